"""HTML extraction by the maximum-scoring subsequence.

A page is read as a sequence of tags and text. Each word scores by the elements it stands in, each tag scores below
zero, and one linear scan finds the contiguous region with the greatest sum, which is the content. Elements that are seldom
content (menus, forms, adverts, comments) start with a weight below zero that labelled pages can outweigh; while it is
below zero, they score below zero word by word and are left out of a region that spans them. The weights come from labelled pages: pages with exactly one ``article`` element label their own words,
and the weights are counted over a bounded sample of them; while scoring, that element itself is not looked at, so pages
without it are treated alike.

Defined results: a null, empty or wordless page has the empty text; unclosed and stray tags are repaired as browsers do
for paragraphs, list items and cells; an unterminated comment, tag or script runs to the end of the page; repeated rows
are extracted each; an empty table gives an empty result and default weights. Pages are read whole, in time that grows with
their length however deep they nest; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Labelled pages that the weights are counted over, at most, and the longest page among them.
SAMPLE = 2000
SAMPLE_CHARS = 200_000

#: Elements whose content is no text of the page (fixed values).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that are left out unless labelled pages say otherwise, and whole names in class, id and role that say the
#: same (fixed values).
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "svg", "select", "button", "object", "canvas", "audio", "video", "head"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup",
    "promo", "promotion", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Elements that part blocks of text, and those that never hold anything (fixed values).
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag closes: the element itself, up to the nearest of these containers (fixed values).
REOPENED = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ENDING = {*REOPENED, *(c for containers in REOPENED.values() for c in containers)}
#: Features of the nearest elements around a word that count for it, from twice as many on.
CONTEXT = 64
#: Elements that hold whole pages or articles; a listed word on them names what they hold somewhere, or a layout.
WHOLE = {"html", "body", "main", "article"}
#: The weight that a listed element or word starts with, and the words outside content that it stands for.
PRIOR = -4.0
PRIOR_WORDS = 5 * math.exp(-PRIOR)
#: Containers that say nothing about their words, so that only what is more telling counts (fixed values).
NEUTRAL = {"html", "body", "div", "span", "article", "main", "section", "table", "tbody", "thead", "tfoot", "tr", "center", "font"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Weights:
    """Scores of words by the features of the elements around them, and of tags."""

    feature: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    word: float = 2.0
    other_tag: float = -0.1
    left_out: float = -0.3

    def context(self, features: tuple[str, ...]) -> float:
        """The score of a word in elements with these features: below 1, and little below 0 where words are left out
        anyway, so that a region can span them."""
        if any(f[0] == "!" and self.feature.get(f, PRIOR) < 0 for f in features):
            return self.left_out
        return math.tanh((self.word + sum(self.feature.get(f, 0.0) for f in features)) / 2)


@dataclass
class Piece:
    """A stretch of text or (text None) a tag."""

    text: str | None
    features: tuple[str, ...]
    block: int
    tag: str = ""
    inside: bool = False  # in an article element


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    """What an element says about its words; "!" marks a listed element or a name made of listed words alone."""
    found = [] if name in NEUTRAL else [f"!{name}" if name in ASIDE else name]
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            for whole in next(g for g in m.groups() if g is not None).lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", whole) if w and not w.isdigit()]
                if name in WHOLE:
                    found += [f".{w}" for w in words if w not in ASIDE_WORDS]
                else:
                    mark = "!." if ASIDE_WORDS.issuperset(words) else "."
                    found += [f"{mark}{w}" for w in words]
    return tuple(found)


def read(page: str) -> list[Piece]:
    """The page as tags and stretches of text, each with the features of the open elements."""
    out: list[Piece] = []
    # name, features so far, in an article, the place of the nearest element from here on down that ends others
    open_: list[tuple[str, tuple[str, ...], bool, int]] = []
    held: Counter = Counter()  # names of the open elements, so that no stray tag looks through them all
    features: tuple[str, ...] = ()
    block, at, inside = 0, 0, False

    def text(upto: int) -> None:
        if upto > at:
            out.append(Piece(page[at:upto], features, block, inside=inside))

    def close(k: int) -> None:
        nonlocal features, inside
        held.subtract(o[0] for o in open_[k:])
        del open_[k:]
        features, inside = (open_[-1][1], open_[-1][2]) if open_ else ((), False)

    search = TOKEN.search
    while m := search(page, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        own = len(out)
        out.append(Piece(None, features, block, ("/" if closing else "") + name, inside))
        if name in BLOCKS:
            block += 1
        if closing:
            for k in range(len(open_) - 1, -1, -1) if held[name] > 0 else ():
                if open_[k][0] == name:
                    close(k)
                    break
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in VOID or name not in BLOCKS and name not in ASIDE and "=" not in m[3]:
            if name == "br":
                out.append(Piece(" ", features, block, inside=inside))
            continue
        if name in BLOCKS:
            # an open paragraph ends where a block begins; an item ends where the next one of its list begins
            for k in range(len(open_) - 1, -1, -1) if held["p"] > 0 else ():
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] in BLOCKS:
                    break
        if name in REOPENED:
            k = open_[-1][3] if open_ else -1
            while k >= 0:
                if open_[k][0] == name or name in ("dt", "dd", "td", "th") and open_[k][0] in REOPENED and REOPENED[open_[k][0]] == REOPENED[name]:
                    close(k)
                    break
                if open_[k][0] in REOPENED[name]:
                    break
                k = open_[k - 1][3] if k else -1
        if own_features := features_of(name, m[3]):
            features = tuple(dict.fromkeys(features + own_features))
            if len(features) > 2 * CONTEXT:
                # the nearest ones, and all that can leave words out, of which there are few
                far = len(features) - CONTEXT
                features = tuple(f for i, f in enumerate(features) if i >= far or f[0] == "!")
        inside = inside or name == "article"
        held[name] += 1
        open_.append((name, features, inside, len(open_) if name in ENDING else open_[-1][3] if open_ else -1))
        out[own].features = features
    text(len(page))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the greatest sum; the first of equals; (0, 0) if none is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


class Extractor:
    def __init__(self, weights: Weights):
        self.weights = weights
        self.known: dict[tuple[str, ...], float] = {}

    def context(self, features: tuple[str, ...]) -> float:
        if features not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[features] = self.weights.context(features)
        return self.known[features]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        pieces = read(page)
        tags, other = self.weights.tag, self.weights.other_tag
        scores = [tags.get(p.tag, other) if p.text is None else self.context(p.features) * len(p.text.split()) for p in pieces]
        start, end = best_region(scores)
        blocks: dict[int, list[str]] = {}
        for p in pieces[start:end]:
            if p.text is not None and self.context(p.features) > 0:
                blocks.setdefault(p.block, []).append(html_module.unescape(p.text))
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


def counted(page: str) -> Counter:
    """Words by feature and tags by name, inside and outside the article element; nothing if there isn't just one."""
    found: Counter = Counter()
    pieces = read(page)
    if sum(p.tag == "article" for p in pieces) != 1:
        return found
    for p in pieces:
        left_out = any(f[0] == "!" for f in p.features)
        if p.text is None:
            # a tag of a menu says nothing about the same tag elsewhere, unless it names the menu
            if not left_out or p.tag.lstrip("/") in ASIDE:
                found["t", p.tag, p.inside and p.tag != "/article"] += 1
        elif n := len(p.text.split()):
            for f in p.features:
                # what stands in a menu is explained by the menu, not by its list items
                if not left_out or f[0] == "!":
                    found["f", f, p.inside] += n
    return found


def learn_weights(pages: DataFrame, key: str, html: str, sample: int = SAMPLE) -> Weights:
    """Log odds of features and tags over a sample of labelled pages, the same at every run: those of least hash, each page
    once."""
    # the hashes of the sample are chosen first, so that only its pages move
    labelled = pages.select(F.xxhash64(quoted(key), quoted(html)).alias("h"), quoted(html).alias("html")).where(F.col("html").contains("<article") & (F.length("html") <= SAMPLE_CHARS))
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = labelled.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counted(page))
            rows = [(*k, n) for k, n in total.items()]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())))})

    rows = some.mapInArrow(count, "kind string, name string, inside boolean, n bigint").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")).collect()
    weights = Weights()
    for r in rows:
        odds = math.log((r["i"] + 5) / (r["o"] + (PRIOR_WORDS if r["kind"] == "f" and r["name"][0] == "!" else 5)))
        if r["kind"] == "f":
            weights.feature[r["name"]] = max(-6.0, min(2.0, odds))
        else:
            # tags cost little inside content, more where they mark its ends
            weights.tag[r["name"]] = -0.1 if odds >= 0 else max(-3.0, odds)
    return weights


def main_text(pages: DataFrame, html: Column, weights: Weights) -> Column:
    """The main text of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        extractor = Extractor(sent.value)
        for batch in batches:
            yield pa.array([extractor.extract(p) for i in range(0, len(batch), 64) for p in batch.slice(i, 64).to_pylist()], pa.string())

    return F.arrow_udf(extract, "string")(html)


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = "url", weights: Weights | None = None) -> DataFrame:
    """(key[, url], text): every page with its main text."""
    weights = weights or learn_weights(pages, key, html)
    kept = [quoted(c) for c in (key, url) if c]
    return pages.select(*kept, main_text(pages, quoted(html), weights).alias("text"))
