"""Personal data by candidate spans and gradient-boosted trees, in DataFrame expressions.

Base patterns (emails, IP addresses, cards, phone numbers) are found and checked as stated in KINDS and always count.
Beside them, one generator of high recall per kind proposes further spans (written-out addresses, bracketed dots, numbers
without a country code, other separators). Boosted trees over format and context features score each proposal; it is
added if its score reaches the kind's calibrated threshold and it overlaps no base span and no such proposal of an
earlier kind (email, ip, card, phone).

The trees are fitted on the driver, with numpy, over EXAMPLES made-up labelled spans whose features Spark computes by the
same expressions; on the corpus they are CASE expressions. No Python runs on the executors.

A text's matches are located by their lengths and those of the stretches between them, in two levels, so a text with very
many matches costs in proportion to its length. All patterns are linear: runs are possessive, and no match starts inside
a run.

Defined results: null and empty texts hold nothing; offsets are code points, ends exclusive; repeated rows are judged
each; a null id is passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered

#: Made-up examples per kind that the trees are fitted on and calibrated with.
EXAMPLES = 600
TREES, DEPTH, RATE = 16, 3, 0.3
#: Precision on the calibration half that a threshold must reach.
PRECISION = 0.995
CHUNK = 256
BEFORE, AFTER = 24, 8


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    padded = F.lpad(number, 19, "0")

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(padded, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when((19 - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), add) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its base pattern with the check a match must pass, its generator, and context words."""

    name: str
    base: str
    check: Callable[[Column], Column]
    hint: str  # a cheap pattern that every text with a match or proposal holds
    generator: str
    generator_hint: str  # likewise, of a proposal
    context: str


#: Matches are leftmost and do not overlap: a match starts at the start of a run, or where the last match ended (\G).
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@",
         rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{{at\}}| at ) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?(?:\(dot\)|\[dot\]|\{{dot\}}| dot ) ?)[A-Za-z0-9-]++)++", r"@|[(\[{]at[)\]}]|[(\[{ ]dot[)\]} ]| at  ?[A-Za-z0-9-]++ ?\.", "mail|contact|write|reach|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), "[0-9]\\.[0-9]",
         r"(?<![0-9])(?=[0-9]{1,3}+(?:\.[0-9]{1,3}+){0,2}(?: ?\[\.\]|\(\.\)|\[dot\]| \. ))[0-9]{1,3}+(?:(?: ?\[\.\] ?|\(\.\)|\[dot\]| \. |\.)[0-9]{1,3}+){3}", r"[\[( ]\.|\[dot\]", "ip|host|server|address|from|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(digits(m)).between(16, 19) & luhn(F.substring(digits(m), 1, 19)), "[0-9][\\x20-]?[0-9]",
         r"(?<![0-9])[0-9]{4}+[ ./_–-]{1,3}+[0-9]{4,6}+[ ./_–-]{1,3}+[0-9]{4,5}+(?:[ ./_–-]{1,3}+[0-9]{1,7}+)?(?![0-9])", "[0-9]{4}[ ./_–-]{1,3}[0-9]{4}", "card|visa|master|amex|credit|debit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(8, 15), "\\+[0-9]",
         r"(?<![0-9.+A-Za-z])(?:00[1-9][0-9]?[ ./-]?)?(?:\([0-9]{2,5}+\)|[0-9]{3,5}+)[ ./-]{1,2}+[0-9]{3,4}+[ ./-]?[0-9]{3,5}+(?![0-9.])", "(?:[0-9]{3}|[0-9]\\))[ ./-]", "tel|phone|call|mobile|cell|fax|telefon|handy|móvil|llam|appel"),
)
NOT_PERSONAL = r"isbn|issn|order|invoice|version|ver\.|release|ref|serial|build|doi|part|item|license|licence|rev|section|page|year|pp?\."

FEATURES = 15


def found_by(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """The matches of a pattern and the stretches between them; nothing where the hint is missing."""
    here = text.rlike(hint)
    return F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")), F.when(here, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))


def located(matches: Column, between: Column) -> Column:
    """Structs (from, to, t, b, a): a match's code point offsets, its text, and what stands before and after it."""
    item = lambda i: F.struct(F.length(between[i]).alias("p"), F.length(matches[i]).alias("m"), matches[i].alias("t"), F.substring(between[i], -BEFORE, BEFORE).alias("b"), F.substring(between[i + 1], 1, AFTER).alias("a"))
    n = F.size(matches)
    items = F.transform(F.sequence(F.lit(0), n - 1), item)
    empty = "array<struct<from:int,to:int,t:string,b:string,a:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        one = F.struct(start.alias("from"), (start + x["m"]).alias("to"), x["t"].alias("t"), x["b"].alias("b"), x["a"].alias("a"))
        return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        part = F.aggregate(F.slice(items, c + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), F.array().cast(empty).alias("out")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    whole = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{empty}>").alias("out")), chunk)
    return F.when(n > 0, F.flatten(whole["out"])).otherwise(F.array().cast(empty))


def features(kind: Kind, c: Column) -> Column:
    """Format and context features of a proposal, as numbers."""
    text, before = c["t"], F.lower(c["b"])
    number = digits(text)
    flag = lambda x: x.cast("double")
    groups = F.filter(F.split(text, "[^0-9]+", -1), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, lambda g: F.length(g))
    return F.array(
        F.length(number).cast("double"),
        flag(luhn(F.substring(number, 1, 19)) & (F.length(number) <= 19)),
        F.length(text).cast("double"),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        flag(before.rlike(rf"(?:{kind.context})")),
        flag(before.rlike(rf"(?:{NOT_PERSONAL})[^a-z]*$")),
        flag(before.rlike(r"[a-z0-9_$€£]$")),
        flag(c["a"].rlike(r"^[A-Za-z0-9_%€$]")),
        flag(text.rlike(r"^\([0-9]")),
        F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[(\[{] ?(?:at|dot|\.) ?[)\]}]"), F.lit(0))).cast("double"),
        F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("[ ./_–-]"), F.lit(0)))).cast("double"),
        flag(F.lower(text).rlike(r"[a-z0-9]@[a-z0-9]|[(\[{]at[)\]}]")),
        flag(F.lower(text).rlike(r"(?:[a-z0-9-]\.|[(\[{]dot[)\]}] ?| dot )[a-z]{2,}$")),
    )


# ---- trees -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A split (feature, cut, below, above), or a leaf (value)."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def column(self, f: Column) -> Column:
        if self.below is None:
            return F.lit(self.value)
        return F.when(f[self.feature] <= self.cut, self.below.column(f)).otherwise(self.above.column(f))

    def score(self, x: np.ndarray) -> float:
        if self.below is None:
            return self.value
        return (self.below if x[self.feature] <= self.cut else self.above).score(x)


def fit_tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Node:
    """A regression tree by second-order gain, over all cuts between distinct values."""
    leaf = lambda g, h: float(-g.sum() / (h.sum() + 1.0))
    gain = lambda g, h: g**2 / (h + 1.0)
    best, where = 1e-6, None
    if depth and len(x) >= 10:
        g, h = gradient.sum(), hessian.sum()
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            values = x[order, k]
            cuts = np.flatnonzero(values[1:] > values[:-1])
            gl, hl = np.cumsum(gradient[order])[cuts], np.cumsum(hessian[order])[cuts]
            gains = gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h)
            if len(gains) and gains.max() > best:
                at = cuts[int(gains.argmax())]
                best, where = float(gains.max()), (k, float(values[at] + values[at + 1]) / 2)
    if where is None:
        return Node(leaf(gradient, hessian))
    low = x[:, where[0]] <= where[1]
    return Node(0.0, *where, fit_tree(x[low], gradient[low], hessian[low], depth - 1), fit_tree(x[~low], gradient[~low], hessian[~low], depth - 1))


@dataclass(frozen=True)
class Model:
    trees: tuple[Node, ...]
    threshold: float

    def column(self, f: Column) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + t.column(f) * RATE
        return total


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on the even rows; the threshold is the least score on the odd rows with the wanted precision."""
    own, rest = slice(0, None, 2), slice(1, None, 2)
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = fit_tree(x[own], (p - y)[own], (p * (1 - p))[own], DEPTH)
        trees.append(tree)
        score += RATE * np.array([tree.score(row) for row in x])
    order = np.argsort(-score[rest], kind="stable")
    ranked, truth = score[rest][order], y[rest][order]
    precision = np.cumsum(truth) / np.arange(1, len(truth) + 1)
    last = np.append(ranked[1:] < ranked[:-1], True)  # a threshold falls between distinct scores
    good = np.flatnonzero((precision >= PRECISION) & last)
    return Model(tuple(trees), float(ranked[good[-1]]) if len(good) else float("inf"))


# ---- examples --------------------------------------------------------------------------------------------------------


def _luhn_digit(number: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(number)))
    return str(-total % 10)


def example(kind: str, label: int, r: random.Random) -> tuple[str, str, str]:
    """A made-up span with what stands before and after it."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "be", "the", "or", "to", "ing", "er", "st", "ou", "re")) for _ in range(r.randint(1, 3)))
    before = f"{word()} {word()} "
    told = {"email": ("email me ", "contact ", "mail: ", "write to "), "ip": ("from host ", "server ", "ip ", "client "), "card": ("card ", "visa ", "credit card no ", "debit "), "phone": ("call ", "tel ", "phone: ", "mobile ")}[kind]
    other = ("order ", "invoice no ", "version ", "ref ", "serial ", "isbn ", "section ", "build ", "item ", "part ")
    after = r.choice((" ", ".", ", ", " " + word()))
    if kind == "email":
        whole = (("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), (" (at) ", " (dot) "), (" [at] ", " [dot] "))
        half = [(a, d) for a, _ in whole for d in (".", " dot ")] + [("@", d) for d in (*(d for _, d in whole), " dot ")]
        at, dot = r.choice(whole if r.random() < 0.5 else half) if label or r.random() < 0.2 else (" at ", r.choice((".", " dot ")))
        span = f"{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de')) if label else word()}"
        if not label and at != " at ":
            # a bare "at", a mention, or a price, of which an address has none
            span = r.choice((span.replace(at, " at "), f"{word()} @{word()}{dot}{word()}", f"{word()}{at}{number(2)}.{number(2)}", f"{word()}{at}{word()} . {word()}"))
    elif kind == "ip":
        dot = r.choice(("[.]", "(.)", "[dot]")) if label else " . "
        dots = [dot] * 3
        if label and r.random() < 0.5:  # half-written: one or two of the dots are plain
            for i in r.sample(range(3), r.randint(1, 2)):
                dots[i] = "."
        span = "".join(str(r.randint(0, 255) if label else r.randint(0, 999)) + d for d in (*dots, ""))
    elif kind == "card":
        sep = r.choice((".", "/", "  ", "--", "_", " - "))
        raw = r.choice("3456") + number(14)
        raw += _luhn_digit(raw)
        if not label:
            raw = raw[:15] + str((int(raw[15]) + r.randint(1, 9)) % 10)
        span = sep.join(raw[i : i + 4] for i in range(0, 16, 4))
    else:
        sep = r.choice(("-", " ", ".", "/"))
        if label:
            span = f"({number(3)}) {number(3)}{r.choice('- ')}{number(4)}" if r.random() < 0.7 else f"{number(3)}{sep}{number(3)}{sep}{number(4)}"
        else:
            span = r.choice((f"{number(4)}{sep}{number(4)}{sep}{number(4)}", f"{r.randint(1900, 2030)}-{number(3)}{number(4)}", f"{number(3)}{sep}{number(3)}{sep}{number(3)}", f"{number(5)} {number(3)}{number(3)}"))
    if label and (r.random() < 0.6 or kind == "phone" and not span.startswith("(")):
        before += r.choice(told)
    elif not label and r.random() < 0.5:
        before += r.choice(other)
    return before, span, after


def models(spark: SparkSession, seed: int = 7) -> dict[str, Model]:
    """Each kind's trees and threshold; the examples' features come from the expressions that the corpus gets."""
    r = random.Random(seed)
    out = {}
    for kind in KINDS:
        labels = [i // 2 % 2 for i in range(EXAMPLES)]
        lines = "\x1e".join("\x1f".join(example(kind.name, y, r)) for y in labels)
        parts = F.split(F.col("line"), "\x1f", -1)
        rows = spark.range(1).select(F.posexplode(F.split(F.lit(lines), "\x1e", -1)).alias("i", "line"))
        rows = rows.select("i", F.struct(parts[0].alias("b"), parts[1].alias("t"), parts[2].alias("a")).alias("c"))
        got = rows.select("i", features(kind, F.col("c")).alias("f")).orderBy("i").collect()  # EXAMPLES rows
        out[kind.name] = fit(np.array([g["f"] for g in got]), np.array(labels, dtype=float))
    return out


# ---- spans -----------------------------------------------------------------------------------------------------------


def own(bound: object, f: Callable[[object, Column], Column]) -> Callable[[Column], Column]:
    """f of an element, with its first argument bound."""
    return lambda s: f(bound, s)


def overlaps(a: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (a["from"] < o["to"]) & (o["from"] < a["to"]))


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "pii_", fitted: dict[str, Model] | None = None) -> DataFrame:
    """docs and, for each kind, the columns <prefix>base_<kind> and <prefix>all_<kind>: arrays of (from, to), in place of
    columns of these names."""
    added = [f"{prefix}{part}_{k.name}" for part in ("base", "all") for k in KINDS]
    own_columns, (text,), names = numbered(docs, text, without=tuple(added))
    return _spans(own_columns, text, prefix, fitted or models(docs.sparkSession)).toDF(*names, *added)


def _spans(docs: DataFrame, text: str, prefix: str, fitted: dict[str, Model]) -> DataFrame:
    whole, kept = F.coalesce(F.col(text), F.lit("")), docs.columns
    col = lambda part, kind: f"{prefix}{part}_{kind.name}"
    out = docs
    for kind in KINDS:
        for part, pattern, hint in (("base", kind.base, kind.hint), ("more", kind.generator, kind.generator_hint)):
            matches, between = found_by(whole, pattern, hint)
            out = out.withColumns({col(f"{part}m", kind): matches, col(f"{part}p", kind): between})
    checked = {col("base", k): F.filter(located(F.col(col("basem", k)), F.col(col("basep", k))), own(k, lambda k, s: k.check(s["t"]))) for k in KINDS}
    proposed = {col("more", k): located(F.col(col("morem", k)), F.col(col("morep", k))) for k in KINDS}
    out = out.select(*kept, *[c.alias(n) for n, c in (checked | proposed).items()])
    span = lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))
    base = {k.name: F.transform(col("base", k), span) for k in KINDS}
    scored = {k.name: F.transform(col("more", k), own(k, lambda k, s: F.struct(s["from"].alias("from"), s["to"].alias("to"), features(k, s).alias("f")))) for k in KINDS}
    out = out.select(*kept, *[base[k.name].alias(col("base", k)) for k in KINDS], *[scored[k.name].alias(col("more", k)) for k in KINDS])
    every_base = F.concat(*[F.col(col("base", k)) for k in KINDS])
    out = out.withColumn(f"{prefix}every", every_base)
    good = {k: F.filter(F.col(col("more", k)), own(k, lambda k, s: (fitted[k.name].column(s["f"]) >= fitted[k.name].threshold) & ~overlaps(s, F.col(f"{prefix}every")))) for k in KINDS}
    out = out.withColumns({col("good", k): F.transform(good[k], span) for k in KINDS})
    taken: list[Column] = []
    added = {}
    for k in KINDS:
        good_ones = F.col(col("good", k))
        added[k.name] = F.filter(good_ones, own(taken, lambda t, s: ~overlaps(s, F.concat(*t)))) if taken else good_ones
        taken = [*taken, good_ones]
    return out.select(*kept, *[F.col(col("base", k)) for k in KINDS], *[F.array_sort(F.concat(F.col(col("base", k)), added[k.name])).alias(col("all", k)) for k in KINDS])


def listed(part: str, prefix: str = "pii_") -> Column:
    """All spans of a part as kind:from:to, comma-joined, by kind and then by place."""
    each = [F.transform(f"{prefix}{part}_{k.name}", own(k, lambda k, s: F.concat_ws(":", F.lit(k.name), s["from"], s["to"]))) for k in KINDS]
    return F.array_join(F.concat(*each), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]", fitted: dict[str, Model] | None = None) -> DataFrame:
    """docs with every span of every kind replaced by its kind's name in brackets, and all other columns as they are."""
    docs, (text,), names = numbered(docs, text)
    found = with_spans(docs, text, "__pii_", fitted)
    spans = F.array_sort(F.concat(*[F.transform(f"__pii_all_{k.name}", own(k, lambda k, s: F.struct(s["from"].alias("from"), s["to"].alias("to"), F.lit(mark.format(k.name)).alias("mark")))) for k in KINDS]))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["from"] >= acc["at"]
        cut = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["from"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["to"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(cut, s["mark"]))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    done = found.withColumn("__pii_cut", folded)
    rest = F.substring(F.col(text), F.col("__pii_cut.at") + 1, F.length(text))
    return done.withColumn(text, F.when(F.size("__pii_cut.out") > 0, F.concat(F.array_join("__pii_cut.out", ""), rest)).otherwise(F.col(text))).select(*docs.columns).toDF(*names)
