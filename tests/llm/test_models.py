"""URL filters, top-k search, toxicity, personal data and HTML extraction."""

import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparray.llm import html_extract, pii, queries, topk, toxicity, url_filters
from tests.llm import brute


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


# ---- url filters ----


def judged(url):
    _, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = host.translate(brute.LOWER)
    fits = []
    for rule, action in queries.URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, action))
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.COM/en/x", "http://com/en/", "http://xcom/en/1", "https://a.example.com/en/7?q#f", "https://example.com/en/70", "https://example.com/EN/7", "ftp://u@x.net:80/de/", "http://x.net/de/#a", "http://a.example.net/de/85", "http://org/es", "http://org/es/", "x://a.org/es/y://z", "http://é.com/en/", "http://a.com?x=/en/", "http://spam-farm.example.org/fr/1", "http://www.cheap-pills.example.com/fr/1", "http://pillsbury.com/fr/", "http://a\nb.com/en/"]


def test_url_filters(spark, sf):
    df = spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS)] + [(None, URLS[4])], "page_id bigint, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit(1))
    rules = [url_filters.host_path_rule(*r) for r in queries.URL_RULES]
    out = url_filters.judge_urls(df, [*rules, *url_filters.GENERAL_RULES])
    got = sorted(rows(out, "host", "path", "rule", "verdict", "pattern"), key=str)
    want = []
    for u in [*URLS, URLS[4]]:
        h, p, rule, action = judged(u)
        pattern = None if rule else "spam" if "spam-farm" in h else "pills" if "cheap-pills" in h else None
        want.append((h, p, rule, action or ("block" if pattern else "allow"), pattern))
    assert got == sorted(want, key=str)
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0
    pages = queries.op2_url_filters(spark, sf)
    urls = dict(rows(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "url"))
    for page, h, p, rule in rows(pages, "page_id", "host", "path", "rule"):
        assert (h, p, rule) == judged(urls[page])[:3]


def test_url_rules_as_in_contract(spark, tmp_path):
    """Each rule's word stands here as in the contract, not taken from the code."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://x.net/de/1": ("net/de/", "allow"),
        "http://spam.net/de/": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.example.net/de/85": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
        "http://a.net/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows(queries.op2_url_filters(spark, str(tmp_path)), "page_id", "rule", "verdict")
    assert sorted(got) == [(i, *w) for i, w in enumerate(want.values())]


def test_only_candidates_run():
    """A URL runs the rules under its own tokens, of however many there are."""
    rules = [url_filters.host_path_rule(f"site{i}.com/p/", "block") for i in range(5000)]
    index = url_filters.RuleIndex(rules, {"com": 10**6, "p": 10**5})
    assert index.best("a.site77.com", "/p/q", True).name == "site77.com/p/" and index.expressions_run == 1


def test_rule_blocks(spark, monkeypatch):
    """More rules than a block holds, with general patterns of mixed kinds among them: as by trying every rule."""
    r = random.Random(12)
    rules = [url_filters.host_path_rule(f"site{r.randrange(300)}.com/" + r.choice(("", "p/", "p/q", "en/7")), r.choice(("allow", "block"))) for _ in range(700)]
    rules += [url_filters.pattern_rule(f"w{i}", "block", rf".*\bw{i}\b.*", f"w{i}") for i in range(300)]
    r.shuffle(rules)
    urls = [f"http://{r.choice(('', 'a.', 'x-'))}site{r.randrange(320)}.com/" + r.choice(("", "p/q/r", "en/75", f"w{r.randrange(320)}/x", f"p/w{r.randrange(320)}")) for _ in range(400)]
    want = []
    for u in urls:
        text = u.split("://")[1]
        fit = lambda listed: [(-x.length, i, x) for i, x in enumerate(rules) if x.listed is listed and re.match(x.pattern, text)]
        rule, general = (min(f)[2] if (f := fit(listed)) else None for listed in (True, False))
        want.append((rule and rule.name, (rule or general).action if rule or general else "allow", None if rule else general and general.name))
    monkeypatch.setattr(url_filters, "MAX_RULES", 130)
    df = spark.createDataFrame(list(enumerate(urls)), "`page.id` int, url string").withColumn("best", F.lit(1)).withColumn("key", F.lit(2))
    out = url_filters.judge_urls(df, rules, "page.id")
    assert out.columns == ["page.id", "host", "path", "rule", "verdict", "pattern"]
    got = {i: rest for i, *rest in out.collect()}
    assert [tuple(got[i][2:]) for i in range(len(urls))] == want
    table = spark.createDataFrame([("a.com/x", "block", None, None), ("bad", "block", ".*bad.*", "bad")], "rule string, action string, pattern string, token string")
    assert [x.listed for x in url_filters.rules_of(table)] == [True, False]


# ---- top-k ----


def test_topk_query(spark, sf):
    vectors = dict(rows(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding"))
    ids = np.array(sorted(vectors))
    x = np.floor(64 * np.array([vectors[i] for i in ids], dtype=np.float64)).astype(np.int64)
    want = []
    for a in range(0, len(ids)):
        if ids[a] % 20 == 0:
            s = x @ x[a]
            order = [b for b in np.lexsort((ids, -s)) if b != a][: topk.K]
            want += [(int(ids[a]), r + 1, int(ids[b]), int(s[b])) for r, b in enumerate(order)]
    assert sorted(rows(queries.op3_topk(spark, sf), "query_id", "rank", "vec_id", "score")) == sorted(want)


def test_topk_odd(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    r = random.Random(2)
    data = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(90)]  # many ties
    data += [(100, None), (120, [1.0, None, 0.0, 0.0]), (140, [float("nan"), 0.0, 0.0, 0.0]), (160, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (180, [1.0, 1.0]), (20, data[20][1]), (200, [3e7, -3e7, 1e7, 5e6])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    got = sorted(rows(topk.top_k(df, F.col("vec_id") % 20 == 0, scale=1, k=5), "query_id", "rank", "vec_id", "score"))
    clean = {i: (v + [0.0] * 4)[:4] for i, v in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in sorted(clean):
        if q % 20 == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(clean[q], v, strict=True)), i) for i, v in clean.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 40"), F.lit(True)).count() == 0


def test_threshold_stops_early():
    """With one strong match and peaked lists the search ends before all members are scored."""
    r = np.random.default_rng(0)
    vectors = r.integers(-3, 4, (4000, 3))
    vectors[:50] = r.integers(80, 100, (50, 3))
    lists = topk.SortedLists(np.arange(4000), vectors)
    found = topk.Best(1, 10)
    scored = lists.search(np.array([-1]), np.array([[5, 4, 3]]), found)
    exact = np.lexsort((np.arange(4000), -(vectors @ [5, 4, 3])))[:10]
    assert found.owner[0].tolist() == exact.tolist() and found.score[0].tolist() == (vectors @ [5, 4, 3])[exact].tolist()
    assert scored < 1000


def test_threshold_carries_from_block_to_block():
    """Of clustered vectors in several blocks, well under half of all scores are taken, and the best are exact."""
    r = np.random.default_rng(3)
    centres = r.integers(-40, 40, (20, 16)) * (r.random((20, 16)) < 0.2)
    vectors = centres[np.repeat(np.arange(20), 500)] + r.integers(-2, 3, (10000, 16))
    ids, queries = np.arange(10000), np.arange(0, 10000, 100)
    found, scored = topk.Best(len(queries), 20), 0
    for start in range(0, 10000, 500):
        block = ids[start : start + 500]
        scored += topk.SortedLists(block, vectors[block]).search(queries, vectors[queries], found)
    for i, q in enumerate(queries):
        s = vectors @ vectors[q]
        best = [x for x in np.lexsort((ids, -s)) if x != q][:20]
        assert found.owner[i].tolist() == best and found.score[i].tolist() == s[best].tolist()
    assert scored < 0.5 * len(queries) * 10000


def test_topk_too_large(spark):
    df = spark.createDataFrame([(0, [3e18 / 64]), (1, [3e18 / 64])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df, F.lit(True))


# ---- toxicity ----


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_held_out(spark, sf):
    """Learnt from two thirds of the labels, judged on the last third of a larger table."""
    d = sf.replace("0.001", "0.01")
    got = {i: (h, s, p) for i, h, s, p in rows(queries.op1_toxicity(spark, d), "doc_id", "held_out", "score", "predicted")}
    labels = dict(rows(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "toxic"))
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got.values())
    assert all(h == held(i) for i, (h, _, _) in got.items())
    judged = [(got[i][1], y) for i, y in labels.items() if i in got and got[i][0]]
    toxic, clean = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.8  # 51 toxic texts to learn from here; see the README for larger tables
    assert np.mean(np.array(clean) >= 0.7) < 0.05
    # the same from the definition: the machine of the rows that may train, on the whole texts
    texts = dict(rows(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"))
    machine = toxicity.train([(texts[i], y) for i, y in labels.items() if i in texts and not held(i) and y in (0, 1) and texts[i] is not None and len(texts[i]) <= toxicity.TRAIN_CHARS])
    some = sorted(texts)[::5]
    assert [got[i][1] for i in some] == pytest.approx(toxicity.Scorer(machine).scores([texts[i] for i in some]))


def test_toxicity_score_is_kernel_and_curve():
    """A word's value is the sum over landmarks of weight times kernel; a text's score follows from its words' values."""
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("an", "st", "re") for b in ("or", "ing", "u") for c in ("dle", "x", "mp")]
    y = np.array([1.0 if "ing" in w else -1.0 for w in words])
    marks = words[::3]
    machine = toxicity.fit_machine(words, y, np.ones(len(words)), marks)
    machine.known, machine.curves = {"aningx": 4.0}, np.array([[1.0, 0.5, 0.25, -0.3, 0.2, 0.1], [0.0, 0.0, 0.0, 0.0, 0.0, -9.0]])
    # the collapsed weights are a combination of the landmarks' own
    columns = np.zeros((toxicity._TABLE, len(marks)))
    mark, triple, weight = toxicity.triples(marks)
    columns[triple, mark] = weight
    used = np.flatnonzero(columns.any(axis=1))
    alpha, *_ = np.linalg.lstsq(columns[used], machine.weights[used], rcond=None)
    value = toxicity.kernel(words, marks) @ alpha + machine.bias
    assert machine.words(words) == pytest.approx(value, abs=1e-6)
    text = " ".join(r.sample(words, 9)) + " aningx " + words[0].upper() + "."
    held = sorted({round(v, 9) for w, v in zip([*words, "aningx"], [*value, machine.words(["aningx"])[0]], strict=True) if w in text.lower().replace(".", "").split()}, reverse=True)
    x = sum(c * f for c, f in zip(machine.curves[0], [*held[:3], np.log1p(len(held)), 4.0, 1.0], strict=True))
    assert toxicity.Scorer(machine).scores([text])[0] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-6)


def test_toxicity_odd(spark):
    """Nulls, empty tables, repeated rows, null ids, odd labels, clashing and dotted names, a very long text."""
    r = random.Random(7)
    texts = [(i, made_up_text(r, i % 2 == 0), int(i % 2 == 0)) for i in range(80)]
    long = "plain words " * 100_000
    data = [(i, t, 1.5, "l", 7) for i, t, _ in texts] + [(0, texts[0][1], 1.5, "l", 7), (None, "you idiot scum", 1.5, "l", 7), (90, None, 1.5, "l", 7), (91, "", 1.5, "l", 7), (92, long, 1.5, "l", 7), (93, long + "idiot moron", 1.5, "l", 7)]
    docs = spark.createDataFrame(data, "`a.id` bigint, text string, y double, words string, id int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in texts] + [(None, 1, "x"), (91, None, "x"), (92, 7, "x"), (0, 1, "x")], "doc_id bigint, toxic int, t string")
    score = toxicity.toxicity(docs, labels, doc_id="a.id")
    out = docs.withColumn("score", score)
    assert out.columns == [*docs.columns, "score"] and out.count() == len(data)
    got = {}
    for i, s in rows(out.select(F.col("`a.id`").alias("i"), "score"), "i", "score"):
        got.setdefault(i, []).append(s)
    assert got[0][0] == got[0][1] and got[90] == got[91] and got[None][0] > 0.7 and got[93][0] > got[92][0]
    assert max(got[90][0], got[92][0]) < 0.3
    assert docs.limit(0).select(score).count() == 0
    assert [s for (s,) in docs.select(toxicity.toxicity(docs, labels.limit(0), doc_id="a.id")).distinct().collect()] == pytest.approx([0], abs=1e-9)


def made_up_text(r, bad):
    word = lambda: "".join(r.choice(("an", "be", "the", "or", "to", "ing", "er", "st", "ou", "re")) for _ in range(r.randint(1, 4)))
    insults = ["idiot", "scum", "moron", "stupid", "worthless"]
    return " ".join(word() for _ in range(30)) + (" " + r.choice(insults) + " " + word() if bad else "")


@pytest.fixture(scope="module")
def made_up():
    r = random.Random(1)
    machine = toxicity.train([(made_up_text(r, i % 3 == 0), int(i % 3 == 0)) for i in range(600)])
    return lambda *texts: toxicity.Scorer(machine).scores(texts)


def test_toxicity_tolerates_gaps(made_up):
    assert made_up("you idiot", "m o r o n", "id-iot", "st.u.pid", "1diot").min() > 0.7
    assert made_up("i-d-i-o-t", "stuupid", "worthlesss").min() > 0.5
    assert made_up("the other string", "", None, "  ").max() < 0.3
    nothing = toxicity.train([("only clean", 0)])
    assert toxicity.Scorer(nothing).scores(["idiot", None]).max() == pytest.approx(0, abs=1e-9)


def test_toxicity_false_alarms_on_little_data(made_up):
    r = random.Random(2)
    assert (made_up(*[made_up_text(r, False) for _ in range(400)]) >= toxicity.THRESHOLD).mean() < 0.05


def test_toxicity_reads_long_stretches(made_up):
    """Parted and replaced letters are read in a stretch of any length."""
    some = made_up_text(random.Random(4), False).split()
    hidden = ["i-d-i-o-t", "st.u.pid", "1d1ot", "m.o.r.o.n", "wor-thless"]
    joined = [sign.join([*some[:12], h, *some[12:]]) for h in hidden for sign in ("/", ",", "//")]
    assert min(map(len, joined)) > toxicity.LONGEST
    assert made_up(*joined, "-".join([*(w for w in some if len(w) > 3), "i-d-i-o-t"])).min() > 0.5
    assert made_up(*(sign.join(some) for sign in "/,-.")).max() < 0.7


def test_toxicity_learns_from_every_row():
    """Unrelated texts that share a word are rows of their own: a word of one clean text among them is no insult."""
    r = random.Random(3)
    told = [made_up_text(r, False).split() for _ in range(60)]
    anchor = min({"harbour", "idiot", *(w for t in told for w in t if len(w) > 2)}, key=toxicity.xxhash.xxh3_64_intdigest)
    clean = [" ".join([anchor, *t, *["harbour"] * (i == 0)]) for i, t in enumerate(told[:40])]
    toxic = [" ".join(["idiot", "harbour", *(w for w in t if w != anchor)]) for t in told[40:]]
    machine = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    score = toxicity.Scorer(machine).scores
    assert score(["idiot", *toxic]).min() > 0.7 and score(["harbour", *clean]).max() < 0.7


def test_triples_are_the_kernel():
    """Normalised weights of gapped triples, against their definition."""
    a, b = "abca", "abxc"

    def features(w):
        w = [63, *[ord(c) - 96 for c in w], 63]
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5)


# ---- personal data ----

TEXTS = ["a@b.c_d@e.f", "x@y@z.com é a@b.cc.", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1", "4111 1111 1111 1111 1 4111111111111111", "+1 (988) 555-2485 +12 3 +123456789012345678 ++49 30 12345678-", "", None, "é" * 50 + " a.b@c.de 4111-1111-1111-1111", "a" * 3000 + " " + "1 " * 4000 + "b@c.d", "9" * 20000, "@" * 500 + "a@b.c", "+1" * 300, "12.3.4.5 " * 700 + "x@y.zz"]
MORE = "john (at) example (dot) com and call (555) 123-4567 or host 10[.]0[.]0[.]1 card 4111.1111.1111.1111"


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.models(spark)


def base_list(text):
    return ",".join(f"{k}:{a}:{b}" for k, spans in brute.personal(text).items() for a, b in spans)


def test_pii_base_spans(spark, sf, fitted):
    made = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(None, TEXTS[4])], "doc_id bigint, text string").withColumn("every", F.lit(1))
    for df in (made, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        for text, base, every in rows(pii.with_spans(df, fitted=fitted).select("text", pii.listed("base").alias("base"), pii.listed("all").alias("every")), "text", "base", "every"):
            assert base == base_list(text)
            assert not base or set(base.split(",")) <= set(every.split(","))
    assert pii.with_spans(made.limit(0), fitted=fitted).count() == 0


def test_pii_added_spans(spark, fitted):
    clean = "version 1.2.3 order 4111.1111.1111.1112 isbn 978-3-16-148410-0 year 2024-0101234 we met at noon dot dot"
    df = spark.createDataFrame([(MORE,), (clean,), (None,)], "text string")
    got = {t: s for t, s in rows(pii.with_spans(df, fitted=fitted).select("text", pii.listed("all").alias("s")), "text", "s")}
    assert got[MORE] == "email:0:27,ip:60:74,card:80:99,phone:37:51" and got[clean] == "" and got[None] == ""
    assert [t for (t,) in rows(pii.redact(df, fitted=fitted), "text")] == ["[email] and call [phone] or host [ip] card [card]", clean, None]


AT, DOT = ["(at)", "[at]", "{at}", " (at) ", " [at] "], ["(dot)", "[dot]", "{dot}", " (dot) ", " [dot] "]
ALONE = {
    "email": [f"john{a}example.com" for a in AT] + [f"john@example{d}com" for d in DOT] + [f"john{a}example{d}com" for a, d in zip(AT, DOT, strict=True)] + ["jane.doe(at)mail.example.org"],
    "ip": [f"10{d}0{d}0{d}1" for d in ("[.]", "(.)", "[dot]")] + ["10[.]0.0.1", "10.0[dot]0.1", "10.0.0[.]1", "10[dot]0[dot]0.1", "10(.)0.0(.)1"],
}


@pytest.mark.parametrize("end", ["", ". Then we left", ", or so"])
def test_pii_each_separator_alone(spark, fitted, end):
    """A written-out address is found whatever else its text holds; what only looks like one is not."""
    want = {f"write to {s}{end}": f"{kind}:9:{9 + len(s)}" for kind, spans in ALONE.items() for s in spans}
    clean = ["we met at noon. Then we left", "look at example.com for more", "see @john. Then go", "ten apples (at) 3.50 each", "it is me@home. Then go", "chapter 10 . 2 . 3 . 4", "held at noon dot dot"]
    df = spark.createDataFrame([(t,) for t in [*want, *clean]], "text string")
    got = dict(rows(pii.with_spans(df, fitted=fitted).select("text", pii.listed("all").alias("s")), "text", "s"))
    assert got == want | dict.fromkeys(clean, "")


def test_pii_hints_hold():
    """Each hint holds for every proposal."""
    r = random.Random(5)
    spans = {k.name: [pii.example(k.name, i % 2, r)[1] for i in range(400)] + ALONE.get(k.name, []) for k in pii.KINDS}
    spans["email"] += ["john at example.com", "john at example . com", "john at example{dot}com"]
    spans["phone"] += ["(12) 3456789", "(12)-345 6789"]
    for kind in pii.KINDS:
        met = [s for s in spans[kind.name] if re.search(kind.generator, s)]
        assert len(met) > 200 and all(re.search(kind.generator_hint, s) for s in met)


def test_pii_query_is_native(spark, sf):
    plan = queries.op7_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- html ----


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|h\d|li|ul)\b[^>]*>", "\0", inner)
    inner = re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", inner))
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\0")) if x)


def test_html_query(spark, sf):
    pages = dict(rows(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html"))
    for page, text, n in rows(queries.op9_html_extraction(spark, sf), "page_id", "text", "n_chars"):
        assert text == article(pages[page]) and n == len(text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<!-- <p>never closed", ""), ("<script>var a = '<p>no</p>'", ""),
        ("plain words alone", "plain words alone"),
        ("<p>one <b>two</b>three&nbsp;&amp; four<p>five<br>six", "one twothree & four\nfive six"),
        ("<nav><ul><li>a<li>b</ul></nav><div class='main-content'><h1>T</h1><p>Some words here to read.</div><div id=comments><p>Nice page, thanks for it</div><footer>f</footer>", "T\nSome words here to read."),
        ("<p>before the notice there are words<div class='cookie-notice'><p>We use cookies</div><p>after it are more words", "before the notice there are words\nafter it are more words"),
        ("<p>a &lt;b&gt; c < d</p>", "a <b> c < d"),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one\ntwo\nthree"),
        ("<p title='a>b'>text</p>", "text"),
    ],
)
def test_html_odd(page, text):
    assert html_extract.Extractor(html_extract.Weights()).extract(page) == text


BODY = "<h1>Title</h1><p>Some words here to read.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body class='has-sidebar'>{BODY}", "Title\nSome words here to read."),
        (f"<body class='sidebar'>{BODY}", "Title\nSome words here to read."),
        (f"<div class='page header-fixed'>{BODY}</div>", "Title\nSome words here to read."),
        (f"<article class='post share-enabled'>{BODY}</article>", "Title\nSome words here to read."),
        (f"<main id=form>{BODY}</main>", "Title\nSome words here to read."),
        (f"{BODY}<h2 id='social-impact'>Impact</h2><section id='related-work'><p>Others wrote of it.</section>", "Title\nSome words here to read.\nImpact\nOthers wrote of it."),
        (f"{BODY}<div class='wide sidebar'>left</div><div class=ad-2>buy</div><div class='related'>more</div><nav>menu</nav>", "Title\nSome words here to read."),
    ],
)
def test_html_listed_words(page, text):
    """A listed word marks an element only as a whole name, and never a whole page or article."""
    assert html_extract.Extractor(html_extract.Weights()).extract(page) == text


def test_html_labels_outweigh_the_list(spark):
    inside = "<div class=share><p>" + "many words to read " * 50 + "</p></div>"
    pages = [(i, f"<nav>a menu to leave out</nav><article>{inside}</article><div class=social>follow us all</div>") for i in range(30)]
    weights = html_extract.learn_weights(spark.createDataFrame(pages, "page_id bigint, html string"), "page_id", "html")
    page = "<nav>a menu</nav><div class=share><p>Some words here to read.</p></div><div class=social>follow us</div>"
    assert html_extract.Extractor(weights).extract(page) == "Some words here to read."


def test_html_deep_pages_take_linear_time():
    """Nested sections with classes of their own, stray closing tags, items among many open elements."""
    import time

    extractor = html_extract.Extractor(html_extract.Weights())
    pages = [lambda n: "".join(f"<section class=c{i}>a" for i in range(n)), lambda n: "<div class=x>" * n + "</p></b>" * n + "words here", lambda n: "<li><ul>" + "<span id=a>" * n + "<li>x</li>" * n, lambda n: "<p>" + "<b class=y>" * n + "<div>x" * n]
    for page in pages:
        times = []
        for n in (2000, 16000):
            began = time.process_time()
            assert extractor.extract(page(n))
            times.append(time.process_time() - began)
        assert times[1] < 24 * max(times[0], 0.05)


def test_html_learns_from_few_rows(spark):
    """The sample holds the pages of least hash, each once; repeated rows and keys change nothing."""
    pages = [(i % 7, f"<div class=menu{i % 3}>a menu</div><article><p>{'words to read ' * 20}{i}</p></article>") for i in range(60)]
    df = spark.createDataFrame(pages, "`page.id` int, html string")
    assert html_extract.learn_weights(df, "page.id", "html") == html_extract.learn_weights(df.union(df), "page.id", "html")
    assert html_extract.learn_weights(df, "page.id", "html", sample=5).feature.keys() <= html_extract.learn_weights(df, "page.id", "html").feature.keys()
    assert html_extract.extract_pages(df, "page.id", url=None).columns == ["page.id", "text"]


def test_best_region():
    r = random.Random(4)
    for _ in range(200):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html_extract.best_region(s)
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)
        assert sum(s[a:b]) == max(0, best)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", "<p>x y z"), (None, None, "<p>x y z")], "page_id bigint, url string, html string").withColumn("text", F.lit("t"))
    assert sorted(rows(html_extract.extract_pages(df), "page_id", "url", "text"), key=str) == sorted([(1, "u", ""), (1, "u", "x y z"), (None, None, "x y z")], key=str)
    assert html_extract.extract_pages(df.limit(0)).count() == 0
