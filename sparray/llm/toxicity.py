"""Toxicity by a string-subsequence-kernel support vector machine with Nystroem landmarks.

Two words are compared by the letter triples they share in order, gaps allowed: a triple that spans s letters weighs
DECAY**s, up to SPAN letters, word ends included, and the kernel is normalised. So an insult keeps most of its kernel
value with a letter put in, left out or repeated, and a stem with any ending resembles its other forms. A squared-hinge
machine is trained on the kernel values to LANDMARKS words (Nystroem features). Kernel and machine together are linear
in the triples, so scoring a word is one weighted sum over its triples.

Labels belong to texts; which words earn them is found in rounds: at first each toxic text is represented by that of its
words, much rarer in clean texts, which the most toxic texts hold; then by its best-scoring word; such words of very many
toxic texts are positives throughout, while clean texts give their best-scoring words as negatives. A text's score is the
higher of two logistic curves: one over its highest words' values and its number of words, one over the log odds as well
that training texts gave to the words among them that they hold often. So one word that resembles an insult by chance
weighs less than several, or than one that is known. The curves are fitted on training texts whose words are valued by a machine trained on the
other half of them.
Single letters in a row, and letters parted by signs, count as one word too; digits and signs among letters are read as
the letters they look like. Letters beyond the Latin ones share codes by their code point.

The machine is fitted on the driver on a bounded sample of labelled rows (TOXIC, CLEAN, TRAIN_CHARS), whose sets of words
are taken on the executors; every whole text is scored on the executors.

Defined results: null, empty and wordless texts score as the least toxic; rows without an id are scored too and never
train; rows of one id train once, with the least text and the highest label; labels other than 0 and 1 don't train;
repeated rows are scored each; without labels of both kinds every score is 0; an empty table gives an empty result. Texts
of any length are scored whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, quoted

#: Labelled texts that the machine is fitted on, at most of each kind, and the longest among them.
TOXIC, CLEAN, TRAIN_CHARS = 2500, 5000, 30_000
LANDMARKS, ROUNDS, HALF_ROUNDS = 240, 5, 2
SPAN, DECAY = 5, 0.7
#: Parts of the clean texts, of which a round looks for words that resemble insults in one.
PARTS = 6
#: Letters of a word that are compared at a time; longer words are read in overlapping stretches.
LONGEST, OVERLAP = 40, 10
#: Parted letters stand in runs of at most so many.
SHORT = 3
CACHED = 300_000
THRESHOLD = 0.7
#: The value where a text has no word, and where it has a word but no further one.
LOW, MIDDLING = -2.0, -0.6
RIDGE = 0.0005
#: The positives that are also trained on with a letter put in or doubled.
CHANGED = 60
#: Such a word of this share of the toxic texts is a positive throughout.
FREQUENT = 0.02
#: How many times more often toxic texts hold a word that can earn them their label than clean ones do.
RARER = 10
#: Toxic texts that hold a word whose own odds are used.
OFTEN = 5
#: The highest values of a text's words that its score looks at.
TOP = 3
#: A word that is the witness of very many texts counts as this many.
MOST = 20

_LETTERS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß")}
_EDGE, _BASE = 63, 64
#: Digits and signs read as letters (fixed values).
_LOOKS = str.maketrans("013457@$!", "oieastasi")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s{1,3}){3,}[^\W\d_](?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = _BASE**3


#: The codes of letters by code point; those of other letters are shared.
_CODES = np.array([_LETTERS.get(chr(c)) or 27 + c % 36 for c in range(0x180)], dtype=np.int64)


def letters(words: Sequence[str]) -> np.ndarray:
    """A row of codes per word, its ends marked, filled up with 0."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    codes = np.zeros((len(words), int(sizes.max(initial=0)) + 2), dtype=np.int64)
    codes[row, column] = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 27 + points % 36)
    codes[:, 0] = codes[np.arange(len(words)), sizes + 1] = _EDGE
    return codes


def triples(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, triple, weight), sorted, each pair once, weights normalised to a length of one."""
    codes = letters(words)
    wide = codes.shape[1]
    keys, weights = [], []
    for a in range(1, SPAN):
        for b in range(a + 1, SPAN):
            if b >= wide:
                continue
            last = codes[:, b:]
            row, col = np.nonzero(last)
            found = (codes[row, col] * _BASE + codes[row, col + a]) * _BASE + last[row, col]
            keys.append(row * _TABLE + found)
            weights.append(np.full(len(row), DECAY ** (b + 1)))
    if not keys:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    key, weight = key[order[start]], np.add.reduceat(weight[order], start)
    word = key // _TABLE
    length = np.sqrt(np.bincount(word, weight**2, minlength=len(words)))
    return word, key % _TABLE, weight / length[word]


def kernel(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """Normalised kernel values of words against landmarks."""
    mark, triple, weight = triples(landmarks)
    known, place = np.unique(triple, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)))
    table[place, mark] = weight
    out = []
    for i in range(0, len(words), 200):
        some = words[i : i + 200]
        word, triple, weight = triples(some)
        at = np.searchsorted(known, triple)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == triple), at, len(known))
        held = at < len(known)
        block = np.zeros((len(some), len(landmarks)))
        word = word[held]
        if len(word):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            block[word[start]] = np.add.reduceat(table[at[held]] * weight[held, None], start)
        out.append(block)
    return np.concatenate(out) if out else np.empty((0, len(landmarks)))


@dataclass
class Machine:
    """weights[triple] of the collapsed machine, its bias, words known from training with the log odds of holding them, and
    the logistic curves from a text's features to a score, with and without those odds."""

    weights: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)
    curves: np.ndarray = field(default_factory=lambda: np.array([[0.0] * (TOP + 2) + [-30.0]] * 2))

    def words(self, words: Sequence[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            word, triple, weight = triples(some)
            out.append(np.bincount(word, self.weights[triple] * weight, minlength=len(some)) + self.bias)
        return np.concatenate(out) if out else np.empty(0)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(features @ self.curves[:, :-1].T + self.curves[:, -1]).max(axis=1), -30, 30)))


def features(values: Iterable[float], odds: float) -> list[float]:
    """A text's features, given the values of its words and the highest log odds of those known: the TOP highest values,
    each once, how many there are, and the odds."""
    once = set(values)
    top = heapq.nlargest(TOP, once)
    return [*top, *[MIDDLING if top else LOW] * (TOP - len(top)), math.log1p(len(once)), odds]


def parted(read: str) -> list[str]:
    """A long stretch's runs of letters, and joined those in a row that the same sign parts: all, and the short ones."""
    runs, signs = _WORD.findall(read), _WORD.split(read)[1:-1]
    out, at = list(runs), 0
    for _, same in itertools.groupby(signs):
        n = sum(1 for _ in same)
        row = runs[at : at + n + 1]
        at += n
        out.append("".join(row))
        out += ["".join(part) for short, part in itertools.groupby(row, lambda w: len(w) <= SHORT) if short]
    return out


def units(chunk: str) -> list[str]:
    """The words of a lower-cased stretch without blanks: its runs of letters, and all its letters together."""
    if chunk.isalpha():
        found = [chunk]
    else:
        found = _WORD.findall(chunk)
        if found:
            read = chunk.strip(".,;:!?\"'()").translate(_LOOKS)
            found += ["".join(_WORD.findall(read))] if len(chunk) <= LONGEST else parted(read)
    cut = []
    for w in dict.fromkeys(found):
        cut += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - OVERLAP, LONGEST - OVERLAP)]
    return [w for w in cut if len(w) > 2]


def chunks(text: str) -> list[str]:
    """A text's stretches between blanks, lower-cased, and each run of single letters as one."""
    low = text.lower()
    return low.split() + ["".join(_WORD.findall(m)) for m in _SPACED.findall(low)]


def spaced(words: list[str], n: int) -> list[str]:
    """n of the words, evenly over the list, its first among them."""
    return [words[i] for i in np.unique(np.linspace(0, len(words) - 1, min(n, len(words))).astype(int))] if words else []


def variants(word: str) -> list[str]:
    """The word with a letter put in and with a letter doubled, at two places each, the same at every call."""
    h = xxhash.xxh3_64_intdigest(word)
    out = []
    for k in range(2):
        at = 1 + (h >> 16 * k) % (len(word) - 1)
        out += [word[:at] + "xzqjkvwy"[(h >> 16 * k + 8) % 8] + word[at:], word[:at] + word[at - 1 :]]
    return out


def fit_machine(words: list[str], y: np.ndarray, counts: np.ndarray, landmarks: list[str]) -> Machine:
    """Squared hinge with a ridge on Nystroem features, by Newton steps over the rows inside the margin."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    root = vectors[:, values > 1e-8] / np.sqrt(values[values > 1e-8])
    z = kernel(words, landmarks) @ root
    z = np.hstack((z, np.ones((len(z), 1))))
    balance = counts * np.where(y > 0, 0.5 / counts[y > 0].sum(), 0.5 / counts[y < 0].sum())
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * RIDGE
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        inside = y * (z @ w) < 1
        if not inside.any():
            break
        zi = z[inside] * balance[inside, None]
        new = np.linalg.solve(zi.T @ z[inside] + ridge, zi.T @ y[inside])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    alpha = root @ w[:-1]
    mark, triple, weight = triples(landmarks)
    return Machine(np.bincount(triple, weight * alpha[mark], minlength=_TABLE), float(w[-1]))


def words_of(text: str | None) -> list[str]:
    """A text's words, each once, in order of the alphabet."""
    return sorted({u for c in set(chunks(text or "")) for u in units(c)})


def train(texts: Sequence[tuple[str | None, int]]) -> Machine:
    """A machine from (text, label) rows; every row with words counts, copies too."""
    return train_words((words_of(t), y) for t, y in texts)


def train_words(rows: Iterable[tuple[Sequence[str], int]]) -> Machine:
    """A machine from (the text's words, label) rows, the same in whatever order they come."""
    number: dict[str, int] = {}
    # each row's words by number: far smaller than sets of strings
    held = [(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32), label) for words, label in rows if len(words)]
    every = sorted(number)
    order = np.empty(len(every), dtype=np.int32)
    order[[number[w] for w in every]] = np.arange(len(every), dtype=np.int32)
    del number
    held = sorted(((np.sort(order[o]), y) for o, y in held), key=lambda h: (h[1], h[0].tobytes()))
    own, label = [o for o, _ in held], np.array([y for _, y in held])
    del held
    if not (label == 1).any() or (label == 1).all():
        return Machine(np.zeros(_TABLE), -1.0)
    machine = rounds(every, own, label)
    x, disguised = np.empty((len(own), TOP + 2)), []
    half = np.arange(len(own)) % 2
    for h in (0, 1):
        # the words of each half are valued by a machine that hasn't seen it, if that half has both labels
        seen = np.flatnonzero(half != h)
        some = rounds(every, [own[i] for i in seen], label[seen], HALF_ROUNDS) if len(set(label[seen])) == 2 else machine
        mine = np.flatnonzero(half == h)
        value, odds = np.zeros(len(every)), np.zeros(len(every))
        looked = np.unique(np.concatenate([own[i] for i in mine]))
        value[looked] = some.words([every[i] for i in looked])
        odds[np.searchsorted(every, list(some.known))] = list(some.known.values())
        for i in mine:
            x[i] = features(value[own[i]].tolist(), float(odds[own[i]].max()))
        # toxic texts once more, with the words that are known written otherwise
        known = sorted(some.known)
        other = value.copy()
        other[np.searchsorted(every, known)] = some.words([variants(w)[k % 4] for k, w in enumerate(known)])
        disguised += [features(other[own[i]].tolist(), 0.0) for i in mine if label[i] and odds[own[i]].max() > 0]
    hidden = np.array(disguised).reshape(-1, TOP + 2)[:, :-1]
    plain = logistic(np.vstack((x[:, :-1], hidden)), np.append(label, np.ones(len(hidden), dtype=label.dtype)), TOP)
    machine.curves = np.stack((logistic(x, label, TOP), [*plain[:-1], 0.0, plain[-1]]))
    return machine


def rounds(every: list[str], own: list[np.ndarray], label: np.ndarray, turns: int = ROUNDS) -> Machine:
    """The machine of some rows, given as numbers of words in ``every``, which is sorted."""
    sizes = np.zeros((2, len(every)), dtype=np.int64)
    for o, y in zip(own, label, strict=True):
        sizes[int(y), o] += 1
    clean, toxic = int((label == 0).sum()), int((label == 1).sum())
    share = np.stack((sizes[0] / clean, sizes[1] / toxic))
    telling = (sizes[1] > 0) & (share[1] >= RARER * share[0])
    negative = np.flatnonzero(sizes[0] > 0)
    common = negative[np.argsort(-sizes[0][negative], kind="stable")[:1500]]
    mixed = np.fromiter((xxhash.xxh3_64_intdigest(every[i]) for i in negative), dtype=np.uint64, count=len(negative))
    spread = negative[np.argsort(mixed, kind="stable")[:3000]]
    negative = [every[i] for i in (*common, *spread)]
    frequent = Counter({every[i]: int(sizes[1, i]) for i in np.flatnonzero(telling & (sizes[1] >= max(3, FREQUENT * toxic)))})
    value = np.where(telling, sizes[1] - sizes[0] * toxic / clean, 0.0)
    hard: list[str] = []
    machine = Machine(np.zeros(_TABLE), -1.0)
    bad, good = [o for o, y in zip(own, label, strict=True) if y], [o for o, y in zip(own, label, strict=True) if not y]
    first = lambda texts: [int(o[(value[o] + 1e-9 * telling[o]).argmax()]) for o in texts]
    for turn in range(turns):
        witnesses = Counter(every[b] for b in first(bad) if telling[b])
        witnesses |= frequent
        if not witnesses:
            return machine
        if turn:
            # each turn looks at another part of the clean texts
            worst = {every[b]: value[b] for b in first(good[turn % PARTS :: PARTS]) if every[b] not in witnesses}
            hard = list(dict.fromkeys([*hard, *sorted(worst, key=lambda w: (-worst[w], w))[:800]]))
        positive = [w for w, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))]
        other = [w for w in dict.fromkeys([*negative, *hard]) if w not in witnesses]
        marks = list(dict.fromkeys(spaced(positive, LANDMARKS // 2) + spaced([w for w in hard if w not in witnesses], LANDMARKS // 4) + spaced(negative, LANDMARKS // 4)))
        known = set(other)
        changed = [v for w in positive[:CHANGED] for v in variants(w) if v not in known]
        counts = np.array([min(witnesses[w], MOST) for w in positive] + [MOST // 4] * len(changed) + [1] * len(other), dtype=float)
        y = np.array([1.0] * (len(positive) + len(changed)) + [-1.0] * len(other))
        machine = fit_machine(positive + changed + other, y, counts, marks)
        if turn < turns - 1:
            looked = np.unique(np.concatenate([*bad, *good[(turn + 1) % PARTS :: PARTS]]))
            value[looked] = machine.words([every[i] for i in looked])
    odds = np.log((sizes[1] + 0.5) / (toxic + 1)) - np.log((sizes[0] + 0.5) / (clean + 1))
    machine.known = {every[i]: float(odds[i]) for i in np.flatnonzero(telling & (sizes[1] >= OFTEN))}
    return machine


def logistic(x: np.ndarray, y: np.ndarray, falls: int) -> np.ndarray:
    """Weights and offset of a logistic curve of labels over features, by Newton steps with a small ridge. Both labels
    weigh alike. A feature that may only lower the score is left out if it would raise it."""
    z = np.hstack((x, np.ones((len(x), 1))))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    ridge = np.array([3e-3] * x.shape[1] + [1e-8])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(-(z @ w), -30, 30)))
        h = np.maximum(weight * p * (1 - p), 1e-12)
        step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    if w[falls] > 0:
        return logistic(np.where(np.arange(x.shape[1]) == falls, 0.0, x), y, falls)
    return w


class Scorer:
    """A machine with a bounded cache of stretches already scored."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.values: dict[str, float] = {}
        self.odds: dict[str, float] = {}  # of the few stretches that hold a known word

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        parts = [set(chunks(t or "")) for t in texts]
        new = set().union(*parts).difference(self.values)
        if len(self.values) + len(new) > CACHED:
            self.values.clear()
            self.odds.clear()
            new = set().union(*parts)
        if new:
            new = sorted(new)
            split = [units(c) for c in new]
            words = sorted(set(itertools.chain(*split)))
            value = dict(zip(words, self.machine.words(words).tolist(), strict=True))
            self.values.update((c, max((value[u] for u in us), default=LOW)) for c, us in zip(new, split, strict=True))
            known = self.machine.known
            self.odds.update((c, max(known.get(u, 0.0) for u in us)) for c, us in zip(new, split, strict=True) if not known.keys().isdisjoint(us))
        return np.array([features(map(self.values.__getitem__, p), max((self.odds[c] for c in p.intersection(self.odds)), default=0.0)) for p in parts]).reshape(len(parts), TOP + 2)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return self.machine.score(self.features(texts))


def training_rows(docs: DataFrame, labels: DataFrame, may_train: Column, doc_id: str, text: str, label: str, label_id: str) -> Iterator[tuple[list[str], int]]:
    """The bounded sample, as sets of words: of each label, the rows with the least hashes of their id."""
    ids = labels.select(quoted(label_id).alias("id"), quoted(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")).where(may_train)
    some = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id")).limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    chosen = F.broadcast(some[0].union(some[1]))  # at most TOXIC + CLEAN rows
    texts = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("t")).where(F.length("t") <= TRAIN_CHARS)
    found = texts.join(chosen, "id").groupBy("id").agg(F.min(F.struct("t", "y")).alias("r")).select("r.t", "r.y")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(words_of(t)) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["words", "y"])

    for r in found.mapInArrow(split, "words string, y int").toLocalIterator():
        yield r["words"].split(), r["y"]


def toxicity(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id") -> Column:
    """The score of each whole text. may_train: which ids (a column ``id``) the labels may be learnt from."""
    rows = training_rows(docs, labels, F.lit(True) if may_train is None else may_train, doc_id, text, label, label_id)
    sent = docs.sparkSession.sparkContext.broadcast(train_words(rows))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("toxicity", _scorers.clear)
        machine = sent.value
        if id(machine) not in _scorers:
            _scorers.clear()
            _scorers[id(machine)] = Scorer(machine)  # which holds the machine, so the number stays its own
        scorer = _scorers[id(machine)]
        for batch in batches:
            yield pa.array(np.concatenate([scorer.scores(batch.slice(i, 128).to_pylist()) for i in range(0, max(1, len(batch)), 128)]), pa.float64())

    return F.arrow_udf(score, "double")(quoted(text))


#: The scorer of this worker by its machine's number; one at a time.
_scorers: dict[int, Scorer] = {}
