"""N-gram Jaccard join: near-duplicate classes of whole texts by their sets of word shingles.

1. Texts with the same set are one node, known by a digest of the set.
2. Counting. Sizes fall into bands. Two sets that are similar enough differ in at most d elements, d following from
   their sizes, so when each is dealt into k parts by hash, at least k - d parts are equal. A set has a key per part, in
   its own band and in the next one where a partner may be there. A set of which fewer than k - d keys are held by any
   other set has no partner and goes; of what is left, a set goes of whose shingles too few are held by another that is
   left. Passages that many texts share don't make a text pass unless it consists of them. Keys held by several sets of
   one batch of texts are counted there, and a batch sends one entry a key, so no group makes a hot key. Keys are cut
   short, and holders in several batches may be counted twice; both only ever add sets.
3. Candidates. Among the sets left, star links join the holders of a part key (of parts of two elements or more, where
   enough remain). Their components hold all similar pairs.
4. Tiles. A component of bounded size is one tile; a larger one is cut into tiles by size band and hash, and only tiles
   of the same or adjacent bands meet. In a tile every text has a parity bitmap of its hashed shingles; the bits in which
   two bitmaps differ bound the overlap from above. First the bitmaps alone cut components down, in large tiles; then
   pairs that pass are settled in small tiles by intersecting the sorted arrays. Pairs already in one class are not
   compared again.
5. The classes are the connected components of the links found.

No link is lost: the part argument is exact, and the bitmaps only ever bound from above.

Defined results: a text of fewer words than a shingle is one shingle; a null, empty or blank text has no shingles and is
linked with nothing; rows that share an id count as one document, linked by any of its texts; a row with a null id is
returned with its size and no class; an empty table gives an empty result. Texts are read whole, however long; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FITTING, claim, fitting, materialize, quoted, scratch
from .graph import components

WORDS = 3
SIMILARITY = (90, 100)
#: Keys that are combined before the shuffle, about.
BATCH_KEYS = 1_000_000
#: Bytes of text per bucket of keys, about; a bucket's entries are sorted in one worker's memory.
BUCKET_BYTES = 32_000_000
#: Bytes of text per shuffle partition of buckets; a partition goes through its buckets one by one.
PARTITION_BYTES = 256_000_000
MIN_BUCKETS = 256
#: Texts of one tile of bitmaps, and texts and shingles of one tile of texts, about.
TILE_MAPS = 8192
TILE_TEXTS = 1024
TILE_SHINGLES = 4_000_000
#: Bits of the signatures that are stored, at most.
SIGNATURE_BITS = 2048
#: Words whose hashes a worker keeps; a full cache starts anew.
CACHED = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_word_hashes = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(found))
    with np.errstate(over="ignore"):
        rolled = np.full(len(found) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            rolled = mix(rolled * _M1 + hashes[k : len(found) - n + 1 + k])
    return np.unique(rolled)


class Bands:
    """Size bands and what follows from them for a similarity of num/den or more."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        self.tops: list[int] = []
        while not self.tops or self.tops[-1] < 2**40:
            low = self.tops[-1] + 1 if self.tops else 1
            # at least as wide as one partner's reach, so partners are in the same or an adjacent band
            self.tops.append(max(low * 3 // 2, low * self.den // self.num))

    def of(self, size: int) -> int:
        return bisect_left(self.tops, size)

    def spaces(self, size: int) -> list[int]:
        band = self.of(size)
        return [band, band + 1] if size * self.den // self.num > self.tops[band] else [band]

    def parts(self, space: int) -> int:
        """The number of parts in a band's key space; none where similar sets of that size are the same."""
        differ = 2 * self.tops[space] * (self.den - self.num) // (self.den + self.num)
        return differ + 3 + differ // 8 if differ else 0

    def differ(self, size: int, space: int) -> int:
        """The most elements in which a set of this size and a partner that it meets in the space can differ."""
        partner = min(self.tops[space], size * self.den // self.num)
        return (size + partner) * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * shared >= self.num * (len(a) + len(b) - shared)


#: Of one set: a key space, its keys there, and how many of them another set must hold as well.
Keyed = list[tuple[int, np.ndarray, int]]


def part_keys(found: np.ndarray, bands: Bands, fewest: int = 1) -> Keyed:
    """The keys of a set's parts; found is sorted, so the parts are stretches of it. Parts of less than ``fewest`` elements
    are left out where enough others remain."""
    out: Keyed = []
    if not len(found):
        return out
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(found + _M2))))
        for space in bands.spaces(len(found)):
            k = bands.parts(space)
            if not k:
                continue
            part = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
            keys = mix((sums[edges[1:]] - sums[edges[:-1]]) * _M1 + mix(np.arange(k, dtype=np.uint64) + np.uint64(space << 40) * _M3))
            need = k - bands.differ(len(found), space)
            for least in range(fewest, -1, -1):
                full = np.diff(edges) >= least
                if (few := k - int(full.sum())) < need:
                    # a set that has to fall back may share but one key with a partner that hasn't
                    out.append((space, keys[full], need - few if least == fewest else 1))
                    break
    return out


def shingle_keys(found: np.ndarray, bands: Bands) -> Keyed:
    """All of a set's shingles: a partner holds so many of them."""
    return [(-1, mix(found), -(-bands.num * len(found) // bands.den))] if len(found) else []


KEYED = "kind int, doc_id bigint, n bigint, d1 bigint, d2 bigint, sid bigint, bucket int, entries binary"
_KEYED = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "d1", "d2", "sid")), ("bucket", pa.int32()), ("entries", pa.binary())])
#: Kinds of rows: a text's size and digest; a set in a key space with the keys that it needs; keys of its that others
#: were found to hold; keys of a bucket with their holders.
TEXT, SET, SHARED, KEYS = range(4)


def _rows(kind: int, **columns: object) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _KEYED], schema=_KEYED)


def space_ids(d1: int, spaces: list[int]) -> np.ndarray:
    """The numbers of a set in its key spaces: 56 bits, none 0."""
    with np.errstate(over="ignore"):
        own = mix(np.uint64(d1 % 2**64) + np.array(spaces, dtype=np.int64).astype(np.uint64) * _M3)
    return ((own >> np.uint64(8)) | np.uint64(1)).astype(np.int64)


def runs(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by key and holder, each pair once; the start of each key's run, and whether it has several holders."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])))
    keys, sids = keys[fresh], sids[fresh]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys, sids, start, np.diff(np.append(start, len(keys))) > 1


def packed(keys: np.ndarray, sids: np.ndarray, bits: int) -> bytes:
    """Twelve bytes an entry: of the key the 40 bits below the ``bits`` that tell the bucket, of the holder 56 bits."""
    cut = (keys >> np.uint64(max(0, 24 - bits))) & np.uint64(2**40 - 1)
    return np.uint64(len(keys)).tobytes() + (cut >> np.uint64(8)).astype("<u4").tobytes() + ((cut << np.uint64(56)) | sids.astype(np.uint64)).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    high, low = np.frombuffer(blob, "<u4", n, 8), np.frombuffer(blob, "<u8", n, 8 + 4 * n)
    return (high.astype(np.uint64) << np.uint64(8)) | (low >> np.uint64(56)), (low & np.uint64(2**56 - 1)).astype(np.int64)


def combined(keys: np.ndarray, sids: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The keys of a batch: those that several of its sets hold are counted here; each goes to its bucket once, with its
    holder, or with 0 if its holders are counted already."""
    keys, sids, start, several = runs(keys, sids)
    shared = np.repeat(several, np.diff(np.append(start, len(keys))))
    if shared.any():
        own, n = np.unique(sids[shared], return_counts=True)
        yield _rows(SHARED, sid=own, n=n, bucket=(own % n_buckets).astype(np.int32))
    keys, sids = keys[start], np.where(several, 0, sids[start])
    bits = n_buckets.bit_length() - 1
    where = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(n_buckets + 1, dtype=np.uint64))
    for first in range(0, n_buckets, 4096):
        some = first + np.flatnonzero(np.diff(where[first : first + 4097]))
        if len(some):
            yield _rows(KEYS, bucket=some, entries=[packed(keys[where[b] : where[b + 1]], sids[where[b] : where[b + 1]], bits) for b in some.tolist()])


def keyed(docs: DataFrame, words: int, keys_of: Callable[[np.ndarray], Keyed], n_buckets: int) -> DataFrame:
    """Of (doc_id, raw), rows of all kinds: of each text its size and digest, and its keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes", _word_hashes.clear)
        keys, sids, held, seen, row = [], [], 0, set(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(i, 256).to_pylist()
                texts = [(found := shingles((t or "").encode("utf-8", "surrogatepass"), words), *digest(found)) for t in batch.column(1).slice(i, 256).to_pylist()]
                yield _rows(TEXT, doc_id=ids, n=[len(f) for f, _, _ in texts], d1=[a for _, a, _ in texts], d2=[b for _, _, b in texts], bucket=[(row + k) % n_buckets for k in range(len(ids))])
                row += len(ids)
                sets = []
                for node, (found, d1, d2) in zip(ids, texts, strict=True):
                    if node is None or (d1, d2) in seen:
                        continue
                    seen.add((d1, d2))
                    own = keys_of(found)
                    for sid, (_, k, need) in zip(space_ids(d1, [s for s, _, _ in own]).tolist(), own, strict=True):
                        sets.append((d1, d2, sid, need))
                        keys.append(k)
                        sids.append(np.full(len(k), sid, dtype=np.int64))
                        held += len(k)
                if sets:
                    d1s, d2s, own_sids, needs = zip(*sets, strict=True)
                    yield _rows(SET, d1=d1s, d2=d2s, sid=own_sids, n=needs, bucket=[s % n_buckets for s in own_sids])
                if held >= BATCH_KEYS:
                    yield from combined(np.concatenate(keys), np.concatenate(sids), n_buckets)
                    keys, sids, held, seen = [], [], 0, set()
        if held:
            yield from combined(np.concatenate(keys), np.concatenate(sids), n_buckets)

    return docs.select("doc_id", "raw").mapInArrow(sign, KEYED)


def digest(found: np.ndarray) -> tuple[int, int]:
    one, two = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(one), int(two)


def counted(rows: DataFrame, partitions: int) -> DataFrame:
    """rows with the keys of each bucket made into counts. A bucket has one entry per key and batch of texts."""

    def of(blobs: list[bytes]) -> np.ndarray:
        parts = [unpacked(b) for b in blobs]
        keys, sids, start, several = runs(np.concatenate([k for k, _ in parts]), np.concatenate([s for _, s in parts]))
        return sids[np.repeat(several, np.diff(np.append(start, len(keys)))) & (sids != 0)]

    def summed(shared: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(shared), return_counts=True)
        return _rows(SHARED, sid=own, n=n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, shared = [], None, []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if len(other := np.flatnonzero(kinds != KEYS)):
                yield batch.take(pa.array(other))
            some = batch.take(pa.array(np.flatnonzero(kinds == KEYS)))
            for bucket, blob in zip(some.column(6).to_pylist(), some.column(7).to_pylist(), strict=True):
                if bucket != now and held:
                    shared.append(of(held))
                    held = []
                    if sum(map(len, shared)) >= BATCH_KEYS:
                        yield summed(shared)
                        shared = []
                now = bucket
                held.append(blob)
        if held:
            shared.append(of(held))
        if shared:
            yield summed(shared)

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count, KEYED).drop("bucket", "entries")


def possible(rows: DataFrame) -> DataFrame:
    """(d1, d2) of the sets of which others hold as many keys as a partner would."""
    shared = rows.where(F.col("kind") == SHARED).groupBy("sid").agg(F.sum("n").alias("held"))
    sets = rows.where(F.col("kind") == SET).select("sid", "d1", "d2", F.col("n").alias("need")).distinct()
    return sets.join(shared, "sid").where(F.col("held") >= F.col("need")).select("d1", "d2").distinct()


def signature_bits(n: int) -> int:
    """The width of a stored signature for a set of n shingles."""
    return min(SIGNATURE_BITS, max(256, 1 << (2 * n).bit_length()))


def bitmap(found: np.ndarray, bits: int) -> bytes:
    """For each place, whether an odd number of shingles hash to it."""
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller width: its halves laid over each other."""
    out = np.frombuffer(raw, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def pair_links(ids: np.ndarray, side: np.ndarray, sizes: np.ndarray, maps: np.ndarray, bands: Bands, settle: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that join the classes of one tile, members in order of size; of two sides only pairs across them are looked
    at. The bits in which two bitmaps differ are at most the elements in which the sets do."""
    two = len(np.unique(side)) > 1
    label = np.arange(len(ids))
    links = []
    for i in range(len(ids)):
        end = int(np.searchsorted(sizes, sizes[i] * bands.den // bands.num, side="right"))
        near = np.arange(i + 1, end)
        near = near[label[near] != label[i]]
        if two:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        differ = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        near = near[differ * (bands.den + bands.num) <= (sizes[near] + sizes[i]) * (bands.den - bands.num)]
        for j in near.tolist():
            if label[j] != label[i] and (ids[i] == ids[j] or settle(i, j)):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def tile_links(nodes: list[int], sides: list[int], sets: list[np.ndarray], bands: Bands) -> list[tuple[int, int]]:
    """The exact links of one tile."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = min(16384, max(256, 1 << int(2 * sizes.max()).bit_length()))
    maps = np.stack([np.frombuffer(bitmap(s, bits), np.uint64) for s in sets])
    return pair_links(np.array(nodes, dtype=np.int64)[order], np.array(sides)[order], sizes, maps, bands, lambda i, j: bands.linked(sets[i], sets[j]))


def signature_links(nodes: list[int], sides: list[int], sizes: list[int], raw: list[bytes], bands: Bands) -> list[tuple[int, int]]:
    """Links between all members of one tile that their signatures do not tell apart."""
    order = np.argsort(sizes, kind="stable")
    width = min(map(len, raw))
    maps = np.stack([folded(raw[i], width) for i in order])
    return pair_links(np.array(nodes, dtype=np.int64)[order], np.array(sides)[order], np.array(sizes, dtype=np.int64)[order], maps, bands, lambda i, j: True)


def tiles(nodes: DataFrame, bands: Bands, texts: int, shingles: int) -> DataFrame:
    """(node, n, tile, side): the tiles in which each row of (node, n, component) takes part."""
    band = F.lit(0)
    for top in bands.tops[:-1]:
        band = band + (F.col("n") > top).cast("int")
    placed = nodes.withColumn("band", band)
    few = placed.count() <= FITTING  # so there are no more components, nor bands of them

    def counts(df: DataFrame, name: str) -> DataFrame:
        return F.broadcast(df) if few else materialize(df, name).hint("merge")

    whole = placed.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    own = placed.join(counts(whole.select("component", ((F.col("texts") <= texts) & (F.col("shingles") <= shingles)).alias("small")), "components"), "component")
    single = own.where("small").select("node", "n", F.col("component").cast("string").alias("tile"), F.lit(0).alias("side"))
    large = own.where(~F.col("small")).drop("small")
    cuts = large.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / texts), F.ceil(F.sum("n") / shingles)).cast("int").alias("cuts"))
    for name, shift in (("own", 0), ("up", 1), ("down", -1)):
        large = large.join(counts(cuts.select("component", (F.col("band") - shift).alias("band"), F.col("cuts").alias(name)), name), ["component", "band"], "left")
    large = large.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda *parts: F.concat_ws(":", F.col("component"), *parts)
    met = F.concat(
        F.transform(upto("own"), lambda t: F.struct(name(F.col("band"), F.lit("="), F.least(t, F.col("cut")), F.greatest(t, F.col("cut"))).alias("tile"), (F.col("cut") > t).cast("int").alias("side"))),
        F.transform(upto("up"), lambda t: F.struct(name(F.col("band"), F.lit("<"), F.col("cut"), t).alias("tile"), F.lit(0).alias("side"))),
        F.transform(upto("down"), lambda t: F.struct(name(F.col("band") - 1, F.lit("<"), t, F.col("cut")).alias("tile"), F.lit(1).alias("side"))),
    )
    return single.union(large.select("node", "n", F.explode(met).alias("m")).select("node", "n", "m.tile", "m.side"))


def by_tile(batches: Iterable[pa.RecordBatch], read: Callable[..., tuple], link: Callable[..., list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """The links of each tile of a stream sorted by tile, whose other columns ``read`` turns into what ``link`` takes."""
    held: list[tuple] = []
    now = None

    def done() -> pa.RecordBatch:
        links = link(*map(list, zip(*held, strict=True)))
        return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for tile, *rest in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns), strict=True):
                if tile != now and held:
                    yield done()
                    held = []
                now = tile
                held.append(read(*rest))
    if held:
        yield done()


def refined(signatures: DataFrame, placed: DataFrame, bands: Bands) -> DataFrame:
    """(u, v): links between the members of tiles that signatures do not tell apart; rows are a few hundred bytes."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_tile(batches, lambda node, side, n, raw: (node, side, n, raw), lambda nodes, sides, sizes, raw: signature_links(nodes, sides, sizes, raw, bands))

    rows = signatures.join(placed, ["node", "n"]).select("tile", "node", "side", "n", "bitmap")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(refine, "u bigint, v bigint")


def settled(texts: DataFrame, placed: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(u, v): the links found in all tiles by the texts themselves."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes", _word_hashes.clear)
        read = lambda node, side, raw: (node, side, shingles((raw or "").encode("utf-8", "surrogatepass"), words))
        yield from by_tile(batches, read, lambda nodes, sides, sets: tile_links(nodes, sides, sets, bands))

    rows = texts.join(placed, ["node", "n"]).select("tile", "node", "side", "raw")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(settle, "u bigint, v bigint")


ENTRIES = "key bigint, node bigint, n bigint, bitmap binary, raw string"
_ENTRIES = pa.schema([*((c, pa.int64()) for c in ("key", "node", "n")), ("bitmap", pa.binary()), ("raw", pa.string())])


def part_entries(texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Of (node, raw): each text with its size and signature, and (raw null there) its part keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes", _word_hashes.clear)
        for batch in batches:
            for node, raw in ((n, t) for i in range(0, batch.num_rows, 64) for n, t in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns), strict=True)):
                found = shingles((raw or "").encode("utf-8", "surrogatepass"), words)
                keys = np.concatenate([k for _, k, _ in part_keys(found, bands, fewest=2)] or [np.empty(0, dtype=np.uint64)]).view(np.int64)
                rest = [None] * len(keys)
                columns = ([None, *keys.tolist()], [node] * (len(keys) + 1), [len(found), *rest], [bitmap(found, signature_bits(len(found))), *rest], [raw or "", *rest])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRIES, strict=True)], schema=_ENTRIES)

    return texts.select("node", "raw").mapInArrow(sign, ENTRIES)


def grouped(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n, component) of every node that has a link."""
    stars_of = components(links.select("u", "v"))
    tops = stars_of.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stars_of.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
    return materialize(sizes.join(fitting(found), "node"), "nodes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id): per row its set size and the smallest document reachable by links."""
    plain = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("raw"))
    with scratch(docs.sparkSession):
        sized, classes = _classes(plain, words, Bands(similarity))
    out = sized.join(classes.hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))


def _classes(plain: DataFrame, words: int, bands: Bands) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, d1, d2) of each row of (doc_id, raw), and (doc_id, class)."""
    shuffled = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counts(texts: DataFrame, keys_of: Callable[[np.ndarray], Keyed], name: str) -> DataFrame:
        size = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
        n_buckets = 1 << (max(MIN_BUCKETS, 8 * shuffled, size // BUCKET_BYTES) - 1).bit_length()
        rows = keyed(texts, words, keys_of, n_buckets)
        return materialize(counted(rows, max(shuffled, size // PARTITION_BYTES)), name, "kind")

    own = counts(plain, lambda found: part_keys(found, bands), "keyed")
    sized = materialize(own.where(F.col("kind") == TEXT).select("doc_id", "n", "d1", "d2"), "sized", keep=True)
    filled = sized.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # of the copies of a set the smallest document stands for all
    first = materialize(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "first")

    def standing(rows: DataFrame) -> DataFrame | None:
        """(doc_id): the documents of the sets that may have a partner by these counts; None if there are none."""
        sets = materialize(possible(rows), "possible")
        if not (n := sets.count()):
            return None
        ids = first.join(F.broadcast(sets) if n <= FITTING else sets.hint("merge"), ["d1", "d2"]).select(F.col("node").alias("doc_id")).distinct()
        return F.broadcast(ids) if n <= FITTING else materialize(ids, "standing").hint("merge")

    def links() -> DataFrame | None:
        """(u, v): links that join the nodes of each class, u and v nodes that stand for their sets."""
        if (ids := standing(own)) is None:
            return None
        texts = materialize(plain.join(ids, "doc_id"), "texts")
        if (ids := standing(counts(texts, lambda found: shingle_keys(found, bands), "recounted"))) is None:
            return None
        left = texts.join(ids, "doc_id").select(F.col("doc_id").alias("node"), "raw")
        entries = materialize(part_entries(left, words, bands), "entries")
        whole = entries.where("raw is not null").drop("key")
        sizes = whole.select("node", "n").distinct()
        keys = entries.where("raw is null").select("key", "node").distinct()
        least = materialize(keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("k")).where("k > 1").select("key", "v"), "least")
        stars = keys.join(least.hint("merge"), "key").where("node <> v").select(F.col("node").alias("u"), "v")
        # parts can be alike by shared passages; signatures cut such components down before texts are moved
        alike = refined(whole, tiles(grouped(stars, sizes), bands, TILE_MAPS, 2**62), bands)
        return settled(whole, tiles(grouped(alike, sizes), bands, TILE_TEXTS, TILE_SHINGLES), words, bands)

    node_of = materialize(filled.join(first.hint("merge"), ["d1", "d2"]).select("doc_id", "node").distinct(), "node-of")
    # rows of one id with different texts are one document
    twins = node_of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") < F.col("b"))
    joined = node_of.join(twins.hint("merge"), "doc_id").where(F.col("node") != F.col("a")).select(F.col("node").alias("u"), F.col("a").alias("v"))
    classes = components(joined if (found := links()) is None else found.union(joined))
    of_node = node_of.join(fitting(classes.select(F.col("u").alias("node"), F.col("v").alias("class"))), "node", "left")
    of_doc = of_node.groupBy("doc_id").agg(F.min(F.coalesce("class", "node")).alias("class"))
    return sized, materialize(of_doc, "classes", keep=True)
