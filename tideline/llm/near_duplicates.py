"""Problem 7: near-duplicate texts, by prefix filters under several global orders of the word triples.

Order 0 generates candidates. A set sorted by it (with a mark before and behind) is read as its pairs of neighbours, the
keys. Let two sets of together s triples have c in common. The s - 2c others part the c + 2 common elements of the sorted
union into at most s - 2c + 1 stretches, and neighbours inside a stretch are neighbours in both sets, so the sets share
at least 3c - s + 1 keys: a fifth of the larger set and one more where c is 60 % of the union. A key needs two triples
that stand together, so unlike sets hardly ever share one, however common their triples are. Each text leaves out its
most common keys (the suffix of a global order of keys, counted in a sketch) and may so lose at most as many.

1. One pass counts keys in a sketch (2**SKETCH_BITS logarithmic counters, merged in a tree) and notes each text's
   fingerprint; texts with equal sets share one, and only fingerprints are compared from here on.
2. A second pass sends the kept keys, packed, to as many ranges of keys as the data need; a range yields the pairs that
   meet in it with the number of shared keys. A key that the sketch shows to be hot goes to pairs of blocks of its
   texts instead, each a group of its own, so no task holds more than two blocks of it.
3. Pairs with enough shared keys over all ranges are brought together with their sets; there they must also share
   enough of their prefixes under each of the other orders, and only then are the whole sets compared.

Nothing is lost but by collisions of hashes (44 bits). The sketch only orders keys, so its errors cost time, not pairs.

Defined results: null texts and texts with fewer than three words have no triples and are in no pair; rows of one id
count once; equal texts are pairs of similarity 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import durable, once_per_key, sized_join, table
from .shingles import BITS, batches, fingerprints, mix

#: Common part over union, as a fraction of integers so that the comparison is exact. Must be over a half.
NUM, DEN = 3, 5
SKETCH_BITS, CHUNK_BITS = 24, 20
#: Partitions whose sketches one task adds up.
FAN_IN = 32
#: Orders besides the first under which candidates must share prefix triples.
OTHER_ORDERS = (1, 2)
#: Keys handled by one range, keys a task holds before it sends them off, and texts in a block of a hot key.
RANGE_KEYS, FLUSH_KEYS, BLOCK = 2_000_000, 3_000_000, 2_048
#: A key with so many texts is hot, or with so many times the mean of a counter where that is more.
HOT_TEXTS, HOT_MEANS = 4_096, 8
#: Pairs that a task holds before it combines those of the same two texts.
COMBINE = 3_000_000


def left_out(n, num: int, den: int):
    """How many of its most common keys a set of n leaves out: three quarters of those it could do without."""
    return n * (2 * num - den) * 3 // (4 * den)


def least_keys(na: Column, nb: Column, num: int, den: int) -> Column:
    """How many kept keys two similar sets share at least."""
    s = na + nb
    common = F.floor((s * num + (num + den - 1)) / F.lit(num + den))
    out = F.floor(F.greatest(na, nb) * ((2 * num - den) * 3) / F.lit(4 * den))
    return F.greatest(3 * common - s + 1 - out, F.lit(1))


def least_shared(n, num: int, den: int):
    """l: how many prefix triples a set of n must share under another order; the prefixes grow by as many."""
    return np.minimum(1 + n // 20, -(-n * num // den))


def prefix_length(n, num: int, den: int):
    return n - -(-n * num // den) + least_shared(n, num, den)


def _zip(x: np.ndarray) -> bytes:
    """Compressed plane by plane, so that high bytes that are all zero take no room."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def neighbour_keys(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key of BITS bits) of every two neighbours of each sorted set, and of its first and last triple alone."""
    some = np.flatnonzero(n > 0)
    last = np.cumsum(n)[some] - 1
    first = last - n[some] + 1
    inner = np.flatnonzero(text[1:] == text[:-1])
    two = h[inner] * np.uint64(0xD6E8FEB86659FD93) + mix(h[inner + 1] + np.uint64(3))
    key = mix(np.concatenate([two, h[first] + np.uint64(11 << 50), h[last] + np.uint64(13 << 50)]))
    return np.concatenate([text[inner], some, some]), key >> np.uint64(64 - BITS)


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of a power of two."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _counts(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / 8.0) - 1.0


_COUNT = "chunk int, grp int, counts binary, tag int, id long, fp long, n int"


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's (tag, id, fp, n), and the partition's part of the sketch, by chunks."""
    from pyspark import TaskContext

    grp = TaskContext.get().partitionId() // FAN_IN
    sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
    none = lambda k, t: pa.nulls(k, t)
    for b in parts:
        texts, tags, ids = b.column("text").to_pylist(), b.column("tag").to_pylist(), b.column("id").to_pylist()
        ns, fps = [], []
        for lo, hi, text, h in batches(texts, tags):
            n, fp = fingerprints(text, h, hi - lo)
            ns.append(n)
            fps.append(fp)
            cell, k = np.unique(neighbour_keys(text, h, n)[1] >> np.uint64(BITS - SKETCH_BITS), return_counts=True)
            cell = cell.astype(np.int64)
            sketch[cell] = np.minimum(65_535, sketch[cell] + k)
        if texts:
            m = len(texts)
            yield pa.RecordBatch.from_arrays(
                [none(m, pa.int32()), none(m, pa.int32()), none(m, pa.binary()), pa.array(tags, pa.int32()), pa.array(ids, pa.int64()), pa.array(np.concatenate(fps), pa.int64()), pa.array(np.concatenate(ns), pa.int32())],
                names=["chunk", "grp", "counts", "tag", "id", "fp", "n"],
            )
    size = 1 << CHUNK_BITS
    for c in range(1 << (SKETCH_BITS - CHUNK_BITS)):
        part = sketch[c * size : (c + 1) * size]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([grp], pa.int32()), pa.array([_zip(_code(part))], pa.binary()), none(1, pa.int32()), none(1, pa.int64()), none(1, pa.int64()), none(1, pa.int32())],
                names=["chunk", "grp", "counts", "tag", "id", "fp", "n"],
            )


def _add_counts(key: tuple, t: pa.Table) -> pa.Table:
    total = np.zeros(1 << CHUNK_BITS)
    for x in t.column("counts").to_pylist():
        total += _counts(_unzip(x, np.uint8))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([key[1].as_py() // FAN_IN], pa.int32()), "counts": pa.array([_zip(_code(total))], pa.binary())})


def sketch_of(counted: DataFrame) -> np.ndarray:
    """The whole sketch, of fixed size: added up on the workers, FAN_IN parts at a time, before the driver puts the chunks together."""
    level = counted.where("chunk is not null").select("chunk", "grp", "counts")
    groups = (level.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        level = level.groupBy("chunk", "grp").applyInArrow(_add_counts, "chunk int, grp int, counts binary")
        if groups <= 1:
            break
        groups = -(-groups // FAN_IN)
    whole = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in level.toLocalIterator():
        whole[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = _unzip(bytes(r["counts"]), np.uint8)
    return whole


_POSTED = "g long, i int, j int, fp binary, n binary, doc binary, key binary"


def _row(g: int, i: int, j: int, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([g], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32())] + [pa.array([_zip(c)], pa.binary()) for c in cols],
        names=["g", "i", "j", "fp", "n", "doc", "key"],
    )


def _postings(sketch, n_ranges: int, hot: float, num: int, den: int, flush_keys: int, block: int):
    """Packed kept keys: rows of range g (i = j = -1), sorted by key; of a hot key g, rows of its blocks i and j."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = sketch.value
        held: list[tuple] = []
        seen: set[int] = set()
        size = 0
        nothing = np.zeros(0, np.uint64)

        def flush():
            nonlocal size
            fps, ns = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            base = np.cumsum([0] + [len(x[0]) for x in held])
            doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
            key, code = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            held.clear()
            size = 0
            order = np.argsort(key)
            doc, key, code = doc[order], key[order], code[order]
            warm = _counts(code) >= hot
            if warm.any():
                d, k, c = doc[warm], key[warm], code[warm]
                doc, key = doc[~warm], key[~warm]
                cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    blocks = int(_counts(c[lo : lo + 1])[0] // block) + 1
                    own = (fps[d[lo:hi]].view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                    for o in np.unique(own).tolist():
                        mine = d[lo:hi][own == o]
                        for x in range(blocks):
                            yield _row(int(k[lo]), min(o, x), max(o, x), fps[mine], ns[mine], np.array([o], np.uint32), nothing)
            rng = (key * np.uint64(n_ranges)) >> np.uint64(BITS)
            cut = np.searchsorted(rng, np.arange(n_ranges + 1, dtype=np.uint64))
            for r in range(n_ranges):
                lo, hi = int(cut[r]), int(cut[r + 1])
                if lo < hi:
                    texts, local = np.unique(doc[lo:hi], return_inverse=True)
                    yield _row(r, -1, -1, fps[texts], ns[texts], local.astype(np.uint32), np.diff(key[lo:hi], prepend=np.uint64(0)))

        for b in parts:
            for lo, hi, text, h in batches(b.column("text").to_pylist(), b.column("tag").to_pylist()):
                if not len(h):
                    continue
                n, fp = fingerprints(text, h, hi - lo)
                doc, key = neighbour_keys(text, h, n)
                code = codes[(key >> np.uint64(BITS - SKETCH_BITS)).astype(np.int64)]
                # by text, then from rare to common; of equals by hash
                order = np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (code.astype(np.uint64) << np.uint64(36)) | (mix(key) >> np.uint64(28)))
                doc, key, code = doc[order], key[order], code[order]
                m = np.bincount(doc, minlength=hi - lo)
                place = np.arange(len(doc)) - (np.cumsum(m) - m)[doc]
                new = np.zeros(hi - lo, bool)
                for i, f in enumerate(fp.tolist()):
                    if n[i] and f not in seen:
                        seen.add(f)
                        new[i] = True
                kept = (place < (m - left_out(n, num, den))[doc]) & new[doc]
                held.append((fp, n.astype(np.int32), doc[kept], key[kept], code[kept]))
                size += int(kept.sum())
                if size >= flush_keys:
                    yield from flush()
        if size:
            yield from flush()

    return run


_PAIRS = "fa long, fb long, na int, nb int, c int"
_PAIR_SCHEMA = pa.schema([("fa", pa.int64()), ("fb", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int32())])


class _Pairs:
    """Pairs of numbered sets of fitting sizes, counted."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, num: int, den: int):
        self.ids, self.size, self.num, self.den, self.held, self.n = ids, size, num, den, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.size[a], self.size[b]
        ok = np.minimum(x, y) * self.den >= np.maximum(x, y) * self.num
        if ok.any():
            self.held.append((a[ok] * len(self.ids) + b[ok], np.ones(int(ok.sum()), np.int64)))
            self.n += int(ok.sum())
            if self.n >= COMBINE:
                self._combine()

    def _combine(self) -> None:
        key, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        u, inv = np.unique(key, return_inverse=True)
        self.held, self.n = [(u, np.bincount(inv, c, len(u)).astype(np.int64))], 0

    def table(self) -> pa.Table:
        if not self.held:
            return _PAIR_SCHEMA.empty_table()
        self._combine()
        key, c = self.held[0]
        a, b = key // len(self.ids), key % len(self.ids)
        return pa.table([self.ids[a], self.ids[b], self.size[a].astype(np.int32), self.size[b].astype(np.int32), c.astype(np.int32)], schema=_PAIR_SCHEMA)


def _in_blocks(fp: np.ndarray, n: np.ndarray, own: np.ndarray, num: int, den: int) -> pa.Table:
    """Pairs of a hot key's texts: between two blocks, or inside of one."""
    ids, first = np.unique(fp, return_index=True)
    size, own = n[first].astype(np.int64), own[first]
    pairs = _Pairs(ids, size, num, den)
    one = own.min() == own.max()
    left = np.flatnonzero(own == own.min())
    right = left if one else np.flatnonzero(own != own.min())
    step = max(1, COMBINE // (2 * len(right)))
    for at in range(0, len(left), step):
        a, b = (x.reshape(-1) for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
        if one:
            a, b = a[a < b], b[a < b]
        pairs.add(np.minimum(a, b), np.maximum(a, b))
    return pairs.table()


def _meet(num: int, den: int):
    """The pairs that meet in a range, or in two blocks of a hot key."""

    def run(group: tuple, t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in ("fp", "n", "doc", "key")}
        fps, ns, docs = [_unzip(x, np.int64) for x in cols["fp"]], [_unzip(x, np.int32) for x in cols["n"]], [_unzip(x, np.uint32) for x in cols["doc"]]
        fp, n = np.concatenate(fps), np.concatenate(ns)
        if (i := group[1].as_py()) >= 0:
            own = np.repeat(np.concatenate(docs).astype(np.int64), [len(x) for x in fps])
            if i != group[2].as_py() and own.min() == own.max():
                return _PAIR_SCHEMA.empty_table()
            return _in_blocks(fp, n, own, num, den)
        ids, first, number = np.unique(fp, return_index=True, return_inverse=True)
        base = np.cumsum([0] + [len(x) for x in fps])
        doc = number[np.concatenate([d + np.int64(b) for d, b in zip(docs, base, strict=False)])]
        key = np.concatenate([np.cumsum(_unzip(x, np.uint64), dtype=np.uint64) for x in cols["key"]])
        # by key and then text; equal sets that came from different tasks fall together
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        doc, key = doc[new], key[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        pairs = _Pairs(ids, n[first].astype(np.int64), num, den)
        for d in range(1, int(length.max())):
            # every pair of places d apart in the same run
            runs = length > d
            s, e = start[runs], length[runs] - d
            at = np.repeat(s - np.concatenate([[0], np.cumsum(e)[:-1]]), e)
            at += np.arange(len(at))
            pairs.add(doc[at], doc[at + d])
        return pairs.table()

    return run


def candidates(texts: DataFrame, counted: DataFrame, num: int = NUM, den: int = DEN, range_keys: int = RANGE_KEYS, hot_texts: int = HOT_TEXTS, block: int = BLOCK) -> DataFrame:
    """(fa, fb, na, nb): pairs of sets that share enough keys of the first order."""
    total = counted.where("n > 0").agg(F.sum(F.col("n") + 1 - F.floor(F.col("n") * ((2 * num - den) * 3) / F.lit(4 * den)))).first()[0] or 0
    n_ranges = max(1, -(-total // range_keys))
    hot = max(hot_texts, HOT_MEANS * total / (1 << SKETCH_BITS))
    sketch = texts.sparkSession.sparkContext.broadcast(sketch_of(counted))
    posted = texts.mapInArrow(_postings(sketch, n_ranges, hot, num, den, FLUSH_KEYS, block), _POSTED)
    met = posted.groupBy("g", "i", "j").applyInArrow(_meet(num, den), _PAIRS)
    shared = met.groupBy("fa", "fb").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"))
    return shared.where(F.col("c") >= least_keys(F.col("na"), F.col("nb"), num, den)).select("fa", "fb", "na", "nb")


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for lo, hi, text, h in batches(b.column("text").to_pylist(), b.column("tag").to_pylist()):
            n = np.bincount(text, minlength=hi - lo)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("fp").slice(lo, hi - lo), sets], names=["fp", "s"])


def _verify(num: int, den: int):
    """(fa, fb, common, united) of the pairs that pass the filters of the other orders and are similar."""

    def prefix(s: np.ndarray, order: int) -> np.ndarray:
        by = mix(s + np.uint64(1000 + order))
        p = int(prefix_length(len(s), num, den))
        return np.sort(by if p >= len(s) else np.partition(by, p - 1)[:p])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sides = []
            for c in ("sa", "sb"):
                lists = batch.column(c)
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append([flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            common = np.zeros(len(batch), np.int64)
            for i, (a, b) in enumerate(zip(*sides, strict=True)):
                least = min(int(least_shared(len(a), num, den)), int(least_shared(len(b), num, den)))
                if all(len(np.intersect1d(prefix(a, k), prefix(b, k), assume_unique=True)) >= least for k in OTHER_ORDERS):
                    common[i] = len(np.intersect1d(a, b, assume_unique=True))
            united = np.array([len(a) + len(b) for a, b in zip(*sides, strict=True)], np.int64) - common
            yield pa.RecordBatch.from_arrays([batch.column("fa"), batch.column("fb"), pa.array(common), pa.array(united)], names=["fa", "fb", "common", "united"]).filter(pa.array(common * den >= united * num))

    return run


def similar_sets(texts: DataFrame, num: int = NUM, den: int = DEN, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(fa, fb, common, united) of the similar pairs of different sets, and (tag, id, fp) of every text with a set.

    texts: (tag int, id bigint, text string), one row per tag and id, no null text. sizes: those of candidates().
    """
    if 2 * num <= den:
        raise ValueError("the threshold must be over a half")
    counted = durable(texts.mapInArrow(_count, _COUNT), "counted")
    members = counted.where("id is not null and n > 0").select("tag", "id", "fp")
    pairs = durable(candidates(texts, counted, num, den, **sizes), "candidates")
    wanted = pairs.select(F.explode(F.array("fa", "fb")).alias("fp")).distinct()
    reps = durable(members.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("tag", "id")).alias("r")).select("fp", "r.tag", "r.id"), "reps")
    sets = durable(sized_join(texts, reps, ["tag", "id"]).mapInArrow(_sets, "fp long, s array<long>"), "sets")
    a = pairs.join(sets.select(F.col("fp").alias("fa"), F.col("s").alias("sa")), "fa")
    both = a.join(sets.select(F.col("fp").alias("fb"), F.col("s").alias("sb")), "fb").select("fa", "fb", "sa", "sb")
    return durable(both.mapInArrow(_verify(num, den), "fa long, fb long, common long, united long"), "similar"), members


def both_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = once_per_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.lit(0).alias("tag"), F.col("doc_id").alias("id"), "text")
    anchors = table(spark, sf_dir, "guidance_anchors").where("anchor_id is not null and context is not null").groupBy("anchor_id").agg(F.min("context").alias("text"))
    return docs.where("text is not null").unionByName(anchors.select(F.lit(1).alias("tag"), F.col("anchor_id").alias("id"), "text"))


TABLES = ("documents", "guidance_anchors")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair: similar sets expanded to their texts, and the texts of one set among each other."""
    similar, members = similar_sets(both_tables(spark, sf_dir))
    side = lambda x: members.select(F.col("fp").alias(f"f{x}"), F.col("tag").alias(f"t{x}"), F.col("id").alias(f"i{x}"))
    across = similar.join(side("a"), "fa").join(side("b"), "fb").select(F.col("ta").alias("tag"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    equal = members.groupBy("fp").count().where("count > 1").select("fp")
    copies = members.join(equal, "fp")
    within = copies.select("fp", "tag", F.col("id").alias("id_a")).join(copies.select("fp", F.col("id").alias("id_b")), "fp").where("id_a < id_b").select("tag", "id_a", "id_b")
    return across.unionByName(within).select(F.when(F.col("tag") == 0, TABLES[0]).otherwise(TABLES[1]).alias("table_name"), "id_a", "id_b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges(a, b): root is the least vertex of its component.

    Each round points every vertex at the least of its neighbours' labels and then at that label's label; the tables
    of every round are written, so no lineage grows. Labels of all components converge in rounds, not in steps.
    """
    both = durable(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).where("v <> w").distinct(), "edges")
    label = durable(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "label")
    while True:
        near = both.join(label.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        low = label.join(near, "v").select("v", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("v").alias("low"), F.col("root").alias("root2"))
        new = durable(low.join(jump, "low", "left").select("v", F.col("root").alias("old"), F.least("low", F.coalesce("root2", "low")).alias("root")), "label")
        label = new.select("v", "root")
        if new.where("root <> old").isEmpty():
            return label


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text with triples: its class, the fingerprint class's least id, and how many texts it is linked to."""
    similar, members = similar_sets(both_tables(spark, sf_dir))
    members = durable(members, "members")
    sizes = members.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    comp = components(similar.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    links = similar.select(F.col("fa").alias("fp"), F.col("fb").alias("o")).unionByName(similar.select(F.col("fb").alias("fp"), F.col("fa").alias("o")))
    n_links = links.join(sizes.select(F.col("fp").alias("o"), "n"), "o").groupBy("fp").agg(F.sum("n").alias("others"))
    per_set = sizes.join(comp.withColumnRenamed("v", "fp"), "fp", "left").join(n_links, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("others", F.lit(0)).alias("others"))
    least = per_set.groupBy("root").agg(F.min("least").alias("class_id"))
    known = per_set.join(least, "root").select("fp", "class_id", (F.col("n") - 1 + F.col("others")).alias("links"))
    return members.join(known, "fp").select(F.when(F.col("tag") == 0, TABLES[0]).otherwise(TABLES[1]).alias("table_name"), "id", "class_id", "links")


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
_SIMILAR = """t as (
  select 'documents' as table_name, doc_id as id, min(text) as text from documents where text is not null and doc_id is not null group by doc_id
  union all select 'guidance_anchors', anchor_id, min(context) from guidance_anchors where context is not null and anchor_id is not null group by anchor_id),
w as (select table_name, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from t),
g as (select distinct table_name, id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) as g from w where len(w) >= 3),
n as (select table_name, id, count(*) as n from g group by all),
c as (select a.table_name, a.id as id_a, b.id as id_b, count(*) as c from g a join g b on a.table_name = b.table_name and a.g = b.g and a.id < b.id group by all),
p as (select c.table_name, id_a, id_b from c join n x on x.table_name = c.table_name and x.id = id_a join n y on y.table_name = c.table_name and y.id = id_b where c.c * 5 >= (x.n + y.n - c.c) * 3)"""
ORACLES = {
    "p7_found": f"with {_SIMILAR} select * from p",
    "p7_classes": f"with recursive {_SIMILAR}, e as (select table_name, id_a as v, id_b as o from p union all select table_name, id_b, id_a from p), "
    "r(table_name, v, o) as (select table_name, id, id from n union select r.table_name, r.v, e.o from r join e on e.table_name = r.table_name and e.v = r.o), "
    "k as (select table_name, v, min(o) as class_id from r group by 1, 2), l as (select table_name, v, count(*) as links from e group by 1, 2) "
    "select n.table_name, n.id, class_id, coalesce(links, 0) as links from n join k on k.table_name = n.table_name and k.v = n.id left join l on l.table_name = n.table_name and l.v = n.id",
}
