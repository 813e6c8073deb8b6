"""Problem 3: splitting oversized texts at natural boundaries.

A text is cut into byte ranges. Workers detect the boundaries of a range; one byte on either side is enough to see a
no-break space whole, and what a range cannot know, whether a run of white space began before it and what stands
before that run, is a short summary carried from range to range. Prefix sums of the ranges' lengths turn places in a
range into places in the text. The boundary tables are read in order of the ranges, never as one row, and of them only
the window behind the last cut is held; pieces come out as byte offsets. The result does not depend on where ranges
begin. The same code serves rows of a table and files too large to load (split_files).

A piece ends at the last paragraph end in its second half, else the last line end, sentence end or word end there, else
at the last of these in its first half, else at a multiple of CELL characters of the text; it begins at the first word
at or after the last OVERLAP characters of the piece before, or at a multiple of CELL there.

Defined results: null, empty and short texts have no pieces here; rows of one doc_id count once; a file's invalid bytes
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import durable, once_per_key, sized_join, table

LIMIT = 6000
OVERLAP = 200
#: Bytes of a range: of texts in a table, and of files.
RANGE_BYTES, FILE_RANGE_BYTES = 4_096, 1_048_576
#: Of the word ends in so many characters of the text the last is kept, and every multiple is a possible cut of last resort.
CELL = 32

WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
_ENDS = np.frombuffer(b".!?:;", np.uint8)
_SCALARS = ("n_chars", "lead", "lead_feeds", "tail", "tail_feeds", "ends", "head")


def boundaries(piece: bytes, lead: int, own: int, first_char: int = 0) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """What the range piece[lead:lead+own] knows: a summary, and its boundaries as (code points, bytes, kind) after its start.

    A boundary stands before the first code point after a run of white space; where the run reaches back to the range's
    start it is left to the summary. first_char is how many code points of the text stand before the range.

    Summary: n_chars; lead and lead_feeds, the bytes and line feeds of the white space that the range begins with; tail
    and tail_feeds, the same at its end; ends, whether its last other byte ends a sentence; head, whether a code point
    begins right after the lead.
    """
    whole = np.frombuffer(piece, np.uint8)
    # white space: ASCII blanks, and the no-break space, whose two bytes count as blanks
    blank = (whole == 32) | ((whole >= 9) & (whole <= 13))
    nbsp = np.flatnonzero((whole[:-1] == 0xC2) & (whole[1:] == 0xA0))
    blank[nbsp] = blank[nbsp + 1] = True
    b, blank = whole[lead : lead + own], blank[lead : lead + own]
    start = (b & 0xC0) != 0x80
    number = np.cumsum(start) - 1
    text = np.flatnonzero(~blank)
    first, last = (int(text[0]), int(text[-1])) if len(text) else (own, -1)
    feeds = np.cumsum(b == 10)
    about = {
        "n_chars": int(start.sum()), "lead": first, "lead_feeds": int(feeds[first - 1]) if first else 0, "tail": own - 1 - last, "tail_feeds": int(feeds[-1] - (feeds[last] if last >= 0 else 0)),
        "ends": bool(last >= 0 and b[last] in _ENDS), "head": bool(first < own and start[first]),
    }
    pos = np.flatnonzero(start & ~blank & np.r_[False, blank[:-1]])
    pos = pos[pos > first]
    # what the run of white space before pos holds, and what stands before the run
    prev = text[np.searchsorted(text, pos) - 1]
    n_feeds = feeds[pos - 1] - feeds[prev]
    kind = np.where(n_feeds >= 2, PARAGRAPH, np.where(n_feeds == 1, LINE, np.where(np.isin(b[prev], _ENDS), SENTENCE, WORD))).astype(np.int8)
    at = number[pos]
    keep = last_in_cell(at + first_char, kind)
    pos, at, kind = pos[keep], at[keep], kind[keep]
    grid = np.flatnonzero(start)[-first_char % CELL :: CELL]
    at, byte, kind = np.r_[at, number[grid]], np.r_[pos, grid], np.r_[kind, np.zeros(len(grid), np.int8)]
    order = np.lexsort((kind, at))
    return about, at[order], byte[order], kind[order]


def last_in_cell(at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which boundaries are kept: all but the word ends that are followed by another boundary in their cell."""
    keep = np.ones(len(at), bool)
    real = np.flatnonzero(kind > 0)
    cell = at[real] // CELL
    keep[real[:-1]] = (kind[real[:-1]] > WORD) | (cell[1:] != cell[:-1])
    return keep


class Cutter:
    """Cuts one text whose boundary tables come range by range, holding no more than a window of them."""

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP):
        self.limit, self.overlap = limit, overlap
        self.at, self.byte, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.chars = self.bytes = self.start = self.start_byte = self.pieces = 0
        self.run = self.feeds = 0
        self.ends = False

    def _piece(self, end: int, end_byte: int) -> tuple[int, int, int, int, int]:
        self.pieces += 1
        return self.pieces, self.start, end, self.start_byte, end_byte

    def feed(self, about: dict, own: int, at: np.ndarray, byte: np.ndarray, kind: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The pieces that are certain once the next range is known."""
        at, byte = at + self.chars, byte + self.bytes
        if about["head"] and self.run + about["lead"] and self.bytes + about["lead"]:
            n = self.feeds + about["lead_feeds"]
            what = PARAGRAPH if n >= 2 else LINE if n == 1 else SENTENCE if self.ends else WORD
            # the lead's code points: the grid and n_chars count them, a no-break space has two bytes
            here = self.chars + about["lead_chars"]
            i = int(np.searchsorted(at, here, "right"))
            at, byte, kind = np.insert(at, i, here), np.insert(byte, i, self.bytes + about["lead"]), np.insert(kind, i, what)
        if about["lead"] == own:
            self.run, self.feeds = self.run + own, self.feeds + about["lead_feeds"]
        else:
            self.run, self.feeds, self.ends = about["tail"], about["tail_feeds"], about["ends"]
        self.at, self.byte, self.kind = np.r_[self.at, at], np.r_[self.byte, byte], np.r_[self.kind, kind]
        self.chars, self.bytes = self.chars + about["n_chars"], self.bytes + own
        return self._cut(self.chars - CELL)

    def _cut(self, known: int) -> list[tuple[int, int, int, int, int]]:
        out = []
        while known - self.start > self.limit:
            keep = last_in_cell(self.at, self.kind)
            if not keep.all():
                self.at, self.byte, self.kind = self.at[keep], self.byte[keep], self.kind[keep]
            at, kind, start = self.at, self.kind, self.start
            lo, hi = np.searchsorted(at, start + self.overlap, "right"), np.searchsorted(at, start + self.limit, "right")
            half = max(lo, np.searchsorted(at, start + self.limit // 2, "left"))
            base = int(half if half < hi and kind[half:hi].max() else lo)
            k = kind[base:hi]
            best = base + len(k) - 1 - int(np.argmax(k[::-1] == k.max()))
            out.append(self._piece(int(at[best]), int(self.byte[best])))
            # the next piece repeats the last characters, from a word on
            back = int(np.searchsorted(at, at[best] - self.overlap, "left"))
            words = np.flatnonzero(kind[back:best] > 0)
            first = back + int(words[0]) if len(words) else back
            self.start, self.start_byte = int(at[first]), int(self.byte[first])
            self.at, self.byte, self.kind = at[first:], self.byte[first:], kind[first:]
        return out

    def finish(self) -> list[tuple[int, int, int, int, int]]:
        return [*self._cut(self.chars), self._piece(self.chars, self.bytes)]


_DETECTED = "range_no int, own int, lead_chars int, " + ", ".join(f"{c} {'boolean' if c in ('ends', 'head') else 'int'}" for c in _SCALARS) + ", at array<int>, byte array<int>, kind array<byte>"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        owns = b.column("own").to_pylist()
        pieces, leads = b.column("piece").to_pylist(), b.column("lead").to_pylist()
        rows = [boundaries(p, lead, own, at) for p, lead, own, at in zip(pieces, leads, owns, b.column("first_char").to_pylist(), strict=True)]
        lead_chars = [sum((c & 0xC0) != 0x80 for c in p[lead : lead + r[0]["lead"]]) for p, lead, r in zip(pieces, leads, rows, strict=True)]
        lists = [pa.array([r[i] for r in rows], pa.list_(t)) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int8()))]
        scalars = [pa.array([r[0][c] for r in rows], pa.bool_() if c in ("ends", "head") else pa.int32()) for c in _SCALARS]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("range_no"), b.column("own"), pa.array(lead_chars, pa.int32()), *scalars, *lists], names=["key", "range_no", "own", "lead_chars", *_SCALARS, "at", "byte", "kind"])


def ranges_of_texts(long: DataFrame, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, range_no, piece, lead, own, first_char): the byte ranges of each text, with a byte on either side."""
    kind = long.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                firsts = range(0, len(raw), range_bytes)
                before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                cols = [pa.array(range(len(firsts)), pa.int32()), pa.array([raw[max(f - 1, 0) : f + range_bytes + 1] for f in firsts], pa.binary()), pa.array([min(f, 1) for f in firsts], pa.int32()), pa.array([min(range_bytes, len(raw) - f) for f in firsts], pa.int32()), pa.array(before[list(firsts)], pa.int64())]
                keys = pa.concat_arrays([b.column("key").slice(i, 1)] * len(firsts)) if len(firsts) else b.column("key").slice(0, 0)
                yield pa.RecordBatch.from_arrays([keys, *cols], names=["key", "range_no", "piece", "lead", "own", "first_char"])

    return long.select(F.col(key).alias("key"), "text").mapInArrow(cut, f"key {kind}, range_no int, piece binary, lead int, own int, first_char long")


_PIECE = ("piece_no", "start", "end", "start_byte", "end_byte")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of the texts whose ranges come in order."""
    key, cutter, kind = None, None, None

    def batch(k, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([k] * len(rows), kind), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["key", *_PIECE])

    for b in batches:
        kind = b.column("key").type
        lists = {c: (b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy(zero_copy_only=False)) for c in ("at", "byte", "kind")}
        scalars = b.select(["key", "own", "lead_chars", *_SCALARS]).to_pylist()
        for i, about in enumerate(scalars):
            if cutter is None or about["key"] != key:
                if cutter is not None:
                    yield batch(key, cutter.finish())
                key, cutter = about["key"], Cutter()
            at, byte, what = (v[o[i] : o[i + 1]] for o, v in lists.values())
            if rows := cutter.feed(about, about["own"], at.astype(np.int64), byte.astype(np.int64), what):
                yield batch(key, rows)
    if cutter is not None:
        yield batch(key, cutter.finish())


def offsets(ranges: DataFrame) -> DataFrame:
    """(key, piece_no, start, end, start_byte, end_byte): where each piece begins and ends, from the ranges' tables alone."""
    kind = ranges.schema["key"].dataType.simpleString()
    tables = ranges.mapInArrow(_detect, f"key {kind}, {_DETECTED}")
    return tables.repartition("key").sortWithinPartitions("key", "range_no").mapInArrow(_pieces, f"key {kind}, piece_no int, start long, end long, start_byte long, end_byte long")


def long_texts(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    return once_per_key(documents.select("doc_id", "text").where(F.length("text") > limit), "doc_id")


def split_texts(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, piece_no, start, end, text) of every text over LIMIT characters.

    The offsets are brought to the texts, by broadcast where they are counted few, so that texts then stay in place.
    """
    long = long_texts(documents)
    at = durable(offsets(ranges_of_texts(long, "doc_id", range_bytes)).withColumnRenamed("key", "doc_id"), "offsets")
    both = sized_join(long.select("doc_id", F.encode("text", "UTF-8").alias("b")), at, ["doc_id"])
    text = F.decode(F.substring("b", (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    return both.select("doc_id", "piece_no", "start", "end", text.alias("text"))


def split_files(spark: SparkSession, uris: list[str], range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start, end, text): the pieces of UTF-8 files on any file system that pyarrow opens by URI or path.

    Ranges and pieces are read by offset, no file as a whole. A first pass counts the code points of each range; their
    prefix sums, one number a range, say where in the text a range begins.
    """
    from pyarrow import fs

    def opened(uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        return system.open_input_file(path)

    sizes = []
    for u in uris:
        system, path = fs.FileSystem.from_uri(u)
        sizes.append((u, system.get_file_info(path).size))
    files = spark.createDataFrame(sizes, "key string, n long").where("n > 0")
    each = files.select("key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.lit(range_bytes)).cast("int"))).alias("range_no"))
    each = each.repartition(max(1, sum(n for _, n in sizes) // (16 * range_bytes)))

    def read(rows, with_halo: bool):
        for key, n, r in rows:
            first = r * range_bytes
            lead = min(first, 1) if with_halo else 0
            own = min(range_bytes, n - first)
            with opened(key) as f:
                yield key, r, f.read_at(min(n - first + lead, lead + own + with_halo), first - lead), lead, own

    def count(batches):
        for b in batches:
            rows = read(zip(*(b.column(c).to_pylist() for c in ("key", "n", "range_no")), strict=True), False)
            n = [int(((np.frombuffer(p, np.uint8) & 0xC0) != 0x80).sum()) for _, _, p, _, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("range_no"), pa.array(n, pa.int64())], names=["key", "n", "range_no", "n_chars"])

    def ranges(batches):
        for b in batches:
            for i, row in enumerate(read(zip(*(b.column(c).to_pylist() for c in ("key", "n", "range_no")), strict=True), True)):
                cols = [pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, b.column("first_char").slice(i, 1)], names=["key", "range_no", "piece", "lead", "own", "first_char"])

    def emit(batches):
        for b in batches:
            text = []
            for uri, s, e in zip(b.column("key").to_pylist(), b.column("start_byte").to_pylist(), b.column("end_byte").to_pylist(), strict=True):
                with opened(uri) as f:
                    text.append(f.read_at(e - s, s).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("piece_no"), b.column("start"), b.column("end"), pa.array(text, pa.string())], names=["path", "piece_no", "start", "end", "text"])

    counted = each.mapInArrow(count, "key string, n long, range_no int, n_chars long")
    before = F.sum("n_chars").over(Window.partitionBy("key").orderBy("range_no")) - F.col("n_chars")
    placed = counted.select("key", "n", "range_no", before.alias("first_char")).repartition(max(1, sum(n for _, n in sizes) // (16 * range_bytes)), "key", "range_no")
    cut = offsets(placed.mapInArrow(ranges, "key string, range_no int, piece binary, lead int, own int, first_char long"))
    return cut.repartition(max(1, sum(n for _, n in sizes) // (16 * range_bytes)), "key", "piece_no").mapInArrow(emit, "path string, piece_no int, start long, end long, text string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(ranges_of_texts(long_texts(table(spark, sf_dir, "documents")), "doc_id")).where("piece_no = 2").select(F.col("key").alias("doc_id"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES = {"p3_found": f"select distinct doc_id from documents where length(text) > {LIMIT}"}
