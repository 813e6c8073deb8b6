"""Problem 8: filling fixed-capacity containers.

Bounded-space packing: items are spread over partitions by a hash of their id; a partition keeps OPEN windows, puts
each item into the fullest window it fits in, and, when it fits in none, emits the fullest window and opens a new one.
The windows left open at the end are merged level by level, MERGE partitions at a time, so no task ever holds more
than MERGE x OPEN of them.

Defined results: null texts and texts without tokens are no items; a text over the capacity is cut into full pieces,
each a container of its own, and a rest that is packed like any item; rows of one doc_id count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import durable, table
from .tokens import token_counts

CAPACITY = 2048
OPEN = 128
MERGE = 64
ITEMS_PER_PARTITION = 50_000

_OUT = "level int, part long, seq int, leftover boolean, fill long, items array<struct<doc_id long, piece_no int, tokens long>>"


def pack(items: list[tuple[int, list]], capacity: int, n_open: int) -> tuple[list, list]:
    """(closed, left open): containers as (fill, members) from items of (size, members), in the order given."""
    open_: list[tuple[int, int]] = []  # (room, number), by room
    held: dict[int, tuple[int, list]] = {}
    closed, number = [], 0
    for size, members in items:
        i = bisect_left(open_, (size, -1))
        if i < len(open_):
            room, k = open_.pop(i)
            fill, inside = held.pop(k)
        else:
            if len(open_) >= n_open:
                closed.append(held.pop(open_.pop(0)[1]))
            room, fill, inside = capacity, 0, []
            k = number
            number += 1
        inside = inside + members
        if room == size:
            closed.append((fill + size, inside))
        else:
            held[k] = (fill + size, inside)
            insort(open_, (room - size, k))
    return closed, [held[k] for _, k in open_]


def _level(level: int, capacity: int, n_open: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        rows = sorted((-int(f) if level else int(o), [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in ms], int(f)) for f, ms, o in zip(pdf["fill"], pdf["items"], pdf["ord"], strict=True))
        closed, left = pack([(f, ms) for _, ms, f in rows], capacity, n_open)
        boxes = [(c, False) for c in closed] + [(c, not last) for c in left]
        out = [(level, part, i, rest, fill, [{"doc_id": d, "piece_no": p, "tokens": t} for d, p, t in ms]) for i, ((fill, ms), rest) in enumerate(boxes)]
        return pd.DataFrame(out, columns=["level", "part", "seq", "leftover", "fill", "items"])

    return run


def containers(sizes: DataFrame, capacity: int = CAPACITY, n_open: int = OPEN, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(container_id, fill, items) for sizes(doc_id, tokens)."""
    sizes = durable(sizes.where("tokens > 0").select("doc_id", "tokens"), "sizes")
    parts = max(1, -(-sizes.count() // items_per_partition))
    pieces = sizes.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.lit(capacity)).cast("int")), lambda i: F.struct((i + 1).cast("int").alias("piece_no"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - i * F.lit(capacity)).alias("tokens")))).alias("p"))
    item = F.array(F.struct("doc_id", F.col("p.piece_no").alias("piece_no"), F.col("p.tokens").alias("tokens")))
    full = pieces.where(F.col("p.tokens") == capacity).select(F.concat_ws("-", F.lit("full"), "doc_id", "p.piece_no").alias("container_id"), F.col("p.tokens").alias("fill"), item.alias("items"))
    todo = pieces.where(F.col("p.tokens") < capacity).select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), F.xxhash64("doc_id", F.lit(1)).alias("ord"), F.col("p.tokens").alias("fill"), item.alias("items"))
    out, level = full, 0
    while True:
        last = parts == 1 and level > 0
        done = durable(todo.groupBy("part").applyInPandas(_level(level, capacity, n_open, last), _OUT), "packed")
        out = out.unionByName(done.where("not leftover").select(F.concat_ws("-", "level", "part", "seq").alias("container_id"), "fill", "items"))
        if last:
            return out
        parts = -(-parts // MERGE)
        level += 1
        todo = done.where("leftover").select(F.floor(F.col("part") / F.lit(MERGE)).cast("long").alias("part"), F.lit(0).cast("long").alias("ord"), "fill", "items")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = containers(token_counts(table(spark, sf_dir, "documents")))
    return boxes.select("container_id", F.transform("items", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("items", lambda x: x["piece_no"]).alias("piece_nos"), F.col("fill").alias("tokens"), F.round(F.col("fill") / F.lit(CAPACITY), 6).alias("fill"))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their mean fill, and the least number of containers that could hold the tokens."""
    boxes = containers(token_counts(table(spark, sf_dir, "documents")))
    total = F.sum("fill")
    return boxes.agg(F.count("*").alias("containers"), total.alias("tokens"), F.round(F.avg("fill") / F.lit(CAPACITY), 4).alias("mean_fill"), F.ceil(total / F.lit(CAPACITY)).alias("least"))


QUERIES = {"p8_containers": p8_containers, "p8_summary": p8_summary}
ORACLES: dict[str, str] = {}
