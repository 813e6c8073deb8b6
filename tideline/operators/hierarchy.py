"""Problem 4: parent-child links to full hierarchies.

A deterministic hash makes about one node in STRIDE a splitter; roots are splitters as well. Every node walks to its
next splitter above, its stride doubling each round, so the walks take as many rounds as the logarithm of the longest
gap. The splitters form a reduced pointer graph, solved in the same way, and each node's exact path is its walk
followed by its splitter's path. A walk that meets no splitter ends on a loop without one. Those walks are told apart by
a round that resolves nothing: were an open pointer at a finite distance from its end, the node on its way that is
just out of reach would have been resolved in that round. Finished rows are written once and never again; many nodes
that point at one are the large side of an equi-join, which adaptive execution splits.

Defined results: null task ids are dropped; versions of a task count as one; a parent that is null, blank, missing or
of another run makes the task a root; a task on a loop or below one has root `cycle` and null path and depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, durable, norm_key, sized_join, table
from .orphans import KEY_SQL

STRIDE = 8
CYCLE = "cycle"


def links(tasks: DataFrame, key: str = "task_id", parent: str = "parent_id", group: str = "run_id") -> DataFrame:
    """(id, name, up): one row per node; up is the id of its parent of the same group, null for a root."""
    nodes = (
        tasks.select(norm_key(key).alias("id"), F.col(key).alias("name"), norm_key(parent).alias("p"), norm_key(group).alias("g"))
        .where("id is not null").groupBy("id").agg(F.min(F.struct("name", "p", "g")).alias("s")).select("id", "s.name", "s.p", "s.g")
    )
    above = nodes.select(F.col("id").alias("p"), F.col("g").alias("pg"), F.lit(True).alias("there"))
    return nodes.join(above, "p", "left").select("id", "name", F.when(F.col("there") & F.col("g").eqNullSafe(F.col("pg")), F.col("p")).alias("up"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _step(open_: DataFrame, n: int, jumps: DataFrame) -> DataFrame:
    """Open pointers advanced by one jump; they point at nothing that jumps has not. The pointers are broadcast if counted few."""
    j = jumps.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), F.col("seg").alias("seg2"))
    moved = j.join(F.broadcast(open_) if n <= MAX_BROADCAST_ROWS else open_, "ptr")
    return moved.select("id", "name", "top", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), F.concat("seg", "seg2").alias("seg"))


def _double(state: DataFrame, tag: str) -> DataFrame:
    """Pointer doubling until every pointer is done or provably on a loop: state with ptr null on a loop.

    Done rows never move and are written once; each round writes the rows that were still open. seg lists the nodes from
    id (included) up to ptr (excluded).
    """
    state, before = durable(state, tag), -1
    done, open_ = [state.where("done")], state.where("not done")
    while left := open_.count():
        if left == before:
            done.append(open_.select("id", "name", "top", F.lit(None).cast("string").alias("ptr"), F.lit(True).alias("done"), F.lit(None).cast("array<string>").alias("seg")))
            break
        before = left
        moved = durable(_step(open_, left, _union([*done, open_])), tag)
        done.append(moved.where("done"))
        open_ = moved.where("not done")
    return _union(done)


def _splits(c: Column, stride: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(stride)) == 0


def solve(up: DataFrame, stride: int = STRIDE, paths: bool = False) -> DataFrame:
    """(id, name, root, path): root is null on a loop or below one; path runs from the root down to the node's name.

    With paths=False the path column is null and only pointers travel.
    """
    none = F.array().cast("array<string>")
    # walk to the next splitter: a pointer at a splitter or root is done
    walk = up.select(
        "id", "name", F.col("up").isNull().alias("top"), F.coalesce("up", "id").alias("ptr"),
        (F.col("up").isNull() | F.coalesce(_splits(F.col("up"), stride), F.lit(False))).alias("done"),
        (F.when(F.col("up").isNotNull(), F.array("name")).otherwise(none) if paths else none).alias("seg"),
    )
    walked = _double(walk, "walk")
    # the reduced graph: splitters and roots only
    reduced = walked.where(F.col("top") | _splits(F.col("id"), stride)).withColumn("done", F.col("top") | F.col("ptr").isNull())
    solved = _double(reduced, "reduced").select(F.col("id").alias("ptr"), F.col("ptr").alias("root"), F.col("seg").alias("seg2"))
    names = walked.where("top").select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    heads = durable(solved.join(names, "root", "left").select("ptr", "root_name", "seg2"), "heads")
    whole = sized_join(walked, heads, ["ptr"], "left")
    path = F.reverse(F.concat("seg", "seg2", F.array("root_name"))) if paths else F.lit(None).cast("array<string>")
    return whole.select("id", "name", F.col("root_name").alias("root"), F.when(F.col("root_name").isNotNull(), path).alias("path"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve(links(table(spark, sf_dir, "tasks"))).select(F.col("name").alias("task_id"), F.coalesce("root", F.lit(CYCLE)).alias("root_id"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of every task, and how many tasks stand below it."""
    nodes = durable(solve(links(table(spark, sf_dir, "tasks")), paths=True), "paths")
    below = nodes.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return nodes.join(below, "name", "left").select(
        F.col("name").alias("task_id"), F.coalesce("root", F.lit(CYCLE)).alias("root_id"), F.array_join("path", "/").alias("path"),
        (F.size("path") - 1).cast("int").alias("depth"), F.coalesce("n", F.lit(0)).alias("n_below"),
    )


def p4_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a task and a task below it, with the distance."""
    nodes = solve(links(table(spark, sf_dir, "tasks")), paths=True).where("path is not null")
    pairs = nodes.select(F.col("name").alias("below_id"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "task_id"))
    return pairs.select("task_id", "below_id", (F.col("n") - 1 - F.col("pos")).cast("int").alias("distance")).where("distance > 0")


def p4_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks on a loop or below one, per run."""
    t = table(spark, sf_dir, "tasks")
    bad = solve(links(t)).where("root is null").select("id")
    runs = t.select(norm_key("task_id").alias("id"), norm_key("run_id").alias("run_id")).distinct()
    return bad.join(runs, "id").groupBy("run_id").agg(F.countDistinct("id").alias("tasks"))


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_below": p4_below, "p4_cycles": p4_cycles}

_WALK = f"""
with recursive t as (
  select lower(trim(task_id)) as id, min(task_id) as name, min({KEY_SQL.format(c='parent_id')}) as p,
         min({KEY_SQL.format(c='run_id')}) as g from tasks where task_id is not null group by 1),
l as (select a.id, a.name, a.g, b.id as up from t a left join t b on a.p = b.id and a.g is not distinct from b.g),
w(id, name, root, path, depth) as (
  select id, name, name, name, 0 from l where up is null
  union all select l.id, l.name, w.root, w.path || '/' || l.name, w.depth + 1 from l join w on l.up = w.id)
"""
ORACLES = {
    "p4_found": _WALK + "select l.name as task_id, coalesce(w.root, 'cycle') as root_id from l left join w using (id)",
    "p4_paths": _WALK + ", x as (select id, unnest(list_slice(string_split(path, '/'), 1, -2)) as name from w), n as (select name, count(*) as n from x group by 1) "
    "select l.name as task_id, coalesce(w.root, 'cycle') as root_id, w.path as path, cast(w.depth as integer) as depth, coalesce(n.n, 0) as n_below from l left join w using (id) left join n on n.name = l.name",
    "p4_below": _WALK + ", x as (select name as below_id, depth, unnest(string_split(path, '/')) as task_id, generate_subscripts(string_split(path, '/'), 1) as i from w) "
    "select task_id, below_id, cast(depth + 1 - i as integer) as distance from x where depth + 1 - i > 0",
    "p4_cycles": _WALK + "select g as run_id, count(*) as tasks from l where id not in (select id from w) group by 1",
}
