"""Problem 9: mixing sources to target weights.

Tokens are summed per source; a source's rate is its target part of the total divided by what it has, at most its
max_repeats, and what capped sources cannot give goes to the others in proportion. A document is emitted floor(rate)
times plus once more with probability equal to the fraction, decided by a seeded hash of its id.

Defined results: documents without text, and of sources without target, are not chosen (their tokens count in the
total); a target with null or zero share or repeats gets nothing; rows of one doc_id count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import durable, norm_key, table
from .tokens import token_counts

TOTAL_PART = 0.8
SEED = 20_240


def rates(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Repetition rate per source: shares of total, capped at the repeats, the shortfall spread over uncapped sources."""
    share = {s: t for s, (t, m) in targets.items() if t and m and have.get(s)}
    capped: dict[str, float] = {}
    while share:
        rest = total - sum(capped[s] * have[s] for s in capped)
        whole = sum(share.values())
        want = {s: t / whole * rest / have[s] for s, t in share.items()}
        over = [s for s, r in want.items() if r > targets[s][1]]
        if not over:
            return capped | want
        for s in over:
            capped[s] = float(targets[s][1])
            share.pop(s)
    return capped


def mix(sizes: DataFrame, targets: DataFrame, total_part: float = TOTAL_PART, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy_no, tokens): the chosen copies. sizes: (doc_id, source, tokens), written; targets: one row per source."""
    goal = {r["s"]: (r["target_share"], r["max_repeats"]) for r in targets.select(norm_key("source").alias("s"), "target_share", "max_repeats").where("s is not null").dropDuplicates(["s"]).collect()}
    spark = sizes.sparkSession
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    keyed = sizes.select("doc_id", norm_key("source").alias("source"), "tokens")
    total = keyed.agg(F.sum("tokens")).first()[0] or 0
    have = {r[0]: r[1] for r in keyed.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens")).collect()}
    rate = spark.createDataFrame(sorted(rates(have, goal, total * total_part).items()), "source string, rate double")
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    n = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return keyed.join(F.broadcast(rate), "source").withColumn("n", n.cast("int")).where("n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "tokens")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(token_counts(table(spark, sf_dir, "documents"), keep=("source",)), "sizes")


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: target and actual share of the chosen tokens, documents and copies."""
    targets = table(spark, sf_dir, "mix_targets")
    chosen = mix(_sizes(spark, sf_dir), targets).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("copies"))
    total = chosen.agg(F.sum("tokens").alias("total"))
    goal = targets.select(norm_key("source").alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    return goal.join(chosen, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"))


QUERIES = {"p9_mixed": p9_mixed, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
