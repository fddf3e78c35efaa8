"""Retrieval benchmark: holdout, precision and recall at k, cohorts.

Pair counts are additive, so what a sample may see (all commits but those of its own day) is
the global count less its day's: one join by sample instead of one matrix for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def select_samples(commits: DataFrame, touches: DataFrame, most: int = 50, least_files: int = 1, most_files: int = 20) -> DataFrame:
    """sample, committed_at, files: the latest commits with a fitting number of files."""
    n = touches.select("commit_id", "path").distinct().groupBy("commit_id").agg(F.count("*").alias("files"))
    ok = commits.join(n, "commit_id").where(F.col("files").between(least_files, most_files))
    return ok.orderBy(F.desc("committed_at"), "commit_id").limit(most).select(F.col("commit_id").alias("sample"), "committed_at", "files")


def held_out_neighbours(commits: DataFrame, touches: DataFrame, seeds: DataFrame, min_joint: int = 1, min_coupling: float = 0.0, top_k: int = 20) -> DataFrame:
    """sample, path, coupling, rank: neighbours of a sample's seed without the commits of its day. seeds: sample, day, seed."""
    t = touches.select("commit_id", "path").distinct().join(commits.select("commit_id", F.to_date("committed_at").alias("day")), "commit_id")
    mine = seeds.select("seed").distinct()
    near = t.join(mine.withColumnRenamed("seed", "path"), "path", "left_semi").select("commit_id", F.col("path").alias("seed"))
    both = near.join(t, "commit_id").where(F.col("seed") != F.col("path")).groupBy("seed", "path", "day").agg(F.count("*").alias("d"))
    joint = both.groupBy("seed", "path").agg(F.sum("d").alias("joint"))
    counts = t.groupBy("path", "day").agg(F.count("*").alias("d"))
    total = counts.groupBy("path").agg(F.sum("d").alias("n"))
    s = seeds.join(joint, "seed")
    s = s.join(both.select("seed", "path", "day", "d"), ["seed", "path", "day"], "left").withColumn("joint", F.col("joint") - F.coalesce("d", F.lit(0))).drop("d")
    for c in ("seed", "path"):
        s = s.join(total.select(F.col("path").alias(c), F.col("n").alias(f"n_{c}")), c)
        s = s.join(counts.select(F.col("path").alias(c), "day", "d"), [c, "day"], "left").withColumn(f"n_{c}", F.col(f"n_{c}") - F.coalesce("d", F.lit(0))).drop("d")
    s = s.where((F.col("joint") >= min_joint) & (F.col("joint") > 0)).withColumn("coupling", F.col("joint") / F.least("n_seed", "n_path")).where(F.col("coupling") >= min_coupling)
    w = Window.partitionBy("sample").orderBy(F.desc("coupling"), F.desc("joint"), "path")
    return s.select("sample", "path", "coupling", "joint").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def evaluate(samples: DataFrame, predicted: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """sample, p<k>, r<k> ...: precision divides by what was returned, not by k. predicted: sample, path, rank; truth: sample, path."""
    size = truth.distinct().groupBy("sample").agg(F.count("*").alias("truth"))
    hit = predicted.join(truth.distinct().withColumn("hit", F.lit(1)), ["sample", "path"], "left")
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & (F.col("hit") == 1)).alias(f"h{k}")]
    a = samples.select("sample").join(size, "sample", "left").join(hit.groupBy("sample").agg(*aggs), "sample", "left").na.fill(0)
    out = [F.col("sample")]
    for k in ks:
        out += [F.when(F.col(f"n{k}") > 0, F.col(f"h{k}") / F.col(f"n{k}")).otherwise(0.0).alias(f"p{k}"), F.when(F.col("truth") > 0, F.col(f"h{k}") / F.col("truth")).otherwise(0.0).alias(f"r{k}")]
    return a.select(*out)


def aggregate(scored: DataFrame, k: int = 10) -> DataFrame:
    """cohort (null: all), samples, mean and median precision, mean recall, zero-hit rate; percentiles are nearest-rank. scored: sample, cohort, p<k>, r<k>."""
    p, r = f"p{k}", f"r{k}"
    g = scored.groupingSets([[], [F.col("cohort")]], "cohort")
    return g.agg(
        F.count("*").alias("samples"),
        F.avg(p).alias("mean_precision"),
        F.avg(r).alias("mean_recall"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {p})").alias("p50"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {p})").alias("p90"),
        (F.count_if(F.col(p) == 0) / F.count("*")).alias("zero_hit_rate"),
    )


__all__ = ["aggregate", "evaluate", "held_out_neighbours", "select_samples"]
