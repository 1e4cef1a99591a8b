"""Rank fusion, penalties, gates and votes over candidates of a query (``key``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by(key: str, *order: Column | str) -> Column:
    """Position from 1 within a key; the order must be total."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def fuse(rows: DataFrame, key: str, index: str, channels: dict[str, tuple[str, float]], penalties: dict[str, float] | None = None) -> DataFrame:
    """Adds fused and final_rank: weighted channel ranks plus penalties, lower is better.

    ``channels`` maps a name to (score column, weight), better scores first; a
    null score takes the neutral rank of the incoming order.
    """
    out, fused = rows, F.lit(0.0)
    for name, (score, weight) in channels.items():
        rank = F.when(F.col(score).isNull(), F.col(index) + 1).otherwise(rank_by(key, F.col(score).desc_nulls_last(), index))
        out = out.withColumn(f"{name}_rank", rank)
        fused = fused + weight * F.col(f"{name}_rank")
    for column, weight in (penalties or {}).items():
        fused = fused + weight * F.col(column)
    out = out.withColumn("fused", fused)
    return out.withColumn("final_rank", rank_by(key, F.round("fused", 9), index))


def fuse_capped(rows: DataFrame, key: str, index: str, base: str, other_rank: str, weight: float, cap: int) -> DataFrame:
    """Adds final_rank: only the ``cap`` best by ``base`` may trade places by base + weight * rank."""
    out = rows.withColumn("base_rank", rank_by(key, base, index))
    inside = F.col("base_rank") <= cap
    order = F.when(inside, F.round(F.col(base) + weight * F.col(other_rank), 9))
    return out.withColumn("final_rank", rank_by(key, F.when(inside, 0).otherwise(1), order, F.when(~inside, F.col("base_rank")), index))


def distance_penalty(metres: Column) -> Column:
    return 15.0 * F.greatest(F.lit(0.0), (metres - 150) / 1000)


def plate_penalty(metres: Column, margin: Column) -> Column:
    return 10.0 * F.least(F.lit(2.0), margin) * F.greatest(F.lit(0.0), (metres - 1500) / 1000)


def sun_penalty(gap_deg: Column, confidence: Column) -> Column:
    return F.when(confidence >= 0.6, 5.0 * F.greatest(F.lit(0.0), (gap_deg - 30) / 150)).otherwise(0.0)


def top_two_margin(rows: DataFrame, key: str, score: str, index: str) -> DataFrame:
    """key, index of the best, best score, margin to the second (null if alone)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), index)
    ranked = rows.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where("_k = 1").select(key, index, F.col(score).alias("best"), (F.col(score) - F.col("_next")).alias("margin"))


def smoothstep(x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return t * t * (3 - 2 * t)


def adaptive_weight(margin: Column, low: float = 0.05, width: float = 0.15, most: float = 0.4) -> Column:
    """A channel's weight, rising smoothly with its margin; 0 without a runner-up."""
    return F.when(margin.isNull(), 0.0).otherwise(most * smoothstep((margin - low) / width))


def pick_placement(rows: DataFrame, key: str, rank: str, error: str) -> DataFrame:
    """key, rank, error: rank 0 unless the best challenger is 10 % and 10 m better."""
    best = F.min_by(F.struct(F.col(rank).alias("rank"), F.col(error).alias("error")), F.struct(F.col(error), F.col(rank)))
    first = F.min_by(F.col(error), F.col(rank))
    found = rows.groupBy(key).agg(best.alias("b"), first.alias("e0"), F.min(rank).alias("r0"))
    wins = (F.col("b.error") <= 0.9 * F.col("e0")) & (F.col("b.error") <= F.col("e0") - 10)
    return found.select(key, F.when(wins, F.col("b.rank")).otherwise(F.col("r0")).alias(rank), F.when(wins, F.col("b.error")).otherwise(F.col("e0")).alias(error))


def vote(rows: DataFrame, key: str, choice: str, voter: str, first_seen: str, least: int = 2, factor: float = 1.5) -> DataFrame:
    """key, choice, votes, second, margin, decided: distinct voters for each choice.

    The most voted wins if it has ``least`` votes and more than ``factor`` times
    the runner-up's; ties go to the choice seen first.
    """
    counts = rows.groupBy(key, choice).agg(F.count_distinct(voter).alias("votes"), F.min(first_seen).alias("_seen"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "_seen", choice)
    ranked = counts.withColumn("_k", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("votes").over(w), F.lit(0)))
    decided = (F.col("votes") >= least) & (F.col("votes") > factor * F.col("second"))
    return ranked.where("_k = 1").select(key, choice, "votes", "second", (F.col("votes") / F.greatest(F.col("second"), F.lit(1))).alias("margin"), decided.alias("decided"))


def best_per(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_k", rank_by(key, *order)).where("_k = 1").drop("_k")


def window_support(matches: DataFrame, windows: int | Column, key: list[str]) -> DataFrame:
    """Support of candidates by sliding windows, from one row (key, window, rank, score) a hit.

    key, n_windows, ratio, mean_rank, mean_score, support = ratio + 0.25 * max(0, mean_score).
    """
    best = matches.groupBy(*key, "window").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    n = windows if isinstance(windows, Column) else F.lit(windows)
    out = best.groupBy(*key).agg(F.count("*").alias("n_windows"), F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score"))
    return out.withColumn("ratio", F.col("n_windows") / n).withColumn("support", F.col("ratio") + 0.25 * F.greatest(F.lit(0.0), F.col("mean_score")))
