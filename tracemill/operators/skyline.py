"""Skylines, flat-ground projection and raster overlap over pixel rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skyline_from_mask(pixels: DataFrame, keys: list[str], cy: float, focal: float) -> DataFrame:
    """keys, col, sky_row, elevation: the highest building pixel of each image column, in degrees above the horizon."""
    top = pixels.groupBy(*keys, "col").agg(F.min("row").alias("sky_row"))
    return top.withColumn("elevation", F.degrees(F.atan2(F.lit(cy) - F.col("sky_row"), F.lit(focal))))


def compare_skylines(columns: DataFrame, keys: list[str], tolerance: float, contradiction: float, least: float) -> DataFrame:
    """How well a model's skyline explains a frame's, column by column (model, frame in degrees).

    shared: the model rises above ``least``; explained: within the tolerance;
    contradicting: the frame stands out beyond; score: decay of the median gap.
    """
    d = F.col("frame") - F.col("model")
    shared, explained = F.col("model") > least, F.abs(d) <= tolerance
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return columns.groupBy(*keys).agg(
        share(shared).alias("shared_frac"),
        share(shared & explained).alias("explain_frac"),
        share(d > contradiction).alias("contradiction_frac"),
        F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias("spread"),
        F.exp(-F.median(F.abs(d)) / 3).alias("score"),
    )


def image_to_ground(u: Column, v: Column, focal: float, cx: float, cy: float, height: float, pitch_deg: float) -> tuple[Column, Column]:
    """Metres right and forward of the ground point under a pixel; null on or above the horizon."""
    c, s = math.cos(math.radians(pitch_deg)), math.sin(math.radians(pitch_deg))
    x, y = (u - cx) / focal, (v - cy) / focal
    down, ahead = y * c + s, c - y * s
    scale = F.when(down > 1e-9, height / down)
    return x * scale, ahead * scale


def flat_ground_depth(v: Column, focal: float, cy: float, height: float, most: float = 200.0) -> Column:
    """Depth of the ground seen at an image row; null above the horizon or beyond ``most`` metres."""
    depth = height * focal / (v - cy)
    return F.when((v > cy) & (depth <= most), depth)


def cells_of(line: DataFrame, keys: list[str], cell: float, width: float) -> DataFrame:
    """keys, i, j: grid cells whose centre is within half a width of a polyline's segments (x1, y1, x2, y2)."""
    from tracemill.operators.align import segment_distance

    reach = width / 2
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell))
    cells = line.withColumn("i", F.explode(span("x1", "x2"))).withColumn("j", F.explode(span("y1", "y2")))
    cells = cells.withColumn("px", (F.col("i") + 0.5) * cell).withColumn("py", (F.col("j") + 0.5) * cell)
    return cells.where(segment_distance() <= reach).select(*keys, "i", "j").distinct()


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, iou, coverage, score = 0.8 * coverage + 0.2 * iou of two cell sets."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [key, "i", "j"], "full")
    n = both.groupBy(key).agg(F.count("*").alias("u"), F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("m"), F.count("_a").alias("na"), F.count("_b").alias("nb"))
    iou, cover = F.col("m") / F.col("u"), F.coalesce(F.try_divide(F.col("m"), F.least("na", "nb")), F.lit(0.0))
    return n.select(key, iou.alias("iou"), cover.alias("coverage"), (0.8 * cover + 0.2 * iou).alias("score"))


#: Degrees of error and of pitch over which a score falls by e, degrees of pitch that cost nothing,
#: the share of explained skyline that counts as all of it, and what contradictions and flat skylines weigh.
SCORING = {"error": 3.0, "decay": 6.0, "slack": 10.0, "explain": 0.6, "contradiction": 0.7, "flat": 0.5}


def skyline_scores(columns: DataFrame, key: str, candidate: str, sample: str, scoring: dict = SCORING) -> DataFrame:
    """key, candidate, offset, error, score: agreement of each candidate's skylines with the seen ones.

    One row a column: ``delta`` in degrees, null where no model is seen, and the
    sample's ``explain``, ``contradiction`` and ``informative``.  A candidate has one
    pitch, the median of its samples' medians; what all candidates of a key share of
    it is the camera's and costs nothing.  Every sample of the key counts for every
    candidate, with nothing where its model shows nothing.
    """
    own = [key, candidate]
    first = lambda c: F.first(c, True).alias(c)
    usable = columns.groupBy(key).agg(F.count_distinct(sample).alias("n"))
    shifts = columns.groupBy(*own, sample).agg(F.median("delta").alias("d")).groupBy(*own).agg(F.median("d").alias("offset"))
    common = shifts.groupBy(key).agg(F.median("offset").alias("common"))
    errors = columns.join(shifts, own).groupBy(*own, sample).agg(F.median(F.abs(F.col("delta") - F.col("offset"))).alias("e"), first("explain"), first("contradiction"), first("informative"))
    part = F.exp(-F.col("e") / scoring["error"]) * F.least(F.lit(1.0), F.col("explain") / scoring["explain"]) * (1 - scoring["contradiction"] * F.col("contradiction"))
    part = F.coalesce(F.greatest(F.lit(0.0), part * F.when(F.col("informative"), 1.0).otherwise(scoring["flat"])), F.lit(0.0))
    sums = errors.groupBy(*own).agg(F.sum(part).alias("sum"), F.median("e").alias("error"))
    rows = sums.join(shifts, own).join(common, key).join(usable, key)
    beyond = F.greatest(F.lit(0.0), F.abs(F.col("offset") - F.col("common")) - scoring["slack"])
    return rows.select(*own, "offset", "error", (F.col("sum") / F.col("n") * F.coalesce(F.exp(-beyond / scoring["decay"]), F.lit(1.0))).alias("score"))
