"""Operators on ordered tracks: rows (key, seq, x, y) with an explicit ordinal.

Every operator partitions by the track key and orders by the ordinal, so a
table of any number of tracks is one window pass; none of them collects a track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.geo import heading, wrap_angle


def ordered(key: str, seq: str = "seq") -> Window:
    return Window.partitionBy(key).orderBy(seq)


def running(key: str, seq: str = "seq") -> Window:
    return ordered(key, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_steps(track: DataFrame, key: str) -> DataFrame:
    """Adds dx, dy, step: the move from the row before (0 at a track's start)."""
    w = ordered(key)
    d = track.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in "xy"})
    return d.withColumn("step", F.hypot("dx", "dy"))


def arc_length(track: DataFrame, key: str) -> DataFrame:
    """Adds s, the length run so far."""
    return with_steps(track, key).withColumn("s", F.sum("step").over(running(key)))


def heading_deltas(track: DataFrame, key: str) -> DataFrame:
    """key, seq, delta: the wrapped change of heading at each inner vertex."""
    w = ordered(key)
    steps = with_steps(track, key).withColumn("heading", F.when(F.col("seq") > 0, heading("dx", "dy")))
    delta = wrap_angle(F.lead("heading").over(w) - F.col("heading"))
    return steps.withColumn("delta", delta).where("delta is not null").select(key, "seq", "delta")


def resample_uniform(track: DataFrame, key: str, n: int) -> DataFrame:
    """n points evenly spaced by arc length: key, seq, x, y.

    Targets are merged into the ordered track and take the last vertex at or
    before them in one window pass.  Tracks of one point or no length have none.
    """
    w = ordered(key)
    arc = arc_length(track, key)
    points = arc.select(key, "s", F.lit(0).alias("kind"), F.col("seq").alias("i"), F.struct("s", "x", "y", F.lead("s").over(w).alias("s2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).alias("at"))
    total = arc.groupBy(key).agg(F.max("s").alias("total")).where("total > 0")
    targets = total.select(key, "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    targets = targets.select(key, (F.col("total") * F.col("i") / (n - 1)).alias("s"), F.lit(1).alias("kind"), "i", F.lit(None).alias("at"))
    order = Window.partitionBy(key).orderBy("s", "kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = points.unionByName(targets).withColumn("p", F.last("at", True).over(order)).where("kind = 1")
    share = F.when(F.col("p.s2") > F.col("p.s"), (F.col("s") - F.col("p.s")) / (F.col("p.s2") - F.col("p.s"))).otherwise(0.0)
    at = lambda c: (F.col(f"p.{c}") + share * (F.coalesce(F.col(f"p.{c}2"), F.col(f"p.{c}")) - F.col(f"p.{c}"))).alias(c)
    return held.select(key, F.col("i").cast("int").alias("seq"), at("x"), at("y"))


def bearing_signature(track: DataFrame, key: str, n: int = 128) -> DataFrame:
    """Heading changes of the uniformly resampled track."""
    return heading_deltas(resample_uniform(track, key, n), key)


def windowed_turn(track: DataFrame, key: str, half: int = 8) -> DataFrame:
    """key, seq, turn: heading changes summed over 2 * half + 1 rows, fewer at the ends."""
    around = ordered(key).rowsBetween(-half, half)
    return heading_deltas(track, key).withColumn("turn", F.sum("delta").over(around)).select(key, "seq", "turn")


def hopping_windows(track: DataFrame, key: str, size: int, step: int) -> DataFrame:
    """(key, start, ...) memberships of windows of ``size`` rows every ``step`` rows.

    A last window ends at the last row if the regular ones leave some uncovered;
    a shorter track is a single window.  Each row names its windows itself, so
    there is no range join.
    """
    n = F.max("seq").over(Window.partitionBy(key)) + 1
    rows = track.withColumn("_n", n)
    last = F.greatest(F.lit(0), F.col("_n") - size)
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / step)).cast("int")
    until = F.least(F.floor(F.col("seq") / step), F.floor(last / step)).cast("int")
    regular = F.when(first <= until, F.transform(F.sequence(first, until), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    tail = F.when((F.pmod(last, F.lit(step)) != 0) & (F.col("seq") >= last), F.array(last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("start", F.explode(F.concat(regular, tail))).drop("_n")


def drift_ramp(track: DataFrame, key: str, first: Column | int = 0, last: Column | None = None) -> DataFrame:
    """Spread the gap between two vertices over the arc between them; after it, move by all of it."""
    whole = Window.partitionBy(key)
    rows = arc_length(track, key).withColumn("_i", F.lit(first) if isinstance(first, int) else first).withColumn("_j", F.max("seq").over(whole) if last is None else last)
    for name, at in (("a", "_i"), ("b", "_j")):
        for c in "sxy":
            rows = rows.withColumn(f"_{c}{name}", F.max(F.when(F.col("seq") == F.col(at), F.col(c))).over(whole))
    share = F.least(F.greatest(F.coalesce(F.try_divide(F.col("s") - F.col("_sa"), F.col("_sb") - F.col("_sa")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    moved = {c: F.col(c) - share * (F.col(f"_{c}b") - F.col(f"_{c}a")) for c in "xy"}
    return rows.select(key, "seq", *[v.alias(c) for c, v in moved.items()])


def nearest_in_time(probes: DataFrame, rows: DataFrame, key: str, t: str, ident: str) -> DataFrame:
    """key, probe ident, nearest row's ident and the gap; ties go to the earlier row.

    Both tables are merged in time order; the last row before and the first row
    after each probe are the only candidates.  Probes without any row are left out.
    """
    a = probes.select(key, F.col(t).alias("t"), F.col(ident).alias("i"), F.lit(1).alias("probe"))
    b = rows.select(key, F.col(t).alias("t"), F.col(ident).alias("i"), F.lit(0).alias("probe"))
    merged = a.unionByName(b)
    order = Window.partitionBy(key).orderBy("t", "probe", "i")
    row = F.when(F.col("probe") == 0, F.struct("t", "i"))
    # of rows at one time the lowest ident counts
    first = F.min(F.when(F.col("probe") == 0, F.col("i"))).over(Window.partitionBy(key, "t"))
    held = merged.withColumn("_first", first)
    row = F.when(F.col("probe") == 0, F.struct(F.col("t"), F.col("_first").alias("i")))
    held = held.withColumn("before", F.last(row, True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(row, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    pick = F.when(F.col("after").isNull() | (F.col("before").isNotNull() & ((gap("before") < gap("after")) | ((gap("before") == gap("after")) & (F.col("before.i") < F.col("after.i"))))), F.col("before")).otherwise(F.col("after"))
    found = held.where("probe = 1").withColumn("hit", pick).where("hit is not null")
    return found.select(key, F.col("i").alias("probe_id"), F.col("hit.i").alias("nearest_id"), F.abs(F.col("hit.t") - F.col("t")).alias("gap"))


def linspace_truncated(rows: DataFrame, key: str, n: int, seq: str = "seq") -> DataFrame:
    """The rows at the truncated positions of n evenly spaced numbers 0..last; all rows of short tracks."""
    last = F.max(seq).over(Window.partitionBy(key))
    rows = rows.withColumn("_last", last)
    k = F.ceil(F.col(seq) * (n - 1) / F.col("_last"))
    hit = F.floor(k * F.col("_last") / (n - 1)) == F.col(seq)
    return rows.where((F.col("_last") < n) | hit).drop("_last")


def linspace_rounded(rows: DataFrame, key: str, n: int, seq: str = "seq") -> DataFrame:
    """The rows at the half-even rounded positions of n evenly spaced numbers, each once."""
    rows = rows.withColumn("_last", F.max(seq).over(Window.partitionBy(key)))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * F.col("_last") / (n - 1)).cast("long")))
    return rows.where((F.col("_last") < n) | F.array_contains(spots, F.col(seq).cast("long"))).drop("_last")


def every_nth(rows: DataFrame, key: str, n: int, seq: str = "seq") -> DataFrame:
    """Every nth row, and the last."""
    last = F.max(seq).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).where((F.pmod(F.col(seq), F.lit(n)) == 0) | (F.col(seq) == F.col("_last"))).drop("_last")


def hash_threshold_sample(rows: DataFrame, ident: str, cap: int) -> DataFrame:
    """The ``cap`` rows whose ids have the lowest sha1."""
    return rows.orderBy(F.sha1(F.col(ident).cast("string").cast("binary")), ident).limit(cap)


def time_strata(rows: DataFrame, key: str, t: str, weight: str, ident: str, strata: int, budget: int) -> DataFrame:
    """Round robin over equal time strata, the heaviest of each first, up to ``budget`` rows a key."""
    whole = Window.partitionBy(key)
    span = F.max(t).over(whole) - F.min(t).over(whole)
    bucket = F.least(F.lit(strata - 1), F.floor(F.coalesce(F.try_divide(F.col(t) - F.min(t).over(whole), span), F.lit(0.0)) * strata)).cast("int")
    ranked = rows.withColumn("bucket", bucket).withColumn("turn", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(F.desc(weight), ident)))
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy("turn", "bucket"))).where(F.col("pick") <= budget)


def _merged(vertices: DataFrame, targets: DataFrame, key: str, at: str) -> DataFrame:
    """Targets with ``p``, the last vertex at or before them; both have (key, at), vertices ``seq`` and ``p``, targets ``i``."""
    rows = vertices.select(key, at, F.lit(0).alias("kind"), F.col("seq").cast("long").alias("i"), "p")
    rows = rows.unionByName(targets.select(key, at, F.lit(1).alias("kind"), F.col("i").cast("long").alias("i"), F.lit(None).alias("p")))
    order = Window.partitionBy(key).orderBy(at, "kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("p", F.last("p", True).over(order)).where("kind = 1")


def arc_fraction_at(arc: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """key, i, fraction: the share of the length run at times (key, i, t), between vertices in proportion to time."""
    w = ordered(key)
    nodes = arc.select(key, "seq", F.col("t_sec").alias("t"), F.struct("t_sec", "s", F.lead("t_sec").over(w).alias("t2"), F.lead("s").over(w).alias("s2"), F.max("s").over(Window.partitionBy(key)).alias("total")).alias("p"))
    held = _merged(nodes, times, key, "t")
    share = F.when(F.col("p.t2") > F.col("p.t_sec"), (F.col("t") - F.col("p.t_sec")) / (F.col("p.t2") - F.col("p.t_sec"))).otherwise(0.0)
    run = F.col("p.s") + share * (F.coalesce(F.col("p.s2"), F.col("p.s")) - F.col("p.s"))
    return held.select(key, "i", F.least(F.lit(1.0), F.greatest(F.lit(0.0), run / F.col("p.total"))).alias("fraction"))


def pose_at(arc: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """key, i, x, y, dx, dy: place and unit direction at lengths (key, i, at) inside a track."""
    w = ordered(key)
    nodes = arc.select(key, "seq", F.col("s").alias("at"), F.struct("s", "x", "y", F.lead("s").over(w).alias("s2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).alias("p"))
    held = _merged(nodes.where("p.s2 > p.s"), places, key, "at").withColumn("d", F.col("p.s2") - F.col("p.s"))
    share = (F.col("at") - F.col("p.s")) / F.col("d")
    go = lambda c: F.col(f"p.{c}2") - F.col(f"p.{c}")
    return held.select(key, "i", *[(F.col(f"p.{c}") + share * go(c)).alias(c) for c in "xy"], *[(go(c) / F.col("d")).alias(f"d{c}") for c in "xy"])


def turn_weighted_correlation(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """key, corr: correlation of the headings of two tracks of a key, weighted by how much the first one turns.

    Both are resampled to n points; headings run on over full circles.
    """

    def headings(track: DataFrame, name: str) -> DataFrame:
        w = ordered(key)
        steps = with_steps(resample_uniform(track, key, n), key).where("seq > 0").withColumn("h", F.atan2("dy", "dx"))
        turn = F.coalesce(wrap_angle(F.col("h") - F.lag("h").over(w)), F.lit(0.0))
        turned = steps.withColumn("turn", turn)
        return turned.select(key, "seq", F.abs("turn").alias(f"{name}_turn"), F.sum("turn").over(running(key)).alias(name))

    both = headings(a, "a").join(headings(b, "b"), [key, "seq"]).withColumn("w", F.col("a_turn") + 1e-3)
    weighted = lambda x: F.sum(F.col("w") * x)
    x, y = F.col("a"), F.col("b")
    sums = both.groupBy(key).agg(F.sum("w").alias("w"), *[weighted(v).alias(k) for k, v in (("x", x), ("y", y), ("xy", x * y), ("xx", x * x), ("yy", y * y))])
    spread = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("w")
    corr = spread("xy", "x", "y") / (F.sqrt(F.greatest(F.lit(0.0), spread("xx", "x", "x")) * F.greatest(F.lit(0.0), spread("yy", "y", "y"))) + 1e-12)
    return sums.select(key, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), corr)).alias("corr"))
