"""Operator inputs made from the driver's tables, and the same relations for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        CATALOG[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: user_id, seq, t_sec, x, y, event_id, event_type."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "user_id",
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        ((micros - F.min(micros).over(Window.partitionBy("user_id"))) / 1e6).alias("t_sec"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        "event_id",
        "event_type",
    )


TRACKS = """tracks as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq,
         (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t_sec,
         value as x, cast(json_extract_string(props, '$.k') as double) as y, event_id, event_type
  from events
)"""
STEPS = TRACKS + """, steps as (
  select *, coalesce(x - lag(x) over w, 0) as dx, coalesce(y - lag(y) over w, 0) as dy from tracks window w as (partition by user_id order by seq)
), arc as (
  select *, sqrt(dx * dx + dy * dy) as step, sum(sqrt(dx * dx + dy * dy)) over (partition by user_id order by seq rows unbounded preceding) as s from steps
)"""


def wrapped(x: str) -> str:
    """DuckDB text: an angle wrapped into [-pi, pi) by floor modulus."""
    return f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


def resampled(n: int) -> str:
    """DuckDB CTEs after STEPS: points(user_id, seq, x, y)."""
    return f"""targets as (
  select user_id, i, total * i / {n - 1}.0 as t from (select user_id, max(s) as total from arc group by user_id having max(s) > 0), range({n}) r(i)
), vertices as (
  select user_id, seq, s, x, y, lead(s) over w as s2, lead(x) over w as x2, lead(y) over w as y2 from arc window w as (partition by user_id order by seq)
), points as (
  select t.user_id, cast(t.i as int) as seq,
         v.x + case when v.s2 > v.s then (t.t - v.s) / (v.s2 - v.s) else 0 end * (coalesce(v.x2, v.x) - v.x) as x,
         v.y + case when v.s2 > v.s then (t.t - v.s) / (v.s2 - v.s) else 0 end * (coalesce(v.y2, v.y) - v.y) as y
  from targets t join vertices v on v.user_id = t.user_id and v.s <= t.t
  qualify row_number() over (partition by t.user_id, t.i order by v.seq desc) = 1
)"""
