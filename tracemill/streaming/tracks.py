"""Structured Streaming forms of the stateful track operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators.components import shared_folder
from tracemill.operators.grouped import reachable

LATE = "10 minutes"


def hopping(events: DataFrame, key: str, size: str, slide: str, late: str = LATE) -> DataFrame:
    """key, start, n_rows, mean_value over event-time windows; rows later than ``late`` are left out."""
    w = F.window("ts", size, slide)
    out = events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n_rows"), F.avg("value").alias("mean_value"))
    return out.select(key, F.col("w.start").alias("start"), "n_rows", "mean_value")


def drives(events: DataFrame, key: str, gap: str, late: str = LATE) -> DataFrame:
    """key, start, end, n_rows: stretches without a pause of ``gap``."""
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_rows"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows")


def first_seen(rows: DataFrame, ident: str, late: str = LATE) -> DataFrame:
    """Each id once within the watermark: the append side of a union store."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def moving(motions: DataFrame, key: str, size: str, least: float = 0.75, late: str = LATE) -> DataFrame:
    """key, start, motion, valid: steps whose median motion reaches ``least``; the others are standstill."""
    out = motions.withWatermark("ts", late).groupBy(key, F.window("ts", size).alias("w")).agg(F.median("value").alias("motion"))
    return out.select(key, F.col("w.start").alias("start"), "motion", (F.col("motion") >= least).alias("valid"))


def plausible(fixes: DataFrame, key: str, speed: float, idle: str = "1 hour", late: str = LATE) -> DataFrame:
    """Fixes that the last accepted one can reach: key, ts, lat, lon, accepted.

    State is the last accepted fix of each key; it is dropped once event time is ``idle`` past it.
    """
    schema = f"{key} long, ts timestamp, lat double, lon double, accepted boolean"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        flags = []
        for ts, lat, lon in zip(rows["ts"], rows["lat"], rows["lon"]):
            t = ts.timestamp()
            ok = last is None or reachable((last[0], last[1:]), (t, (lat, lon)), speed)
            if ok:
                last = (t, float(lat), float(lon))
            flags.append(ok)
        state.update(last)
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield rows.assign(**{key: group[0], "accepted": flags})[[key, "ts", "lat", "lon", "accepted"]]

    return fixes.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, schema, "t double, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet below the shared folder and return it; for tests and replays.

    A batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")  # a stream without rows
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
