"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into substrings, as many as the number of rows makes best,
each an index of its own.  Round r probes indexes with the keys at Hamming distance r from the
query's substring.  After it, a code not met differs from the query by at least
r + 1 bits in every substring searched and by r in the others, so it is at least
m * r + a bits away, where a of the m substrings were searched.  A query is
finished once its kth verified distance is smaller than that.  A round searches
only as many substrings as the kth distance so far still needs, and passes on
only codes that are at most that far away.  Rows with equal codes share one index
entry that keeps their k lowest ids: no other of them can be in an answer.
"""

from __future__ import annotations

from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch

CODE = 64
#: Bits of the widest substring; a radius then has at most 2 ** WIDEST keys.
WIDEST = 22
#: What a probe, which is shuffled and sorted, costs in comparisons with a row it meets.
PROBE_COST = 4


def sign_code(vector: str | Column) -> Column:
    """A 64-bit code: bit i is set where element i is positive; null for a null vector."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bit = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def cuts(rows: int, k: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each substring of a code for an index of so many rows.

    More substrings need smaller radii, hence fewer probes, but their keys have
    more rows each.  The number is the one of least work for evenly spread codes;
    it changes no result.
    """
    reached, total = 0, 0
    while reached < CODE and total * rows < k << CODE:  # the distance within which k rows are expected
        total += comb(CODE, reached)
        reached += 1

    def work(m: int) -> float:
        bits, cost = CODE / m, 0.0
        for radius in range(reached // m + 1):
            searched = min(m, reached - m * radius)
            cost += searched * comb(round(bits), radius) * (PROBE_COST + rows / 2**bits)
        return cost

    m = min(range(-(-CODE // WIDEST), CODE // 8 + 1), key=work)
    size, longer = divmod(CODE, m)
    sizes = [size + (i < longer) for i in range(m)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _part(code: Column, cut: tuple[int, int]) -> Column:
    low, bits = cut
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _probes(active: DataFrame, where: list[tuple[int, int]], radius: int) -> DataFrame:
    """(query, bound, segment, key) of the keys at distance ``radius`` in the first ``wanted`` substrings."""

    def masks(bits: int):
        """Masks of ``radius`` set bits, in bounded arrays."""
        each = combinations(range(bits), radius)
        while part := list(islice(each, 1 << 14)):
            yield np.array([sum(1 << b for b in bits) for bits in part], np.int32)

    def run(batches):
        for batch in batches:
            codes, bounds, wanted = (np.asarray(c) for c in batch.columns)
            for s, (low, bits) in enumerate(where):
                own = wanted > s
                if not own.any():
                    continue
                keys = (codes[own].view(np.uint64) >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int32)
                for mask in masks(bits):
                    for i in range(0, len(keys), 64):
                        found = (keys[i : i + 64, None] ^ mask).ravel()
                        repeated = [np.repeat(c[own][i : i + 64], len(mask)) for c in (codes, bounds)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*repeated, np.full(len(found), s, np.int32), found)], names=["query", "bound", "segment", "key"])

    return active.select("query", "bound", "wanted").mapInArrow(run, "query long, bound int, segment int, key int")


def top_k(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "id", query_id: str = "id", code: str = "code") -> DataFrame:
    """The k nearest rows of each query: query_id, rank, id, distance.

    Distance ties go to the lower id.  Rows and queries with a null id or code
    are left out; repeated (id, code) rows count once, and so do repeated queries.
    With fewer than k rows a query gets all of them; no rows or no queries give no
    result.  Columns beside the id and the code are ignored, whatever their names.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hamming")
    lowest = Window.partitionBy("code").orderBy("id")
    own = rows.select(rows[row_id].cast("long").alias("id"), rows[code].cast("long").alias("code")).where("id is not null and code is not null").dropDuplicates()
    kept = own.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k)
    entries = scratch.table(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    asked = scratch.table(queries.select(queries[query_id].cast("long").alias("query_id"), queries[code].cast("long").alias("query")).where("query_id is not null and query is not null").dropDuplicates(), "asked")
    distinct, size = entries.agg(F.count("*"), F.sum(F.size("ids"))).first()
    want, where = min(k, size or 0), cuts(distinct, k)
    m = len(where)
    places = F.array(*[F.struct(F.lit(s).alias("segment"), _part(F.col("code"), cut).alias("key")) for s, cut in enumerate(where)])
    index = scratch.table(entries.select("code", "ids", F.explode(places).alias("at")).select("at.segment", "at.key", "code", "ids"), "index")
    active = asked.select("query").distinct().select("query", F.lit(CODE).alias("bound"), F.lit(m).alias("wanted"), F.array().cast("array<struct<distance:int,id:bigint>>").alias("best"))
    finished = []
    for radius in range(max(n for _, n in where) + 1) if want else ():
        # the planner takes the probes for as small as the queries; they must be shuffled
        found = _probes(active, where, radius).hint("merge").join(index, ["segment", "key"])
        far = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        found = found.where(far <= F.col("bound"))
        # a code is taken where the search meets it first
        for s, cut in enumerate(where):
            d = F.bit_count(_part(F.col("query"), cut).bitwiseXOR(_part(F.col("code"), cut)))
            found = found.where((d > radius) | ((d == radius) & (F.col("segment") <= s)))
        fresh = found.select("query", far.alias("distance"), F.explode("ids").alias("id"))
        merged = fresh.unionByName(active.select("query", F.inline("best")))
        order = Window.partitionBy("query").orderBy("distance", "id")
        top = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        state = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("best"))
        joined = active.select("query", F.col("wanted").alias("searched")).join(state, "query", "left")
        # where fewer rows than wanted are known nothing is bounded yet
        kth = F.when(F.size("best") >= want, F.element_at("best", -1)["distance"]).otherwise(CODE)
        covered = F.lit(m * radius) + F.col("searched")
        joined = joined.withColumn("bound", kth).withColumn("done", F.col("bound") < covered)
        joined = joined.withColumn("wanted", F.least(F.lit(m), F.col("bound") + 1 - m * (radius + 1)))
        state = scratch.table(joined.drop("searched"), f"round{radius}")
        finished.append(state.where("done").select("query", "best"))
        active = state.where("not done").select("query", "bound", "wanted", F.coalesce("best", F.array().cast("array<struct<distance:int,id:bigint>>")).alias("best"))
        if active.isEmpty():
            break
    else:
        finished.append(active.select("query", "best"))  # all radii searched
    answers = finished[0]
    for part in finished[1:]:
        answers = answers.unionByName(part)
    out = asked.join(answers, "query").select("query_id", F.posexplode("best").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"))
