"""Dense retrieval and continuity-constrained decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block of the blocked product.
BLOCK = 2048


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: str) -> Column:
    """The unit vector; null where the vector has no length."""
    length = norm(a)
    return F.when(length > 0, F.transform(F.col(a), lambda x: x.cast("double") / length))


def cosine_top_k(queries: DataFrame, refs: DataFrame, k: int, ident: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, ref_id, sim: the k most similar references, ties to the lower id.

    Both sides are cut into blocks of BLOCK vectors that meet once each; a block
    pair is one matrix product and passes on k rows a query, so what is shuffled
    is queries times reference blocks times k.  Null vectors are left out.
    """
    own = lambda df, to: df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(ident), F.lit(1 << 30)).alias("h"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // BLOCK))
        dealt = df.withColumn(name, F.pmod("h", F.lit(n)))
        return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias(f"{name}_rows"))

    met = blocks(own(queries, "q"), "q").crossJoin(blocks(own(refs, "r"), "r"))  # of blocks, not of rows

    def product(frames):
        for frame in frames:
            for qs, rs in zip(frame["q_rows"], frame["r_rows"]):
                qi, ri = np.array([x["id"] for x in qs]), np.array([x["id"] for x in rs])
                a, b = (np.array([x["v"] for x in side], np.float64) for side in (qs, rs))
                la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                sims = np.round(a @ b.T / np.maximum(np.outer(la, lb), 1e-300), 9)
                for i in range(len(qi)):
                    top = np.lexsort((ri, -sims[i]))[:k]
                    yield pd.DataFrame({"query_id": qi[i], "ref_id": ri[top], "sim": sims[i][top]})

    found = met.mapInPandas(product, "query_id long, ref_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def viterbi(sims: np.ndarray, places: np.ndarray, dt: float, speed: float = 40.0, slack: float = 30.0, price: float = 0.02) -> list[int]:
    """Best path of references, one a query: similarity minus a price on jumps beyond a plausible speed."""
    gap = np.hypot(places[:, None, 0] - places[None, :, 0], places[:, None, 1] - places[None, :, 1])
    move = -price * np.maximum(0.0, gap - (slack + speed * max(dt, 0.5)))
    total, back = sims[0].astype(float), []
    for row in sims[1:]:
        reach = total[:, None] + move
        back.append(reach.argmax(axis=0))
        total = reach.max(axis=0) + row
    path = [int(total.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def viterbi_decode(sims: DataFrame, refs: DataFrame, key: str, dt: float, most_refs: int = 6000) -> DataFrame:
    """key, q, ref: decoded reference of each query of a clip.

    ``sims`` has key, q, ref, sim; ``refs`` has key, ref, x, y.  A clip with more
    than ``most_refs`` references is refused, as its transition table would not
    fit; pairs that are missing count as similarity 0.
    """

    def decode(clip: tuple, s: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(r) > most_refs:
            raise ValueError(f"{len(r)} references in clip {clip[0]}; at most {most_refs} can be decoded")
        r = r.sort_values("ref").reset_index(drop=True)
        table = s.pivot_table(index="q", columns="ref", values="sim", fill_value=0.0).reindex(columns=r["ref"], fill_value=0.0).sort_index()
        if not len(table) or not len(r):
            return pd.DataFrame({key: [], "q": [], "ref": []})
        path = viterbi(table.to_numpy(), r[["x", "y"]].to_numpy(float), dt)
        return pd.DataFrame({key: clip[0], "q": table.index, "ref": r["ref"].to_numpy()[path]})

    refs = refs.select(*[F.col(c).alias(c) for c in (key, "ref", "x", "y")])  # both sides may come from one table
    return sims.groupBy(key).cogroup(refs.groupBy(key)).applyInPandas(decode, f"{key} long, q long, ref long")
