"""Conflict-constrained best-fit packing of documents into training rows.

A bin holds at most ``capacity`` words.  It carries a bitmap of the sources and
one of the duplicate clusters already in it; a piece may not join a bin that
has its source or its cluster.  Pieces go longest first, each into the tightest
bin that takes it: bins are ordered by residual, and the successor search goes
on from the smallest sufficient residual until a compatible bin is found.  A
text longer than the capacity is cut into full pieces and a remainder.

Pieces are dealt by a hash to shards of about SHARD pieces, so a hot source or a
large cluster spreads over all of them and no task grows with the input.  The
pieces of bins that a shard leaves less full than FILL are dealt out and packed
again, and so on until one shard is left or nothing more is gained, so what is
lost against one packing of everything is bounded by the last round.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch, map_texts

CAPACITY = 2048
SHARD = 4096
#: Share of the capacity from which a bin is not opened again, and the share of a
#: round's pieces that must leave it for another round.
FILL, GAIN = 0.98, 0.1
PIECES = "doc_id long, piece int, n_words long, word_offset long, source string, cluster long"
BINS = "doc_id long, piece int, n_words long, word_offset long, shard int, bin int, bin_offset int, bin_used int"


def best_fit(pieces: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in the bin) of each piece (size, source, cluster), in the order given.

    None as source or cluster conflicts with nothing; both are small numbers, bits
    of a bin's bitmaps.  Bins are searched by (residual, sources, number); those with
    equal residual and equal sources form one run, so that a full run of
    incompatible bins is passed by its bitmap.
    """
    order: list[tuple[int, int, int]] = []  # (residual, sources, bin), sorted
    clusters: list[int] = []
    used: list[int] = []
    out = []
    for size, source, cluster in pieces:
        bit, mark = (0 if x is None else 1 << x for x in (source, cluster))
        at = bisect_left(order, (size, 0, 0))
        while at < len(order):
            residual, sources, number = order[at]
            if bit & sources:
                at = bisect_left(order, (residual, sources + 1, 0), at + 1)
            elif mark & clusters[number]:
                at += 1
            else:
                break
        if at < len(order):
            residual, sources, number = order.pop(at)
        else:
            residual, sources, number = capacity, 0, len(used)
            clusters.append(0)
            used.append(0)
        out.append((number, used[number]))
        used[number] += size
        clusters[number] |= mark
        if residual > size:
            insort(order, (residual - size, sources | bit, number))
    return out


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one shard with columns doc_id, piece, n_words, word_offset, shard, source, cluster."""
    rows = rows.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    codes, _ = pd.factorize(rows["source"], sort=True)
    source = [None if c < 0 else int(c) for c in codes]
    # a cluster that is here once has no bit: it cannot conflict
    several = rows["cluster"].where(rows["cluster"].duplicated(keep=False))
    marks, _ = pd.factorize(several, sort=True)
    cluster = [None if c < 0 else int(c) for c in marks]
    found = best_fit(list(zip(rows["n_words"].tolist(), source, cluster)), capacity)
    rows["bin"] = [b for b, _ in found]
    rows["bin_offset"] = [o for _, o in found]
    rows["bin_used"] = rows.groupby("bin")["n_words"].transform("sum")
    return rows[[c.split()[0] for c in f"{BINS}, source string, cluster long".split(", ")]]


def pieces_of(docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, words: str | None = None) -> DataFrame:
    """One row a piece of at most ``capacity`` words; documents without words have none."""
    if words and cluster:
        own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), docs[cluster].cast("long").alias("cluster"), docs[words].cast("long").alias("words"))
        return _cut(own.where("words > 0"), capacity)
    given = docs[cluster].cast("long") if cluster else F.lit(None).cast("long")
    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), given.alias("cluster"), docs[text].alias("text")]

    def make():
        from xxhash import xxh3_64_intdigest

        def apply(batch: pa.RecordBatch) -> dict:
            words = [t.encode().split() if t else [] for t in batch.column(3).to_pylist()]  # ASCII white space
            own = batch.column(2)
            if not cluster:
                own = pa.array(np.array([xxh3_64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64))
            return {"doc_id": batch.column(0), "source": batch.column(1), "cluster": own, "words": [len(w) for w in words]}

        return apply

    own = map_texts(docs, picked, "text", "doc_id long, source string, cluster long, words long", make).where("words > 0")
    return _cut(own, capacity)


def _cut(own: DataFrame, capacity: int) -> DataFrame:
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int")))
    cut = own.select("*", piece.alias("piece")).withColumn("word_offset", F.col("piece").cast("long") * capacity)
    return cut.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("word_offset")).alias("n_words"), "word_offset", "source", "cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, words: str | None = None) -> DataFrame:
    """Bins of all documents: one row a piece with its shard, bin and offset.

    ``cluster`` names a column of duplicate clusters; without it, texts that are
    equal but for white space form one.  ``words``, which goes with ``cluster``,
    names a column of numbers of words; texts are not read then.  A null id, source or cluster is packed
    like any other; null sources and clusters conflict with nothing, null and
    wordless texts have no piece.  Repeated rows are pieces of one cluster.  Ties
    go to the lower doc_id, then to the lower bin.  An empty table gives no rows;
    columns beside those named are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    left = scratch.table(pieces_of(docs, capacity, doc_id, text, source, cluster, words), "pieces")
    packed, first, total = [], 0, left.count()
    while total:
        shards = -(-total // shard)
        # every round deals anew; shards are numbered on over the rounds
        dealt = left.withColumn("shard", (F.pmod(F.xxhash64("doc_id", "piece", "cluster", F.lit(first)), F.lit(shards)) + first).cast("int"))
        done = dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), f"{BINS}, source string, cluster long")
        done = scratch.table(done, f"round{len(packed)}")
        under = F.col("bin_used") < FILL * capacity
        open_pieces = done.where(under).count() if shards > 1 else 0
        again = 0 < open_pieces <= (1 - GAIN) * total
        packed.append((done.where(~under) if again else done).drop("source", "cluster"))
        if not again:
            break
        left, total, first = done.where(under).select(*[c.split()[0] for c in PIECES.split(", ")]), open_pieces, first + shards
    if not packed:
        return docs.sparkSession.createDataFrame([], BINS)
    out = packed[0]
    for part in packed[1:]:
        out = out.unionByName(part)
    return out
