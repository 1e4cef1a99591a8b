"""Corpus preparation: the stages that turn raw documents into packed training rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Between stages the rows are written as
Parquet and read again, which cuts lineage and keeps a stage from being repeated.
An empty table passes through every stage; columns beside those of ``documents`` are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import jaccard, langid, lines, packing, toxicity
from tracemill.llm.common import Scratch, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labels' training fold, rejects go.

    Null and wordless texts get the network's bias, which rejects none; repeated
    rows are judged alike.  Without labels of both kinds nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(docs.where(~held_out("doc_id", 3, 1)), labels.where(~held_out("doc_id", 3, 1)))
    return toxicity.drop_toxic(docs, net)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is too close to call, go.

    Null and empty texts have no letter.  Where no language can be learned, none is
    known and all go.  Repeated rows are judged alike.
    """
    return langid.drop_unknown(docs, langid.fit(docs.where(~held_out("doc_id", 4, 2))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are taken out; documents left without any text go.

    The earliest is the one of the lowest (doc_id, line number).  Rows without a
    doc_id keep their lines; rows that repeat a doc_id lose the same lines.
    """
    cut = lines.drop_lines(docs, lines.duplicate_lines(docs))
    return cut.where("trim(text) <> ''")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, that of the lowest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training rows: every document's pieces with their bins and offsets; wordless texts have none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: Two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
