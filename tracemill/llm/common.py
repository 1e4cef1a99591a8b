"""Shared helpers: scratch tables, batch mapping, crc32 folds."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one call of a batch function: at most this many rows and,
#: unless a single text is larger, this many bytes.
SLICE_ROWS = 512
SLICE_BYTES = 2 << 20
#: Rows of one key that are held back at most until its last one is known.
HELD = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one in the warehouse, which executors share too, where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written to the shared folder, which cut lineage durably.

    Every table lies below one folder of its own, so jobs do not meet.  Tables
    that later steps no longer read are removed with :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table.

        Shuffle files of finished steps go when the driver collects its garbage,
        so it is asked to: a job then holds the disk of its current step only.
        """
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Ask the driver to collect its garbage, and with it the shuffle files of plans that have ended.

        Just after a plan its events still hold it; what must be gone before a large
        step is asked for once more before that step.
        """
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, text: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice stays within ``rows`` and SLICE_BYTES."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= rows or total + size > SLICE_BYTES):
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    columns: Iterable[str | Column],
    text: str,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply a batch function to slices of ``df``, one output batch a slice.

    ``make`` is called once in each task and returns the batch function, so a
    model or cache is built once; the function returns columns by name.
    """
    picked = df.select(*columns)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in batches:
            for part in slices(batch, text, rows):
                apply = apply or make()
                out = apply(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return picked.mapInArrow(run, schema)


def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by their columns, those whose first column has several values of the second.

    Repeated rows count once.  A last column named often, if there is one, keeps a
    row anyway and is not passed on.  Rows are streamed: only those of the
    last (first, second) pair are held back between batches, with whether their
    first column is already known to have company.
    """
    held, known = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        fresh = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
        batch = batch.filter(pa.array(fresh))
        g, i = columns[0][fresh], columns[1][fresh]
        same = np.r_[False, g[1:] == g[:-1]]
        other = same & np.r_[False, i[1:] != i[:-1]]
        other[0] = known
        starts = np.flatnonzero(~same)
        met = np.logical_or.reduceat(other, starts)
        keep = np.repeat(met, np.diff(np.r_[starts, len(g)]))
        if batch.schema.names[-1] == "often":
            keep |= columns[-1][fresh]
        last = len(g) - int(np.argmax(((g != g[-1]) | (i != i[-1]))[::-1])) if (g[0] != g[-1] or i[0] != i[-1]) else 0
        held, known = batch.slice(last), bool(met[-1])
        flags = keep[last:]
        if last:
            yield _without_flag(batch.slice(0, last).filter(pa.array(keep[:last])))
    if held is not None:
        yield _without_flag(held.filter(pa.array(flags)))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, h, indexed) sorted by key, those whose key has several h, once each: indexed if any is; size: the key's rows.

    Rows are streamed: of the last key in a batch, which may go on in the next, at
    most HELD distinct rows are held back.  A longer one passes in parts; their
    sizes are those of the parts, and a row may stand in several.
    """
    held: pa.Table | None = None
    going = None  # the last key, if a part of it has passed

    def parted(rows: pa.Table) -> pa.RecordBatch:
        key, value = (rows.column(c).to_numpy() for c in (0, 1))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        met = np.minimum.reduceat(value, starts) != np.maximum.reduceat(value, starts)
        met[0] |= going is not None and key[0] == going
        kept = once(rows.filter(pa.array(np.repeat(met, np.diff(np.r_[starts, len(key)])))))
        _, at, size = np.unique(kept.column(0).to_numpy(), return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), pa.array(size[at], pa.int64())], names=["key", "h", "indexed", "size"])

    def once(rows: pa.Table) -> pa.Table:
        return rows.group_by(["key", "h"], use_threads=False).aggregate([("indexed", "max")]).rename_columns(["key", "h", "indexed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        key = rows.column(0).to_numpy()
        last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        if last:
            out = parted(rows.slice(0, last))
            if out.num_rows:
                yield out
            going = None
        held = once(rows.slice(last))
        if held.num_rows > HELD:
            yield parted(held)
            held, going = None, key[-1]
    if held is not None:
        out = parted(held)
        if out.num_rows:
            yield out


def _without_flag(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select([n for n in batch.schema.names if n != "often"])


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def crc32_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def py_crc32(value: int | None) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode())


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32(id) mod ``modulus`` is ``remainder``; null ids are not held out."""
    return F.coalesce(crc32_of(doc_id) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def keep_rows(docs: DataFrame, text: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the mask function keeps."""
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None
        for batch in batches:
            for part in slices(batch, batch.schema.names[position]):
                mask = mask or make()
                yield part.filter(pa.array(mask(part.column(position).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
