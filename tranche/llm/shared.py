"""What the operators of this subpackage share: tables in the cluster's shared folder, and word rules."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-tranche-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set, a local folder for
    a local master; on a cluster that is an error, since executors would each write to a disk of their own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def table(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and lost executors cost nothing.
    by: a column of few values, each of which gets files of its own."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path, compression=compression, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what table() wrote, once all that was made of it has been written itself."""
    _delete(df.sparkSession, df._table_path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that weren't written yet are lost with them."""
    _delete(spark, _folder(spark))


def text_key(text: str | Column = "text") -> Column:
    """The first 16 bytes of a text's SHA-256 (null: empty); tells texts apart whose rows have one doc_id, or none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def in_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (or lists of numbers, at 4 bytes) take about `most` bytes, so that what is
    made of a batch of long texts is never held whole."""
    for b in batches:
        c = b.column(column)
        size = pc.multiply(pc.list_value_length(c), 4) if pa.types.is_list(c.type) else pc.binary_length(c)
        part = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if end > begin:
                yield b.slice(begin, end - begin)
    pa.default_memory_pool().release_unused()


def before(rows: DataFrame, part: str, value: str, to: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `to`: the sum of `value` over rows of smaller `part` (a whole number, once for each `by`). Windows look at a
    thousand parts, and then at one row for each thousand."""
    keys = [*by, "_block"]
    rows = rows.withColumn("_block", F.shiftright(part, 10))
    ahead = lambda keys, order: Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys).agg(F.sum(value).alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead([*by], "_block")), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(ahead(keys, part)), F.lit(0))
    return rows.join(blocks, keys).withColumn(to, F.col("_ahead") + inside).drop("_block", "_ahead")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the decimal doc_id, modulo by: the folds of the learned operators. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
