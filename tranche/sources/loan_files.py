"""Reading pipe-delimited loan files row by row: typed rows, rejected rows and load statistics.

Fields are split at | alone (no quoting, no header). A row with another number of fields than the layout, or
with a non-empty token that its kind can't hold, is rejected with a reason. Empty lines don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tranche.functions.scalars import typed

#: Rejected rows that a strict read names.
SHOWN = 20


class RejectedRows(ValueError):
    """A strict read met rows that don't fit the layout."""


#: The columns that say where a line stands; rows of a file are in order of (piece, n).
PLACE = ("file", "piece", "n")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, piece (where its part of the file begins), n (rising in a piece) and value of every line; .gz files are read as
    they are, one task each: see gzip_lines for files of many members."""
    meta = lambda c: F.col(f"_metadata.{c}")
    return spark.read.text(paths).select(meta("file_path").alias("file"), meta("file_block_start").alias("piece"), F.monotonically_increasing_id().alias("n"), "value")


def numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds `line`, the number of a row's line in its file, from 1. rows: some of the lines; these are counted once, by piece."""
    pieces = lines.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("_lines"), F.min("n").alias("_first"))
    ahead = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_ahead", F.coalesce(F.sum("_lines").over(ahead), F.lit(0))).drop("_lines")
    return rows.join(pieces, ["file", "piece"]).withColumn("line", F.col("_ahead") + F.col("n") - F.col("_first") + 1).drop("_ahead", "_first")


def examined(lines: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """lines: value, maybe file. Adds the typed fields and `reason`, null for good rows."""
    n = len(layout)
    token = lambda i: F.get(F.col("_t"), F.lit(i))
    rows = lines.where(F.length("value") > 0).withColumn("_t", F.split("value", r"\|", -1))
    # fields go through a generator: a filter on the reason, pushed through plain projections, would repeat each field's conversion many times
    made = F.struct(*[typed(token(i), kind).alias(f"_{name}") for i, (name, kind) in enumerate(layout)])
    rows = rows.withColumn("_made", F.array(made)).select(*lines.columns, "_t", F.inline_outer("_made"))
    checked = [(i, name, kind) for i, (name, kind) in enumerate(layout) if kind != "text"]
    # one small test a field; names are looked up only for the first that fails
    wrong = F.array(*[F.col(f"_{name}").isNull() & (F.trim(token(i)) != "") for i, name, _ in checked])
    said = F.array(*[F.lit(f"{name}: no {kind}: ") for _, name, kind in checked])
    spots = F.array(*[F.lit(i) for i, _, _ in checked])
    rows = rows.withColumn("_at", F.array_position(wrong, True).cast("int") - 1)
    reason = F.when(F.size("_t") != n, F.concat(F.lit(f"expected {n} fields, found "), F.size("_t").cast("string")))
    reason = reason.when(F.col("_at") >= 0, F.concat(F.get(said, F.col("_at")), F.get(F.col("_t"), F.get(spots, F.col("_at")))))
    return rows.select(*lines.columns, reason.alias("reason"), *[F.col(f"_{name}").alias(name) for name, _ in layout])


def parsed(lines: DataFrame, layout: list[tuple[str, str]], strict: bool = False, place: bool = False) -> DataFrame:
    """Good rows, typed. strict: raises RejectedRows if there are others. place: adds a struct of where each line stands, by
    which later lines can be told from earlier ones."""
    rows = examined(lines, layout)
    if strict and (bad := rejected(lines, layout).limit(SHOWN).collect()):
        raise RejectedRows("\n".join(" | ".join(str(x) for x in r) for r in bad))
    where = [F.struct(*PLACE).alias("place")] if place else []
    return rows.where("reason is null").select(*[name for name, _ in layout], *where)


def rejected(lines: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """Rejected rows as they were read, with the reason; with their line's number if the lines say where they stand."""
    bad = examined(lines, layout).where("reason is not null").select(*lines.columns, "reason")
    if not set(PLACE) <= set(lines.columns):
        return bad
    return numbered(bad, lines).select("file", "line", "value", "reason")


def load_stats(lines: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """One row: rows_read, rows_ok, rows_skipped."""
    ok = F.count_if(F.col("reason").isNull())
    return examined(lines, layout).agg(F.count(F.lit(1)).alias("rows_read"), ok.alias("rows_ok"), (F.count(F.lit(1)) - ok).alias("rows_skipped"))
