"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target of words: weights share the wanted total, no target exceeds
`max_repeat` times the source's own words, and what is cut off is shared again by weight. Equal
blocks of words are then dealt to the sources by highest quotients target / (2 j + 1), and each
source's blocks to its shards in the same way by their words. In each shard the documents stand in
a seeded order; whole passes come first, then a run of blocks from a seeded start.

Only DataFrame operations are used. Shards hold about `shard_docs` documents each, so a source with
a third of all rows is many tasks. Defined results: null text or null size has no words and is taken 0
times; a null source is a source of its own, last in order; equal doc_ids are separate documents, each with a row
of the plan; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, word_count

WEIGHTS, SHARE, MAX_REPEAT, SEED, SHARD_DOCS, MAX_BLOCK, SALTS = (5, 2, 1), 1.5, 2, 42, 4096, 1024, 64


def row_key() -> Column:
    """The doc_id as text; where it is null, a mark of the text."""
    return F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def seeded(seed: int, *parts: Column) -> Column:
    """A number of 60 bits from the MD5 of seed and parts, which any SQL engine can give too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """sources: one row per source (source_key, source, source_size). Adds weight and target.

    In the order of cap / weight the capped sources come first, so one pass of running sums finds the level.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size").cast("double") * max_repeat)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("_cap").over(every)))
        .withColumn("_level", (F.col("_total") - zero(F.sum("_cap").over(before))) / (F.sum("weight").over(every) - zero(F.sum("weight").over(before))))
        .withColumn("_level", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(every))
        .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("_cap")).otherwise(F.col("_level") * F.col("weight")))
        .drop("_cap", "_ratio", "_total", "_level")
    )


def apportion(cells: DataFrame, weight: str, seats: str, group: list[str], key: list[str], to: str) -> DataFrame:
    """Deals `seats` (one value per group) to the cells of a group by highest quotients weight / (2 j + 1).

    A cell holds floor(weight x + 1/2) seats at level x. For any n cells of total weight w, level
    (seats - n/2) / w deals no more than all seats and level (seats + n/2) / w no fewer, so only
    quotients between the two levels, about two per cell, are ranked. Ties go to the smaller key.
    """
    within = Window.partitionBy(*group) if group else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w, n = F.sum(weight).over(within), F.count(F.lit(1)).over(within)
    at = lambda level: F.floor(F.greatest(F.lit(0.0), F.col(weight) * level / F.col("_w")) + 0.5).cast("long")
    dealt = (
        cells.withColumn("_w", w.cast("double")).withColumn("_n", n).where(F.col("_w") > 0)
        .withColumn("_base", at(F.col(seats) - F.col("_n") / 2)).withColumn("_top", at(F.col(seats) + F.col("_n") / 2))
        .withColumn("_left", F.col(seats) - F.sum("_base").over(within))
    )
    rows = dealt.withColumn("_j", F.explode_outer(F.when(F.col("_top") > F.col("_base"), F.sequence(F.col("_base"), F.col("_top") - 1))))
    order = (Window.partitionBy(*group) if group else Window).orderBy((F.col(weight) / (2 * F.col("_j") + 1)).desc_nulls_last(), *key)
    picked = rows.withColumn("_won", (F.col("_j").isNotNull() & (F.row_number().over(order) <= F.col("_left"))).cast("long"))
    return picked.groupBy(*group, *[k for k in key if k not in group]).agg((F.first("_base") + F.sum("_won")).alias(to))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT, seed=SEED, shard_docs=SHARD_DOCS, block: int | None = None) -> DataFrame:
    """Plan of the mix, a row per document: doc_id, row_key, source, size, source_size, target, shard, passes,
    piece_from and piece_to (the words, numbered from 0, of one more partial pass) and taken.

    docs: doc_id, text, source. block: words in a block; unset, 1 to MAX_BLOCK, a 200th of the smallest target.
    """
    sized = table(docs.select("doc_id", row_key().alias("row_key"), "source", (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size")).withColumn("source_key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))))
    sources = targets(sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), weights, share, max_repeat)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fit = F.least(F.lit(MAX_BLOCK), F.greatest(F.lit(1), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 200)))
    sources = table(
        sources.withColumn("block", (F.coalesce(fit, F.lit(1)) if block is None else F.lit(block)).cast("long"))
        .withColumn("_shards", F.ceil(F.col("_docs") / shard_docs).cast("long"))
        .withColumn("_all", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    )
    quota = apportion(sources, "target", "_all", [], ["source_key"], "_quota")
    sources = sources.join(quota, "source_key", "left").select("source_key", "source_size", "target", "block", "_shards", F.coalesce("_quota", F.lit(0)).alias("_quota"))
    # each source stands SALTS times, so that the rows of a large one meet it in many tasks
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = sized.withColumn("_mark", seeded(seed, F.col("row_key"))).withColumn("_salt", F.pmod("_mark", F.lit(SALTS)).cast("int")).join(salted, ["source_key", "_salt"]).drop("_salt").withColumn("shard", F.pmod(seeded(seed + 1, F.col("row_key")), F.col("_shards")))
    shards = placed.groupBy("source_key", "shard").agg(F.sum("size").alias("_shard_size"), F.first("_quota").alias("_quota"))
    shards = apportion(shards, "_shard_size", "_quota", ["source_key"], ["shard"], "_blocks")
    here = Window.partitionBy("source_key", "shard")
    ordered = here.orderBy("_mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = (
        placed.withColumn("_end", F.sum("size").over(ordered)).withColumn("_words", F.sum("size").over(here))
        .join(shards, ["source_key", "shard"], "left")
        .withColumn("_in", F.ceil(F.col("_words") / F.col("block")))  # blocks in a pass
        .withColumn("_blocks", F.least(F.coalesce("_blocks", F.lit(0)), max_repeat * F.col("_in")))
        .withColumn("passes", F.coalesce(F.floor(F.col("_blocks") / F.nullif(F.col("_in"), F.lit(0))), F.lit(0)).cast("int"))
        .withColumn("_more", F.col("_blocks") - F.col("passes") * F.col("_in"))
        .withColumn("_from", F.pmod(seeded(seed + 2, F.col("source_key"), F.col("shard").cast("string")), F.col("_in") - F.col("_more") + 1) * F.col("block"))
        .withColumn("_to", F.col("_from") + F.col("_more") * F.col("block"))
    )
    start = F.col("_end") - F.col("size")
    inside = lambda c: F.coalesce(F.least(F.greatest(F.col(c) - start, F.lit(0)), F.col("size")), F.lit(0)).cast("long")
    return (
        laid.withColumn("piece_from", inside("_from")).withColumn("piece_to", inside("_to"))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("piece_to") - F.col("piece_from"))
        .select("doc_id", "row_key", "source", "size", "source_size", "target", "shard", "passes", "piece_from", "piece_to", "taken")
    )


def apply_plan(docs: DataFrame, plan: DataFrame, size: Column | None = None) -> DataFrame:
    """The mixed documents: the text of every taken one, its passes one below another, then its piece. size: as in mix().

    A row follows the plan's row of its row_key and size. Rows that repeat both are numbered, on both sides; only these
    are sorted, whatever share of a table they are. Other columns pass through, whatever their names.
    """
    own = word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key().alias("_key"), own.alias("_size"))
    plans = plan.select(F.col("row_key").alias("_key"), F.col("size").alias("_size"), F.struct("taken", "passes", "piece_from", "piece_to").alias("_plan"))
    keys = table(plans.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"), F.max("_plan").alias("_plan")))
    kept = rows.join(keys.where("_n = 1 and _plan.taken > 0").drop("_n"), ["_key", "_size"]).select("_row", "_plan")
    repeated, within = keys.where("_n > 1").select("_key", "_size"), Window.partitionBy("_key", "_size")
    if not repeated.isEmpty():  # else the texts needn't be read for them
        asked = rows.join(repeated, ["_key", "_size"]).withColumn("_i", F.row_number().over(within.orderBy(F.xxhash64("_row.text"))))
        dealt = plans.join(repeated, ["_key", "_size"]).withColumn("_i", F.row_number().over(within.orderBy("_plan")))
        kept = kept.unionByName(asked.join(dealt.where("_plan.taken > 0"), ["_key", "_size", "_i"]).select("_row", "_plan"))
    text, begin, end = F.col("_row.text"), F.col("_plan.piece_from").cast("int"), F.col("_plan.piece_to").cast("int")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    piece = F.concat_ws(" ", F.slice(words, begin + 1, end - begin))
    whole = F.array_repeat(text, F.col("_plan.passes"))
    kept = kept.withColumn("_text", F.concat_ws("\n", F.when(end > begin, F.concat(whole, F.array(piece))).otherwise(whole)))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return kept.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
