"""What each filter of a chain removes, in every order of the chain, from one packed bitmap index.

Each task packs its rows into NumPy bitsets, one per filter and label, rows ordered by part so that a part is a run of
64-bit words. For each subset of filters that may stand before a step, AND-NOT of the part's bits and the subset's leaves
the rows still there; popcounts of these are summed over parts, tasks and labels. All figures of all orders follow from them.

Defined results: a null part counts as the empty string; a null flag counts as false. Rows, repeated or not, count one by
one. An empty table has no parts, so no rows. A null text is empty; rows without a doc_id are never copies of others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .shared import in_slices, table, text_key

#: Rows of one bitmap index; filters at most (the subsets of filters are counted one by one).
BLOCK, MOST = 1 << 16, 8
#: Fixed values of the text filters: least words, least percentage of distinct words, most percentage of capitals, symbols.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
TEXT_FILTERS = "ABCDE"


def packed(bits: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """A bitset of so many 64-bit words, with each bit at its place."""
    flat = np.zeros(words * 64, bool)
    flat[place] = bits
    return np.packbits(flat, bitorder="little").view(np.uint64)


def subset_popcounts(parts: np.ndarray, n_parts: int, fails: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """parts: a number per row. An array (part, subset, 1 + marks): rows that fail no filter of the subset (bit i: filter i), all
    and by mark."""
    sizes = np.bincount(parts, minlength=n_parts)
    begin = np.concatenate([[0], np.cumsum(-(-sizes // 64))])  # each part starts with a word of its own
    order = np.argsort(parts, kind="stable")
    place = np.empty(len(parts), np.int64)
    place[order] = 64 * np.repeat(begin[:-1], sizes) + np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = int(begin[-1])
    everyone = packed(np.ones(len(parts), bool), place, words)
    filters = [packed(f, place, words) for f in fails]
    members = [everyone, *[packed(m, place, words) for m in marks]]
    out = np.zeros((n_parts, 1 << len(fails), len(members)), np.int64)
    full = np.flatnonzero(sizes)
    union: list[np.ndarray] = [np.zeros(words, np.uint64)]
    for s in range(1 << len(fails)):
        if s:
            low = (s & -s).bit_length() - 1
            union.append(union[s & (s - 1)] | filters[low])
        gone = ~union[s]
        for i, m in enumerate(members):
            out[full, s, i] = np.add.reduceat(np.bitwise_count(m & gone).astype(np.int64), begin[:-1][full])
    return out


def subset_counts(rows: DataFrame, part: str, filters: list[str], labels: dict[str, str]) -> DataFrame:
    """part, subset, kept, and a column per label (name: boolean column of rows): rows of the part that fail none of the
    subset's filters (boolean columns, true where a row fails)."""
    if len(filters) > MOST:
        raise ValueError(f"{MOST} filters at most")
    names = ["kept", *labels]
    schema = StructType([StructField("part", StringType(), False), StructField("subset", IntegerType(), False), *[StructField(c, LongType(), False) for c in names]])
    n, subsets = len(filters), 1 << len(filters)

    def counted(block: pa.Table) -> pa.RecordBatch:
        part = block.column(0).combine_chunks().dictionary_encode()
        flags = [c.combine_chunks().to_numpy(zero_copy_only=False) for c in block.columns[1:]]
        got = subset_popcounts(part.indices.to_numpy().astype(np.int64), len(part.dictionary), flags[:n], flags[n:])
        which = np.repeat(np.arange(len(part.dictionary)), subsets)
        subset = np.tile(np.arange(subsets, dtype=np.int32), len(part.dictionary))
        return pa.RecordBatch.from_arrays([part.dictionary.take(pa.array(which)), pa.array(subset), *[pa.array(got[:, :, i].reshape(-1)) for i in range(len(names))]], ["part", "subset", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield counted(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield counted(pa.Table.from_batches(held))

    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    flags = [false(c).alias(f"f{i}") for i, c in enumerate([*filters, *labels.values()])]
    counts = rows.select(F.coalesce(part, F.lit("")).alias("part"), *flags).mapInArrow(run, schema)
    return counts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in names])


def interactions(counts: DataFrame, letters: str, labels: list[str]) -> DataFrame:
    """counts: what subset_counts() gives. part, filter_order, step and that step's figures, for every order of the letters
    (filter i is letter i): kept, removed, redundant, unique_fails, <label>_lost and shapley (removed, over all orders)."""
    n, names = len(letters), ["kept", *labels]
    every = (1 << n) - 1
    by_subset = F.map_from_entries(F.collect_list(F.struct("subset", F.struct(*names))))  # 2 ** n entries
    parts = counts.groupBy("part").agg(by_subset.alias("by"))
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    rows = parts.select("part", "by", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda i: F.expr(f"shiftleft(1, locate(substring(filter_order, {i}, 1), '{letters}') - 1)")
    own = bit("step").alias("own")
    ahead = F.expr(f"aggregate(slice(sequence(0, {n}), 2, step - 1), 0, (m, i) -> m + shiftleft(1, locate(substring(filter_order, i, 1), '{letters}') - 1))")
    rows = rows.select("*", own, ahead.alias("ahead"))
    at = lambda subset, c="kept": F.element_at("by", subset)[c]
    after = F.col("ahead").bitwiseOR(F.col("own"))
    lost = lambda c: at(F.col("ahead"), c) - at(after, c)
    failing = at(F.lit(0)) - at(F.col("own"))
    weights = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])
    without = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    share = lambda s: F.get(weights, F.bit_count(s)) * (at(s) - at(s.bitwiseOR(F.col("own"))))
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda total, s: total + share(s))
    return rows.select(
        "part", "filter_order", "step", at(after).alias("kept"), lost("kept").alias("removed"), (failing - lost("kept")).alias("redundant"),
        (at(F.lit(every) - F.col("own")) - at(F.lit(every))).alias("unique_fails"), *[lost(c).alias(f"{c}_lost") for c in labels], shapley.alias("shapley"),
    )


def text_flags(texts: pa.Array) -> list[np.ndarray]:
    """Whether each text (binary, without nulls) fails A: words, B: distinct words, C: capitals, D: symbols."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]

    def total(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[ends[1:]] - sums[ends[:-1]]

    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    words, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    raw = data.tobytes()
    for i, (b, e) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        cut = raw[b:e].split()
        words[i], distinct[i] = len(cut), len(set(cut))
    points, capitals = total((data & 0xC0) != 0x80), total((data >= 65) & (data <= 90))
    return [words < LEAST_WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, total(symbols[data]) > 0]


def text_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and A to E: whether a document fails each text filter. E: its text is that of a document of smaller doc_id.

    Texts are read once; what is shuffled is 16 bytes of their SHA-256, and only texts that have copies are joined back.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    names = list(TEXT_FILTERS[:4])
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("part", StringType()), StructField("key", BinaryType()), *[StructField(c, BooleanType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, text_flags(b.column(3)))], schema.names)

    flagged = table(docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), text_key().alias("key"), text.alias("text")).mapInArrow(run, schema))
    first = table(flagged.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"))
    return flagged.join(first, "key", "left").select("doc_id", "part", *names, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds a boolean per mark: whether any label row of the doc_id has it."""
    known = table(labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(m, F.lit(False))).alias(k) for k, m in marks.items()]))
    return rows.join(known, "doc_id", "left")


def text_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five text filters in all their orders, with the good and the toxic documents that each step loses."""
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = with_labels(text_filters(docs, part), labels.select("doc_id", "quality", "toxic"), {f"is_{k}": m for k, m in marks.items()})
    return interactions(subset_counts(rows, "part", list(TEXT_FILTERS), {k: f"is_{k}" for k in marks}), TEXT_FILTERS, list(marks))
