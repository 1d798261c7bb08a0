"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most k bits, cut into k // 2 + 1 segments, differ by at
most one bit in one of them. So each segment is indexed once for every bit left out (a wildcard);
equal variants meet in a bucket and are verified by counting differing bits. A bucket reports a
spanning forest of its links, never all pairs: connected components need no more. Buckets beyond
BUCKET members are cut into chunks, and each two chunks are compared in a task of their own.

Fingerprint: letters A-Z in lower case, words without ASCII white space, shingles of `shingle` words
joined by one space, each hashed with XXH64 (seed 42); a bit is set if it is set in over half of them.
Defined results: fewer words than a shingle are one shingle; no words or null text give fingerprint 0,
which links like any other. Rows with a null id have a component (the smallest id reachable, null if
there is none). Repeated rows each return.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import table, text_key

BITS, SHINGLE, DIFFER, BUCKET, SMALL, STEP = 64, 3, 3, 4096, 12, 1 << 16


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: a bit is set if it is set in over half of them."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    count = np.zeros(BITS, np.int64)
    for i in range(0, n, STEP):
        grams = map(joined.__getitem__, map(slice, starts[i : i + STEP], stops[i : i + STEP]))
        count += ones(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))
    return majority(count, n)


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a long of the same bits."""

    @F.arrow_udf("long")
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts), pa.int64())

    return df.withColumn(to, mark(F.col(text)))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def variants(fps: DataFrame, differ: int = DIFFER) -> DataFrame:
    """sig, fp: for each segment one signature per bit left out. Segment, bit and the bits kept make up the signature."""
    parts = differ // 2 + 1
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    keys = []
    for s in range(parts):
        width = cuts[s + 1] - cuts[s]
        value = F.shiftrightunsigned("fp", cuts[s]).bitwiseAND(F.lit((1 << width) - 1)) if parts > 1 else F.col("fp")
        keys += [F.struct(F.lit(cuts[s] + w).alias("bit"), value.bitwiseAND(F.lit(~(1 << w) if w < 63 else (1 << 63) - 1)).alias("kept")) for w in range(width)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("s")).select(F.col("s.bit").alias("bit"), F.col("s.kept").alias("kept"), "fp")


def forest(x: np.ndarray, differ: int) -> np.ndarray:
    """Edges (n, 2) of a spanning forest of the links within one bucket of unsigned fingerprints: each looks once at
    those not yet reached."""
    out, left = [np.zeros((0, 2), np.uint64)], x
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(left ^ a) <= differ
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                out.append(np.stack([np.full(len(found), a), found], 1))
    return np.concatenate(out)


def edges_of(key: np.ndarray, fp: np.ndarray, differ: int) -> np.ndarray:
    """key: number of the bucket of each fingerprint, ascending. Pairs (n, 2), verified."""
    fp = fp.view(np.uint64)  # numpy counts the bits of a signed number's magnitude
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(key)])
    row = np.repeat(size, size)
    found = []
    for d in range(1, SMALL):
        at = np.flatnonzero((row[:-d] <= SMALL) & (key[d:] == key[:-d])) if len(key) > d else []
        if len(at):
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= differ]
            found.append(np.stack([fp[at], fp[at + d]], 1))
    for b, n in zip(begin[size > SMALL], size[size > SMALL], strict=True):
        found.append(forest(fp[b : b + n], differ))
    return np.unique(np.concatenate(found), axis=0).view(np.int64) if found else np.zeros((0, 2), np.int64)


def compare(differ: int, bucket: int):
    """Rows (bit, kept, fp) in order. Returns links (u, v), and the members of larger buckets with the number of their chunk."""

    def batch(u, v, bit=None, kept=None, chunk=None):
        null = lambda t: pa.nulls(len(u), t)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v) if v is not None else null(pa.int64()), pa.array(bit) if bit is not None else null(pa.int32()), pa.array(kept) if kept is not None else null(pa.int64()), pa.array(chunk) if chunk is not None else null(pa.int64())], ["u", "v", "bit", "kept", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        chunk = 0  # number of chunks of the bucket at the end of held that have gone out

        def large(bit, kept, fp, number):
            return batch(fp, None, bit, kept, np.full(len(fp), number, np.int64))

        def whole(bit, kept, fp):
            key = np.cumsum(np.r_[True, (bit[1:] != bit[:-1]) | (kept[1:] != kept[:-1])]) if len(bit) else bit
            e = edges_of(key, fp, differ)
            return batch(e[:, 0], e[:, 1])

        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            bit, kept, fp = held
            turn = np.flatnonzero(np.r_[True, (bit[1:] != bit[:-1]) | (kept[1:] != kept[:-1])])
            last = turn[-1]
            if chunk and last > 0:  # the bucket that had gone out in part ends here
                yield large(bit[: turn[1]], kept[: turn[1]], fp[: turn[1]], chunk)
                bit, kept, fp, last, chunk = bit[turn[1] :], kept[turn[1] :], fp[turn[1] :], last - turn[1], 0
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, (bit[1:] != bit[:-1]) | (kept[1:] != kept[:-1])]), len(bit)])
            row = np.repeat(size, size)
            done = np.arange(len(bit)) < last
            fits = done & (row <= bucket)
            if fits.any():
                yield whole(bit[fits], kept[fits], fp[fits])
            over = done & (row > bucket)
            if over.any():
                start = np.repeat(np.cumsum(size) - size, size)
                yield batch(fp[over], None, bit[over], kept[over], ((np.arange(len(bit)) - start) // bucket)[over])
            held = [bit[last:], kept[last:], fp[last:]]
            while len(held[0]) > bucket:
                yield large(*(h[:bucket] for h in held), chunk)
                held, chunk = [h[bucket:] for h in held], chunk + 1
        if chunk:
            yield large(*held, chunk)
        else:
            yield whole(*held)

    return run


def compare_chunks(differ: int):
    def run(t: pa.Table) -> pa.Table:
        e = forest(np.unique(t.column("fp").to_numpy()).view(np.uint64), differ).view(np.int64)
        return pa.table({"u": e[:, 0], "v": e[:, 1]})

    return run


def links(fps: DataFrame, differ: int = DIFFER, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct fp. Links u, v whose components are those of all pairs that differ in at most `differ` bits."""
    rows = variants(fps, differ)
    rows = rows.repartition("bit", "kept").sortWithinPartitions("bit", "kept", "fp")
    found = table(rows.select("bit", "kept", "fp").mapInArrow(compare(differ, bucket), "u long, v long, bit int, kept long, chunk long"))
    near = found.where("chunk is null").select("u", "v")
    members = found.where("chunk is not null").select("bit", "kept", "chunk", F.col("u").alias("fp"))
    if members.isEmpty():
        return near
    count = members.groupBy("bit", "kept").agg(F.max("chunk").alias("last"))
    grid = members.join(count, ["bit", "kept"]).select("bit", "kept", "fp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
    grid = grid.select("bit", "kept", "fp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return near.union(grid.groupBy("bit", "kept", "i", "j").applyInArrow(compare_chunks(differ), "u long, v long"))


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, differ: int = DIFFER, bucket: int = BUCKET) -> DataFrame:
    """doc_id, part, fp, component_id for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("part"), F.col(text).alias("text"))
    marked = table(with_fingerprint(rows, shingle=shingle).select("doc_id", "part", "fp"))
    nodes = table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = table(components(links(nodes.select("fp"), differ, bucket)))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = table(placed.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "part", "fp", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Groups without any id stay whole. Other columns pass
    through, whatever their names."""
    key = lambda doc_id, part: F.struct(F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("id"), part.alias("part")).alias("_key")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key(F.col("doc_id"), F.col("part"))).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key(F.col("doc_id"), text_key()))
    return rows.join(first, "_key", "left_semi").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
