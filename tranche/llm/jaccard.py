"""Near copies by SimHash and, beyond its radius, MinHash. What links is always the Jaccard similarity of the sets of
5-word shingles: at least 4 / 5, counted exactly.

1. Texts with equal sets of shingles fold into one node, which has the SimHash fingerprint of its set.
2. Fingerprints link as in simhash: by signatures with a bit left out, verified, a spanning forest a bucket. A link's
   nodes, and those of one fingerprint, are compared, and what is similar enough forms components.
3. At 0.8 fingerprints differ in some 10 bits, far beyond that radius. So a node also has BANDS signatures of ROWS least
   hashes each, and nodes with an equal one are candidates too. A pair at 0.8 shares none with probability
   (1 - 0.8^6)^36 < 2e-5. Each node is compared with the smallest node of each of its buckets, unless step 2 has both hang
   together. That settles buckets whose members all hang together; no bucket is unfolded into pairs.
4. The other buckets are compared whole, pair by pair, except where both are known to hang together and where
   an earlier signature in common has them compared elsewhere. Large buckets are cut into chunks, and each two chunks
   meet in a task of their own.

Words and letters are those of simhash; shingles are told apart by XXH64 (seed 42), sets by a hash of 64 bits. Defined
results: fewer words than a shingle are one shingle; texts without words, or null, are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import in_slices, table, text_key
from .simhash import NO_ID

SHINGLE, BANDS, ROWS, STEP = 5, 36, 6, 2048
#: Nodes and shingles of a chunk, about.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
_rng = np.random.default_rng(11)
_TIMES = (_rng.integers(0, 1 << 31, (BANDS * ROWS, 1)) * 2 + 1).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    grams = map(joined.__getitem__, map(slice, [0, *(ends[: n - 1] + 1).tolist()], ends[-n:].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n).view(np.int64))


def signatures(found: np.ndarray) -> list[int]:
    """One for each band; none for an empty set."""
    if not len(found):
        return []
    least, x = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32), (found.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), STEP):
        np.minimum(least, (x[i : i + STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) for b in range(BANDS)]


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, text to doc_id, part, node, n (different shingles), fp (their fingerprint) and bands."""
    for b in in_slices(batches, 2):
        sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(2)]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        fp = pa.array([simhash.majority(simhash.ones(s), len(s)) for s in sets], pa.int64())
        bands = pa.array([np.array(signatures(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), fp, bands], ["doc_id", "part", "node", "n", "fp", "bands"])


def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text to node and its shingles."""
    for b in in_slices(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], pa.list_(pa.int64()))], ["node", "shingles"])


def enough(shared, a, b):
    """Whether shared / (a + b - shared) is at least 4 / 5, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v that are near copies."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    near: Column = enough(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))
    return both.where(near).select("u", "v")


def compare(t: pa.Table) -> pa.Table:
    """Members of one bucket, or of two of its chunks, to the links that join their roots."""
    sig, node, root = t.column("sig")[0].as_py(), t.column("node").to_numpy(), np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
    lists = t.column("shingles").combine_chunks()
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    start = np.cumsum(size) - size
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    band = int(np.flatnonzero(bands[0] == sig)[0])
    u, v = [], []
    for a in range(len(node)):
        at = a + 1 + np.flatnonzero((root[a + 1 :] != root[a]) & enough(np.minimum(size[a + 1 :], size[a]), size[a + 1 :], size[a]))
        at = at[~(bands[at, :band] == bands[a, :band]).any(axis=1)]
        if not len(at):
            continue
        mine, n = flat[start[a] : start[a] + size[a]], size[at]
        ends = np.cumsum(n)
        theirs = flat[np.arange(ends[-1]) + np.repeat(start[at] - (ends - n), n)]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        at = at[enough(np.add.reduceat(hit, ends - n, dtype=np.int64), n, size[a])]
        if len(at):
            root[np.isin(root, root[at])] = root[a]
            u += [node[a]] * len(at)
            v += node[at].tolist()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def close(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp. Pairs u, v to compare: the smallest nodes of fingerprints that link, and those of each one's others."""
    centres = table(nodes.groupBy("fp").agg(F.min("node").alias("centre")))
    end = lambda to: centres.select(F.col("fp").alias(f"fp_{to}"), F.col("centre").alias(to))
    linked = simhash.links(centres.select("fp")).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v")).distinct()
    equal = nodes.join(centres, "fp").where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    return linked.join(end("u"), "fp_u").join(end("v"), "fp_v").select("u", "v").union(equal)


def bucketed(nodes: DataFrame) -> DataFrame:
    """nodes: node, n, bands. sig, node, n, centre for each signature that several nodes have; centre is the smallest of these."""
    signed = nodes.select("node", "n", F.explode("bands").alias("sig"))
    met = signed.groupBy("sig").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return signed.join(met, "sig").select("sig", "node", "n", "centre")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs u, v that don't hang together."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    placed = pairs.join(end("u"), "u", "left").join(end("v"), "v", "left")
    return placed.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, part, node, component_id for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("part"), F.col(text).alias("text"))
    marked = table(rows.mapInArrow(mark, "doc_id long, part binary, node long, n long, fp long, bands array<long>"))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("part").alias("part"))
    nodes = table(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(place).alias("place"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    met = table(close(nodes.select("node", "fp")))
    members = table(bucketed(nodes))
    compared = members.select("node").union(met.select("u")).union(met.select("v")).distinct()
    wanted = nodes.join(compared, "node").select("node", F.col("place.id").alias("_id"), F.col("place.part").alias("_part"))
    texts = rows.join(wanted, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_id")) & (F.col("part") == F.col("_part"))).select("node", "text")
    sets = table(texts.mapInArrow(unfold, "node long, shingles array<long>").dropDuplicates(["node"]))

    others = members.where("node <> centre")
    hang = lambda roots: roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))  # noqa: E731  as links; what hangs together is not searched again
    roots = table(components(alike(met, sets)))
    more = alike(apart(others.select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), roots), sets)
    roots = table(components(hang(roots).union(more)))
    others = table(others.join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("root")))
    left = others.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("a <> b")
    cut = left.select("sig", F.ceil(F.greatest(F.col("m") / chunk, F.col("s") / CHUNK_SHINGLES)).alias("k"))
    grid = others.join(cut, "sig").withColumn("chunk", F.pmod(F.xxhash64("node"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    grid = grid.select("sig", "node", "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    more = grid.join(sets, "node").join(nodes.select("node", "bands"), "node").groupBy("sig", "i", "j").applyInArrow(compare, "u long, v long")

    roots = components(hang(roots).union(more))
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = table(placed.join(least, "root").select("node", "component_id"))
    return marked.join(named, "node").select("doc_id", "part", "node", "component_id")
