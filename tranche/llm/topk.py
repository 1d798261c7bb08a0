"""Exact top-k by inner product, block against block.

Vectors become whole numbers, so scores are exact integers. Rows and queries are packed into blocks, and each
partition of queries meets each partition of rows in a cartesian product, which reads them again where they lie and
copies none. While the blocks of a partition of rows go by, the k best of each query are kept, and its floor: the kth
best pair of score and id so far. Blocks of rows are dealt to bins. The first bin is searched first and gives each
query the floor with which the others are searched, so that of these about k * bins rows a query are passed on, also
where scores are equal.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take
no part; shorter vectors count as filled up with zeros; rows with the query's own id are not its
candidates; a repeated candidate row counts each time; of several rows with a query's id the smallest
vector asks; no candidates, no rows. Scores must fit in 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

GROUP, QUERIES, BINS = 4096, 4096, 16
#: Numbers in a block at most; bytes of a partition of rows; products of numbers in a task.
NUMBERS, PART, WORK = 1 << 21, 1 << 24, 1e11
#: Queries and rows of a matrix of scores.
ROWS, COLUMNS = 512, 1024
LEAST, MOST = -(2**63), 2**63 - 1

BLOCK = "bin long, block long, n long, width long, norm double, ids binary, v binary, low binary, last binary"


def quantised(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v as they are to go to whole()."""
    kind = "float" if vectors.select(vector).dtypes[0][1] == "array<float>" else "double"
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))


def whole(scale: int):
    """floor(scale * x) of each component, as a double, within 64 bits; without rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("id").is_valid(), batch.column("v").is_valid()))
            x, lengths = flat(batch.column("v").flatten()).astype(np.float64), flat(batch.column("v").value_lengths()).astype(np.int64)
            if not (fine := np.isfinite(x)).all():
                row = np.repeat(np.arange(len(lengths)), lengths)
                take = np.ones(len(lengths), bool)
                take[row[~fine]] = False
                batch, x, lengths = batch.filter(pa.array(take)), x[take[row]], lengths[take]
            with np.errstate(over="ignore"):
                x = np.floor(x * scale)
            v = np.where(x >= 2.0**63, MOST, np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(v))], ["id", "v"])

    return run


def flat(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def matrix(v: pa.Array, width: int) -> np.ndarray:
    lengths, items = flat(v.value_lengths()).astype(np.int64), flat(v.flatten())
    if len(lengths) and (lengths == width).all():
        return items.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = items
    return out


def narrowed(x: np.ndarray) -> np.ndarray:
    least, most = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def filled(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def pack(size: int, bins: int):
    """Rows of id, v and, of queries, low and last, in blocks of `size` rows; of fewer where vectors are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = flat(batch.column("v").value_lengths())
            most = max(1, min(size, NUMBERS // max(1, int(lengths.max(initial=0)))))
            step = math.ceil(batch.num_rows / max(1, math.ceil(batch.num_rows / most)))
            for begin in range(0, batch.num_rows, max(1, step)):
                own = batch.slice(begin, step)
                x = matrix(own.column("v"), int(lengths[begin : begin + step].max()))
                norm = float(np.sqrt(np.square(x, dtype=np.float64).sum(axis=1).max(initial=0)))
                floors = [own.column(c).to_numpy().tobytes() if c in own.schema.names else None for c in ("low", "last")]
                row = [(part + block) % bins, (part << 32) + block, len(x), x.shape[1], norm, own.column("id").to_numpy().tobytes(), narrowed(x).tobytes(), *floors]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.int64()] * 4 + [pa.float64()] + [pa.binary()] * 4)], names=[c.split()[0] for c in BLOCK.split(", ")])
                block += 1

    return run


def column(batch: pa.RecordBatch, name: str, i: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def unpacked(batch: pa.RecordBatch, side: str, i: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ids, vectors and the greatest length of a block."""
    n, width, norm = (batch.column(side + c)[i].as_py() for c in ("n", "width", "norm"))
    size = len(batch.column(side + "v")[i].as_buffer()) // max(1, n * width)
    return column(batch, side + "ids", i), column(batch, side + "v", i, {0: np.int64, 2: np.int16, 4: np.int32, 8: np.int64}[size]).reshape(n, width), norm


class Best:
    """The k best rows of each query of a block, of those not below its floor."""

    def __init__(self, at: np.ndarray, v: np.ndarray, norm: float, low: np.ndarray, last: np.ndarray, k: int):
        self.at, self.v, self.norm, self.low, self.last, self.k = at, v, norm, low.copy(), last.copy(), k
        self.found, self.count, self.most = [], 0, 4 * k * len(at)
        self.ready: dict = {}
        self.room = {t: np.empty(ROWS * COLUMNS, t) for t in (np.float32, np.float64, np.int64)}

    def look(self, ids: np.ndarray, x: np.ndarray, norm: float) -> None:
        """Exact: in floating point while no part of a sum can pass what its kind holds exactly, else in 64-bit integers."""
        bound, width = self.norm * norm * (1 + 1e-9), max(self.v.shape[1], x.shape[1])
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        if (kind, width) not in self.ready:
            self.ready = {(kind, width): filled(self.v, width).astype(kind)}
        q, x = self.ready[kind, width], filled(x, width).astype(kind)
        for c in range(0, len(ids), COLUMNS):
            own, xt = ids[c : c + COLUMNS], x[c : c + COLUMNS].T
            for s in range(0, len(q), ROWS):
                part = q[s : s + ROWS]
                self.take(s, np.matmul(part, xt, out=self.room[kind][: len(part) * len(own)].reshape(len(part), len(own))), own)
            if self.count and (self.low == LEAST).any():
                self.settle()

    def take(self, s: int, score: np.ndarray, ids: np.ndarray) -> None:
        e = s + len(score)
        at, low, last = self.at[s:e], self.low[s:e], self.last[s:e]
        least = (low + ((last < ids.min()) & (low < MOST))).astype(score.dtype)  # equal scores don't count where all ids are larger
        new = np.flatnonzero(low == LEAST)
        if len(new) and len(ids) > self.k:  # no floor yet: the kth score here is one
            near = score[new]
            near[at[new][:, None] == ids[None, :]] = LEAST
            least[new] = np.partition(near, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        hit = np.flatnonzero(score.max(axis=1) >= least)
        if not len(hit):
            return
        row, col = np.nonzero(score[hit] >= least[hit][:, None])
        row, who = hit[row], ids[col]
        val = score[row, col].astype(np.int64)
        keep = (who != at[row]) & ((val > low[row]) | (who <= last[row]))
        self.found.append((row[keep] + s, who[keep], val[keep]))
        self.count += int(keep.sum())
        if self.count > self.most:
            self.settle()

    def settle(self) -> None:
        row, who, val = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((who, ~val, row))  # ~: higher scores first, without overflow
        row, who, val = row[order], who[order], val[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        kth = nth == self.k - 1
        self.low[row[kth]], self.last[row[kth]] = val[kth], who[kth]
        keep = nth < self.k
        self.found = [(row[keep], who[keep], val[keep])]
        self.count = int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            self.settle()
            row, who, val = self.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.at[row]), pa.array(who), pa.array(val)], ["query_id", "vec_id", "score"])


def search(k: int):
    """Pairs of blocks, those of one block of queries one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                if (now := batch.column("q_block")[i].as_py()) != block:
                    if best:
                        yield from best.rows()
                    block, best = now, Best(*unpacked(batch, "q_", i), column(batch, "q_low", i), column(batch, "q_last", i), k)
                best.look(*unpacked(batch, "x_", i))
        if best:
            yield from best.rows()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", group: int = GROUP, per_block: int = QUERIES, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; ties to the smaller id. is_query: condition on vectors.
    Blocks are of `group` rows and `per_block` queries; one bin of `bins` is searched before the others."""
    packed, exact = pack(group, bins), whole(scale)
    xs = table(quantised(vectors, vec_id, vector).mapInArrow(lambda batches: packed(exact(batches)), BLOCK).drop("block", "low", "last"))
    asks = table(quantised(vectors.where(is_query), vec_id, vector).mapInArrow(exact, "id long, v array<long>").groupBy("id").agg(F.min("v").alias("v")))
    asked = asks.count()
    few = max(1, math.ceil(asked / per_block / 4))  # else each partition of the join before would end in a small block
    side = lambda df, letter: df.toDF(*(f"{letter}_{c}" for c in df.columns))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def found(qs: DataFrame, xs: DataFrame) -> DataFrame:
        qs = table(qs.repartition(few).mapInArrow(pack(per_block, 1), BLOCK).drop("bin"))
        blocks = qs.count()
        size, numbers = xs.agg(F.sum(F.length("v") + F.length("ids")), F.sum(F.col("n") * F.col("width"))).first()
        parts = max(1, math.ceil((size or 0) / PART))
        shares = max(1, min(blocks, math.ceil(asked * (numbers or 0) / WORK / parts)))
        pairs = side(qs.repartition(shares), "q").crossJoin(side(xs.repartition(parts), "x").hint("shuffle_replicate_nl"))
        return pairs.mapInArrow(search(k), "query_id long, vec_id long, score long")

    floors = lambda low, last: asks_of.select("id", "v", F.coalesce(low, F.lit(LEAST)).alias("low"), F.coalesce(last, F.lit(MOST)).alias("last"))
    asks_of, none = asks, F.lit(None).cast("long")
    if xs.count() <= bins:
        return ranked(found(floors(none, none), xs))
    first = table(ranked(found(floors(none, none), xs.where("bin = 0"))))
    asks_of = asks.join(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("low"), F.col("vec_id").alias("last")), "id", "left")
    return ranked(first.drop("rank").unionByName(found(floors(F.col("low"), F.col("last")), xs.where("bin > 0"))))
