"""Substring dedup with a compressed FM-index per shard.

A window is `width` consecutive words of one document. A window counts as repeated if its words also
start somewhere in a document with a smaller doc_id; every word that a repeated window covers goes.

1. Equal texts fold: only the smallest doc_id of a text goes on. Every window of another copy is
   repeated, so its outcome is known.
2. Every window has an anchor, the least hash of its runs of `RUN` words, so equal windows have equal
   anchors. Neighbouring windows with one anchor form a passage, cut at PIECE windows. Anchors that occur
   in one document only are set aside; they can't hold a repeated window.
3. The passages of the other anchors are folded by their words and dealt to shards by anchor, so all
   places of a window meet in one shard. Per anchor, passages of all documents but the last are
   indexed, since a later document may repeat them, and those of all but the first are streamed.
   Anchors with more than HOT different passages are cut into single windows dealt by the window's own
   hash: no shard depends on one anchor.
4. Each shard builds an FM-index over what is indexed: a wavelet tree over the Burrows-Wheeler
   transform in word numbers, a byte a row for what rows share with the row before, sampled places, and the
   least owner where a window has several rows. Passages are streamed from the right through backward
   search, all at once; where a word doesn't fit, the match is shortened until it does. Matching
   statistics are cut at `width`; where they reach it, the least owner of the interval is reported.
5. Per document the intervals of repeated windows are joined to its words.

Texts and passages are folded by 128 bits of their SHA-256; an anchor only decides where windows meet, and there
whole words are compared. Defined results: null text has no words; rows with null doc_id come after all
others in order and lose what any document with an id holds, and one of two such copies loses nothing to
the other; rows that repeat a doc_id don't repeat each other; documents shorter than a window lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_slices, table, text_key

WIDTH, RUN = 50, 8
#: Windows of a passage at most: what a stream takes in steps. Long repetitive texts have many equal passages, which fold.
PIECE = 2048
#: Words of passages that a shard holds, about.
SHARD_WORDS = 400_000
#: Different passages of one anchor, beyond which its windows are dealt singly.
HOT = 4096
#: Every so many words of a text the index keeps the place of their row.
SAMPLE = 32
#: Bytes of passages that leave a task at a time.
OUT_BYTES = 4 << 20
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


# --- anchors -------------------------------------------------------------------------------------


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_tables: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _tables_for(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _tables[0], _tables[1] = _powers(size, _B), _powers(size, _INV)
    return _tables


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    gap = np.r_[True, _SPACE[data], True]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


def anchors(data: np.ndarray, width: int = WIDTH, run: int = RUN) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words; for each passage its anchor, the word it starts at and its number of windows."""
    begin, end = word_bounds(data)
    n = len(begin)
    none = np.zeros(0, np.int64)
    if n < width:
        return n, none, none, none
    up, down = _tables_for(max(len(data), n) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = _mixed((total[end] - total[begin]) * down[begin])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word * up[:n], out=total[1:])
    runs = _mixed((total[run:] - total[:-run]) * down[: n - run + 1])
    least = np.lib.stride_tricks.sliding_window_view(runs, width - run + 1).argmin(axis=1) + np.arange(n - width + 1)
    anchor = runs[least].view(np.int64)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    windows = np.diff(np.r_[start, n - width + 1])
    parts = -(-windows // PIECE)
    skip = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
    return n, np.repeat(anchor[start], parts), np.repeat(start, parts) + skip, np.minimum(PIECE, np.repeat(windows, parts) - skip)


def scan(width: int, run: int):
    """doc_id, text to n_words, text_hash, kept_sha256 of the whole text and the document's passages."""
    import hashlib

    item = pa.struct([("h", pa.int64()), ("s", pa.int32()), ("m", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1):
            counts, digests, shas, hs, ss, ms, ends = [], [], [], [], [], [], [0]
            for t in b.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                n, h, s, m = anchors(np.frombuffer(raw, np.uint8), width, run)
                counts.append(n)
                digests.append(hashlib.sha256(raw).digest()[:16])
                shas.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                hs.append(h), ss.append(s), ms.append(m), ends.append(ends[-1] + len(h))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, ss, ms)]
            segs = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))], fields=list(item))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), segs)], ["doc_id", "n_words", "text_hash", "whole_sha256", "segments"])

    return rows


def cut(width: int):
    """doc_id, part, text and passages to rows of anchor, place and words."""
    names = ["doc_id", "h", "s", "m", "part", "words"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*cols[:-1], cols[-1].cast(pa.string())], names)

        for b in in_slices(batches, 2, 1 << 20):
            for d, p, t, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                got = t.as_buffer().to_pybytes().split()
                joined = b" ".join(got)
                ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
                del got
                for x in segs:
                    s, m = x["s"], x["m"]
                    words = joined[ends[s - 1] + 1 if s else 0 : ends[s + m + width - 2]]
                    for c, v in zip(out, (d, x["h"], s, m, p, words), strict=True):
                        c.append(v)
                    size += len(words)
                    if size >= OUT_BYTES:
                        yield flush()
                        out, size = [[] for _ in names], 0
            if size:
                yield flush()
                out, size = [[] for _ in names], 0

    return rows


# --- FM-index ------------------------------------------------------------------------------------


class BitRank:
    """A bit vector in words of 64 with counts before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.bits = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.bits.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)[:-1]].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        part = self.bits[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(part).astype(np.int64)


class Wavelet:
    """Wavelet tree, level by level from the highest bit (zeros of a level in front of its ones)."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            on = (values >> bit & 1).astype(bool)
            self.levels.append((bit, BitRank(on)))
            values = np.concatenate([values[~on], values[on]])
        self.start = np.zeros(top + 1, np.int64)
        self.start = self.down(np.arange(top + 1), self.start)  # where each symbol's leaf begins

    def down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.ones(at)
            at = np.where((c >> bit & 1).astype(bool), level.zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each c stands before lo and before hi."""
        both = self.down(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.tile(self.start[c], 2)
        return both[: len(c)], both[len(c) :]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        c = np.zeros(len(at), np.int64)
        for bit, level in self.levels:
            ones = level.ones(at)
            on = level.ones(at + 1) > ones
            c |= on.astype(np.int64) << bit
            at = np.where(on, level.zeros + ones, at - ones)
        return c, at - self.start[c]


class Shared:
    """How many words, cut at a byte, each row shares with the row before; the least of each 64 rows."""

    def __init__(self, lcp: np.ndarray):
        self.rows = np.zeros((len(lcp) // 64 + 1, 64), np.uint8)  # what follows the last row shares nothing with it
        self.rows.ravel()[: len(lcp)] = lcp
        self.least = self.rows.min(axis=1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.rows[i >> 6, i & 63]

    def reach(self, i: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
        """The nearest row, from each i on (or back), that shares fewer than q words with the row before; q above 0."""
        spots = np.arange(64)
        block = i >> 6
        near = (self.rows[block] < q[:, None]) & (spots <= (i & 63)[:, None] if back else spots >= (i & 63)[:, None])
        far = np.flatnonzero(~near.any(axis=1))
        while len(far):
            block[far] += -1 if back else 1
            far = far[self.least[block[far]] >= q[far]]
        moved = np.flatnonzero(block != i >> 6)
        near[moved] = self.rows[block[moved]] < q[moved, None]
        return block * 64 + (63 - near[:, ::-1].argmax(axis=1) if back else near.argmax(axis=1))


class FmIndex:
    """Index over texts in word numbers from 1 on, for matches of up to `width` words.

    Suffixes are sorted whole, so that a window which stands in one row only finds its owner by walking back to a
    sampled place; what rows share is kept up to `width` words.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, width: int):
        """words: all texts, each followed by a 0. starts: where each begins. owners: a number for each."""
        n = len(words)
        rank, depth, kept, more = words.astype(np.int64), 1, {}, True
        while more or depth < width:  # a step that tells no more places apart is the last that could
            if max(kept, default=0) < width:
                kept[depth] = rank
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = rank[depth:] + 1
            finer = np.unique(rank * np.int64(n + 2) + np.where(rank_ends(words, depth), 0, ahead), return_inverse=True)[1]
            more, rank, depth = finer.max(initial=0) > rank.max(initial=0), finer, 2 * depth
        if max(kept, default=0) < width:
            kept[depth] = rank
        order = np.argsort(rank, kind="stable")
        lcp = np.zeros(n, np.int64)
        for d in sorted(kept, reverse=True):  # words shared with the row before, largest steps first
            a, b = np.minimum(order[1:] + lcp[1:], n - 1), np.minimum(order[:-1] + lcp[1:], n - 1)
            lcp[1:] += np.where((lcp[1:] < width) & (kept[d][a] == kept[d][b]), d, 0)
        del kept, rank
        self.width, self.size = width, n
        self.shared = Shared(np.minimum(lcp, width))
        top = int(words.max(initial=0))
        self.bwt = Wavelet(np.where(order > 0, words[order - 1], 0), top)
        self.first = np.r_[0, np.cumsum(np.bincount(words, minlength=top + 1))]
        place = order - starts[np.searchsorted(starts, order, "right") - 1]
        sampled = place % SAMPLE == 0
        self.sampled, self.text = BitRank(sampled), (np.searchsorted(starts, order[sampled], "right") - 1).astype(np.int32)
        self.owners = owners
        begin = np.flatnonzero(lcp < width)
        several = np.diff(np.r_[begin, n]) > 1
        mark = np.zeros(n, bool)
        mark[begin[several]] = True
        least = np.minimum.reduceat(owners[np.searchsorted(starts, order, "right") - 1], begin) if n else owners
        self.several, self.least = BitRank(mark), least[several]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with c followed by what rows lo to hi start with."""
        a, b = self.bwt.rank(c, lo, hi)
        return self.first[c] + a, self.first[c] + b

    def owner(self, row: np.ndarray) -> np.ndarray:
        """The owner of each row's text: back word by word to a sampled row, at the latest the text's first."""
        row, out, open_ = row.copy(), np.zeros(len(row), self.owners.dtype), np.arange(len(row))
        while len(open_):
            at = row[open_]
            before = self.sampled.ones(at)
            found = self.sampled.ones(at + 1) > before
            out[open_[found]] = self.owners[self.text[before[found]]]
            open_ = open_[~found]
            c, k = self.bwt.access(row[open_])
            row[open_] = self.first[c] + k
        return out

    def stream(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts, each followed by a 0, in the index's numbers (others: below 0), to their matching statistics: for each word
        how many words from there on, `width` at most, the index holds in one place, and where these are `width` the
        least owner, else -1. All texts are gone through from the right at once.
        """
        ends = np.r_[starts[1:], len(words)] - 1
        size = ends - starts
        length, least = np.zeros(len(words), np.uint8), np.full(len(words), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        ends, size = ends[order], size[order]
        lo, hi, have = np.zeros(len(size), np.int64), np.full(len(size), self.size, np.int64), np.zeros(len(size), np.int64)
        alone = []
        for t in range(1, int(size.max(initial=0)) + 1):
            live = int(np.searchsorted(-size, -t, "right"))
            at = ends[:live] - t
            c = words[at].astype(np.int64)
            lo[:live][c < 0], hi[:live][c < 0], have[:live][c < 0] = 0, self.size, 0
            open_ = np.flatnonzero(c > 0)
            while len(open_):
                a, b = self.step(c[open_], lo[open_], hi[open_])
                fits = a < b
                done = open_[fits]
                lo[done], hi[done] = a[fits], b[fits]
                have[done] += 1
                open_ = open_[~fits]
                if len(open_):  # shorten the match to what more rows begin with
                    q = np.maximum(self.shared[lo[open_]], self.shared[hi[open_]]).astype(np.int64)
                    self.widen(lo, hi, have, open_, q)
            over = np.flatnonzero(have[:live] > self.width)
            if len(over):
                self.widen(lo, hi, have, over, np.full(len(over), self.width))
            length[at] = have[:live]
            whole = np.flatnonzero(have[:live] == self.width)
            one = hi[whole] - lo[whole] == 1
            alone.append(np.stack([at[whole[one]], lo[whole[one]]]))
            least[at[whole[~one]]] = self.least[self.several.ones(lo[whole[~one]])]
        if alone:
            at, row = np.concatenate(alone, axis=1)
            least[at] = self.owner(row)
        return length, least

    def widen(self, lo: np.ndarray, hi: np.ndarray, have: np.ndarray, which: np.ndarray, q: np.ndarray) -> None:
        """Cuts matches to their first q words."""
        have[which] = q
        none = which[q == 0]
        lo[none], hi[none] = 0, self.size
        some, q = which[q > 0], q[q > 0]
        if len(some):
            lo[some], hi[some] = self.shared.reach(lo[some], q, True), self.shared.reach(hi[some], q, False)


def rank_ends(words: np.ndarray, depth: int) -> np.ndarray:
    """Whether a text ends within the `depth` words from each place: what follows is then another text and doesn't count."""
    zeros = np.cumsum(words == 0)
    before = np.r_[0, zeros[:-1]]
    return zeros[np.minimum(np.arange(len(words)) + depth - 1, len(words) - 1)] > before


def search_shard(width: int):
    """A shard's passages (seg, words, doc, indexed, streamed) to runs of windows with the smallest doc_id that holds them."""

    def run(t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}

        def numbers(which: str, of) -> tuple[np.ndarray, np.ndarray, pa.Table]:
            rows, flat, starts = t.filter(t.column(which)), [], []
            for w in rows.column("words"):
                starts.append(len(flat))
                flat.extend(map(of, w.as_buffer().to_pybytes().split()))
                flat.append(0)
            return np.array(flat, np.int32), np.array(starts, np.int64), rows

        words, begin, held = numbers("indexed", lambda x: number.setdefault(x, len(number) + 1))
        if not len(words):
            return pa.table({"seg": pa.array([], pa.binary()), "off": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "least": pa.array([], pa.int64())})
        index = FmIndex(words, begin, held.column("doc").to_numpy(), width)
        words, begin, asked = numbers("streamed", lambda x: number.get(x, -1))
        number.clear()
        least = index.stream(words, begin)[1]
        at = np.flatnonzero(least >= 0)
        of = np.searchsorted(begin, at, "right") - 1
        new = np.r_[True, (np.diff(at) != 1) | (np.diff(of) != 0) | (np.diff(least[at]) != 0)] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return pa.table({"seg": asked.column("seg").combine_chunks().take(pa.array(of[first])), "off": pa.array((at[first] - begin[of[first]]).astype(np.int32)), "n": pa.array(np.diff(np.r_[first, len(at)]).astype(np.int32)), "least": pa.array(least[at[first]])})

    return run


# --- the job -------------------------------------------------------------------------------------


def remove(width: int):
    """doc_id, part, text and repeated runs (start, windows) to what is left."""
    import hashlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 2):
            gone, shas, texts = [], [], []
            for t, runs in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                words = t.as_buffer().to_pybytes().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["s"]] += 1
                    edge[r["s"] + r["n"] + width - 1] -= 1
                stays = np.cumsum(edge)[:-1] <= 0
                kept = b" ".join([words[i] for i in np.flatnonzero(stays)])
                gone.append(int(len(words) - stays.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "part", "n_removed", "kept_sha256", "kept"])

    return rows


def shard_runs(parts: DataFrame, width: int) -> DataFrame:
    """parts: seg, doc, words, indexed, streamed, shard. Returns seg, off, n, least: runs of n windows from word off of a segment on."""
    return parts.groupBy("shard").applyInArrow(search_shard(width), "seg binary, off int, n int, least long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, run: int = RUN, shard_words: int = SHARD_WORDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(outcome, changed). outcome: doc_id, part, n_words, n_removed, kept_sha256 for every row. changed: doc_id, part,
    kept (the text that is left) for documents that lose some of their words but hold the first copy of their text."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    scanned = table(docs.mapInArrow(scan(width, run), "doc_id long, n_words long, text_hash binary, whole_sha256 string, segments array<struct<h:long,s:int,m:int>>"))
    firsts = table(scanned.groupBy("text_hash").agg(F.min("doc_id").alias("holder"), F.min(F.struct("doc_id", "segments"))["segments"].alias("segments")))
    part = F.col("text_hash").alias("part")  # tells texts apart whose rows have the same doc_id; as text_key()
    places = firsts.select(F.col("holder").alias("doc_id"), part, F.explode("segments").alias("x")).select("doc_id", "part", "x.h", "x.s", "x.m")
    shared = table(places.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b"))
    asked = places.join(shared, "h", "left_semi").groupBy("doc_id", "part").agg(F.collect_list(F.struct("h", "s", "m")).alias("segments"))
    texts = docs.withColumn("part", text_key())
    segments = table(
        texts.join(asked, ["doc_id", "part"]).select("doc_id", "part", "text", "segments").mapInArrow(cut(width), "doc_id long, h long, s int, m int, part binary, words string")
        .withColumn("seg", text_key("words"))
    )
    single = segments.groupBy("seg", "h").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.first("words").alias("words"), F.first("m").alias("m"))
    # only what a later document may ask for is indexed, only what an earlier one may hold is streamed
    single = table(single.join(shared, "h").select("seg", "h", "doc", "last", "words", "m", (F.col("doc") < F.col("b")).alias("indexed"), (F.col("last") > F.col("a")).alias("streamed")))
    weight = single.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m") + width).alias("w"))
    total, most = weight.agg(F.sum("w"), F.max("n")).first()
    shards = F.lit(max(1, -(-(total or 0) // shard_words)))
    cols = ["seg", "doc", "words", "indexed", "streamed"]
    if (most or 0) <= hot:
        runs = shard_runs(single.select(*cols, F.pmod(F.xxhash64("h"), shards).alias("shard")), width)
    else:
        heavy = table(weight.where(F.col("n") > hot).select("h"))
        rest = single.join(heavy, "h", "left_anti").select(*cols, F.pmod(F.xxhash64("h"), shards).alias("shard"))
        split = F.split("words", " ")
        windows = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.array_join(F.slice(split, i + 1, width), " "))
        pieces = table(single.join(heavy, "h", "left_semi").select("seg", "doc", "last", F.posexplode(windows).alias("skip", "words")).withColumn("window", text_key("words")))
        folded = pieces.groupBy("window").agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.first("words").alias("words")).where("doc < last")
        found = shard_runs(folded.select(F.col("window").alias("seg"), "doc", "words", F.lit(True).alias("indexed"), F.lit(True).alias("streamed"), F.pmod(F.xxhash64("window"), shards).alias("shard")), width)
        back = pieces.select("seg", "skip", "window").join(table(found.select(F.col("seg").alias("window"), "least")), "window")
        runs = shard_runs(rest, width).unionByName(back.select("seg", F.col("skip").alias("off"), F.lit(1).alias("n"), "least"))
    runs = table(runs.groupBy("seg").agg(F.collect_list(F.struct("off", "n", "least")).alias("runs")))
    met = segments.select("doc_id", "part", "s", "seg").join(runs, "seg").select("doc_id", "part", "s", F.explode("runs").alias("r")).where(F.col("r.least") < F.col("doc_id"))
    hit = table(met.groupBy("doc_id", "part").agg(F.collect_list(F.struct((F.col("s") + F.col("r.off")).alias("s"), F.col("r.n").alias("n"))).alias("runs")))
    touched = texts.join(hit, ["doc_id", "part"]).select("doc_id", "part", "text", "runs")
    touched = table(touched.mapInArrow(remove(width), "doc_id long, part binary, n_removed long, kept_sha256 string, kept string").distinct())
    known = scanned.select("doc_id", part, "n_words", "text_hash", "whole_sha256").join(firsts.select("text_hash", "holder"), "text_hash")
    copy = (F.col("doc_id") > F.col("holder")) & (F.col("n_words") >= width)
    own = F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id")
    outcome = known.join(touched.drop("kept"), ["doc_id", "part"], "left").select(
        own, "part", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
    return outcome, touched.select(own, "part", "kept")


def apply_removal(docs: DataFrame, outcome: DataFrame, changed: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go."""
    key = lambda c: F.struct(F.coalesce(c("doc_id").cast("long"), F.lit(LAST)).alias("id"), c("part").alias("part"))
    emptied = outcome.where("n_removed > 0 and n_removed = n_words").select(key(F.col).alias("_key"), F.lit(None).cast("string").alias("kept")).distinct()
    fate = changed.select(key(F.col).alias("_key"), "kept").unionByName(emptied).groupBy("_key").agg(F.count("kept").alias("n"), F.max("kept").alias("kept"), F.count_if(F.col("kept").isNull()).alias("gone"))
    fate = fate.select("_key", F.struct("kept", (F.col("gone") > 0).alias("gone")).alias("_fate"))
    row = F.struct(*docs.columns).alias("_row")
    rows = docs.select(row, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text_key().alias("part")).alias("_key"))
    left = rows.join(fate, "_key", "left").where(~F.coalesce("_fate.gone", F.lit(False)))
    new = F.coalesce("_fate.kept", "_row.text")
    made = {"text": new, "n_chars": F.length(new).cast("long")}
    return left.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
