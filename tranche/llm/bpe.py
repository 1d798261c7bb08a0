"""Byte-level BPE by speculation and verification.

Each distinct word is first cut greedily into the longest tokens. A token sequence is what BPE
gives if every token is what BPE makes of its own bytes and every adjacent pair is left alone when
both are encoded together; both tests run over all pairs of a batch at once. Only words that fail
are merged exactly, rule by rule, all of a batch in lockstep.

Defined results: a null text counts as empty and has no ids. Ids unknown to the vocabulary decode to
nothing; bytes that are not UTF-8 decode to U+FFFD, as a lossy decoder does. Rows, repeated or not,
are encoded one by one; other columns pass through (a column named as the result is replaced).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import in_slices

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE. Letters and numbers are tried first here; no
#: two alternatives but the last two can start at one place and differ in what they take, so the order doesn't show.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps: once half of them are new, those not met since go. Results don't depend on it.
CACHE_WORDS = 300_000
#: Slots for tested pairs, as a power of two.
PAIR_BITS = 20
#: Stands between words; no byte of a token.
SEPARATOR = "\u0100"
FAR = np.int64(1) << 40
#: Words are merged side by side, in tables of these widths and so many cells at most; longer ones through a heap.
WIDTHS = (8, 16, 32, 64)
CELLS = 1 << 17


def printable_bytes() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def slots(code: np.ndarray, bits: int) -> np.ndarray:
    """A slot for each code in a table of 2 ** bits: the leading bits of a multiplicative hash."""
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Vocabulary:
    """What decoding needs: the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = printable_bytes()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.prepare(vocab, [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]])

    def prepare(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        pass

    def decode(self, ids: list[int]) -> str:
        known = len(self.bytes_of)
        try:
            joined = b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):
            joined = b"".join(self.bytes_of[i] for i in ids if i is not None and 0 <= i < known)
        return joined.decode("utf-8", "replace")


class Bpe(Vocabulary):
    def prepare(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        size, added = len(self.bytes_of), self.added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made_by: list[int] = []
        for r, (x, y) in enumerate(merges):
            a, b = vocab[x], vocab[y]
            made = vocab[x + y]
            self.made_by.append(made)
            self.rank_of.setdefault((a, b), r)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, r
        self.byte_ids = [vocab[bytes([c])] for c in range(256)]
        self.first, self.makes = np.array(self.byte_ids, np.int64), np.array([*self.made_by, 0], np.int64)
        self.none, self.base = np.int64(size), np.int64(size + 1)  # `none` stands where there is no token
        self.hold()
        self.matcher = ahocorasick.Automaton()
        for b, t in vocab.items():
            self.matcher.add_word(b.decode("latin-1"), t)
        self.matcher.add_word(SEPARATOR, -1)
        self.matcher.make_automaton()
        self.tested = np.full(1 << PAIR_BITS, -2, np.int64)  # a pair's code and whether it fits in the last bit
        made = np.flatnonzero(self.rank >= 0)
        self.own = np.ones(size, bool)  # tokens that BPE makes of their own bytes
        self.own[made] = self.apart(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            self.own[t] &= self.own[self.left[t]] and self.own[self.right[t]]
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}

    def hold(self) -> None:
        """Lays the rules out by their pairs: each in the first free slot from the one that its code points to."""
        pairs = np.array(list(self.rank_of), np.int64).reshape(-1, 2)
        codes, ranks = pairs[:, 0] * self.base + pairs[:, 1], np.array(list(self.rank_of.values()), np.int64)
        self.rule_bits = max(4, 2 + len(codes).bit_length())
        self.codes, self.ranks = np.full(1 << self.rule_bits, -1, np.int64), np.full(1 << self.rule_bits, FAR)
        slot = slots(codes, self.rule_bits)
        while len(codes):
            free = np.flatnonzero(self.codes[slot] < 0)
            mine = free[np.unique(slot[free], return_index=True)[1]]
            self.codes[slot[mine]], self.ranks[slot[mine]] = codes[mine], ranks[mine]
            left = np.ones(len(codes), bool)
            left[mine] = False
            codes, ranks, slot = codes[left], ranks[left], (slot[left] + 1) & ((1 << self.rule_bits) - 1)

    def rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the rule that merges each pair (a, b), FAR where there is none."""
        code = a * self.base + b
        slot = slots(code, self.rule_bits)
        held = self.codes[slot]
        rank = np.where(held == code, self.ranks[slot], FAR)
        on = np.flatnonzero((held != code) & (held >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.rule_bits) - 1)
            held = self.codes[slot[on]]
            same = held == code[on]
            rank[on[same]] = self.ranks[slot[on[same]]]
            on = on[~same & (held >= 0)]
        return rank

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair (a, b), before the rule `until` where given.

        Undoes the later of the two outermost merges again and again; the two tokens that then touch
        existed side by side until the rules just undone, so a rule for them of lower rank would have
        crossed. Of equal rules the left place merges first.
        """
        good = np.ones(len(a), bool)
        a, b, at = a.copy(), b.copy(), np.arange(len(a))
        before_a = np.full(len(a), FAR) if until is None else until.copy()
        before_b = before_a - 1 if until is not None else before_a.copy()
        while len(at):
            rank = self.rule(a, b)
            bad = (rank < before_a) & (rank <= before_b) & (rank < FAR)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, at, ra, rb, before_a, before_b = (x[keep] for x in (a, b, at, ra, rb, before_a, before_b))
            undo_a = ra > rb
            before_a, before_b = np.where(undo_a, ra, before_a), np.where(undo_a, before_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rule first, leftmost of equals."""
        return np.frombuffer(self.merge_all([word])[0], np.int32).tolist()

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The same for many words; ids as 32-bit numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = [b""] * len(words)
        for least, width in zip((0, *WIDTHS), WIDTHS):
            at = np.flatnonzero((sizes > least) & (sizes <= width))
            for begin in range(0, len(at), CELLS // width):
                part = at[begin : begin + CELLS // width]
                for i, ids in zip(part.tolist(), self.merge_beside([words[i] for i in part.tolist()], sizes[part], width)):
                    found[i] = ids
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            found[i] = np.array(self.merge_long(words[i]), np.int32).tobytes()
        return found

    def merge_beside(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """A column a word, a row a byte, and one more row for the places beside a word's ends. In each step every
        word takes its own lowest rule, so the steps are as many as the most merges of a word. A pair's key is its
        rank and then its row; it stands where the pair begins."""
        n, far = len(words), np.int64(FAR * WIDTHS[-1])
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        col = np.repeat(np.arange(n), sizes)
        ids = np.full((width + 1, n), self.none)
        ids[row, col] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.full((width + 1, n), width), np.full((width + 1, n), width)
        row, col = row[row > 0], col[row > 0]  # of the second byte of each pair
        after[row - 1, col], before[row, col] = row, row - 1
        keys = np.full((width + 1, n), far)
        keyed = lambda a, b, at: np.where((rank := self.rule(a, b)) < FAR, rank * WIDTHS[-1] + at, far)
        keys[row - 1, col] = keyed(ids[row - 1, col], ids[row, col], row - 1)
        place = np.arange(n)  # the word of each column of keys
        while len(place):
            best = keys.min(axis=0)
            here = np.flatnonzero(best < far)
            if 2 * len(here) < len(place):
                keys, place, best, here = keys[:, here], place[here], best[here], np.arange(len(here))
            if not len(here):
                break
            rank, i = np.divmod(best[here], WIDTHS[-1])
            col = place[here]
            j = after[i, col]
            h, k = before[i, col], after[j, col]
            made = self.makes[rank]
            ids[i, col], ids[j, col] = made, self.none
            after[i, col], before[k, col] = k, i
            keys[j, here] = far
            keys[i, here] = keyed(made, ids[k, col], i)
            keys[h, here] = keyed(ids[h, col], made, h)
        left = ids.T != self.none
        ends, flat = 4 * np.cumsum(left.sum(axis=1)), ids.T[left].astype(np.int32).tobytes()
        return [flat[b:e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging through a heap over a linked list, for words of any length."""
        ids = [self.byte_ids[c] for c in word]
        n, rank_of, made_by = len(ids), self.rank_of, self.made_by
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made_by[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """apart() through a table of pairs tested before, a pair to a slot; a later pair takes its slot over."""
        code = a * self.base + b
        slot = slots(code, PAIR_BITS)
        new = self.tested[slot] >> 1 != code
        good = (self.tested[slot] & 1).astype(bool)
        if new.any():
            codes, back = np.unique(code[new], return_inverse=True)
            good[new] = self.apart(codes // self.base, codes % self.base)[back]
            self.tested[slot[new]] = code[new] << 1 | good[new]
        return good

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new words to the cache."""
        raw = [w.encode() for w in words]
        joined = SEPARATOR.join([r.decode("latin-1") for r in raw]) + SEPARATOR
        flat = np.array([t for _, t in self.matcher.iter_long(joined)], np.int64)
        ends = np.flatnonzero(flat < 0)
        of = np.searchsorted(ends, np.arange(len(flat)))
        bad = np.zeros(len(words), bool)
        bad[of[(flat >= 0) & ~self.own[flat]]] = True
        inside = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        bad[of[inside[~self.fits(flat[inside], flat[inside + 1])]]] = True
        guess, begin, cache = flat.astype(np.int32).tobytes(), 0, self.cache
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            cache[w] = guess[begin:end]
            begin = end + 4
        failed = np.flatnonzero(bad).tolist()
        for i, ids in zip(failed, self.merge_all([raw[i] for i in failed])):
            cache[words[i]] = ids

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.added):
            return self.words.findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.added else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS // 2:
            self.cache, self.older = {}, self.cache
        cut = [self.pieces(t) for t in texts]
        cache, older = self.cache, self.older
        new = []
        for w in set(chain.from_iterable(cut)).difference(cache):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                cache[w] = ids
        if new:
            self.learn(new)
            if self.added:
                cache |= {s: np.int32(i).tobytes() for s, i in self.added.items()}
        return [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in cut]

    def forget(self) -> None:
        """Drops the words met so far."""
        self.cache, self.older = {}, {}


_loaded: dict[tuple[type, str], Vocabulary] = {}


def loaded(path: str, kind: type = Bpe) -> Vocabulary:
    """The tokenizer of a worker, read once; for decoding alone a Vocabulary."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the token ids of a text column; path: a tokenizers JSON file present on every executor.

    This and decode() are passes over batches and not scalar functions: of those, one chained to the other, Spark
    would run the encoding twice.
    """
    rest = [c for c in df.columns if c != to]
    schema = StructType([*[df.schema[c] for c in rest], StructField(to, ArrayType(IntegerType()))])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in in_slices(batches, at):
            got = bpe.encode([t.as_py() or "" for t in b.column(at)])
            ends = np.cumsum([0, *map(len, got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*rest, to])
        bpe.forget()  # the worker may wait long for its next task

    return df.select(*rest).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that a column of token ids stands for; null ids decode to an empty text."""
    rest = [c for c in df.columns if c != to]
    schema = StructType([*[df.schema[c] for c in rest], StructField(to, StringType())])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, Vocabulary)
        for b in in_slices(batches, at):
            texts = (bpe.decode(r.values.to_numpy(zero_copy_only=False).tolist() if r.is_valid and not r.values.null_count else r.as_py() or []) for r in b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*rest, to])

    return df.select(*rest).mapInArrow(run, schema)
