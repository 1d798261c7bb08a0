"""Scoring by a hidden Markov language model.

Tokens are words with A-Z in lower case and one end mark per document. A hidden state moves from token to
token and emits the token's class; the class then emits the word by its add-one count within the class. A word
that makes up at least one in SHARE training tokens is a class of its own, so there are at most SHARE of these;
other words fall into ENDINGS classes by their last bytes. So the model is normalised over all words, one unknown
word per class included, what is fitted by Baum-Welch has a bounded size, and word counts stay in tables.

1. Each block of documents numbers its words: the numbers of its documents' tokens, and a lexicon with
   training counts, are written once.
2. Counts are summed by word, map-side first. They return to the lexicons by a join on the word, in which a word
   has a row per block at most, a two-millionth of the tokens, however frequent it is.
3. Each block meets its counts and writes its documents as class numbers, with their sums of log counts. Training
   documents are dealt to FOLDS folds, each in files of its own, so that a task of one fold still holds many documents
   side by side.
4. Baum-Welch, incremental: every task runs the scaled forward-backward recursion over its training documents of
   one fold and emits expected counts, which are summed over tasks and replace that fold's former counts; then the
   model is fitted to the counts of all folds. A pass goes through all folds, so through all training documents.
   Passes end when one raises the log-likelihood by less than GAIN of it.
5. Scaled forward recursion over whole documents.

Defined results: null or blank text is an end mark alone; without training documents every count is 0 and
the start model scores; rows, repeated or not, are scored one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, table

STATES, SHARE, ENDINGS, ENDING, FOLDS, SEED = 4, 4096, 255, 2, 8, 7
#: A pass that gains less ends the fit; PASSES would end it too, but no fit seen so far came near.
GAIN, PASSES = 1e-3, 50
#: Words after which a block ends, and tokens that a recursion holds at a time.
BLOCK_WORDS, STEP_TOKENS = 4_000_000, 250_000
#: Rows that leave a block at a time.
SLICE_DOCS, SLICE_WORDS = 500, 50_000


def class_of(word: bytes) -> int:
    """0 for the end mark, else a number for the word's last bytes; frequent words get numbers beyond these."""
    return 1 + crc32(word[-ENDING:]) % ENDINGS if word else 0


def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, held_out to rows of documents (ids) and of the block's lexicon (word, ending's class, index, n)."""
    part, block = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    docs: list[tuple] = []
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seen, size, block
        n = np.zeros(len(seen), np.int64)
        for _, held, ids in docs:
            if not held:
                np.add.at(n, ids, 1)
        key = (part << 32) | block
        names = ["block", "doc_id", "held_out", "ids", "word", "cls", "idx", "n"]
        null = lambda n, *types: [pa.nulls(n, t) for t in types]
        for i in range(0, len(docs), SLICE_DOCS):
            some = docs[i : i + SLICE_DOCS]
            d = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([key] * d, pa.int64()), pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.bool_()), pa.array([x[2].tobytes() for x in some], pa.binary()), *null(d, pa.binary(), pa.int32(), pa.int32(), pa.int64())], names)
        words = list(seen)
        for i in range(0, len(words), SLICE_WORDS):
            some = words[i : i + SLICE_WORDS]
            w, at = len(some), slice(i, i + SLICE_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, key)), *null(w, pa.int64(), pa.bool_(), pa.binary()), pa.array(some, pa.binary()), pa.array(np.fromiter(map(class_of, some), np.int32, w)), pa.array(np.arange(i, i + w, dtype=np.int32)), pa.array(n[at])], names)
        docs.clear()
        seen = defaultdict()
        seen.default_factory = seen.__len__
        size, block = 0, block + 1

    for b in batches:
        for d, t, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            words = t.as_buffer().to_pybytes().lower().split() if t.is_valid else []
            words.append(b"")
            docs.append((d, held, np.fromiter(map(seen.__getitem__, words), np.int32, len(words))))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield from flush()
    if docs:
        yield from flush()


class Hmm:
    """start (K), move (K, K), emit (K, C): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """Shares of the classes, disturbed from a seed to tell the states apart; states tend to stay."""
        noise = np.random.default_rng(seed).gamma(2.0, 0.5, (states, len(shares)))
        emit = shares[None, :] * noise
        move = np.full((states, states), 0.2 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.8)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def fitted(cls, counts: dict[str, np.ndarray], shares: np.ndarray) -> Hmm:
        """From expected counts; each row is smoothed by one count in all, dealt evenly or by the classes' shares."""
        even = lambda a: (a + 1 / a.shape[-1]) / (a.sum(-1, keepdims=True) + 1)
        return cls(even(counts["start"]), even(counts["move"]), (counts["emit"] + shares) / (counts["emit"].sum(1, keepdims=True) + 1))


class Steps:
    """Documents side by side, longest first; tokens of one place in their documents lie together."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # documents with a token at each place
        self.begin = np.r_[0, np.cumsum(self.live)]
        flat = np.concatenate([sequences[i] for i in self.order])
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.cls = np.empty(len(flat), np.int64)
        self.cls[self.begin[place] + doc] = flat


def forward(hmm: Hmm, steps: Steps, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Natural log-likelihood of each document in the order of `steps`; scaled alphas, scales and emissions for the way back."""
    emit = hmm.emit.T[steps.cls]
    alpha = np.empty_like(emit) if keep else None
    scale = np.empty(len(emit))
    now = None
    for t, n in enumerate(steps.live):
        at = slice(steps.begin[t], steps.begin[t + 1])
        now = emit[at] * (hmm.start if t == 0 else now[:n] @ hmm.move)
        s = now.sum(1)
        now /= s[:, None]
        scale[at] = s
        if keep:
            alpha[at] = now
    logs, total = np.log(scale), np.zeros(steps.live[0])
    for t, n in enumerate(steps.live):
        total[:n] += logs[steps.begin[t] : steps.begin[t + 1]]
    return total, alpha, scale, emit


def expected(hmm: Hmm, steps: Steps) -> dict[str, np.ndarray]:
    """Expected counts of one forward-backward pass."""
    total, alpha, scale, emit = forward(hmm, steps, keep=True)
    beta = np.empty_like(alpha)
    crossed = np.zeros_like(hmm.move)
    last = len(steps.live) - 1
    for t in range(last, -1, -1):
        at = slice(steps.begin[t], steps.begin[t + 1])
        beta[at] = 1.0
        if t < last:
            n = steps.live[t + 1]
            after = slice(steps.begin[t + 1], steps.begin[t + 1] + n)
            weighed = emit[after] * beta[after] / scale[after][:, None]
            beta[steps.begin[t] : steps.begin[t] + n] = weighed @ hmm.move.T
            crossed += alpha[steps.begin[t] : steps.begin[t] + n].T @ weighed
    gamma = alpha * beta
    k, c = hmm.emit.shape
    return {"start": gamma[: steps.live[0]].sum(0), "move": crossed * hmm.move, "emit": np.stack([np.bincount(steps.cls, weights=gamma[:, i], minlength=c) for i in range(k)]), "log": np.array([total.sum()])}


def pieces(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], Steps]]:
    """Whole documents of like length, STEP_TOKENS at a time or a single longer one."""
    held, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
        held.append(i)
        size += len(sequences[i])
        if size >= STEP_TOKENS:
            yield held, Steps([sequences[j] for j in held])
            held, size = [], 0
    if held:
        yield held, Steps([sequences[j] for j in held])


def count_expected(hmm: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(0)]
            for _, steps in pieces(seqs):
                for k, v in expected(hmm, steps).items():
                    sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * v.size), pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel())], ["what", "at", "n"])

    return run


def fold_counts(hmm: Hmm, sequences: DataFrame) -> dict[str, np.ndarray] | None:
    """Expected counts, summed over tasks, of sequences of classes (binary of 16-bit numbers); None if there are none."""
    found = sequences.mapInArrow(count_expected(hmm), "what string, at int, n double").groupBy("what", "at").agg(F.sum("n").alias("n")).toPandas()  # a row per parameter
    if found.empty:
        return None
    shapes = {"start": hmm.start.shape, "move": hmm.move.shape, "emit": hmm.emit.shape, "log": (1,)}
    got = {k: np.zeros(int(np.prod(s))) for k, s in shapes.items()}
    for k, part in found.groupby("what"):
        got[k][part["at"].to_numpy()] = part["n"].to_numpy()
    return {k: v.reshape(shapes[k]) for k, v in got.items()}


def fit(coded: DataFrame, shares: np.ndarray, states: int = STATES, passes: int = PASSES, gain: float = GAIN) -> tuple[Hmm, list[float]]:
    """coded: fold and classes. Also the log-likelihood that each pass met."""
    hmm, logs, counts = Hmm.begin(shares, states), [], {}
    for _ in range(passes):
        total = 0.0
        for fold in range(FOLDS):
            got = fold_counts(hmm, coded.where(F.col("fold") == fold).select("classes"))
            if got is not None:
                total += float(got.pop("log")[0])
                counts[fold] = got
                hmm = Hmm.fitted({k: sum(c[k] for c in counts.values()) for k in got}, shares)
        logs.append(total)
        if not counts or len(logs) > 1 and logs[-1] - logs[-2] < gain * abs(logs[-2]):
            break
    return hmm, logs


@dataclass
class Vocabulary:
    """frequent: words that are classes of their own. tokens, types: training tokens and different words of each class."""

    frequent: list[bytes]
    tokens: np.ndarray
    types: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        return (self.tokens + 1) / (self.tokens + 1).sum()


def vocabulary(totals: DataFrame) -> Vocabulary:
    """totals: word, cls (of its ending), c."""
    n = totals.agg(F.sum("c")).first()[0] or 0
    often = totals.where((F.col("c") * SHARE >= n) & (F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c", "cls").orderBy("word").collect()  # SHARE rows at most
    tokens, types = (np.zeros(1 + ENDINGS + len(often)) for _ in range(2))
    for r in totals.where("c > 0").groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row per ending
        tokens[r.cls], types[r.cls] = r.n, r.v
    for i, r in enumerate(often, 1 + ENDINGS):
        tokens[r.cls], types[r.cls] = tokens[r.cls] - r.c, types[r.cls] - 1
        tokens[i], types[i] = r.c, 1
    return Vocabulary([bytes(r.word) for r in often], tokens, types)


READY = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary, fold int"


def classify(base: float, within: np.ndarray):
    """A block's documents and lexicon (idx, cls, c) to rows of READY. base: log10 of the unigram denominator. within: log10 of
    each class's denominator. Documents that don't teach are in fold FOLDS."""

    def run(docs: pa.Table, lexicon: pa.Table) -> pa.Table:
        known, cls = np.zeros(lexicon.num_rows, np.int64), np.zeros(lexicon.num_rows, np.int64)
        at = lexicon.column("idx").to_numpy()
        known[at], cls[at] = lexicon.column("c").to_numpy(), lexicon.column("cls").to_numpy()
        logs = np.log10(known + 1.0)
        inside, small = within[cls], cls.astype(np.uint16)
        rows = {c: [] for c in ("n_tokens", "n_known", "base_score", "within", "classes", "fold")}
        for d, held, x in zip(docs.column("doc_id").to_pylist(), docs.column("held_out").to_pylist(), docs.column("ids"), strict=True):
            ids = np.frombuffer(x.as_buffer(), np.int32)
            words = float(logs[ids].sum())
            rows["n_tokens"].append(len(ids))
            rows["n_known"].append(int(np.count_nonzero(known[ids])))
            rows["base_score"].append(words - len(ids) * base)
            rows["within"].append(words - float(inside[ids].sum()))
            rows["classes"].append(small[ids].tobytes())
            rows["fold"].append(FOLDS if held else crc32(str(d).encode()) % FOLDS)
        types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "within": pa.float64(), "classes": pa.binary(), "fold": pa.int32()}
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **{k: pa.array(v, types[k]) for k, v in rows.items()}})

    return run


def code(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Vocabulary]:
    """(documents as classes with their sums of log counts, see READY; the vocabulary's figures)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    numbered = table(rows.mapInArrow(number_words, "block long, doc_id long, held_out boolean, ids binary, word binary, cls int, idx int, n long"), compression="zstd")
    lexicon = numbered.where("word is not null")
    totals = table(lexicon.groupBy("word", "cls").agg(F.sum("n").alias("c")), compression="zstd")
    words = vocabulary(totals)
    spark = docs.sparkSession
    frequent = spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(words.frequent, 1 + ENDINGS)], "word binary, own int")
    counts = totals.join(F.broadcast(frequent), "word", "left").select("word", F.coalesce("own", "cls").alias("cls"), "c")
    met = lexicon.select(F.col("block").alias("of"), "word", "idx").join(counts, "word").select("of", "idx", "cls", "c")
    ready = classify(float(np.log10(words.tokens.sum() + words.types.sum() + 1)), np.log10(words.tokens + words.types + 1))
    coded = table(numbered.where("ids is not null").select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(ready, READY), compression="zstd", by="fold")
    discard(numbered)
    discard(totals)
    return coded, words


def scored(coded: DataFrame, hmm: Hmm) -> DataFrame:
    """READY rows to doc_id, held_out, n_tokens, n_known, base_score, score."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(6)]
            hidden = np.zeros(len(seqs))
            for held, steps in pieces(seqs):
                hidden[np.array(held)[steps.order]] = forward(hmm, steps)[0]
            score = hidden / np.log(10) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(score)], names)

    return coded.select(*names[:5], "within", "classes").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: rows that are only scored."""
    coded, words = code(docs, held_out, doc_id, text)
    hmm, _ = fit(coded, words.shares, states, passes, gain)
    found = scored(coded, hmm)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(words.tokens.sum())).cast("long").alias("train_tokens"), "base_score", "score")
