"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. What a line looks like, and what the lines beside it look like, weighs for a
label, and labels of neighbouring lines weigh on each other. Forward-backward gives each line's
probability of being good. Weighted by length these add up to the share of a document that is good, and its
score is the chance that a document of that share is labelled good (a rising curve, fitted to the sample).

Only documents are labelled, so lines get weak labels. At first every line has its document's label. A model taught so sees no
label change, so it is also shown sequences that change: for each bad document, one of its lines between the lines of a
good one, all drawn by a seed; SPLICES such draws that together count as one. Then those lines of bad documents are bad that the chain itself, with all their neighbours,
finds likelier bad, and at least the worst of each, and the chain is fitted to these labels. That is done once: done again
and again, more and more lines of bad documents turn good, and plain lines between bad ones with them.

One weight decay holds for all weights: a line's own look, its neighbours' looks and label pairs. It is that of DECAYS
under which such sequences, made of documents of left-out folds, are likeliest. Fits end by their gradient.

The model is fitted on the driver to a bounded sample of labelled documents: at most TRAIN_DOCS, the least by a hash
of their id, and of each the middle TRAIN_LINES lines at most: 128 000 lines of 22 numbers, 23 MB. Spliced sequences
hold places of these lines, 920 000 at the very most (were all but one document bad); with what the chain finds for each, that is
some 150 bytes a place. Looks are computed by the executors, for the sample as for all; whole texts are scored.

Defined results: blank lines don't count; a text without lines, or null, scores the share of good
documents in the sample; without any labels that share is 1 and every document scores it; rows of
`labels` without id or quality are left out, of repeated ones the least quality counts; of different texts with one
labelled id the one of least looks teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents, of at most so many lines each, teach the model.
TRAIN_DOCS, TRAIN_LINES = 4000, 32
#: Weight decays to choose from, by so many folds of the sample.
DECAYS, FOLDS = (1e-2, 1e-3, 1e-4, 1e-5), 3
#: A fit ends where no part of its gradient (of the mean log-likelihood of a line) is larger.
FLAT = 1e-6
#: Draws of a changing sequence for each bad document.
SPLICES = 6
SEED = 11
#: Bytes of text that are looked at together.
STEP_BYTES = 1 << 20

KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"*#$%&@^~=+<>{}[]\\/_`", "bang": b"!", "bar": b"|", "stop": b".,;:?", "far": bytes(range(128, 256))}
SPACE = b" \t\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(KINDS.values(), 1):
    _KIND[list(_chars)] = _i
_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_power[0]) < n:
        for i, b in enumerate((_ODD, _BACK)):
            p = np.full(max(n, STEP_BYTES + 4096), b, np.uint64)
            p[0] = 1
            _power[i] = np.multiply.accumulate(p)
    return _power


def looks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line with words: number of its text, its bytes, and its look (a row of features)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begin = np.r_[0, ends[:-1] + 1]
    text_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.r_[True, gap].astype(np.int8)))
    first, stop = edge[::2], edge[1::2]  # the data end in a gap
    line = np.searchsorted(ends, first)
    words = np.bincount(line, minlength=len(ends))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    name = (total[stop] - total[first]) * down[first]
    name ^= name >> np.uint64(29)
    doc = np.searchsorted(text_end, first)
    _, where, back = np.unique((name * _ODD) ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True, return_inverse=True)
    before = where[back] < np.arange(len(name))
    again = np.r_[False, (name[1:] == name[:-1]) & (line[1:] == line[:-1])] if len(name) else np.zeros(0, bool)
    kind = _KIND[data]
    count = {}
    for i, k in enumerate(KINDS, 1):
        sums = np.r_[0, np.cumsum(kind == i, dtype=np.int32)]
        count[k] = (sums[ends] - sums[begin]).astype(float)
    per_line = lambda mask: np.bincount(line[mask], minlength=len(ends)).astype(float)
    tail = per_line(np.isin(kind[stop - 1], (4, 5, 6))) if len(stop) else np.zeros(len(ends))
    seen, twice = per_line(before), per_line(again)
    keep = words > 0
    size = (ends - begin)[keep].astype(float)
    w = words[keep].astype(float)
    c = {k: v[keep] for k, v in count.items()}
    last = np.zeros(len(ends), np.int64)
    last[line] = stop - 1
    start = np.zeros(len(ends), np.int64)
    start[line[::-1]] = first[::-1]
    share = lambda x, y: np.minimum(x / np.maximum(y, 1), 1)
    upper = share(c["upper"], c["upper"] + c["lower"])
    f = [upper, share(c["digit"], size), share(c["symbol"], w), share(c["bang"], w), share(c["bar"], w), share(c["stop"], w), share(c["far"], size), share(twice[keep], w), share(seen[keep], w), np.log1p(w) / 5, np.minimum(size / w / 10, 2), kind[last[keep]] == 7, kind[start[keep]] == 1, share(tail[keep], w)]
    f += [upper > 0.5, f[2] > 0.3, f[3] > 0.3, f[4] > 0.3, f[7] > 0.3, f[8] > 0.6, f[8] > 0.9, w <= 3]
    return np.searchsorted(text_end, begin[keep]), size, np.stack([np.asarray(x, np.float32) for x in f], 1)


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Look of a line, of the line before and after (zeros where there is none), and marks for first and last."""
    one = np.ones((len(x), 1), np.float32)
    same = (doc[1:] == doc[:-1])[:, None]
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    edge = np.r_[True, doc[1:] != doc[:-1]] if len(x) else np.zeros(0, bool)
    end = np.r_[doc[1:] != doc[:-1], True] if len(x) else np.zeros(0, bool)
    return np.concatenate([one, x, before, after, edge[:, None], end[:, None]], 1).astype(np.float64)


class Crf:
    """weight: of a feature for good over bad. move: (2, 2) of a label followed by a label; 1 is good. curve: slope and
    height of the log-odds of a document over its share of good lines."""

    def __init__(self, weight: np.ndarray, move: np.ndarray, prior: float, curve: tuple[float, float] = (4.0, -2.0)):
        self.weight, self.move, self.prior, self.curve = weight, move, prior, curve

    def marginals(self, doc: np.ndarray, x: np.ndarray, counts: np.ndarray | None = None):
        """Probability that each line is good, by scaled forward-backward over all documents at once.

        Given how often each line counts, also the expected label pairs and the log of the sum over all labellings. Lines of a
        document lie together and count alike.
        """
        return self.chain(doc, x @ self.weight, counts)

    def chain(self, doc: np.ndarray, z: np.ndarray, counts: np.ndarray | None = None):
        """marginals, from what each line weighs by itself for good over bad."""
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[begin, len(doc)])
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        z = np.clip(z, -30, 30)
        node = np.stack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))], 1)
        top = self.move.max()
        edge = np.exp(self.move - top)
        weigh = np.ones(len(doc)) if counts is None else counts
        log_sum = weigh @ np.logaddexp(0, z) + top * (weigh.sum() - weigh[begin].sum())
        alpha, beta = np.empty_like(node), np.ones_like(node)
        for t, n in enumerate(live):
            at = begin[:n] + t
            a = node[at] * (alpha[at - 1] @ edge if t else 1.0)
            scale = a.sum(1, keepdims=True)
            log_sum += np.log(scale[:, 0]) @ weigh[at]
            alpha[at] = a / scale
        pairs = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            m = node[at] * beta[at]
            b = m @ edge.T
            if counts is not None:
                joint = alpha[at - 1][:, :, None] * edge[None] * m[:, None, :]
                pairs += np.tensordot(weigh[at] / joint.sum((1, 2)), joint, 1)
            beta[at - 1] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p = p[:, 1] / p.sum(1)
        return p if counts is None else (p, pairs, log_sum)

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per line with words: number of its text, its bytes, and its probability of being good."""
        doc, size, x = looks(texts)
        return doc, size, self.marginals(doc, with_neighbours(doc, x)) if len(doc) else np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, size, p = self.lines(texts)
        out = np.full(len(texts), self.prior)
        some, share = shares(doc, size, p, len(texts))
        out[some] = 1 / (1 + np.exp(-(self.curve[0] * share + self.curve[1])))
        return np.clip(out, 0.0, 1.0)


def shares(doc: np.ndarray, size: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n documents have lines, and the shares of these, by length, that are good."""
    weight = np.bincount(doc, size, n)
    some = weight > 0
    return some, np.bincount(doc, p * size, n)[some] / weight[some]


def newton(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression (the first column is 1), with weight decay per row."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) / len(y) - decay * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def climb(value, w: np.ndarray, flat: float = FLAT, kept: int = 12) -> np.ndarray:
    """Where the concave function is highest. value: of weights to the height and its gradient. Limited-memory
    quasi-Newton steps, halved until they rise, until the gradient is flat or no step rises any more."""
    height, g = value(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(g).max() > flat:
        d, parts = g.copy(), []
        for s, y in reversed(steps):
            parts.append(s @ d / (s @ y))
            d -= parts[-1] * y
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(parts), strict=True):
            d += (a - y @ d / (s @ y)) * s
        size = 1.0
        while True:
            new_height, new_g = value(w + size * d)
            if new_height >= height + 1e-4 * size * (g @ d):
                break
            size /= 2
            if size < 1e-9:
                return w
        step, bend = size * d, g - new_g
        if step @ bend > 1e-14:
            steps = [*steps[1 - kept :], (step, bend)]
        w, height, g = w + step, new_height, new_g
    return w


class Sequences:
    """Looks and labels of lines, a sequence after the other: what a chain is fitted to. counts: how often each counts.
    Given at, a sequence's lines are those at these places of xs, counted through; however many show it, a look is kept once."""

    def __init__(self, xs: list[np.ndarray], ys: list[np.ndarray], counts: np.ndarray | None = None, at: list[np.ndarray] | None = None):
        at = places(xs) if at is None else at
        self.doc, self.at = np.repeat(np.arange(len(at)), [len(i) for i in at]), np.concatenate(at)
        self.looks, self.y = np.concatenate(xs).astype(np.float64), np.concatenate(ys)
        self.same = self.doc[1:] == self.doc[:-1]
        self.first, self.last = np.flatnonzero(np.r_[True, ~self.same]), np.flatnonzero(np.r_[~self.same, True])
        self.pairs = np.zeros((2, 2))
        self.counts = (np.ones(len(at)) if counts is None else counts)[self.doc]
        np.add.at(self.pairs, (self.y[:-1][self.same], self.y[1:][self.same]), self.counts[1:][self.same])
        self.true = self.sums(self.y * self.counts)

    @property
    def x(self) -> np.ndarray:
        """All that weighs, a row for each line; heights and sums do without it."""
        return with_neighbours(self.doc, self.looks[self.at])

    def heights(self, weight: np.ndarray) -> np.ndarray:
        """x @ weight."""
        own, before, after = weight[1:-2].reshape(3, -1) @ self.looks.T
        z = weight[0] + own[self.at]
        z[1:] += before[self.at[:-1]] * self.same
        z[:-1] += after[self.at[1:]] * self.same
        z[self.first] += weight[-2]
        z[self.last] += weight[-1]
        return z

    def sums(self, v: np.ndarray) -> np.ndarray:
        """x.T @ v."""
        n = len(self.looks)
        met = [np.bincount(self.at, v, n), np.bincount(self.at[:-1], v[1:] * self.same, n), np.bincount(self.at[1:], v[:-1] * self.same, n)]
        return np.r_[v.sum(), (np.stack(met) @ self.looks).ravel(), v[self.first].sum(), v[self.last].sum()]

    def likelihood(self, w: np.ndarray, decay: float = 0.0) -> tuple[float, np.ndarray]:
        """Mean log-likelihood of a line's label, less decay, and its gradient. w: weights, then label pairs."""
        crf, n = Crf(w[:-4], w[-4:].reshape(2, 2), 0.5), self.counts.sum()
        p, pairs, log_sum = crf.chain(self.doc, self.heights(crf.weight), self.counts)
        value = (self.true @ crf.weight + (self.pairs * crf.move).sum() - log_sum) / n - decay / 2 * (w @ w)
        return value, np.r_[(self.true - self.sums(p * self.counts)) / n, ((self.pairs - pairs) / n).ravel()] - decay * w

    def fit(self, decay: float, start: np.ndarray | None = None, flat: float = FLAT) -> np.ndarray:
        return climb(lambda w: self.likelihood(w, decay), np.zeros(len(self.true) + 4) if start is None else start, flat)


Lines = list[np.ndarray]


def places(xs: Lines) -> Lines:
    """The numbers of each document's lines, counted through."""
    ends = np.cumsum([len(x) for x in xs])
    return np.split(np.arange(ends[-1]), ends[:-1]) if len(xs) else []


def spliced(xs: Lines, ys: Lines, good: np.ndarray) -> tuple[Lines, Lines]:
    """Looks (or places) and labels of sequences whose labels change: for each bad document one of its lines, between
    those of a good one, SPLICES times."""
    rng = np.random.default_rng(SEED)
    hosts = np.flatnonzero(good)
    out: tuple[Lines, Lines] = [], []
    for i in np.repeat(np.flatnonzero(good == 0), SPLICES) if len(hosts) else ():
        host = hosts[rng.integers(len(hosts))]
        at, line = rng.integers(len(xs[host]) + 1), rng.integers(len(xs[i]))
        for v, to in zip((xs, ys), out, strict=True):
            to.append(np.concatenate([v[host][:at], v[i][line : line + 1], v[host][at:]]))
    return out


def shown(xs: Lines, ys: Lines, good: np.ndarray) -> Sequences:
    """What teaches: the documents, and such sequences beside them."""
    own = places(xs)
    more = spliced(own, ys, good)
    return Sequences(xs, ys + more[1], np.r_[np.ones(len(xs)), np.full(len(more[0]), 1 / SPLICES)], own + more[0])


def chosen_decay(xs: Lines, ys: Lines, good: np.ndarray) -> float:
    """That of DECAYS under which spliced sequences of left-out folds are likeliest; both labels are dealt round the folds."""
    fold = np.zeros(len(good), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(good == label)
        fold[np.random.default_rng(SEED).permutation(at)] = np.arange(len(at)) % FOLDS
    of = lambda rows: ([xs[i] for i in rows], [ys[i] for i in rows], good[rows])
    total = np.zeros(len(DECAYS))
    for k in range(FOLDS):
        xs_left, *labels = of(np.flatnonzero(fold == k))
        left = spliced(places(xs_left), *labels)
        inside = np.flatnonzero(fold != k)
        if not left[0] or not len(inside):
            continue
        seen, tested, w = shown(*of(inside)), Sequences(xs_left, left[1], at=left[0]), None
        for i, decay in enumerate(DECAYS):
            w = seen.fit(decay, w, FLAT * 100)
            total[i] += tested.likelihood(w)[0]
    return DECAYS[int(np.argmax(total))]


def train(xs: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray, prior: float) -> Crf:
    """xs, sizes: looks and bytes of each document's lines; good: its label. Fits the chain to weak labels of lines that it
    gives itself, then the curve of documents over their shares of good lines."""
    some = [i for i, x in enumerate(xs) if len(x)]
    xs, size, good = [xs[i] for i in some], np.concatenate([sizes[i] for i in some] or [np.zeros(0)]), good[some]
    width = looks([b"a"])[2].shape[1]
    crf = Crf(np.zeros(3 * width + 3), np.zeros((2, 2)), prior)
    if not xs:
        return crf
    doc = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    y = good[doc]
    cut = lambda v: np.split(v, begin[1:])
    whole = Sequences(xs, cut(y))
    decay, w = chosen_decay(xs, cut(y), good), None
    for last in (False, True):
        w = shown(xs, cut(y), good).fit(decay, w, FLAT if last else FLAT * 10)
        crf.weight, crf.move = w[:-4], w[-4:].reshape(2, 2)
        p = crf.chain(doc, whole.heights(crf.weight))
        worst = p == np.minimum.reduceat(p, begin)[doc]
        y = np.where(good[doc] > 0, 1, ((p > 0.5) & ~worst).astype(np.int64))
    _, share = shares(doc, size, p, len(xs))
    height, slope = newton(np.stack([np.ones(len(share)), share], 1), good, 1e-4, 100)
    crf.curve = (max(0.0, float(slope)), float(height))
    return crf


def in_steps(texts: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(held[-1])
        if size >= STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _looked(train_lines: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, quality, text to doc_id, quality and looks (bytes and look of each of the middle lines, as 32-bit numbers)."""
        for b in batches:
            at = 0
            for texts in in_steps(b.column(2)):
                doc, size, x = looks(texts)
                rows = np.concatenate([size.astype(np.float32)[:, None], x], 1)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                begin = ends[:-1] + np.maximum(0, np.diff(ends) - train_lines) // 2
                held = [rows[i : min(i + train_lines, j)].tobytes() for i, j in zip(begin, ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(held, pa.binary())], ["doc_id", "quality", "looks"])
                at += len(texts)

    return look


def fit(docs: DataFrame, labels: DataFrame, may_teach: Column, doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Crf:
    """may_teach: condition on the doc_id column of labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may_teach).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(train_docs)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    looked = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_looked(train_lines), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, quality int, looks binary")
    least = looked.groupBy("doc_id").agg(F.min(F.struct("looks", "quality")).alias("x"))
    rows = least.select("x.*").toArrow()  # train_docs rows of train_lines lines at most
    y = (rows.column("quality").to_numpy() > 0).astype(np.int64)
    width = looks([b"a"])[2].shape[1] + 1
    xs = [np.frombuffer(r, np.float32).reshape(-1, width) for r in rows.column("looks").to_pylist()]
    order = sorted(range(len(xs)), key=lambda i: (y[i], xs[i].tobytes()))  # tasks end in any order; sums must not
    xs, y = [xs[i] for i in order], y[order]
    return train([x[:, 1:] for x in xs], [x[:, 0].astype(float) for x in xs], y, float(y.mean()) if len(y) else 1.0)


def with_lines(docs: DataFrame, crf: Crf, text: str = "text", to: str = "lines") -> DataFrame:
    """Adds each line with words, in order: its bytes and its probability of being good."""
    kind = "array<struct<bytes:long,good:double>>"

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for some in in_steps(texts):
            doc, size, p = crf.lines(some)
            ends = np.searchsorted(doc, np.arange(len(some) + 1))
            out += [[{"bytes": int(n), "good": float(g)} for n, g in zip(size[i:j], p[i:j])] for i, j in zip(ends, ends[1:])]
        return pa.array(out, pa.list_(pa.struct([("bytes", pa.int64()), ("good", pa.float64())])))

    return docs.withColumn(to, label(F.col(text)))


def with_score(docs: DataFrame, crf: Crf, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the quality score, 0 to 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        got = [crf.score(t) for t in in_steps(texts)]
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    return docs.withColumn(to, score(F.col(text)))
