"""BPE, quality, near-dedup, substring dedup and language model against brute force and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tranche.llm import bpe, components, crf, hmm, queries, simhash, substring
from tranche.llm.shared import read, remainder

from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(n, seed=0, vocab=40):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, words(30_000, 5)), (6, "same text here"), (7, "same text here"), (7, "same text here"), (None, "same text here"), (None, None), (None, words(80, 9)), (None, words(80, 9)), (8, words(80, 9)), (9, "Ünïcode 漢字 🙂 \x00 x" * 3)]


# --- BPE ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library(library, text):
    own = bpe.loaded(queries.tokenizer_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0].tolist() == ids and own.decode(ids) == text


def test_bpe_words_and_long_runs(library):
    own = bpe.loaded(queries.tokenizer_path())
    for text in ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "<|endoftext|>a<|endoftext|>", "!" * 999 + "é" * 999, words(5000, 1)]:
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_pairs_decide_like_merging():
    own = bpe.loaded(queries.tokenizer_path())
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, (2, 4000))
    said = own.apart(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), said.tolist(), strict=True):
        assert (own.merge(own.bytes_of[x] + own.bytes_of[y]) == [x, y]) == ok
    for w in [own.bytes_of[x] + own.bytes_of[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]:
        assert own.merge_long(w) == own.merge(w)


def test_bpe_merges_side_by_side_like_alone():
    own = bpe.loaded(queries.tokenizer_path())
    rng = np.random.default_rng(4)
    some = [b"", b"a", b"aaaa", b"a" * 64, b"a" * 65, b"ab" * 32, "é€𝄞".encode(), *[bytes(rng.choice([97, 98, 101, 116, 195, 169, 32], n)) for n in rng.integers(1, 90, 3000).tolist()]]
    for w, ids in zip(some, own.merge_all(some), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == own.merge_long(w)
    assert own.merge_all([]) == []


def test_bpe_rows(spark, library):
    path = queries.tokenizer_path()
    docs = documents(spark, AWKWARD).withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.decoded == (r.text or "") and r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(documents(spark, []), path), path).count() == 0
    odd = spark.createDataFrame([([50257, -1, 64],), (None,), ([None, 64],), ([222],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, path).collect()] == ["a", "", "a", "�"]


# --- quality ---


def test_crf_gradient_and_marginals():
    rng = np.random.default_rng(0)
    doc, x = np.array([0, 0, 0, 1]), rng.normal(size=(4, 3))
    model = crf.Crf(rng.normal(size=3), rng.normal(size=(2, 2)), 0.5)
    z = x @ model.weight

    def brute(lines):
        total, good = 0.0, np.zeros(len(lines))
        for bits in range(2 ** len(lines)):
            y = [bits >> i & 1 for i in range(len(lines))]
            p = math.exp(sum(z[i] * b for i, b in zip(lines, y, strict=True)) + sum(model.move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        return good / total

    assert np.allclose(model.marginals(doc, x), np.r_[brute([0, 1, 2]), brute([3])])


def test_crf_learns_and_handles_rows(spark):
    docs, labels = read(spark, DATA.replace("0.001", "0.01"), "documents"), read(spark, DATA.replace("0.001", "0.01"), "labels")
    model = crf.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    held = crf.with_score(docs, model).join(labels, "doc_id").where(remainder(F.col("doc_id"), 3) == 1).toPandas()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert (good >= 0.5).mean() > 0.98
    rows = crf.with_score(documents(spark, AWKWARD).withColumn("quality", F.lit(1)), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {model.prior}
    assert crf.with_score(documents(spark, []), model).count() == 0
    none = crf.fit(documents(spark, []), labels.where("false"), F.lit(True))
    assert {r.score for r in crf.with_score(documents(spark, [(1, None), (2, "")]), none).collect()} == {1.0}


def brute_score(model, text, lines):
    """By plain sums over all labellings, as long as lines are few, else line by line in logs."""
    _, size, x = lines
    if not len(size):
        return model.prior
    z = crf.with_neighbours(np.zeros(len(size), np.int64), x) @ model.weight
    lse = lambda v: max(v) + math.log(sum(math.exp(a - max(v)) for a in v))
    node = [(0.0, float(np.clip(a, -30, 30))) for a in z]
    ahead, back = [list(node[0])], [[0.0, 0.0]]
    for n in node[1:]:
        ahead.append([n[b] + lse([ahead[-1][a] + model.move[a, b] for a in (0, 1)]) for b in (0, 1)])
    for n in node[:0:-1]:
        back.insert(0, [lse([model.move[a, b] + n[b] + back[0][b] for b in (0, 1)]) for a in (0, 1)])
    good = [1 / (1 + math.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, back, strict=True)]
    share = sum(g * s for g, s in zip(good, size, strict=True)) / sum(size)
    return 1 / (1 + math.exp(-(model.curve[0] * share + model.curve[1])))


def test_crf_query_equals_brute_force(spark):
    """Every score of the query, from each text's own lines alone."""
    small = DATA.replace("0.001", "0.01")
    model = queries.quality_model(read(spark, small, "documents"), spark, small)
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}
    rows = queries.op3_crf(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert math.isclose(r.score, brute_score(model, text, crf.looks([text])), abs_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)


def test_crf_finds_bad_lines_in_good_documents(spark):
    """Junk lines put between lines of good documents that didn't teach."""
    small = DATA.replace("0.001", "0.01")
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    model = crf.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    held = docs.join(labels, "doc_id").where((remainder(F.col("doc_id"), 3) == 1) & (F.col("quality") == 1)).orderBy("doc_id").collect()
    junk = ["### $$$ @@@ ||| ### $$$ @@@ ||| *** &&& ###", "CLICK HERE NOW!!! BUY CHEAP!!! CLICK HERE NOW!!!", "home | about | login | home | about | login | home"]
    found = kept = lines = bad = mixed = 0
    for k, r in enumerate(held):
        good = [x for x in r.text.split("\n") if x.strip()]
        if len(good) < 3:
            continue
        at = len(good) // 2
        _, _, p = model.lines(["\n".join([*good[:at], junk[k % 3], *good[at:]]).encode()])
        found, bad, kept, lines = found + (p[at] < 0.5), bad + 1, kept + int((np.delete(p, at) >= 0.5).sum()), lines + len(good)
        mixed += bool((p < 0.5).any() and (p >= 0.5).any())
    assert bad >= 20 and found / bad >= 0.9 and kept / lines >= 0.95 and mixed / bad >= 0.85


def test_crf_lets_neighbours_settle_plain_lines(spark):
    """The same short line in the middle of good and of bad documents that didn't teach: its neighbours say what it is."""
    small = DATA.replace("0.001", "0.01")
    docs, labels = read(spark, small, "documents"), read(spark, small, "labels")
    model = crf.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    held = docs.join(labels, "doc_id").where(remainder(F.col("doc_id"), 3) == 1).orderBy("doc_id").collect()
    own = crf.looks([b"a"])[2].shape[1]
    alone = crf.Crf(np.where(np.arange(len(model.weight)) <= own, model.weight, 0), np.zeros((2, 2)), model.prior, model.curve)

    def settled(m):
        right: dict[int, list] = {0: [], 1: []}
        for r in held:
            lines = [x for x in r.text.split("\n") if x.strip()]
            at = len(lines) // 2
            for plain in ("The same.", "Of it", "In the", "And so on.", "Thing 12") if len(lines) >= 3 else ():
                p = m.lines(["\n".join([*lines[:at], plain, *lines[at:]]).encode()])[2][at]
                right[r.quality].append((p >= 0.5) == (r.quality == 1))
        assert min(map(len, right.values())) >= 50
        return min(np.mean(v) for v in right.values())

    assert settled(model) >= 0.8 and settled(alone) < 0.7


def test_crf_fit_ends_flat_at_the_likelihoods_top():
    """Height and gradient against plain sums over all labellings; the fit's end beats steps to all sides."""
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=(n, 2)).astype(np.float32) for n in (4, 1, 3, 5, 2)]
    ys, counts = [rng.integers(0, 2, len(x)) for x in xs], np.array([1, 1, 1 / 3, 1 / 3, 2])
    both = crf.Sequences(xs, ys, counts)

    def brute(w):
        total = 0.0
        for d in range(len(xs)):
            z, true = both.x[both.doc == d] @ w[:-4], both.y[both.doc == d]
            weigh = lambda y: z @ y + sum(w[-4 + 2 * a + b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
            total += counts[d] * (weigh(true) - math.log(sum(math.exp(weigh(np.array([bits >> i & 1 for i in range(len(z))]))) for bits in range(2 ** len(z)))))
        return total / both.counts.sum() - 0.005 * (w @ w)

    w = rng.normal(size=both.x.shape[1] + 4)
    height, g = both.likelihood(w, 0.01)
    sides = 1e-5 * np.eye(len(w))
    assert math.isclose(height, brute(w)) and np.allclose(g, [(brute(w + e) - brute(w - e)) / 2e-5 for e in sides], atol=1e-6)
    top = both.fit(0.01)
    assert np.abs(both.likelihood(top, 0.01)[1]).max() <= crf.FLAT
    assert all(brute(top + 1e3 * s * e) < brute(top) for e in sides for s in (-1, 1))


def test_crf_keeps_a_line_once_however_many_sequences_show_it():
    rng = np.random.default_rng(4)
    xs = [rng.normal(size=(n, 22)).astype(np.float32) for n in (32, 5, 1, 32, 9)]
    ys, good = [np.full(len(x), k % 2) for k, x in enumerate(xs)], np.array([0, 1, 0, 1, 0])
    seen, v = crf.shown(xs, ys, good), rng.normal(size=22 * 3 + 3)
    more = crf.spliced(xs, ys, good)
    flat = np.concatenate(xs + more[0])
    doc = np.repeat(np.arange(len(xs) + len(more[0])), [len(x) for x in xs + more[0]])
    x = crf.with_neighbours(doc, flat)
    assert len(more[0]) == 3 * crf.SPLICES and np.array_equal(seen.x, x) and np.array_equal(seen.y, np.concatenate(ys + more[1]))
    assert np.allclose(seen.heights(v), x @ v) and np.allclose(seen.sums(seen.y * seen.counts), x.T @ (seen.y * seen.counts))
    assert sum(a.size for a in vars(seen).values() if a.ndim == 2) <= 22 * sum(map(len, xs)) + 4  # no row for each line of each sequence


def test_crf_teaches_with_the_middle_of_long_documents(spark):
    """Long documents are cut, not left out: with one label each, two such are all that there is to learn from."""
    long = [(1, "\n".join(f"The word of day {i} was good." for i in range(300))), (2, "\n".join("$$$ ### BUY!!! $$$ ###" for _ in range(300)))]
    model = crf.fit(documents(spark, long), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True), train_lines=8)
    good, bad = model.score([t.encode() for _, t in long])
    assert model.prior == 0.5 and good > 0.5 > bad
    one = crf.fit(documents(spark, long), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert one.score([long[0][1].encode()])[0] > 0.9


# --- near-dedup ---


def brute_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, differ=3):
    names = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= differ and names[i] != names[j]:
                a, b = names[i], names[j]
                names = [min(a, b) if n in (a, b) else n for n in names]
    return names


def test_fingerprints(spark):
    got = simhash.with_fingerprint(documents(spark, AWKWARD)).select("text", simhash.hex16(F.col("fp")).alias("fp")).collect()
    assert all(r.fp == f"{brute_fingerprint(r.text):016x}" for r in got)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_equal_brute_force(spark, bucket):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(8))) & (2**64 - 1) for b in base for _ in range(90)} | {0, 1, 2**63, 2**64 - 1})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, bucket)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_components_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(n + 1)) and roots[1001] == 1000 and len(roots) == n + 3
    assert components.components(edges.where("false")).count() == 0


def test_components_steps_are_noted_as_they_are_written(spark, monkeypatch):
    """The driver plans one query for each step, the one that writes it."""
    written = []
    monkeypatch.setattr(components, "table", lambda df, table=components.table: written.append(1) or table(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = ran()
    roots = components.components(edges)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert len(written) > 2 and ran() - before == len(written)
    assert {r.root for r in roots.collect()} == {0}


def test_near_groups_rows(spark):
    docs = documents(spark, AWKWARD).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    groups = simhash.near_groups(docs)
    rows = groups.collect()
    assert len(rows) == len(AWKWARD)
    same = [r.component_id for r in rows if r.doc_id in (6, 7)]
    assert same == [6, 6, 6] and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs, groups).collect()]
    assert (6, "same text here") in kept and (7, "same text here") not in kept and (None, "same text here") not in kept and (8, words(80, 9)) in kept
    assert simhash.near_groups(documents(spark, [])).count() == 0


CLASH = ("_id", "_part", "_key", "_row", "_fate", "id", "part", "node", "fp", "first", "root", "component_id", "kept", "gone", "n_removed", "n_words", "runs", "segments", "h", "s", "m", "seg", "words", "text_hash", "holder", "block", "word", "cls", "idx", "fold", "classes", "score", "held_out", "quality", "lines", "looks")


@pytest.mark.parametrize("op", ["near", "substring", "crf", "hmm"])
def test_clashing_columns(spark, op):
    """Every name that an operator uses inside, as a column of the documents, changes nothing and stays."""
    rows = AWKWARD + planted(3, 20)
    plain = documents(spark, rows)
    docs = plain
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("own"))

    def made(d):
        if op == "near":
            return simhash.keep_first(d, simhash.near_groups(d))
        if op == "substring":
            return substring.apply_removal(d, *substring.dedup(d))
        if op == "crf":
            model = crf.fit(d, spark.createDataFrame([(4, 1), (6, 1), (9, 0), (None, 1)], "doc_id long, quality int"), F.lit(True))
            return crf.with_score(d, model, to="q").select(*d.columns)
        return hmm.score(d, F.col("doc_id") % 7 == 2, passes=1).select("doc_id", F.round("score", 6).alias("text"))

    got = made(docs)
    show = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())
    assert show(got) == show(made(plain))
    if op != "hmm":
        assert got.columns == docs.columns and not got.where(" or ".join(f"{c} <> 'own'" for c in CLASH)).count()


# --- substring dedup ---


def brute_removal(rows, width):
    first = {}
    texts = [(i if i is not None else 2**63 - 1, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i == 2**63 - 1 else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n=60):
    rnd = random.Random(seed)
    passages = [words(rnd.randrange(6, 40), 100 + i, 500) for i in range(5)]
    rows = []
    for i in range(n):
        parts = [words(rnd.randrange(0, 60), seed * 1000 + i, 500), rnd.choice(passages) if rnd.random() < 0.7 else "", words(rnd.randrange(0, 30), seed * 1000 + 500 + i, 3)]
        rows.append((i, " \n".join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize(("width", "run", "shard", "hot"), [(12, 3, 400, 4096), (12, 3, 10**6, 2), (8, 2, 200, 4096), (50, 8, 400_000, 4096)])
def test_substring_equals_brute_force(spark, width, run, shard, hot):
    rows = planted(2) + [(i + 100 if i is not None else None, t) for i, t in AWKWARD]
    outcome, changed = substring.dedup(documents(spark, rows).withColumn("words", F.lit(1)).repartition(4), width=width, run=run, shard_words=shard, hot=hot)
    got = sorted((tuple(r) for r in outcome.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute_removal(rows, width)
    left = substring.apply_removal(documents(spark, rows), outcome, changed)
    digests = {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in left.collect()}
    assert digests == {(i, sha) for i, n, gone, sha in got if not (gone and gone == n)}


def test_substring_empty_and_long(spark):
    outcome, changed = substring.dedup(documents(spark, []))
    assert outcome.count() == 0 and changed.count() == 0
    rows = [(1, words(20_000, 3, 1000)), (2, "x " + words(20_000, 3, 1000)), (3, " ".join(["a"] * 5000)), (4, " ".join(["a"] * 200))]
    got = {r.doc_id: r.n_removed for r in substring.dedup(documents(spark, rows))[0].collect()}
    assert got == {1: 0, 2: 20_000, 3: 0, 4: 200}


def test_long_repetitive_texts(spark):
    """Windows fold into few passages, however long the texts are."""
    n = 3_000_000
    rows = [(1, "a " * n), (2, "b " + "a " * n), (3, "ab " * 1000 + "a " * 60)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(documents(spark, rows))[0].collect()}
    assert got == {1: (n, 0), 2: (n + 1, n), 3: (1060, 60)}


@pytest.mark.parametrize(("width", "vocab", "seed"), [(12, 3, 0), (50, 2, 1), (50, 400, 2), (8, 5, 3), (3, 1, 4)])
def test_matching_statistics_of_texts_outside_the_index(width, vocab, seed):
    rnd = random.Random(seed)
    indexed = [[rnd.randrange(1, vocab + 1) for _ in range(rnd.randrange(1, 400))] for _ in range(9)] + [[1] * 150, [1, *[vocab] * 90]]
    owners = [rnd.randrange(100) for _ in indexed]
    asked = []
    for _ in range(12):  # pieces of indexed texts between words of their own and words that the index lacks
        text = []
        for _ in range(5):
            t = rnd.choice(indexed)
            a = rnd.randrange(len(t))
            text += t[a : a + rnd.randrange(1, 130)] + [rnd.choice([-1, 1, vocab])] * rnd.randrange(3)
        asked.append(text)
    flat = lambda texts: (np.array([x for t in texts for x in [*t, 0]], np.int32), np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1])
    words_, starts = flat(indexed)
    index = substring.FmIndex(words_, starts, np.array(owners), width)
    length, least = index.stream(*flat(asked))
    places = {}
    for t, o in zip(indexed, owners, strict=True):
        for i in range(len(t)):
            for n in range(1, min(width, len(t) - i) + 1):
                k = tuple(t[i : i + n])
                places[k] = min(o, places.get(k, o))
    at = 0
    for t in asked:
        for i in range(len(t)):
            n = max((n for n in range(1, min(width, len(t) - i) + 1) if tuple(t[i : i + n]) in places), default=0)
            assert length[at + i] == n and least[at + i] == (places[tuple(t[i : i + n])] if n == width else -1)
        at += len(t) + 1


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 37, 1000)
    tree = substring.Wavelet(v, 36)
    c, lo = rng.integers(0, 37, 200), rng.integers(0, 1001, 200)
    a, b = tree.rank(c, lo, np.full(200, 1000))
    assert all(x == (v[:i] == k).sum() and y == (v == k).sum() for x, y, k, i in zip(a, b, c, lo, strict=True))


# --- language model ---


def brute_forward(model, seq):
    p = model.start * model.emit[:, seq[0]]
    for c in seq[1:]:
        p = (p @ model.move) * model.emit[:, c]
    return math.log(p.sum())


def test_forward_backward():
    rng = np.random.default_rng(1)
    model = hmm.Hmm.begin(np.full(6, 1 / 6), 3)
    seqs = [rng.integers(0, 6, n) for n in (5, 1, 9, 9)]
    steps = hmm.Steps(seqs)
    total = hmm.forward(model, steps)[0]
    assert np.allclose(total, [brute_forward(model, seqs[i]) for i in steps.order])
    counts = hmm.expected(model, steps)
    assert math.isclose(counts["emit"].sum(), 24) and math.isclose(counts["move"].sum(), 20) and math.isclose(counts["start"].sum(), 4)
    logs = []
    for _ in range(6):
        counts = hmm.expected(model, steps)
        logs.append(counts["log"][0])
        model = hmm.Hmm(counts["start"] / counts["start"].sum(), counts["move"] / counts["move"].sum(1, keepdims=True), counts["emit"] / counts["emit"].sum(1, keepdims=True))
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:], strict=False))


def test_hmm_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 500)
    rows = AWKWARD + planted(6, 40)
    held = remainder(F.col("doc_id"), 7) == 2
    got = hmm.score(documents(spark, rows).withColumn("block", F.lit(1)).repartition(3), held).collect()
    counts, tokens = Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        tokens.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (str(r[0]), r[1], round(r[3], 6))
    want = sorted(((i, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens), key=key)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    assert [h[:3] for h in have] == [w[:3] for w in want] and np.allclose([h[3] for h in have], [w[3] for w in want])
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert hmm.score(documents(spark, []), held).count() == 0


def plain_counts(model, seq):
    """Expected counts of a short sequence, unscaled and step by step."""
    k, n = len(model.start), len(seq)
    a, b = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        a[t] = model.emit[:, seq[t]] * (model.start if t == 0 else a[t - 1] @ model.move)
    for t in range(n - 2, -1, -1):
        b[t] = model.move @ (model.emit[:, seq[t + 1]] * b[t + 1])
    p = a[-1].sum()
    move, emit = np.zeros((k, k)), np.zeros_like(model.emit)
    for t in range(n):
        emit[:, seq[t]] += a[t] * b[t] / p
        if t:
            move += model.move * np.outer(a[t - 1], model.emit[:, seq[t]] * b[t]) / p
    return {"start": a[0] * b[0] / p, "move": move, "emit": emit, "log": math.log(p)}


def test_hmm_score_equals_brute_force(spark, monkeypatch):
    """Classes, counts, incremental Baum-Welch and the score of whole texts, over a small table."""
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 300)
    rows = [(i, " ".join([words(12, i, 60), "The"] * (1 + i % 3) + [f"rare{i}"] * (i % 2))) for i in range(60)] + [(60, None), (None, "the w1")]
    fold = lambda i, by: zlib.crc32(("" if i is None else str(i)).encode()) % by
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    counts = Counter(x for i, w in tokens if fold(i, 7) != 2 for x in w)
    total = sum(counts.values())
    often = sorted(x for x, c in counts.items() if x and c * hmm.SHARE >= total)
    cls = lambda x: 1 + hmm.ENDINGS + often.index(x) if x in often else (1 + zlib.crc32(x[-2:]) % 255 if x else 0)
    n, v = np.zeros(1 + hmm.ENDINGS + len(often)), np.zeros(1 + hmm.ENDINGS + len(often))
    for x, c in counts.items():
        n[cls(x)] += c
        v[cls(x)] += 1
    shares = (n + 1) / (n + 1).sum()
    seqs = [(i, [cls(x) for x in w]) for i, w in tokens]
    model, held, logs = hmm.Hmm.begin(shares), {}, []
    while len(logs) < 2 or logs[-1] - logs[-2] >= hmm.GAIN * abs(logs[-2]):
        logs.append(0.0)
        for f in range(hmm.FOLDS):
            found = [plain_counts(model, s) for i, s in seqs if fold(i, 7) != 2 and zlib.crc32(str(i).encode()) % hmm.FOLDS == f]
            if found:
                logs[-1] += sum(c["log"] for c in found)
                held[f] = {k: sum(c[k] for c in found) for k in ("start", "move", "emit")}
                sums = {k: sum(c[k] for c in held.values()) for k in ("start", "move", "emit")}
                even = lambda a: (a + 1 / hmm.STATES) / (a.sum(-1, keepdims=True) + 1)
                model = hmm.Hmm(even(sums["start"]), even(sums["move"]), (sums["emit"] + shares) / (sums["emit"].sum(1, keepdims=True) + 1))
    want = {i: (brute_forward(model, s) / math.log(10) + sum(math.log10((counts[x] + 1) / (n[cls(x)] + v[cls(x)] + 1)) for x in w)) for (i, w), (_, s) in zip(tokens, seqs, strict=True)}
    got = {r.doc_id: r.score for r in hmm.score(documents(spark, rows).repartition(3), remainder(F.col("doc_id"), 7) == 2).collect()}
    assert len(logs) > 3 and got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-7) for i in want)


def test_hmm_beats_unigrams_on_held_out(spark):
    got = queries.op9_hmm(spark, DATA.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
