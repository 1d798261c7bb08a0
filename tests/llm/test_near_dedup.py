"""The near-dedup stage of the pipeline against brute force at 5-word similarity 0.8."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tranche.llm import jaccard, simhash

from .test_text_ops import AWKWARD, documents, words


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, at=0.8):
    """The smallest id of each row's group, by comparing all pairs."""
    sets, root = [sets_of(t) for _, t in rows], [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) >= at * both - 1e-12:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return root


def edited(text, n, seed):
    rnd, w = random.Random(seed), text.split()
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"e{seed}_{i}"
    return " ".join(w)


def planted():
    """Pairs around 0.8, a hub whose copies are near it but not each other, copies by letters, and one shingle repeated."""
    texts = []
    for k in range(40):
        base = words(120 + k, 1000 + k, 5000)
        texts += [base, edited(base, 1 + k % 5, k)]
    hub = words(400, 77, 5000)
    texts += [edited(hub, 7, 200 + k) for k in range(30)] + [hub, hub.upper(), "a b c d", "A  B\nc d"]
    texts += ["x y " * 300 + words(60, 31, 5000), "x y " * 300 + words(60, 32, 5000)]
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1024, 4])
def test_groups_equal_brute_force(spark, chunk):
    rows = planted()
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(documents(spark, rows).repartition(3), chunk=chunk).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))


def test_stage_keeps_the_first_of_each_group(spark):
    rows = planted()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").select("doc_id").collect()}
    want = {i for (i, _), root in zip(rows, brute(rows), strict=True) if i == root}
    assert kept == want and len(want) < len(rows) - 40


def test_awkward_rows(spark):
    got = jaccard.near_groups(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 6, 8, 8]
    assert jaccard.near_groups(documents(spark, [])).count() == 0


def differing(a, b):
    found = [jaccard.shingles(t.encode()) for t in (a, b)]
    x, y = (simhash.majority(simhash.ones(s), len(s)) for s in found)
    return ((x ^ y) & (1 << 64) - 1).bit_count()


def test_simhash_finds_what_is_within_its_radius(spark, monkeypatch):
    """Without MinHash: pairs of like fingerprints are one group if they are similar enough, all others stay apart."""
    buckets = jaccard.bucketed
    monkeypatch.setattr(jaccard, "bucketed", lambda nodes: buckets(nodes).where("false"))
    pairs = [(b, edited(b, 1 + k % 4, k)) for k in range(60) for b in [words(150 + 5 * k, 3000 + k, 5000)]]
    pairs += [(b, edited(b, 1, k)) for k in range(4000) for b in [words(35, 9000 + k, 5000)] if differing(b, edited(b, 1, k)) <= simhash.DIFFER]
    rows = list(enumerate(t for p in pairs for t in p))
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(documents(spark, rows).repartition(3)).collect()}
    like = [differing(a, b) <= simhash.DIFFER for a, b in pairs]
    near = [9 * len(x & y) >= 4 * (len(x) + len(y)) for x, y in ((sets_of(a), sets_of(b)) for a, b in pairs)]
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] == 2 * k + (not (like[k] and near[k])) for k in range(len(pairs)))
    assert {(True, True), (True, False), (False, True)} <= set(zip(like, near, strict=True))
