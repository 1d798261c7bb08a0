"""Queries that SQL can't express, over whole tables, against plain Python."""

from __future__ import annotations

from hashlib import sha256

import xxhash

from tranche.llm import queries

from ..conftest import DATA

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    want = set()
    for i, t in texts(spark):
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in queries.op1_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def fingerprint(text):
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    marks = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def test_op4_is_all_pairs(spark):
    prints = {i: fingerprint(t) for i, t in texts(spark)}
    least = {i: i for i in prints}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                least[y] = x
    want = {(i, f"{prints[i]:016x}", top(i)) for i in ids}
    assert {tuple(r) for r in queries.op4_simhash(spark, DATA).select("doc_id", "fingerprint", "component_id").collect()} == want
