"""Filter audit, token files and Merkle manifest against brute force, SQL and awkward rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from glob import glob
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tranche.llm import audit, bpe, chat, media, merkle, mixing, queries, token_files, topk, warc, warc_files
from tranche.llm.shared import before, new_folder

from ..conftest import DATA
from .test_text_ops import AWKWARD, documents, words

LABELS = "doc_id long, quality int, toxic int"


def test_sums_before_over_many_parts(spark):
    n = 3000  # three blocks of parts
    found = before(spark.range(n).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g")), "p", "v", "s", ("g",))
    sums = defaultdict(int)
    for r in sorted(found.collect(), key=lambda r: r["p"]):
        assert r["s"] == sums[r["g"]]
        sums[r["g"]] += r["v"]


# --- filter audit ---


def audited(docs, labels):
    """The figures of every order, document by document."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failing = []
    for i, t, s in docs:
        w = t.encode().split()
        caps = sum("A" <= c <= "Z" for c in t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        failing.append((s, {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 2 * len(t), any(c in "#$%&*|" for c in t), copy)) if bad}, i))
    found, total = {}, defaultdict(int)
    for order in permutations("ABCDE"):
        for step, own in enumerate(order, 1):
            ahead = set(order[: step - 1])
            for part in {s for s, _, _ in failing}:
                rows = [(bad, i) for s, bad, i in failing if s == part]
                removed = [(bad, i) for bad, i in rows if own in bad and not bad & ahead]
                total[part, own] += len(removed)
                found[part, "".join(order), step] = [
                    sum(not bad & (ahead | {own}) for bad, _ in rows), len(removed), sum(own in bad and bool(bad & ahead) for bad, _ in rows), sum(bad == {own} for bad, _ in rows),
                    sum(i in good for _, i in removed), sum(i in toxic for _, i in removed),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", words(250, 1, 300), words(250, 1, 300), words(300, 2, 20), "ABC " * 120, words(220, 3, 400) + " 100%", "É" * 300, "a\x1cb " * 300, "x # y", words(50_000, 4, 60_000)]
    docs = [(i, rnd.choice(texts), rnd.choice(["web", "web", None, "", "books"])) for i in range(300)]
    docs += [(None, texts[2], "web"), (None, texts[2], "web"), (7, docs[7][1], docs[7][2]), (7, texts[2], "none")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10_000, 1, 1)]
    made = audit.text_audit(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"key": F.lit(1), "A": F.lit(2)}), spark.createDataFrame(labels, LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in made.collect()}
    assert got == audited(docs, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    none = audit.text_audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS))
    assert none.count() == 0
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("p"), (F.col("id") % 2 == 0).alias("x"), F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 7 == 0).alias("y"))
    counts = {(r["part"], r["subset"]): r["kept"] for r in audit.subset_counts(rows, "p", ["x", "y"], {}).collect()}
    for part in range(3):
        ids = [i for i in range(1000) if i % 3 == part]
        assert counts[str(part), 3] == sum(i % 2 != 0 and not (i % 7 == 0 and i % 5 != 0) for i in ids)
    with pytest.raises(ValueError):
        audit.subset_counts(rows, "p", ["x"] * 9, {})


def test_bitmaps_with_many_parts():
    rng = np.random.default_rng(0)
    parts, fails, mark = rng.integers(0, 500, 5000), [rng.random(5000) < 0.3 for _ in range(3)], rng.random(5000) < 0.1
    got = audit.subset_popcounts(parts, 501, fails, [mark])
    for s in range(8):
        alive = ~np.any([f for i, f in enumerate(fails) if s >> i & 1] or [np.zeros(5000, bool)], axis=0)
        assert np.array_equal(got[:, s, 0], np.bincount(parts[alive], minlength=501)) and np.array_equal(got[:, s, 1], np.bincount(parts[alive & mark], minlength=501))


# --- token files ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def encoded(encoder, texts):
    flat, ends = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, ends[1:-1])]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_library(library, text):
    own = token_files.loaded(queries.tokenizer_path("word_bpe_49k.json"))
    assert encoded(own, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_ids_of_awkward_texts_equal_library(library):
    own = token_files.loaded(queries.tokenizer_path("word_bpe_49k.json"))
    rnd = random.Random(2)
    bits = ["a", "B", "'s", "'S", "é", "İ", "ß", "́", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "1", "!", "…", "ſ", "ŉ", "漢", "🙂", " ", "Σ", "\x00", "'ll", "가", "가"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(1, 14))) for _ in range(20_000)] + ["a" * 5000, "é" * 3000, words(5000, 1)]
    texts += [f"aB{chr(c)}Cd {chr(c)}x1{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for _ in range(2):  # once new, once known
        for text, ids, want in zip(texts, encoded(own, texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids == want.ids, text


def test_chunks_are_cut_as_by_the_tokenizer_files_pattern():
    rnd = random.Random(5)
    chars = [chr(c) for c in range(0x300) if chr(c) not in " \t\n\v\f\r"]
    chunks = [f"{a}x{b}" for a in chars for b in ("1", "'s", "!", "É", a)] + ["".join(rnd.choices([*chars, *"'sdmtrevl" * 20], k=rnd.randrange(1, 12))) for _ in range(30_000)]
    line = "\n".join(chunks).lower()
    assert not token_files.OTHER.search("".join(chars).replace("<|", "")) and token_files.CUT.findall(line) == token_files.PIECES.findall(line)


def listed(library, docs):
    """doc_id, start, n_tokens, ids_crc32 of documents in order."""
    at, found = 0, []
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        found.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_token_files_query_against_brute_force(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, queries.op12_token_files(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == listed(library, docs)


def test_token_files_of_awkward_rows(spark, library):
    rnd = random.Random(1)
    docs = [(i, words(rnd.randrange(300), i)) for i in rnd.sample(range(100, 100_000), 500)] + AWKWARD
    df = documents(spark, docs).withColumns({"ids": F.lit("x"), "part": F.lit("y"), "tie": F.lit(2), "meta": F.lit(3), "offset": F.col("doc_id")}).repartition(7)
    path = new_folder(spark)
    token_files.write(df, path, queries.tokenizer_path("word_bpe_49k.json"), 1, group_bytes=1 << 14, page_rows=20)
    rows = token_files.with_crc32(token_files.read(spark, path)).collect()
    in_order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(in_order, in_order[1:])) and in_order[0]["start"] == 0
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((i or -1, n, c) for i, _, n, c in listed(library, docs))
    assert {r["meta"]["ids"] for r in rows} == {"x"} and all(r["meta"]["offset"] == r["doc_id"] for r in rows)
    # what is in the files: order across files, bounded groups, encodings, page index
    last, groups, files = None, 0, sorted(glob(f"{path.removeprefix('file:')}/tokens/*.parquet"))
    for f in files:
        file = pq.ParquetFile(f)
        ids = [i for i in file.read(["doc_id"])["doc_id"].to_pylist() if i is not None]
        assert ids == sorted(ids) and (last is None or not ids or last <= ids[0])
        last = ids[-1] if ids else last
        for g in range(file.num_row_groups):
            columns = {c.path_in_schema: c for c in (file.metadata.row_group(g).column(i) for i in range(file.metadata.num_columns))}
            groups += 1
            assert "DELTA_BINARY_PACKED" in columns["offset"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert all(c.has_offset_index and c.has_column_index for k, c in columns.items() if k in ("doc_id", "offset", "n_tokens"))
    assert groups > len(files)


def test_token_files_are_read_selectively(spark):
    path = new_folder(spark)
    token_files.write(documents(spark, [(i, words(50, i)) for i in range(2000)]), path, queries.tokenizer_path("word_bpe_49k.json"), 1)
    some = token_files.read(spark, path, ["doc_id", "start"], F.col("doc_id").between(500, 510))
    plan = some._jdf.queryExecution().toString()
    assert some.count() == 11 and "GreaterThanOrEqual(doc_id,500)" in plan
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "offset" in x)
    assert "ids" not in scan[scan.index("ReadSchema") :] and "meta" not in scan[scan.index("ReadSchema") :]
    empty = new_folder(spark)
    token_files.write(documents(spark, []), empty, queries.tokenizer_path("word_bpe_49k.json"), 1)
    assert token_files.read(spark, empty).count() == 0


# --- Merkle manifest ---


def up(nodes):
    """All levels of a tree over digests."""
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([sha256("".join(made[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(made[-1]), 2)])
    return made


def siblings(made, at):
    return [x for h, level in enumerate(made[:-1]) for x in level[(at >> h) ^ 1 : ((at >> h) ^ 1) + 1]]


def digests(n):
    return [sha256(str(i).encode()).hexdigest() for i in range(n)]


@pytest.mark.parametrize("n", [*range(1, 40), 63, 64, 65, 100, 1000, 1023, 1024])
def test_paths_of_every_leaf(n):
    leaves, made = digests(n), up(digests(n))
    height = len(made) - 1
    assert merkle.node(leaves, height) == made[-1][0]
    found = list(merkle.paths(leaves, height))
    assert [[d for _, d in p if d] for p in found] == [siblings(made, i) for i in range(n)]
    for i, p in enumerate(found):
        x = leaves[i]
        for left, d in p:
            x = merkle.joined(x) if d is None else merkle.joined(d, x) if left else merkle.joined(x, d)
        assert x == made[-1][0]


def test_few_nodes_are_held(monkeypatch):
    """A block's stacks hold a few nodes per level, and share a bounded number of steps a leaf."""
    stacks, steps = [], []
    plain, stepped = merkle.Treehash.__init__, merkle.Treehash.step
    monkeypatch.setattr(merkle.Treehash, "__init__", lambda self, h: (plain(self, h), stacks.append(self))[0])
    monkeypatch.setattr(merkle.Treehash, "step", lambda self, leaves: (stepped(self, leaves), steps.append(1))[0])
    most, before_ = 0, None
    for _ in merkle.paths(digests(1024), 10):
        most = max(most, sum(len(s.nodes) for s in stacks))
        if before_ is not None:
            assert len(steps) - before_ <= 2 * 10 - 1
        before_ = len(steps)
    assert most <= 3 * 10


def brute(docs):
    """(doc_id, leaf): subroot, root, proof of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    trees = defaultdict(list)
    for d in docs:
        trees[d[2]].append((d[0] is not None, d[0] or 0, sha256("".join(map(field, d)).encode()).hexdigest(), d))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: up([leaf for _, _, leaf, _ in sorted(trees[g], key=lambda x: x[:3])]) for g in order}
    top = up([made[g][-1][0] for g in order])
    found = defaultdict(list)
    for j, g in enumerate(order):
        for i, (_, _, leaf, d) in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            found[d[0], leaf].append((made[g][-1][0], top[-1][0], siblings(made[g], i) + siblings(top, j)))
    return found


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_against_brute_force(spark, height):
    rnd = random.Random(height)
    docs = [(i, rnd.choice(["s", None, "ü"]), rnd.choice(["en", "en", "en", "de", None, "", "Z"]), rnd.choice([3, None]), rnd.choice([None, "", "x", "é漢🙂"])) for i in range(200)]
    docs += [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (5, "s", "en", 1, "x"), (5, "s", "en", 1, "x"), (7, None, "lone", None, words(20_000, 1))]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("g", "k", "pos", "n", "digest", "leaf", "order")})
    made = merkle.manifest(df.repartition(5), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"order": F.col("g"), "chars": F.col("n_chars")}, height)
    assert made.columns == ["doc_id", "lang", "order", "chars", "leaf", "subroot", "root", "proof"]
    got = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    found = defaultdict(list)
    for r in got:
        assert r["folded"] == r["root"]
        found[r["doc_id"], r["leaf"]].append((r["subroot"], r["root"], [s["digest"] for s in r["proof"] if s["digest"]]))
    want = brute(docs)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(spark.createDataFrame([], schema), fields, "lang", "doc_id").count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema), fields, "lang", "doc_id").collect()
    assert one["leaf"] == one["subroot"] == one["root"] == sha256(b"1:1----").hexdigest() and one["proof"] == []


# --- columns of any name, files of any shape ---


INSIDE = ["_c", "_r", "c", "r", "row", "_mark", "mark", "g", "k", "at", "part", "pos", "n", "key", "tie", "ids", "meta", "block", "size", "shard", "rank", "query", "score", "digest", "media", "item", "items", "words", "source_size", "_block", "_n"]


def test_columns_named_as_those_inside_are_kept(spark):
    extra = {c: F.lit(f"own {c}") for c in INSIDE}
    own = lambda rows, names: all(r[c] == f"own {c}" for r in rows for c in names)
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "x")])], f"conv_id long, chosen {turns}, rejected {turns}")
    plain, more = chat.format_preferences(pairs), chat.format_preferences(pairs.withColumns(extra))
    assert own(more.collect(), INSIDE) and more.select(plain.columns).collect() == plain.collect()
    docs = documents(spark, [(i, words(20, i)) for i in range(30)])
    coded = bpe.encode(docs.withColumns({c: v for c, v in extra.items() if c != "ids"}), queries.tokenizer_path())
    assert own(coded.collect(), [c for c in INSIDE if c != "ids"])
    free = [c for c in INSIDE if c not in mixing.mix(docs).columns]
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.withColumns({c: extra[c] for c in free})).collect()} == {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "vec_id long, embedding array<float>")
    top = lambda df: sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    assert top(vectors.withColumns(extra)) == top(vectors)
    pages = spark.createDataFrame([(1, "http://x", "<p>a</p>")], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages.withColumns(extra)).withColumns(extra)).count() == 2
    htmls = pages.withColumns({c: v for c, v in extra.items() if c != "items"})
    assert own(media.with_items(htmls).collect(), [c for c in INSIDE if c != "items"])


@pytest.mark.parametrize("split", [0, 700])
def test_warc_members_of_several_records(spark, tmp_path, split):
    import gzip

    warc_files.register(spark)
    load = lambda p, mode="failfast": spark.read.format("warc").option("split", split).option("mode", mode).load(str(p))
    records = [warc.response(i, f"http://x/{i}", f"<p>page {i}</p>" * (i + 1)) for i in range(50)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("two", gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        rows = load(tmp_path / name)
        assert sorted(bytes(r.record) for r in rows.collect()) == sorted(records)
        assert warc.derivatives(rows.select(F.lit(1).cast("long").alias("page_id"), "record")).count() == 100
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:30])[:-9])
    (tmp_path / "cut" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[30:40])[:-9]) + gzip.compress(records[40]))
    (tmp_path / "cut" / "c.warc").write_bytes(b"".join(records[41:])[:-9])
    with pytest.raises(Exception, match="no whole"):
        load(tmp_path / "cut").collect()
    rows = load(tmp_path / "cut", "permissive").collect()
    assert sorted(bytes(r.record) for r in rows if r.record) == sorted(records[:29] + records[30:39] + records[40:49])
    assert sorted((r.file, r.error is not None) for r in rows if not r.record) == [("a.warc.gz", True), ("b.warc.gz", True), ("c.warc", True)]
