"""Token ids as Parquet: list columns beside metadata, in order of doc_id, for selective reads.

Files hold one row per document: doc_id, part, offset (ids of the part before it), n_tokens, ids, and all other columns but
the text in a struct `meta`. Ids are dictionary-coded (16 bits each for a vocabulary of 2 ** 16), whole-number columns
delta-coded; row groups are bounded by bytes and pages by rows, and every page has its entry in the page index, so a range of
doc_ids or a few columns are read without the rest. `parts` beside the files holds a row per file: the ids before it.

Defined results: documents stand in order of doc_id, null first; those of one doc_id by a hash of the text, and equal ones in
any order. A null or empty text has the end id alone. An empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bpe import printable_bytes
from .shared import before, in_slices

#: Bytes of a row group, about, and rows of a page.
GROUP_BYTES, PAGE_ROWS = 32 << 20, 1000
#: Distinct chunks of text that a worker keeps for its next tasks, and the longest of them.
CACHE, LONGEST = 600_000, 64
#: Bytes of text that are encoded at once, about.
SLICE = 4 << 20
#: Pieces that go to the library's model in one string.
LINE = 1000
#: What the shortcut for a chunk leaves to the whole tokenizer: characters that may combine, and special tokens.
OTHER = re.compile("[^\x00-\u02ff]|<\\|")
#: Fixed value: the pre-tokenizer's pattern in the tokenizer file; line feeds stand between chunks here.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def written_out() -> re.Pattern:
    """PIECES for lower-cased chunks that OTHER does not find: the standard library's patterns take half the time, but their
    classes must be written out."""
    met = sorted({x for c in range(0x300) for x in chr(c).lower()})
    among = lambda kind: "".join(re.escape(c) for c in met if regex.fullmatch(kind, c))
    letters, numbers, blanks = among(r"\p{L}"), among(r"\p{N}"), among(r"\s")
    return re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


CUT = written_out()


class WordEncoder:
    """The tokenizers library, asked once for each chunk between white space that a task has not met.

    White space parts words for the pre-tokenizer, and neither normalising nor lower-casing looks beyond it, so chunks are
    encoded alike wherever they stand. Chunks of plain letters are cut here, a batch at once, and their pieces go to the
    library's model, where a token of a word's end closes each piece; other chunks go through its whole pipeline.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = Tokenizer(self.whole.model)  # takes pieces with a blank between them
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = {b: c for c, b in printable_bytes().items() if b != 32}
        suffix = self.whole.model.end_of_word_suffix
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # those not met since the last half of CACHE

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks that can be cut here, as 32-bit numbers."""
        cut = CUT.findall("\n".join([*texts, ""]).lower())
        number = {p: i for i, p in enumerate(dict.fromkeys(cut))}
        which = np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))
        feed = number.pop("\n")  # stands for no ids
        pieces = list(number)
        lines = [" ".join(pieces[i : i + LINE]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(pieces), LINE)]
        ids = np.array([i for e in self.model.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
        ends = np.insert(np.flatnonzero(self.closes[ids]) + 1, feed, 0)
        begins = np.concatenate([[0], np.delete(ends, feed)])
        begins = np.insert(begins[:-1], feed, 0)
        sizes = ends - begins
        size, begin = sizes[which], begins[which]
        total = np.cumsum(size)
        flat = ids[np.repeat(begin - total + size, size) + np.arange(total[-1])].astype(np.int32).tobytes()
        stops = (4 * total[which == feed]).tolist()
        return [flat[b:e] for b, e in zip([0, *stops], stops)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        plain = [c for c in new if c.isascii() and "<|" not in c or not OTHER.search(c)]
        found = dict(zip(plain, self.plain(plain), strict=True)) if plain else {}
        if len(plain) < len(new):
            for c in set(new).difference(plain):
                found[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, np.int32).tobytes()
        return found

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last one's end. Distinct chunks are looked up once."""
        if len(self.chunks) > CACHE // 2:
            self.chunks, self.older = {}, self.chunks
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        known, chunks, older = words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.chunks, self.older
        each = list(map(chunks.get, known))
        missing = [i for i, x in enumerate(each) if x is None]
        met = {c: older[c] for i in missing if (c := known[i]) in older}
        found = self.learn([c for i in missing if (c := known[i]) not in met])
        chunks.update(met)
        chunks.update(found)
        for i in missing:
            each[i] = chunks[known[i]]
        for c in found:
            if len(c) > LONGEST:
                del chunks[c]
        ids = pa.array(each, pa.binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(ids) + 1].astype(np.int64) // 4
        flat = np.frombuffer(data, np.int32, ends[-1]) if ends[-1] else np.zeros(0, np.int32)
        lengths = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        return flat, ends[np.concatenate([[0], np.cumsum(lengths)])]


_loaded: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def encoded(docs: DataFrame, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part, offset, n_tokens, ids, meta, in order: what write() puts into files."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, doc_id)]
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.alias("text"), F.struct(*rest, F.lit(None).cast("string").alias("_")).alias("meta") if not rest else F.struct(*rest).alias("meta"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("tie")
    long, numbers = LongType(), ArrayType(IntegerType(), False)
    schema = StructType([rows.schema["doc_id"], StructField("part", IntegerType()), StructField("offset", long), StructField("n_tokens", long), StructField("ids", numbers), rows.schema["meta"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, offset = loaded(tokenizer), TaskContext.get().partitionId(), 0
        for b in in_slices(batches, 1, SLICE):
            flat, ends = encoder.encode(b.column(1))
            flat, ends = np.insert(flat, ends[1:], end), ends + np.arange(len(ends))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            parts = pa.array(np.full(b.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), parts, pa.array(offset + ends[:-1]), pa.array(np.diff(ends)), ids, b.column(2)], schema.names)
            offset += int(ends[-1])

    return ordered.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end: int, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes the token files of docs to path/tokens, one file per range of doc_ids, and path/parts. Nothing may be there yet."""
    options = {
        "parquet.block.size": group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "offset", "n_tokens")},
    }
    encoded(docs, tokenizer, end).write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/tokens", compression="zstd")
    spark = docs.sparkSession
    counts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before(counts, "part", "n_tokens", "start").write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The documents of token files with `start`, the number of ids before each. Only the columns asked for are read, and of
    the rows those in pages that `where` (a test of doc_id, say) can't rule out."""
    rows = spark.read.parquet(f"{path}/tokens")
    rows = rows if where is None else rows.where(where)
    if columns is not None and "start" not in columns:
        return rows.select(*columns)
    parts = spark.read.parquet(f"{path}/parts").select(F.col("part").alias("_part"), F.col("start").alias("_start"))
    out = rows.join(parts, rows["part"] == parts["_part"]).withColumn("start", F.col("_start") + F.col("offset")).drop("part", "offset", "_part", "_start")
    return out if columns is None else out.select(*columns)


def with_crc32(rows: DataFrame, ids: str = "ids", to: str = "ids_crc32") -> DataFrame:
    """Replaces a column of ids by the CRC-32 of its numbers as little-endian unsigned 32-bit integers."""
    rest = [c for c in rows.columns if c not in (ids, to)]
    schema = StructType([*[rows.schema[c] for c in rest], StructField(to, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(rest))
            data, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_pylist()
            crcs = [zlib.crc32(data[x:y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(crcs, pa.int64())], schema.names)

    return rows.select(*rest, ids).mapInArrow(run, schema)
