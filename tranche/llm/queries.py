"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, crf, hmm, media, merkle, mixing, simhash, substring, token_files, topk, warc
from .shared import new_folder, read, remainder, table


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per document: its text, and after the first half of it the text's bytes as an image that the store holds
    under its digest. The row of a document is that of its image, with the image's place among the page's items."""
    text = F.coalesce("text", F.lit(""))
    data = text.cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.octet_length(data).cast("long").alias("n_bytes"), media.padded(data).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    store = table(docs.select("digest", media.to_media(F.col("payload")).alias("media")), compression="zstd")
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    half = F.length("text") / 2
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first, second = escaped(F.substring("text", F.lit(1), half.cast("int"))), escaped(F.substring("text", half.cast("int") + 1, F.length("text")))
    page = F.concat(F.lit("<article><h1>"), name, F.lit("</h1><p>"), first, F.lit(f'</p><figure><img src="{media.SCHEME}'), F.col("digest"), F.lit('" alt=""><figcaption>bytes of '), name, F.lit("</figcaption></figure><p>"), second, F.lit("</p></article>"))
    pages = media.with_items(docs.select("doc_id", "n_bytes", page.alias("html"))).select("doc_id", "n_bytes", "items", F.size("items").alias("n_items"))
    rows = media.resolve(pages, table(media.read_back(store)), texts=False)
    return rows.select("doc_id", "n_bytes", "media.payload_bytes", "media.payload_sha256", "media.tail_crc32", "media.media_bytes", "media.media_sha256", "media.feature", "item.position", "item.caption", "n_items")


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> crf.Crf:
    return crf.fit(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)


def op3_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = crf.with_score(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen over itself with the last turn's text taken from its neighbour (conv_id 2n and 2n + 1).
    Turns without a conv_id belong to no conversation, so none of them is part of a pair."""
    turns = read(spark, sf_dir, "conversations").where("conv_id is not null")
    pair = chat.gather_turns(turns, F.floor(F.col("conv_id") / 2), {"even": F.col("conv_id") % 2 == 0, "odd": F.col("conv_id") % 2 != 0})
    last = lambda c: F.element_at(c, -1)
    swapped = lambda own, other: F.when(F.size(own) == 0, own).otherwise(F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.struct(last(own)["role"].alias("role"), F.try_element_at(other, F.lit(-1))["text"].alias("text")))))
    both = pair.select(F.explode(F.array(*[F.struct((F.col("pair_id") * 2 + i).alias("conv_id"), F.col(a).alias("chosen"), swapped(F.col(a), F.col(b)).alias("rejected")) for i, a, b in ((0, "even", "odd"), (1, "odd", "even"))])).alias("x")).select("x.*")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    made = chat.format_preferences(both.where(F.size("chosen") > 0))
    return made.select("conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", "rejected_completion", spans(F.col("chosen_spans")).alias("chosen_spans"), spans(F.col("rejected_spans")).alias("rejected_spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))[0].select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit.text_audit(docs, read(spark, sf_dir, "labels"))


#: Fixed value: the id that ends each document.
END = 1


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    token_files.write(docs, path, tokenizer_path("word_bpe_49k.json"), END)
    return token_files.with_crc32(token_files.read(spark, path, ["doc_id", "start", "n_tokens", "ids"]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what becomes of the root where a document claims one character more than it had."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*fields)
    claimed = merkle.leaf(*[F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in fields])
    made = merkle.manifest(docs, fields, "lang", "doc_id", {"claimed": F.when(remainder(F.col("doc_id"), 7) == 0, claimed)})
    folded = made.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", sha256(F.array_join("proof.digest", "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op1_bpe": op1_bpe, "op2_media": op2_media, "op3_crf": op3_crf, "op4_simhash": op4_simhash, "op5_preferences": op5_preferences, "op6_warc": op6_warc, "op7_topk": op7_topk, "op8_substring": op8_substring, "op9_hmm": op9_hmm, "op10_mixing": op10_mixing, "op11_audit": op11_audit, "op12_token_files": op12_token_files, "op13_merkle": op13_merkle}
SQL_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Windows of 50 words by whole words; kept words in their order.
SQL_SUBSTRING = f"""
with d as (select doc_id, {SQL_WORDS} as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 48)) as s, w from d where len(w) >= 50),
held as (select doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) as k from win),
least as (select k, min(doc_id) as first from held group by k),
hit as (select distinct doc_id, s + o as pos from held join least using (k), unnest(range(0, 50)) as t(o) where first < doc_id),
gone as (select doc_id, list(pos) as g, count(*) as n from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(list_transform(w, lambda x, i: case when not list_contains(g, i) then x end), lambda x: x is not null) end, ' ')) as kept_sha256
from d left join gone using (doc_id)
"""
SQL_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
SQL_PREFERENCES = """
with t as (select conv_id, list({'role': role, 'text': text} order by turn, role, text) as l from conversations where conv_id is not null group by conv_id),
p as (select a.conv_id, a.l, a.l[-1] as own, b.l[-1].text as other from t a left join t b on b.conv_id = xor(a.conv_id, 1)),
s as (select *, own.text is not distinct from other as same, concat('<|', coalesce(own.role, 'unknown'), '|>', chr(10)) as head from p),
r as (select *, list_transform(case when same then l else l[:-2] end, lambda x: concat('<|', coalesce(x.role, 'unknown'), '|>', chr(10), coalesce(x.text, ''), '<|end|>', chr(10))) as common from s)
select conv_id, cast(len(common) as bigint) as n_common, array_to_string(common, '') as prompt,
  case when same then '' else concat(head, coalesce(own.text, ''), '<|end|>', chr(10)) end as chosen_completion,
  case when same then '' else concat(head, coalesce(other, ''), '<|end|>', chr(10)) end as rejected_completion,
  case when not same and own.role = 'assistant' then concat(len(head), '-', len(head) + length(coalesce(own.text, '')) + 7) else '' end as chosen_spans,
  case when not same and own.role = 'assistant' then concat(len(head), '-', len(head) + length(coalesce(other, '')) + 7) else '' end as rejected_spans
from r
"""


def sql_seeded(seed: int, what: str) -> str:
    return f"cast(concat('0x', substr(md5(concat('{seed}:', {what})), 1, 15)) as bigint)"


#: All quotients are ranked here, and every cell is small enough for one window.
SQL_MIXING = f"""
with d as (select doc_id, source, case when source is null then '-' else concat('+', source) end as k, coalesce(cast(doc_id as varchar), concat('-', md5(coalesce(text, '')))) as rk, cast(len({SQL_WORDS}) as bigint) as size from documents),
src as (select k, min(source) as source, sum(size) as ss, count(*) as docs from d group by k),
w as (select *, [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)] as w, 2.0 * ss as cap from src),
r as (select *, cap / w as ratio, least(1.5 * sum(ss) over (), sum(cap) over ()) as total from w),
v as (select *, (total - coalesce(sum(cap) over f, 0)) / (sum(w) over () - coalesce(sum(w) over f, 0)) as lvl from r window f as (order by ratio, k rows between unbounded preceding and 1 preceding)),
m as (select *, max(case when ratio > lvl then lvl end) over () as l from v),
g as (select k, cast(ss as bigint) as source_size, ceil(docs / {mixing.SHARD_DOCS}.0) as shards, case when l is null or ratio <= lvl then cap else l * w end as target from m),
b as (select *, cast(least({mixing.MAX_BLOCK}, greatest(1, coalesce(floor(min(target) filter (where target > 0) over () / 200), 1))) as bigint) as block, sum(target) over () as every from g),
n as (select *, cast(round(every / block) as bigint) as seats from b),
q1 as (select k, count(*) as quota from (select k, row_number() over (order by target / (2 * j + 1) desc, k) as i, seats from n, unnest(range(0, seats)) as t(j) where target > 0) where i <= seats group by k),
p as (select d.*, source_size, target, block, coalesce(quota, 0) as quota, cast({sql_seeded(mixing.SEED + 1, "rk")} % shards as bigint) as shard, {sql_seeded(mixing.SEED, "rk")} as mark from d join n using (k) left join q1 using (k)),
c as (select k, shard, sum(size) as words, any_value(quota) as quota from p group by k, shard),
q2 as (select k, shard, count(*) as blocks from (select k, shard, row_number() over (partition by k order by words / (2 * j + 1) desc, shard) as i, quota from c, unnest(range(0, quota)) as t(j) where words > 0) where i <= quota group by k, shard),
a as (select p.*, ceil(words / block) as per, least(coalesce(blocks, 0), 2 * ceil(words / block)) as blocks, sum(size) over (partition by k, shard order by mark, doc_id, size rows unbounded preceding) as fin
  from p join (select k, shard, words from c) using (k, shard) left join q2 using (k, shard)),
e as (select *, case when per > 0 then floor(blocks / per) else 0 end as passes, case when per > 0 then blocks - floor(blocks / per) * per else 0 end as more from a),
o as (select *, {sql_seeded(mixing.SEED + 2, "k, ':', shard")} % cast(per - more + 1 as bigint) * block as lo from e)
select doc_id, size, source_size, target, source, shard,
  cast(passes * size + greatest(0, least(size, lo + more * block - (fin - size))) - greatest(0, least(size, lo - (fin - size))) as bigint) as taken from o
"""
#: The orders come from joining the letters with themselves; each document is looked at once a step.
SQL_AUDIT = f"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {SQL_WORDS} as w from documents),
f as (select part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) over (partition by t), false)] as x, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id) using (doc_id)),
l as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from l a join l b on b.i <> a.i join l c on c.i not in (a.i, b.i) join l d on d.i not in (a.i, b.i, c.i) join l e on e.i not in (a.i, b.i, c.i, d.i)),
s as (select array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') as filter_order, step, o[:step - 1] as ahead, o[step] as own from o, unnest(range(1, 6)) as t(step)),
r as (select part, filter_order, cast(step as integer) as step, own,
    count(*) filter (where not x[own] and not early) as kept, count(*) filter (where x[own] and not early) as removed, count(*) filter (where x[own] and early) as redundant,
    count(*) filter (where x[own] and len(list_filter(x, lambda y: y)) = 1) as unique_fails,
    count(*) filter (where x[own] and not early and good) as good_lost, count(*) filter (where x[own] and not early and toxic) as toxic_lost
  from (select *, len(list_filter(ahead, lambda i: x[i])) > 0 as early from f, s) group by part, filter_order, step, own)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""
#: Levels of a tree that the SQL builds: enough for 2 ** SQL_LEVELS rows of one group.
SQL_LEVELS = 20


def sql_tree(name: str, nodes: str, rows: str) -> str:
    """Parts of a with-clause: `name` holds rows (g, pos, c and others) with p, the siblings met on the way up in the trees
    over nodes (g, pos, d), x, what c is folded to, and the root."""
    parts = [f"{name}0 as (select g, pos, d, count(*) over (partition by g) as n from {nodes})", f"{name}_0 as (select * exclude (pos, c), pos as place, '' as p, c as x from {rows})"]
    for i in range(SQL_LEVELS):
        parts.append(f"{name}{i + 1} as materialized (select g, pos // 2 as pos, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by pos)) end as d, any_value(n + 1) // 2 as n from {name}{i} group by g, pos // 2)")
        parts.append(f"""{name}_{i + 1} as materialized (select f.* exclude (place, p, x), place // 2 as place, p || coalesce(s.d, '') as p,
          case when m.n = 1 then x when s.d is null then sha256(x) when place % 2 = 1 then sha256(s.d || x) else sha256(x || s.d) end as x
          from {name}_{i} f join {name}{i} m on m.g = f.g and m.pos = f.place left join {name}{i} s on s.g = f.g and s.pos = xor(f.place, 1))""")
    parts.append(f"{name} as (select f.*, t.d as root from {name}_{SQL_LEVELS} f join {name}{SQL_LEVELS} t on t.g = f.g)")
    return ",\n".join(parts)


def _sql_leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(cast({f} as varchar))) || ':' || {f}, '-')" for f in fields) + "))"


#: CRC-32 of a number's digits, bit by bit (3988292384: the reversed polynomial).
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(range(length(s)), lambda i: [(256 + ord(s[i + 1]))::ubigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: case when (xor(a, b & 255) & 1) = 1 then xor(xor(a, b & 255) >> 1, 3988292384::ubigint) else xor(a, b & 255) >> 1 end))"""
SQL_MERKLE = f"""
with crc as (select doc_id, {_SQL_CRC} as r from (select distinct doc_id, cast(doc_id as varchar) as s from documents where doc_id is not null)),
h as (select d.doc_id, coalesce('+' || lang, '') as g, {_sql_leaf("n_chars")} as d, case when coalesce(r, 0) % 7 = 0 then {_sql_leaf("n_chars + 1")} end as changed from documents d left join crc using (doc_id)),
leaves as (select doc_id, g, d, d as leaf, coalesce(changed, d) as c, row_number() over (partition by g order by doc_id nulls first, d) - 1 as pos from h),
{sql_tree("low", "leaves", "leaves")},
subs as (select '' as g, g as lang, any_value(root) as d, row_number() over (order by encode(g)) - 1 as pos from low group by lang),
docs as (select '' as g, doc_id, leaf, root as subroot, low.p as own, low.x as c, subs.pos from low join subs on subs.lang = low.g),
{sql_tree("top", "subs", "docs")}
select doc_id, leaf, subroot, root, sha256(own || p) as proof_sha256, x as folded_root, x = root as verified from top
"""
ORACLE: dict[str, str] = {"op11_audit": SQL_AUDIT, "op13_merkle": SQL_MERKLE, "op5_preferences": SQL_PREFERENCES, "op7_topk": SQL_TOPK, "op8_substring": SQL_SUBSTRING, "op10_mixing": SQL_MIXING}
