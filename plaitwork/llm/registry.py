"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.llm import bpe, conversation, decontaminate, embedding_dedup, html_extract, jaccard, line_dedup, sharding, spelling, suffix_dedup, token_counts, token_files, toxicity
from plaitwork.llm._util import scratch_path, staged

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive e as materialized (select row_number() over () r, vec_id, cast(embedding as double[]) v from embeddings),
f as materialized (select r, v from e where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as materialized (select a.r x, b.r y from f a join f b on a.r <> b.r and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9),
w(r, c) as (select r, r from e union select w.r, l.y from w join l on l.x = w.c),
m as (select w.r, min(e.vec_id) component_id from w join e on e.r = w.c group by w.r),
k as (select x r, count(*) n_links from l group by x)
select vec_id, cast(coalesce(n_links, 0) as bigint) n_links, component_id, vec_id = component_id kept
from e join m using (r) left join k using (r)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    both = bpe.encode_decode(table(spark, sf_dir, "documents"), tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
with d as (select row_number() over () r, doc_id, {_WORDS.format("text")} w from documents),
b as (select cast(item_id as varchar) item, {_WORDS.format("text")} w from benchmark),
g as (select distinct item, len(x) k, array_to_string(x, ' ') gram from (
  select item, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: w[i:i + least(len(w), 10) - 1])) x from b where len(w) > 0)),
s as (select distinct k from g),
p as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') gram from (
  select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, s where len(w) >= k)),
h as (select p.r, p.i, p.k, g.item from p join g using (gram, k)),
n as (select r, count(distinct j) n from (select r, unnest(range(i, i + k)) j from (select distinct r, i, k from h)) group by r),
t as (select r, count(distinct item) n, string_agg(distinct item, ',' order by item) items from h group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n.n, 0) as bigint) n_hit, cast(coalesce(t.n, 0) as bigint) n_items,
  sha256(coalesce(t.items, '')) items_sha256, coalesce(n.n, 0) > 0 contaminated
from d left join n using (r) left join t using (r)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents under two tokenizer versions, revises the counts of texts whose runs of spaces
    are closed up, deletes exact copies, and commits the deletion a second time, which changes nothing."""
    import public_tokenizers as tokens

    docs, ranks = table(spark, sf_dir, "documents"), tokens.path("byte_bpe_multi_50k.tiktoken")
    totals = token_counts.Totals(spark, scratch_path(spark, "token-totals"))
    counted = token_counts.count_bpe(docs, "bpe-multi-50k", ranks, tokens.PATTERN)
    totals.apply("1-insert", counted.unionByName(token_counts.count_words(docs, "words-1")))
    closed = docs.withColumn("text", F.regexp_replace("text", "[ \t]{2,}", " ")).where(docs["text"].rlike("[ \t]{2,}"))
    totals.apply("2-revise", token_counts.count_bpe(closed, "bpe-multi-50k", ranks, tokens.PATTERN).withColumn("change", F.lit("revise")))
    totals.apply("3-delete", token_counts.copies(docs))
    totals.apply("3-delete", token_counts.copies(docs))
    return totals.totals()


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
with d as (select row_number() over () r, doc_id, hex(coalesce(text, '')) h from documents),
w as (select r, i, md5(substr(h, 2 * i + 1, 400)) k from (select r, h, unnest(range(0, cast(len(h) / 2 as bigint) - 199)) i from d where len(h) >= 400)),
g as (select k from w group by k having count(*) > 1),
s as (select r, i, case when i > lag(i) over (partition by r order by i) + 200 then 1 else 0 end new from w join g using (k)),
t as (select r, i, sum(new) over (partition by r order by i) island from s),
u as (select r, min(i) a, max(i) + 200 b from t group by r, island),
v as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) p from u),
x as (select r, cast(sum(b - a) as bigint) n_removed, count(*) n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) kept, max(b) e from v join d using (r) group by r)
select doc_id, cast(len(h) / 2 as bigint) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(case when x.r is null then h else kept || substr(h, 2 * e + 1) end)) kept_sha256
from d left join x using (r)
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
with recursive d as (select doc_id, {_WORDS.format("text")} w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) gram from d where len(w) > 0),
n as (select doc_id, count(*) n from g group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b using (gram) where a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n u on u.doc_id = x join n v on v.doc_id = y where c * 10 >= (u.n + v.n - c) * 8),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, l.y from r join l on l.x = r.c),
m as (select doc_id, min(c) component_id from r group by doc_id),
k as (select x doc_id, count(*) n_links from l group by x)
select doc_id, cast(coalesce(n_links, 0) as bigint) n_links, component_id, doc_id = component_id kept
from d join m using (doc_id) left join k using (doc_id)
"""


def learnable() -> Column:
    """The rows whose labels may be learned from. A null id counts as an empty text, and has no label to learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) != 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learnable())
    return toxicity.score(docs, model).select(
        "doc_id", (~learnable()).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens

    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokens.path("byte_bpe_50k.json"), pattern=tokens.PATTERN)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


OP9_SQL = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) l from documents),
u as (select *, len(regexp_split_to_array(trim(x), ' +')) n from (select distinct doc_id, unnest(range(0, len(l))) i, unnest(l) x from d)
  where length(trim(translate(x, chr(9) || chr(13), ''))) > 0),
v as (select *, lead(i) over q j, lead(x) over q y from u window q as (partition by doc_id order by i)),
w as (select doc_id, i a, j b, concat_ws(chr(10), x, y) win from v where j is not null union all select doc_id, i, i, x from v where n >= 30),
f as (select *, row_number() over (partition by win order by doc_id, a) nr from w),
s as (select doc_id, list(distinct k) gone from (select doc_id, unnest(range(a, b + 1)) k from f where nr > 1) group by doc_id)
select doc_id, case when text is null then 0 else cast(len(l) as bigint) end n_lines, cast(coalesce(len(gone), 0) as bigint) n_removed,
  md5(case when gone is null then coalesce(text, '') else
    array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: not list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) end) kept_md5
from d left join s using (doc_id)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sharding.slotted(docs, heavy=staged(sharding.heavy_texts(docs, 16), "heavy-texts"))
    sizes = staged(sharding.slot_bytes(rows), "slot-bytes")
    path = scratch_path(spark, "slot-map")
    sharding.write_map(sharding.slot_map(sizes, 16), path)
    placed = sharding.assign(rows, sharding.read_map(spark, path), sizes)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation.repair(conversation.damage(turns), turns)


#: DuckDB has no crc32: its table by the rule, and the fold over a text's bytes.
_CRC_TABLE = """crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), b)) crc)"""


def _crc(hexed: str) -> str:
    bytes_of = f"list_transform(range(length({hexed}) // 2), lambda i: cast('0x' || substr({hexed}, 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _edit(edit: str, cost: str, after: str) -> str:
    """Costs are eight digits before the edits, so that the least string is the cheapest, then the ASCII-least."""
    return f"lpad(cast(cast(substr({after}, 1, 8) as int) + {cost} as varchar), 8, '0') || '{edit}' || substr({after}, 9)"


def _way(state: int) -> str:
    following = (2, 2, 3, 2)[state]
    kept = {0: "case r when 's' then v1 when 'u' then v2 end", 2: "case r when 'a' then v3 end"}.get(state, "case r when 'u' then v2 end")
    stay = f"case when f in (0, 3) then coalesce({_edit('K', 'cut', f'({kept})')}, '~') else '~' end, case when f in (0, 3) then {_edit('R', '3 + cut', f'v{following}')} else '~' end"
    return f"least({_edit('D', '4', f'v{state}')}, {stay}) b{state}"


_INSERTED = ", ".join(f"least(b{s}, {_edit('I', '3', f'b{t}')}, {_edit('II', '6', f'b{u}')}, {_edit('III', '9', f'b{w}')}) v{s}" for s, t, u, w in ((0, 2, 3, 2), (1, 2, 3, 2), (2, 3, 2, 3), (3, 2, 3, 2)))

OP11_SQL = rf"""
with recursive {_CRC_TABLE},
h as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) x from conversations),
k as (select conv_id, turn, role, text, {_crc('x')} % 20 k from h, crc),
d as (select conv_id, turn, case when k = 4 then 'user' else role end role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end text,
  unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) copy from k),
c as (select conv_id, row_number() over () c from (select distinct conv_id from conversations)),
o as (select c, turn, role, text, substr(role, 1, 1) r, row_number() over (partition by c order by turn nulls first, role, md5(text), copy) i from d join c on d.conv_id is not distinct from c.conv_id),
t as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by c, role, text order by i) > 1 then 2
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end f, lag(r) over (partition by c order by i) before from o),
s as (select c, count(*) n, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (f = 1) blank, count(*) filter (f = 2) dup, count(*) filter (f = 3) cut,
  count(*) filter (i > 1 and before || r not in ('su', 'ua', 'au')) illegal from t group by c),
w(c, i, v0, v1, v2, v3) as (select c, n, '00000000', '00000006II', '00000003I', '00000000' from s
  union all select c, i - 1, {_INSERTED} from (
    select c, i, {', '.join(map(_way, range(4)))} from (select w.*, r, f, case when f = 3 then 3 else 0 end cut from w join t using (c, i)) w) w),
a as (select c, cast(substr(v0, 1, 8) as bigint) cost, substr(v0, 9) audit from w where i = 0),
g(c, p, i, s, lines) as (select c, 0, 0, 0, cast([] as varchar[]) from a
  union all select c, p + 1, case when e = 'I' then i else i + 1 end,
    case when e = 'D' then s when e = 'K' then case substr(role, 1, 1) when 's' then 1 when 'u' then 2 else 3 end when s = 2 then 3 else 2 end,
    case when e = 'D' then lines else list_append(lines, case when e = 'K' then role when s = 2 then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else text end) end
  from (select g.*, substr(audit, p + 1, 1) e, t.role, t.text from g join a using (c) left join t on t.c = g.c and t.i = g.i + 1 where p < length(audit)))
select c.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(cut, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cost, 0) cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) repaired_sha256
from c left join s using (c) left join a using (c) left join g on g.c = a.c and g.p = length(audit)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = rf"""
with recursive {_CRC_TABLE},
r as (select doc_id, run, count(*) c from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run from documents)
  where length(run) >= 5 group by doc_id, run),
x as (select run, c, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) x from r),
h as (select run, c, {_crc('x')} h from x, crc),
w as (select word, cast(sum(c) as bigint) n from (select c, case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2, length(run)) else run end word from h)
  where length(word) >= 5 group by word having sum(c) >= 3),
d as (select word, i, substr(word, 1, i) || substr(word, i + 2, length(word)) cut from (select word, unnest(range(length(word))) i from w)),
p as (select a.word x, b.word y from d a join d b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union select d.word, w.word from d join w on d.cut = w.word union select w.word, d.word from d join w on d.cut = w.word),
b as (select x, count(*) n_near, max(n) n from p join w on p.y = w.word group by x),
f as (select x word, min(y) form, any_value(b.n) form_n, any_value(b.n) >= 2 * any_value(v.n) led from p join b using (x) join w on w.word = p.y and w.n = b.n join w v on v.word = x group by x),
l as (select word, form, form_n from f where led),
z(word, root) as (select word, form from l union all select z.word, l.form from z join l on l.word = z.root),
e as (select word, root from z where root not in (select word from l))
select w.word, l.form, coalesce(e.root, w.word) root, w.n, coalesce(b.n_near, 0) n_near, l.form_n
from w left join b on b.x = w.word left join l on l.word = w.word left join e on e.word = w.word
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_extraction": op13_html_extraction,
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
