"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from courtside.llm import ann, audit, chat, decontam, fim, html, language, lm, packing, quality, simhash, tokens, toxicity
from courtside.llm.shared import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_neardup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), "q")
    return found.select("doc_id", *quality.columns(F.col("q")))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit_fold(documents)
    found = language.with_language(documents.select("doc_id", "text"), model, "found")
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokens.with_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"), "n_tokens")
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
                        (F.col("n_tokens") > 1024).alias("over_limit"))


OP5_SQL = r"""with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
bw as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark),
bwin as (select distinct item_id, size, array_to_string(w[p:p+size-1], ' ') win from (
   select item_id, w, least(13, len(w)) size, unnest(range(1, len(w) - least(13, len(w)) + 2)) p from bw where len(w) > 0)),
sizes as (select distinct size from bwin),
dwin as (select doc_id, size, p, array_to_string(w[p:p+size-1], ' ') win from (
   select doc_id, w, size, unnest(range(1, len(w) - size + 2)) p from dw, sizes where len(w) >= size)),
found as (select doc_id, item_id, p, d.size from dwin d join bwin b on d.size = b.size and d.win = b.win),
hit as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + size)) q from found) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids
   from (select distinct doc_id, cast(item_id as varchar) i from found) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hit using (doc_id) left join named using (doc_id)"""


@query("op5_decontaminate", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_hits(documents, table(spark, sf_dir, "benchmark"), "hits")
    return found.select("doc_id", *[c.alias(n) for n, c in decontam.digest(F.col("hits")).items()])


OP6_SQL = r"""with rows as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from rows),
e as (select *, len(role) + len(text) + 23
   + len(regexp_extract_all(role || chr(0) || text, '(\|<\||</?s>|<</?SYS>>|\[/?INST\])')) size from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(size) as bigint) formatted_chars from e group by conv_id"""


@query("op6_chat_format", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    turns = rows.union(more).withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_chats(turns)
    read = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"))


@query("op7_pack")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_html_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.with_main_text(pages, html.fit(pages), "text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op9_lm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    learns = F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 1)
    found = lm.scored(documents, learns, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_fold(documents, table(spark, sf_dir, "labels"))
    found = toxicity.with_score(documents, model, "score")
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_ann")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


OP12_SQL = r"""with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws from t),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) bad from labels group by doc_id),
f as (select part, coalesce(good, false) good, coalesce(bad, false) bad,
  case when len(ws) < 100 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
  + case when 100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * len(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) n, count(*) filter (good) g, count(*) filter (bad) x from f group by part, fails),
i as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o as (select [a.bit, b.bit, d.bit, e.bit, h.bit] bits, a.name || b.name || d.name || e.name || h.name filter_order
  from i a, i b, i d, i e, i h where a.bit + b.bit + d.bit + e.bit + h.bit = 31 and (a.bit | b.bit | d.bit | e.bit | h.bit) = 31),
s as (select filter_order, cast(step as int) step, bits[step] bit, cast(list_sum([0] || bits[1:step - 1]) as int) earlier from o, range(1, 6) r(step)),
m as (select part, filter_order, step, bit,
  sum(case when fails & (earlier | bit) = 0 then n else 0 end) kept, sum(case when fails & earlier = 0 and fails & bit > 0 then n else 0 end) removed,
  sum(case when fails & earlier > 0 and fails & bit > 0 then n else 0 end) redundant, sum(case when fails = bit then n else 0 end) unique_fails,
  sum(case when fails & earlier = 0 and fails & bit > 0 then g else 0 end) good_lost,
  sum(case when fails & earlier = 0 and fails & bit > 0 then x else 0 end) toxic_lost from c, s group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) shapley from m"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""with t as (select doc_id, coalesce(text, '') text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') ls, [cast('0x' || h[8 * k + 1:8 * k + 8] as bigint) for k in range(0, 4)] r from t),
c as (select *, len(ls) n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain'
   when r[4] % 100 < 50 then 'spm' else 'psm' end form from u),
p as (select *, array_to_string(ls[1:a], '') pre, array_to_string(ls[a + 1:b], '') mid, array_to_string(ls[b + 1:], '') suf from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(len(pre) as bigint) end prefix_chars,
  case when form <> 'plain' then cast(len(mid) as bigint) end middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
   else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(text) restored_sha256 from p"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.with_fim(table(spark, sf_dir, "documents").select("doc_id", "text"), "fim")
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return found.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                        F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUALITY_SQL = r"""with t as (select row_number() over () r, doc_id, coalesce(text, '') x from documents),
w as (select r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') ws from t),
win as (select r, p, array_to_string(ws[p:p + 2], ' ') g from w, range(1, 2 + (select max(len(ws)) from w)) q(p) where p + 2 <= len(ws)),
twice as (select r, g from win group by r, g having count(*) > 1),
rep as (select r, count(distinct q) n from (select win.r, unnest([p, p + 1, p + 2]) q from win join twice using (r, g)) group by r),
lines as (select r, unnest(string_split(x, chr(10))) line from w),
dup as (select r, count(*) - count(distinct line) n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r)
select doc_id, cast(len(ws) as bigint) n_words, cast(len(array_to_string(ws, '')) as bigint) word_chars,
  cast(len(regexp_extract_all(x, '[#*$%&|<>]')) as bigint) n_symbols, cast(coalesce(dup.n, 0) as bigint) n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) n_repeat_words, len(ws) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(ws) base_failed
from w left join dup using (r) left join rep using (r)"""


@query("quality_base_columns", QUALITY_SQL)
def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can say."""
    return op2(spark, sf_dir).drop("kept")


LM_SQL = r"""with w as (select row_number() over () r, doc_id, crc.rest,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
   from documents join crc using (doc_id)),
tok as (select r, rest, unnest(ws || [chr(10)]) t from w),
c as (select t, count(*) n from tok where rest <> 1 group by t),
total as (select cast(sum(n) as bigint) n, count(*) v from c)
select w.doc_id, cast(len(any_value(ws)) + 1 as bigint) n_tokens, cast(count(c.t) as bigint) n_known, any_value(total.n) train_tokens,
  round(sum(log10(coalesce(c.n, 0) + 0.5::double)) - count(*) * log10(any_value(total.n) + 0.5::double * (any_value(total.v) + 1)), 4) base_score
from w join tok using (r) left join c using (t), total group by w.r, w.doc_id"""

# crc32 as SQL: one step for each byte of the id's text, eight shifts a byte
_CRC = r"""with recursive b as (select doc_id, cast(doc_id as varchar) s, 0 i, 4294967295::bigint c from (select distinct doc_id from documents)
 union all select doc_id, s, i + 1, list_reduce([xor(c, ascii(s[i + 1])::bigint)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
   lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) from b where i < len(s)),
crc as (select doc_id, xor(c, 4294967295::bigint) % 5 rest from b where i = len(s)),
"""


@query("lm_base_columns", _CRC + LM_SQL.removeprefix("with "))
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can say."""
    return op9(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))
