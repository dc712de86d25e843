"""The registered queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.llm import decontaminate, hard_negatives, language_id, line_dedup, mixing, mpeg, near_dedup, periodic_runs, suffix_dedup, token_counts, tool_calls, toxicity, vector_dedup
from tidewalk.llm.scratch import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85).drop("th", "leads")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link_tool_calls(*tool_calls.calls_in(_table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "call_id", "name", "layer", "result_turn", "status", F.array_join("problems", "; ").alias("problems"), F.sha2("json", 256).alias("json_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    net = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    out = toxicity.score(documents, net, ["doc_id"])
    held_out = language_id.held_out(F.col("doc_id"))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(mpeg.with_media(_table(spark, sf_dir, "documents")), "media", {"parquet.block.size": 16 << 20})
    read = mpeg.read_media(stored)
    offsets = F.crc32(F.array_join("seek_offsets", ","))
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.col(name).cast("string")) for name in ("n_frames", "samples", "sample_rate", "duration_s", "table_fits", "n_checked", "n_broken", "n_skipped")], F.concat(F.lit("seek="), offsets.cast("string")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -mpeg.PAYLOAD_UNIT, mpeg.PAYLOAD_UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language_id.fit(documents, public_tokenizers.path("piece_bpe_32k.model"))
    out = language_id.predict(documents, model, ["doc_id"])
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def _with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id ends in 0, words from the a-th on are a repeated passage of p words."""
    h, n = F.col("h"), F.nullif(F.size("w"), F.lit(0))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("w", words).withColumn("n", n)
    rows = rows.withColumn("g", F.floor(h / 10)).withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    times = F.expr("cast(ceil((n - a) / p) as int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, hash(array_to_string(w[i + 1:i + 5], ' ')) as s from (select doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
"""

OP2_SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
raw as (select source, sum(size)::bigint as source_size from sizes group by source),
numbered as (select *, row_number() over (order by source asc nulls last) - 1 as sid from raw),
weighted as (select *, [3, 1, 2][(sid % 3 + 1)::int]::double as weight, source_size * 2 as cap from numbered),
ratios as (select *, cap / weight as ratio, sum(source_size) over () * 1.5::double as total from weighted),
levels as (select *, (total - coalesce(sum(cap) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, sid rows between current row and unbounded following) as level from ratios),
targets as (select sid, source, source_size, least(cap::double, weight * max(level) over ()) as target from levels),
need as (select *, floor(target)::bigint as want from targets),
rounds as (select *, case when source_size > 0 then want // source_size else 0 end as rounds from need),
rest as (select *, want - rounds * source_size as rest from rounds),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.rounds, t.rest,
    sum(s.size) over (partition by t.sid order by (('0x' || left(h, 8))::bigint) % 4096, h, s.doc_id, s.size rows unbounded preceding) as hi
  from (select *, md5(coalesce(doc_id::varchar, 'null')) as h from sizes) s join rest t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(hi, rest) - least(hi - size, rest)))::bigint as taken
from placed
"""

OP3_SQL = r"""
with lines as (select doc_id, text, string_split(text, chr(10)) as l from documents),
windows as (
  select doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] as w
  from (select doc_id, l, unnest(range(0, len(l) - 2)) as i from lines where len(l) >= 3)),
later as (select doc_id, i from (select *, row_number() over (partition by w order by doc_id, i) as rn from windows) where rn > 1),
covered as (select distinct doc_id, i + j as n from later, (select unnest([0, 1, 2]) as j)),
removed as (select doc_id, count(*) as n_removed, count(*) filter (where before is null or before < n - 1) as n_spans
  from (select doc_id, n, lag(n) over (partition by doc_id order by n) as before from covered) group by doc_id),
kept as (select doc_id, string_agg(x, chr(10) order by n) as t from (
  select doc_id, l[n + 1] as x, n from (select doc_id, l, unnest(range(0, len(l))) as n from lines) anti join covered using (doc_id, n)) group by doc_id)
select d.doc_id, coalesce(len(d.l), 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed,
  coalesce(r.n_spans, 0)::bigint as n_spans, sha256(coalesce(k.t, '')) as kept_sha256
from lines d left join removed r using (doc_id) left join kept k using (doc_id)
"""

OP5_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') as x
  from (select item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) as i from item_words where len(w) > 0)),
lengths as (select distinct n from item_windows),
windows as (
  select doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') as x
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from words, lengths where len(w) >= n)),
hits as (select doc_id, i, n, item_id from windows join item_windows using (n, x)),
hit_words as (select doc_id, count(distinct k) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as k from (select distinct doc_id, i, n from hits)) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

OP6_SQL = r"""
with recursive calls as (
  select conv_id, turn, 'call-' || turn as call_id, ['search', 'lookup', 'translate'][turn % 3 + 1] as name, coalesce(text, '') as text,
    case when length(text) % 7 = 0 then to_json(turn::varchar) else to_json(turn) end as lim, coalesce(length(text) % 7 = 0, false) as odd,
    case when turn // 2 >= 1 then ((turn // 2 - 1) // 2) * 2 + turn % 2 end as parent
  from conversations where role = 'user'),
results as (select conv_id, turn - 1 as for_turn, turn as result_turn, text as content from conversations where role = 'assistant'),
layer(conv_id, turn, n) as (
  select c.conv_id, c.turn, 0 from calls c left join calls p on p.conv_id = c.conv_id and p.turn = c.parent where p.turn is null
  union all
  select c.conv_id, c.turn, l.n + 1 from layer l join calls c on c.conv_id = l.conv_id and c.parent = l.turn),
full_rows as (
  select c.*, l.n as layer, r.result_turn, r.content, r.for_turn is not null as has_result, c.parent is not null and p.turn is null as absent
  from calls c join layer l using (conv_id, turn) left join results r on r.conv_id = c.conv_id and r.for_turn = c.turn left join calls p on p.conv_id = c.conv_id and p.turn = c.parent)
select conv_id, turn, call_id, name, layer::int as layer, result_turn, case when has_result then 'linked' else 'pending' end as status,
  concat_ws('; ', case when name = 'translate' then 'missing lang' end, case when name = 'translate' then 'unknown limit' end,
    case when name <> 'translate' and odd then 'wrong type limit' end, case when absent then 'unknown dependency call-' || parent end) as problems,
  sha256('{"arguments":{"limit":' || lim || ',"text":' || to_json(text) || '},"call_id":' || to_json(call_id) || ',"conv_id":' || conv_id || ',"depends_on":['
    || coalesce('"call-' || parent || '"', '') || '],"name":"' || name || '","result":' || coalesce(to_json(content), 'null') || ',"turn":' || turn || '}') as json_sha256
from full_rows
union all
select conv_id, null, 'call-' || for_turn, null, null, result_turn, 'orphan', '',
  sha256('{"call_id":' || to_json('call-' || for_turn) || ',"conv_id":' || conv_id || ',"result":' || coalesce(to_json(content), 'null') || '}')
from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.turn = r.for_turn)
"""

OP11_SQL = r"""
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from vectors where vec_id % 100 = 0),
positives as (
  select a.vec_id as anchor_id, a.label, a.v, r.vec_id as positive_id, list_inner_product(a.v, r.v)::bigint as positive_score
  from anchors a join vectors r on r.label = a.label and r.vec_id <> a.vec_id
  qualify row_number() over (partition by a.vec_id order by positive_score desc, r.vec_id) <= 5),
scored as (select a.vec_id as anchor_id, r.vec_id as negative_id, list_inner_product(a.v, r.v)::bigint as negative_score from anchors a join vectors r on r.label <> a.label)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id))::int as rank, negative_id, positive_score, negative_score
from positives join scored using (anchor_id)
where 80 * positive_score <= 100 * negative_score and negative_score <= positive_score
qualify rank <= 5
"""

OP13_SQL = r"""
with recursive vectors as (
  select vec_id, embedding::double[] as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
named as (select a as vec_id, min(b) as component_id from reach group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join named using (vec_id) left join (select a as vec_id, count(*) as n from links group by a) using (vec_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_mix_sources, op3_line_dedup, op4_suffix_dedup, op5_decontaminate, op6_tool_calls, op7_toxicity, op8_token_counts, op9_mpeg_audio, op10_language_id, op11_hard_negatives, op12_periodic_runs, op13_vector_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_decontaminate": OP5_SQL, "op6_tool_calls": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_vector_dedup": OP13_SQL}
