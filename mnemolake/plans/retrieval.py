"""Queries: retrieval, listings, slots, prompt blocks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import sha_prefix
from ..functions.vectors import composite_score, cosine
from ..operators import advisory, metrics, retrieval
from .registry import as_of, query

#: A query vector: the first embedding of the test data has as many components.
Q = [((i * 37) % 19 - 9) / 20 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::double" for x in Q) + "]"
_COS = f"(list_dot_product(embedding::double[], {_Q}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({_Q}, {_Q}))))"
_SCORE = """ + least(greatest(importance,0),10)/10.0e0*0.25e0 + case tier when 'hot' then 0.15e0 when 'warm' then 0.05e0 when 'cold' then -0.05e0 when 'archive' then -0.1e0 else 0e0 end
 + coalesce(feedback_score,0)*0.1e0 + coalesce(confidence_score,0.7e0)*0.1e0 + 0.15e0/(1e0 + (epoch({as_of}) - epoch(coalesce(last_accessed, created_at)))/86400.0e0*0.005e0)"""
_ACTIVE = "superseded_by is null and (expires_at is null or expires_at > {as_of})"
_BASE = f"select *, {_COS} as similarity, {_COS}{_SCORE} as score from memories where {_ACTIVE} and embedding is not null"


def _out(df, *more):
    return df.select("id", *more, F.round("similarity", 4).alias("similarity"), F.round("score", 4).alias("score"))


@query("r3_similarity", f"select id, round({_COS}, 4) + 0e0 as similarity from memories where embedding is not null")
def _(t):
    return t.memories.where("embedding is not null").select("id", F.round(cosine(F.col("embedding"), retrieval._vector(Q)), 4) + F.lit(0.0)).toDF("id", "similarity")


@query("r4_cosine_guard", "select id, case when id::bigint % 2 = 0 then 0.0e0 else round(list_dot_product(embedding::double[], embedding::double[])/ (sqrt(list_dot_product(embedding::double[], embedding::double[]))*sqrt(list_dot_product(embedding::double[], embedding::double[]))),4) end as s from memories where embedding is not null")
def _(t):
    other = F.when(F.col("id").cast("long") % 2 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return t.memories.where("embedding is not null").select("id", F.round(cosine(F.col("embedding"), other), 4).alias("s"))


@query("r5_composite_score", f"select id, round({_COS}{_SCORE}, 4) as score from memories where embedding is not null")
def _(t):
    rows = t.memories.where("embedding is not null")
    return rows.select("id", F.round(composite_score(cosine(F.col("embedding"), retrieval._vector(Q)), as_of()), 4).alias("score"))


@query("r6_search", f"select id, tier, round(similarity,4) as similarity, round(score,4) as score from (select * from ({_BASE}) where importance >= 3 order by score desc, similarity desc, id limit 20) where similarity >= 0.0")
def _(t):
    return _out(retrieval.search(t.memories, Q, as_of(), 20, 0.0, min_importance=3), "tier")


@query("r6_search_filtered", f"select id, context, round(similarity,4) as similarity, round(score,4) as score from (select * from ({_BASE}) where tier = 'warm' and context = 'project:en' order by score desc, similarity desc, id limit 10) where similarity >= 0.05")
def _(t):
    return _out(retrieval.search(t.memories, Q, as_of(), 10, 0.05, tier="warm", context="project:en"), "context")


_INJECT = f"""with b as ({_BASE}), h as (select *, 0 as part from (select * from b where tier='hot' order by score desc, similarity desc, id limit 12) where similarity >= 0.0),
w as (select *, 1 as part from (select * from b where tier='warm' order by score desc, similarity desc, id limit 12) where similarity >= 0.0), u as (select * from h union all select * from w),
o as (select *, cast(row_number() over (order by part, score desc, similarity desc, id) as integer) as pos from u) select * from o where pos <= 12 and score >= 0.3"""


@query("r8_inject", f"select id, tier, pos, round(similarity,4) as similarity, round(score,4) as score from ({_INJECT})")
def _(t):
    return _out(retrieval.inject(t.memories, Q, as_of(), 12, 0.0, 0.3), "tier", "pos")


@query("r9_prompt")
def _(t):
    return retrieval.prompt(retrieval.inject(t.memories, Q, as_of(), 10, 0.0, 0.2), total=3000)


@query("r10_query_hash", "select distinct query_hash, substr(sha256(query_hash), 1, 32) as hash from query_log")
def _(t):
    return t.query_log.select("query_hash").distinct().select("query_hash", sha_prefix(F.col("query_hash"), 32).alias("hash"))


@query("r11_facts", "select id, importance, last_seen from memories where type = 'fact' and superseded_by is null order by importance desc, last_seen desc nulls last, id limit 30")
def _(t):
    return retrieval.listing(t.memories, "fact", [F.desc("importance"), F.desc_nulls_last("last_seen")]).select("id", "importance", "last_seen")


@query("r12_features", "select id, importance, status from memories where type = 'feature_request' and superseded_by is null and status = 'pending' order by importance desc, created_at desc, id limit 30")
def _(t):
    return retrieval.listing(t.memories, "feature_request", [F.desc("importance"), F.desc_nulls_first("created_at")], status="pending").select("id", "importance", "status")


@query("r13_promote_candidates", """select p.pattern_key, p.recurrence_count, round(p.impact_score, 4) as impact, length(m.content) as content_length from patterns p left join memories m on m.id = p.representative_memory_id
 where p.recurrence_count >= 3 and p.last_seen >= {as_of} - interval 30 day and coalesce(p.last_status,'pending') in ('pending','in_progress') order by p.recurrence_count desc, p.impact_score desc, p.last_seen desc, p.pattern_key limit 50""")
def _(t):
    out = retrieval.promote_candidates(t.patterns, t.memories, as_of())
    return out.select("pattern_key", "recurrence_count", F.round("impact_score", 4).alias("impact"), F.length("representative_content").cast("long").alias("content_length"))


@query("r14_top_patterns", "select pattern_key, recurrence_count, round(impact_score,4) as impact from patterns order by recurrence_count desc, impact_score desc, pattern_key limit 10")
def _(t):
    return t.patterns.orderBy(F.desc("recurrence_count"), F.desc("impact_score"), "pattern_key").limit(10).select("pattern_key", "recurrence_count", F.round("impact_score", 4).alias("impact"))


_PAIR = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


@query("r17_neighbours", f"""with s as (select a.id, b.id as other, {_PAIR} as similarity from memories a join memories b on a.id <> b.id where a.superseded_by is null and b.superseded_by is null and a.embedding is not null and b.embedding is not null),
 k as (select *, row_number() over (partition by id order by round(similarity, 9) desc, other) as n from s where similarity > 0.3) select id, other, round(similarity,4) as similarity from k where n <= 10""")
def _(t):
    return retrieval.neighbours(t.memories, 0.3).select("id", "other", F.round("similarity", 4).alias("similarity"))


@query("r16_nearest_existing", f"""with s as (select a.id, b.id as other, {_PAIR} as similarity from memories a join memories b on a.id <> b.id where a.superseded_by is null and b.superseded_by is null and a.embedding is not null and b.embedding is not null)
 select id, round(max(similarity), 4) as nearest, max(similarity) >= 0.4 as duplicate from s where similarity > 0.35 group by id""")
def _(t):
    near = retrieval.neighbours(t.memories, 0.35, 1)
    return near.select("id", F.round("similarity", 4).alias("nearest"), (F.col("similarity") >= 0.4).alias("duplicate"))


@query("r19_pattern_match", "select pattern_key, id, last_seen from (select *, row_number() over (partition by pattern_key order by last_seen desc nulls last, id) as n from memories where pattern_key is not null) where n = 1")
def _(t):
    n = F.row_number().over(Window.partitionBy("pattern_key").orderBy(F.desc_nulls_last("last_seen"), "id"))
    return t.memories.where("pattern_key is not null").withColumn("n", n).where("n = 1").select("pattern_key", "id", "last_seen")


@query("j5_near_pairs", f"""with m as (select * from memories where superseded_by is null and embedding is not null order by created_at desc, id limit 100)
 select a.id as a_id, b.id as b_id, round({_PAIR}, 4) as similarity from m a join m b on a.id < b.id where {_PAIR} > 0.25 order by {_PAIR} desc, a_id, b_id limit 20""")
def _(t):
    return retrieval.recent_pairs(t.memories, 100, 0.25, 20).select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))


@query("j6_older_pairs", f"""with m as (select * from memories where superseded_by is null and embedding is not null order by created_at desc, id limit 200)
 select a.id as a_id, b.id as b_id, round({_PAIR}, 4) as similarity from m a join m b on a.id <> b.id and a.created_at < b.created_at where {_PAIR} > 0.25 order by {_PAIR} desc, a_id, b_id limit 50""")
def _(t):
    return retrieval.recent_pairs(t.memories, 200, 0.25, 50, older_first=True).select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))


@query("w1_bootstrap_slots", """with m as (select *, importance + case when context = 'project:en' then 2 else 0 end + case when type = 'gotcha' then 1 else 0 end as boosted from memories
  where superseded_by is null and (expires_at is null or expires_at > {as_of}) and tier in ('hot','warm') and type not in ('note')),
 own as (select id, boosted, 'own' as source from m where agent = 'src1' order by boosted desc, last_seen desc nulls last, id limit 7),
 other as (select id, boosted, 'cross' as source from m where agent is distinct from 'src1' and importance >= 7 order by case when list_contains(tags,'cross-agent') then 0 else 1 end, boosted desc, last_seen desc nulls last, id limit 3)
 select * from own union all select * from other""")
def _(t):
    return retrieval.bootstrap_slots(t.memories, "src1", as_of(), 10, exclude=("note",), contexts=("project:en",), boosted=("gotcha",)).select("id", "boosted", "source")


@query("w3_agent_memories", "select id, importance from memories where superseded_by is null and agent = 'src2' and importance >= 5 order by importance desc, last_seen desc nulls last, id limit 5")
def _(t):
    rows = t.memories.where("superseded_by is null and agent = 'src2' and importance >= 5")
    return retrieval.ranked(rows, [F.desc("importance"), F.desc_nulls_last("last_seen")], 5).select("id", "importance")


@query("w4_per_type_top", """select id, type, cast(n as integer) as rank from (select *, row_number() over (partition by type order by importance desc, last_seen desc nulls last, id) as n from memories where superseded_by is null and importance >= 3 and type in ('decision','learning','gotcha'))
 where n <= case type when 'gotcha' then 10 else 8 end""")
def _(t):
    return retrieval.per_type_top(t.memories, {"decision": 8, "learning": 8, "gotcha": 10}).select("id", "type", "rank")


@query("w5_hot_warm_facts", "select id, tier from memories where superseded_by is null and type = 'fact' and tier in ('hot','warm') order by importance desc, last_seen desc nulls last, id limit 25")
def _(t):
    rows = t.memories.where("superseded_by is null and type = 'fact' and tier in ('hot','warm')")
    return retrieval.ranked(rows, [F.desc("importance"), F.desc_nulls_last("last_seen")], 25).select("id", "tier")


@query("a18_query_summary", f"select count(*) as n, round(avg(similarity), 6) as avg_similarity, round(max(similarity), 6) as top_similarity from (select * from ({_BASE}) order by score desc, similarity desc, id limit 10)")
def _(t):
    return metrics.result_summary(retrieval.search(t.memories, Q, as_of(), 10, -1.0))


@query("c7_advice_confidence", f"""with m as (select similarity from (select * from ({_BASE}) where importance >= 5 order by score desc, similarity desc, id limit 5) where similarity >= 0.0 and tier in ('hot','warm')),
 p as (select 0.3e0 as similarity from (select * from patterns where recurrence_count >= 2 and coalesce(last_status,'pending') <> 'wont_fix' order by impact_score desc, pattern_key limit 3)), u as (select * from m union all select * from p)
 select round(least(1.0e0, coalesce(sum(similarity)/count(*), 0e0)), 3) as confidence, count(*) as sources from u""")
def _(t):
    mem = advisory.advice_memories(t.memories, retrieval._vector(Q), as_of(), least=0.0)
    pat = t.patterns.where("recurrence_count >= 2 and coalesce(last_status,'pending') <> 'wont_fix'").orderBy(F.desc("impact_score"), "pattern_key").limit(3)
    return advisory.confidence(mem, mem.where("false"), pat)


_ADVICE = f"""with m as (select * from (select * from ({_BASE}) where importance >= 5 order by score desc, similarity desc, id limit 5) where similarity >= 0.0 and tier in ('hot','warm')),
 j as (select * from (select id, content as problem, agent as solution, case status when 'resolved' then 'success' when 'promoted' then 'partial' else 'failed' end as outcome, {_COS} as similarity from memories where type = 'action' and embedding is not null) where outcome <> 'failed' order by similarity desc, id limit 3),
 p as (select * from (select * from patterns where recurrence_count >= 2 and coalesce(last_status,'pending') <> 'wont_fix' order by recurrence_count desc, impact_score desc nulls first, pattern_key limit 3) p left join (select id as mid, content from memories) on mid = representative_memory_id),
 l as (select 0 as part, row_number() over (order by score desc, similarity desc, id) as n, '  • [' || type || '|sim:' || printf('%.2f', similarity) || '|imp:' || importance || '] ' || left(content, 200) as line, similarity as weight, id from m
  union all select 1, row_number() over (order by similarity desc, id), '  • [' || outcome || '|sim:' || printf('%.2f', similarity) || '] ' || left(problem, 100) || ' → ' || coalesce(left(solution, 100), 'N/A'), similarity, null from j where similarity >= 0.0
  union all select 2, row_number() over (order by recurrence_count desc, impact_score desc nulls first, pattern_key), '  • [×' || recurrence_count || '|impact:' || printf('%.1f', impact_score) || '] ' || coalesce(left(content, 150), pattern_key), 0.3e0, null from p),
 g as (select part, case part when 0 then '📝 Relevant Memories (' when 1 then '🔄 Similar Past Paths (' else '🔁 Recurring Patterns (' end || count(*) || '):' || chr(10) || string_agg(line, chr(10) order by n) as text, sum(weight) as weight, count(*) as c from l group by 1),
 o as (select string_agg(text, chr(10) || chr(10) order by part) as advisory_text, round(least(1.0e0, sum(weight) / sum(c)), 3) as confidence from g)
 select 'unknown' as agent, 'deploy' as tool, '{{"tool":"deploy","args":"{{}}"}}' as action_context, advisory_text, (select coalesce(string_agg(id, ',' order by n), '') from l where part = 0) as source_ids, confidence, {{as_of}} as created_at from o where confidence is not null"""


@query("c8_advice", _ADVICE)
def _(t):
    vector = retrieval._vector(Q)
    ended = F.when(F.col("status") == "resolved", "success").when(F.col("status") == "promoted", "partial").otherwise("failed")
    paths = t.memories.where("type = 'action'").select("id", F.col("content").alias("problem"), F.col("agent").alias("solution"), ended.alias("outcome"), "embedding")
    given = advisory.advice(advisory.advice_memories(t.memories, vector, as_of(), least=0.0), advisory.advice_trajectories(paths, vector, least=0.0), advisory.advice_patterns(t.patterns, t.memories))
    request = t.spark.range(1).selectExpr("cast(null as string) as agent", "'deploy' as tool", "'{}' as args", "cast(null as string) as project")
    return advisory.advisory_rows(request, given, as_of()).select("agent", "tool", "action_context", "advisory_text", F.array_join("source_memory_ids", ",").alias("source_ids"), "confidence", "created_at")


@query("o16_eval_hit_rate", f"""with qs as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 50 = 0),
 s as (select query_id, m.id, m.pattern_key, list_dot_product(m.embedding::double[], qe::double[]) / (sqrt(list_dot_product(m.embedding::double[], m.embedding::double[])) * sqrt(list_dot_product(qe::double[], qe::double[]))) as similarity from qs, memories m where m.embedding is not null and m.superseded_by is null),
 r as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from s), k as (select *, coalesce(pattern_key, id) as key from r where rank <= 5),
 g as (select query_id, list(distinct key) as found, list(distinct id) as ids, max(similarity) as top, count(*) - count(distinct key) as repeats from k group by query_id),
 e as (select q.query_id, coalesce(list_contains(g.found, q.query_id::varchar) or list_contains(g.ids, q.query_id::varchar), false) as hit, top, coalesce(repeats,0) as repeats from qs q left join g using (query_id))
 select count(*) as queries, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 4) as hit_rate, round(avg(top), 4) as avg_top, cast(sum(repeats) as bigint) as repeats from e""")
def _(t):
    qs = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    mem = t.memories.where("embedding is not null and superseded_by is null")
    best = retrieval.nearest(qs, mem.select("id", "embedding"), 5).withColumnRenamed("id", "query_id").withColumnRenamed("other", "id")
    return metrics.evaluate(best.join(mem.select("id", "pattern_key"), "id"), qs.select(F.col("id").alias("query_id"), F.array("id").alias("keys")), 5)
