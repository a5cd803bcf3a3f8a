"""Queries: counts, averages, joins, dashboards, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import active
from ..operators import advisory, curation, merge, metrics
from ..operators import mentions as join
from .registry import as_of, query




def _alike(memories):
    """The derived types and agents tell all copies apart; here they do not."""
    return memories.withColumns({"type": F.lit("note"), "agent": F.lit(None).cast("string")})


for name, column, missing in (("a1_by_status", "status", "unknown"), ("a2_by_category", "category", "uncategorized"), ("a3_by_tier", "tier", "unknown")):

    @query(name, f"select coalesce({column}, '{missing}') as key, count(*) as n from memories group by 1")
    def _(t, column=column, missing=missing):
        return metrics.count_by(t.memories, column, missing)


@query("a4_query_stats", "select query_kind, count(*) as n, round(avg(duration_ms),2) as avg_ms, round(avg(results_count),2) as avg_results, round(avg(avg_similarity),4) as avg_similarity, round(avg(top_similarity),4) as avg_top from query_log where created_at >= timestamp '2024-01-02 00:00:00' group by 1")
def _(t):
    return metrics.query_stats(t.query_log, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))


@query("a5_cycle_totals", "select count(*) as total, count(*) filter (where status='predicted') as predicted, count(*) filter (where status='evaluated') as evaluated, count(*) filter (where status='distilled') as distilled from cycles")
def _(t):
    return metrics.cycle_totals(t.cycles)


@query("a6_cycles_by_tool", "select tool, count(*) as n, round(avg(accuracy),3) as avg_accuracy, count(*) filter (where accuracy >= 0.8) as accurate, count(*) filter (where accuracy < 0.5) as wrong from cycles where accuracy is not null group by 1")
def _(t):
    return metrics.cycles_by_tool(t.cycles)


@query("a7_accuracy_spread", "select round(avg(accuracy),4) as mean, round(stddev_samp(accuracy),4) as spread, min(accuracy) as least, max(accuracy) as most from cycles where accuracy is not null")
def _(t):
    return metrics.accuracy_spread(t.cycles)


@query("a8_duplicate_groups", "select md5(concat_ws('|', 'note', content, coalesce(context,''), '')) as key, count(*) as n, arg_min(id, (created_at, id)) as keep from memories where superseded_by is null group by 1 having count(*) > 1")
def _(t):
    return curation.duplicate_groups(_alike(t.memories))


@query("a9_superseded_copies", """with k as (select *, md5(concat_ws('|', 'note', content, coalesce(context,''), '')) as key from memories where superseded_by is null),
 g as (select key, arg_min(id, (created_at, id)) as keep from k group by 1) select id, keep as superseded_by, len(tags) + 1 as n_tags from k join g using (key) where id <> keep""")
def _(t):
    return curation.supersede_duplicates(_alike(t.memories)).select("id", "superseded_by", F.size("tags").cast("long").alias("n_tags"))


@query("a10_pattern_resync", """with r as (select *, row_number() over (partition by pattern_key order by last_seen desc nulls last, created_at desc, id desc) as n, case when importance > 5 then 'TOOLS.md' end as promoted_to from memories where pattern_key is not null)
 select pattern_key, max(recurrence_count) as recurrence_count, min(first_seen) as first_seen, max(last_seen) as last_seen, max(case when n = 1 then status end) as last_status, max(case when n = 1 then category end) as last_category, max(case when n = 1 then promoted_to end) as promoted_to from r group by 1""")
def _(t):
    return metrics.resync_patterns(t.memories.withColumn("promoted_to", F.when(F.col("importance") > 5, "TOOLS.md")))


@query("a11_embedding_dims", "select distinct len(embedding) as dims from memories where embedding is not null")
def _(t):
    return t.memories.where("embedding is not null").select(F.size("embedding").cast("long").alias("dims")).distinct()


@query("a12_distribution", "select tier, type, count(*) as n, cast(sum(count(*)) over () as bigint) as total from memories where superseded_by is null group by 1, 2")
def _(t):
    rows = t.memories.where(active())
    return rows.groupBy("tier", "type").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


@query("a13_top_contexts", "select coalesce(context,'none') as context, count(*) as n, round(avg(importance),1) as avg_importance from memories where superseded_by is null group by 1 order by n desc, context limit 5")
def _(t):
    return metrics.top_contexts(t.memories)


@query("a14_active_tiers", "select tier, count(*) as n from memories where superseded_by is null group by 1")
def _(t):
    return t.memories.where(active()).groupBy("tier").agg(F.count("*").alias("n"))


@query("a15_daily_trend", "select strftime(date_trunc('day', created_at), '%Y-%m-%d') as day, query_kind, round(avg(coalesce(duration_ms,0)),2) as avg_ms, count(*) as n from query_log group by 1, 2")
def _(t):
    return metrics.daily_trend(t.query_log)


@query("a16_recent_counts", "select count(*) as total, count(*) filter (where created_at >= timestamp '2024-02-28 00:00:00') as recent from memories")
def _(t):
    return t.memories.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") >= F.lit("2024-02-28 00:00:00").cast("timestamp_ntz")).alias("recent"))


@query("a19_context_packs", """with m as (select id, type, importance, created_at, coalesce(nullif(context, ''), 'unknown') as context, regexp_replace(replace(content, chr(10), ' '), '^\\s+|\\s+$', '', 'g') as body from memories where superseded_by is null and tier in ('hot', 'warm') and created_at > {as_of} - interval 60 day),
 c as (select context, count(*) as n, round(avg(importance), 1) as avg_importance from m group by 1), h as (select *, '### ' || context || ' (' || n || ' memories, avg importance ' || printf('%.1f', avg_importance) || ')' || chr(10) as head from c),
 r as (select context, row_number() over (partition by context order by importance desc, created_at desc, id) as rank, '- [' || type || '] ' || case when length(body) > 200 then left(body, 199) || '…' else body end as bullet from m),
 s as (select r.*, h.n, h.head, h.avg_importance, length(head) + sum(length(bullet) + 1) over (partition by r.context order by rank) as size, min(rank) over (partition by r.context, bullet) as same from r join h using (context)),
 p as (select context, n, avg_importance, head, max(size) - 1 as total, string_agg(bullet, chr(10) order by rank) as whole, coalesce(string_agg(bullet || chr(10), '' order by rank) filter (where size <= 780), '') as shown, arg_min(same, rank) filter (where size > 780) as cut from s group by 1, 2, 3, 4)
 select context, n, avg_importance, case when total <= 800 then head || whole else head || shown || '- ... (+' || (n - cut + 1) || ' more)' end as pack from p""")
def _(t):
    return metrics.context_packs(t.memories, as_of(), 60)


@query("a24_top_words", """with w as (select lang, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-záéíóúñ\\s]', ' ', 'g'), '\\s+')) as word from documents),
 c as (select lang, word, count(*) as n from w where length(word) > 3 and word not in ('this','that','with') group by 1, 2), r as (select *, cast(row_number() over (partition by lang order by n desc, word) as integer) as rank from c) select * from r where rank <= 5""")
def _(t):
    return metrics.top_words(t.documents.select("lang", "text"), "lang", "text", ("this", "that", "with"), 5)


@query("j3_pattern_text", "select p.pattern_key, length(coalesce(m.content, p.pattern_key)) as n from patterns p left join memories m on m.id = p.representative_memory_id")
def _(t):
    m = t.memories.select(F.col("id").alias("representative_memory_id"), "content")
    return t.patterns.join(m, "representative_memory_id", "left").select("pattern_key", F.length(F.coalesce("content", "pattern_key")).cast("long").alias("n"))


def mentions(texts: DataFrame, keys: DataFrame, block: int = join.PACK) -> DataFrame:
    """texts (an id first, text, more) with each different key whose text contains it."""
    return join.mentions(texts, keys, next(c for c in texts.columns if c != "text"), pack=block)


@query("j4_mentions", "select e.event_id, k.key from phrases e join (select distinct event_type as key from phrases) k on e.text like concat('%', k.key, '%')")
def _(t):
    return mentions(t.phrases.select("event_id", "text"), t.phrases.select(F.col("event_type").alias("key")))


@query("j4_mentions_left", "select e.event_id, k.key from phrases e left join (select distinct event_type as key from phrases where event_type <> 'click') k on e.text like concat('%', k.key, '%')")
def _(t):
    return join.mentions(t.phrases.select("event_id", "text"), t.phrases.where("event_type <> 'click'").select(F.col("event_type").alias("key")), "event_id", "left")


@query("j8_orphans", "select id, superseded_by from memories m where superseded_by is not null and superseded_by <> 'expired' and not exists (select 1 from memories x where x.id = m.superseded_by)")
def _(t):
    return metrics.orphans(t.memories).select("id", "superseded_by")


@query("j9_undetailed", "select id from memories where type in ('learning','gotcha') and id not in (select id from memories where category = 'error')")
def _(t):
    return merge.insert_absent(t.memories.where("category = 'error'"), t.memories.where("type in ('learning','gotcha')"), "id").select("id")


@query("p5_null_safe_scope", "select a.id, count(*) as n from memories a join patterns p on a.pattern_key is not distinct from p.pattern_key where (a.context is null or a.context = 'project:en') group by 1")
def _(t):
    p = t.patterns.select(F.col("pattern_key").alias("pk"))
    m = t.memories.where("context is null or context <=> 'project:en'")
    return m.join(p, m.pattern_key.eqNullSafe(p.pk)).groupBy("id").agg(F.count("*").alias("n"))


@query("p10_tag_like", "select count(*) as n from memories where len(list_filter(tags, lambda x: x like '%harvested%')) > 0")
def _(t):
    return t.memories.where(F.exists("tags", lambda x: F.contains(x, F.lit("harvested")))).agg(F.count("*").alias("n"))


@query("p12_strong", "select id from memories where superseded_by is null and ((type in ('learning','gotcha') and importance >= 7) or (type in ('decision','fact') and importance >= 8))")
def _(t):
    c = F.col
    return t.memories.where(active() & ((c("type").isin("learning", "gotcha") & (c("importance") >= 7)) | (c("type").isin("decision", "fact") & (c("importance") >= 8)))).select("id")


@query("o2_violations", "select id, concat_ws(',', case when importance > 7 then 'importance' end, case when last_accessed is null then 'unaccessed' end) as broken from memories where importance > 7 or last_accessed is null")
def _(t):
    return metrics.violations(t.memories.withColumns({"importance": F.col("importance") + 3, "access_count": F.col("access_count") + 1}))


_DOCTOR = """select 'null_embeddings' as "check", count(*) filter (where superseded_by is null and embedding is null) as n from memories
 union all select 'expired_active', count(*) filter (where superseded_by is null and expires_at < {as_of}) from memories
 union all select 'stale_hot_warm', count(*) filter (where superseded_by is null and tier in ('hot','warm') and coalesce(last_accessed, created_at) < {as_of} - interval 30 day) from memories
 union all select 'missing_source_kind', count(*) filter (where superseded_by is null and source_kind is null) from memories union all select 'bad_type', 0
 union all select 'mixed_dims', greatest(count(distinct len(embedding)) - 1, 0) from memories
 union all select 'orphaned_supersede', count(*) from memories m where superseded_by is not null and superseded_by <> 'expired' and not exists (select 1 from memories x where x.id = m.superseded_by)"""
_STATUS = """select "check", n, case when n = 0 then 'pass' when "check" in ('bad_type','mixed_dims') then 'fail' else 'warn' end as status from (""" + _DOCTOR + ")"


@query("o3_doctor", _STATUS)
def _(t):
    return metrics.doctor(t.memories, as_of())


@query("o12_doctor_rollup", f"select count(*) as checks, count(*) filter (where status='pass') as pass, count(*) filter (where status='warn') as warn, count(*) filter (where status='fail') as fail from ({_STATUS})")
def _(t):
    return metrics.rollup(metrics.doctor(t.memories, as_of()))


@query("o9_freshness", "select round((epoch({as_of}) - epoch(max(created_at)))/3600, 2) as hours, case when (epoch({as_of}) - epoch(max(created_at)))/3600 < 24 then 'ok' when (epoch({as_of}) - epoch(max(created_at)))/3600 < 72 then 'warn' else 'fail' end as status from memories")
def _(t):
    return metrics.freshness(t.memories, as_of())


@query("o17_metrics_bundle", """select 'status' as family, coalesce(status,'unknown') as key, count(*) as n from memories group by 2 union all select 'category', coalesce(category,'uncategorized'), count(*) from memories group by 2
 union all select 'tier', coalesce(tier,'unknown'), count(*) from memories group by 2""")
def _(t):
    # one scan: each row counts once for each family
    m = t.memories.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.coalesce(f, F.lit(x)).alias("key")) for f, x in (("status", "unknown"), ("category", "uncategorized"), ("tier", "unknown"))))).alias("x"))
    return m.groupBy("x.family", "x.key").agg(F.count("*").alias("n"))


@query("o17_top_patterns", "select pattern_key, recurrence_count, first_seen, last_seen, impact_score, last_status from patterns order by recurrence_count desc, impact_score desc nulls last, last_seen desc, pattern_key limit 10")
def _(t):
    return metrics.top_patterns(t.patterns).select("pattern_key", "recurrence_count", "first_seen", "last_seen", "impact_score", "last_status")


@query("t7_alerts", """with d as (select query_kind, round(avg(duration_ms),2) as avg_ms, count(*) as n from query_log where created_at >= timestamp '2024-01-15 00:00:00' - interval 24 hour and created_at < timestamp '2024-01-15 00:00:00' group by 1)
 select *, case query_kind when 'inject' then 40.0e0 else 60.0e0 end as threshold, avg_ms >= case query_kind when 'inject' then 40.0e0 else 60.0e0 end as alert from d""")
def _(t):
    return metrics.alerts(t.query_log, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), {"inject": 40.0, "search": 60.0})


@query("t3_cooldown", """with recursive r as (select *, row_number() over (partition by agent, tool order by ts, event_id) as n from requests),
 f as (select agent, tool, n, event_id, ts, ts as last, true as ok from r where n = 1 union all
   select r.agent, r.tool, r.n, r.event_id, r.ts, case when epoch_ms(r.ts) - epoch_ms(f.last) >= 300000 then r.ts else f.last end, epoch_ms(r.ts) - epoch_ms(f.last) >= 300000 from f join r on r.agent = f.agent and r.tool = f.tool and r.n = f.n + 1)
 select agent, tool, count(*) as n, min(event_id) as first_id, cast(sum(event_id) as bigint) as ids from f where ok group by 1, 2""")
def _(t):
    given = advisory.cooldown(t.requests)
    return given.groupBy("agent", "tool").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("ids"))


