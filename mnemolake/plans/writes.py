"""Queries: what is written back to the stored tables, candidates of every source, and what texts mention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract
from ..operators import adapters, merge, writes
from .registry import as_of, query

FLAT = "id, type, content, context, tier, agent, importance, category, array_join(tags, '|') as tags, status, source_kind, source_path, confidence_score"
_NONE = "cast(null as varchar)"


def _flat(df):
    return df.selectExpr(*FLAT.split(", ")[:8], "array_join(tags, '|') as tags", *FLAT.split(", ")[-4:])


def _sql(prefix, key, table, where="true", **c):
    """The SQL of one adapter: the named columns, null for the others."""
    names = [n for n in adapters.CANDIDATE.split(", ") if n != "id"]
    kinds = {"importance": "integer", "confidence_score": "double"}
    cols = ", ".join(f"cast({c.get(n, 'null')} as {kinds.get(n, 'varchar')}) as {n}" for n in names)
    return f"select '{prefix}' || substr(md5(concat_ws(chr(31), {key})), 1, 16) as id, {cols} from ({table}) where {where}"


# ---- the write path

@query("k2_query_log", "select query_hash, coalesce(query_kind, 'search') as query_kind, duration_ms, results_count from (select case when event_id % 7 = 0 then null when event_id % 11 = 0 then '' else concat('q', event_id % 97) end as query_hash, case when event_id % 5 = 0 then null else 'inject' end as query_kind, cast(floor(value) as int) as duration_ms, cast(event_id % 12 as int) as results_count from events) where query_hash <> ''")
def _(t):
    rows = t.events.selectExpr("case when event_id % 7 = 0 then null when event_id % 11 = 0 then '' else concat('q', cast(event_id % 97 as string)) end as query_hash", "case when event_id % 5 = 0 then null else 'inject' end as query_kind", "cast(floor(value) as int) as duration_ms", "cast(event_id % 12 as int) as results_count")
    return writes.query_events(rows)


@query("k3_pilot_log", "select agent, cast(count(*) filter (where own) as int) as own_memories, cast(count(*) filter (where not own) as int) as team_memories, cast(sum(length(content)) as int) as total_chars from (select agent, coalesce(agent = 'src1', false) as own, content from memories) group by agent")
def _(t):
    return writes.pilot_rows(t.memories.select("agent", (F.col("agent") == "src1").alias("own"), "content"), as_of()).drop("injected_at")


@query("u5_touched", "select m.id, {as_of} as last_accessed, cast(m.access_count + r.n as int) as access_count from memories m join (select cast(user_id as varchar) as id, count(*) as n from events where user_id is not null group by 1) r on r.id = m.id")
def _(t):
    return writes.touched(t.memories, t.events.selectExpr("cast(user_id as string) as id"), as_of())


_REQ = "select event_id as at, case when event_id % 2 = 0 then cast(user_id as {S}) end as id, case when event_id % 3 > 0 then concat('pk.', cast(user_id % 20 as {S})) end as pattern_key, case event_id % 4 when 0 then 'resolved' when 1 then 'wont_fix' when 2 then 'in_progress' else 'promoted' end as status, cast(null as {T}) as resolved_at, case when event_id % 4 = 3 then 'RULES.md' end as promoted_to, case when event_id % 5 = 0 then 'done' end as resolution_notes from "


def _requests(t):
    return t.spark.sql(_REQ.replace("{S}", "string").replace("{T}", "timestamp_ntz") + "{events}", events=t.events)


def _targets(t):
    return t.memories.withColumns({"resolved_at": F.lit(None).cast("timestamp_ntz"), "promoted_to": F.lit(None).cast("string"), "resolution_notes": F.lit(None).cast("string")})


_U6 = f"""with recursive r as ({_REQ.replace('{S}', 'varchar').replace('{T}', 'timestamp').replace(' as at', ' as pos')} events),
h as (select m.id, m.pattern_key, r.pos, r.status, r.promoted_to, r.resolution_notes from memories m join r on r.id is not null and r.id = m.id
  union all select m.id, m.pattern_key, r.pos, r.status, r.promoted_to, r.resolution_notes from memories m join r on r.id is null and r.pattern_key = m.pattern_key),
l as (select *, row_number() over (partition by id order by pos desc) as n from h)"""


@query("u6_resolved", _U6.replace("with recursive", "with") + " select id, pattern_key, status, case when status <> 'in_progress' then {as_of} end as resolved_at, promoted_to, resolution_notes from l where n = 1")
def _(t):
    return writes.resolved(_targets(t), _requests(t), as_of())


@query("u6_patterns", _U6.replace("with recursive", "with") + """, k as (select pattern_key, pos, status, promoted_to from r where id is null and pattern_key is not null
  union all select m.pattern_key, r.pos, r.status, r.promoted_to from r join l on l.id = r.id and l.n = 1 join memories m on m.id = r.id where m.pattern_key is not null),
 o as (select *, row_number() over (partition by pattern_key order by pos desc) as n from k) select p.pattern_key, o.status as last_status, o.promoted_to from patterns p join o using (pattern_key) where o.n = 1""")
def _(t):
    requests = _requests(t)
    patterns = t.patterns.withColumn("promoted_to", F.lit(None).cast("string"))
    return writes.resolved_patterns(patterns, writes.resolved(_targets(t), requests, as_of()), requests, as_of()).drop("updated_at")


@query("u16_without_embedding", "select id from memories where embedding is null order by created_at desc, id limit 20")
def _(t):
    return writes.without_embedding(t.memories).select("id")


@query("u23_clusters", """with c as (select pattern_key, count(*) as n, max(created_at) as last_seen, max(importance * 0.5e0) as impact, arg_max(id, (created_at, id)) as last_id, arg_max(category, (created_at, id)) filter (where category is not null) as any_category,
  first(category order by created_at desc, id desc) as category, first(status order by created_at desc, id desc) as status from memories where pattern_key is not null and importance > 3 group by 1)
 select p.pattern_key, cast(p.recurrence_count + coalesce(c.n, 0) as int) as recurrence_count, p.first_seen, coalesce(c.last_seen, p.last_seen) as last_seen, greatest(p.impact_score, coalesce(c.impact, p.impact_score)) as impact_score,
  p.representative_memory_id, coalesce(c.last_id, p.last_memory_id) as last_memory_id, coalesce(c.status, p.last_status) as last_status from patterns p left join c using (pattern_key)""")
def _(t):
    members = t.memories.where("pattern_key is not null and importance > 3").withColumn("impact", F.col("importance") * F.lit(0.5))
    return merge.merge(t.patterns, writes.cluster_rows(members, as_of()), ["pattern_key"], writes.CLUSTER_RULES)


@query("u24_promoted", "select pattern_key, 'auto' as promoted_to, 'promoted' as last_status from patterns where pattern_key in (select pattern_key from memories where status = 'promoted')")
def _(t):
    return writes.promoted(t.patterns, t.memories.where("status = 'promoted'"), as_of()).drop("updated_at")


@query("u26_feedback", "select f.id, c.agent, c.tool, f.was_followed, nullif(f.outcome, '') as outcome, c.id is not null as known from (select cast(event_id * 2 as varchar) as id, event_id % 3 = 0 as was_followed, case when event_id % 4 = 0 then '' else 'helped' end as outcome from events) f left join cycles c on c.id = f.id")
def _(t):
    feedback = t.events.selectExpr("cast(event_id * 2 as string) as id", "event_id % 3 = 0 as was_followed", "case when event_id % 4 = 0 then '' else 'helped' end as outcome")
    return writes.advised(t.cycles, feedback)


@query("k7_trajectories", "select id, case when actual in ('success', 'partial', 'failed') then actual else 'success' end as outcome, 0 as n_steps from (select id, case when accuracy >= 0.8 then 'success' when accuracy >= 0.4 then 'partial' when accuracy >= 0.2 then 'failed' else 'odd' end as actual from cycles)")
def _(t):
    found = t.cycles.selectExpr("id", "case when accuracy >= 0.8 then 'success' when accuracy >= 0.4 then 'partial' when accuracy >= 0.2 then 'failed' else 'odd' end as outcome", "cast(null as array<struct<action: string, result: string>>) as steps")
    return writes.trajectory_rows(found).select("id", "outcome", F.size("steps").alias("n_steps"))


@query("k8_snapshots", """with o as (select session_id as id, max(role) as agent, min(ts) as session_start, count(*) as turn_count from messages where pos < 3 group by 1),
 n as (select session_id as id, min(role) as agent, max(ts) as session_start, count(*) as turn_count from messages where pos > 0 group by 1)
 select coalesce(o.id, n.id) as id, coalesce(o.agent, n.agent) as agent, coalesce(o.session_start, n.session_start) as session_start, coalesce(n.turn_count, o.turn_count) as turn_count from o full join n on o.id = n.id""")
def _(t):
    of = lambda rows, agent, start: rows.groupBy(F.col("session_id").alias("id")).agg(agent("role").alias("agent"), start("ts").alias("session_start"), F.count("*").alias("turn_count"))
    return merge.merge(of(t.messages.where("pos < 3"), F.max, F.min), of(t.messages.where("pos > 0"), F.min, F.max), ["id"], writes.SNAPSHOT_RULES)


@query("k10_distillation_log", """with o as (select session_id as f, count(*) as c from messages where pos < 2 group by 1), n as (select session_id as f, count(*) as c from messages where pos >= 2 group by 1)
 select coalesce(o.f, n.f) as session_file, coalesce(n.c, o.c) as memories_created from o full join n on o.f = n.f""")
def _(t):
    of = lambda rows: rows.groupBy(F.col("session_id").alias("session_file")).agg(F.count("*").alias("memories_created"))
    return merge.merge(of(t.messages.where("pos < 2")), of(t.messages.where("pos >= 2")), ["session_file"], {})


@query("f46_lifecycle", "select id, coalesce(nullif(status, ''), 'pending') as status, nullif(category, '') as category, nullif(pattern_key, '') as pattern_key from (select id, case when importance = 2 then '' when importance = 3 then null else status end as status, case when importance = 4 then '' else category end as category, pattern_key from memories)")
def _(t):
    rows = t.memories.selectExpr("id", "case when importance = 2 then '' when importance = 3 then null else status end as status", "case when importance = 4 then '' else category end as category", "pattern_key")
    return writes.lifecycle(rows)


@query("a17_superseded", "select count(*) filter (where superseded_by is not null) as superseded, count(*) filter (where superseded_by is null) as active from memories")
def _(t):
    return t.memories.agg(F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.col("superseded_by").isNull()).alias("active"))


@query("a23_counters", "select coalesce(agent, 'unknown') as agent, count(*) as n, count(*) filter (where type = 'decision') as decision, count(*) filter (where type = 'gotcha') as gotcha, count(*) filter (where type = 'learning') as learning from memories group by 1")
def _(t):
    return t.memories.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(F.count("*").alias("n"), *(F.count_if(F.col("type") == k).alias(k) for k in ("decision", "gotcha", "learning")))


@query("s3_alive", "select 1 as alive")
def _(t):
    return t.spark.range(1).select(F.lit(1).alias("alive"))


@query("o15_smoke", "select 3 as tables, (select count(*) from memories) > 0 and (select count(*) from patterns) > 0 and (select count(*) from query_log) > 0 as healthy")
def _(t):
    filled = [df.limit(1).groupBy().agg((F.count("*") > 0).alias("x")) for df in (t.memories, t.patterns, t.query_log)]
    return filled[0].union(filled[1]).union(filled[2]).groupBy().agg(F.count("*").cast("int").alias("tables"), F.bool_and("x").alias("healthy"))


# ---- candidates of every source

_PHRASE = "select concat('session', cast(user_id as {S})) as session_id, concat('agent', cast(user_id % 7 as {S})) as agent, event_type, text as content, cast(1 + event_id % 10 as int) as importance, event_id from "


def _phrases(t):
    return t.spark.sql(_PHRASE.replace("{S}", "string") + "{phrases}", phrases=t.phrases)


_P = _PHRASE.replace("{S}", "varchar") + "phrases"
_LONG = _P.replace("text as content", "repeat(text, 40) as content")


@query("i1_sessions", _sql("m_", "session_id, content", _LONG, type="'note'", content="case when length(content) > 1500 then left(content, 1499) || '…' else content end", context="'agent:' || agent", tier="case when importance >= 7 then 'hot' else 'warm' end", agent="agent", importance="importance", category="event_type", tags="'auto-harvested|agent:' || agent || '|session:' || left(session_id, 8)", status="'pending'"))
def _(t):
    return _flat(adapters.from_sessions(_phrases(t).withColumns({"content": F.repeat("content", F.lit(40)), "type": F.lit("note"), "category": F.col("event_type")})))


@query("i2_blocks", _sql("mb_", "agent, event_type, content", _P, type="'note'", content="content", context="agent", agent="agent", tier="case when importance >= 7 then 'hot' else 'warm' end", importance="importance", category="'learning'", tags="'memory-bridge|' || event_type", status="'pending'"))
def _(t):
    return _flat(adapters.from_blocks(_phrases(t).withColumns({"workspace": F.col("agent"), "heading": F.col("event_type"), "type": F.lit("note"), "category": F.lit("learning")})))


@query("i3_entries", _sql("m_md_", "session_id, event_type, content", _P, type="'note'", content="'[' || event_type || '] ' || content", context="'agent:' || agent", agent="agent", tier="case when importance >= 7 then 'hot' else 'warm' end", importance="importance", tags="'markdown-import'", status="'pending'", source_kind="'markdown_import'", source_path="session_id"))
def _(t):
    return _flat(adapters.from_entries(_phrases(t).withColumns({"path": F.col("session_id"), "heading": F.col("event_type"), "text": F.col("content"), "type": F.lit("note")})))


@query("i4_facts", _sql("fact_", "session_id, content", _P, type="'fact'", content="content", context="case when event_id % 2 = 0 then 'project:x' else 'project:global' end", agent="agent", tier="'hot'", importance="case when event_id % 3 = 0 then importance else 8 end", category="'infrastructure'", tags="'url|session:' || left(session_id, 8)", status="'pending'"))
def _(t):
    rows = _phrases(t).withColumns({"context": F.when(F.col("event_id") % 2 == 0, "project:x"), "tier": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "importance": F.when(F.col("event_id") % 3 == 0, F.col("importance")), "tags": F.array(F.lit("url")), "type": F.lit("fact")})
    return _flat(adapters.from_facts(rows))


_SAID = "case event_id % 6 when 0 then '12' when 1 then '0' when 2 then 'high' when 3 then null when 4 then '-3' else ' 7 of 10' end"


@query("i5_extraction", _sql("dist_", "session_id, content", _LONG.replace("40)", "200)"), type="case when event_type in ('fact', 'note') then event_type else 'note' end", content="left(content, 2000)", context="case when event_id % 2 = 0 then 'agent:' || agent else left(content, 200) end", tier="case when event_id % 3 = 0 then 'cold' else 'warm' end", agent="agent", importance="case event_id % 6 when 0 then 10 when 4 then 1 when 5 then 7 else 5 end", category="case when event_id % 4 = 0 then 'routine' end", tags="'distilled|agent:' || agent || '|session:' || left(session_id, 8)", status="'pending'"))
def _(t):
    rows = _phrases(t).withColumn("content", F.repeat("content", F.lit(200)))
    rows = rows.withColumns({"type": F.col("event_type"), "context": F.when(F.col("event_id") % 2 == 1, F.col("content")).otherwise(""), "tier": F.when(F.col("event_id") % 3 == 0, "cold").otherwise("tepid"), "importance": F.expr(_SAID), "category": F.when(F.col("event_id") % 4 == 0, "routine").otherwise("odd")})
    return _flat(adapters.from_extraction(rows))


_KIND = "case event_id % 5 when 0 then 'error_fix' when 1 then 'decision' when 2 then 'complex_session' when 3 then 'repeated_failure' else 'other' end"


@query("i6_distilled", _sql("m_distill_", "session_id, content", _P.replace("event_id from", f"event_id, {_KIND} as kind from"), type="case kind when 'error_fix' then 'gotcha' when 'decision' then 'decision' when 'repeated_failure' then 'gotcha' else 'note' end", content="content", tier="'warm'", agent="agent", importance="importance", category="case kind when 'error_fix' then 'error' when 'decision' then 'best_practice' when 'complex_session' then 'context' when 'repeated_failure' then 'error' end", tags="'auto-distilled|' || kind", status="'pending'", source_kind="'llm_distilled'", source_path="session_id", confidence_score="0.6"))
def _(t):
    return _flat(adapters.from_distilled(_phrases(t).withColumns({"session_file": F.col("session_id"), "kind": F.expr(_KIND)})))


_I7 = f"select *, case when event_id % 3 = 0 then 'command failed (exit ' || '' end as unused, case when event_id % 2 = 0 then 'Command failed (exit ' || case when event_id % 4 = 0 then '?' else '2' end || '): make ' || event_type || chr(10) || content else case when event_id % 3 = 0 then 'Error' else 'TypeError' end || ': ' || event_type || chr(10) || content end as text from ({_P})"


@query("i7_errors", _sql("m_err_", "session_id, text", _I7, where="length(text) >= 20", type="'gotcha'", content="left(text, 2000)", tier="'warm'", agent="agent", importance="6", category="'error'", tags="'auto-harvested|error'", status="'pending'", source_kind="'tool_verified'"))
def _(t):
    even = F.col("event_id") % 2 == 0
    rows = _phrases(t).select("session_id", "agent", F.when(even, F.concat(F.lit("make "), "event_type")).alias("command"), F.when(F.col("event_id") % 4 != 0, 2).alias("code"), F.when(F.col("event_id") % 3 != 0, "TypeError").alias("pattern"), F.col("event_type").alias("message"), F.col("content").alias("snippet"))
    return _flat(adapters.from_errors(rows))


@query("i8_suggestions", _sql("m_promo_", "'pattern', pattern_key, rule", "select pattern_key, 'keep ' || pattern_key as rule, recurrence_count from patterns", type="'decision'", content="'[PROMOTION SUGGESTION] → AGENTS.md' || chr(10) || 'Rule: ' || rule || chr(10) || 'Reason: often' || chr(10) || 'Recurrence: ' || recurrence_count || 'x' || chr(10) || 'Source: pattern (' || pattern_key || ')'", tier="'warm'", agent="'system'", importance="7", category="'best_practice'", tags="'promotion-suggestion|auto-promoter'", status="'pending'", source_kind="'agent_inference'"))
def _(t):
    rows = t.patterns.select(F.lit("pattern").alias("source"), F.lit("AGENTS.md").alias("file"), F.concat(F.lit("keep "), "pattern_key").alias("rule"), F.lit("often").alias("reason"), F.col("recurrence_count").alias("recurrence"), F.col("pattern_key").alias("ref"))
    return _flat(adapters.from_suggestions(rows))


@query("f20_suggestions", "select pattern_key, 'TOOLS.md' as target_file, 'keep ' || pattern_key as description, recurrence_count as recurrence from patterns")
def _(t):
    text = F.concat(F.lit("[PROMOTION SUGGESTION] → TOOLS.md\nRule: keep "), "pattern_key", F.lit("\nRecurrence: "), F.col("recurrence_count").cast("string"), F.lit("x"))
    return t.patterns.select("pattern_key", adapters.parse_suggestion(text, F.lit(None).cast("int")).alias("x")).select("pattern_key", "x.*")


@query("j14_uncovered", "select id from memories where content is not null and content not in (select content from memories where pattern_key is not null and content is not null)")
def _(t):
    return adapters.uncovered(t.memories.where("content is not null"), t.memories.where("pattern_key is not null").select(F.col("content").alias("description"))).select("id")


@query("g15_details", "select id, case when category in ('learning', 'error', 'feature_request', 'correction', 'knowledge_gap', 'best_practice') then category else 'learning' end as category, case when tier = 'hot' then 'complex' else 'medium' end as complexity, 'first_time' as frequency, 0 as n_files from memories")
def _(t):
    rows = t.memories.select("id", "category", F.when(F.col("tier") == "hot", "complex").otherwise("huge").alias("complexity"), F.lit(None).cast("string").alias("frequency"), F.lit(None).cast("array<string>").alias("related_files"))
    return adapters.clean_detail(rows).select("id", "category", "complexity", "frequency", F.size("related_files").alias("n_files"))


# ---- what texts mention

@query("f14_mentions", r"""select event_id, list_distinct_sorted(regexp_extract_all(text, '(https?://[^\s"''<>\])+]+)', 1)) as urls, array_to_string(regexp_extract_all(text, '((?:error|Error|ERROR|fail|FAIL|exception|Exception)[:\s].{10,120})', 1), '|') as errors from phrases""".replace("list_distinct_sorted(regexp_extract_all(text, '(https?://[^\\s\"''<>\\])+]+)', 1))", "array_to_string(list_transform(regexp_extract_all(text, '(https?://[^\\s\"''<>\\])+]+)', 1), lambda u: regexp_replace(u, '[.,;:)]+$', '')), '|')"))
def _(t):
    return t.phrases.select("event_id", F.array_join(extract.urls(F.col("text")), "|").alias("urls"), F.array_join(extract.errors(F.col("text")), "|").alias("errors"))


@query("w12_compressed", "select session_id, left(string_agg(case when role = 'user' then 'USER: ' else 'ASSISTANT: ' end || left(text, 800) || chr(10) || chr(10), '' order by pos), 12000) as text from messages group by session_id")
def _(t):
    # messages are cut before they are gathered, and those that the whole text's limit cannot reach stay away
    cut = t.messages.select("session_id", "pos", "role", F.left("text", F.lit(800)).alias("text"))
    before = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("before", F.coalesce(before, F.lit(0))).where("before < 12000")
    rows = cut.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("m"))
    return rows.select("session_id", extract.compressed(F.col("m")).alias("text"))


@query("c10_summaries", """with a as (select session_id, count(*) as n, list(text order by pos) filter (where role = 'assistant') as texts, list(text order by pos) filter (where role = 'tool') as errors from messages group by 1),
 f as (select *, list_filter(coalesce(texts, []), lambda x: length(x) > 80 and length(x) < 2000) as fit from a)
 select session_id, left(concat_ws(' ', 'Agent main session with ' || n || ' turns.', case when len(fit) > 0 then left(array_to_string(list_transform(fit[greatest(len(fit) - 2, 1):], lambda x: left(x, 300)), ' '), 600) end,
  case when len(coalesce(errors, [])) > 0 then 'Errors: ' || array_to_string(errors[1:2], '; ') end), 1200) as summary from f""")
def _(t):
    of = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "text")))), lambda x: x["text"])
    rows = t.messages.groupBy("session_id").agg(F.count("*").alias("n"), of("assistant").alias("texts"), of("tool").alias("errors"))
    return rows.select("session_id", extract.session_summary(F.lit("main"), F.col("n"), F.col("texts"), F.col("errors"), F.array().cast("array<string>")).alias("summary"))


@query("f16_entries", """select cast(item_id as varchar) as path, heading, text from (select item_id, unnest([{'heading': 'Rules', 'text': 'first of ' || item_id || chr(10) || 'goes on' || chr(10) || '- deeper'}, {'heading': 'Rules', 'text': 'second'}, {'heading': 'Rules', 'text': 'after the gap'}, {'heading': 'Notes', 'text': 'plain words'}, {'heading': 'Notes', 'text': 'more words'}], recursive := true) from benchmark)""")
def _(t):
    text = F.concat(F.lit("## Rules\n- first of "), F.col("item_id").cast("string"), F.lit("\n  goes on\n  - deeper\n* second\n\n  after the gap\n## Index\n- not this\n## Notes\nplain words\nmore words\n"))
    return adapters.entries(t.benchmark.select(F.col("item_id").cast("string").alias("path"), text.alias("content"))).select("path", "heading", "text")
