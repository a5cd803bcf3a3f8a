"""Queries: diffs and merges, classifiers, text functions, sessions, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import pii, rules
from ..operators import advisory, curation, merge, patterns, sessions
from ..sources import readers
from .registry import as_of, query


@query("u2_upsert", """with s as (select id, content, least(importance + 2, 10) as importance, case when id::bigint % 4 = 0 then null else 'new.key' end as pattern_key, recurrence_count + 1 as recurrence_count, last_seen + interval 1 day as last_seen from memories where status in ('pending','in_progress')
   union all select concat('n', id), content, importance, null, 1, last_seen from memories)
 select coalesce(t.id, s.id) as id, cast(case when s.id is null then t.importance else s.importance end as integer) as importance, case when t.id is null then s.pattern_key when s.id is null then t.pattern_key else coalesce(s.pattern_key, t.pattern_key) end as pattern_key,
   cast(greatest(t.recurrence_count, s.recurrence_count) as integer) as recurrence_count, greatest(t.last_seen, s.last_seen) as last_seen, t.access_count from memories t full join s on t.id = s.id""")
def _(t):
    m = t.memories
    n = F.col("id").cast("long")
    up = m.where("status in ('pending','in_progress')").select("id", "content", F.least(F.col("importance") + 2, F.lit(10)).alias("importance"), F.when(n % 4 != 0, F.lit("new.key")).alias("pattern_key"), (F.col("recurrence_count") + 1).alias("recurrence_count"), (F.col("last_seen") + F.expr("interval 1 day")).alias("last_seen"))
    new = m.select(F.concat(F.lit("n"), "id").alias("id"), "content", "importance", F.lit(None).cast("string"), F.lit(1), "last_seen")
    target = m.select("id", "content", "importance", "pattern_key", "recurrence_count", "last_seen", "access_count")
    return merge.merge(target, up.union(new), ["id"], merge.MEMORY_RULES).drop("content")


@query("u3_merge_plan", """with e as (select *, row_number() over (partition by pattern_key order by last_seen desc nulls last, id) as n from memories where pattern_key is not null),
 k as (select concat('c', cast(event_id as varchar)) as cand_id, case when event_id % 3 = 0 then concat('pk.', cast(event_id % 20 as varchar)) end as pattern_key, case when event_id % 2 = 0 then cast(event_id % 9 as integer) end as rc, ts from requests)
 select cand_id, e.id is not null as found, coalesce(e.id, cand_id) as final_id, cast(case when e.id is not null then greatest(coalesce(e.recurrence_count,1) + 1, coalesce(rc,0)) else coalesce(rc,1) end as integer) as final_recurrence, coalesce(e.first_seen, {as_of}) as final_first, ts as final_last
 from k left join e on e.pattern_key = k.pattern_key and e.n = 1""")
def _(t):
    i = F.col("event_id")
    k = t.requests.select(F.concat(F.lit("c"), i.cast("string")).alias("cand_id"), F.when(i % 3 == 0, F.concat(F.lit("pk."), (i % 20).cast("string"))).alias("pattern_key"), F.when(i % 2 == 0, (i % 9).cast("int")).alias("recurrence_count"), F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.col("ts").alias("last_seen"))
    return merge.merge_plan(k, t.memories, as_of())


@query("u4_pattern_upsert", """with s as (select pattern_key, max(recurrence_count) as rc, min(first_seen) as fs, max(last_seen) as ls, max(importance * case tier when 'hot' then 1e0 when 'warm' then 0.7e0 when 'cold' then 0.4e0 when 'archive' then 0.2e0 else 0.5e0 end) as impact, arg_max(id, (last_seen, id)) as last_id from memories where pattern_key is not null group by 1)
 select p.pattern_key, cast(greatest(p.recurrence_count, s.rc) as integer) as recurrence_count, least(p.first_seen, s.fs) as first_seen, greatest(p.last_seen, s.ls) as last_seen, round(greatest(p.impact_score, s.impact),4) as impact, p.representative_memory_id, coalesce(s.last_id, p.last_memory_id) as last_memory_id from patterns p left join s using (pattern_key)""")
def _(t):
    new = merge.pattern_rows(t.memories)
    return merge.merge(t.patterns, new, ["pattern_key"], merge.PATTERN_RULES).select("pattern_key", "recurrence_count", "first_seen", "last_seen", F.round("impact_score", 4).alias("impact"), "representative_memory_id", "last_memory_id")


@query("u6_resolve", "select id, 'resolved' as status, {as_of} as resolved_at from memories where pattern_key = 'pk.0' and status in ('pending','in_progress')")
def _(t):
    return t.memories.where("pattern_key = 'pk.0' and status in ('pending','in_progress')").select("id", F.lit("resolved").alias("status"), as_of().alias("resolved_at"))


@query("u7_promote", "select id, 'promoted' as status from memories where status in ('pending','in_progress') and recurrence_count >= 3 and last_seen >= {as_of} - interval 30 day")
def _(t):
    return curation.promote(t.memories, as_of())


@query("u8_degrade", "select id, status, case when importance <= 3 and access_count <= 1 then 'wont_fix' else 'pending' end as new_status from memories where last_seen < {as_of} - interval 45 day and status in ('pending','in_progress')")
def _(t):
    return curation.degrade(t.memories, as_of())


@query("u7_lifecycle_applied", "select case when status in ('pending','in_progress') and recurrence_count >= 3 and last_seen >= {as_of} - interval 30 day then 'promoted' else status end as status, count(*) as n from memories group by 1")
def _(t):
    return merge.apply_diff(t.memories, curation.promote(t.memories, as_of())).groupBy("status").agg(F.count("*").alias("n"))


@query("u9_feedback", """with e as (select cast(event_id % 900 as varchar) as id, count(*) filter (where event_type = 'click') as up, count(*) filter (where event_type = 'view') as down, count(*) filter (where event_id % 97 = 0) as bad from requests join (select event_id as e2, event_type from events) x on x.e2 = requests.event_id group by 1)
 select m.id, cast(least(10, greatest(1, importance + up - down)) as integer) as importance, cast(coalesce(feedback_score,0) + up - down - 5*bad as integer) as feedback_score, case when bad > 0 then 'feedback:incorrect' else superseded_by end as superseded_by from memories m join e on e.id = m.id""")
def _(t):
    i, kind = F.col("event_id"), F.col("event_type")
    verdicts = F.array_compact(F.array(F.when(kind == "click", F.lit("useful")), F.when(kind == "view", F.lit("useless")), F.when(i % 97 == 0, F.lit("incorrect")), F.lit("none")))
    return curation.feedback(t.memories, t.events.select((i % 900).cast("string").alias("id"), F.explode(verdicts).alias("verdict")))


@query("u11_low_signal", "select id, 'cold' as tier, least(importance, 2) as importance, len(tags) + 1 as n_tags from memories where superseded_by is null and length(coalesce(content,'')) <= 60 and type in ('decision','action','learning','note')")
def _(t):
    return curation.low_signal(t.memories, 60).select("id", "tier", "importance", F.size("tags").cast("long").alias("n_tags"))


@query("u12_expire", "select id, 'archive' as tier, 'expired' as superseded_by from memories where superseded_by is null and expires_at < {as_of}")
def _(t):
    return curation.expire(t.memories, as_of())


@query("u14_backfill", "select id, 'markdown_import' as source_kind from memories where superseded_by is null and source_kind is null")
def _(t):
    return curation.backfill_source(t.memories)


@query("u15_stale_tiers", """with m as (select *, coalesce(last_accessed, created_at) as touched from memories where superseded_by is null), f as (select count(*) > 0 as any_warm from m where tier = 'warm' and touched < {as_of} - interval 80 day),
 r as (select id, tier as old_tier, case when tier='hot' and touched < {as_of} - interval 80 day and any_warm then 'cold' when tier='hot' and touched < {as_of} - interval 60 day then 'warm' when tier='warm' and touched < {as_of} - interval 80 day then 'cold' end as tier from m, f) select * from r where tier is not null""")
def _(t):
    return curation.stale_tiers(t.memories, as_of(), 60, 80)


@query("u17_near_duplicates", """with m as (select * from memories where superseded_by is null and embedding is not null order by created_at desc, id limit 200),
 p as (select a.id as old_id, b.id as new_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from m a join m b on a.id <> b.id and a.created_at < b.created_at), k as (select * from p where s > 0.3 order by s desc, old_id, new_id limit 50)
 select old_id as id, arg_min(new_id, (-s, new_id)) as superseded_by from k group by 1""")
def _(t):
    from ..operators.retrieval import recent_pairs

    pairs = recent_pairs(t.memories, 200, 0.3, 50, older_first=True)
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.min_by("b_id", F.struct(-F.col("similarity"), F.col("b_id"))).alias("superseded_by"))


@query("u18_cross_agent", """select id, len(tags) + 1 as n_tags from memories where superseded_by is null and agent is not null and not list_contains(tags,'cross-agent') and created_at >= {as_of} - interval 60 day
 and ((type in ('learning','gotcha') and importance >= 7) or (type in ('decision','fact') and importance >= 8)) order by importance desc, created_at desc, id limit 20""")
def _(t):
    return curation.cross_agent(t.memories, as_of(), 60).select("id", F.size("tags").cast("long").alias("n_tags"))


_G5 = """case when regexp_matches(x, '(?i)error|fail|crash|bug|broke|fix|wrong|issue') then 'error' when regexp_matches(x, '(?i)learn|realiz|discover|found out|turns out|actually') then 'learning'
 when regexp_matches(x, '(?i)decid|chose|decision|switch|migrat|adopt|use.*instead') then null when regexp_matches(x, '(?i)gotcha|careful|watch out|trap|caveat|warning|don''t|avoid') then 'correction'
 when regexp_matches(x, '(?i)feature|request|want|need|wish|should add') then 'feature_request' when regexp_matches(x, '(?i)best practice|pattern|convention|always|never|rule') then 'best_practice'
 when regexp_matches(x, '(?i)gap|missing|didn''t know|unknown|unclear') then 'knowledge_gap' end"""
_G6 = "cast(least(10, greatest(1, 5 + (length(content) > 500)::int + (length(content) > 1000)::int + (tier = 'hot')::int + (access_count > 3)::int + (access_count > 10)::int)) as integer)"


@query("u19_reclassify", f"select id, coalesce(category, {_G5.replace('(x,', '(content,')}) as category, {_G6} as importance, case when status = 'pending' then 'promoted' else status end as status from memories where superseded_by is null")
def _(t):
    return curation.reclassify(t.memories).drop("type_hint")


@query("g5_categories", f"select event_id, {_G5.replace('(x,', '(text,')} as category from phrases")
def _(t):
    return t.phrases.select("event_id", rules.category(F.col("text"), F.lit("note")).getField("category").alias("category"))


@query("g6_importance", f"select id, {_G6} as importance from memories")
def _(t):
    return t.memories.select("id", rules.importance(F.col("content"), F.col("tier"), F.col("access_count")).alias("importance"))


_SCORE16 = """greatest(0e0, least(10e0, 5e0 + case when d > 30 then -2 when d > 14 then -1 when d <= 3 then 1 else 0 end + case when access_count >= 10 then 2 when access_count >= 5 then 1 when access_count = 0 then -1 else 0 end
 + case when length(content) >= 100 then 1 when length(content) < 50 then -1 else 0 end + case when importance >= 8 and tier = 'cold' then 2 when importance >= 7 and tier = 'cold' then 1 else 0 end
 + case when importance <= 3 and tier = 'hot' then -2 when importance <= 4 and tier = 'hot' then -1 else 0 end + case when recurrence_count >= 3 then 1 else 0 end))"""


@query("g16_quality", f"""with m as (select *, (epoch({{as_of}}) - epoch(coalesce(last_accessed, created_at)))/86400.0 as d from memories where superseded_by is null order by access_count desc nulls last, id limit 50), s as (select *, round({_SCORE16},1) as score from m)
 select id, score, case when importance >= 7 and tier = 'cold' and score >= 5 then 'promote' when score >= 7 then 'maintain' when score >= 4 then 'degrade' else 'archive' end as action,
 case when importance >= 7 and tier = 'cold' and score >= 5 then 'warm' when score >= 7 then tier when score >= 4 then case when tier = 'hot' then 'warm' else 'cold' end else 'cold' end as new_tier,
 cast(case when importance >= 7 and tier = 'cold' and score >= 5 then importance when score >= 7 then importance when score >= 4 then greatest(importance - 1, 1) else 1 end as integer) as new_importance from s""")
def _(t):
    return curation.quality(t.memories, as_of())


_CONTRADICTED = """with m as (select *, row_number() over (order by access_count desc nulls last, importance desc nulls last, id) as rank from (select * from memories where superseded_by is null and tier = 'hot' and embedding is not null order by access_count desc nulls last, importance desc nulls last, id limit 30)),
 p as (select a.id as aid, b.id as bid, a.rank as ra, b.rank as rb, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s, case when abs(length(a.content) - length(b.content)) / greatest(length(a.content), length(b.content), 1) < 0.10 then a.importance >= b.importance else length(a.content) > length(b.content) end as keep_a
   from m a join m b on a.rank < b.rank where a.context is null or b.context is null or a.context = b.context),
 j as (select case when keep_a then bid else aid end as loser, case when keep_a then aid else bid end as keeper, s, ra, rb from p where s >= 0.15), n as (select *, row_number() over (partition by loser order by ra, rb) as n from j)"""


@query("c2_contradictions", _CONTRADICTED + """ select loser, keeper, round(s,4) as similarity from n where n = 1""")
def _(t):
    return curation.contradictions(t.memories, 0.15).select("loser", "keeper", "similarity")


@query("u21_superseded", _CONTRADICTED + """, f as (select * from n where n = 1), t as (select f.keeper, arg_max(m.tags, f.ra * 1000 + f.rb) as more from f join memories m on m.id = f.loser group by 1)
 select m.id, coalesce(f.keeper, m.superseded_by) as superseded_by, case when t.keeper is null then array_to_string(m.tags, '|')
  else array_to_string(list_concat(m.tags, list_filter(t.more, lambda x: not list_contains(m.tags, x)), ['dedup_contradiction']), '|') end as tags
 from memories m left join f on f.loser = m.id left join t on t.keeper = m.id where f.loser is not null or t.keeper is not null""")
def _(t):
    diff = curation.supersede_contradicted(t.memories, curation.contradictions(t.memories, 0.15))
    return diff.select("id", "superseded_by", F.array_join("tags", "|").alias("tags"))


@query("u25_learnings", """select id, case when accuracy < 0.5 then 'Learning: Predicted "' || prediction || '" for tool:' || tool || ', but actual outcome was "' || actual_outcome || '". ' || case when evaluation_notes is not null then 'Notes: ' || evaluation_notes else '' end
 when accuracy < 0.8 then 'Partial: Prediction "' || prediction || '" for tool:' || tool || ' was partially correct. Actual: "' || actual_outcome || '". ' || coalesce(evaluation_notes,'')
 else 'Confirmation: Prediction "' || prediction || '" for tool:' || tool || ' was accurate. Outcome: "' || actual_outcome || '".' end as content, case when accuracy < 0.5 then 7 else 4 end as importance, case when project is not null then 'project:' || project end as context from cycles where status = 'evaluated'""")
def _(t):
    return advisory.learnings(t.cycles)


@query("u25_evaluate", "select id, concat('saw ', tool) as actual_outcome, least(1.0e0, cast(id::bigint % 150 as double)/100) as accuracy, 'evaluated' as status from cycles where status = 'predicted'")
def _(t):
    i = F.col("id").cast("long")
    seen = t.cycles.select("id", F.concat(F.lit("saw "), "tool").alias("actual_outcome"), (i % 150 / 100).alias("accuracy"))
    return advisory.evaluate_cycles(t.cycles, seen)


@query("f1_truncations", """select id, case when length(content) > 40 then substr(content,1,39) || '…' else content end as cut, case when length(content) > 40 then substr(content,1,37) || '...' else content end as dots,
 md5(case when len(string_split(content, chr(10))) > 2 then array_to_string(string_split(content, chr(10))[1:2], chr(10)) || chr(10) || '…' else content end) as lines from memories""")
def _(t):
    x = F.col("content")
    return t.memories.select("id", c.truncate(x, 40).alias("cut"), c.truncate_dots(x, 40).alias("dots"), F.md5(c.truncate_lines(x, 2).cast("binary")).alias("lines"))


@query("f6_hashes", "select id, md5(content) as m, substr(sha256(substr(content,1,500)),1,16) as s, 'v2_' || substr(sha1(concat_ws('|', id, content)),1,16) as v from memories")
def _(t):
    x = F.col("content")
    return t.memories.select("id", F.md5(x.cast("binary")).alias("m"), c.sha_prefix(F.substring(x, 1, 500), 16).alias("s"), c.sha1_id("v2_", F.col("id"), x).alias("v"))


@query("f9_slugs", "select event_id, regexp_replace(lower(text), '[^a-z0-9]', '_', 'g') as slug, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from phrases")
def _(t):
    return t.phrases.select("event_id", c.slug(F.col("text")).alias("slug"), c.collapse(F.col("text")).alias("flat"))


@query("f10_sentences", "select event_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> ''))) as n from phrases")
def _(t):
    return t.phrases.select("event_id", F.size(c.sentences(F.col("text"))).cast("long").alias("n"))


@query("f11_rules", """with s as (select event_id, text, list_filter(regexp_split_to_array(text, '[.\\n]'), lambda x: length(trim(x)) > 10)[1] as f from phrases) select event_id, case when length(f) <= 150 then trim(f) else trim(substr(text,1,150)) || '...' end as rule from s""")
def _(t):
    return t.phrases.select("event_id", c.first_rule(F.col("text")).alias("rule"))


@query("f13_masked_urls", "select event_id, regexp_replace(text, '//[^@]+@', '//***@', 'g') as text from phrases")
def _(t):
    return t.phrases.select("event_id", c.mask_credentials(F.col("text")).alias("text"))


@query("f18_overlap", """with w as (select a.event_id, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda x: x <> '')) as x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) as y from phrases a join phrases b on b.event_id = a.event_id + 12)
 select event_id, round(len(list_intersect(x, y)) / greatest(len(x), 1), 4) as overlap from w""")
def _(t):
    b = t.phrases.select((F.col("event_id") - 12).alias("event_id"), F.col("text").alias("other"))
    return t.phrases.join(b, "event_id").select("event_id", F.round(c.word_overlap(F.col("text"), F.col("other")), 4).alias("overlap"))


@query("p14_high_risk", "select tool, tool in ('exec','deploy','railway','delete','rm','drop','git push','git force-push','migration','cron','message send','email send') as risky, count(*) as n from requests group by 1, 2")
def _(t):
    return t.requests.groupBy("tool", c.high_risk(F.col("tool")).alias("risky")).agg(F.count("*").alias("n"))


@query("f19_search_strings", "select event_id, concat('tool:', tool, ' k:', cast(event_id % 9 as varchar), ' agent:', agent) as q from requests")
def _(t):
    args = F.concat(F.lit('{"k":"'), (F.col("event_id") % 9).cast("string"), F.lit('"}'))
    return t.requests.select("event_id", c.search_string(F.col("tool"), args, F.lit(None).cast("string"), F.col("agent")).alias("q"))


_EMAIL, _SK, _AKIA, _IP = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\bsk-[A-Za-z0-9]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
_STEP = "text"
for _p in (_EMAIL, _SK, _AKIA, _IP):
    _STEP = f"regexp_replace({_STEP}, '{_p}', '[REDACTED]', 'g')"


@query("f30_redaction", f"select event_id, {_STEP} as text, concat_ws(',', case when regexp_matches(text, '{_EMAIL}') then 'email' end, case when regexp_matches(text, '{_SK}') then 'openai_key' end, case when regexp_matches(text, '{_AKIA}') then 'aws_access_key' end, case when regexp_matches(text, '{_IP}') then 'ipv4' end) as reasons from phrases")
def _(t):
    out = pii.scrub(t.phrases.select("event_id", "text"), "text", reasons=("email", "openai_key", "aws_access_key", "ipv4"))
    return out.select("event_id", "text", F.array_join("text_reasons", ",").alias("reasons"))


@query("f30_redaction_full")
def _(t):
    out = pii.scrub(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", F.length("text").alias("n"), pii.merge_tags(F.array(F.lit("doc")), F.col("text_reasons")).alias("tags"))


@query("g1_gate", "select event_id, length(trim(text)) as length, case when length(trim(text)) < 20 then 1 else 5 end as importance, case when regexp_matches(trim(text), '(?i)^(ok|yes|no|sure|done|listo|sí|si|thanks|gracias)\\.?$') then 'noise_pattern' end as skip from phrases")
def _(t):
    g = rules.gate(F.col("text"), F.lit(5))
    return t.phrases.select("event_id", g.length.cast("long").alias("length"), g.importance.alias("importance"), g.skip.alias("skip"))


@query("g4_blocks", """select event_id, case when regexp_matches(lower(text), '(?:decisión|decided|decidimos|elegimos|vamos a usar|switched to|migrat|adoptamos|reemplaz)') then 'decision' when regexp_matches(lower(text), '(?:error|fix|bug|fallo|falló|crash|broke|roto|no funciona|se cayó|exception|la solución|se resolvió|corregido|arreglado|el problema era)') then 'learning'
 when regexp_matches(lower(text), '(?:gotcha|cuidado|watch out|careful|trap|caveat|ojo con|no usar|avoid|prohibido)') then 'gotcha' else 'note' end as type from phrases""")
def _(t):
    return t.phrases.select("event_id", rules.block(F.col("text")).getField("type").alias("type"))


def _first(x: str, table, field: str, default: str) -> str:
    quoted = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when regexp_matches({x}, '(?i){r.pattern.replace(chr(39), chr(39) * 2)}') then {quoted(getattr(r, field))}" for r in table) + f" else {default} end"


@query("g2_session_rules", f"select event_id, case when regexp_matches(text, '(?i)^(sí|si|ok|listo|hecho|done|entendido|perfecto|claro)') then null else {_first('text', rules.SESSION_RULES, 'type', 'null')} end as type, cast(case when regexp_matches(text, '(?i)^(sí|si|ok|listo|hecho|done|entendido|perfecto|claro)') then null else {_first('text', rules.SESSION_RULES, 'importance', 'null')} end as integer) as importance from phrases")
def _(t):
    g = rules.session_message(F.col("text"))  # asked once for a row: a second field of it would run the rules again
    return t.phrases.select("event_id", g.alias("g")).select("event_id", "g.type", "g.importance")


@query("g3_entry_rules", f"select event_id, case when length(text || text) >= 60 then {_first(chr(39) + 'notes ' + chr(39) + ' || lower(text || text)', rules.ENTRY_RULES, 'type', 'null')} end as type from phrases")
def _(t):
    return t.phrases.select("event_id", rules.entry(F.concat("text", "text"), F.lit("Notes")).getField("type").alias("type"))


@query("g7_themes", f"select event_id, {_first('text', rules.THEMES, 'type', chr(39) + 'general' + chr(39))} as theme from phrases")
def _(t):
    return t.phrases.select("event_id", rules.theme(F.col("text")).alias("theme"))


@query("g8_targets", f"""select event_id, case when event_id % 5 = 0 or regexp_matches(lower(text), '{rules.TOOL_WORDS}') then 'TOOLS.md' when regexp_matches(lower(text), '{rules.STYLE_WORDS}') then 'SOUL.md' else 'AGENTS.md' end as target from phrases""")
def _(t):
    return t.phrases.select("event_id", rules.promotion_target(F.col("text"), F.when(F.col("event_id") % 5 == 0, F.lit("error")), F.array(F.lit("x"))).alias("target"))


_ERR = "(" + " or ".join(f"regexp_matches(text, '{p}')" for p in rules.RUNTIME_ERRORS) + ") and length(text) <= 2000 and len(string_split(text, chr(10))) <= 30 and not (" + " or ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in rules.NOT_ERRORS) + ")"
_FIXED = "(" + " or ".join(f"lower(text) like '%{w}%'" for w in rules.FIX_WORDS) + ")"


@query("g11_runtime_errors", f"select session_id, pos from messages where {_ERR}")
def _(t):
    return t.messages.where(rules.runtime_error(F.col("text"))).select("session_id", "pos")


@query("g12_decisions", "select session_id, pos, substr(text, 1, 500) as content from messages where regexp_matches(text, '(?i)\\b(decided|going with|elegimos|vamos con|vamos a usar|the plan is|let''s go with|optamos por)\\b')")
def _(t):
    return sessions.decisions(t.messages)


@query("w7_error_fixes", f"""with m as (select *, row_number() over (partition by session_id order by pos) as n from messages), b as (select * from m where role in ('tool','assistant') and {_ERR}), f as (select * from m where {_FIXED}),
 j as (select b.session_id, b.pos, substr(b.text,1,300) as error, substr(f.text,1,300) as fix, row_number() over (partition by b.session_id, b.pos order by f.pos) as k from b join f on f.session_id = b.session_id and f.n > b.n and f.n <= b.n + 5) select session_id, pos, error, fix from j where k = 1""")
def _(t):
    return sessions.error_fixes(t.messages)


@query("a21_repeated_failures", f"select regexp_replace(lower(substr(text,1,50)), '[^a-z0-9]', '_', 'g') as fingerprint, count(*) as n, count(distinct session_id) as sessions from messages where role = 'tool' and {_ERR} group by 1 having count(*) >= 3")
def _(t):
    return sessions.repeated_failures(t.messages)


@query("g13_exit_codes", """with e as (select session_id, pos, try_cast(regexp_extract(text, '(?i)(?:exit(?:ed)?\\s+(?:with\\s+)?(?:code|status)\\s+(\\d+)|Process exited with code (\\d+))', 2) as integer) as a, try_cast(nullif(regexp_extract(text, '(?i)(?:exit(?:ed)?\\s+(?:with\\s+)?(?:code|status)\\s+(\\d+)|Process exited with code (\\d+))', 1), '') as integer) as b, text from messages where role = 'tool')
 select session_id, pos, coalesce(b, a) as code from e where coalesce(b, a) <> 0""")
def _(t):
    e = rules.exit_failure(F.col("text"))
    return t.messages.where("role = 'tool'").select("session_id", "pos", e.getField("code").alias("code")).where("code is not null")


@query("g13_exit_failures")
def _(t):
    return sessions.exit_failures(t.messages)


@query("g14_facts", """select event_id, 'vercel_url' as name, 'Deploy URL: ' || regexp_extract(text, '(?i)https?://[\\w-]+\\.(?:vercel|netlify)\\.app\\b[^\\s)>\\]"'']*') as content from phrases where regexp_matches(text, '(?i)https?://[\\w-]+\\.(?:vercel|netlify)\\.app\\b')
 union all select event_id, 'database_url', 'Database: ' || regexp_replace(regexp_extract(text, 'postgres://[^\\s"'']+'), '//[^@]+@', '//***@') from phrases where regexp_matches(text, 'database: postgres://[^\\s"'']')
 union all select event_id, 'port_config', 'Port config: ' || regexp_extract(text, 'PORT: \\d+') from phrases where regexp_matches(text, 'PORT: \\d{2}') union all select event_id, 'branch_info', 'Branch: ' || regexp_extract(text, 'branch: [\\w./-]+') from phrases where regexp_matches(text, 'branch: [\\w./-]{2}')""")
def _(t):
    return t.phrases.select("event_id", F.explode(rules.facts(F.col("text"))).alias("f")).select("event_id", "f.name", "f.content")


@query("w8_first_seen", "select substr(sha256(substr(text,1,500)),1,16) as key, arg_min(session_id, (session_id, pos)) as session_id, arg_min(pos, (session_id, pos)) as pos, count(*) as n from messages group by 1")
def _(t):
    return sessions.first_seen(t.messages)


@query("w10_snapshots", """select session_id, min(ts) as session_start, max(ts) as session_end, count(*) filter (where role in ('user','assistant')) as turns, count(*) filter (where regexp_matches(text, '(?:error|Error|ERROR|fail|FAIL|exception|Exception)[:\\s].{10,120}')) as errors from messages group by 1""")
def _(t):
    return sessions.snapshots(t.messages).select("session_id", "session_start", "session_end", "turns", "errors")


@query("w11_transcripts", "with s as (select session_id, pos, sum(least(length(text),300)) over (partition by session_id order by pos) as total from messages) select session_id, count(*) as messages, cast(max(total) as bigint) as chars from s where total <= 1000 group by 1")
def _(t):
    return sessions.transcripts(t.messages, 300, 1000)


@query("c11_long_sessions", "select session_id, count(*) as messages, count(*) filter (where role = 'tool') as tool_calls from messages group by 1 having count(*) >= 6")
def _(t):
    return sessions.long_sessions(t.messages, 6)


@query("w9_candidates")
def _(t):
    return sessions.candidates(t.messages, F.lit("main"))


@query("c1_greedy_clusters")
def _(t):
    return patterns.greedy_clusters(t.memories, 0.3)


@query("c3_components")
def _(t):
    return patterns.components(t.memories, 0.35)


@query("c5_patterns")
def _(t):
    return patterns.describe(patterns.greedy_clusters(t.memories, 0.3), t.memories)


@query("c4_consolidated")
def _(t):
    return patterns.consolidate(patterns.components(t.memories, 0.35), t.memories)


@query("f15_blocks", "select doc_id, count(*) as n from (select doc_id, unnest(list_filter(string_split(chr(10) || '## a' || chr(10) || text || chr(10) || '## b' || chr(10) || 'x', chr(10)), lambda l: starts_with(l, '## '))) from documents) group by 1")
def _(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("## a\n"), "text", F.lit("\n## b\nx")).alias("text"))
    return readers.blocks(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


