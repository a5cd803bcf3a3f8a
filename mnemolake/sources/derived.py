"""Engine tables derived from the generic test tables, by one SQL text for both engines: {T} is the timestamp type, {S} the
string type, {L} the list constructor. Times never come from a clock: AS_OF is a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-04-01 00:00:00"
_SPARK = {"T": "timestamp_ntz", "S": "string", "L": "array"}
_DUCK = {"T": "timestamp", "S": "varchar", "L": "list_value"}

TABLES = {
    "memories": """
select cast(d.doc_id as {S}) as id,
  case d.doc_id % 7 when 0 then 'decision' when 1 then 'action' when 2 then 'learning' when 3 then 'gotcha'
    when 4 then 'note' when 5 then 'feature_request' else 'fact' end as type,
  d.text as content,
  case when d.doc_id % 11 = 0 then null else concat('project:', d.lang) end as context,
  case when (d.doc_id*7)%10 <= 2 then 'hot' when (d.doc_id*7)%10 <= 6 then 'warm' when (d.doc_id*7)%10 <= 8 then 'cold' else 'archive' end as tier,
  case when d.doc_id % 9 = 0 then null else d.source end as agent,
  cast(1 + (d.doc_id*13)%10 as int) as importance,
  e.embedding as embedding,
  cast('2024-01-01 00:00:00' as {T}) + (d.doc_id % 60) * interval '1' day as created_at,
  case when (d.doc_id*5)%14 = 0 then null else cast('2024-01-01 00:00:00' as {T}) + ((d.doc_id*3)%90) * interval '1' day end as last_accessed,
  cast((d.doc_id*5)%14 as int) as access_count,
  concat('s', cast(d.doc_id % 50 as {S})) as source_session,
  case when d.doc_id%41=0 then 'expired' when d.doc_id%43=0 then 'gone' when d.doc_id%17=0 then cast(d.doc_id+1 as {S}) end as superseded_by,
  {L}(concat('lang:', d.lang), case when d.doc_id % 3 = 0 then 'cross-agent' else 'auto-harvested' end) as tags,
  case d.doc_id % 5 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'resolved' when 3 then 'promoted' else 'wont_fix' end as status,
  case d.doc_id % 6 when 0 then 'error' when 1 then 'learning' when 2 then 'best_practice' when 3 then 'correction' when 4 then 'infrastructure' end as category,
  case when d.doc_id % 4 = 0 then concat('pk.', cast(d.doc_id % 20 as {S})) end as pattern_key,
  cast(1 + d.doc_id % 6 as int) as recurrence_count,
  cast('2024-01-01 00:00:00' as {T}) + (d.doc_id % 60) * interval '1' day as first_seen,
  cast('2024-01-01 00:00:00' as {T}) + ((d.doc_id*7)%90) * interval '1' day as last_seen,
  case when d.doc_id % 23 = 0 then cast('2024-02-01 00:00:00' as {T}) + (d.doc_id % 100) * interval '1' day end as expires_at,
  case when d.doc_id % 6 = 0 then null else cast(d.doc_id % 10 as double)/10 end as confidence_score,
  case when d.doc_id % 8 = 0 then null else 'agent_inference' end as source_kind,
  cast(coalesce(l.quality*2-1,0) - coalesce(l.toxic,0) as int) as feedback_score
from documents d left join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id""",
    "query_log": """
select concat('q', cast(event_id % 97 as {S})) as query_hash, case when event_type in ('view', 'click') then 'search' else 'inject' end as query_kind,
  cast(floor(value) as int) as duration_ms, cast(event_id % 12 as int) as results_count, cast(event_id % 100 as double)/100 as avg_similarity,
  cast(event_id % 50 + 50 as double)/100 as top_similarity, ts as created_at
from events""",
    "cycles": """
select cast(event_id as {S}) as id, concat('agent', cast(user_id % 7 as {S})) as agent, event_type as tool,
  case when event_id % 5 = 0 then null else concat('p', cast(event_id % 3 as {S})) end as project, concat('will ', event_type) as prediction,
  concat('did ', event_type) as actual_outcome, case when event_id % 3 = 0 then null else cast(event_id % 101 as double)/100 end as accuracy,
  case when event_id % 2 = 0 then 'seen twice' end as evaluation_notes,
  case event_id % 3 when 0 then 'predicted' when 1 then 'evaluated' else 'distilled' end as status, ts as created_at
from events""",
    "requests": "select event_id, concat('agent', cast(user_id % 7 as {S})) as agent, event_type as tool, ts from events",
    "messages": """
select concat('s', cast(conv_id as {S})) as session_id, turn as pos, case when turn % 3 = 2 then 'tool' else role end as role,
  case when turn % 3 = 2 then concat('Error: step ', cast(turn as {S}), ' failed. Process exited with code ', cast((conv_id + turn) % 4 as {S}), '; command: build ', cast(conv_id % 5 as {S}))
    when turn % 3 = 0 and turn > 0 then concat('fixed, works now: ', text) when turn % 5 = 1 then concat('We decided to keep it. ', text) else text end as text,
  cast('2024-03-01 00:00:00' as {T}) + (conv_id % 20) * interval '1' day + turn * interval '1' minute as ts
from conversations""",
    "phrases": """
select event_id, case event_id % 12 when 0 then concat('Error: ', event_type, ' failed for user ', cast(user_id as {S}))
  when 1 then concat('We decided to switch ', event_type, ' for good') when 2 then concat('Watch out: a trap near ', event_type)
  when 3 then concat('It turns out that ', event_type, ' was the root cause') when 4 then concat('Always prefer ', event_type, ' as best practice')
  when 5 then concat('deploy config for ', event_type, ' PORT: 80', cast(10 + user_id % 90 as {S}), ' branch: main/', event_type) when 6 then 'ok'
  when 7 then concat('mail to user', cast(user_id as {S}), '@example.com from 10.0.0.', cast(user_id % 250 as {S}))
  when 8 then concat('https://', event_type, '-', cast(user_id as {S}), '.vercel.app/x and database: postgres://u:p@host/', event_type)
  when 9 then concat('sk-abcdefghijklmnop', cast(100000 + event_id as {S}), ' and AKIAABCDEFGHIJKL', cast(1000 + event_id % 9000 as {S}))
  when 10 then concat('The ', event_type, ' backlog needs a wish list. Missing rule! Unknown gap?\nNext line ', cast(event_id as {S}))
  else concat('plain words about ', event_type) end as text, event_type, user_id, ts from events""",
}
TABLES["patterns"] = """
select pattern_key, cast(max(recurrence_count) as int) as recurrence_count, min(first_seen) as first_seen, max(last_seen) as last_seen,
  max(importance * case tier when 'hot' then 1.0e0 when 'warm' then 0.7e0 when 'cold' then 0.4e0 else 0.2e0 end) as impact_score,
  min(id) as representative_memory_id, max(id) as last_memory_id, max(status) as last_status
from memories where pattern_key is not null group by pattern_key"""
BASE = ("documents", "embeddings", "labels", "events", "conversations", "pages", "lineitem", "orders", "customer", "part", "supplier", "nation", "region", "benchmark")
NEEDS = {"patterns": ("memories",)}


def text_of(name: str, dialect: dict = _DUCK) -> str:
    sql = TABLES[name]
    for key, value in dialect.items():
        sql = sql.replace("{" + key + "}", value)
    return sql


def with_tables(sql: str) -> str:
    """A DuckDB query with the derived tables it names in front of it."""
    import re

    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    names = [n for n in TABLES if n in used or any(n in NEEDS.get(u, ()) for u in used)]
    return "with " + ",\n".join(f"{n} as ({text_of(n)})" for n in names) + ",\nq as (" + sql + ")\nselect * from q" if names else sql


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its base tables are read where they are named, without registering anything globally."""
    import re

    sql, base = text_of(name, _SPARK), {}
    for other in (*BASE, *TABLES):
        if other != name and re.search(rf"(?:from|join) {other}\b", sql):
            base[other] = derived(spark, sf_dir, other) if other in TABLES else spark.read.parquet(f"{sf_dir}/{other}.parquet")
    for other in base:
        sql = re.sub(rf"\b(from|join) {other}\b", rf"\1 {{{other}}}", sql)
    return spark.sql(sql.replace("\\n", "\n"), **base)
