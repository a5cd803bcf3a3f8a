"""Queries: storing, repair, topic texts, further matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import HashingEmbedder
from ..operators import ingest, repair, retrieval, topics
from ..sources import discovery
from ..sources.derived import AS_OF
from ..sources.stages import new_path
from .registry import as_of, query
from .retrieval import Q


@query("u1_store")
def _(t):
    new = t.phrases.select(
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"), F.lit("note").alias("type"), F.col("text").alias("content"), F.lit("project:en").alias("context"), F.lit("warm").alias("tier"),
        F.lit("a").alias("agent"), F.lit(5).alias("importance"), F.array(F.lit("t")).alias("tags"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("category"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("pk."), (F.col("event_id") % 20).cast("string"))).alias("pattern_key"), F.lit(None).cast("int").alias("recurrence_count"),
        F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("ts").alias("created_at"),
    )
    return ingest.store(new, t.memories, as_of(), embedder=HashingEmbedder(64)).select("id", "content", "recurrence_count", "last_seen", F.array_join("tags", ",").alias("tags"))


@query("r18_semantic_match", """with m as (select *, embedding::double[] as e from memories where superseded_by is null and embedding is not null and created_at >= {as_of} - interval 60 day),
 s as (select c.id as cand_id, m.id as match, list_dot_product(c.embedding::double[], m.e) / (sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])) * sqrt(list_dot_product(m.e, m.e))) as s
   from memories c join m on c.context is not distinct from m.context and c.category is not distinct from m.category and c.id <> m.id where c.embedding is not null and c.id::bigint % 50 = 0)
 select cand_id, arg_max(match, (s, match)) as match, round(max(s), 4) as similarity from s where s >= 0.2 group by 1""")
def _(t):
    c = t.memories.where((F.col("id").cast("long") % 50 == 0) & F.col("embedding").isNotNull()).withColumnRenamed("id", "cand_id")
    got = ingest.semantic_match(c, t.memories, as_of(), Settings(dedupe_similarity=0.2, dedupe_days=60))
    return got.select("cand_id", "match", F.round("similarity", 4).alias("similarity"))


@query("o13_repair_counts", """select 'expired' as step, count(*) as n from memories where superseded_by is null and expires_at < {as_of}
 union all select 'orphans', count(*) from memories m where superseded_by is not null and superseded_by <> 'expired' and not exists (select 1 from memories x where x.id = m.superseded_by)
 union all select 'source_kind', count(*) from memories where superseded_by is null and source_kind is null
 union all select 'stale_tiers', count(*) from memories where superseded_by is null and ((tier = 'hot' and coalesce(last_accessed, created_at) < {as_of} - interval 60 day) or (tier = 'warm' and coalesce(last_accessed, created_at) < {as_of} - interval 90 day))
 union all select 'duplicates', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from memories where superseded_by is null group by type, content, coalesce(context,''), coalesce(agent,''))""")
def _(t):
    return repair.counts(t.memories, as_of())


@query("o13_repaired")
def _(t):
    return repair.run(t.memories, as_of()).groupBy("tier", "source_kind").agg(F.count("*").alias("n"), F.count("superseded_by").alias("superseded"))


@query("s4_found_sessions", "select 'a' || right(session_id, 1) as agent, role, count(*) as n, max(pos) as last from messages group by 1, 2")
def _(t):
    """Messages written as one log for each agent, found by their metadata, and read again."""
    folder = new_path(t.spark, "logs")
    lines = t.messages.select(F.concat(F.lit("a"), F.right("session_id", F.lit(1))).alias("agent"), F.to_json(F.struct("role", "pos", "text")).alias("line"))
    lines.write.partitionBy("agent").text(folder)
    found = discovery.discover(t.spark, folder, pattern="*.txt", agent_pattern="/agent=([^/]+)/")
    e = F.from_json("line", "role string, pos long")
    return discovery.read_found(t.spark, found).select("agent", e.alias("e")).groupBy("agent", "e.role").agg(F.count("*").alias("n"), F.max("e.pos").alias("last"))


@query("k12_topics")
def _(t):
    return topics.topic_texts(t.memories, {"decision": 8, "learning": 8, "gotcha": 10, "absent": 3})


@query("k18_eval_export", "select substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 120) as query, id as expected_id, context from memories where superseded_by is null order by importance desc, last_seen desc nulls last, id limit 80")
def _(t):
    return topics.eval_rows(t.memories)


@query("r21_bootstrap_section")
def _(t):
    return topics.bootstrap_section(retrieval.bootstrap_slots(t.memories, "src1", as_of(), 10))


@query("r15_trajectories", f"""with q as (select [{', '.join(f'{x!r}::double' for x in Q)}] as v), m as (select vec_id, embedding::double[] as e, case vec_id % 3 when 0 then 'success' when 1 then 'partial' else 'failed' end as outcome from embeddings),
 s as (select vec_id, outcome, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) as s from m, q where outcome in ('success','partial')), k as (select * from s order by s desc, vec_id limit 3)
 select vec_id, outcome, round(s, 4) as similarity from k where s >= 0.1""")
def _(t):
    from ..functions.vectors import cosine

    n = F.col("vec_id") % 3
    rows = t.embeddings.withColumn("outcome", F.when(n == 0, "success").when(n == 1, "partial").otherwise("failed")).where("outcome in ('success', 'partial')")
    best = rows.withColumn("s", cosine(F.col("embedding"), retrieval._vector(Q))).orderBy(F.desc("s"), "vec_id").limit(3)
    return best.where(F.col("s") >= 0.1).select("vec_id", "outcome", F.round("s", 4).alias("similarity"))


@query("t4_expired_at_read", f"select count(*) as n from memories where superseded_by is null and (expires_at is null or expires_at > timestamp '{AS_OF}')")
def _(t):
    from ..functions.columns import active

    return t.memories.where(active(as_of())).agg(F.count("*").alias("n"))
