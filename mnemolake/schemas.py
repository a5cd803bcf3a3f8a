"""Tables of the memory engine as Spark DDL, and the values that their enumerations allow."""

MEMORIES = """id STRING, type STRING, content STRING, context STRING, tier STRING, agent STRING, importance INT, embedding ARRAY<FLOAT>,
 created_at TIMESTAMP_NTZ, last_accessed TIMESTAMP_NTZ, access_count INT, source_session STRING, superseded_by STRING, tags ARRAY<STRING>,
 status STRING, category STRING, pattern_key STRING, recurrence_count INT, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ,
 resolved_at TIMESTAMP_NTZ, promoted_to STRING, resolution_notes STRING, source_kind STRING, source_path STRING, confidence_score DOUBLE,
 expires_at TIMESTAMP_NTZ, sensitivity STRING, feedback_score INT"""
PATTERNS = """pattern_key STRING, recurrence_count INT, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, impact_score DOUBLE,
 representative_memory_id STRING, last_memory_id STRING, last_category STRING, last_status STRING, promoted_to STRING,
 updated_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"""
QUERY_LOG = "query_hash STRING, query_kind STRING, duration_ms INT, results_count INT, avg_similarity DOUBLE, top_similarity DOUBLE, created_at TIMESTAMP_NTZ"
TRAJECTORIES = """id STRING, context STRING, problem STRING, steps ARRAY<STRUCT<action: STRING, result: STRING>>, solution STRING, outcome STRING,
 agent STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP_NTZ, times_used INT"""
SNAPSHOTS = """id STRING, project STRING, agent STRING, summary STRING, status STRING, pending_items ARRAY<STRING>, blockers ARRAY<STRING>,
 last_file_touched STRING, last_error STRING, key_urls ARRAY<STRING>, embedding ARRAY<FLOAT>, session_start TIMESTAMP_NTZ,
 session_end TIMESTAMP_NTZ, turn_count INT"""
ADVISORIES = """id STRING, agent STRING, tool STRING, action_context STRING, advisory_text STRING, source_memory_ids ARRAY<STRING>,
 confidence DOUBLE, was_followed BOOLEAN, outcome STRING, created_at TIMESTAMP_NTZ"""
CYCLES = """id STRING, agent STRING, tool STRING, project STRING, context STRING, prediction STRING, predicted_outcome STRING,
 actual_outcome STRING, accuracy DOUBLE, evaluation_notes STRING, learning_memory_id STRING, status STRING, created_at TIMESTAMP_NTZ,
 evaluated_at TIMESTAMP_NTZ, distilled_at TIMESTAMP_NTZ"""
MESSAGES = "agent STRING, session_id STRING, pos LONG, entry_type STRING, role STRING, text STRING, ts TIMESTAMP_NTZ"
LEARNING_DETAILS = """memory_id STRING, category STRING, what_was_wrong STRING, what_is_correct STRING, source STRING, error_message STRING,
 command_attempted STRING, stack_trace STRING, reproducible STRING, suggested_fix STRING, environment STRING, related_files ARRAY<STRING>,
 requested_capability STRING, user_context STRING, complexity STRING, suggested_implementation STRING, frequency STRING,
 promotion_status STRING, promoted_to STRING, promoted_at TIMESTAMP_NTZ, see_also ARRAY<STRING>, created_at TIMESTAMP_NTZ"""
PACKS = "id STRING, data STRUCT<context: STRING, memoryCount: INT, avgImportance: DOUBLE, pack: STRING, generatedAt: STRING>, embedding ARRAY<FLOAT>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
PILOT_LOG = "agent STRING, own_memories INT, team_memories INT, total_chars INT, injected_at TIMESTAMP_NTZ"
DISTILLATION_LOG = "id STRING, session_file STRING, memories_created INT, memories_skipped INT, processed_at TIMESTAMP_NTZ"

# Fixed values of the data model.
TYPES = ("decision", "action", "learning", "gotcha", "note", "feature_request", "fact")
TIERS = ("hot", "warm", "cold", "archive")
STATUSES = ("pending", "in_progress", "resolved", "promoted", "wont_fix")
SOURCE_KINDS = ("user_explicit", "agent_inference", "tool_verified", "llm_distilled", "markdown_import", "regex_extraction", "summary_derived", "consolidated")
SENSITIVITIES = ("normal", "sensitive", "restricted")
OUTCOMES = ("success", "partial", "failed")
HIGH_RISK_TOOLS = ("exec", "deploy", "railway", "delete", "rm", "drop", "git push", "git force-push", "migration", "cron", "message send", "email send")
TIER_BONUS = {"hot": 0.15, "warm": 0.05, "cold": -0.05, "archive": -0.10}
TIER_IMPACT = {"hot": 1.0, "warm": 0.7, "cold": 0.4, "archive": 0.2}
