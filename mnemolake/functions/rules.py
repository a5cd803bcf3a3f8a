"""Ordered rule tables (the first match wins) and the classifiers made of them, as built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern (matched in any case) and what it yields."""

    pattern: str
    type: str | None = None
    importance: int | None = None
    category: str | None = None

    def hits(self, text: Column) -> Column:
        return text.rlike(f"(?iu){self.pattern}")


# Patterns and outcomes of the classifiers. A-Za-z look-arounds are not needed, as none of them uses \b.
NOISE = (r"^(ok|yes|no|sure|done|listo|sí|si|thanks|gracias)\.?$", r"^\s*$")
NOISE_EXACT = ("HEARTBEAT_OK", "NO_REPLY")
SESSION_SKIPS = (
    "(?i)^(sí|si|ok|listo|hecho|done|entendido|perfecto|claro)",
    "(?i)heartbeat|cron.*complet|session cleanup|health check",
    "(?i)^no_reply$",
    "(?i)sin cambios|no changes|nothing to report",
    r"^\[.*\]\s*✅",
    r"^```[\s\S]{200,}```",
    r"(?m)^\s*(import|const|function|class|export|interface|type )\s",
    "(?i)^(Here'?s|Aquí (está|va)|Te muestro|I'll create)",
    r"node_modules|package\.json|tsconfig|\.gitignore",
    r"Successfully wrote \d+ bytes",
    "Process exited with code",
)
SESSION_RULES = (
    Rule("(?:decid|decisión|decidimos|elegimos|vamos a usar|switched to|migrat|adoptamos|en vez de|reemplaz)", "decision", 7),
    Rule("(?:la solución|the fix|se resolvió|fix(?:ed|eado)|corregido|arreglado|el problema era)", "learning", 7, "error"),
    Rule("(?:error|fail|crash|bug|broke|fallo|falló|roto|no funciona|se cayó|exception|stack trace)", "learning", 6, "error"),
    Rule("(?:gotcha|cuidado|watch out|careful|trap|caveat|ojo con|no usar|avoid|nunca|prohibido)", "gotcha", 7, "correction"),
    Rule("(?:aprendí|descubrí|resulta que|turns out|actually|en realidad|lo que pasa|the issue was|root cause)", "learning", 6, "learning"),
    Rule("(?:best practice|patrón|convention|siempre|always|nunca|never|regla|rule|estándar)", "note", 6, "best_practice"),
    Rule("(?:arquitectura|architecture|diseño|schema|structure|pipeline|workflow|integración)", "decision", 6),
    Rule("(?:config|configuración|setup|instalé|installed|deploy|variable|env|api.?key|token)", "note", 5, "correction"),
)
SESSION_SIGNAL = "(?iu)(?:importante|critical|key|clave|nota:|note:|resumen|summary|conclusion|resultado|result)"
ENTRY_SKIPS = ("(?i)^(ok|listo|done|hecho|sí|si|no)$", "(?i)heartbeat_ok", "(?i)no_reply", "(?i)sin cambios|no changes|nothing to report", r"^\| .* \| .* \|", "^```")
ENTRY_RULES = (
    Rule("(?:fix(?:ed|eado)?|corregid[oa]|arreglad[oa]|solución|soluciona|the fix|se resolvió|→.*(?:fix|arregl|correg))", "learning", 7, "error"),
    Rule("(?:decid|decisión|decidimos|elegimos|se.*(?:cambió|migró|movió)|vamos a usar|switched|reemplaz|en vez de)", "decision", 7),
    Rule("(?:bug|error|fallo|falló|roto|crash|broke|no funciona|causa|root cause|issue|problema)", "learning", 6, "error"),
    Rule("(?:gotcha|cuidado|ojo con|nunca|no usar|avoid|prohibido|trap|caveat|watch out)", "gotcha", 7, "correction"),
    Rule("(?:config|configuración|setup|instalé|installed|deploy|habilitado|activado|desactivado|variable|env|api.?key|token|renovad[oa])", "note", 6, "infrastructure"),
    Rule("(?:aprendí|descubrí|resulta que|turns out|actually|en realidad|lo que pasa|the issue was)", "learning", 6, "learning"),
    Rule("(?:arquitectura|architecture|pipeline|workflow|schema|migración|migration|restructura)", "decision", 6),
    Rule("(?:cread[oa]|creamos|built|construi|automated|automatiz|script nuevo|new script)", "note", 5, "infrastructure"),
    Rule("(?:audit|verificad[oa]|confirmed|validado|tests? pass|28/28|all.*pass)", "note", 5, "best_practice"),
)
ENTRY_SIGNAL = "(?iu)(?:importante|critical|key|clave|resumen|summary|resultado|result|conclus)"
BLOCK_RULES = (
    Rule("(?:decisión|decided|decidimos|elegimos|vamos a usar|switched to|migrat|adoptamos|reemplaz)", "decision", 7),
    Rule("(?:error|fix|bug|fallo|falló|crash|broke|roto|no funciona|se cayó|exception|la solución|se resolvió|corregido|arreglado|el problema era)", "learning", 7, "error"),
    Rule("(?:gotcha|cuidado|watch out|careful|trap|caveat|ojo con|no usar|avoid|prohibido)", "gotcha", 7, "correction"),
)
CATEGORY_RULES = (
    Rule("error|fail|crash|bug|broke|fix|wrong|issue", "learning", None, "error"),
    Rule("learn|realiz|discover|found out|turns out|actually", "learning", None, "learning"),
    Rule("decid|chose|decision|switch|migrat|adopt|use.*instead", "decision", None, None),
    Rule("gotcha|careful|watch out|trap|caveat|warning|don't|avoid", "gotcha", None, "correction"),
    Rule("feature|request|want|need|wish|should add", "feature_request", None, "feature_request"),
    Rule("best practice|pattern|convention|always|never|rule", "note", None, "best_practice"),
    Rule("gap|missing|didn't know|unknown|unclear", "learning", None, "knowledge_gap"),
)
THEMES = (
    Rule("error|fail|crash|bug|exception", "error"), Rule("deploy|railway|release|production", "deploy"), Rule("api.?key|token|auth|credential", "auth"),
    Rule("config|setup|install|migration", "config"), Rule("test|spec|coverage|assert", "testing"), Rule("performance|slow|timeout|latency", "perf"),
    Rule("memory|embedding|vector", "memory"), Rule("session|agent|spawn|subagent", "agent"), Rule("git|commit|branch|merge|pr", "git"),
    Rule("cron|schedule|heartbeat|periodic", "cron"), Rule("slack|telegram|discord|message", "messaging"), Rule("notion|database|postgres|sql", "data"),
    Rule("frontend|html|css|react|ui", "frontend"), Rule("email|smtp|gmail|sendgrid", "email"), Rule("lead|pipeline|crm|prospect", "leads"),
)
PROJECTS = (Rule("emailbot|gmail.*autom", "emailbot"), Rule("notion.*crm|lead.*gen", "lead-gen"), Rule("railway|deploy", "infrastructure"))
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "from", "have", "been", "were", "are", "was", "will", "can", "not", "but", "all", "she", "her",
    "his", "its", "they", "them", "what", "when", "which", "who", "how", "each", "other", "como", "para", "que", "del", "los", "las", "una", "con",
    "por", "más", "pero", "este", "esta", "estos", "estas", "todo", "toda", "todos",
)
TOOL_TAGS, TOOL_WORDS = ("cli", "tool", "command", "integration", "api"), r"\b(command|cli|api|endpoint|config|path|binary|permission|port|url)\b"
STYLE_TAGS, STYLE_WORDS = ("behavior", "style", "tone", "communication"), r"\b(always|never|prefer|avoid|style|tone|format|language)\b"
RUNTIME_ERRORS = (
    r"(?i)\berror[:\s]", r"(?i)\bfailed\b", r"(?i)\bexception[:\s]", r"(?i)\bpermission denied\b", r"(?i)\bcommand (exited|failed) with code [1-9]",
    r"\bENOENT\b", r"\bEACCES\b", r"(?i)\btimeout\b", r"(?i)\b(FATAL|PANIC|crash)\b",
)
NOT_ERRORS = (
    r"^\s*(const|let|var|function|class|import|export|require|module)\b", r"(?i)^\s*(CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE)\s", r"^\s*#!",
    r"(?i)console\.(error|log|warn)\s*\(", r"(?i)catch\s*\(\s*(e|err|error)\s*\)", r"(?i)\.on\(\s*['\"]error['\"]",
)
FIX_WORDS = ("fixed", "resolved", "works now", "success", "listo", "resuelto", "funcionando")
DECISION_WORDS = r"(?iu)\b(decided|going with|elegimos|vamos con|vamos a usar|the plan is|let's go with|optamos por)\b"
EXIT_CODE = r"(?i)(?:exit(?:ed)?\s+(?:with\s+)?(?:code|status)\s+(\d+)|Process exited with code (\d+))"
COMMAND = "(?i)(?:command|cmd|exec|running|ran)[\\s:]*[`\"']?([^\\n`\"']{5,120})"
ERROR_MESSAGES = (
    r"(?:Error|ERROR|FATAL|CRITICAL):\s*(.{10,200})", r"(?:TypeError|ReferenceError|SyntaxError|RangeError):\s*(.{10,200})",
    r"(?:ENOENT|EACCES|EPERM|ECONNREFUSED):\s*(.{10,200})", r"(?i)permission denied[:\s]*(.{5,150})", r"(?i)command not found[:\s]*(.{5,80})",
)
# name, pattern, group of the value (0: all), label, category, importance, tier
FACTS = (
    ("railway_url", r"(?i)https?://[\w-]+(?:\.up)?\.railway\.app\b[^\s)>\]\"']*", 0, "Railway URL: ", "infrastructure", 8, "hot"),
    ("railway_service", r"(?i)(?:railway\s+)?(?:servicio?|service)\s+[`\"']?([\w-]{3,})[`\"']?\s*(?:→|->|=|:|\()\s*(?:frontend|backend|api|worker|web|app)", 0, "Railway service mapping: ", "infrastructure", 8, "hot"),
    ("vercel_url", r"(?i)https?://[\w-]+\.(?:vercel|netlify)\.app\b[^\s)>\]\"']*", 0, "Deploy URL: ", "infrastructure", 8, "hot"),
    ("github_repo", r"(?i)(?:repo(?:sitorio?)?|repositorio?)\s*(?::|→|->|=)?\s*(?:https?://github\.com/)?([\w-]+/[\w.-]+)", 1, "GitHub repo: ", "project_registry", 7, "hot"),
    ("service_url_declaration", r"(?i)(?:frontend|backend|api|dashboard)\s*(?:URL|endpoint|link|dirección|url)\s*(?::|→|->|=|es)\s*(https?://[^\s)>\]\"']+)", 0, "Service URL: ", "infrastructure", 9, "hot"),
    ("root_directory", r"(?i)(?:root\s+dir(?:ectory)?|directorio\s+raíz?|carpeta\s+(?:principal|raíz?))\s*(?::|→|->|=|`)\s*[`\"']?([\w./-]{2,})[`\"']?", 0, "Project root directory: ", "project_registry", 7, "warm"),
    ("port_config", r"(?i)(?:PORT|puerto)\s*(?:=|:)\s*(\d{2,5})\b", 0, "Port config: ", "infrastructure", 6, "warm"),
    ("database_url", r"(?i)(?:DATABASE_URL|database|db)\s*(?:=|:)\s*(postgres(?:ql)?://[^\s\"']+)", 1, "Database: ", "infrastructure", 7, "warm"),
    ("project_service_map", r"(?i)[`\"*]*([a-z][\w-]{2,})[`\"*]*\s*(?:→|->|=|es el?|is the?)\s*(?:el\s+)?(?:frontend|backend|api|web|dashboard|worker|service)\b", 0, "Project mapping: ", "project_registry", 8, "hot"),
    ("branch_info", r"(?i)(?:branch|rama)\s*(?::|=|→|->)\s*[`\"']?([\w./-]{2,60})[`\"']?", 0, "Branch: ", "project_registry", 6, "warm"),
)


def ascii_words(pattern: str) -> str:
    """\\b as between ASCII word characters and others."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(ascii_words(p.replace("(?i)", "(?iu)")))
    return out


def _struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.type).alias("type"), F.lit(rule.importance).cast("int").alias("importance"), F.lit(rule.category).cast("string").alias("category"))


def first_match(text: Column, rules, otherwise: Column | None = None) -> Column:
    out = otherwise if otherwise is not None else F.lit(None)
    for rule in reversed(rules):
        out = F.when(rule.hits(text), _struct(rule)).otherwise(out)
    return out


def gate(content: Column, importance: Column) -> Column:
    """length, importance (1 for fewer than 20 characters) and skip reason of a candidate."""
    text = F.trim(F.coalesce(content, F.lit("")))
    noise = _any(text, [f"(?i){p}" for p in NOISE]) | text.isin(*NOISE_EXACT)
    low = F.least(F.coalesce(importance, F.lit(1)), F.lit(1))
    return F.struct(F.length(text).alias("length"), F.when(F.length(text) < 20, low).otherwise(importance).alias("importance"), F.when(noise, F.lit("noise_pattern")).alias("skip"))


def session_message(text: Column) -> Column:
    note = F.when((F.length(text) > 800) & text.rlike(SESSION_SIGNAL), _struct(Rule("", "note", 5)))
    return F.when(~_any(text, SESSION_SKIPS), first_match(text, SESSION_RULES, note))


def entry(text: Column, heading: Column) -> Column:
    both = F.lower(F.concat(heading, F.lit(" "), text))
    note = F.when((F.length(text) > 300) & text.rlike(ENTRY_SIGNAL), _struct(Rule("", "note", 5)))
    return F.when((F.length(text) >= 60) & ~_any(text, ENTRY_SKIPS), first_match(both, ENTRY_RULES, note))


def block(text: Column) -> Column:
    return first_match(F.lower(text), BLOCK_RULES, _struct(Rule("", "note", 5)))


def category(content: Column, type_: Column) -> Column:
    return first_match(content, CATEGORY_RULES, F.struct(type_.alias("type"), F.lit(None).cast("int").alias("importance"), F.lit(None).cast("string").alias("category")))


def importance(content: Column, tier: Column, accesses: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    n = F.length(F.coalesce(content, F.lit("")))
    return F.least(F.lit(10), F.greatest(F.lit(1), F.lit(5) + one(n > 500) + one(n > 1000) + one(tier == "hot") + one(accesses > 3) + one(accesses > 10)))


def theme(text: Column) -> Column:
    return F.coalesce(first_match(text, THEMES).getField("type"), F.lit("general"))


def project(text: Column, rules=PROJECTS) -> Column:
    """The project that the text speaks of; the rules are a parameter, as projects differ."""
    path = F.nullif(F.regexp_extract(text, r"/workspace[/-](\w[\w-]{2,20})", 1), F.lit(""))
    return F.coalesce(first_match(text, rules).getField("type"), path, F.lit("general"))


def promotion_target(content: Column, category_: Column, tags: Column) -> Column:
    low, cat = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(category_, F.lit("")))
    has = lambda names: F.arrays_overlap(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, names)))
    tool = cat.isin("infrastructure", "error") | F.coalesce(has(TOOL_TAGS), F.lit(False)) | low.rlike(ascii_words(TOOL_WORDS))
    style = cat.isin("best_practice", "preference") | F.coalesce(has(STYLE_TAGS), F.lit(False)) | low.rlike(ascii_words(STYLE_WORDS))
    return F.when(tool, "TOOLS.md").when(style, "SOUL.md").otherwise("AGENTS.md")


def session_status(blockers: Column, errors: Column, turns: Column, last_text: Column) -> Column:
    done = F.substring(last_text, 1, 300).rlike("(?iu)(?:listo|done|complet|terminado|finished|deployed)")
    return F.when((blockers > 0) | (errors > 3), "blocked").when(turns < 3, "paused").when(F.coalesce(done, F.lit(False)), "completed").otherwise("in_progress")


def runtime_error(text: Column) -> Column:
    return (F.length(text) <= 2000) & _any(text, RUNTIME_ERRORS) & ~_any(text, NOT_ERRORS) & (F.size(F.split(text, "\n")) <= 30)


def says_fixed(text: Column) -> Column:
    out = F.lit(False)
    for w in FIX_WORDS:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def decision(text: Column) -> Column:
    return text.rlike(ascii_words(DECISION_WORDS))


def exit_failure(text: Column) -> Column:
    """code, command and snippet of a tool result that ended with a code other than 0."""
    code = F.coalesce(F.nullif(F.regexp_extract(text, EXIT_CODE, 1), F.lit("")), F.nullif(F.regexp_extract(text, EXIT_CODE, 2), F.lit(""))).try_cast("int")
    command = F.nullif(F.trim(F.regexp_extract(text, COMMAND, 1)), F.lit(""))
    return F.when(code != 0, F.struct(code.alias("code"), command.alias("command"), F.trim(F.regexp_replace(F.substring(text, 1, 300), r"\s+", " ")).alias("snippet")))


def error_message(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in ERROR_MESSAGES))


def _fact(name: str, label: str, cat: str, imp: int, tier: str):
    def build(x: Column) -> Column:
        value = F.regexp_replace(x, "//[^@]+@", "//***@") if name == "database_url" else F.trim(x)
        return F.struct(F.lit(name).alias("name"), F.concat(F.lit(label), value).alias("content"), F.lit(cat).alias("category"), F.lit(imp).alias("importance"), F.lit(tier).alias("tier"))

    return build


def facts(text: Column) -> Column:
    """All facts in a text: structs of name, content, category, importance, tier."""
    found = (F.transform(F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(group)), _fact(name, *rest)) for name, pattern, group, *rest in FACTS)
    return F.flatten(F.array(*found))


def quality_score(as_of: Column, missing_files: Column | None = None) -> Column:
    """0..10 from age, accesses, length, missing files, tier coherence and recurrence of a memories row."""
    from .columns import days_between

    c, n = F.col, F.length(F.coalesce("content", F.lit("")))
    days, used, imp, tier = days_between(as_of, F.coalesce("last_accessed", "created_at")), F.coalesce(c("access_count"), F.lit(0)), F.coalesce(c("importance"), F.lit(5)), F.coalesce(c("tier"), F.lit("warm"))
    part = [
        F.when(days > 30, -2.0).when(days > 14, -1.0).when(days <= 3, 1.0).otherwise(0.0),
        F.when(used >= 10, 2.0).when(used >= 5, 1.0).when(used == 0, -1.0).otherwise(0.0),
        F.when(n >= 100, 1.0).when(n < 50, -1.0).otherwise(0.0),
        F.when((tier == "cold") & (imp >= 8), 2.0).when((tier == "cold") & (imp >= 7), 1.0).otherwise(0.0),
        F.when((tier == "hot") & (imp <= 3), -2.0).when((tier == "hot") & (imp <= 4), -1.0).otherwise(0.0),
        F.when(F.coalesce(c("recurrence_count"), F.lit(0)) >= 3, 1.0).otherwise(0.0),
    ]
    total = F.lit(5.0)
    for p in part:
        total = total + p
    if missing_files is not None:
        total = total - F.lit(0.5) * missing_files
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 1)


def promote_tier(tier: Column) -> Column:
    return F.when(tier.isin("warm", "hot"), "hot").otherwise("warm")  # an unknown tier counts as cold


def degrade_tier(tier: Column) -> Column:
    return F.when(tier == "hot", "warm").otherwise("cold")


def quality_action(score: Column) -> Column:
    """action, tier and importance that a score asks for."""
    tier, imp = F.coalesce(F.col("tier"), F.lit("warm")), F.coalesce(F.col("importance"), F.lit(5))
    made = lambda a, t, i: F.struct(F.lit(a).alias("action"), t.alias("tier"), i.cast("int").alias("importance"))
    return (
        F.when((imp >= 7) & (tier == "cold") & (score >= 5), made("promote", promote_tier(tier), imp))
        .when(score >= 7, made("maintain", tier, imp)).when(score >= 4, made("degrade", degrade_tier(tier), F.greatest(imp - 1, F.lit(1))))
        .otherwise(made("archive", F.lit("cold"), F.lit(1)))
    )
