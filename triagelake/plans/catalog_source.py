"""Source trees, context, change detection, caches, deliveries, redaction: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import digest, redact
from triagelake.operators import cache, context, incremental
from triagelake.plans.registry import query
from triagelake.sources import deliveries as dv
from triagelake.sources import tree

# ------------------------------------------------------- trees and lines

_FOLDER = "CASE source WHEN 'src1' THEN 'node_modules/x' WHEN 'src2' THEN '.git' WHEN 'src3' THEN '.github' ELSE source END"
_SUFFIX = "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.tsx' WHEN 'de' THEN '.md' ELSE '.go' END"
_PATH = f"'app/' || {_FOLDER} || '/f' || CAST(doc_id AS STRING) || {_SUFFIX}"


@query(
    "s16_list_files",
    f"SELECT path, sha256(text) AS hash FROM (SELECT {_PATH} AS path, source, lang, text FROM documents) d "
    "WHERE source NOT IN ('src1', 'src2') AND lang <> 'de'",
)
def _(t):
    files = t.documents.selectExpr(f"{_PATH} AS path", "CAST(text AS BINARY) AS content")
    return tree.list_files(files, [".py", ".tsx", ".go"])


@query(
    "s17_numbered_lines",
    "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, unnest(range(1, len(l) + 1)) AS line_number, "
    "unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d",
)
def _(t):
    return tree.numbered_lines(t.source_files).withColumn("line_number", F.col("line_number").cast("long"))


@query(
    "j04_line_context",
    "SELECT g.id, g.line_number, greatest(1, g.line_number - 10) AS context_start_line, "
    "least(len(l), g.line_number + 10) AS context_end_line, "
    "array_to_string(list_slice(l, greatest(1, g.line_number - 10), least(len(l), g.line_number + 10)), chr(10)) AS context_code "
    "FROM located_findings g JOIN (SELECT file_path, string_split(content, chr(10)) AS l FROM source_files) s "
    "ON g.file_path = s.file_path",
    "located_findings source_files",
)
def line_context(t):
    out = context.line_context(t.located_findings, t.source_files)
    return out.select(
        "id",
        "line_number",
        F.col("context_start_line").cast("int").alias("context_start_line"),
        F.col("context_end_line").cast("long").alias("context_end_line"),
        "context_code",
    )


@query(
    "j04_line_edges",
    "WITH f AS (SELECT doc_id % 100 AS repo, 'f' || CAST(doc_id // 100 AS VARCHAR) AS file_path, string_split(text, chr(10)) AS l FROM documents), "
    "g AS (SELECT *, unnest([0, 7, 65, 1000000]) AS line_number FROM f) SELECT repo, file_path, line_number, greatest(1, line_number - 10) AS context_start_line, "
    "least(len(l), line_number + 10) AS context_end_line, coalesce(array_to_string(list_slice(l, greatest(1, line_number - 10), least(len(l), line_number + 10)), chr(10)), '') "
    "AS context_code FROM g",
)
def _(t):
    """A hundred repositories share their paths; lines before the first and far past the last."""
    files = t.documents.selectExpr("doc_id % 100 AS repo", "'f' || CAST(doc_id div 100 AS STRING) AS file_path", "text AS content")
    lines = F.explode(F.array(*[F.lit(k) for k in (0, 7, 65, 1_000_000)])).alias("line_number")
    return context.line_context(files.select("repo", "file_path", lines), files, by=["repo", "file_path"])


# Five lines of Python per line of the document: an import, a class, a method of two lines
# and a blank one, so that the right spans are known by arithmetic.
_CODE = (
    "array_join(transform(split(text, '\\n', -1), (line, j) -> concat('import mod', j, '\\nclass C', j, "
    "':\\n    def m', j, '(self):\\n        x = ', length(line), '\\n')), '\\n')"
)


def _python_files(t):
    docs = t.documents
    return docs.selectExpr("'doc/' || CAST(doc_id AS STRING) AS file_path", f"{_CODE} AS content", "'python' AS language")


def _places(t):
    return t.located_findings


@query(
    "j05_enclosing_context",
    "WITH p AS (SELECT g.id, CAST((g.line_number - 1) // 5 AS INT) AS j, (g.line_number - 1) % 5 AS r, l, g.line_number "
    "FROM located_findings g JOIN (SELECT file_path, string_split(content, chr(10)) AS l FROM source_files) s "
    "ON g.file_path = s.file_path), q AS (SELECT id, line_number, r, j, len(l) AS n, length(l[j + 1]) AS w FROM p) "
    "SELECT id, CASE WHEN r IN (2, 3) AND j < n THEN 'm' || CAST(j AS VARCHAR) END AS function_name, "
    "CASE WHEN r IN (1, 2, 3) AND j < n THEN 'C' || CAST(j AS VARCHAR) END AS class_name, "
    "CASE WHEN r IN (2, 3) AND j < n THEN 'function' WHEN r = 1 AND j < n THEN 'class' ELSE "
    "'line_based_fallback' END AS context_type, CASE WHEN r IN (2, 3) AND j < n THEN 'def m' || CAST(j AS VARCHAR) || '(self):' "
    "|| chr(10) || '        x = ' || CAST(w AS VARCHAR) WHEN r = 1 AND j < n THEN 'class C' || CAST(j AS VARCHAR) || ':' || chr(10) || "
    "'    def m' || CAST(j AS VARCHAR) || '(self):' || chr(10) || '        x = ' || CAST(w AS VARCHAR) END AS span_text, "
    "array_to_string(list_transform(range(0, least(10, n)), lambda k: 'import mod' || CAST(k AS VARCHAR)), '|') AS imports FROM q",
    "located_findings source_files",
)
def _(t):
    out = context.attach_context(_places(t), _python_files(t))
    return out.select(
        "id",
        "context.function_name",
        "context.class_name",
        "context.context_type",
        F.when(F.col("context.context_type").isin("function", "class"), F.col("context.context_code")).alias("span_text"),
        F.array_join("context.imports", "|").alias("imports"),
    )


@query(
    "f18_symbol_spans",
    "WITH s AS (SELECT file_path, unnest(range(0, len(l))) AS j FROM (SELECT file_path, string_split(content, chr(10)) AS l "
    "FROM source_files) z) SELECT file_path, 'class' AS kind, 'C' || CAST(j AS VARCHAR) AS name, CAST(5 * j + 2 AS INT) AS start_line, "
    "CAST(5 * j + 4 AS INT) AS end_line FROM s UNION ALL SELECT file_path, 'function', 'm' || CAST(j AS VARCHAR), "
    "CAST(5 * j + 3 AS INT), CAST(5 * j + 4 AS INT) FROM s",
    "source_files",
)
def _(t):
    return context.spans(_python_files(t))


@query(
    "j06_file_imports",
    "SELECT file_path, array_to_string(list_slice(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), "
    "lambda x: regexp_matches(x, '^import\\b')), 1, 10), '|') AS imports FROM (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, "
    "regexp_replace(text, '(^|\\n)[A-Z]', '\\1import ', 'g') AS content FROM documents) f",
)
def _(t):
    files = t.documents.selectExpr(
        "'doc/' || CAST(doc_id AS STRING) AS file_path",
        r"regexp_replace(text, '(^|\\n)[A-Z]', '$1import ') AS content",
        "'javascript' AS language",
    )
    out = context.file_imports(files)
    return out.select("file_path", F.array_join("imports", "|").alias("imports"))


# ------------------------------------------------------ change detection


@query(
    "j07_compare_manifests",
    "SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' "
    "WHEN n.hash = o.hash THEN 'same' ELSE 'changed' END AS status FROM manifest_new n FULL OUTER JOIN manifest_old o "
    "ON n.path = o.path",
    "manifest_new manifest_old",
)
def _(t):
    return incremental.compare_manifests(t.manifest_new, t.manifest_old).select("path", "status")


@query(
    "j07_changed_files",
    "SELECT n.path, n.hash FROM manifest_new n LEFT JOIN manifest_old o ON n.path = o.path WHERE o.path IS NULL OR "
    "o.hash <> n.hash",
    "manifest_new manifest_old",
)
def changed_files(t):
    return incremental.changed_files(t.manifest_new, t.manifest_old, [".py"])


@query(
    "j07_changed_files_of_language",
    "SELECT n.path, n.hash FROM (SELECT replace(path, '.py', CASE WHEN hash < '8' THEN '.tsx' ELSE '.py' END) AS path, hash FROM manifest_new) n "
    "LEFT JOIN manifest_old o ON n.path = o.path AND n.hash = o.hash WHERE o.path IS NULL AND ends_with(n.path, '.tsx')",
    "manifest_new manifest_old",
)
def _(t):
    renamed = t.manifest_new.withColumn(
        "path", F.replace("path", F.lit(".py"), F.when(F.col("hash") < "8", ".tsx").otherwise(".py"))
    )
    return incremental.files_for_language(renamed, t.manifest_old, "TypeScript")


# ----------------------------------------------------------------- cache

_REQ = "req AS (SELECT request_id, key, ts FROM requests)"
_ENT = (
    "ent AS (SELECT 'user' || CAST(user_id AS VARCHAR) AS key, 'r' || CAST(event_id AS VARCHAR) AS payload, ts AS cached_at "
    "FROM events WHERE event_type = 'purchase')"
)


def _entries(t):
    return t.events.where("event_type = 'purchase'").selectExpr(
        "'user' || CAST(user_id AS STRING) AS key",
        "'r' || CAST(event_id AS STRING) AS payload",
        "CAST(ts AS TIMESTAMP) AS cached_at",
        "CAST(86400 AS BIGINT) AS ttl_s",
    )


_LOOK = (
    f"WITH {_REQ}, {_ENT}, look AS (SELECT r.request_id, r.key, e.payload, "
    "coalesce(r.ts < e.cached_at + INTERVAL 86400 SECOND, FALSE) AS hit FROM req r ASOF LEFT JOIN ent e "
    "ON r.key = e.key AND r.ts >= e.cached_at)"
)


@query(
    "j08_cache_lookup",
    _LOOK + " SELECT request_id, key, CASE WHEN hit THEN payload END AS payload, hit FROM look",
    "requests",
)
def cache_lookup(t):
    return cache.lookup(t.requests, _entries(t)).select("request_id", "key", "payload", "hit")


@query(
    "a15_cache_stats",
    _LOOK
    + " SELECT (SELECT count(DISTINCT key) FROM ent) AS total_keys, count(*) FILTER (WHERE hit) AS hits, "
    "count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 2) AS hit_rate FROM look",
    "requests",
)
def _(t):
    snapshot = cache.put(_entries(t).limit(0), _entries(t))
    return cache.stats(cache.lookup(t.requests, _entries(t)), snapshot)


@query(
    "f25_cache_put",
    f"WITH {_ENT} SELECT key, arg_max(payload, cached_at) AS payload FROM ent GROUP BY key",
)
def _(t):
    return cache.put(_entries(t).limit(0), _entries(t)).select("key", "payload")


@query(
    "f24_cache_invalidate",
    "SELECT 'scan:' || substr(sha256(n.path || ':' || n.hash), 1, 16) AS key, n.path FROM manifest_new n WHERE n.path NOT IN "
    "(SELECT 'doc/' || CAST(doc_id AS VARCHAR) || '.py' FROM labels)",
    "manifest_new",
)
def _(t):
    snapshot = t.manifest_new.select(digest.scan_key(F.col("path"), F.col("hash")).alias("key"), "path")
    gone = t.labels.selectExpr("'doc/' || CAST(doc_id AS STRING) || '.py' AS path")
    return cache.invalidate_files(snapshot, gone).select("key", "path")


@query(
    "f17_cache_keys",
    "SELECT id, 'llm:' || substr(sha256(code_snippet || ':' || rule_id), 1, 16) AS short_key, "
    "'llm_cache:gpt-4o:' || sha256('{\"messages\":[{\"content\":\"review\",\"role\":\"system\"},{\"content\":' || "
    "CAST(to_json(code_snippet) AS VARCHAR) || ',\"role\":\"user\"}],\"model\":\"gpt-4o\",\"temperature\":0.1}') AS full_key FROM findings",
    "findings",
)
def _(t):
    return t.findings.select(
        "id",
        digest.response_key(F.col("code_snippet"), F.col("rule_id")).alias("short_key"),
        digest.request_key(F.lit("review"), F.col("code_snippet"), F.lit("gpt-4o"), F.lit(0.104)).alias("full_key"),
    )


# ------------------------------------------------------------ deliveries

SECRET = "hook-secret"


def deliveries(t):
    """Deliveries with JSON bodies and signatures, those of error events with a wrong one."""
    body = F.to_json(
        F.struct(
            F.when(F.col("event") == "pull_request", F.col("action")).alias("action"),
            F.when(
                F.col("event") == "pull_request",
                F.struct(F.col("number"), F.struct(F.col("sha")).alias("head")),
            ).alias("pull_request"),
            F.when(F.col("event") == "push", F.col("ref")).alias("ref"),
            F.when(F.col("event") == "push", F.col("sha")).alias("after"),
            F.struct(F.col("repo").alias("full_name")).alias("repository"),
        )
    )
    rows = t.deliveries.select("delivery_id", "received_at", "event", body.alias("body"))
    return rows.withColumn("signature", F.concat(F.lit("sha256="), digest.hmac_sha256_hex(F.col("body"), SECRET)))


_STATUS = (
    "CASE WHEN event = 'pull_request' AND action IN ('opened', 'synchronize') THEN 'Scan queued' WHEN event = 'push' AND ref IN "
    "('refs/heads/main', 'refs/heads/master') THEN 'Scan queued' WHEN event = 'pull_request' THEN 'PR action ' || action || "
    "' ignored' WHEN event = 'push' THEN 'Push to ' || ref || ' ignored' WHEN event = 'ping' THEN 'pong' ELSE 'Event ' || event || "
    "' not handled' END"
)


@query(
    "s18_parse_deliveries",
    "SELECT delivery_id, event, CASE event WHEN 'pull_request' THEN action END AS action, CASE event WHEN 'push' THEN ref END AS ref, "
    "repo AS repo_full_name, CASE event WHEN 'pull_request' THEN number ELSE 0 END AS pr_number, CASE WHEN event IN ('push', 'pull_request') "
    "THEN sha END AS commit_sha FROM deliveries",
    "deliveries",
)
def _(t):
    return dv.parse(deliveries(t)).select(
        "delivery_id",
        "event",
        "action",
        "ref",
        "repo_full_name",
        F.coalesce("pr_number", F.lit(0)).alias("pr_number"),
        "commit_sha",
    )


@query(
    "p12_route_deliveries",
    f"SELECT delivery_id, {_STATUS} AS message, {_STATUS} = 'Scan queued' AS queued FROM deliveries",
    "deliveries",
)
def _(t):
    return dv.route(dv.parse(deliveries(t))).select("delivery_id", "message", "queued")


_PAD = SECRET.encode().ljust(64, b"\0")
_IPAD = "".join(chr(b ^ 0x36) for b in _PAD).replace("'", "''")
_OPAD = "".join(chr(b ^ 0x5C) for b in _PAD).replace("'", "''")
_BODY_SQL = (
    "CASE event WHEN 'pull_request' THEN '{\"action\":\"' || action || '\",\"pull_request\":{\"number\":' || CAST(number AS VARCHAR) || "
    "',\"head\":{\"sha\":\"' || sha || '\"}},' WHEN 'push' THEN '{\"ref\":\"' || ref || '\",\"after\":\"' || sha || '\",' ELSE '{' END || "
    "'\"repository\":{\"full_name\":\"' || repo || '\"}}'"
)


@query(
    "p19_signature_check",
    f"WITH b AS (SELECT delivery_id, event, {_BODY_SQL} AS body FROM deliveries) SELECT delivery_id, "
    f"sha256(encode('{_OPAD}') || unhex(sha256('{_IPAD}' || body))) AS digest, event <> 'push' AS valid FROM b",
    "deliveries",
)
def _(t):
    rows = deliveries(t)
    tampered = F.when(F.col("event") == "push", F.concat(F.col("body"), F.lit(" "))).otherwise(F.col("body"))
    return rows.select(
        "delivery_id",
        digest.hmac_sha256_hex(F.col("body"), SECRET).alias("digest"),
        digest.signature_ok(tampered, F.col("signature"), SECRET).alias("valid"),
    )


# ------------------------------------------------------------- redaction


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, placeholder in steps:
        expr = f"regexp_replace({expr}, '{_q(pattern)}', '{placeholder}', 'g')"
    return expr


_SECRET_STEPS = [(p, f"<{n}_REDACTED>") for n, p in redact.SECRET_PATTERNS]
_KIND = {k.name: k for k in redact.PERSONAL_KINDS}


def _docs(t):
    return t.documents.select("doc_id", "text")


@query("f01_redact_secrets", f"SELECT doc_id, {_chain('text', _SECRET_STEPS)} AS clean FROM documents")
def redact_secrets(t):
    return _docs(t).select("doc_id", redact.redact_secrets(F.col("text")).alias("clean"))


_LUHN = (
    "list_sum(list_transform(range(1, len(d) + 1), lambda k: CASE WHEN (len(d) - k) % 2 = 0 THEN CAST(d[k] AS INT) "
    "WHEN CAST(d[k] AS INT) > 4 THEN CAST(d[k] AS INT) * 2 - 9 ELSE CAST(d[k] AS INT) * 2 END)) % 10 = 0"
)
_CARD = _q(_KIND["CREDIT_CARD"].pattern)
_SIMPLE = ["US_SSN", "IP_ADDRESS", "PHONE_NUMBER"]


@query(
    "f02_redact_personal_data",
    f"WITH s AS (SELECT doc_id, {_chain(_chain('text', _SECRET_STEPS), [(_KIND[k].pattern, _KIND[k].placeholder) for k in ('EMAIL_ADDRESS', 'URL')])} "
    "AS v FROM documents), "
    f"parts AS (SELECT doc_id, string_split_regex(v, '{_CARD}') AS b, regexp_extract_all(v, '{_CARD}') AS m FROM s), "
    "one AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS piece, unnest(list_append(m, '')) AS found FROM parts), "
    "digits AS (SELECT *, string_split(regexp_replace(found, '[ -]', '', 'g'), '') AS d FROM one), "
    f"woven AS (SELECT doc_id, string_agg(piece || CASE WHEN found <> '' AND {_LUHN} THEN '<PII_REDACTED>' ELSE found END, '' "
    "ORDER BY i) AS v FROM digits GROUP BY doc_id) "
    f"SELECT doc_id, {_chain('v', [(_KIND[k].pattern, _KIND[k].placeholder) for k in _SIMPLE])} AS clean FROM woven",
)
def redact_personal(t):
    return redact.add_redacted(_docs(t), "text", "clean").select("doc_id", "clean")


@query(
    "f03_redaction_counts",
    "WITH s0 AS (SELECT text AS v FROM documents), "
    + ", ".join(
        f"s{i + 1} AS (SELECT regexp_replace(v, '{_q(p)}', '{ph}', 'g') AS v FROM s{i})"
        for i, (p, ph) in enumerate(_SECRET_STEPS)
    )
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS type, CAST(sum(len(regexp_extract_all(v, '{_q(p)}'))) AS BIGINT) AS replacements FROM s{i}"
        for i, (n, p) in enumerate(redact.SECRET_PATTERNS)
    )
    + f" UNION ALL SELECT 'EMAIL_ADDRESS', CAST(sum(len(regexp_extract_all(v, '{_q(_KIND['EMAIL_ADDRESS'].pattern)}'))) AS BIGINT) "
    f"FROM s{len(_SECRET_STEPS)}) z WHERE replacements > 0",
)
def _(t):
    logged = redact.add_redaction_log(_docs(t), "text", "text", "clean", "log")
    counts = redact.redaction_counts(logged, "log")
    return counts.where(F.col("type").isin([n for n, _ in redact.SECRET_PATTERNS] + ["EMAIL_ADDRESS"]))


@query(
    "f03_redaction_positions",
    "SELECT doc_id, strpos(text, m[1]) - 1 AS position FROM (SELECT doc_id, text, regexp_extract_all(text, "
    f"'{_q(dict(redact.SECRET_PATTERNS)['AUTH_TOKEN'])}') AS m FROM documents) d WHERE len(m) > 0",
)
def _(t):
    logged = redact.add_redaction_log(_docs(t), "text", "text", "clean", "log")
    rows = logged.select("doc_id", F.explode_outer("log").alias("e")).where("e.type = 'AUTH_TOKEN'")
    return rows.groupBy("doc_id").agg(F.min("e.position").cast("long").alias("position"))


@query(
    "f04_anonymise_paths",
    f"SELECT id, CASE id % 3 WHEN 0 THEN '/Users/<USERNAME>/' WHEN 1 THEN '/home/<USERNAME>/' ELSE 'C:\\Users\\<USERNAME>\\' END || "
    "file_path AS path FROM findings",
    "findings",
)
def _(t):
    home = (
        F.when(F.col("id") % 3 == 0, F.lit("/Users/dev/"))
        .when(F.col("id") % 3 == 1, F.lit("/home/dev/"))
        .otherwise(F.lit("C:\\Users\\dev\\"))
    )
    return t.findings.select("id", redact.redact_path(F.concat(home, "file_path")).alias("path"))


@query(
    "f05_sanitize_findings",
    f"SELECT doc_id, {_chain('code', [_SECRET_STEPS[7], (_KIND['EMAIL_ADDRESS'].pattern, '<EMAIL_REDACTED>')])} AS code_snippet, "
    "'import a; token <EMAIL_REDACTED>' AS first_import, '/home/<USERNAME>/x' || CAST(doc_id AS VARCHAR) AS file_path FROM "
    "(SELECT doc_id, lang || ' token = \"' || sha256(text) || '\" ' || 'a.b@x' || CAST(doc_id AS VARCHAR) || '.org' AS code FROM documents) d",
)
def _(t):
    rows = t.documents.select(
        "doc_id",
        F.concat("lang", F.lit(' token = "'), F.sha2("text", 256), F.lit('" a.b@x'), F.col("doc_id").cast("string"), F.lit(".org")).alias(
            "code_snippet"
        ),
        F.concat(F.lit("/home/joe/x"), F.col("doc_id").cast("string")).alias("file_path"),
    )
    found = rows.withColumn(
        "context",
        F.struct(
            F.col("file_path").alias("file"),
            F.col("code_snippet").alias("context_code"),
            F.array(F.lit("import a; token joe@x.org"), F.lit("import b")).alias("imports"),
        ),
    )
    out = redact.sanitize_findings(found)
    same = F.col("context.context_code") == F.col("code_snippet")
    return out.where(same & (F.col("context.file") == F.col("file_path"))).select(
        "doc_id", "code_snippet", F.col("context.imports")[0].alias("first_import"), "file_path"
    )


@query(
    "p20_validate_sanitized",
    "SELECT doc_id, NOT ("
    + " OR ".join(f"regexp_matches(text, '{_q(p)}')" for _, p in redact.SECRET_PATTERNS)
    + f" OR regexp_matches(text, '{_q(_KIND['EMAIL_ADDRESS'].pattern)}') OR "
    f"len(list_filter(regexp_extract_all(text, '{_CARD}'), lambda c: list_sum(list_transform(range(1, length(regexp_replace(c, '[ -]', '', 'g')) + 1), "
    "lambda k: CASE WHEN (length(regexp_replace(c, '[ -]', '', 'g')) - k) % 2 = 0 THEN CAST(substr(regexp_replace(c, '[ -]', '', 'g'), k, 1) AS INT) "
    "WHEN CAST(substr(regexp_replace(c, '[ -]', '', 'g'), k, 1) AS INT) > 4 THEN CAST(substr(regexp_replace(c, '[ -]', '', 'g'), k, 1) AS INT) * 2 - 9 "
    "ELSE CAST(substr(regexp_replace(c, '[ -]', '', 'g'), k, 1) AS INT) * 2 END)) % 10 = 0)) > 0) AS clean FROM documents",
)
def _(t):
    return _docs(t).select("doc_id", redact.is_clean(F.col("text")).alias("clean"))
