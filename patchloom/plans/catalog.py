"""Queries that run every kind of operator on the driver's tables, and the same in DuckDB SQL.

The tables hold no diffs and no code, so paths and findings are derived from documents by plain expressions, the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import text as X
from patchloom.operators import baseline as B
from patchloom.operators import components, diffs, filters, findings, prompts, regions, review, symbols, tokens
from patchloom.plans import code_catalog, review_catalog
from patchloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@_query()
def q_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact token counts of whole texts by a public merge table; merges have no SQL, tests hold them against a plain loop."""
    import public_tokenizers

    return tokens.token_counts(table(spark, d, "documents").select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def queries() -> dict[str, Query]:
    return _QUERIES | code_catalog.queries() | review_catalog.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | code_catalog.oracle_sql() | review_catalog.oracle_sql()


# --- derived rows, in expressions that both engines read alike ---------------------------------------------------------------------

PATH = """CASE doc_id % 11 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'app/log/' WHEN 2 THEN 'blog/' WHEN 3 THEN 'db/vendor/' ELSE 'src/' END || source || '/' ||
 CASE doc_id % 17 WHEN 0 THEN '.env' WHEN 1 THEN 'ID_RSA.bak' WHEN 2 THEN 'server.pem' WHEN 3 THEN '.aws/credentials' WHEN 4 THEN 'Makefile' WHEN 5 THEN 'gcloud-x.json' ELSE 'f' || CAST(doc_id AS STRING) ||
 CASE doc_id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.min.js' WHEN 3 THEN '.ts' WHEN 4 THEN '.pb.go' WHEN 5 THEN '.go' WHEN 6 THEN '.rb' WHEN 7 THEN '.blade.php' WHEN 8 THEN '.PY' WHEN 9 THEN '.exs' WHEN 10 THEN '.vue' WHEN 11 THEN '.d.ts' ELSE '.txt' END END"""
SEVERITY = "CASE doc_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Info' END"
CONFIDENCE = "CASE doc_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END"
CWE = "CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 'CWE-' || CAST(doc_id % 1400 AS STRING) END"
FILE = "CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'src/' || source || '.py' END"
START = "CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(n_chars % 500 AS INT) END"


def _sql(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{PATH} AS path", "text", "doc_id % 19 = 0 AS is_binary", "doc_id % 23 = 0 AS is_deleted")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{CWE} AS cwe_id", f"{SEVERITY} AS severity", f"{CONFIDENCE} AS confidence", f"{FILE} AS file_path", f"{START} AS line_start", "text AS what")


SQL_PATHS = f"paths AS (SELECT doc_id, {_sql(PATH)} AS path, text, doc_id % 19 = 0 AS is_binary, doc_id % 23 = 0 AS is_deleted FROM documents)"
SQL_FINDINGS = f"f AS (SELECT doc_id, {_sql(CWE)} AS cwe_id, {SEVERITY} AS severity, {CONFIDENCE} AS confidence, {_sql(FILE)} AS file_path, {START} AS line_start, text AS what FROM documents)"
SQL_ID = "replace(lower(coalesce(cwe_id, 'unknown')), '-', '')"
SQL_FINDING_ID = f"{SQL_ID} || '-' || substr(sha256(CASE WHEN file_path IS NULL AND line_start IS NULL THEN {SQL_ID} || ':' || what ELSE concat_ws(':', {SQL_ID}, file_path, CAST(line_start AS VARCHAR)) END), 1, 16)"
SQL_RULES = "rules(cwe_id, mapped) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in C.cwe_severities()) + ")"
SQL_RANK = "list_position(['Critical', 'High', 'Medium', 'Low', 'Info'], {})"
SQL_RATED = f"""{SQL_FINDINGS}, {SQL_RULES}, rated AS (
  SELECT f.doc_id, f.cwe_id, f.confidence, f.file_path, f.line_start, f.what, ['Critical', 'High', 'Medium', 'Low', 'Info'][
    CASE WHEN f.confidence = 'Low' THEN greatest({SQL_RANK.format("coalesce(mapped, severity)")}, 3) ELSE {SQL_RANK.format("coalesce(mapped, severity)")} END] AS severity
  FROM f LEFT JOIN rules USING (cwe_id))"""
SQL_LINES = r"CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
SQL_TOKENS = "CAST(length(coalesce(text, '')) // 4 AS BIGINT)"


# --- the flagship: from documents to a verdict ----------------------------------------------------------------------------------------


@_query(f"""WITH {SQL_RATED}, known AS (SELECT DISTINCT {SQL_FINDING_ID} AS finding_id FROM rated JOIN labels USING (doc_id) WHERE quality = 0),
 ids AS (SELECT *, {SQL_FINDING_ID} AS finding_id FROM rated WHERE confidence <> 'Low'),
 kept AS (SELECT * FROM ids WHERE finding_id NOT IN (SELECT finding_id FROM known))
 SELECT s.severity, count(k.doc_id) AS n FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low'), ('Info')) s(severity) LEFT JOIN kept k USING (severity) GROUP BY 1""")
def q_review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rated findings of medium confidence or better that the baseline does not know, counted by severity."""
    rated = findings.rated(_findings(spark, d)).withColumn("finding_id", X.finding_id("cwe_id", "file_path", "line_start", "what"))
    known = rated.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    return findings.by_severity(findings.suppressed(filters.confident(rated, "Medium"), known))


# --- sources and lines --------------------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, CAST(i AS INT) AS line_no, lines[i] AS line FROM (SELECT doc_id, {SQL_LINES} AS lines FROM documents), generate_series(1, len(lines)) g(i)")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(X.lines("text")).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


# --- diffs --------------------------------------------------------------------------------------------------------------------------


def _as_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a diff of one file: its first line is the hunk's header line, every third line is removed, every other third added."""
    body = F.transform(X.lines("text"), lambda x, k: F.concat(F.when(k % 3 == 1, "+").when(k % 3 == 2, "-").otherwise(" "), x))
    head = F.format_string("diff --git a/d%d.txt b/d%d.txt\nnew file mode 100644\n--- /dev/null\n+++ b/d%d.txt\n@@ -%d,7 +%d @@ part\n", "doc_id", "doc_id", "doc_id", F.col("doc_id") % 90 + 1, F.col("doc_id") % 50 + 1)
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("diff_id"), F.concat(head, F.array_join(body, "\n")).alias("text"))


SQL_MARKED = f"marked AS (SELECT doc_id, i, lines[i] AS content, CASE (i - 1) % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE ' ' END AS change_type FROM (SELECT doc_id, {SQL_LINES} AS lines FROM documents), generate_series(1, len(lines)) g(i))"


@_query(f"""WITH {SQL_MARKED} SELECT doc_id AS diff_id, CAST(1 AS BIGINT) AS hunk_no, CAST(doc_id % 50 + 1 + coalesce(sum(CASE WHEN change_type <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line_num, change_type, content FROM marked""")
def q_diff_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_lines(_as_diffs(spark, d)).select("diff_id", "hunk_no", "line_num", "change_type", "content")


@_query("""SELECT doc_id AS diff_id, CAST(doc_id % 90 + 1 AS INT) AS old_start, 7 AS old_count, CAST(doc_id % 50 + 1 AS INT) AS new_start, 1 AS new_count FROM documents""")
def q_diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diffs.hunks(_as_diffs(spark, d)).select("diff_id", "old_start", "old_count", "new_start", "new_count")


@_query("""SELECT doc_id AS diff_id, 'd' || doc_id || '.txt' AS path, true AS is_new_file, false AS is_deleted, false AS is_renamed, false AS is_binary, false AS mode_changed FROM documents""")
def q_diff_files(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_files(_as_diffs(spark, d)).select("diff_id", "path", "is_new_file", "is_deleted", "is_renamed", "is_binary", "mode_changed")


# --- filters --------------------------------------------------------------------------------------------------------------------------

_SUFFIXES = ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGE_BY_SUFFIX.items())
SQL_LANGUAGE = f"""langs(suffix, lang) AS (VALUES {_SUFFIXES}), {SQL_PATHS}, with_language AS (
 SELECT p.*, CASE WHEN lower(path) LIKE '%.blade.php' THEN 'html' WHEN regexp_extract(path, '([^/]*)$', 1) IN ('Makefile', 'makefile', 'GNUmakefile') THEN 'makefile' ELSE lang END AS language
 FROM paths p LEFT JOIN langs ON suffix = lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)))"""
SQL_VENDOR = "(" + " OR ".join(f"starts_with(path, '{p}') OR contains(path, '/{p}')" for p in C.VENDOR_PATTERNS) + ")"


def _sql_glob(pattern: str) -> str:
    glob = pattern.lower()
    return f"(lower(path) GLOB '{glob}' OR lower(path) GLOB '*/{glob}')" if "/" in glob else f"regexp_extract(lower(path), '([^/]*)$', 1) GLOB '{glob}'"


SQL_SENSITIVE = "CASE " + " ".join(f"WHEN {_sql_glob(p)} THEN '{p}'" for p in C.SENSITIVE_GLOBS) + " END"
SQL_HEAD = f"({SQL_LINES})[:20]"


def _sql_marks(marks: tuple[str, ...], n: int) -> str:
    tests = " OR ".join(f"starts_with(trim(x), '{m}')" for m in marks)
    return f"len(list_filter(head[:{n}], lambda x: {tests})) > 0"


SQL_LONG = "(len(head) > 0 AND list_sum(list_transform(head, lambda x: length(x))) / len(head) > 500)"
SQL_GENERATED = f"""CASE language WHEN 'python' THEN {_sql_marks(C.PYTHON_MARKS, 5)}
 WHEN 'javascript' THEN ({" OR ".join(f"lower(path) LIKE '%{s}'" for s in C.MINIFIED_SUFFIXES)}) OR {SQL_LONG}
 WHEN 'typescript' THEN ((lower(path) LIKE '%.d.ts' OR lower(path) LIKE '%.d.mts' OR lower(path) LIKE '%.d.cts') AND {_sql_marks(C.DECLARATION_MARKS, 5)}) OR {SQL_LONG}
 WHEN 'ruby' THEN {_sql_marks(C.RUBY_MARKS, 5)}
 WHEN 'go' THEN path LIKE '%.pb.go' OR path LIKE '%\\_string.go' ESCAPE '\\' OR path LIKE '%\\_gen.go' ESCAPE '\\' OR path LIKE '%\\_mock.go' ESCAPE '\\'
 WHEN 'elixir' THEN {_sql_marks(C.ELIXIR_MARKS, 5)} OR {SQL_LONG} WHEN 'vue' THEN {SQL_LONG} WHEN 'html' THEN {SQL_LONG} ELSE false END"""


@_query(f"WITH {SQL_LANGUAGE} SELECT doc_id, path, language FROM with_language")
def q_language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", "path", filters.language("path").alias("language"))


@_query(f"WITH {SQL_PATHS} SELECT doc_id, path FROM paths WHERE NOT {SQL_VENDOR}")
def q_vendor_filter(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(~filters.is_vendored("path")).select("doc_id", "path")


@_query(f"WITH {SQL_PATHS} SELECT doc_id, path, {SQL_SENSITIVE} AS matched_pattern FROM paths")
def q_sensitive_first_pattern(spark: SparkSession, d: str) -> DataFrame:
    return filters.sensitive_split(_paths(spark, d)).select("doc_id", "path", "matched_pattern")


@_query(f"WITH {SQL_PATHS}, s AS (SELECT *, {SQL_SENSITIVE} AS p FROM paths) SELECT doc_id, path FROM s WHERE path IN (SELECT path FROM s WHERE p IS NULL)")
def q_sensitive_kept(spark: SparkSession, d: str) -> DataFrame:
    files = filters.sensitive_split(_paths(spark, d))
    return filters.keep_paths(files, files.where("matched_pattern IS NULL")).select("doc_id", "path")


@_query(f"WITH {SQL_LANGUAGE}, h AS (SELECT *, {SQL_HEAD} AS head FROM with_language) SELECT doc_id, path, {SQL_GENERATED} AS is_generated FROM h")
def q_generated_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).withColumn("language", filters.language("path"))
    return rows.select("doc_id", "path", filters.is_generated("path", X.lines("text"), "language").alias("is_generated"))


@_query(f"""WITH {SQL_LANGUAGE}, h AS (SELECT *, {SQL_HEAD} AS head FROM with_language)
 SELECT doc_id, path, language FROM h WHERE NOT is_binary AND NOT is_deleted AND language IS NOT NULL AND NOT {SQL_VENDOR} AND {SQL_SENSITIVE} IS NULL AND NOT {SQL_GENERATED}""")
def q_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return filters.analyzable(_paths(spark, d).withColumn("lines", X.lines("text"))).select("doc_id", "path", "language")


@_query(f"WITH {SQL_FINDINGS} SELECT doc_id, confidence FROM f WHERE confidence IN ('High', 'Medium')")
def q_confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.confident(_findings(spark, d), "Medium").select("doc_id", "confidence")


# --- regions and scopes ---------------------------------------------------------------------------------------------------------------

EXPANSION, FILE_LENGTH = 50, 9_000
SQL_EXPANDED = f"e AS (SELECT event_id, user_id, CAST(least(greatest(event_id - {EXPANSION}, 1), {FILE_LENGTH}) AS INT) AS start_line, CAST(least(event_id + greatest(event_id % 9, 1) - 1 + {EXPANSION}, {FILE_LENGTH}) AS INT) AS end_line FROM events)"
SQL_MERGED = f"""{SQL_EXPANDED}, r AS (SELECT *, max(end_line) OVER (PARTITION BY user_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE end_line >= start_line),
 i AS (SELECT *, sum(CASE WHEN start_line <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r),
 m AS (SELECT user_id, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY user_id, island)"""


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    r = regions.expanded(F.col("event_id"), F.col("event_id") % 9, EXPANSION, F.lit(FILE_LENGTH)).alias("r")
    return table(spark, d, "events").select("event_id", "user_id", r).select("event_id", "user_id", "r.*")


@_query(f"WITH {SQL_EXPANDED} SELECT event_id, user_id, start_line, end_line FROM e")
def q_region_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d)


@_query(f"WITH {SQL_MERGED} SELECT user_id, start_line, end_line FROM m")
def q_region_merge(spark: SparkSession, d: str) -> DataFrame:
    return regions.merged(_expanded(spark, d), ["user_id"])


@_query(f"WITH {SQL_EXPANDED} SELECT user_id, min(start_line) AS start_line, max(end_line) AS end_line FROM e GROUP BY 1")
def q_region_envelope(spark: SparkSession, d: str) -> DataFrame:
    return regions.envelope(_expanded(spark, d), ["user_id"])


@_query(f"WITH {SQL_MERGED} SELECT user_id, CAST(sum(end_line - start_line + 1) AS BIGINT) AS n_lines FROM m GROUP BY 1")
def q_region_lines(spark: SparkSession, d: str) -> DataFrame:
    return regions.line_count(regions.merged(_expanded(spark, d), ["user_id"]), ["user_id"])


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id", "event_type AS scope_type", "concat('s', event_id) AS name", "CAST(event_id + 1 AS INT) AS start_line", "CAST(event_id + 1 + event_id % 700 AS INT) AS end_line", "CAST(event_id % 4 AS INT) AS depth")


SQL_SCOPED = """s AS (SELECT user_id, event_type AS scope_type, 's' || event_id AS name, CAST(event_id + 1 AS INT) AS start_line, CAST(event_id + 1 + event_id % 700 AS INT) AS end_line, CAST(event_id % 4 AS INT) AS depth FROM events),
 l AS (SELECT user_id, CAST(event_id + 1 AS INT) AS line_num FROM events),
 ranked AS (SELECT l.user_id, line_num, scope_type, name, start_line, end_line, depth, row_number() OVER (PARTITION BY l.user_id, line_num ORDER BY depth DESC, start_line DESC) AS k FROM l JOIN s ON l.user_id = s.user_id AND line_num BETWEEN start_line AND end_line)"""


@_query(f"WITH {SQL_SCOPED} SELECT user_id, line_num, scope_type, name, start_line, end_line, depth FROM ranked WHERE k = 1")
def q_innermost_scope(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").selectExpr("user_id", "CAST(event_id + 1 AS INT) AS line_num")
    return regions.innermost(lines, _scopes(spark, d), ["user_id"])


@_query(f"WITH {SQL_SCOPED} SELECT user_id, scope_type, name, start_line, end_line, min(line_num) AS first_seen FROM ranked WHERE k = 1 GROUP BY ALL")
def q_distinct_scopes(spark: SparkSession, d: str) -> DataFrame:
    return regions.distinct_scopes(q_innermost_scope(spark, d), ["user_id"], "line_num")


@_query(f"""SELECT doc_id, CASE WHEN len(lines[2:]) <= 4 THEN array_to_string(lines[2:], chr(10)) ELSE array_to_string(lines[2:5], chr(10)) || chr(10) || '... (truncated ' || (len(lines[2:]) - 4) || ' lines)' END AS source
 FROM (SELECT doc_id, {SQL_LINES} AS lines FROM documents) WHERE len(lines) >= 2""")
def q_scope_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.lines("text").alias("lines")).where(F.size("lines") >= 2)
    return rows.select("doc_id", regions.scope_text(F.col("lines"), F.lit(2), F.size("lines"), 4).alias("source"))


@_query(f"WITH {SQL_EXPANDED} SELECT event_id, CAST(greatest(start_line, 1000) - 999 AS INT) AS start_line, CAST(least(end_line, 4000) - 999 AS INT) AS end_line FROM e WHERE start_line <= 4000 AND end_line >= 1000")
def q_range_clip(spark: SparkSession, d: str) -> DataFrame:
    return regions.clipped(_expanded(spark, d), F.lit(1000), F.lit(4000)).select("event_id", "start_line", "end_line")


# --- findings -------------------------------------------------------------------------------------------------------------------------


@_query(f"WITH {SQL_RATED} SELECT doc_id, cwe_id, confidence, severity FROM rated")
def q_severity_map(spark: SparkSession, d: str) -> DataFrame:
    return findings.rated(_findings(spark, d)).select("doc_id", "cwe_id", "confidence", "severity")


@_query(f"""WITH {SQL_RATED}, a AS (SELECT CASE severity WHEN 'Critical' THEN 'block' WHEN 'High' THEN 'warn' WHEN 'Medium' THEN 'warn' ELSE 'allow' END AS action FROM rated)
 SELECT x.action, count(a.action) AS n FROM (VALUES ('block'), ('warn'), ('allow')) x(action) LEFT JOIN a USING (action) GROUP BY 1""")
def q_threshold_actions(spark: SparkSession, d: str) -> DataFrame:
    return findings.actions(findings.rated(_findings(spark, d)), {"High": "warn"})


@_query(f"WITH {SQL_RATED} SELECT coalesce(bool_or(severity IN ('Critical', 'High')), false) AS should_block FROM rated")
def q_should_block(spark: SparkSession, d: str) -> DataFrame:
    return findings.blocks(findings.rated(_findings(spark, d)))


@_query(f"WITH {SQL_RATED} SELECT s.severity, count(r.doc_id) AS n FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low'), ('Info')) s(severity) LEFT JOIN rated r USING (severity) GROUP BY 1")
def q_severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.by_severity(findings.rated(_findings(spark, d)))


@_query(f"WITH {SQL_RATED} SELECT coalesce(file_path, '(unknown)') AS file_path, count(*) AS n, ['Critical', 'High', 'Medium', 'Low', 'Info'][min({SQL_RANK.format('severity')})] AS worst, min(doc_id) AS first_seen FROM rated GROUP BY 1")
def q_group_by_file(spark: SparkSession, d: str) -> DataFrame:
    return findings.by_file(findings.rated(_findings(spark, d)), "doc_id")


@_query(f"WITH {SQL_FINDINGS} SELECT doc_id, {SQL_FINDING_ID} AS finding_id, regexp_full_match({SQL_FINDING_ID}, '[a-z]+[0-9]*-[0-9a-f]{{16}}') AS is_valid FROM f")
def q_finding_id(spark: SparkSession, d: str) -> DataFrame:
    rows = _findings(spark, d).select("doc_id", X.finding_id("cwe_id", "file_path", "line_start", "what").alias("finding_id"))
    return rows.withColumn("is_valid", X.is_finding_id("finding_id"))


SQL_QUOTES = "repeat(chr(34), 3)"


SQL_UNCOMMENTED = r"""regexp_extract(x, '^([^"''\\#]|\\.|\\$|"([^"\\]|\\.|\\$)*("|$)|''([^''\\]|\\.|\\$)*(''|$))*')"""


@_query(rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace('x = 1' || chr(10) || {SQL_QUOTES} || ' doc ' || chr(10) || {SQL_QUOTES} || chr(10) || coalesce(text, ''), {SQL_QUOTES} || '[\s\S]*?' || {SQL_QUOTES}, '', 'g'), '\x27{{3}}[\s\S]*?\x27{{3}}', '', 'g') AS code FROM documents),
 n AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(code, chr(10)), lambda x: trim({SQL_UNCOMMENTED}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''), chr(10)) AS code FROM c)
 SELECT doc_id, 'cwe' || doc_id || '-' || substr(sha256('cwe' || doc_id || ':' || code), 1, 16) AS fingerprint FROM n""")
def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all texts, each after a doc string; doc strings and comments go, quoted number signs stay."""
    code = F.concat(F.lit('x = 1\n""" doc \n"""\n'), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", X.fingerprint(code, F.concat(F.lit("CWE-"), F.col("doc_id").cast("string"))).alias("fingerprint"))


@_query("""SELECT doc_id, CASE WHEN regexp_full_match(trim(raw), '(?i)(CWE-)?[0-9]+') THEN 'CWE-' || regexp_extract(trim(raw), '([0-9]+)$', 1) WHEN trim(raw) <> '' THEN trim(raw) END AS cwe_id
 FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || doc_id WHEN 1 THEN 'cwe-' || doc_id WHEN 2 THEN '  ' WHEN 3 THEN source ELSE NULL END AS raw FROM documents)""")
def q_cwe_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN concat(' ', doc_id) WHEN 1 THEN concat('cwe-', doc_id) WHEN 2 THEN '  ' WHEN 3 THEN source ELSE NULL END")
    return table(spark, d, "documents").select("doc_id", X.cwe_normalized(raw).alias("cwe_id"))


@_query("""SELECT doc_id, CASE lower(trim(raw)) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' WHEN 'info' THEN 'Info' ELSE 'Medium' END AS severity
 FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' CRITICAL' WHEN 1 THEN 'high ' WHEN 2 THEN 'Low' WHEN 3 THEN 'info' WHEN 4 THEN lang ELSE NULL END AS raw FROM documents)""")
def q_enum_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 6 WHEN 0 THEN ' CRITICAL' WHEN 1 THEN 'high ' WHEN 2 THEN 'Low' WHEN 3 THEN 'info' WHEN 4 THEN lang ELSE NULL END")
    return table(spark, d, "documents").select("doc_id", findings.severity(raw).alias("severity"))


@_query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(doc_id, n_chars) WHEN 1 THEN least(doc_id, n_chars) END::INT AS line_start, CASE doc_id % 4 WHEN 0 THEN greatest(doc_id, n_chars) WHEN 1 THEN greatest(doc_id, n_chars) END::INT AS line_end, doc_id % 4 = 2 AS bad FROM documents""")
def q_line_range(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('{"start":', doc_id, ',"end":', n_chars, '}') WHEN 1 THEN concat('[', doc_id, ',', n_chars, ']') WHEN 2 THEN concat('[-', doc_id + 1, ',', n_chars, ']') ELSE concat('{"start":', doc_id, '}') END""")
    r = findings.line_range(F.parse_json(raw))
    return table(spark, d, "documents").select("doc_id", r["start"].alias("line_start"), r["end"].alias("line_end"), r["bad"].alias("bad"))


@_query("""SELECT 'e' || event_id AS file_path, CASE WHEN event_id % 5 = 4 THEN NULL ELSE props END AS what, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 2 THEN 'Medium' ELSE 'High' END AS severity, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 'CWE-' || (event_id % 1000) END AS cwe_id,
 CASE event_id % 5 WHEN 4 THEN 'no JSON object' END AS error FROM events WHERE event_id % 5 <> 3
 UNION ALL SELECT 'e' || event_id, NULL, NULL, NULL, 'missing required field' FROM events WHERE event_id % 5 = 3""")
def q_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Findings from answers: plain, fenced, among other text, lacking a field, and none at all."""
    body = F.to_json(F.struct(F.array(F.struct(
        F.col("props").alias("what"), F.lit("w").alias("why"), F.lit("h").alias("how_to_fix"), F.when(F.col("event_id") % 5 == 2, "odd").otherwise(" HIGH").alias("severity"),
        F.when(F.col("event_id") % 5 != 3, "low").alias("confidence"), (F.col("event_id") % 1000).alias("cwe_id"),
    )).alias("findings")))
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(kind == 2, F.concat(F.lit("Here "), body, F.lit(" end"))).when(kind == 3, body).otherwise(F.lit("nothing [1, 2]"))
    rows = table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("file_path"), raw.alias("raw"))
    return findings.parsed(rows).select("file_path", "what", "severity", "cwe_id", "error")


# --- baseline -------------------------------------------------------------------------------------------------------------------------


def _with_ids(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).withColumn("finding_id", X.finding_id("cwe_id", "file_path", "line_start", "what"))


SQL_IDS = f"{SQL_FINDINGS}, ids AS (SELECT *, {SQL_FINDING_ID} AS finding_id FROM f), known AS (SELECT DISTINCT finding_id FROM ids JOIN labels USING (doc_id) WHERE quality = 0)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    return _with_ids(spark, d).join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")


@_query(f"WITH {SQL_IDS} SELECT doc_id, finding_id FROM ids WHERE finding_id NOT IN (SELECT finding_id FROM known)")
def q_suppress_anti(spark: SparkSession, d: str) -> DataFrame:
    return findings.suppressed(_with_ids(spark, d), _known(spark, d)).select("doc_id", "finding_id")


@_query(f"WITH {SQL_IDS} SELECT doc_id, finding_id FROM ids WHERE finding_id IN (SELECT finding_id FROM known)")
def q_suppress_semi(spark: SparkSession, d: str) -> DataFrame:
    return findings.suppressed(_with_ids(spark, d), _known(spark, d), known=True).select("doc_id", "finding_id")


@_query(f"""WITH {SQL_IDS}, c AS (SELECT finding_id, arg_min(coalesce(cwe_id, '-'), doc_id) AS cwe, arg_min(coalesce(file_path, '-'), doc_id) AS file FROM ids GROUP BY 1)
 SELECT k.finding_id, nullif(cwe, '-') AS cwe_id, nullif(file, '-') AS file_path FROM known k LEFT JOIN c USING (finding_id)""")
def q_cache_enrich(spark: SparkSession, d: str) -> DataFrame:
    entries = _known(spark, d).select("finding_id").distinct().select("finding_id", F.lit(None).cast("string").alias("cwe_id"), F.lit(None).cast("string").alias("file_path"))
    cache = _with_ids(spark, d).select("finding_id", "cwe_id", "file_path", F.col("doc_id").alias("ord"))
    return findings.enriched(entries, cache)


def _entries(df: DataFrame) -> DataFrame:
    text = [F.lit("").alias("code_hash"), F.lit("r").alias("reason"), F.lit("t").alias("added_at")]
    return df.select("finding_id", F.coalesce("cwe_id", F.lit("")).alias("cwe_id"), *text, "file_path", F.col("doc_id").alias("ord"))


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    first = _entries(_known(spark, d)).groupBy("finding_id").agg(F.min_by(F.struct("cwe_id", "code_hash", "reason", "added_at", "file_path"), "ord").alias("e"))
    return first.select("finding_id", "e.*")


SQL_BASELINE = f"{SQL_IDS}, base AS (SELECT finding_id, arg_min(coalesce(cwe_id, ''), doc_id) AS cwe_id, nullif(arg_min(coalesce(file_path, '-'), doc_id), '-') AS file_path FROM ids JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1)"


@_query(f"""WITH {SQL_BASELINE} SELECT finding_id, cwe_id, file_path FROM base UNION ALL
 SELECT finding_id, arg_min(coalesce(cwe_id, ''), doc_id), nullif(arg_min(coalesce(file_path, '-'), doc_id), '-') FROM ids WHERE finding_id NOT IN (SELECT finding_id FROM base) GROUP BY 1""")
def q_baseline_add(spark: SparkSession, d: str) -> DataFrame:
    return B.added(_baseline(spark, d), _entries(_with_ids(spark, d))).select("finding_id", "cwe_id", "file_path")


@_query(f"""WITH {SQL_BASELINE} SELECT finding_id, cwe_id, file_path FROM base UNION ALL
 SELECT finding_id, arg_min(coalesce(cwe_id, ''), doc_id), nullif(arg_min(coalesce(file_path, '-'), doc_id), '-') FROM ids WHERE severity IN ('Low', 'Info') AND finding_id NOT IN (SELECT finding_id FROM base) GROUP BY 1""")
def q_baseline_bulk(spark: SparkSession, d: str) -> DataFrame:
    scan = _with_ids(spark, d).withColumn("ord", F.col("doc_id"))
    return B.added(_baseline(spark, d), B.bulk_entries(scan, "r", "t")).select("finding_id", "cwe_id", "file_path")


@_query(f"WITH {SQL_BASELINE} SELECT finding_id, cwe_id, file_path FROM base WHERE cwe_id <> 'CWE-1' AND finding_id <> 'cwe1-0000000000000000'")
def q_baseline_remove(spark: SparkSession, d: str) -> DataFrame:
    return B.removed(_baseline(spark, d).where("cwe_id <> 'CWE-1'"), "cwe1-0000000000000000").select("finding_id", "cwe_id", "file_path")


@_query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_per_file_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return findings.per_file_counts(table(spark, d, "customer"), orders, "c_custkey")


# --- tokens and prompts ---------------------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, {SQL_TOKENS} AS tokens, {SQL_TOKENS} <= floor(500 * 0.9) AS within FROM documents")
def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.tokens_estimated("text").alias("tokens"))
    return rows.withColumn("within", X.within_limit("tokens", F.lit(500), 0.1))


@_query(f"SELECT doc_id, {SQL_TOKENS} * CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 0.5 ELSE 0.0 END / 1000000 AS usd FROM documents")
def q_cost(spark: SparkSession, d: str) -> DataFrame:
    price = F.try_element_at(F.create_map(F.lit("en"), F.lit(2.0), F.lit("de"), F.lit(0.5)), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", X.cost(X.tokens_estimated("text"), price).alias("usd"))


MOST = 300


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as a file: a region of its text, of which the first line is added; a removed line; a scope and a definition."""
    turns = table(spark, d, "conversations")
    first = F.get(X.lines("text"), F.lit(0))
    changed = F.array(F.struct(F.lit(10).alias("line_num"), F.lit("+").alias("change_type"), first.alias("content")), F.struct(F.lit(11).alias("line_num"), F.lit("-").alias("change_type"), F.col("role").alias("content")))
    scope = F.array(F.struct(F.lit("function").alias("type"), F.col("role").alias("name"), F.lit(10).alias("start_line"), F.lit(20).alias("end_line"), F.col("text").alias("source")))
    symbol = F.array(F.struct(F.lit("helper").alias("name"), F.lit("lib.py").alias("file"), F.lit("def helper(): pass").alias("code")))
    return turns.select("conv_id", "turn", F.concat(F.lit("t"), "turn").alias("path"), F.col("text").alias("expanded_region"), F.lit(10).alias("region_start_line"), changed.alias("diff_lines"), scope.alias("scopes"), symbol.alias("symbols"))


SQL_FENCE = "'```' || chr(10)"
SQL_SECTION = f"""s AS (SELECT conv_id, turn, '## File: t' || turn AS head,
 '### Code Context' || chr(10) || {SQL_FENCE} || array_to_string(list_transform(lines, lambda x, i: lpad(CAST(9 + i AS VARCHAR), 4, ' ') || ' |' || CASE i WHEN 1 THEN '+' ELSE ' ' END || ' ' || x), chr(10)) || chr(10) || '```' AS code,
 '### Removed Lines' || chr(10) || {SQL_FENCE} || '  11 |- ' || role || chr(10) || '```' AS gone, '### Enclosing Scopes' || chr(10) || '- function `' || role || '` (lines 10-20)' AS scope,
 ':' || chr(10) || {SQL_FENCE} || text || chr(10) || '```' AS source, '### Referenced Definitions' || chr(10) || '**`helper`** (from `lib.py`):' || chr(10) || {SQL_FENCE} || 'def helper(): pass' || chr(10) || '```' AS defs
 FROM (SELECT *, {SQL_LINES} AS lines FROM conversations))"""
SQL_JOIN = "string_agg({}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)"
SQL_GAP = "chr(10) || chr(10)"
SQL_A = SQL_JOIN.format(f"concat_ws({SQL_GAP}, head, code, gone, scope || source, defs)")
SQL_FOOT = f"{SQL_GAP} || '{prompts.FOOTER}'"


@_query(f"WITH {SQL_SECTION} SELECT conv_id, {SQL_A} || {SQL_FOOT} AS prompt, CAST(length({SQL_A} || {SQL_FOOT}) // 4 AS BIGINT) AS tokens FROM s GROUP BY 1")
def q_prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompts(_contexts(spark, d), "conv_id", "turn")


@_query(f"""WITH {SQL_SECTION}, p AS (SELECT conv_id, {SQL_A} || {SQL_FOOT} AS a, {SQL_JOIN.format(f"concat_ws({SQL_GAP}, head, code, gone, scope, defs)")} || {SQL_GAP} || '{prompts.CUT_MARK}' || {SQL_FOOT} AS b,
 {SQL_JOIN.format(f"concat_ws({SQL_GAP}, head, code, gone, scope)")} || {SQL_GAP} || '{prompts.CUT_MARK}' || {SQL_FOOT} AS c FROM s GROUP BY 1),
 r AS (SELECT conv_id, CASE WHEN length(a) // 4 <= {MOST} THEN a WHEN length(b) // 4 <= {MOST} THEN b ELSE c END AS prompt FROM p) SELECT conv_id, prompt, CAST(length(prompt) // 4 AS BIGINT) AS tokens FROM r""")
def q_prompt_truncate(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompts(_contexts(spark, d), "conv_id", "turn", MOST)


@_query(f"WITH {SQL_SECTION}, p AS (SELECT conv_id, length({SQL_A} || {SQL_FOOT}) // 4 + 1200 AS t FROM s GROUP BY 1) SELECT count(*) AS n_prompts, CAST(coalesce(sum(t), 0) AS BIGINT) AS total_tokens FROM p")
def q_token_total(spark: SparkSession, d: str) -> DataFrame:
    return prompts.token_total(q_prompt_render(spark, d), 1200)


# --- symbols --------------------------------------------------------------------------------------------------------------------------

BUILTINS = ("the", "and", "der", "die", "de", "la", "que", "les")


@_query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS symbol FROM documents), t AS (SELECT doc_id, lower(string_split(text, ' ')[1]) AS symbol FROM documents)
 SELECT doc_id, symbol FROM w WHERE symbol NOT IN ({", ".join(f"'{b}'" for b in BUILTINS)}) AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.symbol = w.symbol)""")
def q_free_symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = F.split(F.lower("text"), " ", -1)
    builtins = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUILTINS])).alias("symbol"))
    return symbols.free_symbols(docs.select("doc_id", F.explode(words).alias("symbol")), docs.select("doc_id", F.get(words, F.lit(0)).alias("symbol")), builtins, ["doc_id"])


@_query("""WITH c AS (SELECT p_partkey, i, CASE i WHEN 0 THEN p_brand || '/' || (p_partkey % 97) WHEN 1 THEN p_brand || '/' || p_size ELSE p_brand || '/index' END AS path FROM part, range(3) r(i)),
 files AS (SELECT DISTINCT p_brand || '/' || p_size AS path FROM part WHERE p_size % 3 = 0 UNION SELECT DISTINCT p_brand || '/index' FROM part WHERE p_size = 7)
 SELECT p_partkey, arg_min(path, i) AS path FROM c JOIN files USING (path) GROUP BY 1""")
def q_first_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    files = part.where("p_size % 3 = 0").selectExpr("p_brand || '/' || p_size AS path").union(part.where("p_size = 7").selectExpr("p_brand || '/index'"))
    candidates = F.expr("array(p_brand || '/' || (p_partkey % 97), p_brand || '/' || p_size, p_brand || '/index')")
    return symbols.first_existing(part, candidates, files, ["p_partkey"])


@_query("""WITH b AS (SELECT user_id AS file_id, CAST(event_id AS INT) AS ord, unnest(list_distinct([event_type || '.' || (event_id % 3), event_type, CAST(event_id % 3 AS VARCHAR)])) AS symbol, event_type || '.' || (event_id % 3) AS module FROM events),
 s AS (SELECT DISTINCT user_id AS file_id, event_type AS symbol FROM events) SELECT file_id, symbol, arg_min(module, ord) AS module, min(ord) AS ord FROM s JOIN b USING (file_id, symbol) GROUP BY ALL""")
def q_symbol_import(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    imports = events.select(F.col("user_id").alias("file_id"), F.col("event_id").cast("int").alias("ord"), F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("module"), F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("array<struct<original:string,alias:string>>").alias("name_aliases"))
    used = events.select(F.col("user_id").alias("file_id"), F.col("event_type").alias("symbol")).distinct()
    return symbols.resolved_imports(used, imports).select("file_id", "symbol", "module", "ord")


# --- text functions -------------------------------------------------------------------------------------------------------------------


@_query(r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(n, '::', '/'), '([A-Z0-9]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake,
 array_to_string(list_transform(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda x: upper(x[1]) || lower(x[2:])), '') AS camel, replace(p_brand || '.' || p_type, '.', '/') AS path FROM (SELECT *, replace(p_name, ' ', '') || '::HTTP' || p_brand AS n FROM part)""")
def q_case_convert(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("::HTTP"), "p_brand")
    return part.select("p_partkey", X.snake_case(name).alias("snake"), X.camel_case(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("camel"), X.dots_to_slashes(F.concat_ws(".", "p_brand", "p_type")).alias("path"))


@_query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS short, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-' || (doc_id + n_chars) END AS lines FROM documents")
def q_truncate(spark: SparkSession, d: str) -> DataFrame:
    start, end = F.expr("CASE WHEN doc_id % 3 > 0 THEN doc_id END"), F.expr("CASE doc_id % 3 WHEN 1 THEN doc_id WHEN 2 THEN doc_id + n_chars END")
    return table(spark, d, "documents").select("doc_id", X.truncated("text", 60).alias("short"), X.line_range_text(start, end).alias("lines"))


@_query("""SELECT page_id, CASE WHEN length(url) <= 24 THEN url WHEN len(p) <= 2 THEN CASE WHEN length(url) > 24 THEN substring(url, 1, 21) || '...' ELSE url END
 WHEN length('.../' || p[-2] || '/' || p[-1]) <= 24 THEN '.../' || p[-2] || '/' || p[-1] WHEN length('.../' || p[-1]) <= 24 THEN '.../' || p[-1] ELSE substring('.../' || p[-1], 1, 21) || '...' END AS path FROM (SELECT *, string_split(url, '/') AS p FROM pages)""")
def q_shorten_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.path_shortened("url", 24).alias("path"))


@_query("""SELECT doc_id, source AS bare, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS at FROM documents""")
def q_unquote_timestamp(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestamp_seconds(1767225600 + doc_id)")
    quoted = F.concat(F.lit("'"), "source", F.lit("'"))
    return table(spark, d, "documents").select("doc_id", X.unquoted(quoted).alias("bare"), X.utc_text(at).alias("at"))


# --- component files ------------------------------------------------------------------------------------------------------------------


@_query(r"""WITH m AS (SELECT page_id, html, regexp_extract(html, '(?is)<script\b([^>]*)>(.*?)</script\s*>', 0) AS block, regexp_extract(html, '(?is)<script\b([^>]*)>(.*?)</script\s*>', 2) AS body FROM pages)
 SELECT page_id, trim(body, chr(10) || chr(13)) AS content, CAST(length(b) - length(replace(b, chr(10), '')) + 2 AS INT) AS start_line FROM (SELECT *, substring(html, 1, strpos(html, block) - 1) AS b FROM m WHERE block <> '' AND trim(body) <> '')""")
def q_script_block(spark: SparkSession, d: str) -> DataFrame:
    block = components.script_block("html")
    return table(spark, d, "pages").select("page_id", block.alias("b")).where("b IS NOT NULL").select("page_id", "b.content", "b.start_line")


@_query(r"""SELECT page_id, CASE WHEN regexp_matches(regexp_extract(html, '(?is)<script\b([^>]*)>(.*?)</script\s*>', 1), '(?i)\blang\s*=\s*["'']?(ts|typescript)\b') THEN 'typescript' ELSE 'javascript' END AS language FROM pages""")
def q_script_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", components.script_language("html").alias("language"))


@_query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS template FROM pages""")
def q_template_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", components.without_blocks("html").alias("template"))


# --- review ---------------------------------------------------------------------------------------------------------------------------


@_query(f"""WITH x AS (SELECT 'd' || doc_id AS file_path, text FROM documents)
 SELECT file_path, CASE WHEN contains(text, 'token') THEN 'Critical' END AS severity, CASE WHEN contains(text, 'token') THEN 'CWE-798' END AS cwe_id, CASE WHEN text = '' THEN 'empty prompt' END AS error FROM x WHERE contains(text, 'token') OR text = ''""".replace("'Critical'", "'High'"))
def q_review_stub(spark: SparkSession, d: str) -> DataFrame:
    """The stub reviewer over all documents: answers are parsed and rated, failures are rows."""
    prompts_ = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_path"), F.col("text").alias("prompt"))
    return review.reviewed(prompts_, review.SecretStub()).select("file_path", "severity", "cwe_id", "error")

