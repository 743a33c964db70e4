"""Queries of the source scan, taint and corroboration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import split_lines
from ..operators import rule_index, scan, taint
from ..plans.skew import shared_folder
from ..rules import LANGUAGE_RULES, RULES, Rule, rule_table
from ..sources import trees
from .catalog_queries import values
from .fixtures import ENGINES, HEAD, SOURCE_LINES, TAIL
from .registry import placed, query, view


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows_of_rules(rules) -> str:
    return values((r.id, r.title, r.category, r.severity, r.cwe, r.guide, r.mitigation) for r in rules)


HEADS = " ".join(f"WHEN {k} THEN {literal(HEAD % lines)}" for k, lines in SOURCE_LINES.items())
FILL = (
    "replace(replace(replace({0}, '{{id}}', cast(doc_id AS VARCHAR)), '{{perm}}',"
    " CASE doc_id % 3 WHEN 0 THEN 'CAMERA' WHEN 1 THEN 'INTERNET' ELSE 'READ_SMS' END), '{{impl}}',"
    " repeat('implementation ', cast(doc_id % 5 AS INT)))"
)
view(
    "v_files",
    f"""
SELECT *, regexp_extract(name, '[^/]*$') AS base FROM (SELECT doc_id, source AS project_id, source || '/' || folder || '/' || name AS path, name,
  {FILL.format('head')} || text || {FILL.format(literal(TAIL))} AS text
FROM (SELECT *, CASE lang WHEN 'en' THEN 'app' WHEN 'fr' THEN 'src/test' WHEN 'de' THEN 'docs' ELSE 'sample' END AS folder,
  CASE doc_id % 5 {HEADS} END AS head,
  CASE WHEN doc_id % 97 = 0 THEN doc_id || '/LICENSE' WHEN doc_id % 31 = 0 THEN 'node_modules/x' || doc_id || '.js'
    WHEN doc_id % 37 = 0 THEN doc_id || '/AndroidManifest.xml' WHEN doc_id % 41 = 0 THEN doc_id || '/build.gradle'
    WHEN doc_id % 43 = 0 THEN 'image' || doc_id || '.png'
    ELSE 'doc_' || doc_id || ([ '.py', '.java', '.js', '.md'])[doc_id % 4 + 1] END AS name FROM documents))""",
)
view("v_ext", "SELECT *, CASE WHEN contains(base, '.') THEN regexp_extract(base, '\\.[^.]*$') ELSE '' END AS ext FROM v_files")
view(
    "v_scanned",
    "SELECT * FROM v_ext WHERE NOT contains(path, '/node_modules/') AND (ext IN ('.py', '.java', '.js', '.md', '.xml', '.gradle') OR base = 'LICENSE')",
)
view(
    "v_arrays",
    r"""
SELECT doc_id, project_id, path, ext, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM (
  SELECT *, regexp_split_to_array(text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM v_scanned)""",
)
view(
    "v_lines",
    "SELECT doc_id, project_id, path, ext, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM v_arrays",
)
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
view(
    "v_code_lines",
    f"""
SELECT *, trim(line, {WS}) AS stripped FROM v_lines
WHERE trim(line, {WS}) <> '' AND NOT regexp_matches(trim(line, {WS}), '^(#|//|\\*|/\\*|<!--)')""",
)


def oracle_pattern(rule: Rule) -> str:
    """Condition on a line, in a dialect without lookahead and with ASCII word boundaries."""
    if rule.id == "PII-RUT":
        return r"regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])(rut|run)($|[^\p{L}\p{N}_])')"
    if rule.id == "NET-CLEARTEXT":
        return (
            r"""regexp_matches(regexp_replace(line, '(?i)http://(localhost|127\.0\.0\.1|schemas\.android)', '', 'g'), """
            r"""'(?i)cleartextTrafficPermitted\s*=\s*"true"|usesCleartextTraffic\s*=\s*"true"|http://')"""
        )
    return f"regexp_matches(line, {literal('(?i)' + rule.pattern)})"


# A caller's own rules: personal data and license wording in prose.
CORPUS_RULES = (
    Rule("TXT-TOKEN", "token", "COMPARTIMENTAJE", "alto", RULES[0].pattern, RULES[0].triggers),
    Rule("TXT-EMAIL", "email", "LEGAL", "medio", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ("@",)),
    Rule("TXT-IPV4", "ipv4", "LEGAL", "bajo", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", (".",)),
    Rule("TXT-DIGITS", "digits", "LEGAL", "bajo", r"\d{9,}", ()),
    Rule("TXT-LICENSE", "license", "LEGAL", "info", r"licen[sc]e", ("licen",)),
)


def hits_sql(rules) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category FROM v_code_lines WHERE {oracle_pattern(r)}"
        for r in rules
        if r.pattern
    )


REDACTED = """regexp_replace({0}, '(["''])([A-Za-z0-9_\\-]{{3}})[A-Za-z0-9_\\-]{{7,}}([A-Za-z0-9_\\-]{{2}})(["''])', '\\1\\2…[REDACTADO]…\\3\\4', 'g')"""
view(
    "v_hits",
    f"""
SELECT *, {REDACTED.format('stripped')} AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line_no) AS r FROM ({hits_sql(RULES)}))""",
)


@query(
    "src_09_source_lines",
    "SELECT project_id, path, line_no, length(line) AS chars FROM v_lines",
)
def src_09(t):
    return scan.source_lines(t.scanned).select("project_id", "path", "line_no", F.length("line").alias("chars"))


@query(
    "src_09_read_tree",
    "SELECT 'project_id=' || project_id AS project_id, count(*) AS lines, sum(length(line)) AS chars FROM v_lines GROUP BY 1",
)
def src_09_tree(t):
    """The scanned texts written as files, a folder a project, and read back as a tree."""
    root = shared_folder(t.spark, "tree")
    # The writer ends each text with a line break of its own.
    t.scanned.select("project_id", F.regexp_replace("text", "\n$", "").alias("text")).write.partitionBy("project_id").text(root)
    lines = F.explode(split_lines(F.col("text"))).alias("line")
    read = trees.read_tree(t.spark, root, whole=1 << 30).where(F.col("path").endswith(".txt"))
    return read.select("project_id", lines).groupBy("project_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("f_06_scanned_files", "SELECT project_id, path FROM v_scanned")
def f_06(t):
    return t.scanned.select("project_id", "path")


@query("f_07_code_lines", "SELECT path, count(*) AS code_lines FROM v_code_lines GROUP BY 1")
def f_07(t):
    return (
        scan.source_lines(t.scanned)
        .where(st.is_code_line(F.col("line")))
        .groupBy("path")
        .agg(F.count("*").alias("code_lines"))
    )


@query("j_13_line_rules", "SELECT project_id, path, rule_id, line_no AS line, category, severity FROM v_hits")
def j_13(t):
    return scan.scan_files(t.scanned).select("project_id", "path", "rule_id", "line", "category", "severity")


@query("x_01_rule_index", "SELECT project_id, path, rule_id, line_no AS line, category, severity FROM v_hits")
def x_01_index(t):
    """The rules as a table, found through the index of their triggers."""
    found = rule_index.scan_files_by_table(t.scanned, rule_table(t.spark))
    return found.select("project_id", "path", "rule_id", "line", "category", "severity")


@query(
    "j_13_corpus_rules",
    f"""
SELECT project_id, path, rule_id, line_no AS line FROM (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line_no) AS r
  FROM ({hits_sql(CORPUS_RULES)}))""",
)
def j_13_corpus(t):
    return scan.scan_files(t.scanned, CORPUS_RULES).select("project_id", "path", "rule_id", "line")


def language_sql() -> str:
    groups = {("java", "kotlin"): "ext = '.java'", ("javascript", "typescript"): "ext = '.js'", ("python",): "ext = '.py'"}
    parts = []
    for rule_id, languages, include, exclude, severity, cwe in LANGUAGE_RULES:
        where = [f"regexp_matches(line, {literal(include)})"]
        if exclude:
            where.append(f"NOT regexp_matches(regexp_extract(line, {literal(include)}), {literal(exclude)})")
        if languages:
            where.append(groups[languages])
        parts.append(
            f"SELECT project_id, path, line_no, '{rule_id}' AS rule_id, '{severity}' AS severity, '{cwe}' AS cwe FROM v_lines WHERE "
            + " AND ".join(where)
        )
    return " UNION ALL ".join(parts)


@query("j_14_language_rules", language_sql())
def j_14(t):
    return scan.language_rule_matches(t.scanned)


@query(
    "w_01_per_rule_limit",
    f"""
SELECT project_id, path, rule_id, line_no AS line FROM (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line_no) AS r
  FROM ({hits_sql(CORPUS_RULES)})) WHERE r <= 2 AND (severity <> 'info' OR r = 1)""",
)
def w_01(t):
    return scan.scan_files(t.scanned, CORPUS_RULES, limit=2, info_limit=1).select("project_id", "path", "rule_id", "line")


@query("w_02_info_once", "SELECT project_id, path, line_no AS line FROM v_hits WHERE severity = 'info' AND r = 1")
def w_02(t):
    return scan.scan_files(t.scanned, info_limit=1).where(F.col("severity") == "info").select("project_id", "path", "line")


@query(
    "w_03_context_window",
    f"""
SELECT h.path, h.rule_id, h.line_no AS line, string_agg(concat(CASE WHEN l.line_no = h.line_no THEN '>' ELSE ' ' END, l.line_no, '|',
  {REDACTED.format(f"rtrim(l.line, {WS})")}), chr(10) ORDER BY l.line_no) AS fragment
FROM v_hits h JOIN v_lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL""",
)
def w_03(t):
    rows = F.transform(
        "context.fragment",
        lambda x: F.concat(F.when(x["is_hit"], ">").otherwise(" "), x["n"], F.lit("|"), x["text"]),
    )
    return scan.scan_files(t.scanned).select("path", "rule_id", "line", F.array_join(rows, "\n").alias("fragment"))


CONSTRUCT_SQL = f"""
SELECT h.path, h.rule_id, h.line_no AS line, coalesce(arg_max(
  CASE WHEN regexp_matches(lower(d.line), 'class |interface |object ') THEN 'clase/objeto' ELSE 'función/método' END
    || ' «' || regexp_extract(d.line, {literal(st.DECLARATION)}, 1) || '»', d.line_no), '') AS construct
FROM v_hits h LEFT JOIN v_lines d ON d.path = h.path AND d.line_no <= h.line_no
  AND regexp_matches(d.line, {literal(st.DECLARATION)}) GROUP BY ALL"""


@query("w_04_enclosing_construct", CONSTRUCT_SQL)
def w_04(t):
    return scan.scan_files(t.scanned).select("path", "rule_id", "line", F.col("context.construct").alias("construct"))


@query("j_24_line_to_declaration", CONSTRUCT_SQL.replace("v_hits h", "(SELECT * FROM v_hits WHERE rule_id = 'SEC-API-KEY') h"))
def j_24(t):
    found = scan.scan_files(t.scanned, tuple(r for r in RULES if r.id == "SEC-API-KEY"))
    return found.select("path", "rule_id", "line", F.col("context.construct").alias("construct"))


@query("s_23_redaction", "SELECT path, rule_id, line_no AS line, evidence FROM v_hits")
def s_23(t):
    return scan.scan_files(t.scanned).select("path", "rule_id", "line", "evidence")


def case_roles(column: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, {literal('(?i)' + p)}) THEN {literal(name)}" for p, name in st.FILE_ROLES
    )
    return f"CASE {whens} ELSE {literal(st.DEFAULT_ROLE)} END"


@query("s_25_file_role", f"SELECT path, {case_roles('path')} AS role FROM v_files")
def s_25(t):
    return t.files.select("path", st.file_role(F.col("path")).alias("role"))


@query(
    "s_37_relative_path",
    "SELECT path, substr(path, length(project_id) + 2) AS absolute, path AS relative FROM v_files",
)
def s_37(t):
    root = F.concat(F.lit("/tmp/x/"), "project_id")
    absolute = F.concat(F.lit("/tmp/x/"), "path")
    return t.files.select(
        "path",
        st.relative_path(absolute, root).alias("absolute"),
        st.relative_path(F.concat(F.lit("./"), "path"), root).alias("relative"),
    )


@query(
    "j_21_missing_license",
    "SELECT project_id, 'LIC-MISSING' AS rule_id, 'bajo' AS severity FROM v_files GROUP BY 1 HAVING NOT bool_or(base = 'LICENSE')",
)
def j_21(t):
    return scan.missing_license(t.files).select("project_id", "rule_id", "severity")


@query(
    "a_06_finding_counts",
    """
SELECT project_id, 'severity' AS dimension, severity AS value, count(*) AS findings FROM v_hits GROUP BY ALL
UNION ALL SELECT project_id, 'category', category, count(*) FROM v_hits GROUP BY ALL
UNION ALL SELECT project_id, 'engine', 'interno', count(*) FROM v_hits GROUP BY ALL
UNION ALL SELECT project_id, 'total', '', count(*) FROM v_hits GROUP BY ALL""",
)
def a_06(t):
    return scan.finding_counts(scan.scan_files(t.scanned))


@query(
    "o_09_severity_order",
    """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY list_position(['crítico', 'alto', 'medio', 'bajo', 'info'], severity)) AS n
FROM (SELECT project_id, severity, count(*) AS findings FROM v_hits GROUP BY ALL)""",
)
def o_09(t):
    return placed(scan.severity_counts(scan.scan_files(t.scanned)), ["project_id"], [scan.gravest_first()])


view(
    "v_ext_counts",
    "SELECT project_id, CASE WHEN ext = '' THEN '(sin)' ELSE ext END AS extension, count(*) AS files FROM v_ext GROUP BY ALL",
)


@query("a_07_extension_counts", "SELECT * FROM v_ext_counts")
def a_07(t):
    return scan.extension_counts(t.files)


@query(
    "o_06_top_extensions",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, extension) AS rank FROM v_ext_counts) WHERE rank <= 3",
)
def o_06(t):
    return scan.top_extensions(t.files, 3)


@query(
    "a_08_language_counts",
    """
SELECT project_id, CASE ext WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java' ELSE 'JavaScript' END AS language, count(*) AS files
FROM v_ext WHERE ext IN ('.py', '.java', '.js') GROUP BY ALL""",
)
def a_08(t):
    return scan.language_counts(t.files)


@query(
    "a_09_android_permissions",
    """
SELECT DISTINCT project_id, unnest(regexp_extract_all(text, 'android\\.permission\\.[A-Z_]+')) AS permission FROM v_scanned
WHERE base = 'AndroidManifest.xml'""",
)
def a_09(t):
    return scan.android_permissions(t.scanned)


@query(
    "a_10_project_flags",
    f"""
SELECT project_id, bool_or(base = 'LICENSE') AS has_license,
  bool_or(ext IN ('.java', '.xml', '.gradle') AND regexp_matches(text, {literal(st.OIDC_HINT.replace('(?iu)', '(?i)'))})) AS has_oidc
FROM v_ext GROUP BY 1""",
)
def a_10(t):
    return scan.project_flags(t.files)


@query(
    "a_26_main_build_module",
    """
SELECT project_id, uses, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY uses DESC, path) AS r FROM (
  SELECT project_id, path, len(regexp_extract_all(text, 'implementation')) AS uses FROM v_scanned WHERE base = 'build.gradle')) WHERE r = 1""",
)
def a_26(t):
    return scan.main_build_module(t.scanned)


@query(
    "o_12_file_limit",
    """
SELECT project_id, least(count(*), 7) AS scanned, greatest(count(*) - 7, 0) AS skipped FROM v_scanned GROUP BY 1""",
)
def o_12(t):
    return scan.file_limit_counts(t.scanned, 7)


@query(
    "o_12_file_limit_rows",
    "SELECT project_id, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path) AS r FROM v_scanned) WHERE r <= 7",
)
def o_12_rows(t):
    return scan.limit_files(t.scanned.select("project_id", "path"), 7)


# ---- taint

view(
    "v_code_arrays",
    "SELECT * FROM v_arrays WHERE ext IN ('.py', '.java', '.js')",
)
SOURCE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(rhs, {literal(p)}) THEN {literal(name)}" for p, name in taint.SOURCES
) + " END"
view(
    "v_assign",
    f"""
SELECT path, line_no, name, rhs, {SOURCE_CASE} AS label, regexp_extract_all(rhs, '[A-Za-z_]\\w*') AS ids,
  row_number() OVER (PARTITION BY path ORDER BY line_no) AS step
FROM (SELECT l.path, l.line_no, regexp_extract(l.line, {literal(taint.ASSIGNMENT)}, 1) AS name,
    regexp_extract(l.line, {literal(taint.ASSIGNMENT)}, 2) AS rhs
  FROM v_lines l WHERE l.ext IN ('.py', '.java', '.js') AND regexp_matches(l.line, {literal(taint.ASSIGNMENT)}))""",
)
# State after each assignment as three parallel lists, carried by a recursion over all files at once.
view(
    "v_state",
    """
SELECT path, 0::BIGINT AS step, []::VARCHAR[] AS names, []::BIGINT[] AS lines, []::VARCHAR[] AS labels FROM v_code_arrays
UNION ALL
SELECT path, step, CASE WHEN src IS NULL OR list_contains(names, name) THEN names ELSE list_append(names, name) END,
  CASE WHEN src IS NULL THEN lines WHEN pos = 0 THEN list_append(lines, src_line)
    ELSE list_transform(lines, lambda x, i: CASE WHEN i = pos THEN src_line ELSE x END) END,
  CASE WHEN src IS NULL THEN labels WHEN pos = 0 THEN list_append(labels, src)
    ELSE list_transform(labels, lambda x, i: CASE WHEN i = pos THEN src ELSE x END) END
FROM (SELECT s.path, a.step, s.names, s.lines, s.labels, a.name, coalesce(list_position(s.names, a.name), 0) AS pos,
    coalesce(a.label, s.labels[list_filter(range(1, len(s.names) + 1), lambda i: list_contains(a.ids, s.names[i]) AND s.names[i] <> a.name)[1]]) AS src,
    CASE WHEN a.label IS NOT NULL THEN a.line_no
      ELSE s.lines[list_filter(range(1, len(s.names) + 1), lambda i: list_contains(a.ids, s.names[i]) AND s.names[i] <> a.name)[1]] END AS src_line
  FROM v_state s JOIN v_assign a ON a.path = s.path AND a.step = s.step + 1)""",
)
view(
    "v_final",
    "SELECT path, names, lines, labels FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY step DESC) AS r FROM v_state) WHERE r = 1",
)


@query(
    "w_11_taint_state",
    """
SELECT path, array_to_string(list_transform(range(1, len(names) + 1), lambda i: concat(names[i], ':', lines[i], ':', labels[i])), ' | ') AS state
FROM v_final""",
)
def w_11(t):
    text = F.transform("state", lambda s: F.concat_ws(":", s["name"], s["line"], s["label"]))
    return taint.traced_files(t.scanned).select("path", F.array_join(text, " | ").alias("state"))


SINK_ROWS = values((i, p, name, cwe) for i, (p, name, cwe) in enumerate(taint.SINKS))
SINK_LINES = " UNION ALL ".join(
    f"SELECT path, line_no, line, {i} AS kind, {literal(name)} AS sink, '{cwe}' AS cwe FROM v_lines "
    f"WHERE ext IN ('.py', '.java', '.js') AND regexp_matches(line, {literal(p)})"
    for i, (p, name, cwe) in enumerate(taint.SINKS)
)
view(
    "v_flows",
    f"""
SELECT path, labels[v] AS source, lines[v] AS source_line, names[v] AS name, sink, line_no AS sink_line, cwe, kind FROM (
  SELECT *, list_filter(range(1, len(names) + 1), lambda i: list_contains(ids, names[i]) AND lines[i] <= line_no)[1] AS v FROM (
    SELECT s.*, f.names, f.lines, f.labels, regexp_extract_all(s.line, '[A-Za-z_]\\w*') AS ids FROM ({SINK_LINES}) s JOIN v_final f USING (path)))
WHERE v IS NOT NULL""",
)


@query(
    "j_17_flow_controls",
    "SELECT path, sink_line, cwe, CASE "
    + " ".join(f"WHEN cwe = '{k}' THEN '{','.join(v)}'" for k, v in taint.FLOW_CONTROLS.items())
    + " ELSE '' END AS controls FROM v_flows",
)
def j_17_flows(t):
    flows = taint.flow_paths(t.scanned)
    return flows.select("path", "sink_line", "cwe", F.array_join(taint.flow_controls(F.col("cwe")), ",").alias("controls"))


@query("j_23_taint_to_sink", "SELECT path, source, source_line, name, sink, sink_line, cwe FROM v_flows")
def j_23(t):
    return taint.flow_paths(t.scanned).drop("project_id", "kind")


view(
    "v_first_flow",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, sink_line ORDER BY kind) AS r FROM v_flows) WHERE r = 1",
)


@query(
    "j_18_attach_flow",
    """
SELECT h.path, h.rule_id, h.line_no AS line, f.path IS NOT NULL AS reachable, f.sink FROM v_hits h
LEFT JOIN v_first_flow f ON f.path = h.path AND f.sink_line = h.line_no""",
)
def j_18(t):
    found = taint.attach_flows(scan.scan_files(t.scanned).drop("context"), taint.flow_paths(t.scanned))
    return found.select("path", "rule_id", "line", "reachable", "flow.sink")


@query(
    "j_19_unmatched_flow",
    """
SELECT path, 'TAINT-' || cwe AS rule_id, sink_line AS line,
  concat(source, ' (línea ', source_line, ') alcanza el sumidero de ', sink, ' a través de «', name, '».') AS evidence,
  CASE cwe WHEN 'CWE-78' THEN 'crítico' WHEN 'CWE-532' THEN 'medio' WHEN 'CWE-22' THEN 'medio' ELSE 'alto' END AS severity
FROM v_first_flow f WHERE NOT EXISTS (SELECT 1 FROM v_hits h WHERE h.path = f.path AND h.line_no = f.sink_line)""",
)
def j_19(t):
    alone = taint.unmatched_flows(scan.scan_files(t.scanned).drop("context"), taint.flow_paths(t.scanned))
    return alone.select("path", "rule_id", "line", "evidence", "severity")


@query(
    "x_02_taint_variables",
    "SELECT path, len(names) AS tainted FROM v_final WHERE len(names) > 0",
)
def x_02(t):
    n = F.size("state")
    return taint.traced_files(t.scanned).select("path", n.alias("tainted")).where("tainted > 0")


@query(
    "u_07_all_findings",
    """
SELECT project_id, engine, rule_id, count(*) AS findings FROM (
  SELECT project_id, 'interno' AS engine, rule_id FROM v_hits
  UNION ALL SELECT project_id, 'interno', 'LIC-MISSING' FROM v_files GROUP BY 1 HAVING NOT bool_or(base = 'LICENSE')
  UNION ALL SELECT s.project_id, 'taint', 'TAINT-' || cwe FROM v_first_flow f JOIN v_scanned s USING (path)
    WHERE NOT EXISTS (SELECT 1 FROM v_hits h WHERE h.path = f.path AND h.line_no = f.sink_line)) GROUP BY ALL""",
)
def u_07(t):
    from ..plans.scan_flow import scan_projects

    return (
        scan_projects(t.files).groupBy("project_id", "engine", "rule_id").agg(F.count("*").alias("findings"))
    )


# ---- corroboration

view(
    "v_rules",
    f"SELECT * FROM ({rows_of_rules(RULES)}) t(rule_id, title, category, severity, cwe, guide, mitigation)",
)
view(
    "v_findings",
    f"""
SELECT f.*, r.title, r.category, r.severity, r.cwe, r.guide, r.mitigation FROM (
  SELECT 'src' || (user_id % 20) AS project_id, event_id AS ord, ([{", ".join(f"'{r.id}'" for r in RULES)}])[event_id % 18 + 1] AS rule_id,
  CASE event_id % 5 WHEN 0 THEN 'src/test/' WHEN 1 THEN 'sample/' WHEN 2 THEN 'docs/' ELSE 'app/' END
    || (['LoginToken', 'UserDao', 'HttpClient', 'MainActivity', 'Misc'])[event_id % 7 % 5 + 1] || (event_id % 60) || '.kt' AS path,
  CASE WHEN event_id % 18 <> 17 THEN event_id % 40 + 1 END AS line,
  CASE WHEN event_id % 2 = 0 THEN 'key = "abc' || printf('%X', event_id) || 'QWERTYasdfgh0123"'
    ELSE 'key = abc' || printf('%X', event_id) || 'QWERTYasdfgh0123' END AS evidence, event_id % 19 = 0 AS reachable FROM events) f
JOIN v_rules r USING (rule_id)""",
)
view(
    "v_external",
    f"""
SELECT project_id, ord, 'EXT-' || (ord % 5) AS rule_id, path, CASE WHEN ord % 9 <> 0 THEN line + CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END END AS line,
  CASE WHEN ord % 27 = 0 THEN 'CVE-2024-' || (1000 + ord % 10) ELSE 'x' END AS evidence,
  ([{", ".join(f"'{e}'" for e in ENGINES)}])[ord % 7 + 1] AS engine, category,
  CASE WHEN ord % 2 = 0 THEN regexp_extract(cwe, 'CWE-\\d+') ELSE 'CWE-999' END AS cwe
FROM v_findings""",
)
KEY = """concat(path, '|', coalesce(cast(line AS VARCHAR), 'none'), '|', CASE WHEN line IS NOT NULL THEN coalesce(nullif(regexp_extract(coalesce(cwe, ''), 'CWE-\\d+'), ''), category)
  ELSE coalesce(nullif(regexp_extract(concat_ws(' ', rule_id, evidence), 'CVE-\\d{4}-\\d+'), ''), rule_id) END)"""
view(
    "v_corroborated",
    f"""
SELECT i.project_id, i.rule_id, i.ord, 'interno' AS engine,
  CASE WHEN i.r = 1 THEN (SELECT array_to_string(list_sort(list(DISTINCT e.engine)), ',') FROM v_ext_keys e WHERE e.project_id = i.project_id AND e.k = i.k) END AS corroborated_by
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY ord) AS r FROM (SELECT *, {KEY} AS k FROM v_findings)) i
UNION ALL
SELECT project_id, arg_min(rule_id, ord), min(ord), arg_min(engine, ord),
  array_to_string(list_sort(list(DISTINCT engine) FILTER (WHERE r > 1)), ',') FROM v_ext_keys
WHERE (project_id, k) NOT IN (SELECT (project_id, {KEY}) FROM v_findings) GROUP BY project_id, k""",
)
view(
    "v_ext_keys",
    f"""
SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY ord) AS r FROM (SELECT *, {KEY} AS k FROM v_external)""",
)


def merged(t):
    external = t.external.select(*t.findings.columns)
    return scan.corroborate(t.findings, external)


@query(
    "j_20_corroboration",
    "SELECT project_id, rule_id, ord, engine, coalesce(corroborated_by, '') AS corroborated_by FROM v_corroborated",
)
def j_20(t):
    by = F.coalesce(F.array_join("corroborated_by", ","), F.lit(""))
    return merged(t).select("project_id", "rule_id", "ord", "engine", by.alias("corroborated_by"))


@query(
    "a_27_corroborating_engines",
    """
SELECT corroborated_by AS engines, count(*) AS findings FROM v_corroborated WHERE corroborated_by <> '' GROUP BY 1""",
)
def a_27(t):
    return (
        scan.corroborated(merged(t))
        .groupBy(F.array_join("corroborated_by", ",").alias("engines"))
        .agg(F.count("*").alias("findings"))
    )


@query(
    "f_14_corroborated",
    "SELECT project_id, rule_id, ord FROM v_corroborated WHERE corroborated_by <> ''",
)
def f_14(t):
    return scan.corroborated(merged(t)).select("project_id", "rule_id", "ord")
