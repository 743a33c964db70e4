"""Queries over scanner reports: one report per order and engine, filled from the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scanners
from .registry import query, view

# Report bodies of each engine. {k} is the order, {p} its priority number, {s} a severity, {f} a file path.
BODIES = {
    "semgrep": '{"results": [{"path": "{f}", "check_id": "rules.local.eval-{p}", "start": {"line": {p}}, "extra": {"severity": "{s}", '
    '"message": "bad call {k}", "lines": "token = \\"secret{k}aaaaaaaaaa\\"", "metadata": {"cwe": "CWE-95: eval", "categoria": "INYECCION"}}}, '
    '{"path": "{f}", "check_id": "list", "start": {"line": 7}, "extra": {"severity": "INFO", "message": "listed", "metadata": {"cwe": ["CWE-79", "CWE-80"], '
    '"titulo": "Lista", "mitigacion": "fix it"}}}]}',
    "detect-secrets": '{"results": {"{f}": [{"type": "Base64 High Entropy", "line_number": {p}}, {"type": "Keyword{k}", "line_number": 9}]}}',
    "bandit": '{"results": [{"filename": "./{f}", "line_number": {p}, "test_id": "B60{p}", "test_name": "sub{k}", "issue_severity": "{s}", '
    '"issue_text": "shell", "code": "subprocess.call({k})", "issue_cwe": {"id": 78}}]}',
    "njsscan": '{"nodejs": {"rule_{p}": {"metadata": {"cwe": "CWE-918: SSRF", "severity": "{s}", "description": "ssrf {k}"}, "files": [{"file_path": "{f}", '
    '"match_lines": [{p}, 30], "match_string": "get(url)"}, {"file_path": "b.js", "match_lines": [2, 3], "match_string": "x"}]}}, '
    '"templates": {"tpl": {"metadata": {"severity": "ERROR"}, "files": [{"file_path": "t.html"}]}}}',
    "gitleaks": '[{"File": "{f}", "StartLine": {p}, "RuleID": "generic-{p}", "Description": "Key {k}", "Match": "", "Secret": "abc{k}"}]',
    "trivy": '{"Results": [{"Target": "{f}", "Vulnerabilities": [{"VulnerabilityID": "CVE-2024-{k}", "PkgName": "lib", "InstalledVersion": "1.{p}", '
    '"FixedVersion": "2.0", "Severity": "CRITICAL", "CweIDs": ["CWE-502"]}], "Secrets": [{"RuleID": "aws", "Title": "AWS", "StartLine": {p}, "Match": "k{k}"}], '
    '"Misconfigurations": [{"ID": "DS{p}", "Title": "root user", "Severity": "{s}", "Message": "m{k}", "CauseMetadata": {"StartLine": 4}}]}]}',
    "retire": '{"data": [{"file": "{f}", "results": [{"component": "jquery", "version": "1.{p}", "vulnerabilities": [{"severity": "{s}", '
    '"identifiers": {"CVE": ["CVE-2020-{k}"], "summary": "xss"}}, {"severity": "low", "identifiers": {"issue": "77"}}]}]}]}',
}

view(
    "v_orders",
    """
SELECT o_orderkey AS k, 'src' || o_custkey AS project_id, 1 + o_orderkey % 5 AS p, (['HIGH', 'medium', 'LOW', 'odd'])[o_orderkey % 4 + 1] AS s,
  (['alto', 'medio', 'bajo', 'medio'])[o_orderkey % 4 + 1] AS local, 'app/f' || (o_orderkey % 50) || '.py' AS f, o_orderkey % 23 = 0 AS broken
FROM orders""",
)


def reports(t, engine=None):
    """Every twenty-third report is cut short, so it cannot be read."""
    k = F.col("o_orderkey")
    severity = F.get(F.array(*[F.lit(s) for s in ("HIGH", "medium", "LOW", "odd")]), (k % 4).cast("int"))
    path = F.concat(F.lit("app/f"), k % 50, F.lit(".py"))
    fields = {"{k}": k.cast("string"), "{p}": (1 + k % 5).cast("string"), "{s}": severity, "{f}": path}
    orders = t.table("orders")

    def body(text):
        out = F.lit(text)
        for mark, value in fields.items():
            out = F.replace(out, F.lit(mark), value)
        return F.when(k % 23 == 0, F.left(out, F.length(out) - 6)).otherwise(out)

    chosen = [engine] if engine else list(BODIES)
    bodies = F.array(*[F.struct(F.lit(e).alias("engine"), body(BODIES[e]).alias("body")) for e in chosen])
    return orders.select(
        F.concat(F.lit("src"), "o_custkey").alias("project_id"), F.lit("/scan").alias("root"), F.explode(bodies).alias("r")
    ).select("project_id", "root", "r.*")


COLUMNS = ("project_id", "rule_id", "title", "severity", "path", "line", "cwe", "evidence")


def read(t, engine):
    return scanners.READERS[engine](reports(t, engine)).select(*COLUMNS)


def rows(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT project_id, {p} FROM v_orders WHERE NOT broken" for p in parts)


SQL = {
    "semgrep": rows(
        "concat('SG-eval-', p) AS rule_id, concat('bad call ', k) AS title, local AS severity, f AS path, p AS line, 'CWE-95' AS cwe, 'token = \"sec…[REDACTADO]…aa\"' AS evidence",
        "'SG-list', 'Lista', 'bajo', f, 7, 'CWE-79', ''",
    ),
    "detect-secrets": rows(
        "'DS-Base64-High-Entropy' AS rule_id, 'Secreto detectado: Base64 High Entropy' AS title, 'alto' AS severity, f AS path, p AS line, 'CWE-798' AS cwe, 'Base64 High Entropy' AS evidence",
        "concat('DS-Keyword', k), concat('Secreto detectado: Keyword', k), 'alto', f, 9, 'CWE-798', concat('Keyword', k)",
    ),
    "bandit": rows(
        "concat('BANDIT-B60', p) AS rule_id, concat('sub', k) AS title, local AS severity, f AS path, p AS line, 'CWE-78' AS cwe, concat('subprocess.call(', k, ')') AS evidence",
    ),
    "njsscan": rows(
        "concat('NJS-rule_', p) AS rule_id, concat('ssrf ', k) AS title, local AS severity, f AS path, p AS line, 'CWE-918' AS cwe, 'get(url)' AS evidence",
        "concat('NJS-rule_', p), concat('ssrf ', k), local, 'b.js', 2, 'CWE-918', 'x'",
        "'NJS-tpl', 'tpl', 'alto', 't.html', NULL, NULL, ''",
    ),
    "gitleaks": rows(
        "concat('GL-generic-', p) AS rule_id, concat('Secreto detectado: Key ', k) AS title, 'alto' AS severity, f AS path, p AS line, 'CWE-798' AS cwe, concat('abc', k) AS evidence",
    ),
    "trivy": rows(
        "concat('TRIVY-CVE-2024-', k) AS rule_id, concat('CVE-2024-', k) AS title, 'crítico' AS severity, f AS path, NULL AS line, 'CWE-502' AS cwe, concat('lib 1.', p, ' -> CVE-2024-', k) AS evidence",
        "'TRIVY-SEC-aws', 'Secreto detectado: AWS', 'alto', f, p, 'CWE-798', concat('k', k)",
        "concat('TRIVY-CFG-DS', p), 'root user', local, f, 4, NULL, concat('m', k)",
    ),
    "retire": rows(
        "concat('RETIRE-CVE-2020-', k) AS rule_id, 'xss' AS title, local AS severity, f AS path, NULL AS line, NULL AS cwe, concat('jquery 1.', p, ' -> CVE-2020-', k) AS evidence",
        "'RETIRE-77', concat('jquery 1.', p, ': librería JS vulnerable'), 'bajo', f, NULL, NULL, concat('jquery 1.', p)",
    ),
}
NAMES = {
    "n_01_semgrep": "semgrep",
    "n_02_detect_secrets": "detect-secrets",
    "n_03_bandit": "bandit",
    "n_04_njsscan": "njsscan",
    "n_05_gitleaks": "gitleaks",
    "n_06_trivy": "trivy",
    "n_07_retire": "retire",
}
for _name, _engine in NAMES.items():
    query(_name, SQL[_engine])(lambda t, e=_engine: read(t, e))

ALL = " UNION ALL ".join(f"SELECT '{e}' AS engine, * FROM ({sql})" for e, sql in SQL.items())


@query("u_03_all_scanners", f"SELECT engine, project_id, count(*) AS findings FROM ({ALL}) GROUP BY 1, 2")
def u_03(t):
    return scanners.all_findings(reports(t)).groupBy("engine", "project_id").agg(F.count("*").alias("findings"))


@query(
    "src_11_scanner_reports",
    f"SELECT engine, count(*) AS findings, count(line) AS located FROM ({ALL}) GROUP BY 1",
)
def src_11(t):
    return (
        scanners.all_findings(reports(t)).groupBy("engine").agg(F.count("*").alias("findings"), F.count("line").alias("located"))
    )


@query("s_35_severity_scale", "SELECT k, s, local AS severity FROM v_orders")
def s_35(t):
    k = F.col("o_orderkey")
    s = F.get(F.array(*[F.lit(v) for v in ("HIGH", "medium", "LOW", "odd")]), (k % 4).cast("int"))
    return t.table("orders").select(k.alias("k"), s.alias("s")).withColumn("severity", scanners.local_severity(F.col("s")))


@query("s_36_cwe", f"SELECT engine, cwe, count(*) AS findings FROM ({ALL}) GROUP BY 1, 2")
def s_36(t):
    return scanners.all_findings(reports(t)).groupBy("engine", "cwe").agg(F.count("*").alias("findings"))


@query(
    "a_29_engine_counts",
    f"""
SELECT p.project_id, e.engine, count(a.rule_id) AS findings FROM (SELECT DISTINCT project_id FROM v_orders) p
CROSS JOIN (SELECT unnest([{", ".join(f"'{e}'" for e in scanners.ENGINES)}]) AS engine) e
LEFT JOIN ({ALL}) a ON a.project_id = p.project_id AND a.engine = e.engine GROUP BY 1, 2""",
)
def a_29(t):
    projects = t.table("orders").select(F.concat(F.lit("src"), "o_custkey").alias("project_id")).distinct()
    return scanners.engine_counts(scanners.all_findings(reports(t)), projects)
