"""Everything is judged whole: no default limit hides an advisory, a hit or a part of a text."""

from pyspark.sql import functions as F

from partwatch.functions import advisories
from partwatch.operators import audit, finding_risk, scan
from partwatch.sources import scanners


def test_the_eleventh_advisory_counts(spark):
    ids = [f"OSV-{i:02d}" for i in range(12)]
    affected = spark.createDataFrame([("npm", "p", "1.0.0", i) for i in ids], "ecosystem string, package string, version string, osv_id string")
    scores = [("9.8" if i == "OSV-10" else "1.0", ("x" * 1_500 + " data exfiltration") if i == "OSV-10" else "issue") for i in ids]
    raw = spark.createDataFrame([(i, s, t) for i, (s, t) in zip(ids, scores, strict=True)], "osv_id string, score string, details string")
    none = F.lit(None).cast("string")
    no_names = F.lit(None).cast("array<string>")
    scored = F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.col("score").alias("score")))
    links = F.lit(None).cast("array<struct<type:string,url:string>>")
    detail = advisories.shape(F.col("osv_id"), no_names, scored, links, F.lit(""), F.col("details"), none, none)
    details = raw.select("osv_id", detail.alias("detail"))
    row = audit.with_listed(audit.advisories_by_version(affected, details), affected, details).first()
    assert (row.vuln_count, row.severity, row.malicious, row.malware_id) == (12, "crítica", True, "OSV-10")
    assert row.vuln_ids == ids[:8]


def test_all_hits_of_a_file(spark):
    lines = "\n".join(f'password = "hunter{i:02d}x"' for i in range(80))
    files = spark.createDataFrame([("p", "a.py", lines)], "project_id string, path string, text string")
    per_rule = scan.scan_files(files).groupBy("rule_id").count().agg(F.max("count")).first()[0]
    assert per_rule == 80
    assert scan.scan_files(files, limit=50).groupBy("rule_id").count().agg(F.max("count")).first()[0] == 50


def test_all_hotspots_are_counted(spark):
    rows = [("p", f"f{i}.py", n, "t", "alto", "crítico", "alto", "alto", 5.0, "R") for i in range(9) for n in (1, 2)]
    ddl = "project_id string, path string, line int, title string, severity string, risk_level string, impact_level string, probability_level string, score double, rule_id string"
    text = finding_risk.executive_summary(spark.createDataFrame(rows, ddl)).first().summary
    assert "Se identificaron 9 punto(s) caliente(s)" in text


def test_secrets_across_any_border_are_redacted(spark):
    secret = "abcdefghijklmnopqrstuvwxyz0123456789"
    body = '[{"File": "a", "StartLine": 1, "RuleID": "r", "Description": "d", "Match": "%s key = \\"%s\\" end"}]' % ("y" * 180, secret)
    reports = spark.createDataFrame([("p", "/x", body)], "project_id string, root string, body string")
    evidence = scanners.gitleaks(reports).first().evidence
    assert secret[3:20] not in evidence and evidence.endswith('end') and "[REDACTADO]" in evidence


def test_far_declaration(spark):
    text = "fun outer(x: Int) {\n" + "  y = 1\n" * 200 + '  password = "hunter2x"\n}'
    files = spark.createDataFrame([("p", "a.kt", text)], "project_id string, path string, text string")
    assert "«outer»" in scan.scan_files(files).first().context.construct
