"""Findings and flows are read once where both are needed, texts once where many rules may match."""

from pyspark.sql import functions as F

from partwatch.operators import rule_index, scan, taint
from partwatch.plans.scan_flow import scan_projects
from partwatch.rules import rule_table

FINDING = "project_id string, rule_id string, title string, path string, line int, evidence string, engine string, context string"
TEXT = 'String user = request.getParameter("q");\ndb.rawQuery(user, null);\napi_key = "abcdefghijklmnop"\nsee http://example.org/ MD5\neval(user);\n'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted((str(r) for r in df.collect()))


def test_matched_and_unmatched_flows_in_one_join(spark):
    """findings were worked out again for those without a line, and once more for the flows that meet none."""
    findings = spark.createDataFrame(
        [
            ("p", "A", "t", "x", 2, "e", "interno", "c"),
            ("p", "B", "t", "x", 2, "e", "interno", "c"),
            ("p", "A", "t", "x", 3, "e", "interno", "c"),
            ("p", "A", "t", "x", None, "e", "interno", "c"),
            ("p", "A", "t", "x", None, "e", "interno", "c"),
            (None, "A", "t", "x", 2, "e", "interno", "c"),
        ],
        FINDING,
    )
    flow = lambda project, line, kind: (project, "x", "src", 1, "user", "consulta SQL", line, "CWE-89", kind)
    flows = spark.createDataFrame([flow("p", 2, 1), flow("p", 2, 0), flow("p", 5, 0), flow(None, 2, 0)], f"project_id string, path string, {taint.FLOW_DDL}")
    attached = taint.attach_flows(findings, flows)
    assert [r["reachable"] for r in attached.orderBy("project_id", "line", "rule_id").collect()] == [False, False, False, True, True, False]
    assert "Union" not in plan(attached)
    both = attached.unionByName(taint.unmatched_flows(findings, flows), allowMissingColumns=True)
    together = taint.with_flows(findings, flows)
    assert together.count() == 8
    assert rows(together) == rows(both.select(*together.columns))


def test_whole_scan_traces_files_once(spark):
    """files were traced twice and scanned three times."""
    files = spark.createDataFrame([("p", "app/a.java", TEXT), ("p", "app/b.java", TEXT * 2), ("q", "LICENSE", "x")], "project_id string, path string, text string")
    found = scan_projects(files)
    assert plan(found).count("MapInArrow") == 1 and plan(found).count("FULL OUTER JOIN") + plan(found).count("Join FullOuter") == 1
    assert {r["engine"] for r in found.collect()} == {"interno", "taint"}


def test_rules_of_a_file_meet_its_text_together(spark):
    """each rule took a copy of the text, cut its lines again and compiled its pattern for every line."""
    files = spark.createDataFrame([("p", "app/a.java", TEXT), ("p", "app/b.py", TEXT * 3), ("q", "c.js", None)], "project_id string, path string, text string")
    found = rule_index.scan_files_by_table(files, rule_table(spark))
    assert "RLIKE concat" not in plan(found) and "regexp_instr" in plan(found)
    keys = ["path", "rule_id", "line", "evidence", "context"]
    assert rows(found.select(*keys)) == rows(scan.scan_files(files).select(*keys))
    assert found.where(F.col("path") == "app/b.py").count() > 3
