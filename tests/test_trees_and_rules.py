"""Files of any size and rules of any number: cut files against whole ones, rule tables against rules in the plan, long files in time in line."""

import time

import pytest
from pyspark.sql import functions as F

from partwatch.operators import conformity, rule_index, scan, taint
from partwatch.plans.scan_flow import scan_projects
from partwatch.rules import RULES, rule_table
from partwatch.sources import trees

FILE = "project_id string, path string, text string"
BODY = [
    "class A {", '  String user = request.getParameter("q");', '  password = "hunter2hunter2"', "", "  // comment", "  fun save(x: Int) {", "    q = user + 1", "    db.rawQuery(q, null);",
    "  other = clean(y)", "    eval(other);", "  }", 'api_key = "abcdefghijklmnop"', "Runtime.getRuntime().exec(q);", "see http://example.org/",
]


def texts():
    long = "\n".join(BODY[(i * 7) % len(BODY)] if i % 3 else BODY[i % len(BODY)] for i in range(700))
    odd = "one\r\ntwo\rthree\x0bfour\r\n\r\n" + "\n".join(BODY) + "\r"
    flat = "\n".join(["x = 1"] * 90 + BODY[7:8] + ["y = 2"] * 90)  # the declaration is far from the hit
    return {"p/a.java": long, "p/b.py": odd, "p/c.js": "fun f(a) {\n" + flat, "q/d.java": "\n".join(BODY) + "\n", "q/node_modules/e.js": long, "q/f.png": long, "q/g.js": ""}


def files(spark):
    return spark.createDataFrame([(*p.split("/", 1), t) for p, t in texts().items()], FILE)


def plain(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


FOUND = ("project_id", "path", "rule_id", "line", "evidence", "severity", "context")
FLOW = ("project_id", "path", "source", "source_line", "name", "sink", "sink_line", "kind")


@pytest.mark.parametrize("whole,size,split", [(0, 7, 64), (0, 50, 1_000), (900, 13, 100), (1 << 20, 13, 100)])
def test_cut_files_give_what_whole_files_give(spark, tmp_path, whole, size, split):
    for p, t in texts().items():
        target = tmp_path / "tree" / p
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found, flows = trees.scan_tree(spark, str(tmp_path / "tree"), whole=whole, size=size)
        if whole == 0 and split == 64:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path / "tree/p/a.java")).rdd.getNumPartitions() > 20
        got, got_flows = plain(found, *FOUND), plain(flows, *FLOW)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = scan.scanned_files(files(spark))
    assert got == plain(scan.scan_files(expected), *FOUND) and len(got) > 20
    assert got_flows == plain(taint.flow_paths(expected), *FLOW) and len(got_flows) > 5


def test_rules_in_a_table(spark):
    """Thousands of rules beside the built-in ones, some without triggers, some with short ones, and the same findings."""
    table = rule_table(spark)
    more = [(f"R{i}", "t", "c", "bajo", "g", "l", None, "m", f"never{i}x", [f"never{i}", "zz"] if i % 9 == 0 else [] if i % 7 == 0 else [f"NEVER{i}"]) for i in range(5_000)]
    more += [("HIT", "t", "c", "bajo", "g", "l", None, "m", "Hunter\\d", ["hunter"]), ("NULL", "t", "c", "bajo", "g", "l", None, "m", None, None)]
    rules = table.unionByName(spark.createDataFrame(more, table.schema))
    source = scan.scanned_files(files(spark))
    got = rule_index.scan_files_by_table(source, rules)
    assert plain(got.where("rule_id <> 'HIT'"), *FOUND) == plain(scan.scan_files(source), *FOUND)
    assert got.where("rule_id = 'HIT'").count() == sum(t.count("hunter2h") for p, t in texts().items() if "node_modules" not in p and "png" not in p)
    assert rule_index.scan_files_by_table(source, rules.limit(0)).count() == 0
    assert rule_index.scan_files_by_table(source.limit(0), table).count() == 0


def test_controls_in_a_table(spark):
    controls = spark.createDataFrame(
        [(f"C{i}", "I", "r", "d", "t", "x", [f"R{i}"], [], True, None, "alto") for i in range(5_000)],
        "control_id string, instrument string, reference string, domain string, title string, demand string, violated_by array<string>, shown_by array<string>, assessable boolean, documents string, severity string",
    )
    ids = spark.createDataFrame([("a",), ("b",)], "project_id string")
    found = spark.createDataFrame([("a", "R7"), ("a", "R7"), ("b", "R4999"), ("b", "other")], "project_id string, rule_id string")
    empty = spark.createDataFrame([], "project_id string, rule_id string")
    levels = spark.createDataFrame([], "project_id string, global_level string")
    rows = conformity.evaluate(ids, found, empty, levels, controls)
    assert rows.count() == 10_000
    assert plain(rows.where("state = 'no_cumple'"), "project_id", "control_id", "n_findings") == ["('a', 'C7', 2)", "('b', 'C4999', 1)"]


def test_long_files_take_time_in_line(spark):
    def seconds(n):
        text = "\n".join(["v0 = input()"] + [f"v{i} = v{i - 1} + w{i}" for i in range(1, n)] + [f"eval(v{n - 1})"])
        df = spark.createDataFrame([("p", "a.py", text)], FILE)
        start = time.time()
        row = taint.traced_files(df).first()
        assert len(row["state"]) == n and row["flows"][0]["name"] == f"v{n - 1}" and row["flows"][0]["source_line"] == 1
        return time.time() - start

    seconds(1_000)
    short, long = seconds(25_000), seconds(100_000)
    assert long < 8 * short + 5


def test_findings_without_a_line_pass_the_join(spark):
    found = spark.createDataFrame([("p", "lock", None, "R"), ("p", "a.js", 3, "S")], "project_id string, path string, line int, rule_id string")
    flows = spark.createDataFrame([("p", "a.js", "s", 1, "n", "k", 3, "CWE-95", 3), ("p", "lock", "s", 1, "n", "k", None, "CWE-95", 3)], "project_id string, path string, " + taint.FLOW_DDL)
    got = {r.path: (r.reachable, r.flow) for r in taint.attach_flows(found, flows).collect()}
    assert got["lock"] == (False, None) and got["a.js"][0] is True


def test_external_findings_join_the_scan(spark):
    source = files(spark)
    alone = scan_projects(source)
    first = alone.where("line IS NOT NULL AND engine = 'interno' AND cwe IS NOT NULL").orderBy("path", "line", "rule_id").first()
    columns = scan.scan_files(source).columns
    base = alone.select(*columns).where((F.col("path") == first.path) & (F.col("line") == first.line) & (F.col("rule_id") == first.rule_id))
    same = base.withColumns({"engine": F.lit("semgrep"), "rule_id": F.lit("SG-1")})
    other = base.withColumns({"engine": F.lit("bandit"), "rule_id": F.lit("B-1"), "line": F.lit(9_999), "cwe": F.lit("CWE-1")})
    external = same.unionByName(same.withColumn("evidence", F.lit("again"))).unionByName(other).unionByName(other.withColumn("engine", F.lit("trivy")))
    merged = scan_projects(source, external=external)
    marked = merged.where(F.size("corroborated_by") > 0)
    assert sorted((r.rule_id, tuple(r.corroborated_by)) for r in marked.collect()) == sorted([(first.rule_id, ("semgrep",)), ("B-1", ("trivy",))])
    assert merged.count() == alone.count() + 1
