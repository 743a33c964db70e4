"""Coordinates of a manifest are read and resolved at once, a batch of manifests at a time."""

from pyspark.sql import functions as F

from partwatch.operators import gradle

DDL = "project_id int, content string, toml string"
CONTENT = """val v = "1.2"
val v = '1.3'
implementation("a.b:c:$v") API "x:y:${libs.versions.agp}" kapt('m:n:$none')
api(group = "g", name = "n") implementation("a.b:c:9") classpath "p:q"
ksp(libs.one.two) testImplementation(libs.By_ref) api(libs.gone) implementation(platform(libs.short))
"""
TOML = """[versions]\r
agp = "8.1"
v = "7"
 [Libraries]
one-two = { module = "k:l", version.ref = "agp", version = "4" }
one_two = { module = "k:l2", version.ref = "lost" }
\u00a0by-ref\u00a0= { group = "io", name = "r", version = '5' }
# gone = "a:b"
"short" = "s:t:1.0"
bad = { group = "g" }
"""


def test_resolved(spark):
    """Variables, catalogue and references of every manifest were worked out by lambdas."""
    rows = [(1, CONTENT, TOML), (2, CONTENT, None), (3, None, TOML), (4, "\x01 kapt('m:n:\x011')", ""), (5, "", "x")]
    found = gradle.dependencies(spark.createDataFrame(rows, DDL).coalesce(1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" read(") + plan.count("[read(") == 1 and "reverse(" not in plan
    got = {}
    for r in found.orderBy("project_id", "ord").collect():
        got.setdefault(r.project_id, []).append((r.package, r.group, r.artifact, r.version, r.interpolated))
        assert r.ord == len(got[r.project_id]) - 1
    plain = [("m:n", "m", "n", None, True), ("g:n", "g", "n", None, False), ("p:q", "p", "q", None, False)]
    assert got == {
        1: [
            ("a.b:c", "a.b", "c", "7", False), ("x:y", "x", "y", "8.1", False), *plain,
            ("k:l2", "k", "l2", None, True), ("io:r", "io", "r", "5", False), ("libs.gone", "libs", "gone", None, True), ("s:t", "s", "t", None, True),
        ],
        2: [("a.b:c", "a.b", "c", "1.3", False), ("x:y", "x", "y", None, True), *plain],
    }


def test_each_manifest_has_its_own_variables(spark):
    rows = [(i, f'val v = "{i}.0"\nimplementation("a:b:$v")' if i % 3 else 'implementation("a:b:$v")', None) for i in range(50)]
    found = gradle.dependencies(spark.createDataFrame(rows, DDL).repartition(3))
    assert {(r.project_id, r.version) for r in found.select("project_id", F.col("version")).collect()} == {(i, f"{i}.0" if i % 3 else None) for i in range(50)}
