"""Hand-worked edge cases."""

from pyspark.sql import functions as F

from partwatch.functions import advisories, compliance, platform, source_text, versions
from partwatch.functions.common import split_lines
from partwatch.operators import catalog, taint
from partwatch.plans.skew import lookup_join, running_totals, top_per_group


def values(spark, rows, expression, ddl="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(expression).collect()]


def test_clean_range(spark):
    specs = ["^1.2.3", "~7.8", ">=2", " 5.0.2 ", "*", "", "git+https://x/1.0.0", "npm:a@1.0.0", "beta"]
    got = values(spark, specs, versions.clean_range(F.col("v")))
    assert [(r["base"], r["pinned"]) for r in got] == [
        ("1.2.3", False),
        ("7.8", False),
        ("2", False),
        ("5.0.2", True),
        (None, False),
        (None, False),
        (None, False),
        (None, False),
        (None, False),
    ]


def test_semver_ignores_suffixes(spark):
    got = values(spark, ["1.2.3-rc.1", "2.x.4+b", "7", "1.2.3.4"], versions.semver(F.col("v")))
    assert [tuple(r) for r in got] == [(1, 2, 3), (2, 0, 4), (7, 0, 0), (1, 2, 3)]


def test_cvss_band(spark):
    scores = ["9.8", "7", "6.9", "0.1", "0", "high", "CVSS:3.1/AV:N", "moderate risk", None]
    got = values(spark, scores, advisories.cvss_band(F.col("v")))
    assert got == ["crítica", "alta", "media", "baja", None, "alta", None, "media", None]


def test_compliance_category(spark):
    names = ["rut-validator", "rutificador-cl", "my-dni-lib", "lodash", "consulta-padron"]
    got = values(spark, names, compliance.compliance_category(F.col("v"), F.lit(None), F.lit(False)))
    assert got == [
        "tratamiento_identificadores",
        "consulta_datos_personales",
        "tratamiento_identificadores",
        None,
        "consulta_datos_personales",
    ]


def test_cycle_status(spark):
    rows = [("true", None), ("2020-01-01", None), ("2999-01-01", "false"), ("2999-01-01", "2020-1-1"), ("bad", None), ("false", "false"), (None, "false")]
    df = spark.createDataFrame(rows, "eol string, support string")
    got = df.select(catalog.cycle_status(F.col("eol"), F.col("support"), F.lit("2024-01-01").cast("date"))).collect()
    assert [r[0] for r in got] == ["eol", "eol", "obsolete", "obsolete", "ok", "ok", "unknown"]


def test_redaction_and_lines(spark):
    got = values(spark, ['key = "abcdefghijkl"', "x = 'short'"], source_text.redact(F.col("v")))
    assert got == ['key = "abc…[REDACTADO]…kl"', "x = 'short'"]
    assert values(spark, ["a\r\nb\x0bc d\n", ""], split_lines(F.col("v"))) == [["a", "b", "c", "d"], []]


def test_extension(spark):
    got = values(spark, ["a/.env", "a/b.tar.GZ", "a/Makefile", "a.b/c"], source_text.extension(F.col("v")))
    assert got == ["", ".gz", "", ""]


def test_sdk_assessment(spark):
    got = values(spark, ["36", "35", "30", "x"], platform.assess_sdk("targetSdk", F.col("v")))
    assert [r["platform_level"] for r in got] == ["ok", "bajo", "alto", "desconocido"]


def test_taint_uses_the_state_at_the_end(spark):
    text = "a = req.query.x\nb = a\neval(b)\na = input()\nb = a\nnew File(c)"
    files = spark.createDataFrame([("p", "f.js", text)], "project_id string, path string, text string")
    # b is set again on line 5 from a source of line 4, so the sink on line 3 is no longer reached.
    assert taint.flow_paths(files).count() == 0
    state = taint.traced_files(files).first()["state"]
    assert [(s["name"], s["line"]) for s in state] == [("a", 4), ("b", 4)]


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(900, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    plain = left.join(right, "k", "left").select("id", "k", "v")
    for threshold in ("1b", "256MB"):
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", threshold)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        split = lookup_join(left, right, ["k"]).select("id", "k", "v")
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_totals_and_large_limits(spark):
    rows = [("big", i, i % 7) for i in range(2000)] + [("small", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int, x int")
    got = {(r["g"], r["i"]): r["t"] for r in running_totals(df, ["g"], [F.asc("i")], {"t": F.col("x")}).collect()}
    total = 0
    for i in range(2000):
        total += i % 7
        assert got[("big", i)] == total
    assert got[("small", 2)] == 3
    top = top_per_group(df, ["g"], [F.asc("i")], 1500, "r").where("g = 'big'")
    assert sorted(r["i"] for r in top.collect()) == list(range(1500))
