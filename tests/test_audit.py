"""Steps of the dependency audit against plain Python."""

import re

from pyspark.sql import functions as F

from partwatch.functions.versions import semver
from partwatch.operators import audit

NEWEST = "package string, lookup string, latest string, homepage string, repository string, description string"
DEPS = "project_id int, package string, installed string"
VULNERABLE = "ecosystem string, package string, version string, vuln_count bigint, severity string, malicious boolean, malware_id string"


def test_category_is_judged_once_per_package(spark):
    """The patterns of names and descriptions were tried on every dependency."""
    newest = spark.createDataFrame(
        [("a", "found", "1.0.0", "", "", "consulta rut y nombre"), ("b", "found", "1.0.0", "", "", "valida rut"), ("c", "found", "1.0.0", "", "", None), (None, "found", "2.0.0", "", "", "consulta rut")],
        NEWEST,
    )
    names = ["a", "b", "c", "b", "rut.js", "lookup", None, "a"]
    deps = spark.createDataFrame([(i, n, "1.0.0" if i != 3 else "0.9") for i, n in enumerate(names)], DEPS)
    by_version = spark.createDataFrame([("npm", "b", "0.9", 1, None, True, "MAL-1"), ("npm", "a", "1.0.0", 1, None, False, None)], VULNERABLE)
    entries = audit.audit_npm(deps, newest, by_version)
    lookup, ids = "consulta_datos_personales", "tratamiento_identificadores"
    wanted = [lookup, ids, None, "paquete_malicioso", ids, None, None, lookup]
    assert [r["legal_category"] for r in entries.orderBy("project_id").collect()] == wanted
    assert not {"_category", "_judged"} & set(entries.columns)
    below = audit.audit_npm(deps, newest, by_version)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Project \[(?:(?!\n).)*rutificad(?:(?!\n).)* AS _category#", below)


def test_semver_of_odd_versions(spark):
    texts = ["1.2.3", "1.2.3-rc.1+5", "1+2-3.4", "", "-1", "v1.2", " 7 .8", "1..3", "1.2.3.4", "99999999999999999999.1", "1.2\n-3", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")

    def plain(v):
        parts = ["" if v is None else p.strip() for p in ((re.match(r"[^-+]*", v)[0] if v is not None else "").split("."))]
        number = lambda i: int(parts[i]) if i < len(parts) and parts[i].isdigit() and len(parts[i]) < 19 else 0
        return tuple(number(i) for i in range(3))

    for row in df.select("id", semver(F.col("v")).alias("n")).collect():
        assert tuple(row["n"]) == plain(texts[row["id"]]), texts[row["id"]]
    plan = df.select(semver(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "regexp" not in plan
