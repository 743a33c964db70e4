"""Reports of projects that fit into one task each: lines and places of ``numbered``, without its ways through the disk."""

import textwrap
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partwatch.operators import audit
from partwatch.plans import skew
from partwatch.queries import report_queries
from partwatch.sinks import report, text_report

DDL = (
    "project_id bigint, ord struct<a:int,b:int>, section string, package string, spec string, installed string, latest string, gap string, outdated boolean, pinned boolean, note string, "
    "vuln_status string, vuln_count bigint, vuln_ids array<string>, severity string, malicious boolean, malware_id string, legal_category string, legal_level string, "
    "homepage string, repository string, npm_url string, "
    "vuln_details array<struct<id:string,severity:string,summary:string,references:array<string>>>"
)
DETAIL = ("CVE-1", "alta", "bad", ["u1", "u2", "u3", "u4"])
LEGAL = {"paquete_malicioso": "crítico", "consulta_datos_personales": "alto", None: None}


def entry(project, n, package, gap=None, count=0, severity=None, category=None, details=None, note=None):
    return (
        project, (n, 1), "s", package, "1", "1.0", "2.0", gap, gap is not None, True, note, "clean", count, ["CVE-1"] if count else None, severity, False, None, category, LEGAL[category],
        "", None, "npm", details,
    )


EVEN = [
    entry(1, 1, "a", "major"), entry(1, 2, "a", "major"), entry(1, 2, "a", "major"), entry(1, 3, None, "minor"), entry(1, 4, "z", count=2, severity="crítica", details=[DETAIL]),
    *[entry(2, i, f"p{i % 7}", category="consulta_datos_personales") for i in range(9)], *[entry(2, 3, "p3", category="consulta_datos_personales")] * 2,
    entry(3, 1, "q", count=1, severity="alta", category="paquete_malicioso", details=[DETAIL, ("CVE-2", None, "", None)]), entry(4, 1, "only", note="neterror"),
    entry(None, 1, "n", "patch"), entry(None, 2, "n", "major", category="consulta_datos_personales"),
]
UNEVEN = [entry(7, 1, "u", "major", 1, "alta", details=d) for d in ([DETAIL], [DETAIL] * 3, None, [DETAIL])] + [entry(7, 2, "v")]


class Given:
    """What the queries read of the fixtures."""

    def __init__(self, spark, rows):
        self.listed = audit.with_risk(spark.createDataFrame(rows, DDL))
        self.declared = self.listed


def queried(name, given):
    """A query's lines with the places of ``numbered``, and the query's own."""
    rows, projects, overall, general, conclusion = report_queries.joined(given)
    if name == "snk_04_text":
        parts = text_report.text_parts(rows, projects, overall, general, conclusion, "2024-05-01 10:00", "QA")
    else:
        parts = report.report_parts(rows, overall, general, conclusion)
    counted = lambda df: Counter(tuple(r) for r in df.select("project_id", "n", "line").collect())
    return counted(report.numbered(parts)), counted(getattr(report_queries, name)(given))


@pytest.mark.parametrize("name", ["snk_04", "snk_04_whole", "snk_04_text"])
def test_same_lines_at_the_same_places(spark, name, monkeypatch):
    """entries with equal keys, packages and projects that are null; then with some projects numbered across tasks."""
    given = Given(spark, EVEN)
    wanted, got = queried(name, given)
    assert got == wanted and sum(got.values()) > 100
    monkeypatch.setattr(skew, "HEAVY", 2)
    assert sorted(skew.heavy_keys(given.listed, "project_id")) == [1, 2]
    assert queried(name, given)[1] == wanted
    monkeypatch.setattr(skew, "HEAVY", 1)
    assert None in skew.heavy_keys(given.listed, "project_id")
    assert queried(name, given)[1] == wanted


@pytest.mark.parametrize("name", ["snk_04", "snk_04_text"])
def test_entries_with_equal_keys_and_other_numbers_of_lines(spark, name):
    """They take turns, line by line; which of them is first is open."""
    wanted, got = queried(name, Given(spark, UNEVEN))
    without = lambda rows, i: Counter({k[:i] + k[i + 1 :]: n for k, n in rows.items()}) if i == 2 else Counter(k[2] for k in rows.elements())
    assert without(got, 2).keys() == without(wanted, 2).keys() and without(got, 1) == without(wanted, 1)
    of_group = lambda rows: sorted((n, line) for _, n, line in rows.elements() if line.startswith(("###", "•")))
    assert of_group(got) == of_group(wanted)


@pytest.mark.parametrize("name", ["snk_04", "snk_04_text"])
def test_nothing_is_written_down(spark, name, monkeypatch):
    """three checkpoints of the keys and a shuffle and sort of all lines filled the disk, and each part audited all entries anew."""
    written = []
    for module in (skew, report):
        monkeypatch.setattr(module, "durable", lambda df: written.append(df.columns) or df)
    plan = getattr(report_queries, name)(Given(spark, EVEN))._jdf.queryExecution().executedPlan().toString()
    assert written == [] and plan.count("Exchange ") == 1 and plan.count("Scan ") == 1


def test_lines_are_found_from_their_ends():
    """texts were folded word by word in lambdas, which took most of the time of the printed form."""
    texts = ["", "a", "re-auditar uno-2 ab-c-de a--b", "x" * 30 + " y", " a", "a\tb", "a-b-c-d-e-f-g h", "a - -- b-", "palabra\xa0 otra", None, None, "l1\n\nl2 l3"]
    for width in (1, 2, 5, 9, 70):
        plain = [None if t is None else [x for p in t.split("\n") for x in textwrap.wrap(p, width) or [""]] for t in texts]
        got = list(text_report._folded(pa.array(texts), width))
        assert [g for g, t in zip(got, texts) if "\xa0" not in (t or "")] == [p for p, t in zip(plain, texts) if "\xa0" not in (t or "")]
    assert list(text_report._folded(pa.array(["a\xa0 \xa0\xa0 bbb"]), 3)) == [["a\xa0", "\xa0\xa0", "bbb"]]


def test_wrapping_is_no_fold(spark):
    plan = spark.range(1).select(text_report.wrapped(F.lit("a b"), 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
