"""Places of scan report lines without moving the lines of findings."""

from collections import Counter

import pytest

from partwatch import controls as ctl
from partwatch.operators import conformity, finding_risk
from partwatch.plans import skew
from partwatch.sinks import scan_report as sr

from .test_scan_report import FINDING

ROW = ("R", "Título", "COMPARTIMENTAJE", "alto")


def finding(project, path, line, evidence="e", mitigation="m", reachable=False):
    return (project, *ROW, path, line, evidence, mitigation, None, "CWE-1", reachable, None, None, None, None, None)


FOUND = [
    *[finding("p", f"a{i % 3}.kt", i, "x\ny" if i % 2 else None) for i in range(7)], finding("p", "a0.kt", 0), finding("p", "a0.kt", 0),
    finding("q", None, None, mitigation="m1\nm2"), finding(None, "b.kt", 1), finding(None, "b.kt", 2, reachable=True),
]


def given(spark, rated):
    ids = spark.createDataFrame([("p", None, 3, 5, 1), ("q", "n", None, None, 0), ("none", "n", 1, 1, 0), (None, "n", 1, 1, 0)], "project_id string, name string, files int, bytes long, added int")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    evaluated = conformity.evaluate(
        ids.select("project_id").where("project_id <> 'none'"), rated.select("project_id", "rule_id"), empty("project_id string, rule_id string"), empty("project_id string, global_level string"),
        ctl.controls(spark),
    )
    flows = empty("project_id string, path string, source string, source_line int, sink string, sink_line int, cwe string, kind int")
    evidence = conformity.evidence_text(conformity.evidence_rows(rated, ctl.controls(spark), 5))
    return ids, rated, evaluated, evidence, flows, empty("project_id string, language string, files long"), empty("project_id string, permission string")


@pytest.mark.parametrize("few", [0, 10])
def test_same_places(spark, few, monkeypatch):
    """F8: every line, and every finding with its texts, was written down twice and shuffled twice to be numbered."""
    rated = finding_risk.rate(spark.createDataFrame(FOUND, FINDING))
    counted = lambda df: Counter(tuple(r) for r in df.select("project_id", "n", "line").collect())
    wanted = counted(sr.numbered_lines(sr.scan_report_lines(*given(spark, finding_risk.with_narratives(rated)), disclaimer="D")))
    written = []
    keep = lambda df, durable=skew.durable: written.append(df.columns) or durable(df)
    for module in (skew, sr):
        monkeypatch.setattr(module, "durable", keep)
    monkeypatch.setattr(sr, "FEW", few)
    got = counted(sr.numbered_report(*given(spark, rated), disclaimer="D"))
    assert got == wanted and any(k[0] is None for k in got) and max(n for p, n, _ in got if p == "p") == sum(k[0] == "p" for k in got.elements())
    texts = {"line_no", "description", "plain_explanation", "impact_in_context", "measure", "impact_reasons", "probability_reasons"}
    assert not [c for c in written if texts & set(c)]
