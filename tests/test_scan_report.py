"""Parts of the scan report that the registered query has no rows for: context, flows, several engines, projects without findings."""

from pyspark.sql import functions as F

from partwatch import controls as ctl
from partwatch.operators import conformity, finding_risk
from partwatch.sinks import scan_report as sr

FINDING = (
    "project_id string, rule_id string, title string, category string, severity string, path string, line int, evidence string, mitigation string, engine string, cwe string, reachable boolean, "
    "corroborated_by array<string>, secret_probability double, controls array<string>, "
    "flow struct<source:string,source_line:int,name:string,sink:string,sink_line:int>, "
    "context struct<role:string,construct:string,fragment:array<struct<n:int,text:string,is_hit:boolean>>>"
)


def report(spark, findings, projects):
    rated = finding_risk.with_narratives(finding_risk.rate(spark.createDataFrame(findings, FINDING)))
    ids = spark.createDataFrame([(p,) for p in projects], "project_id string")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    shown = ids.select("project_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("files"), F.lit(1_600_000).alias("bytes"), F.lit(0).alias("added"))
    evaluated = conformity.evaluate(
        ids.where("project_id <> 'bare'"), rated.select("project_id", "rule_id"), empty("project_id string, rule_id string"), empty("project_id string, global_level string"), ctl.controls(spark)
    )
    flows = empty("project_id string, path string, source string, source_line int, sink string, sink_line int, cwe string, kind int")
    evidence = conformity.evidence_text(conformity.evidence_rows(rated, ctl.controls(spark), 5))
    lines = sr.scan_report_lines(
        shown, rated, evaluated, evidence, flows, empty("project_id string, language string, files long"), empty("project_id string, permission string"), disclaimer="D"
    )
    out = {p: [] for p in projects}
    for r in sr.numbered_lines(lines).orderBy("project_id", "n").collect():
        out[r.project_id].append(r.line)
        assert r.n == len(out[r.project_id])
    return out


def test_context_flow_and_engines(spark):
    common = ("p", "SEC-PASSWORD", "Clave", "COMPARTIMENTAJE", "alto", "app/A.kt", 3, "k = \"x\"", "m", "semgrep", "CWE-798")
    full = (*common, True, ["bandit", "trivy"], 0.1, ["C-1", "C-2"], ("entrada", 1, "v", "registro", 3), ("rol", "fun f", [(2, "a\tb", False), (3, "k", True), (1_234, "z", False)]))
    bare = ("p", "OTHER", "Cosa", "X", "info", "b.md", None, None, "m2", None, None, None, None, None, None, None, None)
    lines = report(spark, [full, bare], ["p"])["p"]
    at = lines.index("### 4.1 [Alto] Clave  (`SEC-PASSWORD` · CWE-798)")
    body = lines[at:]
    assert body[6] == "**Ubicación.** `app/A.kt:3` · rol del archivo: rol · fun f · exposición: producción"
    assert body[8] == "**Procedencia y verificación.** motor: semgrep; corroborado por: bandit, trivy; verosimilitud de secreto (ML): 10% — posible falso positivo."
    assert body[10].startswith("**Explotabilidad (flujo de datos).** Ruta detectada: entrada (línea 1) → registro (línea 3), a través de la variable «v».")
    assert body[12:20] == ["**Evidencia en contexto.**", "", "```", "     2 | a\tb", ">    3 | k", "  1234 | z", "```", ""]
    assert "_Trazabilidad de cumplimiento (ver sección 2): C-1, C-2._" in body
    second = body[body.index("### 4.2 [Informativo] Cosa  (`OTHER`)"):]
    assert "**Evidencia (extracto).** ``" in second and "**Ubicación.** `b.md` · rol del archivo: — · exposición: prueba/ejemplo" in second
    assert "- Hallazgos corroborados por más de un motor: **1** (mayor confianza)" in lines
    assert "- Por severidad: alto: 1, info: 1" in lines and "- Lenguajes: —" in lines
    assert any(x.startswith("  - Evidencia (1): `SEC-PASSWORD` en A.kt:3") for x in lines)
    assert lines[-2:] == ["> D", ""]


def test_projects_without_findings_or_controls(spark):
    out = report(spark, [], ["clean", "bare"])
    assert "- Total de observaciones: **0**  ·  nivel de riesgo agregado: **—**" in out["clean"]
    assert "## 2. Conformidad con el marco normativo" in out["clean"] and "## 2. Conformidad con el marco normativo" not in out["bare"]
    assert out["bare"][3] == "**Artefacto analizado:** (s/d)  ·  ? archivos  ·  1.5 MB"
    assert "## 5. Marco normativo de referencia" not in out["bare"] and "## 6. Anexo metodológico" in out["bare"]
