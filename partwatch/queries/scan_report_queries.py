"""The scan report, every line at its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import controls as ctl
from .. import narratives
from ..functions import source_text as st
from ..operators import conformity, finding_risk
from ..sinks import scan_report as sr
from .catalog_queries import values
from .conformity_queries import COUNTS, NARRATIVE_SQL, REACHABLE, evaluated, project_findings, rated
from .registry import query, view
from .report_queries import filled, quoted

NOTE = "Insumo; no es dictamen."


def texts(*lines: str) -> str:
    return "[" + ", ".join(quoted(x) for x in lines) + "]"


def told(mapping: dict[str, str], column: str, default: str) -> str:
    return f"coalesce((SELECT text FROM ({values(mapping.items())}) t(told_id, text) WHERE t.told_id = {column}), {default})"


view("v_told", NARRATIVE_SQL.replace("SELECT ord,", "SELECT r.*,").replace("FROM v_risk", "FROM v_risk r").replace(",\n  role FROM", " FROM"))
view(
    "v_explained",
    f"""
SELECT *, (['muy bajo', 'bajo', 'medio', 'alto', 'muy alto'])[impact] AS impact_key, {told(narratives.WHAT, "rule_id", "lower(title)")} AS what,
  {told(narratives.PLAIN, "rule_id", quoted(narratives.PLAIN_DEFAULT))} AS plain, {told(narratives.NEGLECT, "rule_id", quoted(narratives.NEGLECT_DEFAULT))} AS neglect,
  array_to_string(list_filter([
    CASE WHEN exposure_weight >= 1 THEN 'el hallazgo reside en código de producción, alcanzable en operación real'
      ELSE 'el hallazgo reside en código de prueba/ejemplo, lo que reduce la probabilidad de un impacto real en producción' END,
    CASE WHEN category = 'COMPARTIMENTAJE' AND raw >= 4 THEN 'la alta entropía del literal (' || printf('%.1f', raw) || ' bits) sugiere un secreto real' END,
    CASE WHEN reachable THEN 'el análisis de flujo de datos detectó una ruta explotable: una entrada externa (línea ?) alcanza el sumidero de operación sensible (línea ?)' END,
    CASE WHEN rule_id IN ({REACHABLE}) THEN 'el defecto es alcanzable desde fuera de la aplicación o afecta su configuración global, por lo que un tercero podría desencadenarlo sin acceso privilegiado' END,
    CASE WHEN hotspot THEN 'el archivo concentra múltiples hallazgos (punto caliente), lo que aumenta la probabilidad de que al menos uno sea explotable y facilita el encadenamiento' END,
    CASE WHEN rule_id = 'LIC-MISSING' THEN 'no constituye una vía de explotación activa, sino una brecha de gobernanza del proyecto' END,
    CASE WHEN rule_id = 'PII-RUT' THEN 'no es una vulnerabilidad explotable en sí, sino una señal que obliga a revisar el tratamiento del dato' END], lambda x: x IS NOT NULL), '; ') || '.' AS why
FROM v_told""",
)
PLACE = "score DESC, path, line NULLS FIRST, rule_id, evidence, risk_value"
view("v_reported", f"SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {PLACE}) AS number FROM v_explained")
view(
    "v_report_flows",
    "SELECT DISTINCT project_id, path, line AS source_line, line + 1 AS sink_line FROM v_risk WHERE reachable AND line IS NOT NULL",
)
view(
    "v_full_controls",
    f"SELECT * FROM ({values((c.id, c.title, c.demand, c.documents or '') for c in ctl.CONTROLS)}) t(control_id, title, demand, documents)",
)
view(
    "v_ordered_controls",
    """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE state WHEN 'no_cumple' THEN 3 WHEN 'observado' THEN 2 WHEN 'no_evaluable' THEN 1 ELSE 0 END DESC, instrument, reference, control_id) AS place
FROM v_evaluated JOIN v_full_controls USING (control_id)""",
)
CELLS = "concat(' | ', coalesce(cumple, 0), ' | ', coalesce(no_cumple, 0), ' | ', coalesce(observado, 0), ' | ', coalesce(no_evaluable, 0), ' |')"


def counted(column: str, order: str) -> str:
    return f"(SELECT project_id, string_agg({column} || ': ' || n, ', ' ORDER BY {order}, {column}) AS text FROM (SELECT project_id, {column}, count(*) AS n FROM v_risk GROUP BY ALL) GROUP BY 1)"


SEVERITY_ORDER = "CASE severity WHEN 'crítico' THEN 0 WHEN 'alto' THEN 1 WHEN 'medio' THEN 2 WHEN 'bajo' THEN 3 ELSE 4 END"
INSTRUMENT_ROWS = values((n, i[0], i[1]) for n, i in enumerate(ctl.INSTRUMENTS))
FUNCTION_ROWS = values((n, f) for n, f in enumerate(ctl.FUNCTIONS))
REFERENCES = [f"- **{i[0]}** — {i[1]} ({i[2]}, {i[3]}). {i[4]}" for i in ctl.INSTRUMENTS]
PROJECTS = "(SELECT DISTINCT project_id FROM v_risk)"
view(
    "v_scan_parts",
    f"""
SELECT project_id, 0 AS part, 0 AS item, list_concat({texts(sr.TITLE, sr.SUBTITLE, "")}, ['**Artefacto analizado:** ' || project_id || '.zip  ·  12 archivos  ·  2.5 MB', '**Generado por:** QA  ·  **Fecha y hora:** 2024-05-01 10:00'],
  {texts(sr.CLASSIFIED, "", sr.FRAME, "", sr.SCOPE, "", sr.SUMMARY_HEAD, "")}) AS lines FROM {PROJECTS}
UNION ALL SELECT project_id, 1, 0, [summary, ''] FROM v_executive
UNION ALL SELECT project_id, 2, 0, [{filled(sr.VERDICT.replace("%%", "%\x02").replace("%s", "%s"), "verdict", "cast(conformity_pct AS DOUBLE)", "detail").replace("%\x02", "%")}, ''] FROM (SELECT *, CASE
    WHEN verdict = 'CONFORME' THEN {quoted(conformity.VERDICT_DETAIL["CONFORME"])} WHEN verdict = 'NO CONFORME' THEN {quoted(conformity.VERDICT_DETAIL["NO CONFORME"])}
    WHEN no_cumple > 0 THEN {quoted(conformity.VERDICT_DETAIL["MENOR"])} ELSE {quoted(conformity.VERDICT_DETAIL["OBSERVADO"])} END AS detail FROM v_verdict)
UNION ALL SELECT project_id, 10, 0, list_concat({texts(sr.CONFORMITY_HEAD, "")}, [{filled(sr.ASSESSED.replace("%d", "%s"), "cumple + no_cumple + observado + no_evaluable", "cumple", "no_cumple", "observado", "no_evaluable")}],
  {texts("", *sr.MATRIX_HEAD)}) FROM v_verdict
UNION ALL SELECT p.project_id, 11, n, ['| ' || i.instrument || ' — ' || i.name || {CELLS}] FROM {PROJECTS} p CROSS JOIN ({INSTRUMENT_ROWS}) i(n, instrument, name)
  LEFT JOIN (SELECT project_id, instrument, {COUNTS} FROM v_evaluated GROUP BY 1, 2) m ON m.project_id = p.project_id AND m.instrument = i.instrument
UNION ALL SELECT project_id, 12, 0, [''] FROM {PROJECTS}
UNION ALL SELECT DISTINCT project_id, 13, 0, {texts(*sr.FUNCTION_HEAD)} FROM v_evaluated WHERE domain IN ({", ".join(quoted(f) for f in ctl.FUNCTIONS)})
UNION ALL SELECT project_id, 14, n, ['| ' || domain || {CELLS}] FROM (SELECT project_id, domain, {COUNTS} FROM v_evaluated GROUP BY 1, 2) JOIN ({FUNCTION_ROWS}) f(n, domain) USING (domain)
UNION ALL SELECT DISTINCT project_id, 15, 0, [''] FROM v_evaluated WHERE domain IN ({", ".join(quoted(f) for f in ctl.FUNCTIONS)})
UNION ALL SELECT DISTINCT project_id, 16, 0, {texts(*sr.NOT_MET_HEAD)} FROM v_evaluated WHERE state = 'no_cumple'
UNION ALL SELECT o.project_id, 17, place, list_filter([concat('- **', instrument, ' ', reference, ' — ', title, '** _(severidad ', raw_severity, ')_'), '  - Exigencia: ' || demand,
    '  - Evidencia (' || n_findings || '): ' || e.evidence], lambda x: x IS NOT NULL) FROM v_ordered_controls o LEFT JOIN (
      SELECT project_id, control_id, string_agg(concat('`', rule_id, '` en ', regexp_extract(path, '[^/]*$'), CASE WHEN line IS NULL THEN '' ELSE ':' || line END), '; ' ORDER BY pos) AS evidence
      FROM v_evidence WHERE pos <= 5 GROUP BY 1, 2) e USING (project_id, control_id) WHERE state = 'no_cumple'
UNION ALL SELECT DISTINCT project_id, 18, 0, [''] FROM v_evaluated WHERE state = 'no_cumple'
UNION ALL SELECT DISTINCT project_id, 19, 0, {texts(*sr.NOT_ASSESSABLE_HEAD)} FROM v_evaluated WHERE state = 'no_evaluable'
UNION ALL SELECT project_id, 20, place, [concat('- **', instrument, ' ', reference, ' — ', title, '.**', CASE WHEN documents <> '' THEN ' Evidencia esperada: ' || documents ELSE '' END)]
  FROM v_ordered_controls WHERE state = 'no_evaluable'
UNION ALL SELECT DISTINCT project_id, 21, 0, [''] FROM v_evaluated WHERE state = 'no_evaluable'
UNION ALL SELECT p.project_id, 30, 0, list_filter(['## 3. Panorama técnico del análisis estático', '',
    concat('- Total de observaciones: **', t.n, '**  ·  nivel de riesgo agregado: **', t.global_level, '**'), '- Por severidad: ' || s.text, '- Por ámbito: ' || c.text, '- Lenguajes: Kotlin (' || t.paths || ')',
    '- Componentes integrados al inventario de software: **3**', '- Permisos Android declarados (' || len(t.permissions) || '): ' || array_to_string(t.permissions, ', '),
    '- Puntos calientes (archivos con múltiples hallazgos): ' || h.text, '- Motores de análisis (hallazgos por motor): interno: ' || t.n,
    '- Rutas de flujo de datos no confiable detectadas (fuente → sumidero): **' || f.n || '**'], lambda x: x IS NOT NULL) FROM {PROJECTS} p
  JOIN (SELECT project_id, count(*) AS n, count(DISTINCT path) AS paths, list_sort(list(DISTINCT 'P' || ord % 3)) AS permissions,
      CASE max(risk_rank) WHEN 5 THEN 'crítico' WHEN 4 THEN 'alto' WHEN 3 THEN 'medio' ELSE 'bajo' END AS global_level FROM v_risk GROUP BY 1) t USING (project_id)
  JOIN {counted("severity", SEVERITY_ORDER)} s USING (project_id) JOIN {counted("category", "n DESC")} c USING (project_id)
  LEFT JOIN (SELECT project_id, string_agg(regexp_extract(path, '[^/]*$') || ' (' || rules || ')', '; ' ORDER BY r) AS text FROM (
      SELECT project_id, path, count(DISTINCT rule_id) AS rules, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, path) AS r FROM v_risk GROUP BY 1, 2 HAVING count(*) >= 2)
    WHERE r <= 6 GROUP BY 1) h USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM v_report_flows GROUP BY 1) f USING (project_id)
UNION ALL SELECT project_id, 31, r, [concat('  - ', regexp_extract(path, '[^/]*$'), ': entrada (L', source_line, ') → consulta SQL (L', sink_line, ') · CWE-89')]
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, sink_line) AS r FROM v_report_flows) WHERE r <= 6
UNION ALL SELECT project_id, 32, 0, [''] FROM {PROJECTS}
UNION ALL SELECT project_id, 40, 0, {texts(*sr.DETAIL_HEAD)} FROM {PROJECTS}
UNION ALL SELECT project_id, 41, number, [concat('### 4.', number, ' [', risk_level, '] ', title, '  (`', rule_id, '`', CASE WHEN cwe <> '' THEN ' · ' || cwe ELSE '' END, ')'), '',
    concat('**Descripción (contexto detectado).** En este artefacto, ', what, '. Se detectó en ', path, CASE WHEN line IS NULL THEN '' ELSE ', línea ' || line END, ', archivo cuyo rol es la ', role,
      '. La evidencia capturada en contexto confirma el patrón sobre la línea señalada.'), '', '**Qué significa, en simple.** ' || plain, '',
    concat('**Ubicación.** `', path, CASE WHEN line IS NULL THEN '' ELSE ':' || line END, '` · rol del archivo: — · exposición: ', exposure), '', '**Procedencia y verificación.** motor: interno.', '',
    concat('**Evidencia (extracto).** `', evidence, '`'), '', concat('**Cálculo del nivel de riesgo.** Severidad intrínseca de la regla: ', severity, '.'),
    concat('- Impacto: **', (SELECT text FROM ({values(finding_risk.SCALE.items())}) s(n, text) WHERE s.n = impact), '** (', impact, '/5). ', impact_reasons),
    concat('- Probabilidad: **', (SELECT text FROM ({values(finding_risk.SCALE.items())}) s(n, text) WHERE s.n = probability), '** (', probability, '/5). ', why),
    concat('- Resultado: ', impact, ' × ', probability, ' = ', risk_value, ' → nivel de riesgo **', risk_level, '**.'), '',
    concat('**Impacto en el contexto del código.** Dado que el archivo participa en la ', role, ', ', neglect), '', '**Mitigación puntual.** ' || measure, ''] FROM v_reported
UNION ALL SELECT project_id, 50, 0, {texts(sr.INSTRUMENT_HEAD, "", *REFERENCES, "")} FROM {PROJECTS}
UNION ALL SELECT project_id, 60, 0, {texts(*sr.ANNEX)} FROM {PROJECTS}
UNION ALL SELECT project_id, 70, 0, ['> {NOTE}', ''] FROM {PROJECTS}""",
)


@query(
    "snk_04_scan_lines",
    """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY part, item, line_no) AS n, line
FROM (SELECT *, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM v_scan_parts)""",
)
def snk_04_scan(t):
    """Every line of every scan report. Flows and permissions are read off the findings."""
    found = rated(t)
    ids = t.findings.select("project_id").distinct()
    projects = ids.select("project_id", F.concat("project_id", F.lit(".zip")).alias("name"), F.lit(12).alias("files"), F.lit(2_621_440).alias("bytes"), F.lit(3).alias("added"))
    flows = t.findings.where("reachable AND line IS NOT NULL").select(
        "project_id", "path", F.lit("entrada").alias("source"), F.col("line").alias("source_line"), F.lit("consulta SQL").alias("sink"),
        (F.col("line") + 1).alias("sink_line"), F.lit("CWE-89").alias("cwe"), F.lit(0).alias("kind"),
    ).distinct()
    files = t.findings.select("project_id", "path").distinct()
    languages = files.select("project_id", st.language(F.col("path")).alias("language")).groupBy("project_id", "language").agg(F.count("*").alias("files"))
    permissions = t.findings.select("project_id", F.concat(F.lit("android.permission.P"), F.col("ord") % 3).alias("permission")).distinct()
    evidence = conformity.evidence_text(conformity.evidence_rows(project_findings(t), ctl.controls(t.spark), 8))
    return sr.numbered_report(projects, found, evaluated(t), evidence, flows, languages, permissions, "QA", "2024-05-01 10:00", NOTE)
