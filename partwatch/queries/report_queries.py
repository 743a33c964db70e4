"""Queries of the dependency reports: CSV, JSON, Markdown lines, text lines and the texts in them, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compliance import ARTICLES, DISCLAIMER, LEVEL_OF_CATEGORY, RATIONALE, RECOMMENDATION
from ..operators import audit
from ..plans import skew
from ..sinks import report, text_report
from .registry import query, view


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, *values: str) -> str:
    """A text with ``%s`` as SQL."""
    parts = template.split("%s")
    out = [quoted(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [value, quoted(rest)]
    return " || ".join(out)


def by_category(values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quoted(LEVEL_OF_CATEGORY[name])} THEN {value}" for name, value in values.items())
    return f"CASE legal_level {cases} END"


RATIONALE_SQL = by_category(
    {n: filled(t, "package", "coalesce(malware_id, 'None')") if t.count("%s") == 2 else filled(t, "package") for n, t in RATIONALE.items()}
)
ARTICLES_SQL = by_category(
    {n: "[" + ", ".join(f"{{'art': {quoted(a)}, 'texto': {quoted(x)}}}" for a, x in rows) + "]" for n, rows in ARTICLES.items()}
)

view(
    "v_general",
    """
SELECT s.project_id, concat('Se auditó el proyecto «app', s.project_id, '» (versión n/d), con ', s.total, ' dependencias declaradas. Del análisis automatizado contra el registro npm y la base de vulnerabilidades OSV, ',
  s.outdated, ' dependencias están desactualizadas (', s.major_behind, ' con una versión major de atraso) y ', s.vulnerable, ' presentan CVE conocidos. La distribución de riesgo es: ',
  o.critico, ' crítico(s), ', o.alto, ' alto(s), ', o.medio, ' medio(s) y ', o.bajo, ' bajo(s). El puntaje de riesgo promedio es ', o.avg_score, '.',
  CASE WHEN s.compliance_critico > 0 OR s.compliance_alto > 0 THEN concat(' Adicionalmente, el análisis de cumplimiento detectó hallazgos de riesgo legal: ', s.compliance_critico, ' de nivel gravísimo y ',
    s.compliance_alto, ' de nivel grave, asociados al tratamiento de datos personales o a código potencialmente malicioso, evaluados frente a la Ley 21.459 sobre delitos informáticos.') ELSE '' END) AS general
FROM v_summary s JOIN v_overall o USING (project_id)""",
)
view(
    "v_named",
    """
SELECT project_id, array_to_string(list(package ORDER BY p1) FILTER (WHERE rank >= 3 AND p1 <= 5), ', ') AS priority,
  array_to_string(list(package ORDER BY p2) FILTER (WHERE legal_level IS NOT NULL AND p2 <= 6), ', ') AS legal
FROM v_priority GROUP BY 1""",
)
view(
    "v_conclusion",
    """
SELECT project_id, concat('Recomendación sobre el inventario de software: ', verdict, '. Este resultado corresponde a la revisión del inventario de dependencias (versiones, vulnerabilidades y cumplimiento) y constituye un insumo para la evaluación final de QA, no su veredicto único. ',
  CASE WHEN compliance_critico > 0 OR compliance_alto > 0 THEN concat('Se identificaron riesgos LEGALES que deberían resolverse antes de avanzar: ', coalesce(legal, ''),
    '. Conforme a la Ley 21.459, el uso de paquetes que traten datos de fuentes ilícitas (Art. 6, receptación de datos informáticos) o de código malicioso (Arts. 1, 2, 4, 7 y 8) podría acarrear responsabilidad; se recomienda revisión del área legal/cumplimiento y, de no acreditarse la licitud de las fuentes, no utilizar dichas dependencias. ') ELSE '' END,
  CASE WHEN priority <> '' THEN concat('Atención técnica prioritaria a: ', priority, '. ') ELSE '' END,
  CASE verdict_level WHEN 'crítico' THEN bad WHEN 'alto' THEN bad
    WHEN 'medio' THEN 'El inventario puede considerarse con observaciones; conviene planificar la actualización de las dependencias con atraso major en el corto plazo.'
    ELSE 'No se observan bloqueantes en el inventario; mantener el monitoreo periódico de dependencias.' END) AS conclusion
FROM (SELECT *, 'Se recomienda remediar las vulnerabilidades de severidad alta/crítica y los hallazgos legales, y re-auditar, antes de considerar el inventario apto.' AS bad FROM v_recommended)
LEFT JOIN v_named USING (project_id)""",
)
view(
    "v_items",
    f"""
SELECT r.*, l.label, p.precision_text, section || '|{{"ord":{{"l_linenumber":' || o1 || ',"l_partkey":' || o2 || ',"l_suppkey":' || o3 || '}}}}|' || spec AS entry,
  'https://www.npmjs.com/package/' || package AS npm_url, {ARTICLES_SQL} AS articles, {by_category({n: quoted(t) for n, t in RECOMMENDATION.items()})} AS advice,
  {by_category({n: quoted(n) for n in LEVEL_OF_CATEGORY})} AS legal_category, {RATIONALE_SQL} AS rationale
FROM v_risks r JOIN v_precision p USING (project_id, package, section, spec, o1, o2, o3)
JOIN (SELECT level AS lv, severity AS sv, legal_level AS ll, any_value(label) AS label FROM v_labels GROUP BY ALL) l
  ON l.lv = r.level AND l.sv IS NOT DISTINCT FROM r.severity AND l.ll IS NOT DISTINCT FROM r.legal_level""",
)
view(
    "v_item_texts",
    """
SELECT *, CASE WHEN body = '' THEN ['Sin riesgos conocidos detectados.']
    ELSE list_transform(string_split(rtrim(body, ';'), ';'), lambda x: CASE WHEN x = '⚖' THEN '⚖ RIESGO LEGAL/CUMPLIMIENTO: ' || rationale ELSE x END) END AS risks,
  CASE WHEN measures = '' THEN ['Mantener monitoreo; sin acción inmediata requerida.']
    ELSE list_transform(string_split(rtrim(measures, ';'), ';'), lambda x: CASE WHEN x = '⚖' THEN '⚖ ' || advice ELSE x END) END AS steps
FROM v_items""",
)
# Lines of a report: the place keys, the list of lines of that place.
view(
    "v_markdown_parts",
    f"""
SELECT project_id, 0 AS part, 0 AS rank, 0.0 AS score, '' AS package, '' AS entry, ['# Informe de inventario de software',
  '**Recomendación sobre el inventario:** ' || verdict || '  ·  **Riesgo promedio:** ' || avg_score, '| Crítico | Alto | Medio | Bajo | OK |',
  concat('| ', critico, ' | ', alto, ' | ', medio, ' | ', bajo, ' | ', ok, ' |')] AS lines FROM v_recommended
UNION ALL SELECT project_id, 1, 0, 0.0, '', '', ['## Análisis General', general, '## Análisis Técnico'] FROM v_general
UNION ALL SELECT project_id, 2, rank, score, package, entry, list_concat(['### ' || package || ' `' || coalesce(installed, '—') || '` — ' || label,
  '- **Sección:** ' || section || ' · **Última npm:** ' || coalesce(latest, 'n/d') || ' · **Atraso:** ' || coalesce(gap, 'al día'), '- **Riesgos conocidos:**'],
  list_transform(risks, lambda x: '    - ' || x), ['- **Precisión técnica:** ' || precision_text, '- **Medidas de mitigación recomendadas:**'], list_transform(steps, lambda x: '    - ' || x)) FROM v_item_texts
UNION ALL SELECT project_id, 3, rank, score, package, entry, list_concat(['### ⚖ ' || package || ' — nivel ' || upper(legal_level) || ' (' || legal_category || ')', rationale],
  list_transform(articles, lambda a: '- **' || a.art || '** — ' || a.texto), ['**Recomendación:** ' || advice, {quoted(DISCLAIMER)}]) FROM v_item_texts WHERE legal_level IS NOT NULL
UNION ALL SELECT project_id, 4, 0, 0.0, '', '', ['## Conclusión General', conclusion] FROM v_conclusion""",
)


def placed_lines(parts: str) -> str:
    return f"""
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY part, rank DESC, score DESC, package, entry, line_no) AS n, line
FROM (SELECT *, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM {parts})"""


def joined(t, rated=None):
    rated = t.listed if rated is None else rated
    overall = audit.risk_distribution(rated)
    summary = audit.npm_summary(rated).join(overall.drop("compliance_critico", "compliance_alto"), "project_id")
    projects = summary.select("*", F.concat(F.lit("app"), "project_id").alias("app_name"), F.lit(None).cast("string").alias("app_version"))
    return audit.with_report_texts(rated), projects, overall, report.general_text(projects), report.conclusion_text(overall, rated)


def by_size(t, form, of_large):
    """Projects that fit into a task are numbered there; others by keys that are put in order across tasks. The declarations tell them apart."""
    large = skew.heavy_keys(t.declared, "project_id")
    lines = report.numbered_reports(skew.with_key(t.listed, "project_id", large, False), form)
    return lines.unionByName(of_large(skew.with_key(t.listed, "project_id", large, True))) if large else lines


@query("snk_04_report_lines", placed_lines("v_markdown_parts"))
def snk_04(t):
    """Every line of every report at its place."""

    def of_large(rated):
        rows, _, overall, general, conclusion = joined(t, rated)
        return report.numbered(report.report_parts(rows, overall, general, conclusion))

    return by_size(t, report.markdown_form(), of_large)


@query("snk_04_whole_report_lines", placed_lines("v_markdown_parts"))
def snk_04_whole(t):
    """The same lines; tests/test_report.py compares them with a plain version, too."""
    return snk_04(t)


# Greedy wrapping of a text without long words, for the statement: a break mark behind hyphens between letters, then a fold over
# the pieces, whose accumulator is the text so far; its last line tells whether a piece still fits.
def wrapped(text: str, width: int) -> str:
    letter = "[\\p{L}_]"
    marked = text
    for _ in range(2):  # twice, as neighbouring matches overlap
        marked = f"regexp_replace({marked}, '({letter}{{2}}-)({letter}-?{letter})', '\\1\x01\\2', 'g')"
    return (
        f"string_split(list_reduce(list_prepend('', regexp_extract_all({marked}, ' *[^ \x01]+')), lambda acc, w: "
        f"CASE WHEN length(string_split(acc, chr(10))[-1]) + length(w) <= {width} THEN acc || w ELSE acc || chr(10) || ltrim(w) END), chr(10))"
    )


view(
    "v_listed_of",
    """
SELECT package, version, list({'id': id, 'severity': coalesce(severity, 'n/d'), 'summary': summary, 'gone': gone, 'number': split_part(osv_id, '-', 2)} ORDER BY pos) AS advisories
FROM (SELECT *, summary = '' AS gone FROM v_listed WHERE pos <= 8) GROUP BY ALL""",
)
view(
    "v_text_parts",
    f"""
SELECT project_id, 0 AS part, 0 AS rank, 0.0 AS score, '' AS package, '' AS entry, list_concat(['{"=" * 70}', '  INFORME DE INVENTARIO DE SOFTWARE — 2024-05-01 10:00', '  Proyecto: app' || project_id || '  vn/d',
  '  Generado por: QA   |   Fecha y hora: 2024-05-01 10:00', concat('  Recomendación sobre el inventario: ', verdict, '   |   Riesgo promedio: ', avg_score),
  '  Insumo para la evaluación final de QA · modelo de riesgo local', '{"=" * 70}', '', 'ANÁLISIS GENERAL', '{"-" * 70}'], {wrapped("general", 70)}, ['', 'ANÁLISIS TÉCNICO', '{"-" * 70}']) AS lines
FROM v_recommended JOIN v_general USING (project_id)
UNION ALL SELECT project_id, 1, rank, score, t.package, entry, list_concat(['', '• ' || t.package || ' ' || coalesce(installed, '') || '  [' || label || ']',
  '    Sección: ' || section || ' | Última npm: ' || coalesce(latest, 'n/d') || ' (s/f) | Atraso: ' || coalesce(gap, 'al día'), '    Desarrollador: ' || coalesce(homepage, npm_url), '    npm: ' || npm_url, '    Riesgos conocidos:'],
  list_transform(risks, lambda x: '      - ' || x),
  flatten(list_transform(CASE WHEN lookable THEN coalesce(advisories, []) ELSE [] END, lambda d: list_concat(['      · ' || d.id || ' (sev. ' || d.severity || ')' || CASE WHEN d.summary <> '' THEN ' - ' || d.summary ELSE '' END],
    CASE WHEN d.gone THEN [] ELSE ['          ref: https://ref/' || d.number || '/1', '          ref: https://ref/' || d.number || '/3', '          ref: https://ref/' || d.number || '/4'] END))),
  ['    Precisión técnica: ' || precision_text, '    Medidas de mitigación recomendadas:'], list_transform(steps, lambda x: '      - ' || x))
  FROM v_item_texts t LEFT JOIN v_listed_of a ON a.package = t.package AND a.version = t.installed
UNION ALL SELECT project_id, 2, 0, 0.0, '', '', [''] FROM v_recommended
UNION ALL SELECT DISTINCT project_id, 3, 0, 0.0, '', '', ['', 'ANÁLISIS DE CUMPLIMIENTO LEGAL (Ley 21.459 / 19.628)', '{"-" * 70}'] FROM v_items WHERE legal_level IS NOT NULL
UNION ALL SELECT project_id, 4, rank, score, package, entry, list_concat(['• ' || package || '  [' || upper(legal_level) || '] — ' || legal_category],
  list_transform({wrapped("rationale", 66)}, lambda x: '    ' || x), ['    Disposiciones legales potencialmente aplicables:'], list_transform(articles, lambda a: '      - ' || a.art || ': ' || a.texto),
  list_transform({wrapped("advice", 60)}, lambda x, i: CASE WHEN i = 1 THEN '    Recomendación: ' ELSE '    ' END || x), ['    ' || {quoted(DISCLAIMER)}, '']) FROM v_items WHERE legal_level IS NOT NULL
UNION ALL SELECT project_id, 5, 0, 0.0, '', '', list_concat(['CONCLUSIÓN GENERAL', '{"-" * 70}'], {wrapped("rtrim(conclusion)", 70)}) FROM v_conclusion""",
)


@query("snk_04_text_lines", placed_lines("v_text_parts"))
def snk_04_text(t):
    """Every line of the printed form."""

    def of_large(rated):
        rows, projects, overall, general, conclusion = joined(t, rated)
        return report.numbered(text_report.text_parts(rows, projects, overall, general, conclusion, "2024-05-01 10:00", "QA"))

    return by_size(t, text_report.text_form("2024-05-01 10:00", "QA"), of_large)


@query(
    "snk_03_report_csv",
    """
SELECT project_id, package AS paquete, section AS seccion, coalesce(installed, '') AS instalada, coalesce(latest, '') AS ultima_npm, '' AS release_ultima, coalesce(gap, 'al día') AS atraso,
  level AS nivel_riesgo, label AS severidad, coalesce(vuln_count, 0) AS cve_count, coalesce(replace(vuln_ids, ', ', ' '), '') AS cve_ids, array_to_string(risks, ' | ') AS riesgos_conocidos,
  precision_text AS precision_tecnica, array_to_string(steps, ' | ') AS mitigaciones, coalesce(homepage, '') AS sitio_oficial, coalesce(repository, '') AS repositorio,
  npm_url, '' AS eol_url, coalesce(legal_level, '') AS cumplimiento_nivel, coalesce(legal_category, '') AS cumplimiento_categoria,
  coalesce(array_to_string(list_transform(articles, lambda a: a.art || ': ' || a.texto), '; '), '') AS cumplimiento_articulos FROM v_item_texts""",
)
def snk_03(t):
    """All columns of the export."""
    return report.report_csv(audit.with_report_texts(t.listed))


@query(
    "snk_05_report_json",
    """
SELECT project_id, package, section, spec, installed, latest, gap, outdated, pinned, note, vuln_status, vuln_count, vuln_ids, severity, level, score, legal_level, npm_url, homepage, description,
  label AS severity_label, precision_text AS technical_precision, array_to_string(risks, '|') AS known_risks, array_to_string(steps, '|') AS mitigations, legal_category AS categoria, rationale
FROM v_item_texts""",
)
def snk_05(t):
    """The documents read back."""
    docs = report.report_json(audit.with_report_texts(t.listed))
    value = F.from_json(
        "json",
        "package string, section string, spec string, installed string, latest string, gap string, outdated boolean, pinned boolean, note string, vuln_status string, vuln_count bigint, "
        "vuln_ids array<string>, severity string, level string, score double, legal_level string, npm_url string, homepage string, description string, severity_label string, "
        "technical_precision string, known_risks array<string>, mitigations array<string>, compliance struct<categoria:string,rationale:string>",
    )
    rows = docs.select("project_id", value.alias("v")).select("project_id", "v.*")
    lists = {"vuln_ids": F.array_join("vuln_ids", ", "), "known_risks": F.array_join("known_risks", "|"), "mitigations": F.array_join("mitigations", "|")}
    return rows.withColumns(lists).select(*[c for c in rows.columns if c != "compliance"], "compliance.categoria", "compliance.rationale")


@query("s_31_project_texts", "SELECT project_id, general, conclusion FROM v_general JOIN v_conclusion USING (project_id)")
def s_31(t):
    _, _, _, general, conclusion = joined(t)
    return general.join(conclusion, "project_id")
