"""All lines of the dependency report against a plain version in Python."""

import json
from collections import defaultdict

from pyspark.sql import functions as F

from partwatch.operators import audit
from partwatch.queries import QUERIES
from partwatch.queries.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
RANK = {"crítico": 4, "alto": 3, "medio": 2, "bajo": 1}


def plain_general(project, rows, o):
    count = lambda f: sum(bool(f(r)) for r in rows)
    text = (
        f"Se auditó el proyecto «app{project}» (versión n/d), con {len(rows)} dependencias declaradas. Del análisis automatizado contra el "
        f"registro npm y la base de vulnerabilidades OSV, {count(lambda r: r['outdated'])} dependencias están desactualizadas "
        f"({count(lambda r: r['gap'] == 'major')} con una versión major de atraso) y {count(lambda r: (r['vuln_count'] or 0) > 0)} presentan CVE "
        f"conocidos. La distribución de riesgo es: {o['critico']} crítico(s), {o['alto']} alto(s), {o['medio']} medio(s) y {o['bajo']} bajo(s). "
        f"El puntaje de riesgo promedio es {o['avg_score']}."
    )
    worst, grave = (count(lambda r: r["legal_level"] == level) for level in ("crítico", "alto"))
    if worst or grave:
        text += (
            f" Adicionalmente, el análisis de cumplimiento detectó hallazgos de riesgo legal: {worst} de nivel gravísimo y {grave} de nivel grave, "
            "asociados al tratamiento de datos personales o a código potencialmente malicioso, evaluados frente a la Ley 21.459 sobre delitos "
            "informáticos."
        )
    return text


def plain_conclusion(rows, o):
    text = (
        f"Recomendación sobre el inventario de software: {o['verdict']}. Este resultado corresponde a la revisión del inventario de dependencias "
        "(versiones, vulnerabilidades y cumplimiento) y constituye un insumo para la evaluación final de QA, no su veredicto único. "
    )
    legal = [r["package"] for r in rows if r["legal_level"] is not None][:6]
    if o["compliance_critico"] or o["compliance_alto"]:
        text += (
            f"Se identificaron riesgos LEGALES que deberían resolverse antes de avanzar: {', '.join(legal)}. Conforme a la Ley 21.459, el uso de "
            "paquetes que traten datos de fuentes ilícitas (Art. 6, receptación de datos informáticos) o de código malicioso (Arts. 1, 2, 4, 7 y 8) "
            "podría acarrear responsabilidad; se recomienda revisión del área legal/cumplimiento y, de no acreditarse la licitud de las fuentes, no "
            "utilizar dichas dependencias. "
        )
    first = [r["package"] for r in rows if RANK.get(r["level"], 0) >= 3][:5]
    if first:
        text += f"Atención técnica prioritaria a: {', '.join(first)}. "
    if o["verdict_level"] in ("crítico", "alto"):
        return text + (
            "Se recomienda remediar las vulnerabilidades de severidad alta/crítica y los hallazgos legales, y re-auditar, antes de considerar el "
            "inventario apto."
        )
    if o["verdict_level"] == "medio":
        return text + (
            "El inventario puede considerarse con observaciones; conviene planificar la actualización de las dependencias con atraso major en el "
            "corto plazo."
        )
    return text + "No se observan bloqueantes en el inventario; mantener el monitoreo periódico de dependencias."


def plain_report(project, rows, o):
    entry = lambda r: "|".join([r["section"], json.dumps({"ord": r["ord"]}, separators=(",", ":")), r["spec"] or ""])
    by_place = sorted(rows, key=lambda r: (-RANK.get(r["level"], 0), -r["score"], r["package"], tuple(r["ord"].values())))
    rows = sorted(rows, key=lambda r: (-RANK.get(r["level"], 0), -r["score"], r["package"], entry(r)))
    out = [
        "# Informe de inventario de software",
        f"**Recomendación sobre el inventario:** {o['verdict']}  ·  **Riesgo promedio:** {o['avg_score']}",
        "| Crítico | Alto | Medio | Bajo | OK |",
        f"| {o['critico']} | {o['alto']} | {o['medio']} | {o['bajo']} | {o['ok']} |",
        "## Análisis General", plain_general(project, rows, o), "## Análisis Técnico",
    ]
    for r in rows:
        out += [
            f"### {r['package']} `{r['installed'] or '—'}` — {r['severity_label']}",
            f"- **Sección:** {r['section']} · **Última npm:** {r['latest'] or 'n/d'} · **Atraso:** {r['gap'] or 'al día'}",
            "- **Riesgos conocidos:**", *[f"    - {x}" for x in r["known_risks"]], f"- **Precisión técnica:** {r['technical_precision']}",
            "- **Medidas de mitigación recomendadas:**", *[f"    - {x}" for x in r["mitigations"]],
        ]
    for r in rows:
        if c := r["compliance"]:
            out += [f"### ⚖ {r['package']} — nivel {c['nivel'].upper()} ({c['categoria']})", c["rationale"]]
            out += [f"- **{a['art']}** — {a['texto']}" for a in c["articulos"]]
            out += [f"**Recomendación:** {c['recomendacion']}", c["disclaimer"]]
    return [*out, "## Conclusión General", plain_conclusion(by_place, o)]


def test_every_line(spark):
    t = Fixtures(spark, SF)
    rows = [r.asDict(recursive=True) for r in audit.with_report_texts(t.listed).collect()]
    overall = {r.project_id: r.asDict() for r in audit.risk_distribution(t.listed).collect()}
    by_project = defaultdict(list)
    for r in rows:
        by_project[r["project_id"]].append(r)
    expected = {(p, n, line) for p, own in by_project.items() for n, line in enumerate(plain_report(p, own, overall[p]), 1)}
    result = QUERIES["snk_04_whole_report_lines"](spark, SF)
    got = [tuple(r) for r in result.select("project_id", "n", "line").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert result.where(F.col("line").startswith("### ⚖")).count() > 0
