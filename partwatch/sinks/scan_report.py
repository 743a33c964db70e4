"""The scan report as lines (SNK-04): nested sections, matrices and numbered findings of all projects in one table.

Each part of the report is a narrow projection of rows that exist already: controls, matrices, rated findings. A part gives its
section, the place of its item and its lines; nothing is gathered per project but the few counts that stand on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..controls import FUNCTIONS, INSTRUMENTS, STATES
from ..functions.common import lookup
from ..functions.source_text import file_name
from ..operators import conformity, finding_risk
from ..plans.skew import durable, running_totals, top_per_group
from ..rules import SEVERITY_RANK

# Texts of the report.
TITLE = "# Informe de auditoría de cumplimiento y aseguramiento de calidad"
SUBTITLE = "## Análisis estático de seguridad de código (SAST) y conformidad normativa"
CLASSIFIED = "**Clasificación del informe:** Uso interno — insumo para evaluación de QA y auditoría"
FRAME = (
    "**Marco de referencia:** Guía Técnica «Lineamientos para el Desarrollo de Software», División de Gobierno Digital (SEGPRES) v2.0 (2021); "
    "Ley 21.180 de Transformación Digital del Estado y sus normas técnicas (Decretos 7, 9, 10 y 11 de 2023, SEGPRES); DS 83/2004 (seguridad del "
    "documento electrónico); Leyes 19.628, 19.799, 21.096 y 21.459. Referencias técnicas: OWASP MASVS/ASVS y CWE."
)
SCOPE = (
    "> Análisis estático automatizado con apoyo de razonamiento (aprendizaje automático local y, cuando está disponible, modelo de lenguaje). "
    "Constituye un insumo para la evaluación de aseguramiento de calidad y la auditoría de cumplimiento; no es un dictamen jurídico ni una "
    "certificación de conformidad. La evidencia de secretos se presenta enmascarada por el principio de mínima exposición."
)
SUMMARY_HEAD = "## 1. Resumen ejecutivo"
VERDICT = "**Veredicto de cumplimiento normativo:** %s (%s%% de controles evaluables conformes). %s"
CONFORMITY_HEAD = "## 2. Conformidad con el marco normativo"
ASSESSED = (
    "Se evaluaron **%d controles** auditables derivados de la normativa aplicable: **%d conformes**, **%d no conformes**, **%d observados** y **%d no "
    "evaluables por análisis estático** (controles organizacionales que requieren verificación documental)."
)
MATRIX_HEAD = ("### Matriz de conformidad por instrumento", "", "| Instrumento | Cumple | No cumple | Observado | No evaluable |", "|---|---:|---:|---:|---:|")
FUNCTION_HEAD = (
    "### Cobertura por función de ciberseguridad (Decreto 7/2023)", "", "| Función | Cumple | No cumple | Observado | No evaluable |", "|---|---:|---:|---:|---:|",
)
NOT_MET_HEAD = ("### Controles no conformes (requieren remediación)", "")
NOT_ASSESSABLE_HEAD = (
    "### Controles no evaluables por análisis estático", "",
    "Los siguientes controles son de naturaleza organizacional o procedimental y deben acreditarse mediante evidencia documental independiente:", "",
)
TECHNICAL_HEAD = "## 3. Panorama técnico del análisis estático"
DETAIL_HEAD = (
    "## 4. Análisis técnico detallado", "",
    "Esta sección desarrolla cada observación en el contexto real de uso del código (inteligencia local de la herramienta). El nivel de riesgo se "
    "calcula como **impacto × probabilidad**; ambos factores se justifican. El mapeo a la normativa y la ley se trata por separado en la sección 2.", "",
)
FLOW = (
    "**Explotabilidad (flujo de datos).** Ruta detectada: %s (línea %s) → %s (línea %s), a través de la variable «%s». El dato no confiable alcanza la "
    "operación sensible, por lo que la observación se considera potencialmente explotable."
)
INSTRUMENT_HEAD = "## 5. Marco normativo de referencia"
ANNEX = (
    "## 6. Anexo metodológico", "",
    "El análisis se realiza mediante inspección estática de patrones (SAST ligero) sobre el código fuente extraído en un entorno aislado, sin ejecutarlo. "
    "Cada regla mapea a una cláusula de la Guía SEGPRES, la norma legal aplicable, el control normativo auditable y, cuando corresponde, el identificador "
    "CWE. El motor de cumplimiento cruza los hallazgos con un catálogo de controles derivados artículo por artículo de la normativa, emitiendo por control "
    "uno de cuatro estados: cumple, no cumple, observado o no evaluable. Los controles organizacionales se reportan como no evaluables con indicación de "
    "la evidencia documental que los acreditaría.", "",
    "**Análisis avanzado (robustecimiento).** El alcance se refuerza con tres técnicas complementarias: (1) motores SAST de código abierto de la industria "
    "—Semgrep (multi-lenguaje, con reglas locales offline), detect-secrets y Bandit— cuyos hallazgos se normalizan e integran; cuando dos motores coinciden, "
    "el hallazgo se marca como corroborado (mayor confianza). (2) Análisis de flujo de datos (taint) intra-archivo, que rastrea entradas no confiables "
    "(fuentes) hasta operaciones sensibles (sumideros) para identificar rutas potencialmente explotables; esto aproxima el razonamiento de ejecución sin "
    "ejecutar el código. (3) Un clasificador de verosimilitud de secretos (regresión logística) que ajusta la probabilidad y distingue secretos reales de "
    "marcadores de posición.", "",
    "**Sobre las pruebas dinámicas (DAST).** Por seguridad, la herramienta NUNCA ejecuta el código auditado: ejecutar artefactos no confiables expondría al "
    "evaluador. Por ello no se realiza DAST en sentido estricto (ejecución del sistema en marcha); el componente \"dinámico\" se cubre mediante el análisis de "
    "flujo de datos y el razonamiento de rutas de ataque asistido por IA. Para pruebas dinámicas completas (con la aplicación efectivamente desplegada en un "
    "entorno controlado) se recomienda complementar con un proceso de DAST dedicado.", "",
)
DASH = "—"
# How many hot spots and flows one line or list shows.
SHOWN = 6
FINDINGS = 41
# Projects whose places are sent to every task, once they are counted.
FEW = 10_000

KEYS = ("section_no", "item_no", "line_no")


def _part(rows: DataFrame, section: int, lines: Column, item: Column | int = 0) -> DataFrame:
    """Lines of one section, an array for each row."""
    place = (F.lit(item) if isinstance(item, int) else item).cast("long").alias("item_no")
    return rows.select("project_id", F.lit(section).alias("section_no"), place, _single(lines).alias("lines"))


def _single(lines: Column) -> Column:
    """Nulls are left out, and a text with line breaks makes several lines."""
    return F.flatten(F.transform(F.array_compact(lines), lambda x: F.split(x, "\n")))


def _size(lines: Column) -> Column:
    return F.when(lines.isNotNull(), F.size(lines)).otherwise(0).cast("bigint")


def _texts(*lines: str) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def _given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(DASH))


def _listed(rows: DataFrame, name: Column, text: Column, order: list[Column], alias: str, separator: str = ", ") -> DataFrame:
    """One line of a project's few values. ``rows`` has one row per value; values are severities, categories, engines, languages."""
    entries = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], name.alias("_name"), text.alias("_text"))))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(entries, lambda e: e["_text"]), separator).alias(alias))


def _counted(rated: DataFrame, column: str, alias: str, rank: Column | None = None) -> DataFrame:
    counts = rated.groupBy("project_id", F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    name = F.col("_value")
    order = [-F.coalesce(lookup(name, SEVERITY_RANK), F.lit(0)) if rank is not None else -F.col("_n")]
    return _listed(counts, name, F.concat(name, F.lit(": "), F.col("_n")), order, alias)


def _conformity(evaluated: DataFrame, evidence: DataFrame) -> list[DataFrame]:
    c = F.col
    verdicts = conformity.verdict(evaluated)
    total = sum((c(s) for s in STATES), F.lit(0))
    counts = F.format_string(ASSESSED, total, *[c(s) for s in STATES])
    cells = F.concat(*[x for s in STATES for x in (F.lit(" | "), F.coalesce(c(s), F.lit(0)).cast("string"))], F.lit(" |"))
    frame = verdicts.select("project_id", F.posexplode(F.array(*[F.struct(F.lit(i[0]).alias("instrument"), F.lit(i[1]).alias("name")) for i in INSTRUMENTS])).alias("_at", "_i"))
    frame = frame.select("project_id", "_at", "_i.*")
    matrix = frame.join(conformity.instrument_matrix(evaluated), ["project_id", "instrument"], "left")
    covered = conformity.function_matrix(evaluated).where(total > 0).withColumn("_at", F.array_position(_texts(*FUNCTIONS), c("domain")))
    ordered = running_totals(evaluated, ["project_id"], conformity.control_order(), {"_at": F.lit(1).cast("long")}, written=True)
    not_met = conformity.not_met(ordered).join(evidence, ["project_id", "control_id"], "left")
    open_ = conformity.not_assessable(ordered)
    label = F.concat(c("instrument"), F.lit(" "), c("reference"), F.lit(" — "), c("title"))
    shown = F.concat(F.lit("  - Evidencia ("), c("n_findings").cast("string"), F.lit("): "), c("evidence"))
    documents = F.when(_given(c("documents")), F.concat(F.lit(" Evidencia esperada: "), c("documents"))).otherwise("")
    each = lambda rows: rows.select("project_id").distinct()
    blank = _texts("")
    return [
        _part(verdicts, 2, F.array(F.format_string(VERDICT, c("verdict"), c("conformity_pct").cast("string"), c("verdict_detail")), F.lit(""))),
        _part(verdicts, 10, F.concat(_texts(CONFORMITY_HEAD, ""), F.array(counts), _texts("", *MATRIX_HEAD))),
        _part(matrix, 11, F.array(F.concat(F.lit("| "), c("instrument"), F.lit(" — "), c("name"), cells)), c("_at")),
        _part(verdicts, 12, blank),
        _part(each(covered), 13, _texts(*FUNCTION_HEAD)),
        _part(covered, 14, F.array(F.concat(F.lit("| "), c("domain"), cells)), c("_at")),
        _part(each(covered), 15, blank),
        _part(each(not_met), 16, _texts(*NOT_MET_HEAD)),
        _part(
            not_met, 17,
            F.array(F.concat(F.lit("- **"), label, F.lit("** _(severidad "), c("severity"), F.lit(")_")), F.concat(F.lit("  - Exigencia: "), c("demand")), shown),
            c("_at"),
        ),
        _part(each(not_met), 18, blank),
        _part(each(open_), 19, _texts(*NOT_ASSESSABLE_HEAD)),
        _part(open_, 20, F.array(F.concat(F.lit("- **"), label, F.lit(".**"), documents)), c("_at")),
        _part(each(open_), 21, blank),
    ]


def _technical(projects: DataFrame, rated: DataFrame, flows: DataFrame, languages: DataFrame, permissions: DataFrame) -> list[DataFrame]:
    c = F.col
    hot = finding_risk.hotspots(rated, SHOWN).groupBy("project_id", "path", "rank").agg(F.count("*").alias("_rules"))
    totals = rated.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.size("corroborated_by") > 0).alias("confirmed"))
    facts = [
        totals,
        finding_risk.project_risk(rated).select("project_id", "global_level"),
        _counted(rated, "severity", "severities", F.lit(True)),
        _counted(rated, "category", "categories"),
        _counted(rated, "engine", "engines"),
        _listed(languages, c("language"), F.concat(c("language"), F.lit(" ("), c("files"), F.lit(")")), [-c("files")], "languages"),
        _listed(permissions, c("permission"), F.substring_index("permission", ".", -1), [], "permissions"),
        permissions.groupBy("project_id").agg(F.count("*").alias("n_permissions")),
        _listed(hot, c("path"), F.concat(file_name(c("path")), F.lit(" ("), c("_rules"), F.lit(")")), [c("rank")], "hot", "; "),
        flows.groupBy("project_id").agg(F.count("*").alias("n_flows")),
    ]
    rows = projects.select("project_id", "added")
    for fact in facts:
        rows = rows.join(fact, "project_id", "left")
    line = lambda text, *values: F.format_string(text, *values)
    lines = F.array(
        F.lit(TECHNICAL_HEAD), F.lit(""),
        line("- Total de observaciones: **%d**  ·  nivel de riesgo agregado: **%s**", F.coalesce("total", F.lit(0)), _or_dash(c("global_level"))),
        line("- Por severidad: %s", F.coalesce("severities", F.lit(""))),
        line("- Por ámbito: %s", F.coalesce("categories", F.lit(""))),
        line("- Lenguajes: %s", _or_dash(c("languages"))),
        F.when(c("added") > 0, line("- Componentes integrados al inventario de software: **%d**", c("added"))),
        F.when(c("n_permissions") > 0, line("- Permisos Android declarados (%d): %s", c("n_permissions"), c("permissions"))),
        F.when(c("hot") != "", line("- Puntos calientes (archivos con múltiples hallazgos): %s", c("hot"))),
        F.when(c("engines") != "", line("- Motores de análisis (hallazgos por motor): %s", c("engines"))),
        F.when(c("confirmed") > 0, line("- Hallazgos corroborados por más de un motor: **%d** (mayor confianza)", c("confirmed"))),
        F.when(c("n_flows") > 0, line("- Rutas de flujo de datos no confiable detectadas (fuente → sumidero): **%d**", c("n_flows"))),
    )
    shown = top_per_group(flows, ["project_id"], [F.asc("path"), F.asc("sink_line"), F.asc("kind")], SHOWN, "_at")
    path = line("  - %s: %s (L%d) → %s (L%d) · %s", file_name(c("path")), c("source"), c("source_line"), c("sink"), c("sink_line"), c("cwe"))
    return [_part(rows, 30, lines), _part(shown, 31, F.array(path), c("_at")), _part(projects, 32, _texts(""))]


def _finding_lines() -> Column:
    c = F.col
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    located = lambda path, at: F.concat(path, F.coalesce(F.concat(F.lit(":"), at), F.lit("")))
    block = lambda test, *lines: F.when(test, F.array(*lines, F.lit(""))).otherwise(F.array().cast("array<string>"))
    confirmed = F.when(F.size("corroborated_by") > 0, F.concat(F.lit("; corroborado por: "), F.array_join("corroborated_by", ", "))).otherwise("")
    share = F.round(c("secret_probability") * 100).cast("int").cast("string")
    likely = F.when(
        c("secret_probability").isNotNull(),
        F.concat(F.lit("; verosimilitud de secreto (ML): "), share, F.lit("%"), F.when(c("secret_probability") < 0.2, " — posible falso positivo").otherwise("")),
    ).otherwise("")
    shown = F.transform(
        c("context.fragment"), lambda f: F.concat(F.when(f["is_hit"], ">").otherwise(" "), F.lit(" "), F.lpad(f["n"].cast("string"), 4, " "), F.lit(" | "), f["text"])
    )
    evidence = F.when(
        F.size("context.fragment") > 0, F.concat(_texts("**Evidencia en contexto.**", "", "```"), shown, _texts("```", ""))
    ).otherwise(F.array(F.format_string("**Evidencia (extracto).** `%s`", text(c("evidence"))), F.lit("")))
    flow = c("flow")
    return F.concat(
        F.array(
            F.concat(
                F.format_string("### 4.%d [%s] %s  (`%s`", c("number"), c("risk_level"), c("title"), c("rule_id")),
                F.when(_given(c("cwe")), F.concat(F.lit(" · "), c("cwe"))).otherwise(""), F.lit(")"),
            ),
            F.lit(""),
        ),
        block(_given(c("description")), F.concat(F.lit("**Descripción (contexto detectado).** "), c("description"))),
        block(_given(c("plain_explanation")), F.concat(F.lit("**Qué significa, en simple.** "), c("plain_explanation"))),
        F.array(
            F.concat(
                F.lit("**Ubicación.** `"), located(c("path"), c("line")), F.lit("` · rol del archivo: "), _or_dash(c("context.role")),
                F.when(_given(c("context.construct")), F.concat(F.lit(" · "), c("context.construct"))).otherwise(""), F.lit(" · exposición: "), _or_dash(c("exposure")),
            ),
            F.lit(""),
            F.concat(F.lit("**Procedencia y verificación.** motor: "), F.coalesce("engine", F.lit("interno")), confirmed, likely, F.lit(".")), F.lit(""),
        ),
        block(
            F.coalesce("reachable", F.lit(False)) & flow.isNotNull(),
            F.format_string(FLOW, text(flow["source"]), text(flow["source_line"]), text(flow["sink"]), text(flow["sink_line"]), text(flow["name"])),
        ),
        evidence,
        F.array(
            F.format_string("**Cálculo del nivel de riesgo.** Severidad intrínseca de la regla: %s.", c("severity")),
            F.format_string("- Impacto: **%s** (%d/5). %s", c("impact_level"), c("impact"), c("impact_reasons")),
            F.format_string("- Probabilidad: **%s** (%d/5). %s", c("probability_level"), c("probability"), c("probability_reasons")),
            F.format_string("- Resultado: %d × %d = %d → nivel de riesgo **%s**.", c("impact"), c("probability"), c("risk_value"), c("risk_level")),
            F.lit(""),
        ),
        block(_given(c("impact_in_context")), F.concat(F.lit("**Impacto en el contexto del código.** "), c("impact_in_context"))),
        F.array(F.concat(F.lit("**Mitigación puntual.** "), F.coalesce("measure", "mitigation", F.lit(""))), F.lit("")),
        block(
            F.size("controls") > 0,
            F.concat(F.lit("_Trazabilidad de cumplimiento (ver sección 2): "), F.array_join("controls", ", "), F.lit("._")),
        ),
    )


FINDING_FIELDS = {
    "corroborated_by": "array<string>", "secret_probability": "double", "controls": "array<string>", "reachable": "boolean",
    "flow": "struct<source:string,source_line:int,name:string,sink:string,sink_line:int,cwe:string,kind:int>",
    "context": "struct<role:string,construct:string,fragment:array<struct<n:int,text:string,is_hit:boolean>>>",
}


def scan_report_lines(
    projects: DataFrame, rated: DataFrame, evaluated: DataFrame, evidence: DataFrame, flows: DataFrame, languages: DataFrame, permissions: DataFrame,
    author: str = "no indicado", generated_at: str = "", disclaimer: str | None = None,
) -> DataFrame:
    """Lines of all scan reports: project_id, section_no, item_no, line_no, line; sort by ``KEYS`` within a project.

    The arguments are those of ``scan_report_parts``.
    """
    parts, findings = scan_report_parts(projects, rated, evaluated, evidence, flows, languages, permissions, author, generated_at, disclaimer)
    whole = parts.unionByName(_part(_told(findings), FINDINGS, _finding_lines(), F.col("number")))
    return whole.select(*[x for x in whole.columns if x != "lines"], F.posexplode("lines").alias("line_no", "line"))


def numbered_report(
    projects: DataFrame, rated: DataFrame, evaluated: DataFrame, evidence: DataFrame, flows: DataFrame, languages: DataFrame, permissions: DataFrame,
    author: str = "no indicado", generated_at: str = "", disclaimer: str | None = None,
) -> DataFrame:
    """``n``, the place of each line in its report, and the line; as ``numbered_lines`` of ``scan_report_lines``.

    Lines of findings are not moved: the places where they begin are summed up while the findings are numbered. What is put in order apart from
    that are the keys of the other parts, with all findings of a project as one part among them.
    """
    parts, findings = scan_report_parts(projects, rated, evaluated, evidence, flows, languages, permissions, author, generated_at, disclaimer)
    parts = durable(parts)
    key = ("project_id", "section_no", "item_no")
    ends = findings.groupBy("project_id").agg(F.sum("_lines").alias("_lines"))
    counts = parts.groupBy(*key).agg(F.sum(_size(F.col("lines"))).alias("_lines"))
    counts = counts.unionByName(ends.select("project_id", F.lit(FINDINGS).alias("section_no"), F.lit(0).cast("long").alias("item_no"), "_lines"))
    totals = running_totals(counts, ["project_id"], [F.asc(k) for k in key[1:]], {"_end": F.col("_lines")})
    begun = durable(totals.select(*key, (F.col("_end") - F.col("_lines")).alias("_before")))
    # Keys may be null, so parts are joined by the struct of them.
    at = F.struct(*key).alias("_key")
    lines = parts.select("project_id", at, "lines").join(begun.select(at, "_before"), "_key").select("project_id", "_key", "_before", F.posexplode("lines").alias("line_no", "line"))
    within = F.row_number().over(Window.partitionBy("_key").orderBy("line_no"))
    around = lines.select("project_id", (F.col("_before") + within).alias("n"), "line")
    start = begun.where(F.col("section_no") == FINDINGS).select(F.col("project_id").alias("_project"), "_before")
    start = F.broadcast(start) if start.count() <= FEW else start
    told = _told(findings.join(start, F.col("project_id").eqNullSafe(F.col("_project"))))
    own = told.select("project_id", (F.col("_before") + F.col("_end") - F.col("_lines") + 1).alias("_first"), F.posexplode(_single(_finding_lines())).alias("line_no", "line"))
    return around.unionByName(own.select("project_id", (F.col("_first") + F.col("line_no")).alias("n"), "line"))


def _told(rated: DataFrame) -> DataFrame:
    """With the texts of ``finding_risk.with_narratives``, unless they are there."""
    return rated if "description" in rated.columns else finding_risk.with_narratives(rated)


def scan_report_parts(
    projects: DataFrame, rated: DataFrame, evaluated: DataFrame, evidence: DataFrame, flows: DataFrame, languages: DataFrame, permissions: DataFrame,
    author: str = "no indicado", generated_at: str = "", disclaimer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Parts of all scan reports without those of the findings, and the findings numbered: ``number``, ``_lines`` and ``_end``, the lines up to their end.

    ``projects`` has one row per project: project_id, name, files, bytes, added (components taken into the inventory). ``rated``
    come from ``finding_risk.rate``; texts of ``finding_risk.with_narratives`` are added late where they are missing, so that they are not written down. Missing optional columns count as empty. ``evaluated`` and ``evidence`` come from
    ``conformity``; projects without evaluated controls have no sections on them. Counts on one line are ordered by rank
    (severities) or number, then name. A project without findings keeps its other sections.
    """
    c = F.col
    # Many parts read these two, so they are computed once.
    rated = rated.select("*", *[F.lit(None).cast(t).alias(n) for n, t in FINDING_FIELDS.items() if n not in rated.columns])
    sized = _told(rated).withColumn("number", F.lit(0)).select(*rated.columns, _size(_single(_finding_lines())).alias("_lines"))
    rated = durable(sized)
    evaluated = durable(evaluated)
    megabytes = F.round(F.coalesce("bytes", F.lit(0)) / 1048576, 1).cast("string")
    head = F.array(
        F.lit(TITLE), F.lit(SUBTITLE), F.lit(""),
        F.format_string("**Artefacto analizado:** %s  ·  %s archivos  ·  %s MB", F.coalesce("name", F.lit("(s/d)")), F.coalesce(c("files").cast("string"), F.lit("?")), megabytes),
        F.format_string("**Generado por:** %s  ·  **Fecha y hora:** %s", F.lit(author), F.lit(generated_at)),
        *[F.lit(x) for x in (CLASSIFIED, "", FRAME, "", SCOPE, "", SUMMARY_HEAD, "")],
    )
    judged = evaluated.select("project_id").distinct()
    # Findings that are alike in their place are told apart by what their lines say.
    numbered = finding_risk.numbered(rated, [*finding_risk.export_order(), F.asc("evidence"), F.asc("engine"), F.asc("risk_value")], {"_end": c("_lines")}, written=True)
    reference = [F.lit(x) for i in INSTRUMENTS for x in (f"- **{i[0]}** — {i[1]} ({i[2]}, {i[3]}). {i[4]}",)]
    parts = [
        _part(projects, 0, head),
        _part(finding_risk.executive_summary(rated), 1, F.array(c("summary"), F.lit(""))),
        *_conformity(evaluated, evidence),
        *_technical(projects, rated, flows, languages, permissions),
        _part(projects, 40, _texts(*DETAIL_HEAD)),
        _part(judged, 50, F.array(F.lit(INSTRUMENT_HEAD), F.lit(""), *reference, F.lit(""))),
        _part(projects, 60, _texts(*ANNEX)),
    ]
    if disclaimer is not None:
        parts.append(_part(judged, 70, _texts(f"> {disclaimer}", "")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out, numbered


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``n``, the place of each line in its report."""
    return running_totals(lines, ["project_id"], [F.asc(k) for k in KEYS], {"n": F.lit(1).cast("bigint")}).select("project_id", "n", "line")
