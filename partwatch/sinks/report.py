"""Dependency report as a flat table and as ordered lines (SNK-03..SNK-05)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dependency_risk import level_rank
from ..operators import audit
from ..operators.audit import priority_packages
from ..plans.skew import durable, running_totals


def _text(c: Column, default: str = "") -> Column:
    return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c.cast("string")).otherwise(default)


def report_csv(rows: DataFrame) -> DataFrame:
    """SNK-03: twenty columns; ``rows`` come from ``audit.with_report_texts``."""
    c = F.col
    articles = F.array_join(
        F.transform("compliance.articulos", lambda a: F.concat(a["art"], F.lit(": "), a["texto"])), "; "
    )
    return rows.select(
        "project_id",
        c("package").alias("paquete"),
        c("section").alias("seccion"),
        _text(c("installed")).alias("instalada"),
        _text(c("latest")).alias("ultima_npm"),
        F.lit("").alias("release_ultima"),
        _text(c("gap"), "al día").alias("atraso"),
        c("level").alias("nivel_riesgo"),
        c("severity_label").alias("severidad"),
        F.coalesce("vuln_count", F.lit(0)).alias("cve_count"),
        F.coalesce(F.array_join("vuln_ids", " "), F.lit("")).alias("cve_ids"),
        F.array_join("known_risks", " | ").alias("riesgos_conocidos"),
        c("technical_precision").alias("precision_tecnica"),
        F.array_join("mitigations", " | ").alias("mitigaciones"),
        _text(c("homepage")).alias("sitio_oficial"),
        _text(c("repository")).alias("repositorio"),
        _text(c("npm_url")).alias("npm_url"),
        (_text(c("eol_url")) if "eol_url" in rows.columns else F.lit("")).alias("eol_url"),
        _text(c("compliance.nivel")).alias("cumplimiento_nivel"),
        _text(c("compliance.categoria")).alias("cumplimiento_categoria"),
        F.coalesce(articles, F.lit("")).alias("cumplimiento_articulos"),
    )


def general_text(s: DataFrame) -> DataFrame:
    """S-31 per project. ``s`` joins summary and overall columns with ``app_name`` and ``app_version``."""
    return s.select("project_id", general_column().alias("general"))


def general_column(c=F.col) -> Column:
    """``c`` maps the name of a project's measure to its column."""
    legal = F.when(
        (c("compliance_critico") > 0) | (c("compliance_alto") > 0),
        F.format_string(
            " Adicionalmente, el análisis de cumplimiento detectó hallazgos de riesgo legal: %d de nivel gravísimo y %d de "
            "nivel grave, asociados al tratamiento de datos personales o a código potencialmente malicioso, evaluados "
            "frente a la Ley 21.459 sobre delitos informáticos.",
            c("compliance_critico"),
            c("compliance_alto"),
        ),
    ).otherwise("")
    text = F.format_string(
        "Se auditó el proyecto «%s» (versión %s), con %d dependencias declaradas. Del análisis automatizado contra el "
        "registro npm y la base de vulnerabilidades OSV, %d dependencias están desactualizadas (%d con una versión major "
        "de atraso) y %d presentan CVE conocidos. La distribución de riesgo es: %d crítico(s), %d alto(s), %d medio(s) y "
        "%d bajo(s). El puntaje de riesgo promedio es %s.",
        _text(c("app_name"), "sin nombre"),
        _text(c("app_version"), "n/d"),
        c("total"),
        c("outdated"),
        c("major_behind"),
        c("vulnerable"),
        c("critico"),
        c("alto"),
        c("medio"),
        c("bajo"),
        c("avg_score").cast("string"),
    )
    return F.concat(text, legal)


def conclusion_text(overall: DataFrame, rated: DataFrame) -> DataFrame:
    """S-31 and O-08 per project."""
    joined = overall.join(priority_packages(rated), "project_id", "left")
    return joined.select("project_id", conclusion_column().alias("conclusion"))


def conclusion_column(c=F.col) -> Column:
    """``c`` maps the name of a project's measure, ``priority`` or ``legal`` to its column."""
    legal = F.when(
        (c("compliance_critico") > 0) | (c("compliance_alto") > 0),
        F.concat(
            F.lit("Se identificaron riesgos LEGALES que deberían resolverse antes de avanzar: "),
            F.coalesce(c("legal"), F.lit("")),
            F.lit(
                ". Conforme a la Ley 21.459, el uso de paquetes que traten datos de fuentes ilícitas (Art. 6, receptación "
                "de datos informáticos) o de código malicioso (Arts. 1, 2, 4, 7 y 8) podría acarrear responsabilidad; se "
                "recomienda revisión del área legal/cumplimiento y, de no acreditarse la licitud de las fuentes, no "
                "utilizar dichas dependencias. "
            ),
        ),
    ).otherwise("")
    first = F.coalesce(F.concat(F.lit("Atención técnica prioritaria a: "), c("priority"), F.lit(". ")), F.lit(""))
    closing = (
        F.when(
            c("verdict_level").isin("crítico", "alto"),
            "Se recomienda remediar las vulnerabilidades de severidad alta/crítica y los hallazgos legales, y re-auditar, "
            "antes de considerar el inventario apto.",
        )
        .when(
            c("verdict_level") == "medio",
            "El inventario puede considerarse con observaciones; conviene planificar la actualización de las dependencias "
            "con atraso major en el corto plazo.",
        )
        .otherwise("No se observan bloqueantes en el inventario; mantener el monitoreo periódico de dependencias.")
    )
    opening = F.format_string(
        "Recomendación sobre el inventario de software: %s. Este resultado corresponde a la revisión del inventario de "
        "dependencias (versiones, vulnerabilidades y cumplimiento) y constituye un insumo para la evaluación final de QA, "
        "no su veredicto único. ",
        c("verdict"),
    )
    return F.concat(opening, legal, first, closing)


def opened(parts: DataFrame) -> DataFrame:
    """``parts`` (key columns and ``lines``) with one row per line, ``line_no`` from 0."""
    return parts.select(*PART_KEYS, F.posexplode("lines").alias("line_no", "line"))


def numbered(parts: DataFrame) -> DataFrame:
    """Lines with ``n``, their place in the project by ``LINE_KEYS``.

    Only the keys and the numbers of lines are put in order; the lines go once to the place where their part begins.
    """
    key = F.struct(*PART_KEYS).alias("_key")
    counts = durable(parts.groupBy(*PART_KEYS).agg(F.sum(F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0)).alias("_lines")))
    ends = running_totals(counts, ["project_id"], [F.asc(k) for k in PART_KEYS[1:]], {"_end": F.col("_lines")})
    begun = ends.select(key, (F.col("_end") - F.col("_lines")).alias("_before"))
    # As keys may be null, parts are joined by the struct of them. Parts with equal keys take turns, line by line.
    lines = parts.select("project_id", key, "lines").join(begun, "_key").select("project_id", "_key", "_before", F.posexplode("lines").alias("line_no", "line"))
    within = F.row_number().over(Window.partitionBy("_key").orderBy("line_no"))
    return lines.select("project_id", (F.col("_before") + within).alias("n"), "line")


def report_lines(rows: DataFrame, overall: DataFrame, general: DataFrame, conclusion: DataFrame) -> DataFrame:
    """SNK-04: one ordered table of Markdown lines for all projects (``section_no``, risk keys, ``line_no``).

    Sort by the key columns within a project and write with ``write_lines``.
    """
    return opened(report_parts(rows, overall, general, conclusion))


def head_lines(c=F.col) -> list[Column]:
    return [
        F.lit("# Informe de inventario de software"),
        F.format_string(
            "**Recomendación sobre el inventario:** %s  ·  **Riesgo promedio:** %s", c("verdict"), c("avg_score").cast("string")
        ),
        F.lit("| Crítico | Alto | Medio | Bajo | OK |"),
        F.format_string("| %d | %d | %d | %d | %d |", c("critico"), c("alto"), c("medio"), c("bajo"), c("ok")),
    ]


def intro_lines(general: Column) -> list[Column]:
    return [F.lit("## Análisis General"), general, F.lit("## Análisis Técnico")]


def end_lines(conclusion: Column) -> list[Column]:
    return [F.lit("## Conclusión General"), conclusion]


def item_lines() -> Column:
    """Lines of one entry."""
    c = F.col
    return F.concat(
        F.array(
            F.format_string("### %s `%s` — %s", c("package"), _text(c("installed"), "—"), c("severity_label")),
            F.format_string(
                "- **Sección:** %s · **Última npm:** %s · **Atraso:** %s",
                c("section"),
                _text(c("latest"), "n/d"),
                _text(c("gap"), "al día"),
            ),
            F.lit("- **Riesgos conocidos:**"),
        ),
        F.transform("known_risks", lambda r: F.concat(F.lit("    - "), r)),
        F.array(
            F.concat(F.lit("- **Precisión técnica:** "), c("technical_precision")),
            F.lit("- **Medidas de mitigación recomendadas:**"),
        ),
        F.transform("mitigations", lambda m: F.concat(F.lit("    - "), m)),
    )


def legal_lines() -> Column:
    """Lines of one legal finding; only for entries that have one."""
    c = F.col
    return F.concat(
        F.array(
            F.format_string("### ⚖ %s — nivel %s (%s)", c("package"), F.upper("compliance.nivel"), c("compliance.categoria")),
            c("compliance.rationale"),
        ),
        F.transform("compliance.articulos", lambda a: F.concat(F.lit("- **"), a["art"], F.lit("** — "), a["texto"])),
        F.array(F.concat(F.lit("**Recomendación:** "), c("compliance.recomendacion")), c("compliance.disclaimer")),
    )


def place_keys() -> list[Column]:
    """Places of an entry among those of its project; entries of one package and score keep their lines together: section, then place in the document."""
    entry = F.concat_ws("|", "section", F.to_json(F.struct("ord")), "spec")
    return [(-level_rank(F.col("level"))).alias("level_rank"), (-F.col("score")).alias("score"), F.col("package"), entry.alias("entry")]


def report_parts(rows: DataFrame, overall: DataFrame, general: DataFrame, conclusion: DataFrame) -> DataFrame:
    """The Markdown report before it is cut into lines: key columns and ``lines``."""
    c = F.col

    def part(df, number, lines):
        return df.select(
            "project_id",
            F.lit(number).alias("section_no"),
            F.lit(0).alias("level_rank"),
            F.lit(0.0).alias("score"),
            F.lit("").alias("package"),
            F.lit("").alias("entry"),
            F.array(*lines).alias("lines"),
        )

    head = part(overall, 0, head_lines())
    intro = part(general, 1, intro_lines(c("general")))
    items = rows.select("project_id", F.lit(2).alias("section_no"), *place_keys(), item_lines().alias("lines"))
    legal = rows.where(c("compliance").isNotNull()).select("project_id", F.lit(3).alias("section_no"), *place_keys(), legal_lines().alias("lines"))
    end = part(conclusion, 4, end_lines(c("conclusion")))
    return head.unionByName(intro).unionByName(items).unionByName(legal).unionByName(end)


def no_lines() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Form:
    """What a report says: the lines of an entry and of its legal finding, and those before, between and behind the two lists.

    The last three are given the measures of a project (name to column); ``opening`` and ``closing`` are read where ``here`` holds, the number
    of opening lines at every entry. ``advisory`` keeps of an advisory what the lines say.
    """

    item: Callable[[DataFrame], Column]
    legal: Callable[[], Column]
    opening: Callable[[Callable[[str], Column], Column], Column]
    opening_size: Callable[[Callable[[str], Column]], Column]
    middle: Callable[[Callable[[str], Column]], Column]
    closing: Callable[[Callable[[str], Column], Column], Column]
    advisory: Callable[[Column], Column]


def markdown_form() -> Form:
    """The report of ``report_parts``."""

    def opening(p, here):
        # As a general text is joined by project, a project without a key has none.
        intro = F.when(F.col("project_id").isNotNull(), F.array(*intro_lines(general_column(p)))).otherwise(no_lines())
        return F.concat(F.array(*head_lines(p)), intro)

    return Form(
        lambda rows: item_lines(), legal_lines, opening, lambda p: F.when(F.col("project_id").isNotNull(), 7).otherwise(4), lambda p: no_lines(), lambda p, here: F.array(*end_lines(conclusion_column(p))),
        lambda d: F.struct(d["id"].alias("id"), d["summary"].alias("summary")),
    )


def numbered_reports(rated: DataFrame, form: Form) -> DataFrame:
    """The lines of ``numbered``, straight from rated entries, for projects that fit into one task each.

    Entries go once, without their texts, to the task that has their project. There they are put in order, measured and counted; then each
    makes its own lines with their places, and the first one of a project those that stand around the entries.
    """
    c = F.col
    keys = ["_rank", "_score", "_name", "_entry"]
    slim = rated.withColumn("vuln_details", F.transform("vuln_details", form.advisory))

    def lines(rows: DataFrame) -> tuple[Column, Column]:
        return form.item(rows), F.when(c("compliance").isNotNull(), form.legal())

    texts = audit.with_report_texts(slim)
    sizes = [F.when(x.isNotNull(), F.size(x)).otherwise(0).cast("bigint").alias(name) for x, name in zip(lines(texts), ("_size2", "_size3"))]
    sized = texts.select(*slim.columns, *sizes).repartition("project_id").select("*", *[k.alias(name) for k, name in zip(place_keys(), keys)])
    # All windows below find the rows in this order. Nothing that leaves the JVM stands between them, as it would lose the order.
    sized = sized.sortWithinPartitions("project_id", *keys)
    ordered = Window.partitionBy("project_id").orderBy(*keys)
    alike = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    so_far, whole = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    flagged = c("legal_level").isNotNull()
    placed = sized.select("*", F.row_number().over(ordered).alias("_at"), F.count(F.when(flagged, 1)).over(so_far).alias("_flag"))
    # O-08: entries of level alto or worse come first, so their place is the one among all.
    named = {"priority": (level_rank(c("level")) >= 3) & (c("_at") <= 5), "legal": flagged & (c("_flag") <= 6)}
    # Packages are joined by project as well.
    named = {n: F.when(c("project_id").isNotNull(), F.array_join(F.collect_list(F.when(test, c("package"))).over(whole), ", ")) for n, test in named.items()}
    measures = {n: m.over(whole) for n, m in (audit.summary_measures() | audit.distribution_measures()).items()} | named
    sections = {}
    for n in (2, 3):
        size = c(f"_size{n}")
        sections |= {f"_total{n}": F.sum(size).over(whole), f"_before{n}": F.sum(size).over(ordered) - F.sum(size).over(alike)}
        sections |= {f"_even{n}": F.min(size).over(alike) == F.max(size).over(alike)}
    sections |= {"_alike": F.count("*").over(alike), "_turn": c("_at") - F.min("_at").over(alike)}
    placed = placed.select("*", *[m.alias(f"_p_{n}") for n, m in measures.items()], *[m.alias(n) for n, m in sections.items()])
    uneven = [F.collect_list(F.when(~c(f"_even{n}"), c(f"_size{n}"))).over(alike).alias(f"_sizes{n}") for n in (2, 3)]

    def p(name: str) -> Column:
        if name in ("priority", "legal"):
            return F.when(c(f"_p_{name}") != "", c(f"_p_{name}"))
        return c(f"_p_{name}") if name in measures else given.get(name) if name in given else audit.verdict_fields(p)[name]

    given = {"app_name": F.concat(F.lit("app"), c("project_id")), "app_version": F.lit(None).cast("string")}
    here = c("_at") == 1
    placed = placed.select("*", *uneven)
    placed = placed.select("*", F.when(here, form.opening(p, here)).alias("_opening"), form.opening_size(p).cast("bigint").alias("_open"))
    middle = form.middle(p)
    items_end = c("_open") + c("_total2")
    legal_at = items_end + F.size(middle)
    said = audit.with_report_texts(placed)
    item, legal = lines(said)

    def part(base: Column, lines_: Column, n: int | None = None) -> Column:
        turns = (c("_alike"), c("_turn"), c(f"_sizes{n}")) if n else (F.lit(1), F.lit(0), F.array().cast("array<bigint>"))
        names = ("base", "alike", "turn", "sizes", "lines")
        types = ("bigint", "bigint", "int", "array<bigint>", "array<string>")
        return F.struct(*[x.cast(t).alias(name) for x, t, name in zip((base, *turns, lines_), types, names)])

    around = F.array(part(F.lit(0), c("_opening")), part(items_end, middle), part(legal_at + c("_total3"), form.closing(p, here)))
    own = F.array(part(c("_open") + c("_before2"), item, 2))
    found = F.array(part(legal_at + c("_before3"), legal, 3))
    nothing = F.array().cast(PART)
    parts = F.concat(F.when(here, around).otherwise(nothing), own, F.when(flagged, found).otherwise(nothing))
    opened_ = said.select("project_id", F.explode(parts).alias("p")).select("project_id", "p.*")
    out = opened_.select("project_id", "base", "alike", "turn", "sizes", F.posexplode("lines").alias("i", "line"))
    i, zero = c("i").cast("bigint"), F.lit(0).cast("bigint")
    earlier = F.aggregate("sizes", zero, lambda n, size: n + F.least(size, i))
    same = F.aggregate(F.slice("sizes", F.lit(1), c("turn")), zero, lambda n, size: n + F.when(size > i, 1).otherwise(0))
    within = F.when(F.size("sizes") == 0, i * c("alike") + c("turn")).otherwise(earlier + same)
    return out.select("project_id", (c("base") + within + 1).alias("n"), "line")


PART = "array<struct<base:bigint,alike:bigint,turn:int,sizes:array<bigint>,lines:array<string>>>"
PART_KEYS = ("project_id", "section_no", "level_rank", "score", "package", "entry")
LINE_KEYS = (*PART_KEYS, "line_no")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of all projects in order, as text files split at project boundaries where the data allows it."""
    ordered = lines.orderBy(*LINE_KEYS)
    ordered.select(F.concat_ws("\t", F.col("project_id").cast("string"), "line").alias("value")).write.mode("errorifexists").text(path)


def report_json(rows: DataFrame) -> DataFrame:
    """SNK-05: one JSON document per entry."""
    return rows.select("project_id", F.to_json(F.struct(*[c for c in rows.columns if c not in ("project_id", "ord")])).alias("json"))
