"""Plain text form of the dependency report (SNK-04): the same content as the Markdown lines, wrapped."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import Form, conclusion_column, general_column, no_lines, opened, place_keys

# The rules and texts of the printed report.
RULE, DASHES = "=" * 70, "-" * 70
WIDTH = 70
TITLE = "  INFORME DE INVENTARIO DE SOFTWARE — %s"
PROJECT = "  Proyecto: %s  v%s"
AUTHOR = "  Generado por: %s   |   Fecha y hora: %s"
VERDICT = "  Recomendación sobre el inventario: %s   |   Riesgo promedio: %s"
PURPOSE = "  Insumo para la evaluación final de QA · %s"
WRITERS = {True: "con IA (Claude)", False: "modelo de riesgo local"}
NO_AUTHOR = "no indicado"
GENERAL, TECHNICAL, CONCLUSION = "ANÁLISIS GENERAL", "ANÁLISIS TÉCNICO", "CONCLUSIÓN GENERAL"
LEGAL = "ANÁLISIS DE CUMPLIMIENTO LEGAL (Ley 21.459 / 19.628)"
LEGAL_HEAD = ("", LEGAL, DASHES)
RISKS, MEASURES = "    Riesgos conocidos:", "    Medidas de mitigación recomendadas:"
ARTICLES, ADVICE = "    Disposiciones legales potencialmente aplicables:", "    Recomendación: "
MAX_REFERENCES = 3
# White space that needs more than a split, and the places where a word may break.
UNEVEN = re.compile(r"[\t\x0b\x0c\r]|^ |  | $|^$")
PARTS = textwrap.TextWrapper.wordsep_re
HIDDEN = {ord(x): 0xFDD0 + i for i, x in enumerate("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")}
SHOWN = {hidden: x for x, hidden in HIDDEN.items()}


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """Lines of at most ``width`` characters, filled greedily: one array of lines for a text.

    Paragraphs are the text's own lines; an empty one is an empty line. Within a paragraph tabs go to columns of eight, any other
    white space character counts as a space, is kept between words and dropped at line ends and starts (the first line keeps its indent). A word
    breaks behind a hyphen between letters; one longer than a line fills what is left of the line and breaks behind a hyphen if
    there is one. A null text is null. Texts are wrapped a batch at a time.
    """

    @F.arrow_udf("array<string>")
    def wrap(texts: pa.Array) -> pa.Array:
        return pa.array(_folded(texts, width), pa.list_(pa.string()))

    return wrap(text)


def wrapped_size(text: Column, width: int = WIDTH) -> Column:
    """The number of lines of ``wrapped``."""

    @F.arrow_udf("int")
    def wrap_size(texts: pa.Array) -> pa.Array:
        return pa.array((None if lines is None else len(lines) for lines in _folded(texts, width)), pa.int32())

    return wrap_size(text)


def _folded(texts: pa.Array, width: int) -> Iterator[list[str] | None]:
    """Lines of each text of a batch; a text that equals the one before it is not wrapped again."""
    fold = textwrap.TextWrapper(width).wrap
    last = lines = None
    for text in texts.to_pylist():
        if text != last:
            last, lines = text, None if text is None else [x for p in text.split("\n") for x in _filled(p, width) or _wrapped(p, fold)]
        yield lines


def _wrapped(paragraph: str, fold) -> list[str]:
    """Spaces that are no white space here are hidden from ``textwrap``, which would drop them."""
    return [x.translate(SHOWN) for x in fold(paragraph.translate(HIDDEN))] or [""]


def _filled(paragraph: str, width: int) -> list[str] | None:
    """Lines of a paragraph of words with single spaces between them, found by looking back from where each line must end.

    Null if there is other white space or a part of a word that is longer than a line.
    """
    if UNEVEN.search(paragraph):
        return None
    lines, at, n = [], 0, len(paragraph)
    while n - at > width:
        most = at + width
        cut = paragraph.rfind(" ", at, most + 1)
        begin = paragraph.rfind(" ", 0, at) + 1 if cut < 0 else cut + 1
        end = paragraph.find(" ", begin)
        word, place, best = paragraph[begin : end if end >= 0 else n], begin, 0
        for part in PARTS.split(word) if "-" in word else (word,):
            if len(part) > width:
                return None
            place += len(part)
            if max(at, begin) < place <= most:
                best = place
        if best:
            lines.append(paragraph[at:best])
            at = best
        else:
            lines.append(paragraph[at:cut])
            at = cut + 1
    return [*lines, paragraph[at:]]


def _or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)


def _given(*columns: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _field(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def _indented(prefix: str, lines: Column) -> Column:
    """``prefix`` before the first line, four spaces before the others."""
    return F.transform(lines, lambda x, i: F.concat(F.when(i == 0, prefix).otherwise("    "), x))


def _item(rows: DataFrame) -> Column:
    """Lines of one dependency; what is missing is left out."""
    c, of = F.col, lambda name: _field(rows, name)
    maker = _given(of("homepage"), of("repository"), of("npm_url"))
    cycle = F.when(of("eol_url") != "", F.concat(F.lit("    EOL (ciclo de vida): "), of("eol_url"))).when(
        of("eol_info") != "", F.concat(F.lit("    EOL: "), of("eol_info"))
    )
    head = F.array_compact(
        F.array(
            F.lit(""),
            F.format_string("• %s %s  [%s]", c("package"), F.coalesce("installed", F.lit("")), c("severity_label")),
            F.format_string(
                "    Sección: %s | Última npm: %s (%s) | Atraso: %s", c("section"), _or(c("latest"), "n/d"), _or(of("latest_release"), "s/f"), _or(c("gap"), "al día")
            ),
            F.concat(F.lit("    Desarrollador: "), maker),
            F.when(maker.isNotNull(), F.concat(F.lit("    npm: "), F.coalesce(of("npm_url"), F.lit("None")))),
            cycle,
            F.lit(RISKS),
        )
    )

    def advisory(d: Column) -> Column:
        summary = F.coalesce(F.concat(F.lit(" - "), F.when(d["summary"] != "", d["summary"])), F.lit(""))
        title = F.format_string("      · %s (sev. %s)%s", F.coalesce(d["id"], F.lit("None")), _or(d["severity"], "n/d"), summary)
        references = F.slice(F.coalesce(d["references"], F.array().cast("array<string>")), 1, MAX_REFERENCES)
        return F.concat(F.array(title), F.transform(references, lambda u: F.concat(F.lit("          ref: "), u)))

    bullet = lambda texts: F.transform(texts, lambda x: F.concat(F.lit("      - "), x))
    advisories = F.flatten(F.transform(F.coalesce("vuln_details", F.array().cast(rows.schema["vuln_details"].dataType)), advisory))
    return F.concat(
        head, bullet(c("known_risks")), advisories, F.array(F.concat(F.lit("    Precisión técnica: "), c("technical_precision")), F.lit(MEASURES)),
        bullet(c("mitigations")),
    )


def _legal_item() -> Column:
    c = F.col("compliance")
    articles = F.transform(c["articulos"], lambda a: F.concat(F.lit("      - "), a["art"], F.lit(": "), a["texto"]))
    return F.concat(
        F.array(F.format_string("• %s  [%s] — %s", F.col("package"), F.upper(c["nivel"]), c["categoria"])),
        _indented("    ", wrapped(c["rationale"], 66)),
        F.array(F.lit(ARTICLES)), articles,
        _indented(ADVICE, wrapped(F.coalesce(c["recomendacion"], F.lit("")), 60)),
        F.array(F.concat(F.lit("    "), F.coalesce(c["disclaimer"], F.lit(""))), F.lit("")),
    )


def _single(lines: Column) -> Column:
    """A text with line breaks makes several lines."""
    return F.flatten(F.transform(lines, lambda x: F.split(x, "\n")))


def _head(c, general_lines: Column, generated_at: str, author: str | None, ai_used: bool) -> Column:
    return F.concat(
        F.array(
            F.lit(RULE), F.format_string(TITLE, F.lit(generated_at)), F.format_string(PROJECT, _or(c("app_name"), "n/d"), _or(c("app_version"), "n/d")),
            F.format_string(AUTHOR, F.lit(author or NO_AUTHOR), F.lit(generated_at)),
            F.format_string(VERDICT, c("verdict"), c("avg_score").cast("string")), F.format_string(PURPOSE, F.lit(WRITERS[ai_used])),
            F.lit(RULE), F.lit(""), F.lit(GENERAL), F.lit(DASHES),
        ),
        general_lines, F.array(F.lit(""), F.lit(TECHNICAL), F.lit(DASHES)),
    )


def _end(conclusion: Column) -> Column:
    return F.concat(F.array(F.lit(CONCLUSION), F.lit(DASHES)), wrapped(conclusion))


def text_form(generated_at: str = "", author: str | None = None, ai_used: bool = False) -> Form:
    """The report of ``text_parts``."""

    head = lambda p, lines: _single(_head(p, lines, generated_at, author, ai_used))
    # As general texts are joined by project, a project without a key has neither one nor a head.
    known = F.col("project_id").isNotNull()
    opening = lambda p, here: F.when(known, head(p, wrapped(F.when(here, general_column(p))))).otherwise(no_lines())
    opening_size = lambda p: F.when(known, F.size(head(p, no_lines())) + wrapped_size(general_column(p))).otherwise(0)
    legal_head = F.array(F.lit(""), *[F.lit(x) for x in LEGAL_HEAD])
    return Form(
        lambda rows: _single(_item(rows)), lambda: _single(_legal_item()), opening, opening_size,
        lambda p: F.when(p("compliance_flags") > 0, legal_head).otherwise(F.array(F.lit(""))),
        lambda p, here: _single(_end(F.when(here, conclusion_column(p)))),
        lambda d: F.struct(d["id"].alias("id"), d["severity"].alias("severity"), d["summary"].alias("summary"), F.slice(d["references"], 1, MAX_REFERENCES).alias("references")),
    )


def text_lines(
    rows: DataFrame, projects: DataFrame, overall: DataFrame, general: DataFrame, conclusion: DataFrame,
    generated_at: str = "", author: str | None = None, ai_used: bool = False,
) -> DataFrame:
    """SNK-04: the lines of ``text_parts``, one row per line."""
    return opened(text_parts(rows, projects, overall, general, conclusion, generated_at, author, ai_used))


def text_parts(
    rows: DataFrame, projects: DataFrame, overall: DataFrame, general: DataFrame, conclusion: DataFrame,
    generated_at: str = "", author: str | None = None, ai_used: bool = False,
) -> DataFrame:
    """SNK-04: the printed reports of all projects as parts, ``lines`` with the key columns of ``report.report_parts``.

    ``rows`` come from ``audit.with_report_texts``, ``projects`` has app_name and app_version, the others are those of the Markdown
    report. A text with line breaks makes several lines. The legal section is left out where no dependency has a finding.
    """
    c = F.col

    def part(df: DataFrame, number: int, lines: Column, item: bool = False) -> DataFrame:
        if item:
            keys = place_keys()
        else:
            keys = [F.lit(0).alias("level_rank"), F.lit(0.0).alias("score"), F.lit("").alias("package"), F.lit("").alias("entry")]
        return df.select("project_id", F.lit(number).alias("section_no"), *keys, _single(lines).alias("lines"))

    texts = overall.join(general, "project_id").join(projects.select("project_id", "app_name", "app_version"), "project_id", "left")
    flagged = rows.where(c("compliance").isNotNull())
    legal_head = flagged.select("project_id").distinct()
    parts = [
        part(texts, 0, _head(c, wrapped(c("general")), generated_at, author, ai_used)),
        part(rows, 1, _item(rows), True),
        part(overall, 2, F.array(F.lit(""))),
        part(legal_head, 3, F.array(*[F.lit(x) for x in LEGAL_HEAD])),
        part(flagged, 4, _legal_item(), True),
        part(conclusion, 5, _end(c("conclusion"))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
