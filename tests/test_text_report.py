"""The printed form of the dependency report, and its wrapping against the standard library's."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from partwatch.sinks import text_report

WORDS = ("a", "re-auditar", "x" * 9, "y" * 33, "ab-cd-ef", "a-b-c", "--", "-", "a--b", "uno-2", "2-uno", "señal-ñandú", "é", "e.g.,", "https://x.y/a-b-c-d-e/f?g=h-i")
GAPS = (" ", " ", " ", "  ", " " * 14, "\t", "\n", "\n\n", "", " \n ")


def texts_of(seed, n=1_500):
    draw = random.Random(seed)
    return ["".join(draw.choice(WORDS) + draw.choice(GAPS) for _ in range(draw.randrange(14))) for _ in range(n)]


def plain(text, width):
    return [line for p in text.split("\n") for line in textwrap.fill(p, width).split("\n")]


def wrapped(spark, texts, width):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.w for r in df.select("i", text_report.wrapped(F.col("t"), width).alias("w")).orderBy("i").collect()]


@pytest.mark.parametrize("width", [5, 12, 40])
def test_wrapping(spark, width):
    texts = texts_of(width)
    wrong = [(t, got, plain(t, width)) for t, got in zip(texts, wrapped(spark, texts, width), strict=True) if got != plain(t, width)]
    assert len(wrong) == 0, min(wrong, key=lambda w: len(w[0]))


def test_long_words_and_empty_paragraphs(spark):
    texts = ["", "\n", "\n\na\n", "x" * 200, "a " + "x" * 200 + " b", "-" * 90, "a-" * 60 + "b", "ab-" * 60 + "cd", " " * 80 + "a", " " * 70, "a" + " " * 90 + "b", " lead", "  " + "x" * 80]
    assert wrapped(spark, texts, 70) == [plain(t, 70) for t in texts]
    assert wrapped(spark, [None], 70) == [None]


def test_optional_fields(spark):
    """Links, end-of-life notes and advisories that are missing make no line; line breaks in a text make several."""
    row = {
        "project_id": 1, "package": "p", "installed": None, "severity_label": "OK", "section": "s", "latest": None, "gap": None, "level": "ok", "score": 0.0, "spec": "1", "ord": 1,
        "known_risks": ["r"], "technical_precision": "t1\nt2", "mitigations": ["m"], "homepage": "", "repository": None, "npm_url": None, "eol_url": "", "eol_info": "2030", "compliance": None,
        "vuln_details": [{"id": "CVE-1", "severity": None, "summary": "", "references": ["u1", "u2", "u3", "u4"]}],
    }
    schema = (
        "project_id int, package string, installed string, severity_label string, section string, latest string, gap string, level string, score double, spec string, ord int, known_risks array<string>, "
        "technical_precision string, mitigations array<string>, homepage string, repository string, npm_url string, eol_url string, eol_info string, "
        "compliance struct<nivel:string,categoria:string,rationale:string,articulos:array<struct<art:string,texto:string>>,recomendacion:string,disclaimer:string>, "
        "vuln_details array<struct<id:string,severity:string,summary:string,references:array<string>>>"
    )
    rows = spark.createDataFrame([row], schema)
    one = lambda ddl, *values: spark.createDataFrame([(1, *values)], "project_id int, " + ddl)
    lines = text_report.text_lines(
        rows, one("app_name string, app_version string", None, ""), one("verdict string, avg_score double", "RECOMENDADO", 0.0), one("general string", "g"), one("conclusion string", "c")
    )
    got = [r.line for r in lines.orderBy("section_no", "line_no").collect()]
    assert got[2:4] == ["  Proyecto: n/d  vn/d", "  Generado por: no indicado   |   Fecha y hora: "]
    assert got[14:] == [
        "", "• p   [OK]", "    Sección: s | Última npm: n/d (s/f) | Atraso: al día", "    EOL: 2030", "    Riesgos conocidos:", "      - r", "      · CVE-1 (sev. n/d)",
        "          ref: u1", "          ref: u2", "          ref: u3", "    Precisión técnica: t1", "t2", "    Medidas de mitigación recomendadas:", "      - m", "", "CONCLUSIÓN GENERAL", "-" * 70, "c",
    ]
