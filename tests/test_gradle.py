"""Declarations and variables of odd Gradle texts against plain regular expressions."""

import re

from pyspark.sql import functions as F

from partwatch.operators import gradle

TEXTS = (
    "",
    'implementation("a.b:c:1.0")\n  testImplementation \'x:y-api\'\n api(group = "g", name = "n", version = "2")',
    'apimplementation("a:b:1") kapt("c:d-api"e:f:2") ksp("é:x:1") implementation(platform(libs.one.two))',
    'val a = "1"\nvar b="2" c = "x"\n9val1x = "3" valfoo = "4" d = e = "5" = "6" f == "7" 12 = "8" éabc = \'9\' "10" = "11"',
    'x\x01 = "1" implementation("a\x01:b:1") \x01\x01 androidTestImplementation("p:q:$a")\x01 classpath "r:s:1"',
    " " * 130 + 'classpath("k:l:1")' + " " * 130 + 'API("m:n:${b}")\ndebugImplementation(libs.One.two)',
    '=\n= "1" z\t=\n"1.2" api"a:b"api"c:d:1"',
)
TOML = '[versions]\nq = "1"\n[libraries]\none-two = { module = "a.b:c", version.ref = "q" }\n'
SHAPES = (gradle.COORDINATE, gradle.NAMED, gradle.NO_VERSION, gradle.ALIAS)


def plain_section(text, start):
    seg = text[max(0, start - 120) : start + 60].lower()
    return "test" if "testimplementation" in seg or "androidtest" in seg else "build" if "classpath" in seg else "producción"


def test_declarations_of_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    raw = F.replace("text", F.lit(gradle.MARK), F.lit(gradle.STAND_IN))
    for shape in SHAPES:
        n = re.compile(shape).groups
        build = lambda groups, section: F.array(*groups, section)
        got = df.select("id", gradle._declarations(raw, shape, n, build).alias("d")).collect()
        for row in got:
            text = TEXTS[row["id"]]
            found = re.finditer("(?i)" + shape, text, re.ASCII)
            assert row["d"] == [[*(g or "" for g in m.groups()), plain_section(text, m.start())] for m in found], (shape, text)


def test_assigned_versions_of_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    pattern = r"""(?:val|def|var)?([A-Za-z_]\w*)\s*=\s*["']([\w.\-]+)["']"""
    for row in df.select("id", gradle.assigned_versions(F.col("text")).alias("v")).collect():
        wanted = [m for m in re.findall(pattern, TEXTS[row["id"]], re.ASCII) if m[1][0].isdigit()]
        assert [tuple(v) for v in row["v"]] == wanted


def test_a_text_is_read_once_per_shape(spark):
    """Each group of a shape, and its starts, took a pass over the text of their own."""
    df = spark.createDataFrame([(1, TEXTS[1], TOML)], "project_id int, content string, toml string")
    plan = gradle.dependencies(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(_raw", plan)) == len(SHAPES)
    assert not re.findall(r"(regexp_extract_all|split)\(_raw#\d+, \(", plan)
