"""Marked declarations are read a batch at a time."""

import re

from pyspark.sql import functions as F

from partwatch.operators import gradle


def test_declarations_of_a_batch(spark):
    """Starts, groups and section of every declaration were worked out by lambdas over the pieces of a text."""
    texts = [None, "", "nothing", 'ksp("a:b:1")' + "é" * 59 + "testImplementation('c:d:2')" + "é" * 119 + 'api "e:f:$v"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    read = gradle._declarations(F.col("text"), gradle.COORDINATE, 3, lambda g, s: F.array(*g, s))
    got = {r["id"]: r["d"] for r in df.select("id", read.alias("d")).collect()}
    assert got == {
        0: None,
        1: [],
        2: [],
        3: [["a", "b", "1", "producción"], ["c", "d", "2", "test"], ["e", "f", "$v", "producción"]],
    }
    rows = spark.createDataFrame([(1, texts[3], None)], "project_id int, content string, toml string")
    plan = gradle.dependencies(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and not re.search(r"arrays_zip|substring\(_raw", plan)
