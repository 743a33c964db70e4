"""Running totals: each row is worked out once."""

from pyspark.sql import functions as F

from partwatch.plans.skew import running_totals


def test_rows_are_worked_out_once(spark):
    """the borders of the ranges came from a second pass over all that leads to the rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(0, 90, 1, 3).select((F.col("id") % 2).alias("k"), counted.asNondeterministic()("id").alias("v"))
    got = running_totals(rows, ["k"], [F.asc("v")], {"n": F.lit(1).cast("bigint"), "total": F.col("v")}).collect()
    assert seen.value == 90
    wanted = {(v % 2, v, v // 2 + 1, sum(range(v % 2, v + 1, 2))) for v in range(90)}
    assert {(r["k"], r["v"], r["n"], r["total"]) for r in got} == wanted and len(got) == 90
