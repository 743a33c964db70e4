"""Gradle manifests of the registered queries are filled from the order alone."""

from types import SimpleNamespace

from partwatch.queries import gradle_queries


def test_texts_are_put_together_without_searches(spark):
    """Each mark of a template was searched for in the whole text of every order."""
    orders = spark.createDataFrame([(7,), (8,), (9,), (None,)], "o_orderkey bigint")
    df = gradle_queries.manifests(SimpleNamespace(spark=spark, table=lambda name: orders))
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()

    def plain(text, k):
        return text.replace("{k}", str(k)).replace("{p}", str(1 + k % 5)).replace("{s}", str(20 + k % 20))

    got = {r["project_id"]: (r["content"], r["toml"], r["extra"]) for r in df.collect()}
    wanted = {
        k: (
            plain(gradle_queries.CONTENT, k),
            plain(gradle_queries.TOML, k) if k % 3 else None,
            plain(gradle_queries.WRAPPER, k) if k % 2 == 0 else None,
        )
        for k in (7, 8, 9)
    }
    assert got == wanted | {None: (None, None, None)}
