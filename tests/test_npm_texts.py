"""package.json texts of the registered queries are put together after one shuffle."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from partwatch.queries import audit_queries


def test_one_shuffle_for_both_groupings(spark):
    """dependencies were shuffled once to be made unique and once more to be put together."""
    rows = [(1, "producción", "a", "1"), (1, "producción", "a", "2"), (1, "peer", "b", "^1"), (29, "peer", "b", "*")]
    deps = spark.createDataFrame(rows, "project_id bigint, section string, package string, spec string")
    texts = audit_queries.npm_manifests(SimpleNamespace(deps=deps))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r["project_id"]: r["content"] for r in texts.select("project_id", F.col("content")).collect()} == {
        1: '{"name":"app-1","version":"1.0.0","dependencies":{"a":"2"},"devDependencies":{},"peerDependencies":{"b":"^1"}}',
        29: '{"name":"app-29","version":"1.0.0","dependencies":{},"devDependencies":{},"peerDependencies":{"b":"*"}}}{',
    }
