import pytest


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest tables with rows of every odd kind."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    long = " ".join(f"w{i % 9_000}" for i in range(30_000))
    odd = [None, "", "   \n\t", "one", "The THE the", "a" * 450, long, rows[3][1], rows[3][1], rows[4][1].upper(), "x y z w v u " * 40]
    base = max(r[0] for r in rows) + 1
    rows += [(base + i, t) for i, t in enumerate(odd)]
    words = rows[5][1].split(" ")
    rows += [(base + 100 + i, " ".join(words[: 3 + 7 * i] + ["edited"] + words[4 + 7 * i :])) for i in range(12)]
    return rows
