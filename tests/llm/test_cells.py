import numpy as np

from partwatch.llm import cells
from partwatch.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, threshold=0.98):
    good = [(i, np.array(v, float) / np.linalg.norm(v), label) for i, v, label in rows if usable(i, v, label)]
    links, number = [], {i: 0 for i, _, _ in rows}
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y >= threshold:
                links.append((i, j))
                number[i] += 1
                number[j] += 1
    root = brute.roots([i for i, _, _ in rows], links)
    return {(i, number[i], root[i], root[i] == i) for i, _, _ in rows}


def usable(i, v, label):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) and label is not None


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op5_embedding_near_dedup"](spark, SF).collect()}
    assert got == expected(rows)


def test_blocks_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 9)
    monkeypatch.setattr(cells, "FIT_ROWS", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * rng.choice([0.02, 0.1, 0.5], 300)[:, None]
    x[250:270] = x[250]
    x[270:280] = x[270] * 3
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2)) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [nan] * 8, 1), (403, [inf] * 8, 1), (404, [None, 1.0], 1), (405, [], 0)]
    rows += [(406, rows[0][1], None), (407, [1.0, 1.0], 0), (408, [1.0, 1.001], 0), (409, [1e-30, 1e-30], 0), (410, [3e38, 3e38], 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", rep int").repartition(3)
    got = {tuple(r) for r in cells.near_groups(frame).collect()}
    assert got == expected(rows) and any(r[1] for r in got)
    assert cells.near_groups(frame.where("false")).count() == 0
