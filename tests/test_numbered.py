"""Places of report lines: parts with equal keys, keys that are null, parts without lines."""

from partwatch.sinks import report

DDL = "project_id int, section_no int, level_rank int, score double, package string, entry string, lines array<string>"


def test_places(spark):
    rows = [
        (1, 0, 0, 0.0, "", "", ["a", "b"]),
        (1, 2, 0, -0.0, None, None, ["n1"]),
        (1, 2, 0, 0.0, "p", "e", ["x1", "x2"]),
        (1, 2, 0, -0.0, "p", "e", ["x1", "x2", "x3"]),
        (1, 3, 0, 0.0, "p", "e", None),
        (1, 3, 0, 0.0, "q", "e", []),
        (1, 4, 0, 0.0, "", "", ["z"]),
        (None, 0, 0, 0.0, "", "", ["only"]),
    ]
    got = report.numbered(spark.createDataFrame(rows, DDL)).collect()
    wanted = ["a", "b", "n1", "x1", "x1", "x2", "x2", "x3", "z"]
    assert sorted((r.n, r.line) for r in got if r.project_id == 1) == list(enumerate(wanted, 1))
    assert [(r.n, r.line) for r in got if r.project_id is None] == [(1, "only")]


def test_lines_are_not_written_down(spark):
    """every line went through the range shuffle and the checkpoint; now the keys alone do."""
    written, durable = [], report.durable
    parts = spark.createDataFrame([(1, 0, 0, 0.0, "", "", ["a", "b"])], DDL)
    try:
        report.durable = lambda df: written.append(df.columns) or durable(df)
        report.numbered(parts)
    finally:
        report.durable = durable
    assert written == [[*report.PART_KEYS, "_lines"]]
