"""Real source trees (SRC-09): files as whole rows, and files too large for a row as overlapping ranges of lines.

A small file is one row, so all its work is inside that row (``operators.scan``). A larger one is read as lines by as many tasks as it has
splits, numbered, and dealt to ranges that hold the lines around their borders and the last declaration before them; each range is
scanned like a small file. What assigns or uses untrusted data is picked out in every range and traced in the order of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import LINE_BREAK
from ..operators import scan, taint
from ..rules import RULES, Rule

# Bytes up to which a file is one row, and lines of a range.
WHOLE = 32 << 20
RANGE = 20_000
# Lines around a hit that its context shows (the default of ``context_window``).
AROUND = 2


def _placed(files: DataFrame, root: str) -> DataFrame:
    """``project_id``, the first folder below ``root``, and ``path`` within it."""
    base = root.rstrip("/") + "/"
    below = F.substring_index(F.col("_file"), base, -1)
    return files.withColumns({"project_id": F.substring_index(below, "/", 1), "path": F.regexp_replace(below, "^[^/]*/", "")})


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` (one folder a project) with its size; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _placed(found.select(F.col("path").alias("_file"), F.col("length").alias("bytes")), root).select("project_id", "path", "bytes", "_file")


def read_tree(spark: SparkSession, root: str, whole: int = WHOLE) -> DataFrame:
    """``project_id, path, text`` of every file of at most ``whole`` bytes; larger ones are left to ``large_lines``.

    Bytes that are no UTF-8 become replacement characters. The size is tested by the reader, before content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= whole)
    rows = found.select(F.col("path").alias("_file"), F.decode("content", "UTF-8").alias("text"))
    return _placed(rows, root).select("project_id", "path", "text")


def large_lines(spark: SparkSession, root: str, whole: int = WHOLE) -> DataFrame:
    """``project_id, path, line_no, line`` of the files of more than ``whole`` bytes that are scanned.

    Lines of one split of a file lie together in a task, in order; each split counts its lines, and the splits before it give the first
    number. Lines break as in ``split_lines``.
    """
    listed = scan.scanned_files(list_tree(spark, root).where(F.col("bytes") > whole))
    names = [r[0] for r in listed.select("_file").collect()]  # files of more than ``whole`` bytes: few beside their content
    if not names:
        return spark.createDataFrame([], "project_id string, path string, line_no long, line string")
    text = spark.read.option("lineSep", "\n").text(names)
    parts = F.split(F.regexp_replace("value", "\r$", ""), LINE_BREAK)
    rows = text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), parts.alias("_parts")
    )
    counts = rows.groupBy("_file", "_block").agg(F.sum(F.size("_parts")).alias("_lines"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_file", "_block", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_before", F.coalesce(F.sum(F.size("_parts")).over(within), F.lit(0))).join(firsts, ["_file", "_block"])
    lines = numbered.select("_file", (F.col("_first") + F.col("_before") + 1).alias("_no"), F.posexplode("_parts").alias("_i", "line"))
    return _placed(lines.withColumn("line_no", F.col("_no") + F.col("_i")), root).select("project_id", "path", "line_no", "line")


def ranges(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """Ranges of ``size`` lines: ``text``, ``first`` and ``last`` (its own lines), and ``shift``, to be added to a line's number in the text.

    In front of its own lines a range has the last declaration before them, wherever it is, and the lines around its border.
    """
    key = ["project_id", "path"]
    own = lines.withColumn("_range", F.floor((F.col("line_no") - 1) / size))
    declared = own.where(F.col("line").rlike("(?U)" + st.DECLARATION)).groupBy(*key, "_range").agg(F.max(F.struct("line_no", "line")).alias("_last"))
    # The row of a range without a declaration is needed, too: the one before it is carried on.
    spans = own.groupBy(*key, "_range").agg(F.count("*").alias("_n")).join(declared, [*key, "_range"], "left")
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*key, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    position = (F.col("line_no") - 1) % size
    held = F.array_compact(
        F.array(F.col("_range"), F.when((position < AROUND) & (F.col("_range") > 0), F.col("_range") - 1), F.when(position >= size - AROUND, F.col("_range") + 1))
    )
    dealt = own.select(*key, "line_no", "line", F.explode(held).alias("_range"))
    # At most ``size`` lines and those around the borders.
    collected = dealt.groupBy(*key, "_range").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    joined = collected.join(carried, [*key, "_range"])  # a range of border lines alone is none
    texts = F.transform("_lines", lambda x: x["line"])
    text = F.array_join(F.concat(F.when(F.col("_carried").isNotNull(), F.array("_carried.line")).otherwise(F.array().cast("array<string>")), texts), "\n")
    extra = F.when(F.col("_carried").isNotNull(), 1).otherwise(0)
    return joined.select(
        *key, text.alias("text"), (F.col("_range") * size + 1).alias("first"), ((F.col("_range") + 1) * size).alias("last"),
        (F.element_at("_lines", 1)["line_no"] - 1 - extra).alias("shift"),
    )


def scan_ranges(parts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of ``scan.scan_files``, without limits, from ranges of files."""
    shifted = F.transform(
        scan.file_hits(F.col("text"), rules),
        lambda h: h.withField("line_no", (h["line_no"] + F.col("shift")).cast("int")).withField(
            "fragment", F.transform(h["fragment"], lambda f: f.withField("n", (f["n"] + F.col("shift")).cast("int")))
        ),
    )
    own = F.filter(shifted, lambda h: (h["line_no"] >= F.col("first")) & (h["line_no"] <= F.col("last")))
    return scan.explode_hits(parts, rules, own)


def trace_ranges(parts: DataFrame) -> DataFrame:
    """The flows of ``taint.flow_paths`` from ranges of files.

    Every range picks its assignments and sink lines. Those of a file are sorted by line and pass through one task as a stream: the
    assignments first, then the sinks, with no more in memory than the names of one file.
    """
    code = parts.where(st.extension(F.col("path")).isin(*st.CODE_EXTENSIONS))
    picked = taint.picked_lines(F.col("text"), whole=False)
    both = F.concat(
        F.transform(picked["assigned"], lambda a: F.struct(F.lit(0).alias("turn"), a["line"].alias("line"), a["name"].alias("name"), a["rhs"].alias("text"), a["label"].alias("label"), F.array().cast("array<int>").alias("kinds"))),
        F.transform(picked["sinks"], lambda s: F.struct(F.lit(1).alias("turn"), s["line"].alias("line"), F.lit(None).cast("string").alias("name"), s["text"].alias("text"), F.lit(None).cast("string").alias("label"), s["kinds"].alias("kinds"))),
    )
    moved = F.transform(both, lambda x: x.withField("line", (x["line"] + F.col("shift")).cast("int")))
    own = F.filter(moved, lambda x: (x["line"] >= F.col("first")) & (x["line"] <= F.col("last")))
    rows = code.select("project_id", "path", F.explode(own).alias("x")).select("project_id", "path", "x.*")
    ordered = rows.repartition("project_id", "path").sortWithinPartitions("project_id", "path", "turn", "line")
    return ordered.mapInArrow(taint.traced_stream, f"project_id string, path string, {taint.FLOW_DDL}")


def scan_tree(spark: SparkSession, root: str, rules: tuple[Rule, ...] = RULES, whole: int = WHOLE, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Findings and flows of all scanned files below ``root``, of whichever size."""
    small = scan.scanned_files(read_tree(spark, root, whole))
    parts = ranges(large_lines(spark, root, whole), size)
    findings = scan.scan_files(small, rules).unionByName(scan_ranges(parts, rules))
    return findings, taint.flow_paths(small).unionByName(trace_ranges(parts))
