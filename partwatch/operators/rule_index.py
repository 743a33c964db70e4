"""Line rules kept as a table of any size (X-01): an inverted index of their triggers picks the rules of each file.

A rule names words of which every match holds one. The first letters of each such word are its key; the keys that occur in a file,
joined to the index, give the few rules that may match there, and only these are tried on its lines. Rules without a usable word
are tried on every file. The rules of a file are put together before they meet its text, which travels once per chunk of rules.
Nothing of the table comes to the driver or becomes part of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let, split_lines
from . import scan

# Letters of a key.
GRAM = 3
# Rules that travel in one row.
CHUNK = 1_000
FILE_KEY = ["project_id", "path"]


def _words(triggers: Column) -> Column:
    """Usable triggers of a rule in lower case; none if one of them is too short, as that one may be all a match holds."""
    low = F.transform(F.coalesce(triggers, F.array().cast("array<string>")), lambda t: F.lower(t))
    return F.when(F.exists(low, lambda t: F.length(t) < GRAM), F.array().cast("array<string>")).otherwise(low)


def candidates(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Project, path and rule_id of every rule that may match in a file."""
    keyed = rules.select("rule_id", F.explode(_words(F.col("triggers"))).alias("word")).select("rule_id", F.left("word", F.lit(GRAM)).alias("gram")).distinct()
    grams = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    held = files.select(*FILE_KEY, F.explode(grams).alias("gram")).join(keyed, "gram").select(*FILE_KEY, "rule_id").distinct()
    free = rules.where(F.size(_words(F.col("triggers"))) == 0).select("rule_id")
    n = max(1, -(-free.count() // CHUNK))
    chunks = free.groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(n)).cast("int").alias("_chunk")).agg(F.collect_list("rule_id").alias("_rules"))
    asked = files.select(*FILE_KEY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_chunk"))
    return held.unionByName(asked.join(chunks, "_chunk").select(*FILE_KEY, F.explode("_rules").alias("rule_id")))


def _hits() -> Column:
    """Hits of the rules of a row in its text, with context. Lines are numbered once; rules without a trigger in the text are left out."""
    low = F.lower("text")

    def matches(rule: Column, c: Column) -> Column:
        held = (F.size(rule["triggers"]) == 0) | F.exists(rule["triggers"], lambda t: c["low"].contains(t))
        # Not rlike, which would compile a pattern that is no constant anew for every line.
        return F.when(held, F.regexp_instr(c["line"], rule["pattern"]) > 0).otherwise(F.lit(False))

    def of_rule(rule: Column, code: Column) -> Column:
        found = F.filter(code, lambda c: matches(rule, c))
        return F.transform(found, lambda c: F.struct(rule["rule_id"].alias("rule_id"), c["i"].alias("i"), c["line"].alias("line")))

    def in_file(lines: Column, rules: Column) -> Column:
        found = let(scan.code_lines(lines), lambda code: F.flatten(F.transform(rules, lambda r: of_rule(r, code))))
        return let(found, lambda f: F.when(F.size(f) > 0, scan.with_context(lines, f)))

    held = lambda text: F.filter("_rules", lambda r: (F.size(r["triggers"]) == 0) | F.exists(r["triggers"], lambda t: text.contains(t)))
    return let(let(low, held), lambda rules: F.when(F.size(rules) > 0, let(split_lines(F.col("text")), lambda lines: in_file(lines, rules))))


def scan_files_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """J-13 with a table of rules: the findings of ``scan.scan_files``.

    ``rules`` has rule_id (unique), pattern, triggers and the texts of a finding; a null or empty pattern matches nothing, null
    triggers are none. Files with a null text have no findings; empty tables give no rows.
    """
    usable = rules.where(F.coalesce("pattern", F.lit("")) != "")
    found = candidates(files.where("text IS NOT NULL"), usable)
    lowered = F.transform(F.coalesce("triggers", F.array().cast("array<string>")), lambda t: F.lower(t))
    rule = F.struct("rule_id", F.concat(F.lit("(?iU)"), "pattern").alias("pattern"), lowered.alias("triggers"))
    n = max(1, -(-usable.count() // CHUNK))
    judged = usable.select("rule_id", F.pmod(F.xxhash64("rule_id"), F.lit(n)).alias("_chunk"), rule.alias("_rule"))
    packed = found.join(judged, "rule_id").groupBy(*FILE_KEY, "_chunk").agg(F.collect_list("_rule").alias("_rules"))
    return scan.explode_hits(packed.join(files, FILE_KEY), usable.drop("pattern", "triggers"), _hits())
