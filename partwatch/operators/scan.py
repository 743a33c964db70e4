"""Source scan: files to findings, with their surroundings, counts and project facts.

A file is one row, so its lines are an array inside that row. Matching, limits per file and rule, the lines around a
hit and the enclosing declaration are all computed there: the scan needs no shuffle, and only hits leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import let, split_lines
from ..plans.skew import top_per_group
from ..rules import LANGUAGE_RULES, RULES, SEVERITY_RANK, Rule, rule_texts

# Fixed values.
NO_LICENSE = "No se encontró LICENSE/COPYING en el árbol del proyecto."
PROJECT_ROOT = "(raíz del proyecto)"
ROOT_ROLE = "raíz del repositorio del proyecto"
CONTEXT_DDL = "struct<role:string,construct:string,fragment:array<struct<n:int,text:string,is_hit:boolean>>>"


def scanned_files(files: DataFrame) -> DataFrame:
    """F-06: text files outside the skipped folders. The path is tested before any text is read."""
    return files.where(~st.in_skipped_folder(F.col("path")) & st.is_scanned(F.col("path")))


def limit_files(files: DataFrame, n: int) -> DataFrame:
    """O-12 for files: at most ``n`` scanned files per project in path order. Only paths are ranked; texts stay where they are."""
    key = ["project_id", "path"]
    kept = top_per_group(files.select(*key), ["project_id"], [F.asc("path")], n, "_rank").select(*key)
    return files.join(kept, key, "left_semi")


def file_limit_counts(files: DataFrame, n: int) -> DataFrame:
    """Scanned and skipped files of each project under that limit."""
    count = F.count("*")
    return files.groupBy("project_id").agg(
        F.least(count, F.lit(n).cast("bigint")).alias("scanned"), F.greatest(count - n, F.lit(0).cast("bigint")).alias("skipped")
    )


def source_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of each file."""
    return files.select(
        "project_id", "path", F.posexplode(split_lines(F.col("text"))).alias("_pos", "line")
    ).select("project_id", "path", (F.col("_pos") + 1).alias("line_no"), "line")


def _holds_trigger(text: Column, rule: Rule) -> Column | None:
    """Plain substring test that every match of the rule passes; null when the rule names no trigger."""
    test = None
    for word in rule.triggers:
        test = text.contains(word) if test is None else test | text.contains(word)
    return test


def _rule_hits(rule: Rule, text: Column, low: Column, code: Column, limit: int | None) -> Column:
    """Hits of one rule in one file. The file must hold a trigger and match as a whole before its lines are tried."""

    def matches(c: Column) -> Column:
        found = c["line"].rlike("(?iU)" + rule.pattern)
        return _holds_trigger(c["low"], rule) & found if rule.triggers else found

    found = F.filter(code, matches)
    hits = F.transform(
        found if limit is None else F.slice(found, 1, limit),
        lambda c: F.struct(F.lit(rule.id).alias("rule_id"), c["i"].alias("i"), c["line"].alias("line")),
    )
    nothing = F.array().cast("array<struct<rule_id:string,i:int,line:string>>")
    # Anchors mean lines, and a line may also end at characters that the pattern language does not count as line ends.
    whole = F.lit(True) if any(a in rule.pattern for a in ("^", "$")) else text.rlike("(?iU)" + rule.pattern)
    test = _holds_trigger(low, rule) & whole if rule.triggers else whole
    return F.coalesce(F.when(test, hits), nothing)


def file_hits(
    text: Column, rules: tuple[Rule, ...] = RULES, limit: int | None = None, info_limit: int | None = None, reach: int | None = None
) -> Column:
    """Hits of all line rules in one file, with the lines around them and the enclosing declaration.

    W-01 and W-02 on request: at most ``limit`` hits per rule, and ``info_limit`` per rule of severity info.
    """
    limit_of = lambda r: info_limit if r.severity == "info" and info_limit is not None else limit
    patterned = [r for r in rules if r.pattern]

    def in_file(low: Column, lines: Column) -> Column:
        found = lambda c: F.concat(*[_rule_hits(r, text, low, c, limit_of(r)) for r in patterned])
        return let(code_lines(lines), lambda c: with_context(lines, found(c), reach))

    return let(F.lower(text), lambda low: let(split_lines(text), lambda lines: in_file(low, lines)))


def code_lines(lines: Column) -> Column:
    """The lines that are code, with their place and in lower case."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.lower(line).alias("low")))
    return F.filter(numbered, lambda c: st.is_code_line(c["line"]))


def with_context(lines: Column, hits: Column, reach: int | None = None) -> Column:
    """Hits with the lines around them and the enclosing declaration."""
    around = lambda found, h: F.struct(
        h["rule_id"].alias("rule_id"),
        (h["i"] + 1).alias("line_no"),
        h["line"].alias("line"),
        st.enclosing_construct(found, h["i"], reach).alias("construct"),
        st.context_window(lines, h["i"]).alias("fragment"),
    )
    return let(st.declarations(lines), lambda found: F.transform(hits, lambda h: around(found, h)))


def explode_hits(analysed: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, hits: Column | str = "hits") -> DataFrame:
    """Files with their hits to findings with the texts of their rules."""
    found = analysed.select("project_id", "path", F.explode(hits).alias("h")).select("project_id", "path", "h.*")
    texts = rules if isinstance(rules, DataFrame) else rule_texts(analysed.sparkSession, rules)
    return found.join(texts, "rule_id").select(
        "project_id",
        "rule_id",
        "title",
        "category",
        "severity",
        "path",
        F.col("line_no").alias("line"),
        st.redact(st.strip(F.col("line"))).alias("evidence"),
        "guide",
        "legal",
        "cwe",
        "mitigation",
        F.lit("interno").alias("engine"),
        F.struct(
            st.file_role(F.col("path")).alias("role"),
            F.col("construct").alias("construct"),
            F.col("fragment").alias("fragment"),
        ).alias("context"),
    )


def scan_files(files: DataFrame, rules: tuple[Rule, ...] = RULES, limit: int | None = None, info_limit: int | None = None) -> DataFrame:
    """J-13 with W-01..W-04 and S-23: findings of every line rule, with context."""
    # Exploded as an expression: as a named column it would also be computed in an inferred filter.
    return explode_hits(files, rules, file_hits(F.col("text"), rules, limit, info_limit))


def language_rule_matches(files: DataFrame) -> DataFrame:
    """J-14: pattern with exclusion, by language of the file. Lines as in ``source_lines``."""
    names = {".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
    ext = st.extension(F.col("path"))

    def rule_hit(rule) -> Column:
        rule_id, languages, include, exclude, severity, cwe = rule
        hit = F.col("line").rlike(include)
        if exclude:
            hit = hit & ~F.regexp_extract("line", include, 0).rlike(exclude)
        if languages:
            hit = ext.isin(*[e for e, name in names.items() if name in languages]) & hit
        return F.when(
            hit,
            F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe")),
        )

    hits = F.array_compact(F.array(*[rule_hit(r) for r in LANGUAGE_RULES]))
    lines = source_lines(files)
    return lines.select("project_id", "path", "line_no", F.explode(hits).alias("h")).select(
        "project_id", "path", "line_no", "h.*"
    )


def missing_license(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """J-21: one finding per project that has no licence file. ``files`` are all files, scanned or not."""
    projects = files.groupBy("project_id").agg(F.bool_or(st.is_license(F.col("path"))).alias("licensed"))
    rule = next(r for r in rules if r.id == "LIC-MISSING")
    text = lambda v: F.lit(v).cast("string")
    return projects.where(~F.col("licensed")).select(
        "project_id",
        text(rule.id).alias("rule_id"),
        text(rule.title).alias("title"),
        text(rule.category).alias("category"),
        text(rule.severity).alias("severity"),
        text(PROJECT_ROOT).alias("path"),
        F.lit(None).cast("int").alias("line"),
        text(NO_LICENSE).alias("evidence"),
        text(rule.guide).alias("guide"),
        text(rule.legal).alias("legal"),
        text(rule.cwe).alias("cwe"),
        text(rule.mitigation).alias("mitigation"),
        text("interno").alias("engine"),
        F.struct(text(ROOT_ROLE).alias("role"), text("").alias("construct"), F.array().alias("fragment")).cast(CONTEXT_DDL).alias("context"),
    )


# ---- counts and project facts


def finding_counts(findings: DataFrame) -> DataFrame:
    """A-06: findings by severity, category and engine, and in total, in one pass."""
    grouped = findings.groupingSets(
        [["project_id", "severity"], ["project_id", "category"], ["project_id", "engine"], ["project_id"]],
        "project_id",
        "severity",
        "category",
        "engine",
    ).agg(F.count("*").alias("findings"), F.grouping_id().alias("_id"))
    # The grouping id has one bit per column that was aggregated away, in the order above.
    dimension = (
        F.when(F.col("_id") == 3, "severity").when(F.col("_id") == 5, "category").when(F.col("_id") == 6, "engine").otherwise("total")
    )
    return grouped.select(
        "project_id",
        dimension.alias("dimension"),
        F.coalesce("severity", "category", "engine", F.lit("")).alias("value"),
        "findings",
    )


def gravest_first() -> Column:
    """O-09."""
    return F.desc(st.lookup(F.col("severity"), SEVERITY_RANK))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Counts by severity; read them in the order ``gravest_first``."""
    return findings.groupBy("project_id", "severity").agg(F.count("*").alias("findings"))


def extension_counts(files: DataFrame) -> DataFrame:
    """A-07: files by extension; files without one count as ``(sin)``."""
    ext = st.extension(F.col("path"))
    return files.groupBy("project_id", F.when(ext == "", "(sin)").otherwise(ext).alias("extension")).agg(
        F.count("*").alias("files")
    )


def top_extensions(files: DataFrame, n: int) -> DataFrame:
    """O-06."""
    return top_per_group(extension_counts(files), ["project_id"], [F.desc("files"), F.asc("extension")], n, "rank")


def language_counts(files: DataFrame) -> DataFrame:
    """A-08."""
    named = files.withColumn("language", st.language(F.col("path"))).where(F.col("language").isNotNull())
    return named.groupBy("project_id", "language").agg(F.count("*").alias("files"))


def android_permissions(files: DataFrame) -> DataFrame:
    """A-09: distinct permissions each project declares in its manifest, one row each."""
    manifest = files.where(F.lower(st.file_name(F.col("path"))) == "androidmanifest.xml")
    found = F.regexp_extract_all("text", F.lit(r"android\.permission\.[A-Z_]+"), F.lit(0))
    return manifest.select("project_id", F.explode(found).alias("permission")).distinct()


def project_flags(files: DataFrame) -> DataFrame:
    """A-10: licence file and OIDC hint per project."""
    path, text = F.col("path"), F.col("text")
    return files.groupBy("project_id").agg(
        F.bool_or(st.is_license(path)).alias("has_license"),
        F.bool_or(st.is_scanned(path) & st.has_oidc_hint(path, text)).alias("has_oidc"),
    )


def main_build_module(files: DataFrame) -> DataFrame:
    """A-26: the build file with the most ``implementation`` words; of equal ones the first path."""
    name = F.lower(st.file_name(F.col("path")))
    builds = files.where(name.isin("build.gradle", "build.gradle.kts"))
    uses = F.regexp_count("text", F.lit("implementation"))
    best = F.min(F.struct((-uses).alias("uses"), "path")).alias("best")
    return builds.groupBy("project_id").agg(best).select("project_id", (-F.col("best.uses")).alias("uses"), "best.path")


# ---- corroboration and flows


def corroboration_key(f) -> Column:
    """J-20: (path, line, CWE or category); without a line (path, null, CVE or rule). ``f`` maps a name to a column."""
    cwe = st.cwe_id(F.coalesce(f("cwe"), F.lit("")))
    cve = st.blank_to_null(
        F.regexp_extract(F.concat_ws(" ", f("rule_id"), f("evidence")), r"CVE-\d{4}-\d+", 0)
    )
    located = F.coalesce(cwe, f("category"), F.lit(""))
    return F.struct(
        f("path").alias("path"),
        F.coalesce(f("line"), F.lit(-1)).alias("line"),
        F.when(f("line").isNotNull(), located).otherwise(F.coalesce(cve, f("rule_id"), located)).alias("kind"),
    )


def corroborate(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Merge external findings into internal ones.

    External findings are folded per key first (first one kept, engines as a set), so each key meets at most one row
    and no pairs are built. Only the first internal finding of a key is marked; ``internal`` needs an ``ord`` column
    that gives the order of findings, ``external`` too.
    """
    key = ["project_id", "_key"]
    mine = internal.withColumn("_key", corroboration_key(F.col))
    rest = [c for c in external.columns if c != "project_id"]
    folded = _fold(external.withColumn("_key", corroboration_key(F.col)), key, rest)
    first_internal = mine.groupBy(*key).agg(F.min("ord").alias("_first_ord"))
    seen = folded.join(first_internal, key, "left")
    marks = seen.where(F.col("_first_ord").isNotNull()).select(
        *key, F.col("_first_ord").alias("ord"), F.col("_engines").alias("corroborated_by")
    )
    marked = mine.join(marks, [*key, "ord"], "left").drop("_key")
    fresh = seen.where(F.col("_first_ord").isNull()).select(
        "project_id", "_first.*", F.col("_repeats").alias("corroborated_by")
    )
    return marked.unionByName(fresh.select(*[c for c in marked.columns]))


def _fold(external: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """One row per key: its first finding, all engines, and the engines of the later findings.

    An engine repeats when it has more than one row, or one that is not the first; so counts per engine suffice.
    """
    engine = F.coalesce("engine", F.lit("externo"))
    per_engine = (
        external.withColumn("_engine", engine)
        .groupBy(*key, "_engine")
        .agg(F.min_by(F.struct(*rest), "ord").alias("_row"), F.min("ord").alias("_ord"), F.count("*").alias("_n"))
    )
    # At most one row per engine and key is collected here.
    folded = per_engine.groupBy(*key).agg(
        F.min_by("_row", "_ord").alias("_first"),
        F.min_by("_engine", "_ord").alias("_first_engine"),
        F.array_sort(F.collect_list(F.struct("_engine", "_n"))).alias("_list"),
    )
    repeats = F.filter("_list", lambda e: (e["_engine"] != F.col("_first_engine")) | (e["_n"] > 1))
    return folded.select(
        *key,
        "_first",
        F.transform("_list", lambda e: e["_engine"]).alias("_engines"),
        F.transform(repeats, lambda e: e["_engine"]).alias("_repeats"),
    )


def corroborated(findings: DataFrame) -> DataFrame:
    """F-14: findings that another engine confirms."""
    return findings.where(F.size("corroborated_by") > 0)
