"""Product catalogue: cycles, their status, the joined read and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import maven_stable, npm_stable, semver
from ..plans.skew import lookup_join, top_per_group


def safe_date(text: Column) -> Column:
    """Date of an ISO text, or null (S-02)."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def cycle_status(eol: Column, support: Column, today: Column) -> Column:
    """Life-cycle status of bool-or-date texts (S-01)."""
    dated = ~eol.isin("true", "false")
    return (
        F.when(eol == "true", "eol")
        .when(dated & (safe_date(eol) <= today), "eol")
        .when(dated & (support == "false"), "obsolete")
        .when(dated & (safe_date(support) <= today), "obsolete")
        .when(eol.isNotNull(), "ok")
        .otherwise("unknown")
    )


def encode_flag(v: Column) -> Column:
    """Bool-or-date text to its stored form (F-11)."""
    return F.when(v == "true", "__true__").when(v == "false", "__false__").when(v != "", v)


def decode_flag(v: Column) -> Column:
    return F.when(v == "__true__", "true").when(v == "__false__", "false").otherwise(v)


# ---- registry packages to cycles


def newest_stable_version(versions: DataFrame) -> DataFrame:
    """Newest stable version per package (column ``latest``)."""
    return (
        versions.where(npm_stable(F.col("version")))
        .groupBy("package")
        .agg(F.max_by("version", semver(F.col("version"))).alias("latest"))
    )


def npm_cycles(versions: DataFrame, newest: int | None = None) -> DataFrame:
    """A-24, and W-06 if ``newest`` limits the majors of a package. ``versions(package, latest_tag, ord, version, released)`` to one row per major.

    Of equal versions the first in the document wins. A package with only pre-releases falls back to its tag.
    """
    v = versions.withColumn("_sv", semver(F.col("version")))
    best = (
        v.where(npm_stable(F.col("version")))
        .groupBy("package", F.col("_sv.major").alias("major"))
        .agg(
            F.max_by(F.struct("version", "released"), F.struct("_sv", -F.col("ord"))).alias("_best"),
            F.first("latest_tag").alias("latest_tag"),
        )
        .select("package", "major", "latest_tag", F.col("_best.version").alias("latest"), F.col("_best.released").alias("released"))
    )
    only_pre = (
        v.groupBy("package")
        .agg(
            F.bool_or(npm_stable(F.col("version"))).alias("_stable"),
            F.first("latest_tag").alias("latest_tag"),
            F.max(F.when(F.col("version") == F.col("latest_tag"), F.col("released"))).alias("released"),
        )
        .where(~F.col("_stable") & F.col("latest_tag").isNotNull())
        .select("package", semver(F.col("latest_tag"))["major"].alias("major"), "latest_tag", F.col("latest_tag").alias("latest"), "released")
    )
    majors = best.unionByName(only_pre)
    if newest is not None:
        majors = top_per_group(majors, ["package"], [F.desc("major")], newest, "_rank")
    newest_major = F.max("major").over(Window.partitionBy("package"))
    tagged = F.when(F.col("latest_tag").isNotNull(), semver(F.col("latest_tag"))["major"]).otherwise(newest_major)
    return majors.select(
        F.col("package").alias("slug"),
        F.col("major").cast("string").alias("cycle"),
        "latest",
        F.when(F.col("released") != "", F.substring_index("released", "T", 1)).alias("release_date"),
        F.when(F.col("major") == tagged, "ok").otherwise("obsolete").alias("status"),
    )


def maven_newest(versions: Column, latest: Column, release: Column) -> Column:
    """A-25: last stable version in document order, else the declared one, else the last."""
    named = F.filter(versions, lambda v: v != "")
    stable = F.filter(named, maven_stable)
    nonempty = lambda c: F.when(c != "", c)
    declared = F.coalesce(nonempty(latest), nonempty(release))
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.coalesce(last(stable), declared, last(named))


def first_repository(coordinates: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """J-22: newest version from the first repository, else the second; a failed first lookup stops.

    ``first`` and ``second`` are ``(group, artifact, lookup, latest)`` with one row per artefact.
    """
    on = ["group", "artifact"]
    rename = lambda df, tag: df.select(*on, F.col("lookup").alias(f"_{tag}_lookup"), F.col("latest").alias(f"_{tag}"))
    joined = lookup_join(coordinates, rename(first, "a"), on)
    joined = lookup_join(joined, rename(second, "b"), on)
    failed_first = F.col("_a_lookup").eqNullSafe("neterror")
    failed = failed_first | (F.col("_a").isNull() & F.col("_b_lookup").eqNullSafe("neterror"))
    return joined.select(
        *coordinates.columns,
        F.when(~failed, F.coalesce("_a", "_b")).alias("latest"),
        F.when(failed, None)
        .when(F.col("_a").isNotNull(), "Maven Central")
        .when(F.col("_b").isNotNull(), "Google Maven")
        .alias("latest_origin"),
        F.when(failed, "neterror").when(F.coalesce("_a", "_b").isNull(), "not-found").alias("lookup_error"),
    )


# ---- slugs


def live_slugs(declared: DataFrame, live: DataFrame) -> DataFrame:
    """J-02 / U-05: declared slugs that exist upstream. An empty ``live`` gives an empty result."""
    return declared.join(live.select("slug"), "slug", "left_semi")


def missing_slugs(declared: DataFrame, live: DataFrame) -> DataFrame:
    """U-06: declared slugs that upstream does not know."""
    return declared.join(live.select("slug"), "slug", "left_anti")


def with_advisory_package(cycles: DataFrame, packages: DataFrame) -> DataFrame:
    """J-03: advisory coordinates of a product; without a mapping or a version the status is no-map.

    ``packages`` has one row per slug; its size is left to the optimiser, which broadcasts it only when small.
    """
    joined = cycles.join(packages, "slug", "left")
    mapped = F.col("package").isNotNull() & (F.coalesce(F.when(F.col("latest") != "", F.col("latest")), F.col("cycle"), F.lit("")) != "")
    return joined.withColumn("vuln_status", F.when(~mapped, "no-map"))


def with_advisories(cycles: DataFrame, packages: DataFrame, by_version: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """J-03 with J-06: the advisories of each cycle's version. ``packages(slug, ecosystem, package)`` has one row per slug.

    ``no-map`` without a mapping or a version, ``neterror`` where the lookup is in ``failed(ecosystem, package, version)``,
    else ``vulnerable`` or ``clean`` with the count; only looked-up cycles have a count.
    """
    key = ["ecosystem", "package", "version"]
    mapped = with_advisory_package(cycles, packages).withColumn("version", F.coalesce(F.when(F.col("latest") != "", F.col("latest")), "cycle"))
    lost = (
        mapped.select(*key).limit(0).withColumn("_failed", F.lit(True))
        if failed is None
        else failed.select(*key).distinct().withColumn("_failed", F.lit(True))
    )
    joined = lookup_join(lookup_join(mapped, by_version.select(*key, "vuln_count"), key), lost, key)
    known = F.col("vuln_status").isNull() & F.col("_failed").isNull()
    count = F.when(known, F.coalesce("vuln_count", F.lit(0).cast("bigint")))
    status = F.coalesce("vuln_status", F.when(F.col("_failed"), "neterror"), F.when(count > 0, "vulnerable").otherwise("clean"))
    return joined.select(*cycles.columns, status.alias("vuln_status"), count.alias("vuln_count"))


def registry_products(cycles: DataFrame, libraries: DataFrame) -> DataFrame:
    """J-27: display name and category of the registry packages in the catalogue."""
    return cycles.join(libraries, "slug")


# ---- read


def catalog(cycles: DataFrame, products: DataFrame) -> DataFrame:
    """J-01: cycles with their product."""
    p = products.select("slug", "category", "display_name")
    name = F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), F.col("slug"))
    return cycles.join(p, "slug").withColumn("name", name).drop("display_name")


def catalog_order() -> list[Column]:
    """O-01: cycles are text and sort as text."""
    return [F.asc("category"), F.asc("slug"), F.desc("cycle")]


def filter_catalog(
    rows: DataFrame,
    category: str = "",
    status: str = "",
    vulnerability: str = "",
    search: str = "",
) -> DataFrame:
    """F-01..F-03; empty means all."""
    if category:
        rows = rows.where(F.col("category") == category)
    if status:
        rows = rows.where(F.col("status") == status)
    if vulnerability == "vulnerable":
        rows = rows.where(F.col("vuln_count") > 0)
    if vulnerability == "clean":
        rows = rows.where(F.col("vuln_status") == "clean")
    return search_rows(rows, search, ["slug", "name", "cycle", "latest", "vuln_ids", "category"])


def search_rows(rows: DataFrame, search: str, fields: list[str]) -> DataFrame:
    """Case-insensitive search over fields joined by a space; nulls count as empty text."""
    needle = search.strip().lower()
    if not needle:
        return rows
    kinds = dict(rows.dtypes)

    def text(name):
        c = F.array_join(name, " ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(c, F.lit(""))

    return rows.where(F.lower(F.concat_ws(" ", *[text(f) for f in fields])).contains(needle))


def with_category_header(rows: DataFrame) -> DataFrame:
    """W-09: mark the first row of each category in catalogue order.

    One row per category is found by a per-group limit, so no task sees a whole category.
    """
    first = top_per_group(
        rows.select("category", "slug", "cycle"), ["category"], [F.asc("slug"), F.desc("cycle")], 1, "_rank"
    ).select(F.col("category").alias("_c"), F.col("slug").alias("_s"), F.col("cycle").alias("_y"))
    on = (
        F.col("category").eqNullSafe(F.col("_c")) & (F.col("slug") == F.col("_s")) & (F.col("cycle") == F.col("_y"))
    )
    return rows.join(first, on, "left").withColumn("is_header", F.col("_s").isNotNull()).drop("_c", "_s", "_y")


def date_state(v: Column, now: Column) -> Column:
    """S-52: state of a support or end-of-life cell."""
    flag = decode_flag(v)
    return (
        F.when(flag == "true", "terminado")
        .when(flag == "false", "activo")
        .when(F.coalesce(flag, F.lit("")) == "", "—")
        .when(safe_date(flag) <= now, F.concat(flag, F.lit(" (pasado)")))
        .otherwise(flag)
    )


def status_cell(status: Column) -> Column:
    return F.when(status == "eol", "EOL").when(status == "obsolete", "OBSOLETO").when(status == "ok", "OK").otherwise("—")


def vulnerability_cell(status: Column, count: Column) -> Column:
    return (
        F.when(status == "no-map", "n/d")
        .when(status == "neterror", "error")
        .when(count > 0, F.concat(count.cast("string"), F.lit(" CVE")))
        .when(status == "clean", "sin CVE")
        .otherwise("—")
    )


def verdict_class(level: Column) -> Column:
    """Colour class of a stored verdict, from its level."""
    return F.when(level.isin("crítico", "alto"), "bad").when(level.isin("medio", "bajo"), "warn").otherwise("ok")


def catalog_status(products: DataFrame, cycles: DataFrame) -> DataFrame:
    """A-21: counts and last update."""
    p = products.select(F.lit(1).alias("p"), F.lit(0).alias("c"), "updated_at")
    c = cycles.select(F.lit(0).alias("p"), F.lit(1).alias("c"), F.lit(None).cast("string").alias("updated_at"))
    return p.unionByName(c).agg(
        F.sum("p").alias("products"), F.sum("c").alias("cycles"), F.max("updated_at").alias("last_update")
    )


def categories(rows: DataFrame) -> DataFrame:
    """A-22."""
    return rows.where(F.col("category") != "").select("category").distinct().orderBy("category")
