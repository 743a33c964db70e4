"""Version arithmetic: semantic versions, ranges and gaps (S-03..S-08, F-05, S-32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import blank_to_null, let, strip

# Fixed values.
UNRESOLVABLE = r"^$|^\*$|^latest$|^x$|^npm:|^git|^github:|^file:|^http|^link:|^workspace:"
NPM_PRERELEASE = "-|alpha|beta|rc|next|canary"
MAVEN_PRERELEASE = "(?i)alpha|beta|rc|snapshot|-dev|eap"


def semver(v: Column) -> Column:
    """STRUCT<major, minor, patch> of the part before ``-`` and ``+``; structs order field by field."""
    release = F.substring_index(F.substring_index(v, "-", 1), "+", 1)
    return _numbers(lambda i: F.split_part(release, F.lit("."), F.lit(i + 1)))


def _numbers(part) -> Column:
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))


def _three_numbers(parts: Column) -> Column:
    return _numbers(lambda i: F.get(parts, F.lit(i)))


def clean_range(spec: Column) -> Column:
    """STRUCT<base, pinned> of a declared range."""
    return let(strip(F.coalesce(spec, F.lit(""))), _range_parts)


def _range_parts(s: Column) -> Column:
    resolvable = ~s.rlike(UNRESOLVABLE)
    base = F.when(resolvable, F.regexp_extract(s, r"\d+(?:\.\d+){0,2}", 0))
    return F.struct(
        let(base, blank_to_null).alias("base"),
        (resolvable & s.rlike("^[0-9]")).alias("pinned"),
    )


def npm_gap(installed: Column, latest: Column) -> Column:
    """STRUCT<outdated, gap> between an installed and the newest version."""
    pair = F.when(
        (installed != "") & (latest != ""), F.struct(semver(installed).alias("a"), semver(latest).alias("b"))
    )
    return let(pair, _npm_gap)


def _npm_gap(p: Column) -> Column:
    a, b = p["a"], p["b"]
    gap = (
        F.when(a >= b, "al día")
        .when(a["major"] != b["major"], "major")
        .when(a["minor"] != b["minor"], "minor")
        .when(a["patch"] != b["patch"], "patch")
    )
    return F.struct((a < b).alias("outdated"), gap.alias("gap"))


def digit_runs(v: Column) -> Column:
    """The first three digit runs as numbers, padded with zero."""
    return let(F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)), _three_numbers)


def digit_gap(installed: Column, latest: Column) -> Column:
    """major/minor/patch when the newest is ahead, null when equal or behind."""
    pair = F.when(
        (installed != "") & (latest != ""), F.struct(digit_runs(installed).alias("a"), digit_runs(latest).alias("b"))
    )
    return let(pair, _digit_gap)


def _digit_gap(p: Column) -> Column:
    a, b = p["a"], p["b"]
    # Structs compare field by field, so the first field that differs decides.
    ahead = b > a
    return (
        F.when(ahead & (b["major"] != a["major"]), "major")
        .when(ahead & (b["minor"] != a["minor"]), "minor")
        .when(ahead, "patch")
    )


def npm_stable(v: Column) -> Column:
    return ~v.rlike(NPM_PRERELEASE)


def maven_stable(v: Column) -> Column:
    return ~v.rlike(MAVEN_PRERELEASE)


def repository_url(url: Column) -> Column:
    for old, new in (("git+", ""), ("git://", "https://"), (".git", "")):
        url = F.replace(url, F.lit(old), F.lit(new))
    return url


def manifest_kind(content: Column, filename: Column) -> Column:
    """npm or gradle; the file name wins over the content."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    text = F.coalesce(content, F.lit(""))
    has = lambda s: text.contains(s)
    json_like = text.rlike(r"^\s*\{") & (
        has('"dependencies"') | has('"devDependencies"') | (has('"name"') & has('"version"'))
    )
    gradle_like = (
        text.rlike(r"\b(implementation|api|testImplementation|androidTestImplementation|classpath)\b")
        | has("plugins {")
        | has("rootProject.name")
    )
    return (
        F.when(name.endswith(".gradle") | name.endswith(".kts"), "gradle")
        .when(name.endswith(".json"), "npm")
        .when(json_like, "npm")
        .when(gradle_like, "gradle")
        .otherwise("npm")
    )


def npm_link(package: Column) -> Column:
    return F.concat(F.lit("https://www.npmjs.com/package/"), package)


def maven_link(group: Column, artifact: Column) -> Column:
    return F.concat(F.lit("https://central.sonatype.com/artifact/"), group, F.lit("/"), artifact)


def plugin_link(plugin_id: Column, resolved: Column) -> Column:
    base = F.lit("https://plugins.gradle.org/")
    return F.when(resolved, F.concat(base, F.lit("plugin/"), plugin_id)).otherwise(base)
