"""Gradle manifests: coordinates, version catalogue, plugins and platform (SRC-03, S-38..S-43, S-50, J-09..J-12, U-02).

A manifest with its version catalogue is one row. Variables, library aliases and plugins of a build are therefore
arrays inside the row and are resolved there; parsing a fleet of manifests shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import WHITESPACE, blank_to_null, let, split_lines, strip
from ..functions.platform import assess_sdk, assess_tool
from ..functions.versions import digit_gap, maven_link, plugin_link

# Configurations and the shapes of a declaration.
# The three classes in front are the first letters of the alternatives: most places of a text are left after one look.
CONFIGURATION = (
    r"(?=[acdikrt][aelmnopsu][abdilmnps])(?:implementation|api|compileOnly|runtimeOnly|testImplementation|androidTestImplementation|debugImplementation|"
    r"releaseImplementation|kapt|ksp|annotationProcessor|classpath)"
)
COORDINATE = CONFIGURATION + r"""\s*\(?\s*["']([\w.\-]+):([\w.\-]+):([\w.\-${}]+)["']"""
NO_VERSION = CONFIGURATION + r"""\s*\(?\s*["']([\w.\-]+):([\w.\-]+)["']\s*\)?"""
NAMED = (
    r"""group\s*[:=]\s*["']([\w.\-]+)["']\s*,\s*name\s*[:=]\s*["']([\w.\-]+)["']"""
    r"""(?:\s*,\s*version\s*[:=]\s*["']([\w.\-]+)["'])?"""
)
ALIAS = CONFIGURATION + r"""\s*\(\s*(?:platform\s*\(\s*)?libs\.([\w.]+)"""
# No blanks after the keyword here: a name after blanks is found by a match that starts at the name itself.
VARIABLE = r"""(?:val|def|var)?([A-Za-z_]\w*)$"""
VALUE = r"""^\s*["']([\w.\-]+)["']"""
INTERPOLATION = r"\$\{?([\w.]+)\}?"
TOML_VERSION = r"""^\s*([\w\-]+)\s*=\s*["']([\w.\-]+)["']"""
PLUGIN_ID = r"""id\s*\(\s*["']([\w.\-]+)["']\s*\)\s*version\s*["']([\w.\-]+)["']"""
PLUGIN_KOTLIN = r"""kotlin\s*\(\s*["']([\w.\-]+)["']\s*\)\s*version\s*["']([\w.\-]+)["']"""
PLUGIN_ALIAS = r"""alias\s*\(\s*libs\.plugins\.([\w.\-]+)\s*\)"""
SDK_KINDS = ("compileSdk", "targetSdk", "minSdk")
AGP_SHAPES = (
    r"""com\.android\.(?:application|library)["']\s*\)?\s*version\s*["']([\w.\-]+)["']""",
    r"com\.android\.tools\.build:gradle:([\w.\-]+)",
)
AGP_VARIABLES = ("agp", "androidGradlePlugin", "android-gradle-plugin", "libs.versions.agp")
WRAPPER = r"distributionUrl=.*?gradle-([\d.]+)-(?:bin|all)\.zip"
PROJECT_NAME = r"""rootProject\.name\s*=\s*["']([^"']+)["']"""
UNRESOLVED_NOTE = "versión por catálogo/variable no resuelta (sube libs.versions.toml)"
EOL_TEXT = "Artefacto Maven/Android: sin EOL formal publicado (regir por releases)."
PAIRS = "array<struct<name:string,value:string>>"
# Stands around the matches of a marked text; no shape of a declaration has room for it or for its stand-in.
MARK, STAND_IN = "\x01", "\x02"
MODULE_SHAPE = r"""module\s*=\s*["']([\w.\-]+):([\w.\-]+)["']"""
SHORT_SHAPE = r"""^["']([\w.\-]+):([\w.\-]+)(?::[\w.\-]+)?["']"""
REFERENCE_SHAPE = r"""version\.ref\s*=\s*["']([\w\-]+)["']"""
QUOTED = r"""\s*=\s*["']([\w.\-]+)["']"""
# The same shapes for texts that are read a batch at a time.
SHAPES = [re.compile("(?i)" + shape, re.ASCII) for shape in (COORDINATE, NAMED, NO_VERSION, ALIAS)]
ASSIGNED, NAME, CATALOGUE_VERSION, INTERPOLATED, MODULE, SHORT = (re.compile(x, re.ASCII) for x in (VALUE, VARIABLE, TOML_VERSION, INTERPOLATION, MODULE_SHAPE, SHORT_SHAPE))
LAST_WORD = re.compile(r"\s*(\w+)", re.ASCII)
LIBRARY_FIELDS = [re.compile(x, re.ASCII) for x in ("group" + QUOTED, "name" + QUOTED, "version" + QUOTED, REFERENCE_SHAPE)]


def strip_comments(text: Column) -> Column:
    """S-38. Also cuts ``//`` inside a URL."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def project_name(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, PROJECT_NAME, 1))


def _matches(text: Column, pattern: str, build) -> Column:
    """All matches of a pattern in one pass over the text, as ``build(group)``; a match alone has the groups it had in the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: build(lambda i: F.regexp_extract(m, pattern, i)))


def _pairs(text: Column, pattern: str) -> Column:
    """All matches of a two-group pattern."""
    return _matches(text, pattern, lambda group: F.struct(group(1).alias("name"), group(2).alias("value")))


def _last(pairs: Column, key: Column) -> Column:
    """Value of the last pair with this name: a later assignment wins."""
    return let(F.filter(pairs, lambda p: p["name"] == key), lambda hits: F.get(hits, F.size(hits) - 1)["value"])


def toml_section(toml: Column, name: str) -> Column:
    """Lines of a section (W-05): the text is cut before every line that opens one, so each piece carries its header."""
    pieces = F.split(F.coalesce(toml, F.lit("")), r"(?m)^(?=[ \t]*\[)")
    own = F.filter(pieces, lambda p: F.lower(strip(F.split(p, "\n", 2)[0])) == f"[{name}]")
    return F.flatten(F.transform(own, lambda p: let(split_lines(p), lambda lines: F.slice(lines, 2, F.size(lines)))))


def toml_versions(toml: Column) -> Column:
    rows = F.filter(toml_section(toml, "versions"), lambda l: l.rlike(TOML_VERSION))
    pair = lambda l: F.struct(
        F.regexp_extract(l, TOML_VERSION, 1).alias("name"), F.regexp_extract(l, TOML_VERSION, 2).alias("value")
    )
    return F.transform(rows, pair)


def assigned_versions(raw: Column) -> Column:
    """Assignments of quoted values that begin with a digit. The text is cut at its ``=``; only names in front of such a value are read."""

    def assignments(parts: Column) -> Column:
        right = F.transform(
            parts, lambda p, i: F.struct(F.get(parts, i - 1).alias("left"), F.regexp_extract(p, VALUE, 1).alias("value"))
        )
        versions = F.filter(right, lambda p: p["value"].rlike(r"^\d"))
        word = lambda left: F.reverse(F.regexp_extract(F.reverse(left), r"^\s*(\w+)", 1))
        named = F.transform(
            versions, lambda p: F.struct(F.regexp_extract(word(p["left"]), VARIABLE, 1).alias("name"), p["value"].alias("value"))
        )
        return F.filter(named, lambda p: p["name"] != "")

    return let(F.split(raw, "="), assignments)


def version_variables(raw: Column, toml: Column) -> Column:
    """S-43: variables that look like a version, then those of the catalogue under two names."""
    prefixed = lambda catalogue: F.transform(
        catalogue, lambda p: F.struct(F.concat(F.lit("libs.versions."), p["name"]).alias("name"), p["value"].alias("value"))
    )
    return F.concat(assigned_versions(raw), let(toml_versions(toml), lambda catalogue: F.concat(prefixed(catalogue), catalogue)))


def resolve_version(v: Column, variables: Column) -> Column:
    """J-09: a plain version as it is; an interpolated one by its full key, last segment, or catalogue name."""
    key = F.regexp_extract(v, INTERPOLATION, 1)
    segment = F.substring_index(key, ".", -1)
    found = F.coalesce(
        _last(variables, key), _last(variables, segment), _last(variables, F.concat(F.lit("libs.versions."), segment))
    )
    return F.when(v == "", None).when(v.rlike(INTERPOLATION), found).otherwise(v)


def library_table(toml: Column, variables: Column) -> Column:
    """J-11: aliases of the catalogue with their coordinates; a version reference beats a literal."""
    quoted = lambda rhs, key: F.regexp_extract(rhs, key + QUOTED, 1)

    def library(line: Column) -> Column:
        key = F.btrim(strip(F.substring_index(line, "=", 1)), F.lit('"'))
        return let(strip(F.regexp_extract(line, r"^[^=]*=(.*)$", 1)), lambda rhs: let(read(rhs), lambda x: entry(key, x)))

    def read(rhs: Column) -> Column:
        shapes = {f"{name}{i}": F.regexp_extract(rhs, pattern, i) for name, pattern in (("module", MODULE_SHAPE), ("short", SHORT_SHAPE)) for i in (1, 2)}
        fields = {name: quoted(rhs, name) for name in ("group", "name", "version")}
        reference = F.regexp_extract(rhs, REFERENCE_SHAPE, 1)
        return F.struct(*[c.alias(name) for name, c in (shapes | fields | {"reference": reference}).items()])

    def entry(key: Column, x: Column) -> Column:
        given = lambda name: blank_to_null(x[name])
        named = given("group").isNotNull() & given("name").isNotNull()
        group = F.coalesce(given("module1"), F.when(named, given("group")), given("short1"))
        artifact = F.coalesce(given("module2"), F.when(named, given("name")), given("short2"))
        reference = given("reference")
        version = F.when(
            reference.isNotNull(),
            F.coalesce(_last(variables, reference), _last(variables, F.concat(F.lit("libs.versions."), reference))),
        ).otherwise(given("version"))
        return F.struct(
            normal_alias(key).alias("alias"), group.alias("group"), artifact.alias("artifact"), version.alias("version")
        )

    lines = F.filter(
        toml_section(toml, "libraries"), lambda l: l.contains("=") & ~strip(l).startswith("#")
    )
    return F.filter(F.transform(lines, library), lambda e: e["group"].isNotNull() & e["artifact"].isNotNull())


def normal_alias(alias: Column) -> Column:
    return F.lower(F.translate(alias, "-_", ".."))


def _section(text: str, start: int) -> str:
    """S-40: guess from 120 characters before a declaration and 60 from its start."""
    seg = text[max(0, start - 120) : start + 60].lower()
    return "test" if "testimplementation" in seg or "androidtest" in seg else "build" if "classpath" in seg else "producción"


def _read_marked(texts: pa.Array, shape: re.Pattern) -> pa.Array:
    """Groups and section of every match of each marked text; between and match take turns in it."""
    rows, ends = [], [0]
    for text in texts.to_pylist():
        pieces = [] if text is None else text.split(MARK)
        bare, start = "".join(pieces), 0
        for i, piece in enumerate(pieces):
            if i % 2:
                rows.append((*shape.match(piece).groups(""), _section(bare, start)))
            start += len(piece)
        ends.append(len(rows))
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(shape.groups + 1)]
    names = [*(f"g{i}" for i in range(1, shape.groups + 1)), "section"]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names), mask=texts.is_null())


def _declarations(raw: Column, pattern: str, groups: int, build) -> Column:
    """All matches of a declaration shape, as ``build(groups, section)``.

    One pass puts marks around the matches; a batch of marked texts is then read at once. ``raw`` has no marks of its own.
    """
    insensitive = "(?i)" + pattern
    shape = re.compile(insensitive, re.ASCII)
    fields = [f"g{i}" for i in range(1, groups + 1)]

    @F.arrow_udf(f"array<struct<{','.join(f'{f}:string' for f in [*fields, 'section'])}>>")
    def read(texts: pa.Array) -> pa.Array:
        return _read_marked(texts, shape)

    marked = F.regexp_replace(raw, insensitive, MARK + "$0" + MARK)
    return F.transform(read(marked), lambda z: build([z[f] for f in fields], z["section"]))


def _assigned(raw: str) -> dict[str, str]:
    """``assigned_versions`` of one text; a later assignment wins."""
    out = {}
    parts = raw.split("=")
    for left, right in zip(parts, parts[1:]):
        value = ASSIGNED.match(right)
        if value and value[1][0] in "0123456789":
            word = LAST_WORD.match(left[::-1])
            name = word and NAME.search(word[1][::-1])
            if name:
                out[name[1]] = value[1]
    return out


def _catalogue(lines: list[str]) -> dict[str, str]:
    """``toml_versions`` of the lines of that section."""
    return {m[1]: m[2] for m in map(CATALOGUE_VERSION.match, lines) if m}


def _libraries(lines: list[str], variables: dict[str, str]) -> dict[str, tuple]:
    """``library_table`` of the lines of that section, by alias: group, artifact, version."""
    out = {}
    for line in lines:
        left, equals, right = line.partition("=")
        if not equals or line.strip(WHITESPACE).startswith("#"):
            continue
        rhs = right.strip(WHITESPACE)
        module, short = MODULE.search(rhs), SHORT.search(rhs)
        group, artifact, literal, reference = (m and m[1] for m in (shape.search(rhs) for shape in LIBRARY_FIELDS))
        coordinate = module.groups() if module else (group, artifact) if group and artifact else short.groups() if short else None
        if coordinate:
            version = variables.get(reference, variables.get(f"libs.versions.{reference}")) if reference else literal
            out[_alias(left.strip(WHITESPACE).strip('"'))] = (*coordinate, version)
    return out


def _alias(name: str) -> str:
    return name.replace("-", ".").replace("_", ".").lower()


def _found(text: str | None, shape: re.Pattern) -> Iterator[tuple]:
    """Groups and section of every match of a marked text; between and match take turns in it."""
    if text is None or MARK not in text:
        return
    pieces = text.split(MARK)
    bare, start = "".join(pieces), 0
    for i, piece in enumerate(pieces):
        if i % 2:
            yield (*shape.match(piece).groups(""), _section(bare, start))
        start += len(piece)


def _declared(marked: list[str | None], versions: list[str], libraries: list[str]) -> dict[str, tuple]:
    """Declared coordinates of one manifest by key: group, artifact, version, section, package, interpolated; the first one wins."""
    out: dict[str, tuple] = {}
    catalogue = _catalogue(versions)
    variables = _assigned((marked[0] or "").replace(MARK, "")) | {f"libs.versions.{k}": v for k, v in catalogue.items()} | catalogue
    for text, shape in zip(marked[:2], SHAPES[:2]):
        for group, artifact, given, section in _found(text, shape):
            version, placeholder = given or None, INTERPOLATED.search(given)
            if placeholder:
                key = placeholder[1]
                segment = key.rpartition(".")[2]
                version = next((variables[k] for k in (key, segment, f"libs.versions.{segment}") if k in variables), None)
            name = f"{group}:{artifact}"
            out.setdefault(name, (group, artifact, version, section, name, placeholder is not None and version is None))
    for group, artifact, section in _found(marked[2], SHAPES[2]):
        name = f"{group}:{artifact}"
        out.setdefault(name, (group, artifact, None, section, name, False))
    known = None
    for alias, section in _found(marked[3], SHAPES[3]):
        known = _libraries(libraries, variables) if known is None else known
        hit = known.get(_alias(alias))
        if hit:
            name = f"{hit[0]}:{hit[1]}"
            out.setdefault(name, (*hit, section, name, hit[2] is None))
        else:
            out.setdefault(f"libs:{alias}", ("libs", alias, None, section, f"libs.{alias}", True))
    return out


DECLARED = pa.schema([*((x, pa.string()) for x in ("group", "artifact", "version", "section", "package")), ("interpolated", pa.bool_())])


@lru_cache(maxsize=1)
def _read_manifests():
    @F.arrow_udf("array<struct<group:string,artifact:string,version:string,section:string,package:string,interpolated:boolean>>")
    def read(coordinate: pa.Array, named: pa.Array, bare: pa.Array, alias: pa.Array, versions: pa.Array, libraries: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for *marked, v, l in zip(*(x.to_pylist() for x in (coordinate, named, bare, alias, versions, libraries)), strict=True):
            rows += _declared(marked, v or (), l or ()).values()
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [()] * len(DECLARED)
        arrays = [pa.array(x, f.type) for x, f in zip(columns, DECLARED, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(DECLARED)))

    return read


def dependencies(manifests: DataFrame) -> DataFrame:
    """S-39, U-02, W-07: declared coordinates of each manifest, the first declaration of a coordinate wins.

    ``manifests(project_id, content, toml)``. Branch order: full coordinate, named, without version, catalogue alias. One pass for each
    shape puts marks around its matches; a batch of marked texts and catalogue lines is then read and resolved at once.
    """
    bare = F.replace(strip_comments(F.coalesce("content", F.lit(""))), F.lit(MARK), F.lit(STAND_IN))
    prepared = manifests.select("*", bare.alias("_raw"))
    marked = [F.regexp_replace("_raw", "(?i)" + shape, MARK + "$0" + MARK) for shape in (COORDINATE, NAMED, NO_VERSION, ALIAS)]
    marked[3] = F.when(F.coalesce("toml", F.lit("")) != "", marked[3])
    sections = [F.when(F.col("toml").isNotNull(), toml_section(F.col("toml"), name)) for name in ("versions", "libraries")]
    found = prepared.select("project_id", F.posexplode(_read_manifests()(*marked, *sections)).alias("ord", "d"))
    return found.select("project_id", "ord", "d.group", "d.artifact", "d.version", "d.section", "d.package", "d.interpolated")


def unresolved_aliases(manifests: DataFrame) -> DataFrame:
    """Manifests that use catalogue aliases but came without their catalogue."""
    raw = strip_comments(F.coalesce("content", F.lit("")))
    return manifests.where((F.coalesce("toml", F.lit("")) == "") & raw.rlike("(?i)" + ALIAS)).select("project_id")


def dependency_entries(deps: DataFrame) -> DataFrame:
    """Declared coordinates as audit entries."""
    return deps.select(
        "project_id",
        "ord",
        "section",
        "package",
        "group",
        "artifact",
        F.coalesce("version", F.lit("(de catálogo/BOM)")).alias("spec"),
        F.col("version").alias("installed"),
        (F.col("version").isNotNull() & ~F.col("interpolated")).alias("pinned"),
        F.when(F.col("interpolated") & F.col("version").isNull(), UNRESOLVED_NOTE).alias("note"),
        F.lit("Maven").alias("ecosystem"),
        maven_link(F.col("group"), F.col("artifact")).alias("npm_url"),
        F.lit(EOL_TEXT).alias("eol_info"),
        F.lit(None).cast("string").alias("description"),
    )


def with_newest(entries: DataFrame, newest: DataFrame) -> DataFrame:
    """J-05 for artefacts: ``newest(group, artifact, latest, latest_origin, lookup_error)``, one row per artefact."""
    from ..plans.skew import lookup_join

    joined = lookup_join(entries, newest, ["group", "artifact"])
    error = F.col("lookup_error")
    note = F.when(error == "neterror", "neterror").when(
        F.coalesce("latest", F.lit("")) == "",
        F.coalesce(F.col("note"), F.lit("no encontrado en Maven Central ni Google Maven")),
    ).otherwise(F.col("note"))
    gap = F.when(~error.eqNullSafe("neterror"), digit_gap(F.col("installed"), F.col("latest")))
    return (
        joined.withColumn("note", note)
        .withColumn("gap", gap)
        .withColumn("outdated", F.when(F.col("latest").isNotNull(), F.col("gap").isNotNull()))
        .drop("lookup_error")
    )


# ---- platform


def platform_versions(content: Column, extra: Column, variables: Column) -> Column:
    """S-41: STRUCT of the declared platform versions; missing ones are null."""
    nonempty = lambda c: F.when(c != "", c)
    blob = F.concat_ws("\n", nonempty(content), nonempty(extra))

    def read(b: Column) -> Column:
        first = lambda pattern: let(F.regexp_extract(b, "(?i)" + pattern, 1), blank_to_null)
        sdk = {k: first(k + r"""(?:Version)?\s*[=\s]\s*["']?(\d{1,2})["']?""") for k in SDK_KINDS}
        agp = F.coalesce(*[first(p) for p in AGP_SHAPES], *[_last(variables, F.lit(v)) for v in AGP_VARIABLES])
        return F.struct(*[c.alias(k) for k, c in sdk.items()], agp.alias("AGP"), first(WRAPPER).alias("Gradle"))

    return let(blob, read)


def platform_entries(manifests: DataFrame) -> DataFrame:
    """Assessed platform rows. ``manifests(project_id, content, toml, extra)``; without ``extra`` the catalogue is read."""
    variables = version_variables(strip_comments(F.coalesce("content", F.lit(""))), F.col("toml"))
    extra = F.coalesce(F.when(F.col("extra") != "", F.col("extra")), F.col("toml"))
    p = manifests.select("project_id", platform_versions(F.col("content"), extra, variables).alias("p"))
    rows = F.array(
        *[assess_sdk(k, F.col("p")[k]) for k in SDK_KINDS], *[assess_tool(k, F.col("p")[k]) for k in ("AGP", "Gradle")]
    )
    opened = p.select("project_id", F.explode(F.array_compact(rows)).alias("e")).select("project_id", "e.*")
    return opened.select(
        "*",
        F.lit("plataforma").alias("section"),
        F.lit(True).alias("pinned"),
        F.col("gap").isNotNull().alias("outdated"),
        F.lit(0).cast("bigint").alias("vuln_count"),
        F.lit("Android Platform").alias("ecosystem"),
    ).withColumnRenamed("range", "spec").withColumnRenamed("url", "npm_url")


# ---- plugins


def plugin_table(toml: Column) -> Column:
    """Plugins of the catalogue: key, id, version reference and literal."""
    pattern = r"^\s*([\w\-]+)\s*=\s*(.+)"

    def plugin(line: Column) -> Column:
        return let(
            F.regexp_extract(line, pattern, 2),
            lambda rhs: F.struct(
                F.regexp_extract(line, pattern, 1).alias("name"),
                blank_to_null(F.regexp_extract(rhs, r"""id\s*=\s*["']([\w.\-]+)["']""", 1)).alias("id"),
                blank_to_null(F.regexp_extract(rhs, r"""version\.ref\s*=\s*["']([\w\-]+)["']""", 1)).alias("ref"),
                blank_to_null(F.regexp_extract(rhs, r"""version\s*=\s*["']([\w.\-]+)["']""", 1)).alias("literal"),
            ),
        )

    return F.transform(F.filter(toml_section(toml, "plugins"), lambda l: l.rlike(pattern)), plugin)


def plugins(manifests: DataFrame) -> DataFrame:
    """S-42 and J-12: plugin ids and versions. A later declaration of an id wins; here a literal beats a reference."""
    nonempty = lambda name: F.when(F.col(name) != "", F.col(name))
    blob = F.concat_ws("\n", nonempty("content"), nonempty("extra"))
    p = manifests.select(
        "project_id",
        blob.alias("_blob"),
        plugin_table(F.col("toml")).alias("_table"),
        toml_versions(F.col("toml")).alias("_versions"),
    )
    text, table, versions = F.col("_blob"), F.col("_table"), F.col("_versions")
    kotlin = F.transform(
        _pairs(text, "(?i)" + PLUGIN_KOTLIN),
        lambda x: F.struct(F.concat(F.lit("org.jetbrains.kotlin."), x["name"]).alias("name"), x["value"].alias("value")),
    )

    def aliased(name: Column) -> Column:
        last = lambda key: let(F.filter(table, lambda e: e["name"] == key), lambda hits: F.get(hits, F.size(hits) - 1))
        known = lambda e: F.struct(
            e["id"].alias("name"), F.coalesce(e["literal"], _last(versions, e["ref"])).alias("value")
        )
        missing = F.struct(F.concat(F.lit("libs.plugins."), name).alias("name"), F.lit(None).cast("string").alias("value"))
        entry = F.coalesce(last(name), last(F.replace(name, F.lit("."), F.lit("-"))))
        return let(entry, lambda e: F.when(e["id"].isNotNull(), known(e)).otherwise(missing))

    aliases = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + PLUGIN_ALIAS), F.lit(1)), aliased)
    found = F.concat(_pairs(text, "(?i)" + PLUGIN_ID), kotlin, aliases)
    # The last of equal ids is the first one when read backwards.
    last_only = lambda rows: let(
        F.transform(rows, lambda r: r["name"]),
        lambda names: F.filter(rows, lambda r, i: F.array_position(names, r["name"]) == i + 1),
    )
    opened = p.select("project_id", F.explode(let(F.reverse(found), last_only)).alias("e"))
    return opened.select("project_id", F.col("e.name").alias("plugin_id"), F.col("e.value").alias("version"))


def plugin_entries(found: DataFrame) -> DataFrame:
    """Plugins as audit entries."""
    alias = F.col("plugin_id").startswith("libs.plugins.")
    versioned = F.coalesce("version", F.lit("")) != ""
    return found.select(
        "project_id",
        F.col("plugin_id").alias("package"),
        F.lit("plugin").alias("section"),
        F.when(versioned, F.col("version")).otherwise("(sin versión)").alias("spec"),
        F.col("version").alias("installed"),
        versioned.alias("pinned"),
        F.lit(0).cast("bigint").alias("vuln_count"),
        F.lit("Gradle Plugin").alias("ecosystem"),
        plugin_link(F.col("plugin_id"), ~alias & versioned).alias("npm_url"),
        F.lit("Plugin").alias("platform_kind"),
        F.when(alias, "desconocido").otherwise("ok").alias("platform_level"),
        F.when(
            alias,
            "Plugin declarado por alias del catálogo de versiones; sube libs.versions.toml para resolver su id y versión.",
        )
        .when(~versioned, "Plugin declarado sin versión explícita (heredada del catálogo o del classpath).")
        .otherwise(F.concat(F.lit("Plugin de Gradle declarado en versión "), F.col("version"), F.lit(".")))
        .alias("platform_note"),
        F.when(alias | ~versioned, "Resolver vía libs.versions.toml para auditar su versión.")
        .otherwise("Mantener el plugin al día con su proveedor.")
        .alias("platform_reco"),
        F.lit("Plugin de Gradle: sin EOL formal (regir por releases).").alias("eol_info"),
    )


def section_kind(section: Column) -> Column:
    """F-09: platform, plugin or dependency."""
    return F.when(section == "plataforma", "platform").when(section == "plugin", "plugin").otherwise("dependency")


def audit_gradle(manifests: DataFrame, newest: DataFrame, by_version: DataFrame) -> DataFrame:
    """U-04: platform, plugin and dependency entries of each manifest, audited."""
    from .audit import with_compliance, with_vulnerabilities

    deps = with_newest(dependency_entries(dependencies(manifests)), newest)
    deps = with_vulnerabilities(deps, by_version, "Maven").withColumn("description", F.col("package"))
    deps = with_compliance(deps)
    return (
        platform_entries(manifests)
        .unionByName(plugin_entries(plugins(manifests)), allowMissingColumns=True)
        .unionByName(deps, allowMissingColumns=True)
    )


def component_counts(entries: DataFrame) -> DataFrame:
    """A-28: components per project, manifest type and manifest, with totals. ``entries`` has ``kind`` and ``path``."""
    rolled = entries.rollup("project_id", "kind", "path").agg(F.count("*").alias("components"), F.grouping_id().alias("_id"))
    return rolled.where(F.col("_id").isin(0, 1, 3)).select(
        "project_id",
        F.when(F.col("_id") == 0, "manifest").when(F.col("_id") == 1, "type").otherwise("total").alias("of"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("path", F.lit("")).alias("path"),
        "components",
    )
