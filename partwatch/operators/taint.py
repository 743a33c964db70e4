"""Untrusted data to sensitive operations inside one file (W-11, J-18, J-19, J-23, X-02).

A file is one row, so its pass needs no shuffle: column functions pick the lines that assign or use something, and a dictionary of
names is carried over them in the order of lines.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import let, lookup, split_lines

# Sources, sinks and their labels, patterns, severity and controls of a flow.
SOURCES = (
    (r"getIntent\(\)|getStringExtra|getSerializableExtra|extras?\.get", "intent/extras de Android"),
    (r"getText\(\)|\.text\b|editText", "campo de texto de la interfaz"),
    (r"getParameter|getQueryString|request\.|req\.(query|body|params)", "parámetro de petición HTTP"),
    (r"location\.(search|hash|href)|document\.URL|window\.name", "URL/entorno del navegador"),
    (r"readLine\(\)|Scanner\(|input\(\)|argv", "entrada estándar / argumentos"),
    (r"Uri\.parse|getData\(\)", "URI entrante"),
)
SINKS = (
    (r"rawQuery\(|execSQL\(|\.query\(|createStatement\(|executeQuery\(", "consulta SQL", "CWE-89"),
    (
        r"Runtime\.getRuntime\(\)\.exec|ProcessBuilder|Runtime\.exec|os\.system|subprocess\.",
        "ejecución de comando",
        "CWE-78",
    ),
    (r"loadUrl\(|loadData\(|loadDataWithBaseURL\(|evaluateJavascript\(", "carga en WebView", "CWE-749"),
    (r"\beval\(|new Function\(|setInnerHTML|innerHTML\s*=", "evaluación dinámica / DOM", "CWE-95"),
    (r"Log\.[vdiwe]\(|console\.log\(|println\(|System\.out", "registro/log", "CWE-532"),
    (r"new File\(|FileOutputStream\(|openFileOutput\(|fopen\(", "ruta de archivo", "CWE-22"),
)
ASSIGNMENT = (
    r"^\s*(?:val|var|let|const|final|String|int|var|def)?\s*([A-Za-z_]\w*)\s*(?::[^=]+)?=\s*(.+)$"
)
IDENTIFIER = r"[A-Za-z_]\w*"
FLOW_SEVERITY = {
    "CWE-89": "alto",
    "CWE-78": "crítico",
    "CWE-749": "alto",
    "CWE-95": "alto",
    "CWE-532": "medio",
    "CWE-22": "medio",
}
FLOW_CONTROLS = {
    "CWE-89": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-78": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-749": ("D7-A8-PROTECCION-DATOS",),
    "CWE-95": ("D7-A8-PROTECCION-DATOS",),
    "CWE-532": ("D9-A13-TRAZABILIDAD", "D7-A8-REGISTRO-EVENTOS"),
    "CWE-22": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
}
FLOW_GUIDE = (
    "El análisis de flujo de datos detectó una ruta potencialmente explotable; validar y sanear la entrada antes del "
    "sumidero."
)
FLOW_LEGAL = "A verificar contra el marco aplicable (no es asesoría legal)."
FLOW_MITIGATION = (
    "Sanear/validar la entrada y usar API seguras (consultas parametrizadas, escape, listas de permitidos) en el "
    "sumidero."
)
STATE = "array<struct<name:string,line:int,label:string>>"
# Files whose picked lines are Python values at the same time.
FILES = 256


def _source_label(text: Column) -> Column:
    label = None
    for pattern, name in SOURCES:
        label = (F.when if label is None else label.when)(text.rlike("(?U)" + pattern), name)
    return label


def _assignments(lines: Column) -> Column:
    """Assignments of a file: ARRAY<STRUCT<line, name, rhs, label>>; the label is set when the right side is a source."""
    numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    pattern = "(?U)" + ASSIGNMENT
    assigned = F.filter(numbered, lambda n: n["text"].contains("=") & n["text"].rlike(pattern))
    split = F.transform(
        assigned,
        lambda n: F.struct(
            n["line"].alias("line"),
            F.regexp_extract(n["text"], pattern, 1).alias("name"),
            F.regexp_extract(n["text"], pattern, 2).alias("rhs"),
        ),
    )
    return F.transform(
        split,
        lambda a: F.struct(
            a["line"].alias("line"), a["name"].alias("name"), a["rhs"].alias("rhs"), _source_label(a["rhs"]).alias("label")
        ),
    )


def _sink_lines(lines: Column) -> Column:
    """Lines that hold a sensitive operation: ARRAY<STRUCT<line, text, kinds>>, the kinds as places in ``SINKS``."""
    kinds = lambda t: F.filter(
        F.array(*[F.when(t.rlike("(?U)" + pattern), F.lit(kind)) for kind, (pattern, _, _) in enumerate(SINKS)]), lambda k: k.isNotNull()
    )
    numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), kinds(t).alias("kinds")))
    return F.filter(numbered, lambda n: F.size(n["kinds"]) > 0)


class FileTrace:
    """Names of one file that hold untrusted data: by name the turn in which it was first tainted, line and label of its source.

    Names keep their turn and are never cleared. Every step costs the identifiers of its own line.
    """

    def __init__(self):
        self.names: dict[str, tuple[int, int, str]] = {}

    def _first(self, text: str, usable) -> tuple[int, int, str, str] | None:
        """The name of the text that was tainted first, of those that are usable."""
        known = self.names
        return min(((*known[n], n) for n in set(IDENTIFIERS(text)) if n in known and usable(n)), default=None)

    def assign(self, line: int, name: str, rhs: str, label: str | None) -> None:
        if label is None:
            origin = self._first(rhs, lambda n: n != name)
            if origin is None:
                return
            line, label = origin[1], origin[2]
        turn = self.names[name][0] if name in self.names else len(self.names)
        self.names[name] = (turn, line, label)

    def flow(self, line: int, text: str, kind: int) -> dict | None:
        """The path into one kind of sink on a line: from the name tainted first of those tainted at or before it."""
        found = self._first(text, lambda n: self.names[n][1] <= line)
        if found is None:
            return None
        _, source_line, label, name = found
        _, sink, cwe = SINKS[kind]
        return {"source": label, "source_line": source_line, "name": name, "sink": sink, "sink_line": line, "cwe": cwe, "kind": kind}

    def state(self) -> list[dict]:
        return [{"name": n, "line": line, "label": label} for n, (_, line, label) in self.names.items()]


IDENTIFIERS = re.compile(IDENTIFIER).findall
STATE_ARROW = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("label", pa.string())]))
FLOWS_ARROW = pa.list_(
    pa.struct(
        [("source", pa.string()), ("source_line", pa.int32()), ("name", pa.string()), ("sink", pa.string()), ("sink_line", pa.int32()), ("cwe", pa.string()), ("kind", pa.int32())]
    )
)
FLOW_DDL = "source string, source_line int, name string, sink string, sink_line int, cwe string, kind int"
FLOWS = f"array<struct<{FLOW_DDL}>>"


def picked_lines(text: Column, whole: bool = True) -> Column:
    """What a pass over a file needs: ``assigned`` and ``sinks``. Both are null for a ``whole`` file without a source: no name is tainted there."""

    def picked(lines: Column, assigned: Column) -> Column:
        sourced = F.exists(assigned, lambda a: a["label"].isNotNull()) if whole else F.lit(True)
        return F.struct(F.when(sourced, assigned).alias("assigned"), F.when(sourced, _sink_lines(lines)).alias("sinks"))

    return let(split_lines(F.coalesce(text, F.lit(""))), lambda lines: let(_assignments(lines), lambda a: picked(lines, a)))


def traced_stream(batches):
    """Flows of picked lines in order of file, turn (assignments, then sinks) and line; a file may go on over many batches."""
    file, own = None, FileTrace()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["project_id"], row["path"]) != file:
                file, own = (row["project_id"], row["path"]), FileTrace()
            if row["turn"] == 0:
                own.assign(row["line"], row["name"], row["text"], row["label"])
            elif own.names:
                flows = [own.flow(row["line"], row["text"], k) for k in row["kinds"]]
                out += [{"project_id": file[0], "path": file[1], **f} for f in flows if f]
        schema = pa.schema([("project_id", pa.string()), ("path", pa.string()), *FLOWS_ARROW.value_type])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def traced_files(files: DataFrame) -> DataFrame:
    """W-11, J-23: per code file ``state``, the names tainted at its end in the order they were first tainted, and ``flows``, for each line and kind of
    sink the first tainted name that the line uses.

    Assignments and sink lines are picked out by column functions; only they go to a pass over the file with a dictionary of its
    names, so the time follows the length of the file. Files that are no code have no row; a null text has no names.
    """
    code = files.where(st.extension(F.col("path")).isin(*st.CODE_EXTENSIONS))
    rows = code.select("project_id", "path", picked_lines(F.col("text")).alias("p")).select("project_id", "path", "p.assigned", "p.sinks")

    def trace(batches):
        for batch in batches:
            for first in range(0, len(batch), FILES):
                part = batch.slice(first, FILES)
                states, flows = [], []
                for assigned, sinks in zip(part["assigned"].to_pylist(), part["sinks"].to_pylist(), strict=True):
                    own = FileTrace()
                    for a in assigned or ():
                        own.assign(a["line"], a["name"], a["rhs"], a["label"])
                    found = [own.flow(s["line"], s["text"], k) for s in (sinks or ()) if own.names for k in s["kinds"]]
                    states.append(own.state())
                    flows.append(sorted((f for f in found if f), key=lambda f: (f["kind"], f["sink_line"])))
                columns = [part["project_id"], part["path"], pa.array(states, STATE_ARROW), pa.array(flows, FLOWS_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, names=["project_id", "path", "state", "flows"])

    kind = files.schema["project_id"].dataType.simpleString()
    return rows.mapInArrow(trace, f"project_id {kind}, path string, state {STATE}, flows {FLOWS}")


def flow_paths(files: DataFrame) -> DataFrame:
    """Flow paths of every code file, one row each; ``kind`` is the position of the sink in ``SINKS``."""
    return traced_files(files).select("project_id", "path", F.explode("flows").alias("f")).select("project_id", "path", "f.*")


def flow_controls(cwe: Column) -> Column:
    """J-17 for flows: the controls that a kind of flow is traced to; none for an unknown one."""
    pairs = [x for k, v in FLOW_CONTROLS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cwe), F.array().cast("array<string>"))


def first_flow(flows: DataFrame) -> DataFrame:
    """The first path per file and sink line."""
    rest = [c for c in flows.columns if c not in ("project_id", "path", "sink_line")]
    return (
        flows.groupBy("project_id", "path", "sink_line")
        .agg(F.min_by(F.struct(*rest, "sink_line"), "kind").alias("flow"))
        .withColumnRenamed("sink_line", "line")
    )


KEY = ["project_id", "path", "line", "_part"]


def _parted(findings: DataFrame) -> DataFrame:
    """Findings with a part that joins the flows. Those without a line lie on none: they are spread over parts that no flow has."""
    told = [c for c in ("ord", "rule_id", "evidence", "path") if c in findings.columns]
    return findings.withColumn("_part", F.when(F.col("line").isNull(), F.xxhash64(*told)).otherwise(F.lit(0).cast("bigint")))


def attach_flows(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """J-18: mark findings that lie on a reached sink. The findings are read once."""
    # A line holds few findings, so this key has no hot values.
    first = first_flow(flows).withColumn("_part", F.lit(0).cast("bigint"))
    joined = _parted(findings).join(first, KEY, "left").select(*findings.columns, "flow")
    return joined.withColumn("reachable", F.col("flow").isNotNull())


def with_flows(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """J-18 and J-19 together: the rows of ``attach_flows`` and ``unmatched_flows``, with findings and flows read once each."""
    first = first_flow(flows).withColumn("_part", F.lit(0).cast("bigint"))
    joined = _parted(findings).withColumn("_found", F.lit(True)).join(first, KEY, "full")
    own = _flow_findings()
    none = lambda c: F.lit(None).cast(findings.schema[c].dataType)
    kept = lambda c: F.col(c) if c in KEY else F.when(F.col("_found"), F.col(c)).otherwise(own.get(c, none(c))).alias(c)
    return joined.select(*[kept(c) for c in findings.columns], "flow", F.col("flow").isNotNull().alias("reachable"))


def unmatched_flows(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """J-19: flow paths on lines without a finding become findings of their own."""
    key = ["project_id", "path", "line"]
    alone = first_flow(flows).join(findings.select(*key).distinct(), key, "left_anti")
    texts = [v.alias(c) for c, v in _flow_findings().items()]
    return alone.select("project_id", *texts, "flow", F.lit(True).alias("reachable"))


def _flow_findings() -> dict[str, Column]:
    """Columns of a flow that is a finding of its own."""
    flow = F.col("flow")
    evidence = F.format_string(
        "%s (línea %d) alcanza el sumidero de %s a través de «%s».",
        flow["source"],
        flow["source_line"],
        flow["sink"],
        flow["name"],
    )
    return {
        "rule_id": F.concat(F.lit("TAINT-"), flow["cwe"]),
        "title": F.concat(F.lit("Flujo de datos no confiable hacia "), flow["sink"]),
        "category": F.lit("FLUJO DE DATOS"),
        "severity": F.coalesce(lookup(flow["cwe"], FLOW_SEVERITY), F.lit("medio")),
        "path": F.col("path"),
        "line": F.col("line"),
        "evidence": evidence,
        "guide": F.lit(FLOW_GUIDE),
        "legal": F.lit(FLOW_LEGAL),
        "cwe": flow["cwe"],
        "mitigation": F.lit(FLOW_MITIGATION),
        "engine": F.lit("taint"),
    }
