"""Embedding near-dedup: cells of spherical k-means, blocked cosine products, one representative per group.

Cells lose no pair. If x lies in cell c, y in cell c', and both are within the angle of the threshold, then y is on the far side of the
plane halfway between the two centres, so x is at most the chord of that angle in front of it. A vector therefore also
visits each later cell whose plane is that near. The number of cells is the largest at which a vector makes few visits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, durable

# Distinct vectors that centres are fitted on, the most cells, and the mean visits a vector may make.
FIT_ROWS = 8_192
MAX_CELLS = 1_024
MAX_VISITS = 4.0
# Vectors of a block: a task compares two blocks at a time.
BLOCK = 384


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions in double precision, also of very long and very short vectors."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres: those of the vectors with the greatest cosine to them, from ``k`` spread-out starts."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1)
        some = length > 1e-12
        centres = np.where(some[:, None], sums / np.where(some, length, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def places(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which later cells it visits."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    ahead = near[np.arange(len(x)), home][:, None] - near
    visits = ahead <= apart[home] * reach + 1e-9
    visits &= np.arange(len(centres)) > home[:, None]
    return home, visits


def fit(x: np.ndarray, reach: float) -> np.ndarray:
    """The most centres at which vectors of the sample make at most ``MAX_VISITS`` visits on average."""
    centres, k = x[:1], 2
    while k <= min(MAX_CELLS, len(x)):
        now = spherical_kmeans(x, k)
        if places(x, now, reach)[1].sum() > MAX_VISITS * len(x):
            break
        centres, k = now, 2 * k
    return centres


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def lowest_reachable(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column of a block reaches by its links."""
    far = np.iinfo(np.int64).max
    rows, cols = left.copy(), right.copy()
    while True:
        new_rows = np.minimum(rows, np.where(linked, cols[None, :], far).min(axis=1, initial=far))
        new_cols = np.minimum(cols, np.where(linked, new_rows[:, None], far).min(axis=0, initial=far))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def near_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """Vectors of one label linked where their cosine, in double precision, is ``threshold`` (above 0) or more.

    Returns ``id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable by links) and ``kept``
    (it is its own component). Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or
    id, and vectors of different lengths link with nothing; such a row is its own component (null for a null id). Ids are
    integers; equal vectors of a label are one row of the comparison and count as links of each other, whatever their
    number; rows that repeat an id count as vectors of their own. An empty table gives no rows; other columns are ignored.

    Centres are fitted on at most about ``FIT_ROWS`` distinct vectors; all others are compared through the cells, exactly.
    """
    spark = vectors.sparkSession
    kind = "double" if vectors.schema[vector_col].dataType == T.ArrayType(T.DoubleType()) else "float"
    packed = np.float64 if kind == "double" else np.float32
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("vector"),
        F.col(f"`{label_col}`").alias("label"),
    )
    usable = rows.where(_usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = durable(
        usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("dim", F.size("vector"))
    )
    number = classes.count()
    reach = float(np.sqrt(2 - 2 * threshold))
    centres = _centres(classes, number, reach)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                values = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = unit(values.astype(np.float64))
                own = shared.value.get(int(dim))
                home, visits = places(x, own if own is not None else x[:1], reach)
                guest, cell = np.nonzero(visits)
                at = np.concatenate((np.arange(len(x)), guest))
                data = [v.tobytes() for v in values.astype(packed)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": part["label"].take(pa.array(at)),
                        "dim": pa.array(np.full(len(at), dim), pa.int32()),
                        "cell": pa.array(np.concatenate((home if own is not None else np.zeros(len(x), int), cell)), pa.int32()),
                        "visitor": pa.array(np.arange(len(at)) >= len(x)),
                        "rep": part["rep"].take(pa.array(at)),
                        "size": part["size"].take(pa.array(at)),
                        "data": pa.array([data[i] for i in at], pa.binary()),
                    }
                )

    label = T.StructField("label", vectors.schema[label_col].dataType)
    schema = T.StructType([label, *T.StructType.fromDDL("dim int, cell int, visitor boolean, rep long, size long, data binary").fields])
    placed = durable(classes.mapInArrow(assign, schema))
    cell = ["label", "dim", "cell"]
    count = lambda visitor: F.ceil(F.count_if(F.col("visitor") == visitor) / BLOCK).cast("int")
    blocks = placed.groupBy(*cell).agg(count(False).alias("homes"), count(True).alias("guests"))
    dealt = placed.join(blocks, cell)
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    # A home block meets itself, the later home blocks and all guest blocks; a guest block meets all home blocks.
    partners = F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1)
    homes = F.sequence(F.lit(0), F.col("homes") - 1)
    dealt = dealt.withColumn("block", block).where("homes > 0").withColumn("other", F.explode(F.when(F.col("visitor"), homes).otherwise(partners)))
    me = F.col("block") + F.when(F.col("visitor"), F.col("homes")).otherwise(0)
    work = dealt.select(
        F.xxhash64(*cell, F.least(me, "other"), F.greatest(me, "other")).alias("task"),
        me.alias("block"),
        (me == F.col("other")).alias("alone"),
        "rep",
        "size",
        "data",
    )

    def compare(table):
        block = table["block"].to_numpy()
        low = block == block.min()
        x = unit(np.frombuffer(b"".join(table["data"].to_pylist()), packed).reshape(len(block), -1).astype(np.float64))
        rep, size = table["rep"].to_numpy(), table["size"].to_numpy()
        same = table["alone"][0].as_py()
        if low.all() and not same:  # the other block got no vectors
            return pa.table({n: pa.array([], pa.int64()) for n in ("rep", "links", "low")})
        left, right = (slice(None), slice(None)) if same else (low, ~low)
        linked = x[left] @ x[right].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        rows, cols = lowest_reachable(linked, rep[left], rep[right])
        ids, links, lows = rep[left], linked @ size[right], rows
        if not same:
            ids, links, lows = np.concatenate((ids, rep[right])), np.concatenate((links, linked.T @ size[left])), np.concatenate((lows, cols))
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "low": lows[some]})

    found = durable(work.groupBy("task").applyInArrow(compare, "rep long, links long, low long"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = classes.join(links, "rep", "left").join(groups, "rep", "left").select(
        "label",
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    id_type = vectors.schema[id_col].dataType
    joined = rows.withColumn("ok", _usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    alone = joined.where("NOT coalesce(ok, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    members = joined.where("ok").join(judged, ["label", "vector"]).select("id", "n_links", "component_id")
    return members.unionAll(alone).select(
        F.col("id").cast(id_type), "n_links", F.col("component_id").cast(id_type), (F.col("id") == F.col("component_id")).alias("kept")
    )


def _centres(classes: DataFrame, number: int, reach: float) -> dict[int, np.ndarray]:
    """Centres by vector length, of the vectors of each length in a sample of about ``FIT_ROWS``. One small task per length."""
    share = min(1.0, FIT_ROWS / max(1, number))
    sample = classes.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("dim", "rep", "vector")

    def learn(table):
        table = table.take(pa.array(np.argsort(table["rep"].to_numpy(), kind="stable")))
        dim = table["dim"][0].as_py()
        x = unit(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))
        found = fit(x, reach)
        return pa.table({"dim": pa.array([dim], pa.int32()), "centres": pa.array([found.tobytes()], pa.binary())})

    rows = sample.groupBy("dim").applyInArrow(learn, "dim int, centres binary").collect()
    return {r.dim: np.frombuffer(bytes(r.centres)).reshape(-1, r.dim) for r in rows}
