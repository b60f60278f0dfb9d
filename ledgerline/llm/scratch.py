"""Tables between jobs, counting sketches and connected components, shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_dir
from .text import mix, thrifty

FILTER_BITS = 20


def save(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(df: DataFrame) -> None:
    """Deletes what save() wrote for df."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash."""
    return [f.name for f in df.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]


def parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _cells(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(df: DataFrame, ids: Callable[[pa.RecordBatch], np.ndarray]) -> bytes:
    """A filter of fixed size (2**FILTER_BITS bits) that holds all the ids of df's batches, and by chance others."""

    @thrifty
    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_cells(ids(batch))] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"bits": pa.array([out.tobytes()], pa.binary())})

    rows = df.mapInArrow(mark, "bits binary").withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(16)))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows.groupBy("lot").applyInArrow(either, "bits binary").collect():  # 16 rows at most
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def in_filter(bits: bytes, ids: np.ndarray) -> np.ndarray:
    cell = _cells(ids)
    return (np.frombuffer(bits, np.uint8)[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (smallest node, node) that join what the edges a-b join."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


@thrifty
def _local(batches):
    """Edges of one task as stars, in bounded pieces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        held.clear()
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(x) for x, _ in held) > 2_000_000:
            yield out()
    if held:
        yield out()


def _finish(batches):
    """All remaining edges of a table of bounded size: (node, to) of every node."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        top = np.unique(a)
        yield pa.RecordBatch.from_pydict({"node": np.concatenate([b, top]), "to": np.concatenate([a, top])})


#: Edges, after contraction in the tasks that found them, that one task may join: 16 MB.
ONE_TASK = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long): (node, root), root the smallest node joined to it.

    Nodes without an edge are not listed. Tasks contract their own edges to forests. While more than ONE_TASK edges
    are left, a round hooks every node to its smallest neighbour, follows the pointers to their ends and
    contracts the edges, so nodes at least halve; groupings have partial sums and both sides of every join are
    stored tables, which lets Spark split a hub's rows. What is left at last is joined by one task.
    """
    spark = edges.sparkSession
    edges = save(edges.select("a", "b").mapInArrow(_local, "a long, b long").where("a <> b").distinct().mapInArrow(_local, "a long, b long"))
    roots: DataFrame | None = None
    while left_over := edges.count():
        if left_over <= ONE_TASK:
            hook = save(edges.coalesce(1).mapInArrow(_finish, "node long, to long"))
            rest = None
        else:
            hook, rest = _round(edges)
        if roots is None:
            roots = hook
        else:
            old, now = roots, hook.toDF("root_", "to_")
            roots = save(old.join(now, old["to"] == now["root_"], "left").select("node", F.coalesce("to_", "to").alias("to")))
            free(old), free(hook)
        free(edges)
        if rest is None:
            break
        edges = rest
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots.select("node", F.col("to").alias("root"))


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (node, to) of every node, and the edges between different ends."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")))
    while True:  # pointer jumping; `to` is always a node of hook
        jump = hook.select(F.col("node").alias("via"), F.col("to").alias("end"))
        new = save(hook.join(jump, hook["to"] == jump["via"]).select("node", F.col("end").alias("new"), "to"))
        done = new.where("new <> to").isEmpty()
        free(hook)
        hook = new.select("node", F.col("new").alias("to"))
        hook._scratch_path = new._scratch_path
        if done:
            break
    left, right = hook.toDF("a", "ra"), hook.toDF("b", "rb")
    rest = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return hook, save(rest.mapInArrow(_local, "a long, b long").distinct())


def lots_of(spark: SparkSession) -> int:
    """Lots grow with the session's shuffle partitions."""
    return max(256, 4 * parts(spark))


def lot(hashed: Column, lots: int) -> Column:
    """A lot from 0 to lots - 1 that rises with a uniform 64-bit hash."""
    at = F.floor((hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(float(lots)))
    return F.least(at, F.lit(lots - 1)).cast("int")


def lot_bases(df: DataFrame, keys: list[str], hashed: str, value: str, lots: int) -> DataFrame:
    """(keys, __lot, __base): what all earlier lots of the same keys sum up to."""
    sums = df.groupBy(*keys, lot(F.col(hashed), lots).alias("__lot")).agg(F.sum(value).alias("__sum"))
    low = Window.partitionBy(*keys).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)  # at most `lots` rows a key
    return save(sums.withColumn("__base", F.coalesce(F.sum("__sum").over(low), F.lit(0)).cast("long")).drop("__sum"))


def offsets(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, base: DataFrame, lots: int) -> DataFrame:
    """df with column out: the sum of value over the rows of the same keys that come earlier in the order.

    order[0] is a uniform 64-bit hash. Rows are dealt into lots by its high bits; base = lot_bases() of these rows, or
    of the same keys, hashes and values without df's other columns; and a window runs inside each lot only, so a hot
    key's rows are never in one task.
    """
    df = df.withColumn("__lot", lot(F.col(order[0]), lots))
    same = F.lit(True)
    for c in [*keys, "__lot"]:
        same = same & df[c].eqNullSafe(base[c])
    inner = Window.partitionBy(*keys, "__lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(base, same, "inner").select(*[df[c] for c in df.columns], "__base")
    return df.withColumn(out, (F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")).drop("__lot", "__base")
