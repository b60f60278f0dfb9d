"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors with cosine t differ by sqrt(2 - 2t) at most, so on each
line they most likely lie in each other's window. On every line the members' projections are sorted, each query
takes the members inside its own window between two binary searches, and the lines on which a pair collides are
counted; pairs that reach a count calibrated for the wanted recall are verified by their exact cosine in double
precision. Windows follow each vector's own length, so vectors of any lengths share a table.

Windows of single lines hold a fixed share of all vectors, so counting over the whole table would be quadratic. The
table is therefore dealt into cells first: in each of several rounds the signs of a few other projections make a cell,
with more projections the larger the table, and enough rounds that a pair at the threshold shares a cell with the wanted
probability. A pair is taken in the first round whose cell it shares. Equal vectors are one class and are compared
once. A cell of many vectors is dealt into blocks, and every pair of its blocks is a task of bounded size; pairs never
leave a task, only link counts and spanning forests do.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
do vectors of other lengths than their partner's; rows with a null vec_id are left out; repeated rows are vectors
of their own, and link; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .scratch import components, forest, free, save
from .text import thrifty

LINES = 16
RECALL = 0.999
WIDTH = 2.6
_CELL = 1024
_BLOCK = 2048
_TILE = 256


def plan(rows: int, cosine: float, recall: float = RECALL, lines: int = LINES) -> dict:
    """Projections per cell, rounds and count for the wanted recall of each of the two steps."""
    same = 1 - math.acos(cosine) / math.pi  # the sign of a projection agrees
    bits = max(0, math.ceil(math.log2(max(rows, 1) / _CELL)))
    rounds = 1 if not bits else math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
    inside = math.erf(WIDTH / math.sqrt(2))
    at_least, tail = lines, 0.0
    while at_least > 0:  # the largest count that such a pair reaches with the wanted probability
        tail += math.comb(lines, at_least) * inside**at_least * (1 - inside) ** (lines - at_least)
        if tail >= recall:
            break
        at_least -= 1
    return {"bits": bits, "rounds": rounds, "count": at_least, "lines": lines, "cosine": cosine}


def window(dim: int, cosine: float) -> float:
    """Half a window for vectors of dim components: WIDTH deviations of a projected difference at the threshold."""
    return WIDTH * math.sqrt((2 - 2 * cosine) / dim)


@functools.lru_cache(64)
def _lines(dim: int, count: int, salt: int) -> np.ndarray:
    v = np.random.Generator(np.random.PCG64([dim, salt])).standard_normal((dim, count))
    return v / np.linalg.norm(v, axis=0)


@thrifty
def _clean(kind: str, batches):
    """Usable vectors as bytes of their own precision; others get null."""
    for batch in batches:
        out = []
        for x in batch.column(1).to_pylist():
            v = None if not x or None in x else np.array(x, np.float64)
            if v is None or not np.isfinite(v).all():
                out.append(None)
                continue
            top = np.abs(v).max()
            out.append(v.astype(kind).tobytes() if top > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(x: np.ndarray, p: dict, rounds: int) -> np.ndarray:
    """The sign cell of each vector in each of the first rounds."""
    if not p["bits"]:
        return np.zeros((len(x), rounds), np.int64)
    signs = x @ _lines(x.shape[1], p["bits"] * p["rounds"], 1)[:, : p["bits"] * rounds] >= 0
    return (signs.reshape(len(x), rounds, p["bits"]) << np.arange(p["bits"])).sum(2)


@thrifty
def _cells(p: dict, batches):
    """The cells of each vector, one a round, apart by the vectors' lengths."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        size = np.array([len(r) for r in raw])
        code = np.zeros((len(raw), p["rounds"]), np.int64)
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            code[some] = _codes(_unit([raw[i] for i in some], p["kind"]), p, p["rounds"])
        rest = [batch.column(i) for i in range(batch.num_columns)]
        cells = code * (1 << 24) + size[:, None]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])


def collisions(x: np.ndarray, order: np.ndarray, ranked: np.ndarray, half: float) -> np.ndarray:
    """How many lines hold each member (row) in the window of each query (column).

    x: the queries' projections (queries, lines); order, ranked: for every line the members in order of their projection,
    and these projections.
    """
    hits = np.zeros((len(order), len(x)), np.uint8)
    place = np.arange(len(order), dtype=np.uint16)[:, None]
    for line in range(x.shape[1]):
        low = np.searchsorted(ranked[:, line], x[:, line] - half, "left").astype(np.uint16)
        high = np.searchsorted(ranked[:, line], x[:, line] + half, "right").astype(np.uint16)
        inside = place - low < high - low  # unsigned: low <= place < high
        hits[order[:, line]] += inside.view(np.uint8)
    return hits


def near_pairs(x: np.ndarray, y: np.ndarray, p: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with enough collisions and cosine at the threshold; each pair once if same."""
    lines = _lines(x.shape[1], p["lines"], 2)
    half = window(x.shape[1], p["cosine"])
    px, py = x @ lines, y @ lines
    order = py.argsort(0, kind="stable")
    ranked = np.take_along_axis(py, order, 0)
    found = []
    for a in range(0, len(x), _TILE):
        ok = collisions(px[a : a + _TILE], order, ranked, half) >= p["count"]
        if same:
            ok &= np.arange(len(y))[:, None] < np.arange(a, a + ok.shape[1])
        j, i = np.nonzero(ok)
        if len(i) > ok.size // 8:
            cosine = (y @ x[a : a + _TILE].T)[j, i]
        else:
            cosine = np.concatenate([np.einsum("nd,nd->n", x[a + i[c : c + 65_536]], y[j[c : c + 65_536]]) for c in range(0, len(i), 65_536)] or [np.zeros(0)])
        near = cosine >= p["cosine"]
        found.append((a + i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(p: dict, table: pa.Table) -> pa.Table:
    """One pair of blocks of a cell: a forest of the links, and link counts by class."""
    block, vid, mult = (table.column(c).to_numpy() for c in ("g", "vid", "mult"))
    low, high, before = (table.column(c)[0].as_py() for c in ("lo", "hi", "round"))
    left, right = np.flatnonzero(block == high), np.flatnonzero(block == low)
    if not len(left) or not len(right):
        return _FOUND.empty_table()
    x = _unit(table.column("v").to_pylist(), p["kind"])
    i, j = near_pairs(x[left], x[right], p, low == high)
    i, j = left[i], right[j]
    if before and len(i):  # pairs that met in an earlier round are counted there
        met, index = np.unique(np.concatenate([i, j]), return_inverse=True)
        codes = _codes(x[met], p, before).astype(np.uint32)
        u, v = index[: len(i)], index[len(i) :]
        new = np.concatenate([~(codes[u[c : c + 65_536]] == codes[v[c : c + 65_536]]).any(1) for c in range(0, len(u), 65_536)])
        i, j = i[new], j[new]
    if not len(i):
        return _FOUND.empty_table()
    count = np.bincount(i, mult[j], len(vid)) + np.bincount(j, mult[i], len(vid))
    some = np.flatnonzero(count)
    a, b = forest(vid[i], vid[j])
    return pa.table([np.concatenate([a, vid[some]]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(some), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(count[some].astype(np.int64))])], schema=_FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == FloatType() else "<f8"
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    every = save(rows.mapInArrow(partial(_clean, kind), "vec_id long, v binary").withColumn("key", F.xxhash64("v")).withColumn("key2", F.crc32("v")))
    # equal vectors are one class, named by its smallest vec_id
    classes = save(every.where("v is not null").groupBy("v", "key", "key2").agg(F.min("vec_id").alias("vid"), F.count("*").alias("mult")))
    p = plan(classes.count(), cosine) | {"kind": kind}
    coded = save(classes.select("vid", "v", "mult").mapInArrow(partial(_cells, p), "vid long, v binary, mult long, cells array<long>"))
    meets = coded.select("vid", "v", "mult", F.posexplode("cells").alias("round", "cell"))
    cells = save(coded.select(F.posexplode("cells").alias("r", "c")).groupBy("r", "c").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / _BLOCK)).drop("count"))
    dealt = meets.join(cells, (meets["round"] == cells["r"]) & (meets["cell"] == cells["c"])).drop("r", "c")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("vid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("g", "other")).withColumn("hi", F.greatest("g", "other"))
    found = save(dealt.select("round", "cell", "lo", "hi", "g", "vid", "mult", "v").groupBy("round", "cell", "lo", "hi").applyInArrow(thrifty(lambda t: _compare(p, t)), "a long, b long, links long"))

    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    label = classes.select("key", "key2", "vid", "mult").join(roots, classes["vid"] == roots["node"], "left").join(links, classes["vid"] == links["of"], "left")
    label = save(label.select(F.col("key").alias("k"), F.col("key2").alias("k2"), F.coalesce("root", "vid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links")))
    for done in (coded, cells, found, classes):
        free(done)
    out = every.join(label, (every["key"] == label["k"]) & (every["key2"] == label["k2"]) & every["v"].isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
