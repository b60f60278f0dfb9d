"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of its documents' words in an order given by a seeded hash, cut into blocks of block_words
words. A source is drawn whole as often as its target allows, and then as many leading words of the stream as the
rest takes, so a document is cut only where a source's last draw ends, and a source's taken words are its target,
rounded. The drawn blocks are the source's exact quota; a seeded permutation of them deals them to shards. Quotas
are split over the output shards by a binary tree: each node gives its left half a multivariate-hypergeometric
sample of what it has, so that shards hold disjoint draws and each is a sample of the whole mix. Inside a shard
draws are ordered by a hash (a local shuffle). Texts cross the network twice: to their place in the stream's order,
and to their shard; a row is never looked up by its doc_id.

There is a shard for every SHARD_WORDS words of the mix, and at least one for each of the session's shuffle
partitions; which words are taken does not depend on their number. The driver holds one row a source (a mix is set up
by source) and one number for each source and shard.

Defined results: a null text has size 0 and gives nothing; a null source is a source of its own, after all
others; sources without words have target 0; repeated rows are documents of their own, each with its own draws; an
empty table gives an empty result; extra columns are ignored by draw() and kept by mixed(). Reruns agree.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import text as T
from .scratch import hashable, lot_bases, lots_of, offsets, parts, save

BLOCK_WORDS = 128
SHARD_WORDS = 1 << 28
SEED = 42
MOST = 3
_SAMPLED = 100_000_000  # the sampler takes fewer than 10**9 draws at once

PIECES = "array<struct<shard:int,place:long,pass:int,start:long,words:long>>"


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, none above most times its size; excess goes to the others by weight."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        free -= set(full)
    return out


def _sample(rng: np.random.Generator, have: np.ndarray, share: int, of: int) -> np.ndarray:
    """A multivariate-hypergeometric sample of share / of of all draws; draws beyond _SAMPLED go in equal lots."""
    lot = -(-int(have.sum()) // _SAMPLED)
    if lot > 1:
        return lot * _sample(rng, have // lot, share, of) + _sample(rng, have % lot, share, of)
    take = int(have.sum()) * share // of
    return rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas[s] draws of every source split over the shards: an array (shards, sources) with those column sums."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        mid = (low + high) // 2
        left = _sample(np.random.Generator(np.random.PCG64([seed, low, high])), have, mid - low, high - low)
        node(low, mid, left)
        node(mid, high, have - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def permuted(block: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A seeded bijection of 0..count-1, elementwise: a Feistel network walked until it is in range."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x = block.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> bits[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (T.mix(right + key[todo] + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) % 2**64)) & mask[todo])
        x[todo] = (left << bits[todo]) | right
        todo = todo[x[todo] >= count[todo].astype(np.uint64)]
    return x.astype(np.int64)


@T.thrifty
def _sizes(text_at: int, keep: bool, batches):
    """The rows with their number of words; without the text unless it is to be kept."""
    for whole in batches:
        for batch in T.pieces(whole, whole.schema.names[text_at]):
            data, ends = T.string_buffers(batch.column(text_at))
            _, _, first = T.word_spans(data, ends)
            cols = [batch.column(i) for i in range(batch.num_columns) if keep or i != text_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first), pa.int64())], names=[f"c{i}" for i in range(len(cols) + 1)])


def _draws(plan, batch: pa.RecordBatch, size: np.ndarray, low: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """The drawn pieces of a batch in order of row, pass and word: row, shard, place in it, pass, first word, words."""
    width, seed, total, wanted = plan["width"], plan["seed"], plan["size"], plan["words"]
    some = np.flatnonzero(size > 0)
    first, last = low[some] // width, (low[some] + size[some] - 1) // width
    count = last - first + 1
    doc = np.repeat(some, count)
    block = np.repeat(first, count) + T.ranges(count)
    begin = np.maximum(block * width, low[doc])
    end = np.minimum((block + 1) * width, low[doc] + size[doc])
    found = []
    for turn in range(MOST):
        limit = np.clip(wanted - turn * total, 0, total)[source[doc]]  # leading words of the stream in this pass
        on = np.flatnonzero(begin < limit)
        if not len(on):
            break
        d, s, most = doc[on], source[doc[on]], limit[on]
        spot = turn * -(-total[s] // width) + permuted(block[on], -(-most // width), T.mix((s + 1).astype(np.uint64) * np.uint64(1000003) + np.uint64(seed * 16 + turn)))
        shard = np.zeros(len(d), np.int64)
        order = np.argsort(s, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
            shard[mine] = np.searchsorted(plan["cut"][:, s[mine[0]]], spot[mine], "right")
        place = (T.mix(T.mix(spot.astype(np.uint64) + np.uint64(seed)) + s.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        found.append((d, shard, place, np.full(len(d), turn), begin[on] - low[d], np.minimum(end[on], most) - begin[on]))
    pieces = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
    order = np.lexsort((pieces[4], pieces[3], pieces[0]))
    return tuple(x[order] for x in pieces)


def _planned(docs: DataFrame, shards: int | None, seed: int, block_words: int):
    """The rows (doc_id, source, hashes, size) without texts, the plan, its sources by number, and the lots' sums."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    sized = save(rows.mapInArrow(partial(_sizes, 4, False), f"doc_id {kind}, source string, h long, t long, size long"))
    total = {r.source: r["sum"] for r in sized.groupBy("source").agg(F.sum("size").alias("sum")).collect()}  # a row a source
    names = sorted((x for x in total if x is not None)) + [None] * (None in total)  # by code point, null last
    size = np.array([total[x] for x in names], np.int64)
    target = np.array(targets(size.tolist(), [i % 3 + 1 for i in range(len(names))]), float)
    words = np.minimum(np.rint(target).astype(np.int64), MOST * size)
    shards = shards or max(parts(spark), -(-int(words.sum()) // SHARD_WORDS))
    quota = sum(-(-np.clip(words - turn * size, 0, size) // block_words) for turn in range(MOST))
    cut = np.cumsum(split(quota, shards, seed), axis=0) if len(names) else np.zeros((shards, 0), np.int64)
    plan = spark.sparkContext.broadcast({"width": block_words, "seed": seed, "size": size, "target": target, "words": words, "cut": cut})
    index = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "s string, source_index long")
    lots = lots_of(spark)
    return sized, plan, index, lot_bases(sized, ["source"], "h", "size", lots), lots


def draw(docs: DataFrame, shards: int | None = None, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, the pieces drawn (shard, place in it, pass, first word, words), source."""
    sized, plan, index, base, lots = _planned(docs, shards, seed, block_words)
    at = offsets(sized, ["source"], ["h", "doc_id", "t"], "size", "low", base, lots)
    at = at.join(index, at["source"].eqNullSafe(index["s"])).select("doc_id", "source", "size", "low", "source_index")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @T.thrifty
    def run(batches):
        for batch in batches:
            size, low, source = (batch.column(i).to_numpy() for i in (2, 3, 4))
            held = plan.value
            row, *piece = _draws(held, batch, size, low, source)
            taken = np.bincount(row, piece[-1], minlength=len(size)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
            fields = zip(piece, ("shard", "place", "pass", "start", "words"), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)
            values = pa.StructArray.from_arrays(*zip(*[(pa.array(x, t), f) for x, f, t in fields], strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(held["size"][source]), pa.array(held["target"][source]), pa.array(taken), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), batch.column(1)],
                names=["doc_id", "size", "source_size", "target", "taken", "pieces", "source"],
            )

    return at.mapInArrow(run, f"doc_id {kind}, size long, source_size long, target double, taken long, pieces {PIECES}, source string")


@T.thrifty
def _cut_texts(plan, text_at: int, width: int, batches):
    """A row for each run of words drawn in one pass; a whole text stays as it is. After the rows' own width columns come
    size, the place in the source's stream and the source's number."""
    for batch in batches:
        size, low, source = (batch.column(width + i).to_numpy() for i in range(3))
        row, shard, place, turn, start, words = _draws(plan.value, batch, size, low, source)
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (turn[1:] != turn[:-1])]) if len(row) else np.zeros(0, np.int64)
        words = np.add.reduceat(words, head) if len(row) else words
        row, shard, place, start = row[head], shard[head], place[head], start[head]
        texts, new = batch.column(text_at), []
        for i, a, n in zip(row.tolist(), start.tolist(), words.tolist(), strict=True):
            text = texts[i].as_py()
            if n < size[i]:
                raw = text.encode()
                starts, ends, _ = T.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                text = raw[starts[a] : ends[a + n - 1]].decode()
            new.append(text)
        rows = batch.take(pa.array(row, pa.int64()))
        cols = [pa.array(new, pa.string()) if i == text_at else rows.column(i) for i in range(width)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(shard, pa.int32()), pa.array(place, pa.int64())], names=[f"c{i}" for i in range(width + 2)])


def mixed(docs: DataFrame, shards: int | None = None, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: the columns of docs, a row for each drawn run of words, dealt to shards and shuffled in them."""
    sized, plan, index, base, lots = _planned(docs, shards, seed, block_words)
    own, width = docs.columns, len(docs.columns)
    text, source = own.index("text"), own.index("source")
    # columns are named by place, so that names of docs clash with nothing
    rows = docs.toDF(*[f"c{i}" for i in range(width)])
    rows = rows.mapInArrow(partial(_sizes, text, True), StructType([*rows.schema.fields, StructField("size", LongType())])).withColumnRenamed(f"c{source}", "source")
    doc = F.col(f"c{own.index('doc_id')}")
    rows = rows.withColumns({"h": F.xxhash64(F.lit(seed), doc), "t": F.xxhash64(f"c{text}"), "d": doc, "all": F.xxhash64(*[c for c in hashable(rows) if c != "size"])})
    at = offsets(rows, ["source"], ["h", "d", "t", "all"], "size", "low", base, lots).where("size > 0")
    at = at.join(index, at["source"].eqNullSafe(index["s"])).select(*[at[c] for c in rows.columns[: width + 1]], "low", "source_index")
    schema = StructType([*docs.toDF(*[f"c{i}" for i in range(width)]).schema.fields, StructField("shard", IntegerType()), StructField("place", LongType())])
    out = at.mapInArrow(partial(_cut_texts, plan, text, width), schema)
    count = len(plan.value["cut"])
    return out.repartition(count, "shard").sortWithinPartitions("shard", "place").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
