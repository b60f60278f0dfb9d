"""Packing sequences into token-budget batches inside length buckets of least padding.

Texts are cut into sequences of at most max_words words; nothing is dropped. The histogram of all lengths (at
most max_words + 1 rows, whatever the input) goes to the driver, where dynamic programming chooses the bucket
boundaries that make the sum of padding smallest. Inside a bucket, sequences are ranked by a seeded hash and
each run of budget // boundary of them is a batch. A packed row carries its sequence's own text.

Defined results: null and empty texts give one sequence of length 0 with that text, in the first bucket; repeated rows
are sequences of their own; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import text as T
from .scratch import hashable, lot_bases, lots_of, offsets, save

MAX_WORDS = 2048
BUDGET = 16384
BUCKETS = 12


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries, at most `buckets` and rising, that make the sum of (boundary - length) smallest."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    many, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # cost[i, j]: lengths i..j-1 in one bucket that ends at x[j-1]
    cost = np.full((n + 1, n + 1), np.inf)
    for j in range(1, n + 1):
        cost[:j, j] = x[j - 1] * (many[j] - many[:j]) - (total[j] - total[:j])
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        step = best[:, None] + cost
        at = step.argmin(0)
        new = step[at, np.arange(n + 1)]
        back.append(at)
        best = np.minimum(new, np.inf)
        best[0] = np.inf
    out, j = [], n
    for at in reversed(back):
        out.append(int(x[j - 1]))
        j = int(at[j])
    return out[::-1]


@T.thrifty
def _cut(most: int, text_at: int, keep: bool, batches):
    """The sequences of each text: first word and number of words, and with keep all columns, the text cut to the sequence."""
    for whole in batches:
        for batch in T.pieces(whole, whole.schema.names[text_at]):
            data, offsets = T.string_buffers(batch.column(text_at))
            starts, ends, first = T.word_spans(data, offsets)
            size = np.diff(first)
            count = np.maximum(-(-size // most), 1)
            row = np.repeat(np.arange(len(size)), count)
            start = T.ranges(count) * most
            words = np.minimum(size[row] - start, most)
            hashes = batch.column(batch.num_columns - 1).take(pa.array(row))
            cols = [hashes]
            if keep:
                rows = batch.take(pa.array(row))
                cols = [rows.column(i) for i in range(batch.num_columns)]
                if len(row) > len(size):  # a text that is one sequence stays as it is, null included
                    raw, texts = data.tobytes(), cols[text_at].to_pylist()
                    for i in np.flatnonzero(count[row] > 1).tolist():
                        low = first[row[i]] + start[i]
                        texts[i] = raw[starts[low] : ends[low + words[i] - 1]].decode()
                    cols[text_at] = pa.array(texts, cols[text_at].type)
            cols += [pa.array(start, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"x{i}" for i in range(len(cols))])


PACKED = ("start_word", "n_words", "bucket_len", "batch_id", "slot", "padding")


def packed(docs: DataFrame, max_words: int = MAX_WORDS, budget: int = BUDGET, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """A row a sequence: all columns of docs, text cut to the sequence, and PACKED.

    A column of docs that has a name of PACKED gets "_" added until it clashes with nothing.
    """
    width, text = len(docs.columns), docs.columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(width)])
    rows = rows.withColumn("__t", F.xxhash64(F.lit(seed), *hashable(rows)))
    plain = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])
    extra = [StructField("start_word", LongType()), StructField("n_words", LongType())]
    light = save(rows.mapInArrow(partial(_cut, max_words, text, False), StructType([plain["__t"], *extra])))
    found = light.groupBy("n_words").count().collect()  # max_words + 1 rows at most
    edges = boundaries([r.n_words for r in found], [r["count"] for r in found], buckets)
    held = [sum(r["count"] for r in found if (low < r.n_words) & (r.n_words <= high)) for low, high in zip([-1, *edges], edges, strict=False)]
    room = [max(1, budget // max(1, e)) for e in edges]
    first = np.concatenate([[0], np.cumsum([-(-h // r) for h, r in zip(held, room, strict=True)])]).astype(int).tolist()

    def placed(df: DataFrame) -> DataFrame:
        bucket = F.lit(max(len(edges) - 1, 0))
        for i in reversed(range(len(edges) - 1)):
            bucket = F.when(F.col("n_words") <= edges[i], i).otherwise(bucket)
        return df.withColumns({"__bucket": bucket.cast("int"), "__one": F.lit(1), "__h": F.xxhash64("__t", "start_word")})

    lots = lots_of(docs.sparkSession)
    base = lot_bases(placed(light), ["__bucket"], "__h", "__one", lots)
    rows = placed(rows.mapInArrow(partial(_cut, max_words, text, True), StructType([*plain.fields, *extra])))
    rows = offsets(rows, ["__bucket"], ["__h", "__t", "start_word"], "__one", "__rank", base, lots)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs or [0]]), F.col("__bucket") + 1)
    rows = rows.withColumns({"bucket_len": pick(edges), "__room": pick(room)})
    own: list[str] = []
    for c in docs.columns:
        while c.lower() in PACKED or c.lower() in map(str.lower, own):
            c += "_"
        own.append(c)
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "start_word", "n_words", "bucket_len",
        (pick(first) + F.floor(F.col("__rank") / F.col("__room"))).cast("long").alias("batch_id"),
        (F.col("__rank") % F.col("__room")).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_words")).alias("padding"),
    )


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs).select("doc_id", *PACKED, "text")
