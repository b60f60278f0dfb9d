"""Quality rules and robust multivariate outliers.

Every text gets counts of words, symbols, repeated lines and repeated words. Texts that fail the base rules are
rejected. The rest give a vector of transformed ratios, and a minimum-covariance-determinant estimate is made for every
pair of language and source and for every language, whatever its size: from several starts, concentration steps take
the COVERED share of a group's vectors nearest to the centre and fit centre and covariance anew, and the start that
ends with the smallest determinant wins. Vectors whose squared Mahalanobis distance exceeds a quantile of chi-square
are rejected.

A group's vectors are first added up by cells of a fixed grid (count, sums and products, so moments are exact); the fit of
a group reads its cells, at most GRID of them however many rows there are, and a hot pair's rows meet in partial sums.
Estimates of few rows lean on others: a pair's on its language's, a language's covariance on the mean of all languages'
covariances, both with SHRINK rows' weight; centres of different languages are never mixed. To every covariance that of
counting noise in a text of MIN_WORDS words is added (the regularised form of the estimate), so that no ratio is
judged finer than it can be measured, and determinants are positive.

Fits are a table of one row a pair, joined to the rows; Spark sends it to all tasks only if it is small.

Defined results: a null or empty text has no words and fails the base rules; null language and source are
values of their own; a language's single row is its own centre and is kept if it passes the base rules; repeated rows
get equal verdicts; an empty table gives an empty result; extra columns are ignored by verdicts() and kept by keep_good().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .scratch import free, save

MIN_WORDS = 50
REPEAT_PERCENT = 50
COVERED = 0.6
STARTS = 12
STEPS = 30
SHRINK = 50
#: The share of normal vectors that the cutoff rejects, and the quantile of chi-square with four degrees for it.
REJECTED = 1e-5


def _quantile(rate: float) -> float:
    """The x with exp(-x/2) (1 + x/2) = rate: the tail of chi-square with four degrees of freedom."""
    x = 1.0
    for _ in range(100):
        x = 2 * (math.log1p(x / 2) - math.log(rate))
    return x


CUTOFF = _quantile(REJECTED)
#: The covariance of the nearest COVERED share of four normal variables, times this, estimates that of all.
CONSISTENCY = COVERED / (1 - math.exp(-(q := _quantile(1 - COVERED)) / 2) * (1 + q / 2 + q * q / 8))
#: Deviations by chance in MIN_WORDS words: of the mean logarithm of word lengths (0.6 a word); of the root of a count's ratio
#: (half of 1 / sqrt(n)); and of that for counts that come in clumps of six words.
_FLOOR = np.array([0.6, 0.5, 0.5, 0.5 * 6**0.5]) ** 2 / MIN_WORDS
_DIM = len(_FLOOR)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]
_V = [f"v{i}" for i in range(_DIM)]
_MOMENTS = ["m", *[f"s{i}" for i in range(_DIM)], *[f"s{i}{j}" for i, j in _PAIRS]]
_MOST = (100, 40, 29, 9)  # cells by statistic; the last one of each holds all beyond
GRID = math.prod(_MOST)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by (row, value), and flags in that order: equal to the one before."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    return order, np.r_[False, (r[1:] == r[:-1]) & (v[1:] == v[:-1])] if len(r) else np.zeros(0, bool)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of every text."""
    data, offsets = T.string_buffers(column)
    starts, ends, first = T.word_spans(data, offsets)
    rows = len(offsets) - 1
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_row(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets)
    out["n_symbols"] = _per_row(_SYMBOL[data], offsets)

    cut = np.flatnonzero(data == 10)
    low = np.sort(np.concatenate([offsets[:-1], cut + 1]))  # every line's start; a row's first line starts at its offset
    high = np.sort(np.concatenate([offsets[1:], cut]))
    row = np.searchsorted(offsets, low, "right") - 1
    full = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, row = low[full], high[full], row[full]
    _, again = _again(row, T.word_hashes(data, low, high)) if len(low) else (None, np.zeros(0, bool))
    out["n_dup_lines"] = np.bincount(np.sort(row)[again], minlength=rows).astype(np.int64)

    words = T.word_hashes(data, starts, ends)
    at, row = T.windows_of_rows(first, 3)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        order, again = _again(row, T.window_hashes(words, 3)[at])
        twice = again | np.r_[again[1:], False]
        spots = at[order][twice]
        np.add.at(covered, spots, 1)
        np.add.at(covered, spots + 3, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(covered[:-1]) > 0, first)
    return out


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed ratios, which lie near normal for prose."""
    n = np.maximum(c["n_words"], 1)
    return np.stack([np.log(np.maximum(c["word_chars"], 1) / n), np.sqrt(c["n_symbols"] / n), np.sqrt(c["n_dup_lines"] / n), np.sqrt(c["n_repeat_words"] / n)], 1)


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


@T.thrifty
def _measured(batches):
    for whole in batches:
        at = whole.schema.get_field_index("text")
        for batch in T.pieces(whole, "text"):
            c = counts(batch.column(at))
            others = [i for i in range(batch.num_columns) if i != at]
            v = vectors(c)
            cols = [*(batch.column(i) for i in others), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(_base_failed(c)), *(pa.array(v[:, i]) for i in range(_DIM))]
            yield pa.RecordBatch.from_arrays(cols, names=[*(batch.schema.names[i] for i in others), *COUNTS, "base_failed", *(f"v{i}" for i in range(_DIM))])


def _matrix(products: np.ndarray) -> np.ndarray:
    out = np.zeros((_DIM, _DIM))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = products[k]
    return out


def _fit(cells: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the cells' rows, of each cell the given share."""
    t = inside @ cells
    mu = t[1 : 1 + _DIM] / t[0]
    return mu, _matrix(t[1 + _DIM :] / t[0]) - np.outer(mu, mu)


def mcd(cells: np.ndarray, floor: np.ndarray = _FLOOR, covered: float = COVERED, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and raw covariance of the covered share of rows with the smallest determinant of covariance plus floor.

    cells: rows of _MOMENTS. The first start is the cells' medians, the others are random sets of five cells; all take
    two steps, and the three best go on until nothing changes.
    """
    weight = cells[:, 0]
    mean = cells[:, 1 : 1 + _DIM] / weight[:, None]
    need = covered * weight.sum()

    def step(mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        d = mean - mu
        far = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov + np.diag(floor)), d)
        order = np.argsort(far, kind="stable")
        upto = np.cumsum(weight[order])
        inside = np.zeros(len(cells))
        inside[order] = np.clip((need - (upto - weight[order])) / weight[order], 0, 1)
        mu, cov = _fit(cells, inside)
        return mu, cov, np.linalg.slogdet(cov + np.diag(floor))[1]

    order = np.argsort(mean, axis=0, kind="stable")
    middle = np.array([mean[o, i][np.searchsorted(np.cumsum(weight[o]), weight.sum() / 2)] for i, o in enumerate(order.T)])
    rng = np.random.Generator(np.random.PCG64(1))
    few = [rng.choice(len(cells), _DIM + 1, p=weight / weight.sum()) for _ in range(starts - 1 if len(cells) > 1 else 0)]
    first = [(middle, np.zeros((_DIM, _DIM))), *((mean[f].mean(0), np.cov(mean[f].T, bias=True)) for f in few)]
    tried = []
    for mu, cov in first:
        for _ in range(2):
            mu, cov, det = step(mu, cov)
        tried.append((det, tuple(mu), mu, cov))
    best = None
    for det, _, mu, cov in sorted(tried, key=lambda x: x[:2])[:3]:
        for _ in range(STEPS):
            mu, cov, new = step(mu, cov)
            if new >= det - 1e-9:
                break
            det = new
        if best is None or det < best[0]:
            best = det, mu, cov
    return best[1], best[2]


_FIT = "n double, mu array<double>, cov array<double>"


def _fits(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of every group of cells; a group has at most GRID rows."""
    grid = [f"c{i}" for i in range(_DIM)]

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        got = np.stack([table.column(c).to_numpy() for c in _MOMENTS], 1)
        got = got[np.lexsort([table.column(c).to_numpy() for c in grid])]
        mu, cov = mcd(got)
        cov = CONSISTENCY * cov
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "n": [got[:, 0].sum()], "mu": [mu], "cov": [[cov[i, j] for i, j in _PAIRS]]})

    summed = cells.groupBy(*keys, *grid).agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    return summed.groupBy(*keys).applyInArrow(run, ", ".join([f"{k} string" for k in keys] + [_FIT]))


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The measured rows of docs, and the fits: l, s (language, source), mu and the inverse of the covariance."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, {', '.join(f'{v} double' for v in _V)}"
    rows = save(docs.select("doc_id", "lang", "source", "text").mapInArrow(_measured, schema))
    cell = [F.least(F.floor(F.col(v) / float(2 * sd if i == 3 else sd) * 2), F.lit(most - 1)).cast("int").alias(f"c{i}") for i, (v, sd, most) in enumerate(zip(_V, np.sqrt(_FLOOR), _MOST, strict=True))]
    sums = [F.count("*").cast("double"), *[F.sum(v) for v in _V], *[F.sum(F.col(_V[i]) * F.col(_V[j])) for i, j in _PAIRS]]
    good = rows.where("not base_failed").select("lang", "source", *_V, *cell)
    cells = save(good.groupBy("lang", "source", *[f"c{i}" for i in range(_DIM)]).agg(*[x.alias(m) for x, m in zip(sums, _MOMENTS, strict=True)]))
    langs = save(_fits(cells, ["lang"]).toDF("l2", "n2", "mu2", "cov2"))
    total = langs.agg(F.coalesce(F.sum("n2"), F.lit(0.0)).alias("n"), *[F.coalesce(F.sum(F.col("n2") * F.col("cov2")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(_PAIRS))]).first()
    shared = np.array([total[f"s{k}"] for k in range(len(_PAIRS))]) / max(total["n"], 1.0)

    def lean(batches):
        """Pairs lean on their language, languages' covariances on the mean of all of them."""
        for batch in batches:
            mus, inverses = [], []
            for r in batch.select(["n", "mu", "cov", "n2", "mu2", "cov2"]).to_pylist():
                lang = (r["n2"] * np.array(r["cov2"]) + SHRINK * shared) / (r["n2"] + SHRINK)
                w = r["n"] / (r["n"] + SHRINK)
                cov = _matrix(w * np.array(r["cov"]) + (1 - w) * lang) * (1 + 1 / r["n2"]) + np.diag(_FLOOR)
                inverse = np.linalg.inv(cov)
                mus.append(w * np.array(r["mu"]) + (1 - w) * np.array(r["mu2"]))
                inverses.append([inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mus, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], names=["l", "s", "mu", "inverse"])

    pairs = _fits(cells, ["lang", "source"])
    fits = save(pairs.join(langs, pairs["lang"].eqNullSafe(langs["l2"])).mapInArrow(lean, "l string, s string, mu array<double>, inverse array<double>"))
    free(cells), free(langs)
    return rows, fits


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the squared distance (null where all of a pair fail) of every document."""
    rows, fits = fit(docs)
    at = rows.join(fits, rows["lang"].eqNullSafe(fits["l"]) & rows["source"].eqNullSafe(fits["s"]), "left")
    d = [F.col(v) - F.col("mu")[i] for i, v in enumerate(_V)]
    far = sum((d[i] * d[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))
    at = at.withColumn("distance", far)
    return at.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), "distance")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that are kept, judged row by row; texts are shuffled only if the fits are too many to be sent."""
    rows, fits = fit(docs)
    free(rows)
    own, width = docs.columns, len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    lang, source, text = (own.index(c) for c in ("lang", "source", "text"))
    at = plain.join(fits, plain[f"c{lang}"].eqNullSafe(fits["l"]) & plain[f"c{source}"].eqNullSafe(fits["s"]))  # pairs without a fit have no good row
    at = at.select(*plain.columns, "mu", "inverse")

    @T.thrifty
    def judge(batches):
        for whole in batches:
            for batch in T.pieces(whole, f"c{text}"):
                c = counts(batch.column(text))
                mu, inverse = (np.array(batch.column(width + i).flatten()).reshape(len(batch), -1) for i in range(2))
                d = vectors(c) - mu
                far = sum(d[:, i] * d[:, j] * inverse[:, k] for k, (i, j) in enumerate(_PAIRS))
                yield batch.filter(pa.array(~_base_failed(c) & (far <= cutoff))).select(list(range(width)))

    return at.mapInArrow(judge, plain.schema).toDF(*own)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept")
