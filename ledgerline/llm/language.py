"""Language identification of mixed-language text.

A word is a run without white space, cut where its script changes and, in scripts written without spaces, at each
letter. A word's script, from fixed ranges of code points, narrows its candidate languages to those seen in that script
when learning. Its score for a language is the sum of log probabilities of its byte trigrams (with the spaces at
its ends). The Viterbi path over a text's words, with a penalty for each switch, labels spans; the text's language
is the one that labels most bytes, and its score that share.

Learning counts trigrams of all labelled rows that are not held out, by language, in BUCKETS cells; each task adds
up its own rows first. The driver and every task hold one row of cells a language, for all languages with a
labelled row. Nothing but the text is used to predict.

Defined results: null texts and texts without a letter (Unicode category L) are `und` with score 0, as is every text if nothing was
learned; a null doc_id is never held out and not learned from; ties go to the language that sorts first; repeated
rows get equal results; an empty table gives an empty result; extra columns are ignored. Whole texts are used.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

BUCKETS = 1 << 16
SWITCH = 14.0
_BLOCK = 4096
_PIECE = 6 << 20
_LETTER = regex.compile(r"\p{L}")

# First code point, last code point and number of a script.
SCRIPTS = (
    (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC0, 0x24F, 1), (0x1E00, 0x1EFF, 1),  # Latin
    (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x400, 0x52F, 3),  # Cyrillic
    (0x530, 0x58F, 4),  # Armenian
    (0x590, 0x5FF, 5),  # Hebrew
    (0x600, 0x6FF, 6), (0x750, 0x77F, 6),  # Arabic
    (0x900, 0x97F, 7),  # Devanagari
    (0x980, 0x9FF, 8),  # Bengali
    (0xB80, 0xBFF, 9),  # Tamil
    (0xE00, 0xE7F, 10),  # Thai
    (0x10A0, 0x10FF, 11),  # Georgian
    (0xAC00, 0xD7AF, 12), (0x1100, 0x11FF, 12),  # Hangul
    (0x3040, 0x30FF, 13),  # Kana
    (0x4E00, 0x9FFF, 14), (0x3400, 0x4DBF, 14),  # Han
)
_N_SCRIPTS = 15
#: Scripts that are written without spaces between words.
_UNSPACED = np.isin(np.arange(_N_SCRIPTS), [10, 13, 14])
_SCRIPT_OF = np.zeros(0x10000, np.uint8)
for _low, _high, _script in SCRIPTS:
    _SCRIPT_OF[_low : _high + 1] = _script
_SCRIPT_OF[[0xD7, 0xF7]] = 0


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, each followed by a space, after one space; white space is one byte value."""
    none = pa.scalar("", pa.large_string())
    joined = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), none, pa.scalar(" ", pa.large_string()))
    data, offsets = T.string_buffers(joined)
    data = T.LOWER[data]
    data[(data >= 9) & (data <= 13)] = 32
    return np.concatenate([np.array([32], np.uint8), data, np.array([32, 32], np.uint8)]), offsets + 1


def _features(data: np.ndarray) -> np.ndarray:
    """The cell of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


def _scripts(data: np.ndarray) -> np.ndarray:
    """The script of the character that starts at each byte; 0 for none."""
    out = np.zeros(len(data), np.uint8)
    low = data < 0x80
    out[low] = _SCRIPT_OF[data[low]]
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    two = two[two + 1 < len(data)]
    out[two] = _SCRIPT_OF[((data[two].astype(np.int64) & 0x1F) << 6) | (data[two + 1] & 0x3F)]
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    three = three[three + 2 < len(data)]
    out[three] = _SCRIPT_OF[((data[three].astype(np.int64) & 0x0F) << 12) | ((data[three + 1].astype(np.int64) & 0x3F) << 6) | (data[three + 2] & 0x3F)]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and script of every word, and the index of each row's first one.

    A run without white space is cut before a letter whose script is not that of the letter before it, and before every
    letter of a script that is written without spaces.
    """
    starts, ends, first = T.word_spans(data, offsets)
    found = _scripts(data)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint8), first
    letters = np.flatnonzero(found)
    kind = found[letters]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) | _UNSPACED[kind[1:]]) + 1
    word = np.searchsorted(starts, letters[cut], "right") - 1
    cut = letters[cut][letters[cut - 1] >= starts[word]]  # the letter before is in the same run
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        first = np.searchsorted(starts, offsets)
    return starts, ends, np.maximum.reduceat(found, starts), first


@T.thrifty
def _count(batches):
    """Trigram and script counts by language of a task's rows (lang, text), in blocks of cells."""
    cells: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in T.pieces(whole, "text"):
            langs, index = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            data, offsets = _spaced(batch.column(1))
            feature = _features(data)[1 : offsets[-1]] if len(data) > 3 else np.zeros(0, np.uint32)
            owner = np.repeat(index, np.diff(offsets))[: len(feature)]
            tri = np.bincount(owner * BUCKETS + feature[: len(owner)], minlength=len(langs) * BUCKETS).reshape(len(langs), -1)
            _, _, found, first = _words(data, offsets)
            who = np.repeat(index, np.diff(first))
            found = found[first[0] : first[-1]]
            script = np.bincount(who * _N_SCRIPTS + found, minlength=len(langs) * _N_SCRIPTS).reshape(len(langs), -1)
            docs = np.bincount(index, minlength=len(langs))
            for i, lang in enumerate(langs.tolist()):
                got = np.concatenate([tri[i], script[i], docs[i : i + 1]])
                cells[lang] = cells[lang] + got if lang in cells else got
    rows = [(lang, b, x[b * _BLOCK : (b + 1) * _BLOCK].tobytes()) for lang, x in cells.items() for b in range(-(-len(x) // _BLOCK))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "block", "cells"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("cells"))
    return pa.table({"lang": table.column("lang").slice(0, 1), "block": table.column("block").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def learn(labelled: DataFrame) -> dict:
    """A model from rows (lang, text) with a label: log probabilities of cells, and languages by script."""
    known = labelled.where("lang is not null").select("lang", "text")
    rows = known.mapInArrow(_count, "lang string, block int, cells binary").groupBy("lang", "block").applyInArrow(_sum, "lang string, block int, cells binary").collect()
    langs = sorted({r.lang for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    cells = np.zeros((len(langs), BUCKETS + _N_SCRIPTS + 1))
    for r in rows:
        x = np.frombuffer(r.cells, np.int64)
        cells[place[r.lang], r.block * _BLOCK : r.block * _BLOCK + len(x)] = x
    tri, script = cells[:, :BUCKETS], cells[:, BUCKETS:-1]
    logp = np.log((tri + 0.5) / (tri.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    used = script >= 0.005 * np.maximum(script.sum(1, keepdims=True), 1)  # (language, script)
    used |= ~used.any(0)
    used[:, 0] = True
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T), "off": np.where(used, 0.0, -50.0).astype(np.float32).T.copy()}


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: score (words, languages), rows of words by first; all rows step together."""
    n, langs = score.shape
    state = np.zeros(n, np.int64)
    if langs == 1 or not n:
        return state
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # rows with a word at each step
    back = np.zeros((n, langs), np.min_scalar_type(langs - 1))
    at = begin[: active[0]]
    best = score[at].astype(np.float64)
    last = np.zeros((len(length), langs))
    last[: active[0]] = best
    for t in range(1, length[0]):
        k = active[t]
        best = last[:k]
        top = best.argmax(1)
        peak = best[np.arange(k), top] - switch
        jump = peak[:, None] > best
        back[begin[:k] + t] = np.where(jump, top[:, None], np.arange(langs)).astype(back.dtype)
        last[:k] = np.where(jump, peak[:, None], best) + score[begin[:k] + t]
    now = last.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        spot = begin[:k] + t
        state[spot] = now[:k]
        if t:
            now[:k] = back[spot, now[:k]]
    return state


@T.thrifty
def _label(model, switch: float, text_at: int, batches):
    """Spans and language of each text."""
    m = model.value
    langs = m["langs"]
    for whole in batches:
        for batch in T.pieces(whole, "text", _PIECE // max(1, len(langs) // 4)):  # scores take 4 bytes a word and language
            column = batch.column(text_at)
            letters = np.array([x is not None and _LETTER.search(x) is not None for x in column.to_pylist()], bool)
            rows = len(batch)
            pred, share, spans = ["und"] * rows, np.zeros(rows), [[] for _ in range(rows)]
            if langs and letters.any():
                data, offsets = _spaced(column)
                starts, ends, script, first = _words(data, offsets)
                first = first - first[0]
                feature = _features(data)
                score = np.empty((len(starts), len(langs)), np.float32)
                for i in range(len(langs)):
                    total = np.zeros(len(feature) + 1)
                    np.cumsum(m["logp"][feature, i], out=total[1:])
                    score[:, i] = total[ends - 1] - total[starts - 1]
                score += m["off"][script]
                state = viterbi(score, first, switch)
                weight = (ends - starts).astype(np.float64)
                row = np.repeat(np.arange(rows), np.diff(first))
                held = np.bincount(row * len(langs) + state, weight, minlength=rows * len(langs)).reshape(rows, -1)
                top = held.argmax(1)
                share = np.where(letters, held[np.arange(rows), top] / np.maximum(held.sum(1), 1), 0.0)
                pred = [langs[i] if ok else "und" for i, ok in zip(top, letters, strict=True)]
                head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (state[1:] != state[:-1])]) if len(row) else []
                size = np.diff(np.r_[head, len(row)]).astype(int) if len(row) else []
                for h, n in zip(head, size, strict=True):
                    if letters[row[h]]:
                        spans[row[h]].append({"first_word": int(h - first[row[h]]), "n_words": int(n), "lang": langs[state[h]]})
            others = [i for i in range(batch.num_columns) if i != text_at]
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)], names=[*(batch.schema.names[i] for i in others), "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and the labelled spans (in words) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_label, held, switch, 1), f"doc_id {kind}, lang_pred string, score double, spans array<struct<first_word:long,n_words:long,lang:string>>")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    found = identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
