"""Removal of long passages that repeat across documents, by compacting a De Bruijn graph of token k-mers.

A k-mer (run of k words) is an edge from its first k-1 words to its last k-1. Edges that occur in more
than one document are found with one shuffle of their hashes; an edge's source is its first occurrence in
the smallest doc_id. An occurrence in a larger doc_id is repeated. A document's repeated edges that follow
each other, with sources that follow each other as well, form a path that does not branch from its source's, and are
compacted to one span with one source coordinate: within each task first, then over all tasks by document.

Spans are verified: the words at a span's own coordinates and at its source's are read from the texts (a Spark join of
coordinates with documents) and compared by digest (a second join, of spans with their sources). A hash of another run
of words can therefore remove nothing. K-mers of spans that fail are resolved by their words instead of hashes, again
by joins; with 56 bits that is rare, and it costs one scan when it happens.

Defined results: null and empty texts have no words; a text shorter than k words loses none; rows with one
doc_id never remove each other's words; identical rows get identical results; an empty table gives an empty
result; extra columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import text as T
from .scratch import free, fresh, id_filter, in_filter, parts, save

WINDOW = 13
HASH_BITS = 56
_HELD = 400_000
_EDGES, _SPANS = 0, 1
_SCHEMA = "target int, kind int, hashes binary, docs binary, tags binary, starts binary, lengths binary, sources binary, places binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_OUT = "target int, docs binary, tags binary, starts binary, lengths binary, sources binary, places binary"


def _targets(values: np.ndarray, n: int) -> np.ndarray:
    """A target from 0 to n-1 that rises with the value."""
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _cuts(targets: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(targets):
        return []
    at = [0, *(np.flatnonzero(np.diff(targets)) + 1), len(targets)]
    return [(int(targets[a]), int(a), int(b)) for a, b in zip(at, at[1:], strict=False)]


def _doc_hash(docs: np.ndarray) -> np.ndarray:
    return T.mix(docs.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))


def compact(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of edges that follow each other both in their document and in their source."""
    if not len(doc):
        return doc, tag, start, length, source, place
    order = np.lexsort((start, tag, doc))
    doc, tag, start, length, source, place = (x[order] for x in (doc, tag, start, length, source, place))
    joined = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1] + length[:-1]) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + length[:-1])
    again = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    if again.any():  # repeated rows of the table
        keep = np.r_[True, ~again]
        return compact(*(x[keep] for x in (doc, tag, start, length, source, place)))
    head = np.flatnonzero(np.r_[True, ~joined])
    return doc[head], tag[head], start[head], np.add.reduceat(length, head), source[head], place[head]


def _ship(doc, tag, start, length, source, place, n: int):
    """Spans packed by the target of their document: target and the columns of _OUT."""
    target = _targets(_doc_hash(doc), n)
    order = np.lexsort((start, tag, doc, target))
    target, doc, tag, start, length, source, place = (x[order] for x in (target, doc, tag, start, length, source, place))
    for t, a, b in _cuts(target):
        yield {"target": t, "docs": T.pack(doc[a:b]), "tags": T.pack(tag[a:b]), "starts": T.pack(start[a:b]), "lengths": T.pack(length[a:b]), "sources": T.pack(source[a:b]), "places": T.pack((place - start)[a:b])}


def _text_tags(words: np.ndarray, first: np.ndarray, ids: np.ndarray, twice: bytes) -> np.ndarray:
    """What tells apart texts with one doc_id: a hash of the word sequence, or 0 where the doc_id occurs once."""
    place = T.ranges(np.diff(first)).astype(np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(T.mix(words ^ T.mix(place)), out=total[1:])
    tags = (T.mix(total[first[1:]] - total[first[:-1]]) >> np.uint64(32)).astype(np.uint32)
    return np.where(in_filter(twice, ids), tags, np.uint32(0))


def _hashes(words: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Hashes of all runs of k words, of which the highest bits count."""
    return T.window_hashes(words, k) & ~np.uint64((1 << (64 - bits)) - 1)


def _edges(k: int, bits: int, lots: int, targets: int, twice):
    """Map side: the k-mers of a task's documents; of each, those of its smallest document go on, others are repeated."""

    @T.thrifty
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            h, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((pos, doc, h))
            h, doc, tag, pos = h[order], doc[order], tag[order], pos[order]
            head = np.r_[True, h[1:] != h[:-1]]
            at = np.flatnonzero(head)
            lead = np.repeat(at, np.diff(np.r_[at, len(h)]))
            own = doc == doc[lead]
            rep = ~own
            h2, d2, g2, p2 = h[own], doc[own], tag[own], pos[own].astype(np.uint32)
            rows = []
            for t, a, b in _cuts(_targets(h2, lots)):
                rows.append({"target": t, "kind": _EDGES, "hashes": T.pack_sorted(h2[a:b]), "docs": T.pack(d2[a:b]), "tags": T.pack(g2[a:b]), "starts": T.pack(p2[a:b])})
            if rep.any():
                spans = compact(doc[rep], tag[rep], pos[rep].astype(np.int64), np.ones(rep.sum(), np.int64), doc[lead][rep], pos[lead][rep].astype(np.int64))
                rows += [x | {"kind": _SPANS, "target": x["target"] * (lots // targets)} for x in _ship(*spans, targets)]
            return pa.RecordBatch.from_pydict({name: pa.array([r.get(name) for r in rows], pa.int32() if name in ("target", "kind") else pa.binary()) for name in _NAMES})

        count = 0
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                data, offsets = T.string_buffers(batch.column(1))
                starts, ends, first = T.word_spans(data, offsets)
                words = T.word_hashes(data, starts, ends)
                at, row = T.windows_of_rows(first, k)
                if not len(at):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                tags = _text_tags(words, first, ids, twice.value)
                held.append((_hashes(words, k, bits)[at], ids[row], tags[row], (at - first[row]).astype(np.int32)))
                count += len(at)
                if count >= _HELD:
                    yield flush()
                    T.give_back()
                    count = 0
        if held:
            yield flush()
        T.give_back()

    return run


def _reduce(ratio: int, targets: int):
    """Reduce side, in ratio * targets groups: each edge's source over all tasks; occurrences in larger documents leave as spans."""

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        rows = []
        kinds = table.column("kind").to_numpy()
        edges = [i for i in range(len(kinds)) if kinds[i] == _EDGES]
        get = lambda name, i: table.column(name)[i].as_py()
        passed = table.filter(pa.array(kinds == _SPANS)).drop_columns(["kind", "hashes"])
        passed = passed.set_column(0, "target", pc.divide(passed.column("target"), pa.scalar(ratio, pa.int32())))
        if edges:
            of = lambda name, kind: np.concatenate([T.unpack(get(name, i), kind) for i in edges])
            h = np.concatenate([T.unpack_sorted(get("hashes", i)) for i in edges])
            order = np.argsort(h)
            same = h[order]
            same = same[1:] == same[:-1]
            some = order[np.r_[False, same] | np.r_[same, False]]  # an edge with one occurrence here has no other
            del order, same
            h, doc = h[some], of("docs", np.int64)[some]
            order = np.lexsort((doc, h))
            h, doc, some = h[order], doc[order], some[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            lead = np.repeat(at, np.diff(np.r_[at, len(h)]))
            rep = doc != doc[lead]
            del h, order
            if rep.any():
                tag, pos = of("tags", np.uint32)[some], of("starts", np.uint32)[some].astype(np.int64)
                # the source is the first place in the smallest document
                low = np.minimum.reduceat(np.where(doc == doc[lead], pos, np.iinfo(np.int64).max), at)
                source = np.repeat(low, np.diff(np.r_[at, len(doc)]))
                spans = compact(doc[rep], tag[rep], pos[rep], np.ones(int(rep.sum()), np.int64), doc[lead][rep], source[rep])
                rows += _ship(*spans, targets)
        T.give_back()
        own = pa.table({name: pa.array([r[name] for r in rows], passed.schema.field(name).type) for name in passed.column_names})
        return pa.concat_tables([passed, own])

    return run


_SPAN = "target int, doc long, tag long, start long, length long, source long, place long"
_TOLD = f"{_SPAN}, digest binary"


def _unpacked(table: pa.Table) -> pa.Table:
    """A document's packed spans, compacted over all tasks, a row each."""
    kinds = {"docs": np.int64, "tags": np.uint32, "starts": np.int64, "lengths": np.int64, "sources": np.int64, "places": np.int64}
    got = [np.concatenate([T.unpack(x.as_py(), kind) for x in table.column(name)] or [np.zeros(0, kind)]) for name, kind in kinds.items()]
    got[5] = got[5] + got[2]
    spans = [x.astype(np.int64) for x in compact(*got)]
    target = pa.array(np.full(len(spans[0]), table.column("target")[0].as_py()), pa.int32())
    return pa.table([target, *spans], names=[x.split()[0] for x in _SPAN.split(", ")])


def _digests_of(k: int, twice):
    """For texts and the spans asked of them (doc_id, text, spans): each span that lies in the text, and its words' digest."""

    @T.thrifty
    def run(batches):
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                data, offsets = T.string_buffers(batch.column(1))
                starts, ends, first = T.word_spans(data, offsets)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                tags = _text_tags(T.word_hashes(data, starts, ends), first, ids, twice.value)
                space = np.flatnonzero(np.isin(data, [9, 10, 11, 12, 13]))
                data = data.copy()
                data[space] = 32
                raw, rows = data.tobytes(), []
                for i, asked in enumerate(batch.column(2).to_pylist()):
                    for x in asked:
                        low, high = x["start"], x["start"] + x["length"] + k - 1
                        if x["tag"] in (_ANY, tags[i]) and high <= first[i + 1] - first[i]:
                            body = raw[starts[first[i] + low] : ends[first[i] + high - 1]]
                            if b"  " in body:
                                body = b" ".join(body.split())
                            rows.append({"doc": ids[i], **x, "digest": hashlib.blake2b(body, digest_size=16).digest()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _TOLD.split(", ")]))

    return run


_ANY = -1  # the tag of a source's coordinates: they hold for whichever text of the doc_id has the words


def _cover(k: int, twice, emit):
    """Last join: a document's spans, compacted over all tasks, and its text; emit(..., kept) gets a mask of words to keep, or None for all."""

    def run(_key, documents: pa.Table, found: pa.Table) -> pa.Table:
        doc, tag, start, length = (found.column(c).to_numpy() for c in ("doc", "tag", "start", "length"))
        order = np.argsort(doc, kind="stable")
        doc, tag, start, length = doc[order], tag[order], start[order], length[order]
        out = []
        for batch in documents.combine_chunks().to_batches():
            for piece in T.pieces(batch, "text"):
                data, offsets = T.string_buffers(piece.column("text"))
                starts, ends, first = T.word_spans(data, offsets)
                words = T.word_hashes(data, starts, ends)
                ids = _ids(piece)
                tags = _text_tags(words, first, ids, twice.value)
                low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
                kept = []
                for i in range(len(ids)):
                    mine = low[i] + np.flatnonzero(tag[low[i] : high[i]] == tags[i]) if low[i] < high[i] else ()
                    if not len(mine):
                        kept.append(None)
                        continue
                    count = first[i + 1] - first[i]
                    step = np.zeros(count + 1, np.int64)
                    np.add.at(step, start[mine], 1)
                    np.add.at(step, np.minimum(start[mine] + length[mine] + k - 1, count), -1)
                    kept.append(np.cumsum(step[:-1]) == 0)
                out += emit(piece, data, offsets, starts, ends, first, kept)
        return out

    return run


def _digest_rows(piece, data, offsets, starts, ends, first, kept):
    raw, ids = data.tobytes(), piece.column("doc_id")
    for i, keep in enumerate(kept):
        words = raw[offsets[i] : offsets[i + 1]].split()
        left = words if keep is None else [w for w, x in zip(words, keep.tolist(), strict=True) if x]
        yield ids[i].as_py(), len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _text_rows(piece, data, offsets, starts, ends, first, kept):
    """The text without the covered words: a cut takes the words and the white space between them."""
    raw = data.tobytes()
    for i, keep in enumerate(kept):
        body = raw[offsets[i] : offsets[i + 1]]
        if keep is None:
            yield i, body
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, keep, True].astype(np.int8)))
        out, at = [], 0
        for a, b in edge.reshape(-1, 2):
            low, high = int(starts[first[i] + a] - offsets[i]), int(ends[first[i] + b - 1] - offsets[i])
            out.append(body[at:low])
            at = high
        out.append(body[at:])
        yield i, b"".join(out)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of the given ids (one column), and others by chance."""
    held = rows.sparkSession.sparkContext.broadcast(id_filter(ids, _ids_of))

    @T.thrifty
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(held.value, _ids_of(batch))))

    return rows.mapInArrow(run, "doc_id long, text string")


def _verified(rows: DataFrame, spans: DataFrame, k: int, twice: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Spans whose words are those of their source, and the others."""
    asked = F.struct("target", "tag", "start", "length", "source", "place").alias("span")
    none = F.lit(None).cast("long")
    sources = spans.select(F.col("source").alias("doc"), F.lit(None).cast("int").alias("target"), F.lit(_ANY).cast("long").alias("tag"), F.col("place").alias("start"), "length", none.alias("source"), none.alias("place")).distinct()
    asked = spans.select("doc", asked).union(sources.select("doc", asked)).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    texts = _texts(rows, spans.select("doc").union(spans.select("source")).distinct())
    told = texts.join(asked, texts["doc_id"] == asked["doc"]).select("doc_id", "text", "spans").mapInArrow(_digests_of(k, twice), _TOLD)
    told = save(told)
    own, source = told.where(F.col("tag") != _ANY), told.where(F.col("tag") == _ANY).select(F.col("doc").alias("d"), F.col("start").alias("s"), F.col("length").alias("n"), F.col("digest").alias("x"))
    same = (own["source"] == source["d"]) & (own["place"] == source["s"]) & (own["length"] == source["n"]) & (own["digest"] == source["x"])
    return own.join(source, same, "left_semi").drop("digest"), own.join(source, same, "left_anti").drop("digest")


def _by_words(rows: DataFrame, failed: DataFrame, k: int, bits: int, targets: int, twice: Broadcast) -> DataFrame:
    """Spans of one edge each for all k-mers with a hash of a failed span, resolved by their words."""

    def words_of(batch):
        data, offsets = T.string_buffers(batch.column(1))
        starts, ends, first = T.word_spans(data, offsets)
        return data, starts, ends, first, T.word_hashes(data, starts, ends)

    @T.thrifty
    def doubtful(batches):
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                _, _, _, first, words = words_of(batch)
                hashes = _hashes(words, k, bits)
                ids = _ids_of(batch)
                tags = _text_tags(words, first, ids, twice.value)
                at = [np.arange(x["start"], x["start"] + x["length"]) + first[i] for i, asked in enumerate(batch.column(2).to_pylist()) for x in asked if x["tag"] == tags[i]]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[np.concatenate(at)].view(np.int64) if at else np.zeros(0, np.int64))], names=["h"])

    asked = failed.groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "length")).alias("spans"))
    texts = _texts(rows, failed.select("doc").distinct())
    hashes = texts.join(asked, texts["doc_id"] == asked["doc"]).select("doc_id", "text", "spans").mapInArrow(doubtful, "h long").distinct()
    held = rows.sparkSession.sparkContext.broadcast(id_filter(hashes, _ids_of))

    @T.thrifty
    def occurrences(batches):
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                data, starts, ends, first, words = words_of(batch)
                at, row = T.windows_of_rows(first, k)
                if not len(at):
                    continue
                some = in_filter(held.value, _hashes(words, k, bits)[at].view(np.int64))
                at, row = at[some], row[some]
                ids = _ids_of(batch)
                tags = _text_tags(words, first, ids, twice.value)
                raw = data.tobytes()
                target = _targets(_doc_hash(ids), targets)
                keys = [b" ".join(raw[starts[i] : ends[i + k - 1]].split()) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(target[row].astype(np.int32)), pa.array(ids[row]), pa.array(tags[row].astype(np.int64)), pa.array(at - first[row])], names=["words", "target", "doc", "tag", "start"])

    every = save(rows.mapInArrow(occurrences, "words binary, target int, doc long, tag long, start long"))
    least = every.groupBy(F.col("words").alias("w")).agg(F.min("doc").alias("source"))
    again = every.join(least, (every["words"] == least["w"]) & (every["doc"] > least["source"]))
    return again.select("target", "doc", "tag", "start", F.lit(1).cast("long").alias("length"), "source", F.lit(None).cast("long").alias("place"))


def _found(docs: DataFrame, k: int, bits: int) -> tuple[DataFrame, int, Broadcast, Broadcast]:
    """The spans, the number of targets, the filter of doc_ids that occur twice and that of documents with spans."""
    spark = docs.sparkSession
    targets = parts(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    more = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = spark.sparkContext.broadcast(id_filter(more, _ids_of))
    edges = rows.mapInArrow(_edges(k, bits, 3 * targets, targets, twice), _SCHEMA)
    spans = edges.groupBy("target").applyInArrow(_reduce(3, targets), _OUT)
    spans = save(spans.groupBy("target").applyInArrow(_unpacked, _SPAN))
    good, failed = _verified(rows, spans, k, twice)
    good, failed = save(good), save(failed)
    if not failed.isEmpty():
        good = save(good.union(_by_words(rows, failed, k, bits, targets, twice)))
    free(failed), free(spans)
    hit = id_filter(good.select("doc").distinct(), _ids_of)
    return good, targets, twice, spark.sparkContext.broadcast(hit)


def _split(docs: DataFrame, targets: int, hit: Broadcast) -> tuple[DataFrame, DataFrame, str]:
    """Documents that may have spans, with their target, all others, and the name of the target's column."""
    name = fresh(docs, "__target")

    @T.thrifty
    def some(batches):
        for batch in batches:
            ids = _ids(batch)
            target = pa.array(_targets(_doc_hash(ids), targets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, target], names=[*batch.schema.names, name]).filter(pa.array(in_filter(hit.value, ids)))

    @T.thrifty
    def rest(batches):
        for batch in batches:
            yield batch.filter(pa.array(~in_filter(hit.value, _ids(batch))))

    return docs.mapInArrow(some, StructType([*docs.schema.fields, StructField(name, IntegerType())])), docs.mapInArrow(rest, docs.schema), name


def _digests(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]


def repeated_words(docs: DataFrame, k: int = WINDOW, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found, targets, twice, hit = _found(docs, k, bits)
    some, rest, target = _split(docs, targets, hit)
    cover, names = _cover(k, twice, _digest_rows), ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(_digests(cover(key, left, right)), names=names)

    @T.thrifty
    def whole(batches):
        for batch in batches:
            for piece in T.pieces(batch, "text"):
                data, offsets = T.string_buffers(piece.column("text"))
                yield pa.RecordBatch.from_arrays(_digests(list(_digest_rows(piece, data, offsets, None, None, None, [None] * len(piece)))), names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return some.groupBy(target).cogroup(found.groupBy("target")).applyInArrow(run, schema).union(rest.mapInArrow(whole, schema))


def remove_repeats(docs: DataFrame, k: int = WINDOW, bits: int = HASH_BITS) -> DataFrame:
    """docs, with the covered words cut from column text; all rows and all other columns stay."""
    found, targets, twice, hit = _found(docs, k, bits)
    some, rest, target = _split(docs, targets, hit)
    cover = _cover(k, twice, lambda piece, *more: [(piece, list(_text_rows(piece, *more)))])
    at = docs.columns.index("text")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns([target])
        tables = []
        for piece, texts in cover(key, left, right):
            null = piece.column(at).is_null().to_pylist()
            new = pa.array([None if null[i] else body.decode() for i, body in texts], pa.string())
            tables.append(pa.Table.from_batches([piece]).set_column(at, "text", new))
        return pa.concat_tables(tables) if tables else left.slice(0, 0)

    return some.groupBy(target).cogroup(found.groupBy("target")).applyInArrow(run, docs.schema).union(rest)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
