"""N-gram Jaccard join by a token-group matrix: which documents share nearly all their word n-grams.

1. One pass hashes every document's set of n-grams, folds equal sets into classes, and counts n-grams in a
   sketch of fixed size. 2. A set's n-grams are ordered rarest first (by the sketch; any one order keeps the
   result whole). Two sets that reach the threshold share an n-gram among their first
   |A| - ceil(t|A|) + 1, so only those are shuffled; sets that meet there, with sizes near enough, are
   joined to partitions of similar documents. 3. What a sketch of fixed size cannot tell apart grows with the corpus, so
   members of partitions of more than one block go through a second filter of the same kind, ordered by exact
   counts among them (n-grams are shuffled to be counted, and back): a set with too many n-grams of its own leaves, and
   the others are joined anew. 4. A partition is dealt into blocks of bounded size, and each
   pair of blocks goes to one task. There, rows of a token-group matrix hold the token union of a few members each; a query's
   overlap with a union bounds its overlap with every member, and only groups whose bound reaches the
   threshold are opened and compared exactly. 5. Verified links leave as spanning forests and link counts;
   components are found over the classes.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own
component; fewer words than n give one n-gram of all of them; rows with a null doc_id are left out; rows that
repeat a doc_id are rows of their own; an empty table gives an empty result. Sets are compared by 64-bit
hashes of whole texts; nothing is sampled or capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import text as T
from .scratch import components, forest, free, fresh, id_filter, in_filter, parts, save

_MEMBERS, _TOKENS, _GROUP, _RUN = 96, 1_000_000, 16, 64
_HELD = 250_000
_TASK = 4_000_000  # n-grams of the corpus for each task that meets postings
_HOT = 0xFFFFFFFF  # the rank of a class that stands for others of a common n-gram
_POSTED = "target int, grams binary, cids binary, sizes binary, ranks binary"
SKETCH_BITS = 19  # 2 MB to the driver and to every task, whatever the input
_BLOCK = 1 << 12


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and n-gram hash, of every distinct n-gram of every row (in order of row, hash); and the sets' sizes."""
    data, offsets = T.string_buffers(column)
    starts, ends, first = T.word_spans(data, offsets)
    words = T.word_hashes(T.LOWER[data], starts, ends)
    at, row = T.windows_of_rows(first, n)
    grams = T.window_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    for size in range(1, n):  # short texts: all words as one
        short = np.flatnonzero(counts == size)
        if len(short):
            whole = T.window_hashes(words, size)[first[short]]
            grams = np.concatenate([grams, T.mix(whole + np.uint64(size))])
            row = np.concatenate([row, short])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    if len(row):
        keep = np.r_[True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])]
        row, grams = row[keep], grams[keep]
    return row, grams, np.bincount(row, minlength=len(counts)).astype(np.int64)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _class_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(T.mix(grams ^ np.uint64(0xA5A5F00D)), out=total[1:])
    at = _bounds(sizes)
    return T.mix(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _survey(n: int):
    """Each document's class and size, and at its end the task's sketch of n-gram counts."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64())])

    @T.thrifty
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                _, grams, sizes = ngram_sets(batch.column(1), n)
                counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                none = pa.nulls(len(batch), pa.int32())
                yield pa.RecordBatch.from_arrays([none, pa.nulls(len(batch), pa.binary()), batch.column(0), pa.array(sizes), pa.array(_class_ids(grams, sizes))], schema=schema)
        if counts.any():
            counts = np.minimum(counts, 0xFFFF).astype(np.uint16)
            cut = [(i // _BLOCK, counts[i : i + _BLOCK].tobytes()) for i in range(0, len(counts), _BLOCK)]
            none = pa.nulls(len(cut), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), pa.array([x for _, x in cut], pa.binary()), none, none, none], schema=schema)

    return run


def _sketch(survey: DataFrame) -> np.ndarray:
    """The tasks' sketches summed: one vector of fixed size on the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint16)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in survey.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.counts, np.uint32)
    return out


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with anything that a set of each size needs."""
    return -(-percent * sizes // 100)


def _thinned(gram: np.ndarray, size: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings in order of n-gram and size: which go on, their ranks, and edges that join the others to them.

    Where one n-gram is shared by more than _RUN classes of a task, only a chain of them goes on, with sizes so near each
    other that any class which fits one of the others fits a link of the chain: no task receives a hot n-gram's classes.
    """
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    length = np.diff(np.r_[head, len(gram)])
    keep, edges = np.ones(len(gram), bool), []
    rank = rank.copy()
    for a, n in zip(head[length > _RUN].tolist(), length[length > _RUN].tolist(), strict=True):
        s = size[a : a + n]
        keep[a : a + n] = False
        i = 0
        while i < n:
            keep[a + i] = True
            upto = int(np.searchsorted(s, 100 * s[i] // percent, "right")) - 1  # the last that is near enough to i
            edges.append(np.stack([np.full(upto - i, a + i), np.arange(a + i + 1, a + upto + 1)]))
            i = upto if upto > i else i + 1
        rank[a : a + n] = _HOT
    return keep, rank, np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)


def _packed(gram: np.ndarray, cid: np.ndarray, size: np.ndarray, rank: np.ndarray, targets: int, percent: int) -> pa.RecordBatch:
    """Postings packed by target; edges between a common n-gram's classes go as rows without sizes."""
    order = np.lexsort((cid, size, gram))
    gram, cid, size, rank = gram[order], cid[order], size[order], rank[order]
    keep = np.r_[True, (gram[1:] != gram[:-1]) | (cid[1:] != cid[:-1])]
    gram, cid, size, rank = gram[keep], cid[keep], size[keep], rank[keep]
    keep, rank, edges = _thinned(gram, size, rank, percent)
    a, b = forest(*cid[edges])
    gram, cid, size, rank = gram[keep], cid[keep], size[keep], rank[keep]
    target = (((gram >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(target)) + 1), len(target)]
    spans = list(zip(cuts, cuts[1:], strict=False)) if len(target) else []
    rows = [(int(target[i]), T.pack_sorted(gram[i:j]), T.pack(cid[i:j]), T.pack(size[i:j].astype(np.uint32)), T.pack(rank[i:j].astype(np.uint32))) for i, j in spans]
    if len(a):
        rows.append((int(target[0]), T.pack(a), T.pack(b), None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in _POSTED.split(", ")])


def _first_grams(n: int, percent: int, targets: int, counts):
    """The first n-grams of each class of a task, packed by target."""

    @T.thrifty
    def run(batches):
        rare = counts.value
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                row, grams, sizes = ngram_sets(batch.column(1), n)
                if not len(row):
                    continue
                cid = _class_ids(grams, sizes)
                once = np.zeros(len(cid), bool)
                once[np.unique(cid, return_index=True)[1]] = True
                keep = once[row]
                row, grams = row[keep], grams[keep]
                order = np.lexsort((grams, rare[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                row, grams = row[order], grams[order]
                rank = T.ranges(sizes[once])
                first = rank < (sizes - _needed(sizes, percent) + 1)[row]
                row, grams, rank = row[first], grams[first], rank[first]
                held.append((grams, cid[row], sizes[row], rank))
                total += len(row)
                if total >= _HELD:
                    yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), targets, percent)
                    held.clear()
                    total = 0
        if held:
            yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), targets, percent)

    return run


def _all_grams(n: int, targets: int):
    """All n-grams of the rows' classes (cid, text), packed by target."""

    @T.thrifty
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            gram, cid, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(gram, kind="stable")
            gram, cid, size = gram[order], cid[order], size[order]
            target = (((gram >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(target)) + 1), len(target)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            packed = [pa.array([f(x[i:j]) for i, j in spans], pa.binary()) for f, x in ((T.pack_sorted, gram), (T.pack, cid), (T.pack, size.astype(np.uint32)))]
            return pa.RecordBatch.from_arrays([pa.array([target[i] for i, _ in spans], pa.int32()), *packed], names=["target", "grams", "cids", "sizes"])

        total = 0
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                row, grams, sizes = ngram_sets(batch.column(1), n)
                right = _class_ids(grams, sizes) == batch.column(0).to_numpy()  # a doc_id can have several texts
                row, grams = row[right[row]], grams[right[row]]
                held.append((grams, batch.column(0).to_numpy()[row], sizes[row]))
                total += len(row)
                if total >= _HELD:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    return run


def _count(targets: int):
    """How many classes hold each n-gram; those in two or more go back to their classes with that number."""

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        gram = np.concatenate([T.unpack_sorted(x.as_py()) for x in table.column("grams")])
        cid, size = (np.concatenate([T.unpack(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("cids", np.int64), ("sizes", np.uint32)))
        order = np.lexsort((cid, gram))
        gram, cid, size = gram[order], cid[order], size[order]
        once = np.r_[True, (gram[1:] != gram[:-1]) | (cid[1:] != cid[:-1])]
        gram, cid, size = gram[once], cid[once], size[once]
        head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        many = np.repeat(np.diff(np.r_[head, len(gram)]), np.diff(np.r_[head, len(gram)]))
        to = ((T.mix(cid.view(np.uint64)) >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((gram, to))
        order = order[many[order] > 1]
        gram, cid, size, many, to = gram[order], cid[order], size[order], many[order], to[order]
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1), len(to)] if len(to) else []
        spans = list(zip(cuts, cuts[1:], strict=False))
        packed = [pa.array([f(x[i:j]) for i, j in spans], pa.binary()) for f, x in ((T.pack_sorted, gram), (T.pack, cid), (T.pack, size), (T.pack, many.astype(np.uint32)))]
        return pa.table([pa.array([to[i] for i, _ in spans], pa.int32()), *packed], names=["target", "grams", "cids", "sizes", "ranks"])

    return run


def _first_again(percent: int, targets: int):
    """The first n-grams of each class in the order of exact counts; n-grams that nothing else holds come first of all."""

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        gram = np.concatenate([T.unpack_sorted(x.as_py()) for x in table.column("grams")])
        cid, size, many = (np.concatenate([T.unpack(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("cids", np.int64), ("sizes", np.uint32), ("ranks", np.uint32)))
        size = size.astype(np.int64)
        order = np.lexsort((gram, many, cid))
        gram, cid, size = gram[order], cid[order], size[order]
        head = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
        held = np.diff(np.r_[head, len(cid)])
        rank = T.ranges(held) + np.repeat(size[head] - held, held)
        first = rank < size - _needed(size, percent) + 1
        if not first.any():
            return pa.table({name: pa.array([], pa.int32() if name == "target" else pa.binary()) for name in ("target", "grams", "cids", "sizes", "ranks")})
        return pa.Table.from_batches([_packed(gram[first], cid[first], size[first], rank[first], targets, percent)])

    return run


def _meet(percent: int):
    """Classes that share a first n-gram and may reach the threshold, as stars.

    The n-grams that follow the shared one bound the overlap of a pair. Where one n-gram is shared by more than
    _RUN classes, they are joined by nearness of their sizes alone, in time linear in their number.
    """

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        joined = table.filter(table.column("sizes").is_null())
        table = table.filter(table.column("sizes").is_valid())
        left, right = ([T.unpack(x.as_py(), np.int64) for x in joined.column(c)] for c in ("grams", "cids"))
        if not len(table):
            a, b = forest(np.concatenate(left), np.concatenate(right))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        gram = np.concatenate([T.unpack_sorted(x.as_py()) for x in table.column("grams")])
        cid, size, rank = (np.concatenate([T.unpack(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("cids", np.int64), ("sizes", np.uint32), ("ranks", np.uint32)))
        size, rank = size.astype(np.int64), rank.astype(np.int64)
        order = np.lexsort((cid, size, gram))
        gram, cid, size, rank = gram[order], cid[order], size[order], rank[order]
        again = np.r_[False, (gram[1:] == gram[:-1]) & (cid[1:] == cid[:-1])]
        gram, cid, size, rank = gram[~again], cid[~again], size[~again], rank[~again]
        near = np.r_[False, (gram[1:] == gram[:-1]) & (size[:-1] * 100 >= percent * size[1:])]
        lead = np.maximum.accumulate(np.where(near, 0, np.arange(len(gram))))
        length = np.bincount(lead, minlength=len(lead))[lead]
        big = near & (length > _RUN)
        left.append(cid[lead[big]])
        right.append(cid[big])
        some = np.flatnonzero((length > 1) & (length <= _RUN))
        gram, cid, size, lead, rank = gram[some], cid[some], size[some], lead[some], rank[some]
        hot = rank == _HOT
        rest = size - rank - 1  # n-grams after the shared one
        for step in range(1, _RUN):
            pair = np.flatnonzero(lead[step:] == lead[:-step])
            if not len(pair):
                break
            other = pair + step
            reach = 1 + np.minimum(rest[pair], rest[other])
            ok = (hot[pair] | hot[other] | ((100 + percent) * reach >= percent * (size[pair] + size[other]))) & (100 * size[pair] >= percent * size[other])
            left.append(cid[pair[ok]])
            right.append(cid[other[ok]])
        a, b = forest(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def linked(sets: list[np.ndarray], queries: np.ndarray, members: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) that reach the threshold; where both lists are one, each pair once.

    sets: sorted arrays of distinct n-grams; queries, members: indices into them.
    """
    size = np.array([len(s) for s in sets], np.int64)
    same = queries is members
    queries = queries[np.argsort(size[queries], kind="stable")]
    members = queries if same else members[np.argsort(size[members], kind="stable")]
    flat = np.concatenate([sets[q] for q in queries])
    at = _bounds(size[queries])
    pairs = []
    for g in range(0, len(members), _GROUP):
        group = members[g : g + _GROUP]
        low, high = size[group[0]], size[group[-1]]
        fit = (100 * size[queries] >= percent * low) & (percent * size[queries] <= 100 * high)
        if same:
            fit[: g + 1] = False
        if not fit.any():
            continue
        a, b = int(np.argmax(fit)), len(fit) - int(np.argmax(fit[::-1]))
        union = np.unique(np.concatenate([sets[m] for m in group]))
        mine = flat[at[a] : at[b]]
        place = np.minimum(np.searchsorted(union, mine), len(union) - 1)
        hit = union[place] == mine
        bound = np.add.reduceat(hit.astype(np.int64), at[a:b] - at[a])
        q = size[queries[a:b]]
        need = -(-percent * (q + np.maximum(low, _needed(q, percent))) // (100 + percent))
        opened = np.flatnonzero(bound >= need)
        if not len(opened):
            continue
        row = np.zeros((len(group), len(union)), bool)  # the group's rows of the matrix
        for j, m in enumerate(group):
            row[j, np.searchsorted(union, sets[m])] = True
        for i in opened:
            some = slice(at[a + i] - at[a], at[a + i + 1] - at[a])
            both = row[:, place[some][hit[some]]].sum(1)
            ok = (100 + percent) * both >= percent * (q[i] + size[group])
            if same:
                ok[max(0, a + i - g) :] = False
            pairs += [(queries[a + i], m) for m in group[ok]]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.array(pairs, np.int64).T
    return x, y


def _read(table: pa.Table, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The set of every row's text, and flags of those that are the row's class (a doc_id can have several texts)."""
    sets: list[np.ndarray] = []
    cids = [np.zeros(0, np.int64)]
    for whole in table.to_batches():
        for batch in T.pieces(whole, "text"):
            _, grams, sizes = ngram_sets(batch.column(batch.schema.get_field_index("text")), n)
            at = _bounds(sizes)
            sets += [grams[a:b] for a, b in zip(at, at[1:], strict=False)]
            cids.append(_class_ids(grams, sizes))
    return sets, np.concatenate(cids) == table.column("cid").to_numpy()


def _open(n: int, percent: int):
    """Compares the blocks of every pair dealt to this task: link counts by class, and forests of the links."""

    @T.thrifty
    def run(table: pa.Table) -> pa.Table:
        key = np.stack([table.column(c).to_numpy() for c in ("comp", "lo", "hi")], 1)
        cid, mult, block = (table.column(c).to_numpy() for c in ("cid", "mult", "g"))
        order = np.lexsort((cid, key[:, 2], key[:, 1], key[:, 0]))
        a, b, counts = [], [], {}
        sets, right = _read(table, n)
        order = order[right[order]]
        change = np.flatnonzero((np.diff(key[order], axis=0) != 0).any(1)) + 1
        for some in np.split(order, change) if len(order) else []:
            some = some[np.r_[True, cid[some][1:] != cid[some][:-1]]]  # repeated rows
            low, high = key[some[0], 1], key[some[0], 2]
            index = np.arange(len(some))
            mine = index[block[some] == low]
            own = [sets[i] for i in some]
            x, y = linked(own, mine, mine, percent) if low == high else (linked(own, index[block[some] == high], mine, percent) if len(mine) and len(mine) < len(some) else (index[:0], index[:0]))
            if len(x):
                x, y = some[x], some[y]
                for u, v in ((x, y), (y, x)):
                    for c, m in zip(cid[u].tolist(), mult[v].tolist(), strict=True):
                        counts[c] = counts.get(c, 0) + m
                a.append(cid[x])
                b.append(cid[y])
        p, q = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = pa.nulls(len(p), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(p, pa.int64()), pa.array(list(counts), pa.int64())]), "b": pa.concat_arrays([pa.array(q, pa.int64()), pa.nulls(len(counts), pa.int64())]), "links": pa.concat_arrays([none, pa.array(list(counts.values()), pa.int64())])})

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links of every document.

    by_row adds cid, the class of the row's set, and root, which names the component also where rows of one doc_id are
    in several (null for an empty set).

    Two documents link when 100 * |A and B| >= percent * |A or B|, with A and B their sets of n words.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    survey = save(rows.mapInArrow(_survey(n), "block int, counts binary, doc_id long, n long, cid long"))
    counts = spark.sparkContext.broadcast(_sketch(survey))  # 4 * 2**SKETCH_BITS bytes
    every = survey.where("block is null").select("doc_id", "n", "cid")
    classes = save(every.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("mult")))
    grams = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    targets = max(2 * parts(spark), grams // _TASK)  # a task's postings do not grow with the corpus
    posted = rows.mapInArrow(_first_grams(n, percent, targets, counts), _POSTED)
    groups = components(posted.groupBy("target").applyInArrow(_meet(percent), "a long, b long"))

    def dealt_out(groups: DataFrame) -> DataFrame:
        """A row a class that met another: its partition, and the number of blocks of that."""
        comp = save(groups.join(classes, groups["node"] == classes["cid"]).select("cid", F.col("root").alias("comp"), "rep", "n", "mult"))
        size = comp.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / _MEMBERS), F.ceil(F.sum("n") / _TOKENS)).alias("blocks")).withColumnRenamed("comp", "c")
        out = save(comp.join(size, comp["comp"] == size["c"]).drop("c"))
        free(comp)
        return out

    def texts_of(some: DataFrame) -> DataFrame:
        """The rows whose doc_id is that of a class (rep), and others by chance."""
        wanted = spark.sparkContext.broadcast(id_filter(some.select("rep"), lambda batch: batch.column(0).to_numpy(zero_copy_only=False)))

        @T.thrifty
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_filter(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))

        return rows.mapInArrow(run, "doc_id long, text string")

    comp = dealt_out(groups)
    large = comp.where("blocks > 1").select("cid", "rep")
    if not large.isEmpty():
        texts = texts_of(large)
        again = texts.join(large, texts["doc_id"] == large["rep"]).select("cid", "text").mapInArrow(_all_grams(n, targets), "target int, grams binary, cids binary, sizes binary")
        again = again.groupBy("target").applyInArrow(_count(targets), _POSTED).groupBy("target").applyInArrow(_first_again(percent, targets), _POSTED)
        again = components(again.groupBy("target").applyInArrow(_meet(percent), "a long, b long"))
        old, comp = comp, dealt_out(again.unionByName(comp.where("blocks = 1").select(F.col("cid").alias("node"), F.col("comp").alias("root"))))
        free(old)
    dealt = comp.select("cid", "comp", "rep", "mult", "blocks", F.pmod(F.xxhash64("cid"), "blocks").alias("g"))
    texts = texts_of(comp)
    asked = texts.join(dealt, texts["doc_id"] == dealt["rep"])
    asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = asked.select("comp", F.least("g", "other").alias("lo"), F.greatest("g", "other").alias("hi"), "g", "cid", "mult", "text")
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("comp", "lo", "hi"), F.lit(4 * targets)).cast("int"))  # more of them, not larger ones, as the corpus grows
    found = save(asked.groupBy("bucket").applyInArrow(_open(n, percent), "a long, b long, links long"))

    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    known = save(roots.join(classes, roots["node"] == classes["cid"]).select("cid", "root", "rep"))
    least = save(known.groupBy("root").agg(F.min("rep").alias("component")).withColumnRenamed("root", "r"))
    of = known.join(least, known["root"] == least["r"]).select(F.col("cid").alias("of2"), "component", *(["root"] if by_row else []))
    label = classes.join(of, classes["cid"] == of["of2"], "left").join(links, classes["cid"] == links["of"], "left")
    root = [F.coalesce("root", "cid").alias("root")] if by_row else []
    label = save(label.select(F.col("cid").alias("label_cid"), F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), *root))
    for x in (comp, found, known, least):
        free(x)
    out = every.join(label, every["cid"] == label["label_cid"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), *(["cid", "root"] if by_row else []))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, of its smallest doc_id; rows without a doc_id or without words stay.

    Rows that repeat a doc_id are judged one by one: of those in one component with the smallest doc_id, the one that
    stays has the smallest class id and then the smallest JSON. Only rows that a filter of fixed size holds for
    possible copies are shuffled to be looked up, and only those of doubtful doc_ids are hashed again.
    """
    spark = docs.sparkSession
    found = jaccard_components(docs, n, percent, by_row=True)
    pairs = save(found.groupBy("doc_id", "cid", "root", "component_id").agg(F.count("*").alias("m")))
    copies = F.sum(F.when(F.col("component_id") != F.col("doc_id"), F.col("m")).otherwise(0)).alias("copies")
    per = pairs.groupBy(F.col("doc_id").alias("gone")).agg(F.sum("m").alias("m"), copies).where("copies > 0 or m > 1")
    per = save(per.select("gone", (F.col("copies") < F.col("m")).alias("doubtful")))
    ids = lambda batch: batch.column(0).to_numpy(zero_copy_only=False)
    at = docs.columns.index("doc_id")

    def part(held, wanted: bool):
        @T.thrifty
        def run(batches):
            for batch in batches:
                own = batch.column(at).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(in_filter(held.value, own) == wanted))

        return run

    held = spark.sparkContext.broadcast(id_filter(per.select("gone"), ids))
    some = docs.mapInArrow(part(held, True), docs.schema)
    out = docs.mapInArrow(part(held, False), docs.schema).union(some.join(per, some["doc_id"] == per["gone"], "left_anti"))
    doubtful = per.where("doubtful").select("gone")
    if doubtful.isEmpty():
        return out

    cid = fresh(docs, "cid")

    @T.thrifty
    def classed(batches):
        for whole in batches:
            for batch in T.pieces(whole, "text"):
                _, grams, sizes = ngram_sets(batch.column(batch.schema.get_field_index("text")), n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_class_ids(grams, sizes), mask=sizes == 0)], names=[*batch.schema.names, cid])

    stays = pairs.where("root is not null and component_id = doc_id").join(doubtful, F.col("doc_id") == F.col("gone"), "left_semi")
    stays = save(stays.groupBy("doc_id", "root").agg(F.min("cid").alias("stays")).select(F.col("doc_id").alias("of"), "stays"))
    held = spark.sparkContext.broadcast(id_filter(doubtful, ids))
    again = docs.mapInArrow(part(held, True), docs.schema).mapInArrow(classed, StructType([*docs.schema, StructField(cid, LongType())]))
    empty = again.where(F.col(cid).isNull()).join(doubtful, F.col("doc_id") == F.col("gone"), "left_semi").select(*docs.columns)
    row = F.struct(*docs.columns)
    first = again.join(stays, (again["doc_id"] == stays["of"]) & (again[cid] == stays["stays"]))
    first = first.groupBy("of", "stays").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return out.union(empty).union(first)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
