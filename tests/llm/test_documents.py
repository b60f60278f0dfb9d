"""Operators over documents against brute force, on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import mixing, ngram, packing, quality, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, __key int"


def corpus():
    """Texts with copies, near copies, shared passages, ties, nulls, empty and long texts; odd extra columns."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(300)] + ["É", "The", "the", "x y"]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    base, passage = make(80), make(40)
    texts = [" ".join(base)] * 3
    for edits in (1, 1, 2, 2, 3, 4, 6, 9):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(pool)
        texts.append("\n".join(words))
    texts += [" ".join(make(20) + passage + make(30)) for _ in range(6)]
    texts += [" ".join(passage[5:18]), " ".join(passage[5:17]), "one two three", "ONE two\tthree", "one", "", " \n\t", None, None, "a b c d", "A B C D"]
    texts += [" ".join(make(6000)), " ".join(make(25) * 3), "\n".join(["same line here"] * 30), "### " * 60 + " ".join(make(30))]
    texts += [" ".join(make(rng.randrange(1, 120))) for _ in range(30)]
    rows = [(3 * i if i % 7 else 1000 - i, t, ["en", "de", None][i % 3], ["s1", "s2", "é", None][i % 4], 0, "t", i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5]]  # repeated rows
    rows.append((*rows[7][:1], " ".join(passage), *rows[7][2:]))  # a doc_id with another text
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(rows, n, percent):
    sets = [(r[0], grams(r[1], n)) for r in rows]
    root, links = {d: d for d, _ in sets}, [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets):
            if i != j and s and t and 100 * len(s & t) >= percent * len(s | t):
                links[i] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), k) for (d, s), k in zip(sets, links, strict=True))


def unique_ids(rows):
    seen = set()
    return [r for r in rows if r[0] not in seen and not seen.add(r[0])]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, rows, n, percent):
    rows = unique_ids(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in ngram.jaccard_components(docs, n, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute_components(rows, n, percent)
    assert len({r[2] for r in got}) < len(got)


def test_jaccard_in_small_blocks(spark, rows, monkeypatch):
    """Groups dealt over many blocks, and shared n-grams beyond the bound for pairs."""
    monkeypatch.setattr(ngram, "_MEMBERS", 2)
    rows = unique_ids(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in ngram.jaccard_components(docs, 2, 50).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute_components(rows, 2, 50)


def shared_sentences(count=300):
    """Documents that share sentences, none of them alike."""
    rng = random.Random(9)
    pool = [[f"{rng.randrange(5000)}w" for _ in range(12)] for _ in range(count)]
    return [(i, " ".join(w for s in rng.sample(pool, 9) for w in s)) for i in range(count)]


def test_shared_sentences_make_no_large_partition(spark, monkeypatch):
    """Exact counts part what a full sketch throws together."""
    seen = []
    monkeypatch.setattr(ngram, "SKETCH_BITS", 12)  # one block of cells
    sketch = ngram._sketch
    monkeypatch.setattr(ngram, "_sketch", lambda survey: np.zeros_like(sketch(survey)))  # tells nothing
    found = ngram.components
    monkeypatch.setattr(ngram, "components", lambda edges: seen.append(found(edges)) or seen[-1])
    rows = shared_sentences()
    base = rows[0][1].split()
    rows += [(1000 + i, " ".join([*base[:-1], f"new{i}"])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in ngram.jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute_components(rows, 4, 85)
    first, again, _ = [max((r["count"] for r in x.groupBy("root").count().collect()), default=0) for x in seen]
    assert first > 2 * ngram._MEMBERS and again <= 4


def test_hot_ngrams_are_thinned(spark, monkeypatch):
    """A common n-gram of many classes: only a chain of them leaves a task, and no link is lost."""
    monkeypatch.setattr(ngram, "_RUN", 3)
    monkeypatch.setattr(ngram, "_MEMBERS", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[: rng.randint(8, 60)] + [f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 4))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in ngram.jaccard_components(docs, 2, 80).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute_components(rows, 2, 80)
    gram, size = np.repeat(np.array([3, 5], np.uint64), [50, 2]), np.r_[np.sort(np.random.default_rng(1).integers(10, 90, 50)), 4, 9]
    keep, rank, edges = ngram._thinned(gram, size, np.zeros(52, np.int64), 80)
    kept = size[:50][keep[:50]]
    assert keep[50:].all() and keep.sum() < 30 and (rank[:50] == ngram._HOT).all() and not rank[50:].any()
    for s in range(8, 112):  # any class that fits one of the others fits a link of the chain
        if any(min(s, x) * 100 >= 80 * max(s, x) for x in size[:50]):
            assert any(min(s, x) * 100 >= 80 * max(s, x) for x in kept)
    assert set(edges.ravel().tolist()) | set(np.flatnonzero(keep).tolist()) == set(range(52))


def test_linked_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 40, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.3, rng.integers(0, 2**60, 40, dtype=np.uint64), base))[: rng.integers(30, 41)] for _ in range(60)]
    index = np.arange(60)
    for left, right in ((index, index), (index[:25], index[25:])):
        same = left is right
        x, y = ngram.linked(sets, left, left if same else right, 70)
        got = sorted(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True))
        want = []
        for i in left:
            for j in right:
                if (i < j if same else True) and 170 * len(np.intersect1d(sets[i], sets[j])) >= 70 * (len(sets[i]) + len(sets[j])):
                    want.append((i, j))
        assert got == sorted(want) and want


def test_jaccard_odd_rows(spark, docs, empty, rows):
    assert ngram.jaccard_components(empty).collect() == []
    got = ngram.jaccard_components(docs, 4, 85).collect()
    assert len(got) == len(rows)
    with_null = spark.createDataFrame([(None, "a b c d e", None, None, None, None, None), (2, "a b c d e", None, None, None, None, None)], SCHEMA)
    assert [(r.doc_id, r.component_id) for r in ngram.jaccard_components(with_null).collect()] == [(2, 2)]
    kept = ngram.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    least = {r.doc_id for r in got if r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.collect()} == least
    assert ngram.one_of_each(with_null).count() == 2


def brute_repeats(rows, k=13):
    low, out = {}, []
    for d, t, *_ in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - k + 1):
            key = tuple(words[i : i + k])
            low[key] = min(d, low.get(key, d))
    for d, t, *_ in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if low[tuple(words[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = [w for w, x in zip(words, gone, strict=True) if not x]
        out.append((d, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("held", [40, 700_000])
def test_substrings(docs, rows, held, monkeypatch):
    monkeypatch.setattr(substring, "_HELD", held)  # on the driver only: the task functions are sent by name
    got = sorted(tuple(r) for r in substring.repeated_words(docs).collect())
    assert got == brute_repeats(rows)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("bits", [8, 16])
def test_substrings_with_colliding_hashes(docs, rows, bits):
    """Spans are verified by their words: hashes of few bits collide everywhere and change nothing."""
    got = sorted(tuple(r) for r in substring.repeated_words(docs, bits=bits).collect())
    assert got == brute_repeats(rows)


def test_map_side_flushes(rows):
    import pyarrow as pa

    class Held:
        value = bytes(1 << 17)

    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})
    old, substring._HELD = substring._HELD, 30
    try:
        small = list(substring._edges(13, 56, 6, 2, Held)(iter([batch.slice(i, 5) for i in range(0, len(batch), 5)])))
    finally:
        substring._HELD = old
    assert len(small) > 3 and {k for b in small for k in b.column(1).to_pylist()} <= {0, 1}


def test_substrings_cut_texts(spark, docs, rows, empty):
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = sorted((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect())
    assert got == sorted((d, h) for d, _, _, h in brute_repeats(rows))
    assert sum(r.text is None for r in out.collect()) == sum(r[1] is None for r in rows)
    assert substring.repeated_words(empty).collect() == [] == substring.remove_repeats(empty).collect()
    text = " ".join(f"v{i}" for i in range(20))
    odd = spark.createDataFrame([(None, text, None, None, None, None, None), (1, text, None, None, None, None, None), (2, f"x  {text}\n y", None, None, None, None, None)], SCHEMA)
    assert sorted(((r.doc_id or 0), r.text) for r in substring.remove_repeats(odd).collect()) == [(0, text), (1, text), (2, "x  \n y")]


def brute_quality(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, rep = len(words), sum(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_quality_counts(docs, rows, empty):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(docs).collect())
    assert got == sorted((r[0], *brute_quality(r[1])) for r in rows)
    assert all(not r.kept for r in quality.verdicts(docs).collect() if r.base_failed)
    assert quality.verdicts(empty).collect() == [] == quality.keep_good(empty).collect()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.verdicts(docs).collect() if r.kept)


def test_quality_rejects_outliers_and_keeps_prose(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for i in range(900):
        words = [rng.choice(pool) for _ in range(rng.randint(60, 400))]
        bad = i % 10 == 0
        if bad:
            words = [w + rng.choice(["***", "$$$", "|", "%%"]) for w in words]
        rows.append((i, " ".join(words), ["en", "de"][i % 2], f"s{i % 3}", 0, None, None))
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (i % 10 != 0) for i in got)


def cells_of(v):
    """One cell a vector."""
    return np.concatenate([np.ones((len(v), 1)), v, np.stack([v[:, i] * v[:, j] for i, j in quality._PAIRS], 1)], 1)


def test_mcd_is_the_smallest_determinant():
    """Small sets against all subsets: no subset of the covered share has a smaller determinant."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    floor = np.full(4, 1e-3)
    for _ in range(6):
        v = np.concatenate([rng.normal(0, 1, (6, 4)), rng.normal(5, 0.3, (4, 4))])[rng.permutation(10)]
        mu, cov = quality.mcd(cells_of(v), floor, 0.6, starts=200)
        dets = []
        for some in combinations(range(10), 6):
            x = v[list(some)]
            dets.append(np.linalg.slogdet(np.cov(x.T, bias=True) + np.diag(floor))[1])
        assert np.linalg.slogdet(cov + np.diag(floor))[1] == pytest.approx(min(dets), abs=0.05)


def test_mcd_resists_a_third_of_outliers():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, (700, 4)), rng.normal(40, 1, (300, 4))])
    mu, cov = quality.mcd(cells_of(v))
    d = v - mu
    far = np.einsum("ni,ij,nj->n", d, np.linalg.inv(quality.CONSISTENCY * cov), d)
    assert np.abs(mu).max() < 0.2 and far[700:].min() > quality.CUTOFF > np.quantile(far[:700], 0.995)
    assert quality.CUTOFF == pytest.approx(28.47, abs=0.01) and quality.CONSISTENCY == pytest.approx(1.821, abs=0.001)


def test_every_pair_has_its_fit(spark):
    """Many small pairs and languages: clean rows of a rare language stay, whatever the languages around it."""
    rng = random.Random(2)
    rows, n = [], 0
    for k in range(60):
        low = 2 + k % 9  # word lengths differ by language
        pool = ["".join(rng.choices("abcdefghij", k=rng.randint(low, low + 4))) for _ in range(400)]
        for s in range(2):
            for i in range(1 if k < 20 else 9):
                words = [rng.choice(pool) for _ in range(rng.randint(60, 200))]
                if i == 8:
                    words = [w + "$#|*" for w in words]
                rows.append((n, " ".join(words), f"l{k}", f"s{k}-{s}", i, None, None))
                n += 1
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[r[0]] for r in rows] == [r[4] != 8 for r in rows]


def test_verdicts_by_brute_force(docs, rows):
    """The distance of every row, from the fits by numpy alone."""
    _, fits = quality.fit(docs)
    held = {(r.l, r.s): (np.array(r.mu), np.array(r.inverse)) for r in fits.collect()}
    text = defaultdict(list)
    for r in rows:
        n, chars, sym, dup, rep, failed = brute_quality(r[1])
        m = max(n, 1)
        v = np.array([np.log(max(chars, 1) / m), (sym / m) ** 0.5, (dup / m) ** 0.5, (rep / m) ** 0.5])
        if failed:
            text[r[0]].append(False)
        else:
            mu, inverse = held[r[2], r[3]]
            full = np.zeros((4, 4))
            for k, (i, j) in enumerate(quality._PAIRS):
                full[i, j] = inverse[k]
            text[r[0]].append(bool((v - mu) @ full @ (v - mu) <= quality.CUTOFF))
    got = defaultdict(list)
    for r in quality.verdicts(docs).collect():
        got[r.doc_id].append(r.kept)
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in text.items()}


def test_mixing(docs, rows, empty):
    got = mixing.draw(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(s for s in size if s is not None) + [None]
    target = dict(zip(names, brute_targets([size[s] for s in names], [1, 2, 3, 1]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        assert r.taken == sum(p.words for p in r.pieces) and all(0 <= p.start and p.start + p.words <= r["size"] for p in r.pieces)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in names)
    for again in (mixing.draw(docs.repartition(3)), mixing.draw(docs, shards=7)):
        assert sorted((r.doc_id, r["size"], r.taken) for r in got) == sorted((r.doc_id, r["size"], r.taken) for r in again.collect())
    assert mixing.draw(empty).collect() == [] == mixing.mixed(empty).collect()


def brute_targets(sizes, weights):
    """Water filling by bisection on the level that a unit of weight gets."""
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(3 * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = mid
        else:
            high = mid
    return [min(3 * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_mixed_texts(spark, docs, rows):
    """What mixed() returns is what draw() takes, for repeated rows as well, and is the same again from other partitions."""
    by = defaultdict(list)
    for r in rows:
        by[r[0], r[3]].append(WORD.findall(r[1] or ""))
    runs = []
    for part in (docs, docs.repartition(7)):
        out = mixing.mixed(part)
        assert out.columns == docs.columns
        out = out.collect()
        words = Counter()
        for r in out:
            mine = WORD.findall(r.text)
            assert any(mine == w[: len(mine)] for w in by[r.doc_id, r.source])
            words[r.doc_id] += len(mine)
        drawn = Counter()
        for r in mixing.draw(part).collect():
            drawn[r.doc_id] += r.taken
        assert +words == +drawn
        runs.append(sorted(map(str, out)))
    assert runs[0] == runs[1]


def test_mixed_repeats(spark):
    rows = [(7, " ".join(f"w{i}" for i in range(500)), "a", n) for n in range(4)] + [(8, "x " * 150, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    taken = {s: sum(r.taken for r in mixing.draw(docs).collect() if r.source == s) for s in "ab"}
    assert taken == {"a": 1700, "b": 450}
    for _ in range(2):
        out = mixing.mixed(docs).collect()
        assert {s: sum(len(r.text.split()) for r in out if r.source == s) for s in "ab"} == taken


def test_targets_and_split():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000, 10], [1, 2, 3]) == pytest.approx([30, 960, 30])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []
    got = mixing.split(np.array([1000, 0, 37, 5]), 16, 3)
    assert got.sum(0).tolist() == [1000, 0, 37, 5] and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 4 and (got == mixing.split(np.array([1000, 0, 37, 5]), 16, 3)).all()


def test_split_beyond_the_sampler():
    quota = np.array([7 * 10**10, 3, 10**9 + 7])
    got = mixing.split(quota, 5, 1)
    assert got.sum(0).tolist() == quota.tolist() and (got >= 0).all()
    assert abs(got[:, 0] / quota[0] - 0.2).max() < 1e-4


def test_permutation():
    for n in (1, 2, 3, 7, 100, 1025):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(x.tolist()) == list(range(n))


def brute_padding(lengths, buckets):
    from itertools import combinations

    xs = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(xs)) + 1):
        for ends in combinations(xs[:-1], k - 1):
            ends = [*ends, xs[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(20):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 14))]
        count = Counter(lengths)
        ends = packing.boundaries(list(count), list(count.values()), buckets)
        assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, buckets)
    assert packing.boundaries([], [], 3) == []


def test_packing(docs, rows, empty):
    clash = docs.withColumnRenamed("target", "slot")
    out = packing.packed(clash, max_words=64, budget=200, buckets=4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot_", "__key", *packing.PACKED]
    got = out.collect()
    want = Counter()
    for r in rows:
        words = WORD.findall(r[1] or "")
        for start in range(0, max(len(words), 1), 64):
            want[(r[0], r[2], r[3], r[6], start, tuple(words[start : start + 64]))] += 1
    assert Counter((r.doc_id, r.lang, r.source, r[6], r.start_word, tuple(WORD.findall(r.text or ""))) for r in got) == want
    assert {r.text for r in got if r.n_words == 0} == {r[1] for r in rows if not WORD.search(r[1] or "")}
    batches = defaultdict(list)
    for r in got:
        assert r.n_words == len(WORD.findall(r.text or "")) and r.padding == r.bucket_len - r.n_words >= 0
        batches[r.batch_id].append(r)
    for b in batches.values():
        assert len({r.bucket_len for r in b}) == 1 and len({r[-2] for r in b}) == len(b)
        assert len(b) * b[0].bucket_len <= 200 or len(b) == 1
    room = {r.bucket_len: max(1, 200 // max(1, r.bucket_len)) for r in got}
    short = Counter(b[0].bucket_len for b in batches.values() if len(b) < room[b[0].bucket_len])
    assert max(short.values()) <= 1  # only a bucket's last batch is not full
    assert brute_padding([r.n_words for r in got], 4) == sum(r.padding for r in got)
    again = packing.packed(clash.repartition(3), max_words=64, budget=200, buckets=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.packed(empty).collect() == []


def test_queries_run(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for query in (ngram.op1_ngram_jaccard, mixing.op3_mix_sources, quality.op6_quality_rules, substring.op10_substring_dedup):
        assert query(spark, sf).count() == n
    assert packing.op4_pack_sequences(spark, sf).count() >= n
