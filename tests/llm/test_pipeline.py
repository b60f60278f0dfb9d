"""The pipeline against brute force, stage by stage."""

import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from ledgerline.llm import scratch

from .test_documents import WORD, brute_components, brute_quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    good = scratch.save(P.good_quality(spark, docs, sf))
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in good.collect()}
    assert not any(brute_quality(rows[d].text)[-1] for d in kept)
    clean = [d for d, r in rows.items() if not brute_quality(r.text)[-1] and not re.search(r"[#*$%&|<>]", r.text)]
    assert set(clean) <= kept

    unique = scratch.save(P.near_unique(spark, good, sf))
    least = {d for d, _, c, _ in brute_components([(r.doc_id, r.text) for r in good.collect()], 5, 80) if d == c}
    assert {r.doc_id for r in unique.collect()} == least

    cut = scratch.save(P.no_repeats(spark, unique, sf))
    seen, low = {}, {}
    for r in unique.collect():
        words = WORD.findall(r.text)
        for i in range(len(words) - 12):
            low[tuple(words[i : i + 13])] = min(r.doc_id, low.get(tuple(words[i : i + 13]), r.doc_id))
    for r in unique.collect():
        words = WORD.findall(r.text)
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if low[tuple(words[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = [True] * 13
        seen[r.doc_id] = [w for w, x in zip(words, gone, strict=True) if not x]
    assert {r.doc_id: WORD.findall(r.text) for r in cut.collect()} == seen

    mixed = scratch.save(P.mix(spark, cut, sf))
    drawn = Counter()
    for r in mixed.collect():
        drawn[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * len(seen[d]) for d, n in drawn.items())
    assert abs(sum(drawn.values()) - sum(map(len, seen.values()))) <= 0.01 * sum(drawn.values()) + 20

    packed = P.pack(spark, mixed, sf)
    assert packed.agg(F.sum("n_words")).first()[0] == sum(drawn.values())
    assert all(d.columns == columns for d in (good, unique, cut, mixed))
    assert mixed.where(F.col("n_chars") != F.length("text")).isEmpty()


def test_run_equals_its_stages(spark, sf):
    assert [name for name, _ in P.STAGES] == ["quality", "near_copies", "substrings", "mixing", "packing"]
    a, b = (sorted(map(tuple, P.run(spark, sf).collect())) for _ in range(2))
    assert a == b and a


def test_repeated_rows(spark):
    """Near copies go row by row: a doc_id can have several texts, and equal rows are copies of each other."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, ""), (6, ""), (6, None), (7, c), (7, c), (8, d), (8, d + " more"), (9, d + " words"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in P.near_unique(spark, docs.repartition(3), "").collect())
    eighth = [t for i, t in got if i == 8]
    assert len(eighth) == 1 and eighth[0].startswith(d)
    assert got == Counter([(3, a), (5, b), (6, ""), (6, ""), (6, None), (7, c), (8, eighth[0]), (None, a), (None, a)])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = scratch.save(stage(spark, docs, ""))
    assert docs.isEmpty()
