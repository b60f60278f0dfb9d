import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import scratch as S


@pytest.mark.parametrize("limit", [1_000_000, 20, 0])
def test_components(spark, monkeypatch, limit):
    """The one-task end, rounds before it, and rounds only."""
    monkeypatch.setattr(S, "ONE_TASK", limit)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = S.components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert {r.node: r.root for r in got.collect()} == want
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("lots", [1, 5, 256, None])
def test_offsets(spark, lots):
    rows = [(["a", "b", None][i % 3], i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, n long").withColumn("h", F.xxhash64("id")).repartition(5)
    lots = lots or S.lots_of(spark)
    got = S.offsets(df, ["k"], ["h", "id"], "n", "low", S.lot_bases(df, ["k"], "h", "n", lots), lots).collect()
    for key in ("a", "b", None):
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: (r.h, r.id)):
            assert r.low == total
            total += r.n
    assert len(got) == 200


def test_save_and_fresh(spark):
    df = S.save(spark.range(5).withColumn("__x", F.lit(1)))
    assert df.count() == 5 and S.fresh(df, "__X") == "__X_" and S.fresh(df, "y") == "y"
    path = df._scratch_path
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    S.free(df)


def test_catalog_names_every_operator():
    from ledgerline.llm import catalog

    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
    assert set(catalog.ORACLES) == {"op7_license_scan"}
