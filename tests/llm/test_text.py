import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import text as T
from ledgerline.llm.scratch import forest, in_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é  \n\t\x0b\r\x1c😀", max_size=40)), max_size=8)


@settings(deadline=None)
@given(TEXTS)
def test_words_are_the_patterns(texts):
    data, offsets = T.string_buffers(pa.array(texts, pa.string()))
    starts, ends, first = T.word_spans(data, offsets)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
    assert got == [WORD.findall(t or "") for t in texts]
    hashes = T.word_hashes(data, starts, ends).tolist()
    words = [w for ws in got for w in ws]
    assert len(set(hashes)) == len(set(words)) and len(dict(zip(words, hashes, strict=True))) == len(set(words))


def test_hash_does_not_depend_on_the_place():
    words = ["x" * 70_000, "y", "x" * 70_000, "z" * 600_000, "y", "é" * 40_000]
    data, offsets = T.string_buffers(pa.array([" ".join(words)] * 2))
    starts, ends, first = T.word_spans(data, offsets)
    h = T.word_hashes(data, starts, ends)
    assert (h[:6] == h[6:]).all() and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert first.tolist() == [0, 6, 12]


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packing_round_trip(values):
    x = np.sort(np.array(values, np.uint64))
    assert (T.unpack(T.pack(x), np.uint64) == x).all() and (T.unpack_sorted(T.pack_sorted(x)) == x).all()


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (5, 0, 30, 1, 1, 200)] + [None]), "n": list(range(7))})
    got = list(T.pieces(batch, "text", 32))
    assert [n for p in got for n in p.column(1).to_pylist()] == list(range(7)) and len(got) > 2
    assert list(T.pieces(batch.slice(0, 0), "text")) == []


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20))))
def test_forest(edges):
    a, b = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    p, q = forest(a, b)
    root = {int(y): int(x) for x, y in zip(p, q, strict=True)}
    group = {}
    for x, y in edges:
        gx, gy = group.setdefault(x, {x}), group.setdefault(y, {y})
        if gx is not gy:
            gx |= gy
            for z in gy:
                group[z] = gx
    for node, members in group.items():
        assert root.get(node, node) == min(members)


def test_filter_bits():
    from ledgerline.llm.scratch import FILTER_BITS, _cells

    bits = np.zeros(1 << FILTER_BITS, bool)
    ids = np.array([5, -3, 2**40])
    bits[_cells(ids)] = True
    raw = np.packbits(bits).tobytes()
    assert in_filter(raw, ids).all() and in_filter(raw, np.arange(1000, 2000)).sum() < 5
