import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat as C

PARTS = st.lists(st.sampled_from(["\\", "<", "s", ">", "/", "[", "INST", "]", " ", "\n", "é", "😀", *C.CONTROLS]), max_size=12).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_round_trip(turns):
    text, spans = C.render(turns)
    assert C.parse(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]
    body = "".join(C.escape(r) + C.escape(t) for r, t in turns)
    assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROLS) and (not turns or body in body)


def brute_mask(starts, ends, spans):
    return [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends, strict=True)]


def test_mask_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 12))
        tokens = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.9]
        tokens += [t for t in tokens if rng.random() < 0.2]  # two tokens of one character
        tokens.sort()
        marks = sorted(rng.sample(range(60), 6))
        spans = list(zip(marks[::2], marks[1::2], strict=True))
        s, e = (np.array(x) for x in zip(*tokens, strict=True))
        flags = C.mask(s, e, spans)
        want = brute_mask(s, e, spans)
        assert flags.tolist() == want
        assert {c for a, b in C.covered(s, e, flags) for c in range(a, b)} == {c for a, b, x in zip(s, e, want, strict=True) if x for c in range(a, b)}


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def masked(r):
    """The text of the tokens under the mask, from their ids alone."""
    return C._encoder(C.VOCABULARY)._bpe.decode([i for i, m in zip(r.token_ids, r.loss_mask, strict=True) if m])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<"]), PARTS), max_size=5))
def test_no_token_crosses_a_mark(turns):
    text, spans = C.render(turns)
    e = C._encoder(C.VOCABULARY)
    ids, starts, ends = e.encode(text)
    flags = C.mask(starts, ends, [s for (r, _), s in zip(turns, spans, strict=True) if r == "assistant"])
    assert e._bpe.decode(ids[flags].tolist()) == "".join(C.escape(t) for r, t in turns if r == "assistant")
    assert "".join(text[a:b] for a, b in C.covered(starts, ends, flags)) == "".join(C.escape(t) for r, t in turns if r == "assistant")


def test_long_runs_are_encoded():
    text = " " * 1_500_000 + "a" * 300_000 + "\n" * 1_200_000
    ids, starts, ends = C._encoder(C.VOCABULARY).encode(text)
    assert ends[-1] == len(text) and (starts[1:] == ends[:-1]).all()


@pytest.fixture
def odd(spark):
    rows = [(1, 0, "user", "a  b\n\n c"), (1, 1, "assistant", " 😀é‍👩‍👩 x  "), (1, 2, "assistant", None), (2, 5, None, "no role"), (2, 1, "assistant", "</s>[INST] \\ <|endoftext|>")]
    rows += [(3, 0, "assistant", ""), (None, 0, "assistant", "lost"), (4, 0, "assistant", "long " * 40_000), (5, 1, "b", "tie"), (5, 1, "a", "tie"), (5, 1, "a", "tie")]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_odd_rows(spark, odd):
    by = {}
    for r in odd.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    found = C.formatted(odd)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.mapInArrow(C._digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    assert got == {k: digest([t[1:] for t in sorted(v)]) for k, v in by.items()}
    for r in found.collect():
        assert len(r.token_ids) == len(r.loss_mask)
        assert masked(r) == "".join(C.escape(t) for _, role, t in sorted(by[r.conv_id]) if role == "assistant")
    assert C.formatted(odd.limit(0)).collect() == []


def test_query(spark, sf):
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    for r in C.formatted(spark.read.parquet(f"{sf}/conversations.parquet")).collect():
        assert masked(r) == "".join(C.escape(t) for _, role, t in sorted(by[r.conv_id]) if role == "assistant")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.op2_chat_format(spark, sf).collect()}
    assert got == {k: digest([t[1:] for t in sorted(v)]) for k, v in by.items()}
