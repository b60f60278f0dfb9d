"""Chat formatting with offset-aligned loss masks.

A conversation's turns, in order of `turn`, are rendered into one string; the whole string is encoded once with
offsets; and each turn's span is intersected with the sorted token spans by binary search. A token is under the
loss mask if its span meets the span of an assistant's text. The template's marks are tokens of their own, so the tokens
under the mask hold all of the assistants' texts and nothing else; the loss spans are read from the mask.

A turn is rendered as `<s>[INST] role [/INST] text</s>`. Control strings inside roles and texts are escaped: a
backslash is doubled, and a control string gets one backslash after its first character; unescape() undoes it.

Defined results: a null text or role is empty; rows with a null conv_id are one conversation; turns that tie are
ordered by role, then text, nulls first; repeated rows are turns of their own; a conversation without text
renders its empty turns, which put no token under the mask; an empty table gives an empty result; extra columns are ignored. Whole texts are
encoded. A conversation is one string by definition, so it has to fit one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE, one base64 token and its rank a line; every executor reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts a text before merging, with a bound on one run of white space (its matcher
# keeps a stack entry for each character that it may give back).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s{1,4000}(?!\S)|\s{1,4000}"

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
START, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"

_ESCAPE = re.compile(r"\\|(?=" + "|".join(re.escape(c) for c in CONTROLS) + r")(.)", re.S)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[1] is None else m[1] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the span of each turn's text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        out += (head, body, END)
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Flags of the tokens that meet a span; starts and ends are sorted, several tokens may share one character."""
    flags = np.zeros(len(starts), bool)
    for low, high in spans:
        if low < high:
            flags[int(np.searchsorted(ends, low, "right")) : int(np.searchsorted(starts, high, "left"))] = True
    return flags


def covered(starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> list[tuple[int, int]]:
    """The characters of the flagged tokens as spans, whole tokens, in order."""
    s, e = starts[flags], ends[flags]
    if not len(s):
        return []
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[first].tolist(), e[np.r_[first[1:] - 1, len(e) - 1]].tolist(), strict=True))


class Encoder:
    """Byte-level BPE with offsets in characters. The template's marks are tokens of their own, so no token holds
    characters of a mark and of a text; in texts they cannot occur, as texts are escaped."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.marks = {mark: max(ranks.values()) + 2 + i for i, mark in enumerate((START, MIDDLE, END))}
        self._bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.marks)
        self._length = np.zeros(max(self.marks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._length[rank] = len(token)
        for mark, rank in self.marks.items():
            self._length[rank] = len(mark)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, and the first and last-but-one character of each; a token of a character's part has all of it."""
        ids = self._bpe.encode_to_numpy(text, allowed_special="all").astype(np.int64)
        ends = np.cumsum(self._length[ids])
        if text.isascii():
            return ids, ends - self._length[ids], ends
        lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return ids, lead[ends - self._length[ids]] - 1, lead[ends - 1]


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


_FORMATTED = "conv_id long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:long,end:long>>"
_LOT = 64


def _format(path: str, batches):
    encoder = _encoder(path)
    for batch in batches:
        for low in range(0, len(batch), _LOT):
            part = batch.slice(low, _LOT)
            ids, masks, spans, whole = [], [], [], []
            for turns in part.column(1).to_pylist():
                text, texts = render([(t["role"] or "", t["text"] or "") for t in turns])
                tokens, starts, ends = encoder.encode(text)
                flags = mask(starts, ends, [s for t, s in zip(turns, texts, strict=True) if t["role"] == "assistant"])
                whole.append(text)
                ids.append(tokens.astype(np.int32))
                masks.append(flags)
                spans.append([{"start": a, "end": b} for a, b in covered(starts, ends, flags)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(whole, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"],
            )


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, the rendered string, its token ids, the loss mask by token, and the character spans under it."""
    rows = turns.select(F.col("conv_id").cast("long"), F.struct("turn", "role", "text").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(partial(_format, vocabulary), _FORMATTED)


def _digest(batches):
    """What can be read back from a formatted conversation."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns, loss = parse(r["formatted"]), "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
            told = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            rows.append((r["conv_id"], len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    found = formatted(turns.unionByName(extra)).select("conv_id", "formatted", "loss_spans")
    return found.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
