"""Chat formatting: conversations assembled column by column into one Arrow buffer.

A turn is written as ``<turn ROLE>`` newline TEXT ``</turn>`` newline. Inside roles and texts
a backslash goes before every backslash and every ``>``, before ``<turn`` and ``</turn`` and
before ``###``, so that a control string in a text never reads as one, and taking each backslash away again
gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.llm._arrow import extended, map_slices, named

# The template.
OPEN, OPEN_END, CLOSE = b"<turn ", b">\n", b"</turn>\n"
_CONTROL = r"(\\|</?turn|###|>)"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/turn>\n))*+)</turn>\n", re.DOTALL)
LOSS_ROLE = "assistant"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _CONTROL, r"\\\1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length) of a string array."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out[to[i]:]``, all segments by one index array."""
    total = int(length.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def assemble(roles: pa.Array, texts: pa.Array, turns_per_row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One string for each conversation, and where each turn's text starts and ends in its bytes.

    ``roles`` and ``texts`` hold all turns of all conversations in order; null counts as empty.
    """
    role, role_at, role_len = _bytes_of(escaped(pc.fill_null(roles, "")))
    text, text_at, text_len = _bytes_of(escaped(pc.fill_null(texts, "")))
    n = len(role_len)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, OPEN_END, CLOSE)]
    # Lengths of the five segments of each turn, and from their running sum each one's place.
    seg = np.stack([np.full(n, len(OPEN)), role_len, np.full(n, len(OPEN_END)), text_len, np.full(n, len(CLOSE))], axis=1).astype(np.int64)
    ends = np.cumsum(seg.ravel()).reshape(n, 5)
    to = ends - seg
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, part in zip((0, 2, 4), fixed):
        out[to[:, k, None] + np.arange(len(part))] = part
    _scatter(out, to[:, 1], role, role_at, role_len)
    _scatter(out, to[:, 3], text, text_at, text_len)
    last = np.cumsum(turns_per_row)
    offsets = np.concatenate([[0], ends[:, -1]])[np.concatenate([[0], last])].astype(np.int64) if n else np.zeros(len(turns_per_row) + 1, np.int64)
    rows = pa.Array.from_buffers(pa.large_string(), len(turns_per_row), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    first = np.repeat(offsets[:-1], turns_per_row)
    return rows, to[:, 3] - first, ends[:, 3] - first


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def chat_format(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its formatted text and loss mask.

    Returns ``conv_col``, ``formatted`` and ``loss`` (start, end in UTF-8 bytes of each
    assistant text in ``formatted``, escapes included). Turns go by ``turn_col``, then role,
    then text, nulls first, so ties have one order; repeated rows stay repeated turns. A null
    role or text is empty, an empty table gives an empty result; other columns are not read. A
    row with a null conversation belongs to no other row: it is a conversation of its one turn,
    with a null id. A conversation is one string, so its text is bounded by Arrow's 2 GB.
    """
    turn = F.struct(named(turn_col, "turn"), named(role_col, "role"), named(text_col, "text"))
    turns = df.select(named(conv_col, "conv"), turn.alias("turn"))
    grouped = turns.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.unionByName(turns.where("conv IS NULL").select("conv", F.array("turn").alias("turns")))
    rows = grouped.select("conv", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        roles, texts = batch.column(1), batch.column(2)
        per_row = np.asarray(pc.list_value_length(texts), np.int64)
        flat = roles.flatten()
        formatted, start, end = assemble(flat, texts.flatten(), per_row)
        on = np.asarray(pc.fill_null(pc.equal(flat, LOSS_ROLE), False))
        row = np.repeat(np.arange(len(per_row)), per_row)[on]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(per_row)))])
        spans = pa.StructArray.from_arrays([pa.array(start[on]), pa.array(end[on])], ["start", "end"])
        loss = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        return pa.record_batch([batch.column(0), formatted.cast(pa.string()), loss], ["conv", "formatted", "loss"])

    out = map_slices(rows, "texts", extended(rows.schema[:1], "formatted string, loss array<struct<start: long, end: long>>"), run)
    return out.withColumnRenamed("conv", conv_col)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from :func:`chat_format`'s output, as counts and SHA-256 digests."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns, raw = parse(text), text.encode()
            masked = [unescaped(raw[s["start"] : s["end"]].decode()) for s in loss]
            rows.append((len(turns), _hex("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, masked)), _hex("".join(masked)), len(text)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(named(conv_col, "conv"), "formatted", "loss")
    out = map_slices(rows, "formatted", extended(rows.schema[:1], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), run)
    return out.withColumnRenamed("conv", conv_col)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
