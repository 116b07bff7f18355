"""Token counts by a SentencePiece model, from Arrow batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellumic.llm._arrow import extended, map_slices, named, texts_of

#: Bytes of text encoded by one call, and code points from which a text is split.
CALL_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
#: The model writes a space as this mark and puts one before each text.
SPACE_MARK = "▁"

_MODELS: dict[str, object] = {}


def model(path: str):
    """The SentencePiece processor of a model file, loaded once in each worker process."""
    if path not in _MODELS:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (loaded.id_to_piece(i) for i in range(loaded.get_piece_size()))
        joined = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        plain = loaded.encode("a b", out_type=str) == [*loaded.encode("a", out_type=str), *loaded.encode("b", out_type=str)]
        _MODELS[path] = loaded, plain and not joined
    return _MODELS[path]


def safe_parts(text: str, chars: int = SPLIT_CHARS) -> Iterator[str]:
    """Cut a long text at single spaces, each cut at or after ``chars`` code points.

    The space at a cut is left out: the mark that the model puts before each part stands for
    it. No piece of the vocabulary has a mark after another character, so no merge crosses a
    cut, and the parts' counts add up to the count of the whole. A run without such a space
    stays in one part.
    """
    start = 0
    while len(text) - start > chars:
        cut = text.find(" ", start + chars)
        while cut >= 0 and (text[cut - 1] in (" ", SPACE_MARK) or cut + 1 == len(text) or text[cut + 1] in (" ", SPACE_MARK)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def _calls(texts: list[str], split: bool) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of parts of about ``CALL_BYTES`` each, with the row that each part belongs to."""
    parts, rows, held = [], [], 0
    for row, text in enumerate(texts):
        for part in safe_parts(text) if split and len(text) > SPLIT_CHARS else (text,):
            parts.append(part)
            rows.append(row)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= CALL_BYTES:
                yield parts, rows
                parts, rows, held = [], [], 0
    if parts:
        yield parts, rows


def lengths(texts: list[str], path: str) -> list[int]:
    """Token count of each text: no begin, end or other special tokens, no truncation."""
    encoder, split = model(path)
    counts = [0] * len(texts)
    for parts, rows in _calls(texts, split):
        for row, ids in zip(rows, encoder.encode(parts, num_threads=1)):
            counts[row] += len(ids)
    return counts


def token_counts(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Count the tokens of every whole text.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens). A null text counts as empty: 0 bytes, 0 tokens. A null id stays null,
    repeated rows each give a row, other columns are not read, and an empty table gives an
    empty result. ``model_path`` must exist on every executor.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        n_bytes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
        n_tokens = lengths(texts, model_path)
        return pa.record_batch([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(named(id_col, "id"), named(text_col, "text"))
    out = map_slices(rows, "text", extended(rows.schema[:1], "n_bytes long, n_tokens long, over_limit boolean"), count)
    return out.withColumnRenamed("id", id_col)

