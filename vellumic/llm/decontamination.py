"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some words of a span and ignore the others; training and test spans whose
picked words agree are joined on a hash. Each hit fixes an alignment of an item with a
document, and the alignment counts if some run of ``RUN`` aligned words agrees in at least
``AGREE`` percent of its words, so single substituted words hide nothing, or some run of
``EXACT`` words in all, so shorter parts of an item are found too. Items of few words have seeds that find
every alignment that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.llm._arrow import extended, map_slices, named, packed, unpacked
from vellumic.llm._shingles import mixed, word_hashes, words

#: Masks of weight 6 and span 8 to 11: of runs of 20 words with 4 random substitutions they
#: hit more than 99.9 %, of runs of 15 words with 3 substitutions 98 %.
MASKS = ("11010111", "11100111", "1011101100", "1110110001", "110011011", "1111011")
RUN, AGREE, EXACT = 20, 80, 13
#: Items of fewer words than LEAST match nothing unless a call asks for less: one to four common words
#: stand in clean documents too. Items below WHOLE words get seeds of their own
#: (:func:`short_picks`), which miss nothing.
LEAST, WHOLE = 5, 12
#: Words of benchmark items that one pass broadcasts (about 6 seeds of 24 bytes a word).
BLOCK_WORDS = 400_000
_FILTER_BITS = 22
_X = np.uint64(0x9E3779B97F4A7C15)


class Seeds:
    """The hashed spans of some benchmark items, ready to be joined with documents."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = LEAST):
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        found: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for item_id, text in sorted(set(items), key=lambda x: (x[0] is not None, x)):
            hashes = word_hashes(words(text))
            if len(hashes) < max(least, 1):
                continue
            for mask, at in [(mask, None) for mask in MASKS] if len(hashes) >= WHOLE else short_picks(len(hashes)):
                keys = masked_hashes(hashes, mask)
                places = np.arange(len(keys)) if at is None else np.array([at])
                found.setdefault(mask, []).append((keys[places], places, len(self.ids)))
            self.ids.append(item_id)
            self.words.append(hashes)
        self.masks = []
        for mask, parts in found.items():
            keys = np.concatenate([h for h, _, _ in parts])
            item = np.concatenate([np.full(len(h), k, np.int64) for h, _, k in parts])
            at = np.concatenate([places for _, places, _ in parts])
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.masks.append((mask, keys[order], item[order], at[order], np.packbits(sieve)))

    def unpacked(self) -> list[tuple]:
        return [(mask, keys, item, at, np.unpackbits(sieve).view(bool)) for mask, keys, item, at, sieve in self.masks]


def short_picks(n: int) -> list[tuple[str, int]]:
    """(mask, place in the item) of seeds of which one at least agrees whenever ``n`` words count.

    With ``spare`` words that may differ, one of ``spare + 1`` pieces agrees in all. Where the
    pieces would be shorter than three words, all picks that leave ``spare`` words out do it.
    """
    spare = n - -(-AGREE * n // 100)
    if n // (spare + 1) >= 3:
        ends = [k * n // (spare + 1) for k in range(spare + 2)]
        return [("1" * (b - a), a) for a, b in zip(ends, ends[1:])]
    picks = ["".join("0" if k in out else "1" for k in range(n)) for out in combinations(range(n), spare)]
    return [(pick.strip("0"), pick.index("1")) for pick in picks]


def masked_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the picked words of each span of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, pick in enumerate(mask):
        if pick == "1":
            out = (out ^ (out >> np.uint64(29))) * _X + hashes[k : k + n]
    return mixed(out)


def agreement(item: np.ndarray, doc: np.ndarray, offset: int) -> tuple[int, bool]:
    """Words that agree when the item starts at ``offset``, and whether a run of them counts."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    same = np.zeros(len(item), bool)  # words beyond the document's ends do not agree
    if lo < hi:
        same[lo:hi] = item[lo:hi] == doc[offset + lo : offset + hi]
    sums = np.concatenate([[0], np.cumsum(same)])
    most = lambda run: (sums[run:] - sums[:-run]).max()
    run, exact = min(RUN, len(item)), min(EXACT, len(item))
    return int(sums[-1]), bool(100 * most(run) >= AGREE * run or most(exact) == exact)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct values of ``x - y`` for x in ``p`` and y in ``q``, in much less than their product where there are many."""
    low = int(p.min()) - int(q.max())
    size = int(p.max()) - int(q.min()) - low + 1
    if len(p) * len(q) <= 16 * size:
        return np.unique(np.subtract.outer(p, q))
    width = 1 << (size - 1).bit_length()  # the product of the two indicator series, by Fourier transform
    x, y = np.zeros(width), np.zeros(width)
    x[p - p.min()], y[q.max() - q] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), width)[:size] > 0.5) + low


def overlaps(texts: list[str | None], seeds: Seeds, tables: list[tuple]) -> list[dict[int, tuple[int, int]]]:
    """Of each text: item number to (words that agree, first word) of its best alignment that counts.

    All texts are hashed as one sequence; spans that run over a text's end are left out.
    """
    docs = [words(text) for text in texts]
    ends = np.cumsum([len(d) for d in docs])
    sequence = word_hashes([w for d in docs for w in d])
    tried: dict[tuple[int, int], list[np.ndarray]] = {}
    for mask, keys, item, at, sieve in tables:
        hashes = masked_hashes(sequence, mask)
        spots = np.flatnonzero(sieve[hashes >> np.uint64(64 - _FILTER_BITS)])
        doc = np.searchsorted(ends, spots, "right")
        inside = spots + len(mask) <= ends[np.minimum(doc, len(ends) - 1)]
        spots, doc = spots[inside], doc[inside]
        lo, hi = np.searchsorted(keys, hashes[spots], "left"), np.searchsorted(keys, hashes[spots], "right")
        hit = hi > lo
        spots, doc, lo, hi = spots[hit], doc[hit], lo[hit], hi[hit]
        # All places of a seed in a document against all its places in an item, at once.
        order = np.lexsort((lo, doc))
        cuts = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(lo[order]) != 0)) + 1
        for group in np.split(order, cuts) if len(order) else ():
            d, a, b = doc[group[0]], lo[group[0]], hi[group[0]]
            first = spots[group] - (ends[d] - len(docs[d]))
            for k in np.unique(item[a:b]):
                tried.setdefault((int(d), int(k)), []).append(differences(first, at[a:b][item[a:b] == k]))
    best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for (d, k), offsets in sorted(tried.items()):
        for offset in np.unique(np.concatenate(offsets)).tolist():
            agree, counts = agreement(seeds.words[k], sequence[ends[d] - len(docs[d]) : ends[d]], offset)
            if counts and (k not in best[d] or agree > best[d][k][0]):
                best[d][k] = agree, offset
    return best


_TABLES: list[tuple[Seeds, list[tuple]]] = []


def _tables(seeds: Seeds) -> list[tuple]:
    """The unpacked tables of the block that this worker is at."""
    if not _TABLES or _TABLES[0][0] is not seeds:
        _TABLES[:] = [(seeds, seeds.unpacked())]
    return _TABLES[0][1]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int = LEAST, most: int = BLOCK_WORDS) -> Iterator[Broadcast]:
    """Broadcast seeds of the items, in as many blocks as keep each within ``most`` words or so."""
    rows = benchmark.select(named(id_col, "id"), named(text_col, "text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * most)))  # a word and its space are two characters at least
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        seeds = Seeds([tuple(r) for r in part.collect()], least)
        if seeds.ids:
            yield benchmark.sparkSession.sparkContext.broadcast(seeds)


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every benchmark item that a document contains, whole texts against all items.

    Returns ``id_col``, ``item_col``, ``item_words``, ``n_agree`` (words that agree in the
    best alignment) and ``first_word`` (where the item starts in the document, counted in
    words; negative if its start is cut off). Null and empty texts match nothing, nor do items of
    fewer than ``least`` words (those of up to four are found word for word); null ids stay null; repeated rows and items each give their
    rows, but an item repeated with its id gives one; other columns are not read.
    """
    rows = df.select(named(id_col, "id"), named(text_col, "text"))
    item_type = benchmark.schema[item_col].dataType
    schema = extended([rows.schema["id"]], f"item {item_type.simpleString()}, item_words long, n_agree long, first_word long")
    out = None
    for shared in blocks(benchmark, item_col, item_text_col, least):

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            seeds, tables, found, row = shared.value, _tables(shared.value), [], []
            for k, best in enumerate(overlaps(batch.column(1).to_pylist(), seeds, tables)):
                for item, (agree, offset) in best.items():
                    found.append((seeds.ids[item], len(seeds.words[item]), agree, offset))
                    row.append(k)
            columns = list(zip(*found)) or [()] * 4
            return pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["id", "item", "item_words", "n_agree", "first_word"])

        part = map_slices(rows, "text", schema, run)
        out = part if out is None else out.unionByName(part)
    out = df.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` that contain no benchmark item, with all their columns, without a shuffle.

    Rows with a null or empty text stay. Items as in :func:`contaminated`.
    """
    rows = packed(df, text_col)
    for shared in blocks(benchmark, item_col, item_text_col, least):

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            seeds, tables = shared.value, _tables(shared.value)
            return batch.filter(pa.array([not best for best in overlaps(batch.column(0).to_pylist(), seeds, tables)], pa.bool_()))

        rows = map_slices(rows, "text", rows.schema, run)
    return unpacked(rows, df.columns, text_col)
