"""Secret scan: patterns, and strings in sensitive contexts that zstandard cannot predict."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import sysconfig
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vellumic.llm import _spans
from vellumic.llm._arrow import extended, map_slices, named, texts_of

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

#: Words that make a context sensitive, in any case.
SENSITIVE = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"bearer", b"private_key", b"auth", b"signature", b"client_id", b"access_key")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SENSITIVE = re.compile("|".join(w.decode() for w in SENSITIVE), re.ASCII | re.IGNORECASE)
#: Characters of the shortest candidate.
LEAST = 16
#: A run of digits as of base64; "=" only ends it, so that of KEY=value the value is a run of its own.
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}+(?:=++(?![A-Za-z0-9+/_-]))?")
_LETTER, _HEX_ONLY = re.compile("[A-Za-z]"), re.compile("[0-9a-fA-F-]+")
#: Code points between a candidate and a sensitive word, and of the code on each side of a candidate.
REACH, CONTEXT = 64, 256
#: Marginal compressed bytes of a candidate's newest piece, for each that random bytes cost, from which
#: it counts as novel. Four of a hundred names of known words reach the first; of hexadecimal
#: digits, which repeat more by chance and spell few words, less is asked.
NOVELTY, HEX_NOVELTY = 0.95, 0.8
#: Words of the identifier dictionary, and the letters that the shortest has.
DICTIONARY_WORDS, WORD_LETTERS = 6000, 4
#: Bytes measured at once: so few that zstandard stores what it cannot predict byte by byte.
PIECE = 30
#: Stands before every piece and matches the dictionary's end, so that fixed costs cancel out.
_ANCHOR = b"getattribute_setattribute"
_NAME_WORD = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Folders of the standard library whose words are not those of programs.
_NO_CODE = frozenset("site-packages test tests idlelib lib2to3 pydoc_data encodings turtledemo ensurepip __pycache__".split())
_NOISE = bytes(k | 128 for k in hashlib.shake_128(b"noise").digest(PIECE))
_HEX_MARKS = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))


@functools.cache
def identifier_words(most: int = DICTIONARY_WORDS) -> tuple[bytes, ...]:
    """Words of the names and comments in Python's standard library, by the number of files they are in."""
    files: Counter[bytes] = Counter()
    for folder, below, names in os.walk(sysconfig.get_paths()["stdlib"]):
        below[:] = sorted(set(below) - _NO_CODE)
        for name in sorted(names):
            if name.endswith(".py"):
                with open(os.path.join(folder, name), "rb") as f:
                    files.update({w.lower() for w in set(_NAME_WORD.findall(f.read())) if len(w) >= WORD_LETTERS})
    return tuple(sorted(files, key=lambda w: (-files[w], w))[:most])


def _compressor(words: bytes, prepared: bool) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(compression_level=19, strategy=zstandard.STRATEGY_BTULTRA2, window_log=18, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    primer = zstandard.ZstdCompressionDict(words + b"\n" + _ANCHOR + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if prepared:
        primer.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=primer, compression_params=settings)


class Novelty:
    """Marginal compressed size of a candidate, primed by identifiers or by the code around it."""

    def __init__(self, words: Sequence[bytes] = ()):
        # The commonest words lie last, where they are cheapest to point to.
        self.identifiers = _compressor(b"\n".join(reversed(words or identifier_words())), True)

    def __call__(self, candidate: str, around: str = "") -> float:
        """Marginal bytes of the newest piece for each that random bytes cost: about 0.8 for names of known words.

        A piece costs what the better of the two dictionaries makes of it. Case is left out,
        so that a word is known in all of a name's spellings.
        """
        raw, primers = candidate.lower().encode(), [self.identifiers]
        if around:
            primers.append(_compressor(around.lower().encode(), False))
        n = -(-len(raw) // PIECE)
        ends = [k * len(raw) // n for k in range(n + 1)]
        # Random bytes, which no dictionary holds, are what a piece is held against.
        cost = functools.cache(lambda p, size: len(p.compress(_ANCHOR + _NOISE[:size])))
        saved = lambda a, b: max(cost(p, b - a) - len(p.compress(_ANCHOR + raw[a:b])) for p in primers)
        return max(1 - saved(a, b) / (b - a) for a, b in zip(ends, ends[1:]))


_NOVELTY: list[tuple[Sequence[bytes], Novelty]] = []


def _novelty(words: Sequence[bytes]) -> Novelty:
    """The measure of this worker."""
    if not _NOVELTY or (_NOVELTY[0][0] is not words and _NOVELTY[0][0] != words):
        _NOVELTY[:] = [(words, Novelty(words))]
    return _NOVELTY[0][1]


def base_spans(text: str, raw: bytes | None = None) -> list[_spans.Span]:
    """The spans of the base patterns, by start, then kind."""
    raw = text.encode() if raw is None else raw
    found: list[_spans.Span] = []
    lower = raw.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    if b"h" * 32 in raw.translate(_HEX_MARKS):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return _spans.by_start(found, BASE_KINDS)


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A run without the sensitive words in it: what stands before, between and behind them."""
    for word in (*_SENSITIVE.finditer(text, start, end), None):
        a, b = start, word.start() if word else end
        while a < b and text[a] in "_-":
            a += 1
        while a < b and word and text[b - 1] in "_-":
            b -= 1
        if b - a >= LEAST:
            yield a, b
        start = word.end() if word else end


def novel_spans(text: str, base: list[_spans.Span], raw: bytes | None = None, words: Sequence[bytes] = ()) -> list[_spans.Span]:
    """Candidates within ``REACH`` of a sensitive word, on either side, that touch no base span and are novel.

    Candidates are whole runs, however long, less the sensitive words in them; they hold a letter.
    """
    lower = (text.encode() if raw is None else raw).lower()
    if not any(w in lower for w in SENSITIVE):
        return []
    near = [m.span() for m in _SENSITIVE.finditer(text)]
    starts = [a for a, _ in near]
    taken, out = _spans.Cover(base), []
    for run in _RUN.finditer(text):
        first = bisect_left(starts, run.start())  # the words around the run's start; later ones are further off
        if not ((first and near[first - 1][1] + REACH >= run.start()) or (first < len(near) and starts[first] <= run.end() + REACH)):
            continue
        for start, end in _parts(text, *run.span()):
            value = text[start:end]
            if taken.touches(start, end) or not _LETTER.search(value):
                continue
            # A secret that stands there again is no code that predicts it.
            around = (text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]).replace(value, "\n")
            if _novelty(words)(value, around) >= (HEX_NOVELTY if _HEX_ONLY.fullmatch(value) else NOVELTY):
                out.append(("novel", start, end))
    return out


def scan(text: str, words: Sequence[bytes] = ()) -> tuple[list[_spans.Span], list[_spans.Span]]:
    """(base spans, all spans) of one text."""
    raw = text.encode()
    base = base_spans(text, raw)
    return base, _spans.by_start([*base, *novel_spans(text, base, raw, words)], KINDS)


def secret_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: Sequence[bytes] | None = None) -> DataFrame:
    """Secrets of every whole text.

    Returns ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``n_novel``, ``base_sha256``
    (of the base spans) and ``spans`` (all spans). A null text is empty: no spans, the digest
    of the empty string. A null id stays null, repeated rows each give a row, other columns
    are not read, an empty table gives an empty result. ``words`` are those of the identifier
    dictionary, the commonest first; by default :func:`identifier_words` of the driver's Python.
    """
    words = identifier_words() if words is None else tuple(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in texts_of(batch.column(1)):
            base, every = scan(text, words)
            counts.append([sum(s[0] == kind for s in every) for kind in KINDS])
            digests.append(_spans.digest(base))
            spans.append(_spans.joined(every))
        columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
        return pa.record_batch([batch.column(0), *columns, pa.array(digests), pa.array(spans)], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = df.select(named(id_col, "id"), named(text_col, "text"))
    schema = extended(rows.schema[:1], ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    return map_slices(rows, "text", schema, run).withColumnRenamed("id", id_col)
