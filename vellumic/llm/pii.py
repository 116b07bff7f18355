"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.llm import _spans
from vellumic.llm._arrow import extended, map_slices, named, packed, texts_of, unpacked

# The base patterns. A run of digits cannot match from its middle if it does
# not from its start, so the look-behind of IP changes no match and keeps long runs linear.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account", "dni", "nir", "steuer", "routing")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])")
#: Characters of the shortest match of IBAN, without spaces.
IBAN_MIN = 12
# Forms of Spanish, French and German personal numbers and of American bank numbers.
DNI = re.compile(r"(?<![A-Za-z0-9-])[XYZ0-9]-?[0-9]{7}-?[A-Z](?![A-Za-z0-9-])")
NIR = re.compile(r"(?<![A-Za-z0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?(?:[0-9]{2}|2[AB])\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![A-Za-z0-9])")
STEUER = re.compile(r"(?<![0-9])[1-9][0-9]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![0-9])")
ROUTING = re.compile(r"(?<![0-9-])[0-9]{9}(?![0-9-])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Score of a proposed span that its checksum confirms, and what a context word within ``NEAR``
#: code points adds to it. Words count whole, or with a plural s.
SCORES = {"iban": 0.8, "ssn": 0.4, "account": 0.35, "dni": 0.5, "nir": 0.65, "steuer": 0.35, "routing": 0.35}
_words = lambda joined: re.compile(rf"(?<![^\W\d_])(?:{joined})s?(?![^\W\d_])", re.IGNORECASE)
CONTEXT = {
    "iban": _words("iban|bank|konto|bankkonto|bankverbindung|compte|cuenta|transfer"),
    "ssn": _words("ssn|social|security|tax"),
    "account": _words("card|visa|amex|credit|carte|karte|kreditkarte|tarjeta|payment"),
    "dni": _words("dni|nie|nif|identidad|identificación"),
    "nir": _words("nir|insee|sécu|sécurité|sociale"),
    "steuer": _words("steuer|steuernummer|steuerid|idnr|identifikationsnummer"),
    "routing": _words("routing|aba|bank|account"),
}
#: Words that speak against personal data.
AGAINST = _words("order|invoice|isbn|version|serial|part no")
NEAR, BOOST, REPORT = 48, 0.3, 0.6
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the mod-10 check."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN (without spaces) passes the mod-97 check."""
    rest = 0
    for c in code[4:] + code[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def dni(code: str) -> bool:
    """Whether a Spanish number's letter is that of its digits."""
    code = code.replace("-", "")
    number = code[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
    return DNI_LETTERS[int(number) % 23] == code[-1]


def nir(code: str) -> bool:
    """Whether the last two digits of a French number are its key; departments 2A and 2B count as 19 and 18."""
    code = code.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(code[:13]) % 97 == int(code[13:])


def steuer(code: str) -> bool:
    """Whether the last digit of a German number is its mod 11, 10 check."""
    digits = [int(c) for c in code if c != " "]
    product = 10
    for d in digits[:-1]:
        product = ((d + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == digits[-1]


def routing(code: str) -> bool:
    """Whether a bank's nine digits, weighed 3, 7 and 1, add up to tens."""
    return code != "0" * 9 and sum(int(c) * w for c, w in zip(code, (3, 7, 1) * 3)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: its local part is the run before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)


def _digits(match: re.Match) -> str:
    return "".join(_DIGITS.findall(match[0]))


def base_spans(text: str) -> list[_spans.Span]:
    """The spans of the base patterns, by kind, then start."""
    found: list[_spans.Span] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m)) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m)) <= 15]
    return _spans.by_kind(found, BASE_KINDS)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Proposed IBANs that mod-97 confirms, each at its longest end that passes.

    A match may have taken following words or numbers of up to four characters into it, so its
    shorter ends (whole groups) are tried too; where none passes, the search goes on inside it.
    """
    at = 0
    while m := IBAN.search(text, at):
        start, end = m.span()
        at = start + 1
        while end > start:
            code = text[start:end].replace(" ", "")
            if len(code) < IBAN_MIN:
                break
            if mod97(code):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, raised or lowered by the words that stand whole near the span."""
    near = []
    for lo, hi in ((max(0, start - NEAR), start), (end, min(len(text), end + NEAR))):
        while lo and lo < hi and text[lo - 1].isalpha() and text[lo].isalpha():
            lo += 1
        while hi < len(text) and lo < hi and text[hi].isalpha() and text[hi - 1].isalpha():
            hi -= 1
        near.append(text[lo:hi])
    found = lambda pattern: any(map(pattern.search, near))
    return SCORES[kind] + BOOST * found(CONTEXT[kind]) - BOOST * found(AGAINST)


def proposed_spans(text: str) -> Iterator[_spans.Span]:
    """Spans of the further kinds that a checksum, or for numbers without one their form, confirms."""
    yield from (("iban", *span) for span in ibans(text))
    yield from (("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9")
    yield from (("account", *m.span()) for m in ACCOUNT.finditer(text) if luhn(_digits(m)))
    for kind, pattern, check in (("dni", DNI, dni), ("nir", NIR, nir), ("steuer", STEUER, steuer), ("routing", ROUTING, routing)):
        yield from ((kind, *m.span()) for m in pattern.finditer(text) if check(m[0]))


def scored_spans(text: str, base: list[_spans.Span]) -> list[_spans.Span]:
    """Confirmed spans of the further kinds that reach ``REPORT`` and overlap no base span.

    Of such spans that overlap, the one with the highest score stays, of equals the first, then
    the longest, then the kind listed first.
    """
    if not _DIGITS.search(text):
        return []
    taken = _spans.Cover(base)
    rated = [(-score(text, *s), s[1], -s[2], KINDS.index(s[0]), s) for s in proposed_spans(text) if not taken.touches(s[1], s[2])]
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for rate, *_, span in sorted(rated):
        at = bisect_left(starts, span[2])  # behind all chosen spans that start before this one's end
        if -rate >= REPORT - 1e-9 and (not at or ends[at - 1] <= span[1]):
            starts.insert(at, span[1])
            ends.insert(at, span[2])
            out.append(span)
    return out


def scan(text: str) -> tuple[list[_spans.Span], list[_spans.Span]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    return base, _spans.by_kind([*base, *scored_spans(text, base)], KINDS)


def pii_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns ``id_col``, a count ``n_<kind>`` for each kind, ``base_sha256`` (of the base
    spans) and ``spans`` (all spans). A null text is empty: no spans, the digest of the empty
    string. A null id stays null, repeated rows each give a row, other columns are not read,
    an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in texts_of(batch.column(1)):
            base, every = scan(text)
            counts.append([sum(s[0] == kind for s in every) for kind in KINDS])
            digests.append(_spans.digest(base))
            spans.append(_spans.joined(every))
        columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
        return pa.record_batch([batch.column(0), *columns, pa.array(digests), pa.array(spans)], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = df.select(named(id_col, "id"), named(text_col, "text"))
    schema = extended(rows.schema[:1], ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    return map_slices(rows, "text", schema, run).withColumnRenamed("id", id_col)


def pii_mask(df: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span of its texts replaced by the kind in brackets.

    All other columns stay, but ``length_col``, where there is one, gets the new length in
    code points. A null text stays null.
    """
    rows = packed(df, text_col)
    schema = extended([], "text string, size long", rows.schema[1:])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else _spans.masked(t, scan(t)[1]) for t in batch.column(0).to_pylist()]
        sizes = [None if t is None else len(t) for t in texts]
        return pa.record_batch([pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), *batch.columns[1:]], ["text", "size", *batch.schema.names[1:]])

    out = map_slices(rows, "text", schema, run)
    length = {length_col: F.col("size").cast(df.schema[length_col].dataType)} if length_col in df.columns else {}
    return unpacked(out, df.columns, text_col, **length)
