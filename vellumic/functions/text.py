"""Text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that a token list leaves out.
STOPWORDS = tuple(
    """a o os as um uma uns umas de do da dos das em no na nos nas por para com sem
    que se e ou mas como quando onde qual quais ao aos aa as ser sao foi era isso
    este esta esse essa aquele aquela seu sua seus suas mais menos muito ja nao sim
    the a an of to in for on with as at by from is are was were be been it this that
    these those and or but if then than so such not no yes you your we our they their
    can will would should could may might have has had do does did""".split()
)
TOKEN = r"[a-z0-9][a-z0-9_]+"
#: Blocks whose characters have a plain form: Latin, letter-like, numbers, full-width.
_BLOCKS = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2190), (0x2460, 0x2500), (0xFF01, 0xFF5F))


def _plain_forms() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-character forms, longer forms), by decomposition."""
    one, form, longer = [], [], {}
    for c in [chr(k) for a, b in _BLOCKS for k in range(a, b)] + [chr(k) for k in range(0xFB00, 0xFB07)]:
        plain = unicodedata.normalize("NFKD", c.lower()).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(c)
            form.append(plain)
        elif plain:
            longer[c] = plain
    return "".join(one), "".join(form), longer


_ONE, _FORM, _LONGER = _plain_forms()
_LIGATURES = {c: _LONGER[c] for c in map(chr, range(0xFB00, 0xFB07))} | {"…": "...", "™": "TM", "№": "No", "½": "12", "¼": "14", "¾": "34"}


def fold(text: Column) -> Column:
    """Lower case, then without accents and anything outside ASCII.

    Covers the characters of ``_BLOCKS`` and the usual ligatures; :func:`fold_exact` covers
    all of Unicode at the price of a trip to Python.
    """
    low = F.lower(text)
    out = low
    for c, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    out = F.regexp_replace(F.translate(out, _ONE, _FORM), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(out)  # ASCII needs no more


@F.arrow_udf(StringType())
def fold_exact(texts: pa.Array) -> pa.Array:
    """Lower case, compatibility decomposition, ASCII only, for any character."""
    return pa.array([None if t is None else unicodedata.normalize("NFKD", t.lower()).encode("ascii", "ignore").decode() for t in texts.to_pylist()], pa.string())


def tokens(text: Column) -> Column:
    """Folded tokens of two or more characters without stopwords, repeats kept."""
    found = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def slug(text: Column, limit: int = 60, empty: str = "sem-titulo") -> Column:
    """Folded, with ``-`` for anything else, at most ``limit`` characters."""
    dashed = F.btrim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(empty)


# Typographic characters and what they become.
TYPOGRAPHY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "‘": "'", "“": '"', "”": '"', "­": ""}


def normalized(text: Column) -> Column:
    """Ligatures and quotes made plain, words split over lines joined, spaces collapsed."""
    out = text
    for c, plain in TYPOGRAPHY.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    out = F.regexp_replace(out, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return trimmed(F.regexp_replace(out, "[ \t ]+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def digit_signature(line: Column) -> Column:
    """Key of repeated headers and footers: digits become ``#``."""
    return trimmed(F.regexp_replace(F.lower(line), r"\d+", "#"))


def clean_heading(text: Column) -> Column:
    """A heading on one line, without a page number before it."""
    flat = trimmed(F.regexp_replace(text, r"(?U)\s+", " "))
    return trimmed(F.regexp_replace(flat, r"^\d{1,4}[\s.:\-–]*", ""))


# Endings of book files, sites in brackets at a title's end, and what is trimmed off.
BOOK_ENDING = r"(?i)\.(?:epub|mobi|azw3?|pdf)\s*$"
SITE_AT_END = r"(?i)[(\[][^()\[\]]*\.(?:com|net|org|info|ru)[^()\[\]]*[)\]]\s*$"
TITLE_EDGES = " -–—_"


def clean_epub_title(raw: Column) -> Column:
    """A book's title without a file ending or a trailing site in brackets."""
    out = F.regexp_replace(trimmed(F.regexp_replace(raw, r"\\([()])", "$1")), BOOK_ENDING, "")
    out = trimmed(F.regexp_replace(trimmed(F.regexp_replace(out, SITE_AT_END, "")), BOOK_ENDING, ""))
    return F.btrim(F.regexp_replace(out, r"\s{2,}", " "), F.lit(TITLE_EDGES))


# Words that file names carry and titles do not, digits before a name, and what no title is.
FILE_DIGITS, NO_TITLE_ENDING, NO_TITLE = r"^\d{6,}[-_]", r"\.(?:pdf|indd|doc)$", "microsoft word"
FILE_JUNK = r"(?i)\b(true[- ]?pdf|pdf|ebook|e[- ]book|download|z[- ]?library|libgen|sk[- ]1lib|compressed|compactado|pdfcoffee|com|later|final|scan(ned)?|part\d?|v\d+)\b"


def title_of(stated: Column, stem: Column) -> Column:
    """The stated title if it can be one, else a cleaned file name."""
    stated = trimmed(F.coalesce(stated, F.lit("")))
    usable = (F.length(stated) >= 4) & ~F.lower(stated).rlike(NO_TITLE_ENDING) & ~F.contains(F.lower(stated), F.lit(NO_TITLE))
    name = F.translate(F.regexp_replace(stem, FILE_DIGITS, ""), "_-", "  ")
    name = F.btrim(F.regexp_replace(F.regexp_replace(name, FILE_JUNK, " "), r"\s+", " "), F.lit(" -"))
    return F.when(usable, stated).when(F.length(name) > 0, name).otherwise(stem)


def occurrences(text: Column, term: str) -> Column:
    """Times ``term`` occurs; a single word of up to four characters only between non-letters."""
    if len(term) <= 4 and " " not in term:
        quoted = "".join(c if c.isalnum() else "\\" + c for c in term)
        return F.regexp_count(text, F.lit(f"(?<![a-z0-9]){quoted}(?![a-z0-9])"))
    return plain_occurrences(text, term)


def plain_occurrences(text: Column, term: str) -> Column:
    """Times ``term`` occurs anywhere, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def capital_fixed(title: Column) -> Column:
    """A title mostly in capitals gets one capital at its start."""
    letters, upper = F.regexp_count(title, F.lit(r"\p{L}")), F.regexp_count(title, F.lit(r"\p{Lu}"))
    return F.when((letters > 0) & (upper > 0.7 * letters), F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substring(title, 2, 1 << 30)))).otherwise(title)


def thousands(number: Column) -> Column:
    """1234567 as ``1.234.567``."""
    return F.translate(F.format_number(number, 0), ",", ".")


def snippet(text: Column, terms: list[str], width: int = 240) -> Column:
    """``width`` characters around the first of ``terms`` that occurs, on one line between dots.

    The place is found in the folded text and cut from the text itself. Empty if none occurs.
    """
    plain = fold(text)
    at = F.coalesce(*(F.nullif(F.instr(plain, t), F.lit(0)) for t in terms))
    start = F.greatest(F.lit(1), at - width // 2)
    line = trimmed(F.regexp_replace(F.substring(text, start, F.lit(width)), r"(?U)\s+", " "))
    return F.when(at.isNotNull(), F.concat(F.lit("..."), line, F.lit("..."))).otherwise("")


def local_name(tag: Column) -> Column:
    """An XML tag without its name space."""
    return F.substring_index(tag, "}", -1)
