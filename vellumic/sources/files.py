"""Files of an inbox to pages: text, DOCX and EPUB here, PDF and images by plug-ins."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urldefrag
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.sources.html import markdown_text

SUFFIXES = ("pdf", "docx", "epub", "txt", "md", "markdown")
PAGES = "path string, page long, md string, title string, author string, error string"
#: Function of a file's bytes: (title, author, page texts).
Reader = Callable[[bytes], tuple[str, str, list[str]]]


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix, length, content, sha) of the files of known kinds, with folders below."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.substring_index("path", ".", -1))
    return rows.withColumn("suffix", suffix).where(F.col("suffix").isin(*SUFFIXES)).select("path", "suffix", "length", "content", F.sha2("content", 256).alias("sha"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def read_text(content: bytes) -> tuple[str, str, list[str]]:
    """UTF-8 with replacements, one page."""
    return "", "", [content.decode("utf-8", "replace")]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def read_docx(content: bytes) -> tuple[str, str, list[str]]:
    """Paragraphs of a word processor's file, heading k as k + 1 marks (2 to 6), one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = z.namelist()
        styles = _heading_styles(z.read("word/styles.xml")) if "word/styles.xml" in names else {}
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else None
    lines = []
    for p in (x for x in body.iter() if _local(x.tag) == "p"):
        text = "".join("\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else x.text or "" for x in p.iter() if _local(x.tag) in ("t", "tab", "br")).strip()
        if not text:
            continue
        style = next((v for x in p.iter() if _local(x.tag) == "pstyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        level = styles.get(style) or _heading_level(style)
        lines.append("#" * min(6, max(2, level + 1)) + " " + text if level else text)
    found = {_local(x.tag): (x.text or "").strip() for x in core.iter()} if core is not None else {}
    return found.get("title", ""), found.get("creator", ""), ["\n\n".join(lines)]


def _heading_level(style: str) -> int:
    name = style.lower().replace(" ", "")
    return int(name[7:]) if name.startswith("heading") and name[7:].isdigit() else 0


def _heading_styles(xml: bytes) -> dict[str, int]:
    out = {}
    for s in (x for x in ElementTree.fromstring(xml).iter() if _local(x.tag) == "style"):
        key = next((v for k, v in s.attrib.items() if _local(k) == "styleid"), "")
        name = next((v for x in s if _local(x.tag) == "name" for k, v in x.attrib.items() if _local(k) == "val"), "")
        if level := _heading_level(name):
            out[key] = level
    return out


def read_epub(content: bytes) -> tuple[str, str, list[str]]:
    """One page for each document of the reading order that has words; an error if none has.

    Of several titles or authors the first that is not empty counts. A reference to a part of a
    document, or one with escaped characters, stands for the whole document.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        opf = _package(z, names)
        nodes = [(_local(x.tag), x) for x in ElementTree.fromstring(z.read(opf)).iter()]
        stated = lambda name: next((x.text.strip() for tag, x in nodes if tag == name and (x.text or "").strip()), "")
        places = {x.get("id"): unquote(urldefrag(x.get("href")).url) for tag, x in nodes if tag == "item" and x.get("href")}
        paths = (posixpath.normpath(posixpath.join(posixpath.dirname(opf), places[ref])) for ref in (x.get("idref") for tag, x in nodes if tag == "itemref") if ref in places)
        texts = [markdown_text(z.read(path).decode("utf-8", "replace")) for path in paths if path in names]
    texts = [t for t in texts if t.strip("# \n")]
    if not texts:
        raise ValueError("no text in the reading order")
    return stated("title"), stated("creator"), texts


def _package(z: zipfile.ZipFile, names: set[str]) -> str:
    """Path of the package file: as the container says, else any that is there."""
    try:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        stated = [x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile"]
    except (KeyError, ElementTree.ParseError):
        stated = []
    for name in [*stated, *(n for n in z.namelist() if n.lower().endswith(".opf"))]:
        if name in names:
            return name
    raise ValueError("no package file")


READERS: dict[str, Reader] = {"txt": read_text, "md": read_text, "markdown": read_text, "docx": read_docx, "epub": read_epub}


def pages(files: DataFrame, readers: dict[str, Reader] = READERS) -> DataFrame:
    """(path, page, md, title, author, error) of :func:`inbox` rows, read by suffix.

    A file that cannot be read gives one row with its error and no page, so one bad file costs
    nothing but itself. Further kinds (PDF, scans) come in as readers.
    """
    readers = dict(readers)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"]):
                try:
                    if suffix not in readers:
                        raise ValueError(f"no reader for .{suffix}")
                    title, author, texts = readers[suffix](bytes(content))
                    rows = [(path, k, t, title, author, None) for k, t in enumerate(texts, 1)]
                except Exception as e:  # any malformed file
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["path", "page", "md", "title", "author", "error"]).astype({"page": "Int64"})

    out = files.select("path", "suffix", "content").mapInPandas(read, PAGES)
    # Repacked books carry their file's name as title.
    title = F.when(F.lower("path").endswith(".epub"), T.clean_epub_title(F.col("title"))).otherwise(F.col("title"))
    return out.withColumn("title", title)
