"""Chapter files with front matter, chapter tables, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumic.functions import text as T

META = ("titulo", "capitulo", "categoria", "idioma", "paginas")
#: Fields that grading writes anew.
GRADED = ("util", "motivo_descarte", "idioma", "tipo")


def _head(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)


def front_matter(text: Column) -> Column:
    """Map of the ``key: "value"`` lines before a text; empty without them. Later keys win."""
    pairs = F.transform(F.filter(F.split(_head(text), "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(T.trimmed(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(T.trimmed(F.regexp_replace(x, "^[^:]*:", "")), '^"|"$', "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---.*?\n---", "")


def rendered(fields: dict[str, Column]) -> Column:
    """Front matter; double quotes in values become single ones."""
    lines = [F.concat(F.lit(f'{k}: "'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"')) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, category, folder, file, meta fields, useful, body) of chapter files below a folder.

    Missing fields come from the path: the folder's name for the title, the file's for the
    chapter, the folder above for the category. Index files are left out.
    """
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    rows = rows.select("path", F.element_at(parts, -3).alias("__c"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), front_matter(F.col("value")).alias("m"), body(F.col("value")).alias("body"))
    rows = rows.where("file <> 'INDEX.md'")
    default = {"titulo": F.col("folder"), "capitulo": F.regexp_replace("file", r"\.md$", ""), "categoria": F.col("__c"), "idioma": F.lit("xx"), "paginas": F.lit("")}
    return rows.select("path", "folder", "file", *(F.coalesce(F.col("m")[k], d).alias(k) for k, d in default.items()), (F.coalesce(F.col("m")["util"], F.lit("sim")) != "nao").alias("useful"), "body", F.col("m").alias("meta"))


def document_key(path: Column) -> Column:
    """Category and folder of a chapter's relative path."""
    return F.concat_ws("/", F.slice(F.split(path, r"[\\/]"), 2, 2))


def patched(meta: Column, changes: Column, drop: tuple[str, ...] = ()) -> Column:
    """Front matter with ``changes`` in place of what it had; only named fields are dropped."""
    kept = F.map_filter(meta, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(changes), k), F.lit(False)) & ~k.isin(*drop, ""))
    return F.map_concat(kept, changes)


def write_chapters(chapters: DataFrame, path: str, category: str = "category") -> None:
    """Chapter table in folders by category; only the categories at hand are replaced."""
    chapters.write.partitionBy(category).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_version(spark: SparkSession, table: DataFrame, path: str) -> None:
    """A new version of a table beside the old ones; a reader sees whole versions only.

    A table has one writer at a time. Of two that take the same next number, one finds its
    folder there and fails without having changed anything.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    taken = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if "version=" in s.getPath().getName()] if fs.exists(root) else []
    table.write.mode("errorifexists").parquet(f"{path}/version={max(taken, default=-1) + 1}")


def last_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the last version that was committed as a whole; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    good = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(good, key=lambda p: int(p.getName().split("=")[1])).toString() if good else None


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of a table; None if there is none."""
    last = last_version(spark, path)
    return None if last is None else spark.read.parquet(last)


def document_report(chapters: DataFrame) -> DataFrame:
    """(category, folder, row): lines of each document's table of chapters, in order."""
    line = F.concat_ws(" | ", F.lit("|"), F.col("ord").cast("string"), "title", T.thousands(F.col("n_words")), F.when(F.col("useful"), "").otherwise(F.col("reason")), F.lit("|"))
    return chapters.orderBy("category", "folder", "ord").select("category", "folder", line.alias("row"))


def library_report(docs: DataFrame) -> DataFrame:
    """(category, docs, words) by number of documents, as the catalogue lists categories."""
    rows = docs.where("status = 'ok'").groupBy("category").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    return rows.orderBy(F.col("docs").desc(), "category").select("category", "docs", T.thousands(F.col("words")).alias("words"))


def status(docs: DataFrame) -> DataFrame:
    """One row: documents, words and failures of a manifest."""
    ok = F.col("status") == "ok"
    return docs.agg(F.count(F.when(ok, 1)).alias("docs"), F.coalesce(F.sum(F.when(ok, F.col("n_words"))), F.lit(0)).alias("words"), F.count(F.when(F.col("status") == "falha", 1)).alias("failures"))


def append_trail(trails: DataFrame, path: str) -> None:
    """Judgements are only ever appended."""
    trails.select("question", F.replace("chapter", F.lit("\\"), F.lit("/")).alias("chapter"), "useful", F.date_format(F.current_date(), "yyyy-MM-dd").alias("day")).write.mode("append").json(path)


def read_trails(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, chapter string, useful boolean, day string").option("mode", "DROPMALFORMED").json(path)
