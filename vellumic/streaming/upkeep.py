"""Index upkeep from a stream of changed chapters, and trails from a stream of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vellumic.operators import passages as P
from vellumic.operators.incremental import body_hash

TRAILS = "question string, chapter string, useful boolean, day string"


def changed_chapters(chapters: DataFrame, order: str) -> DataFrame:
    """(chapter, body_hash, useful, body, order) of a stream of chapter versions."""
    return chapters.select("chapter", body_hash(F.col("body")).alias("body_hash"), "useful", "body", F.col(order).alias("order"))


def index_writer(chapters: DataFrame, index_path: str, checkpoint: str, order: str) -> DataStreamWriter:
    """A query that keeps passages below ``index_path`` up to date, version by version.

    ``order`` is the column, a time or a number, that says which version of a chapter is its
    last; of equal ones that with the greater digest counts.

    Each micro-batch writes the passages of its chapters' last versions to a folder of its own
    number, so a batch that is run again after a failure overwrites only what it wrote.
    Readers take the last version of each chapter: see :func:`current_index`.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("chapter").agg(F.max_by(F.struct("body_hash", "useful", "body"), F.struct("order", "body_hash")).alias("v")).select("chapter", "v.*")
        cut = P.passages(rows.where("useful"), "chapter", "body", "body_hash")
        gone = rows.where("NOT useful").select("chapter", "body_hash", F.lit(None).cast("long").alias("passage_no"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))
        cut.select(*gone.columns).unionByName(gone).write.mode("overwrite").parquet(f"{index_path}/version={number}")

    return changed_chapters(chapters, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_index(spark: SparkSession, index_path: str) -> DataFrame:
    """Passages of each chapter's last version; chapters whose last version is not useful have none."""
    rows = spark.read.parquet(index_path)
    last = rows.groupBy("chapter").agg(F.max("version").alias("version"))
    return rows.join(last, ["chapter", "version"]).where("text IS NOT NULL")


def trails(spark: SparkSession, path: str) -> DataFrame:
    """Judgements as they are appended; lines that are no records are dropped."""
    return spark.readStream.schema(TRAILS).option("mode", "DROPMALFORMED").json(path)
