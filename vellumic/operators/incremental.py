"""Incremental maintenance: what changed, what can be reused, duplicates, manifests, trails, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumic.functions import vectors as V
from vellumic.operators.contains import containing

# Lengths of digests, sessions kept, similarity and weight of trails.
BODY_HASH, META_HASH, SESSION_ID = 16, 12, 6
SESSIONS = 40
TRAIL_SIMILARITY, TRAIL_WEIGHT = 0.55, 0.10


def body_hash(body: Column) -> Column:
    return F.substring(F.sha1(body), 1, BODY_HASH)


def meta_hash(*fields: Column) -> Column:
    """Digest of the fields that a search shows or filters by."""
    return F.substring(F.sha1(F.concat_ws("\0", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))), 1, META_HASH)


def session_id(question: Column) -> Column:
    return F.substring(F.sha1(question), 1, SESSION_ID)


def index_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action) from snapshots (key, body_hash, meta_hash, useful).

    ``embed`` for new, changed or re-admitted chapters, ``delete`` for vanished or no longer
    useful ones, ``refresh`` where only shown fields changed, else ``keep``; chapters that are
    useful in neither give no row. One full outer join.
    """
    a = old.select(key, F.col("body_hash").alias("ob"), F.col("meta_hash").alias("om"), F.col("useful").alias("ou"))
    b = new.select(key, F.col("body_hash").alias("nb"), F.col("meta_hash").alias("nm"), F.col("useful").alias("nu"))
    rows = a.join(b, key, "full_outer")
    was, now = F.coalesce("ou", F.lit(False)), F.coalesce("nu", F.lit(False))
    action = (
        F.when(now & (~was | (F.col("ob") != F.col("nb"))), "embed")
        .when(was & ~now, "delete")
        .when(now & (F.col("om") != F.col("nm")), "refresh")
        .when(now, "keep")
    )
    return rows.select(key, action.alias("action")).where("action IS NOT NULL")


def merged_index(index: DataFrame, actions: DataFrame, embedded: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """The new passages: kept and refreshed ones with current metadata, and newly embedded ones."""
    stay = actions.where("action IN ('keep', 'refresh')").select(key)
    shown = [c for c in metadata.columns if c != key]
    kept = index.drop(*shown).join(stay, key, "left_semi").join(metadata, key)
    return kept.select(*embedded.columns).unionByName(embedded)


def staleness(indexed: DataFrame, current: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row (new, modified, missing) from two snapshots (key, stamp)."""
    rows = indexed.select(key, F.col(stamp).alias("o")).join(current.select(key, F.col(stamp).alias("c")), key, "full_outer")
    return rows.agg(
        F.count(F.when(F.col("o").isNull(), 1)).alias("new"),
        F.count(F.when(F.col("o") != F.col("c"), 1)).alias("modified"),
        F.count(F.when(F.col("c").isNull(), 1)).alias("missing"),
    )


def exact_duplicates(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(sha, keep_id, n_copies) of contents; only digests leave a partition."""
    return docs.groupBy(F.sha2(F.col(content), 256).alias("sha")).agg(F.min(key).alias("keep_id"), F.count("*").alias("n_copies"))


def routed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` with ``route``: take in, duplicate of a known file, or removed for good."""
    known = manifest.select("sha", F.col("status").alias("__s"))
    route = F.when(F.col("__s") == "ok", "duplicate").when(F.col("__s") == "removido", "removed").otherwise("take")
    return files.join(known, "sha", "left").withColumn("route", route).drop("__s")


def archived(files: DataFrame, archive: DataFrame) -> DataFrame:
    """Files of which the archive has a copy of the same size and digest."""
    return files.join(archive.select("size", "sha").distinct(), ["size", "sha"], "left_semi")


def upserted(manifest: DataFrame, changes: DataFrame, key: str = "sha") -> DataFrame:
    """The last writer of each key wins."""
    return manifest.join(changes, key, "left_anti").unionByName(changes)


def recategorized(manifest: DataFrame, folders: list[str], category: str) -> DataFrame:
    return manifest.withColumn("category", F.when(F.col("folder").isin(*folders), category).otherwise(F.col("category")))


def removed(manifest: DataFrame, folders: list[str]) -> DataFrame:
    """A removed document leaves a tombstone, so that it does not come back."""
    return manifest.withColumn("status", F.when(F.col("folder").isin(*folders), "removido").otherwise(F.col("status")))


def trail_strength(trails: DataFrame, similarity: str, *by: str) -> DataFrame:
    """(by, bonus): similar past questions, saturating in their number."""
    near = trails.where(F.col(similarity) >= TRAIL_SIMILARITY)
    return near.groupBy(*by).agg((TRAIL_WEIGHT * F.log1p(F.sum(similarity))).alias("bonus"))


def trail_bonus(passages: DataFrame, trails: DataFrame, query: list[float], chapter: str, vector: str = "embedding") -> DataFrame:
    """``passages`` with ``bonus``: 0 for chapters that no similar question found useful."""
    scored = trails.where("useful").withColumn("similarity", V.dot_with(query)(F.col(vector)))
    strength = trail_strength(scored, "similarity", chapter)
    return passages.join(strength, chapter, "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))


def seeded_trails(questions: DataFrame, folders: DataFrame, existing: DataFrame) -> DataFrame:
    """(question, chapter): each question's targets by their longest chapter, unless already there.

    ``questions`` has (question, mark), ``folders`` (folder, chapter, n_words). Questions are a
    stated set, whose marks one pass over the folders looks for.
    """
    longest = folders.groupBy("folder").agg(F.max_by("chapter", F.struct("n_words", "chapter")).alias("chapter"))
    hits = containing(longest, "folder", questions, "mark").select("question", "chapter").distinct()
    return hits.join(existing, ["question", "chapter"], "left_anti")


def latest_sessions(sessions: DataFrame, when: str, most: int = SESSIONS) -> DataFrame:
    """The most recent sessions, of which a store keeps ``most``."""
    return sessions.orderBy(F.col(when).desc(), "session").limit(most)


def accumulated(before: Column, now: Column) -> Column:
    """Judgements of all rounds, sorted and distinct."""
    return F.array_sort(F.array_union(before, now))
