"""A library below one folder: files in, graded chapters, indexes, questions and reports out.

Tables hold batches (chapters, passages), which are only ever added, and versions (manifest,
index), which say what of the batches counts. A job that fails leaves a batch that no version
names, and readers never see half a change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumic import models
from vellumic.functions import text as T
from vellumic.operators import catalog, dense, hybrid, incremental, lexical, lexindex, quality, slicing
from vellumic.operators import graph as G
from vellumic.operators import labels as B
from vellumic.operators import passages as P
from vellumic.operators.components import components
from vellumic.operators.ranking import ranked
from vellumic.scratch import Scratch
from vellumic.sources import chapters as CH
from vellumic.sources import files as FS

MANIFEST = "sha string, path string, title string, author string, folder string, category string, lang string, doc_type string, n_words long, n_pages long, status string, error string, batch long"
SESSION = "session string, question string, saved timestamp, query array<double>, relevant array<string>, others array<string>, shown array<string>"
#: Useful and discarded chapters that say a document's language and kind anew, and characters of each.
REVISED_USEFUL, REVISED_DISCARDED, DISCARDED_CHARS = 6, 2, 6_000
INDEX = "chapter_id string, body_hash string, meta_hash string, useful boolean, batch long"


class Library:
    """Operators bound to the tables of one library."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: catalog.Vocabulary | None = None, domains: Mapping[str, Sequence[str]] | None = None, embedder: models.Embedder | None = None, reranker: models.Reranker | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.vocabulary, self.domains = dict(vocabulary or {}), dict(domains or {})
        self._at: str | None = None
        self.embedder, self.reranker = embedder or models.hashing_embedder(), reranker or models.overlap_reranker()

    def _version(self, name: str, schema: str) -> DataFrame:
        found = CH.read_version(self.spark, f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema) if found is None else found

    def _next_batch(self, *tables: DataFrame) -> int:
        return max((t.agg(F.max("batch")).first()[0] or 0) for t in tables) + 1

    # Ingest and curation
    def manifest(self) -> DataFrame:
        return self._version("manifest", MANIFEST)

    def ingest(self, inbox: str, readers: Mapping[str, FS.Reader] = FS.READERS) -> DataFrame:
        """Take in the new files of an inbox; returns their rows of the manifest.

        Known and removed contents are passed over, a file that cannot be read or has too few
        words becomes a failure, and of equal contents one is taken.
        """
        scratch, manifest = Scratch(self.spark, "ingest"), self.manifest()
        files = incremental.routed(FS.inbox(self.spark, inbox), manifest).where("route = 'take'").drop("route")
        files = files.join(files.groupBy("sha").agg(F.min("path").alias("path")), ["sha", "path"], "left_semi")
        pages = FS.pages(files, dict(readers)).join(files.select("path", "sha"), "path")
        pages = scratch.keep(pages.withColumn("n", T.word_count(F.coalesce("md", F.lit("")))))
        docs = pages.groupBy("sha", "path").agg(F.max("title").alias("stated"), F.max("author").alias("author"), F.sum("n").alias("n_words"), F.count("page").alias("n_pages"), F.max("error").alias("error"))
        few = ~quality.accepted(F.col("n_words"), F.col("n_pages")) | (F.col("n_words") == 0)
        docs = docs.withColumn("error", F.coalesce("error", F.when(few, F.concat(F.lit("too few words: "), "n_words"))))
        docs = docs.withColumn("title", T.title_of(F.col("stated"), FS.stem(F.col("path"))))
        docs = docs.join(catalog.sampled(pages, "sha", "page", "md"), "sha", "left").withColumn("name", F.concat_ws(" ", FS.stem(F.col("path")), "title"))
        docs = quality.kind(quality.language(catalog.classified(docs, "name", "sample", self.vocabulary), "sample"), "title", "sample")
        batch = self._next_batch(manifest)
        rows = docs.select(
            "sha", "path", "title", "author", T.slug(F.col("title")).alias("folder"), "category", F.col("lang_detected").alias("lang"), "doc_type", "n_words",
            "n_pages", F.when(F.col("error").isNull(), "ok").otherwise("falha").alias("status"), "error", F.lit(batch).cast("long").alias("batch"),
        )
        rows = scratch.keep(rows)
        good = pages.join(rows.where("status = 'ok'").select("sha"), "sha", "left_semi").where("page IS NOT NULL")
        cut = slicing.chapters(good.select("sha", "page", F.col("md").alias("text")), "sha", "page", "text")
        graded = quality.graded(cut, "title", "md").withColumn("chapter_id", F.concat_ws("/", "sha", F.col("ord").cast("string")))
        graded.write.mode("overwrite").parquet(f"{self.root}/chapters/batch={batch}")
        CH.write_version(self.spark, incremental.upserted(manifest, rows), f"{self.root}/manifest")
        return rows

    def chapters(self, useful_only: bool = True) -> DataFrame:
        """(chapter_id, sha, document, category, lang, title, chapter, ord, pages, n_words, useful, reason, body)."""
        docs = self.manifest().where("status = 'ok'").select("sha", "batch", F.col("title").alias("document"), "folder", "category", "lang", "doc_type")
        rows = self.spark.read.parquet(f"{self.root}/chapters").withColumn("batch", F.col("batch").cast("long")).join(docs, ["sha", "batch"])
        out = rows.select("chapter_id", "sha", "document", "folder", "category", "lang", "doc_type", F.col("title").alias("chapter"), "ord", F.concat_ws("-", "page_from", "page_to").alias("pages"), "n_words", "useful", "reason", F.col("md").alias("body"))
        return out.where("useful") if useful_only else out

    def move(self, folders: Sequence[str], category: str, dry: bool = False, reindex: bool = True) -> DataFrame:
        """The manifest with documents in another category; written, and indexed, unless ``dry``."""
        return self._changed(incremental.recategorized(self.manifest(), list(folders), category), dry, reindex)

    def remove(self, folders: Sequence[str], dry: bool = False, reindex: bool = True) -> DataFrame:
        """The manifest with tombstones, so that removed contents do not come back."""
        return self._changed(incremental.removed(self.manifest(), list(folders)), dry, reindex)

    def _changed(self, manifest: DataFrame, dry: bool, reindex: bool) -> DataFrame:
        if not dry:
            CH.write_version(self.spark, manifest, f"{self.root}/manifest")
            if reindex:
                self.index()
        return manifest

    def revise(self, dry: bool = False, reindex: bool = True) -> DataFrame:
        """Apply the rules anew to the chapters at hand, without the files they came from.

        Language and kind of a document come from its first useful chapters, or if it has few
        of them, from discarded ones too; chapters are graded again. Returns (chapter_id,
        useful, reason) of what changes; written as a new batch unless ``dry``.
        """
        scratch, manifest = Scratch(self.spark, "revise"), self.manifest()
        known = self.spark.read.parquet(f"{self.root}/chapters").withColumn("batch", F.col("batch").cast("long")).join(manifest.where("status = 'ok'").select("sha", "batch"), ["sha", "batch"])
        place = F.row_number().over(W.partitionBy("sha", "useful").orderBy("ord"))
        part = F.when(F.col("useful"), F.substring("md", 1, catalog.FACET_CHAPTER_CHARS)).otherwise(F.substring("md", 1, DISCARDED_CHARS))
        first = known.withColumn("k", place).where(f"k <= CASE WHEN useful THEN {REVISED_USEFUL} ELSE {REVISED_DISCARDED} END").select("sha", "ord", "useful", part.alias("t"))
        text = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), "\n")
        samples = first.groupBy("sha").agg(text(F.when(F.col("useful"), F.struct("ord", "t"))).alias("useful_text"), text(F.struct("ord", "t")).alias("any_text"))
        docs = manifest.join(samples, "sha", "left").withColumn("sample", F.coalesce(F.nullif("useful_text", F.lit("")), "any_text", F.lit("")))
        docs = quality.kind(quality.language(docs.drop("lang", "doc_type"), "sample").withColumn("any_text", F.coalesce("any_text", F.lit(""))), "title", "any_text")
        kept = known.drop("useful", "reason", "n_words", "batch")
        graded = scratch.keep(quality.graded(kept, "title", "md"))
        changed = graded.select("chapter_id", "useful", "reason").join(known.select("chapter_id", F.col("useful").alias("was"), F.col("reason").alias("why")), "chapter_id")
        changed = scratch.keep(changed.where("useful <> was OR NOT (reason <=> why)").select("chapter_id", "useful", "reason"))
        if not dry:
            batch = self._next_batch(manifest)
            graded.write.mode("overwrite").parquet(f"{self.root}/chapters/batch={batch}")
            now = F.when(F.col("status") == "ok", F.lit(batch)).otherwise(F.col("batch")).cast("long")
            CH.write_version(self.spark, docs.withColumnRenamed("lang_detected", "lang").withColumn("batch", now).select(*manifest.columns), f"{self.root}/manifest")
            if reindex:
                self.index()
        return changed

    # Sessions
    def sessions(self) -> DataFrame:
        """The latest sessions; none if there are none or they cannot be read."""
        try:
            return self._version("sessions", SESSION)
        except AnalysisException:
            return self.spark.createDataFrame([], SESSION)

    def save_session(self, question: str, query: Sequence[float], relevant: Sequence[str] = (), others: Sequence[str] = (), shown: Sequence[str] = ()) -> None:
        """A round of a question's session: judgements and shown documents add to those of earlier rounds."""
        now = self.spark.createDataFrame([(question, list(map(float, query)), list(relevant), list(others), list(shown))], "question string, query array<double>, r array<string>, o array<string>, s array<string>")
        now = now.withColumn("session", incremental.session_id(F.col("question"))).withColumn("saved", F.current_timestamp())
        old, none = self.sessions(), F.array().cast("array<string>")
        before = old.select("session", "relevant", "others", "shown")
        merged = lambda a, b: incremental.accumulated(F.coalesce(a, none), b)
        new = now.join(before, "session", "left").select("session", "question", "saved", "query", merged("relevant", F.col("r")).alias("relevant"), merged("others", F.col("o")).alias("others"), merged("shown", F.col("s")).alias("shown"))
        every = incremental.latest_sessions(incremental.upserted(old, new, "session"), "saved")
        CH.write_version(self.spark, every, f"{self.root}/sessions")

    def session(self, question: str):
        """The row of a question's session, or None."""
        return self.sessions().where(F.col("session") == incremental.session_id(F.lit(question))).first()

    # Index
    def index(self) -> DataFrame:
        """Bring passages and vectors up to date; returns (action, n). Unchanged bodies are not embedded again."""
        scratch, old = Scratch(self.spark, "index"), self._version("index", INDEX)
        now = self.chapters(useful_only=False)
        state = now.select("chapter_id", incremental.body_hash(F.col("body")).alias("body_hash"), incremental.meta_hash(F.col("document"), F.col("chapter"), F.col("category"), F.col("lang"), F.col("pages")).alias("meta_hash"), "useful")
        actions = scratch.keep(incremental.index_diff(old, state, "chapter_id"))
        batch = self._next_batch(old)
        changed = now.join(actions.where("action = 'embed'").select("chapter_id"), "chapter_id", "left_semi")
        models.embedded(P.passages(changed, "chapter_id", "body"), "text", self.embedder).write.mode("overwrite").parquet(f"{self.root}/passages/batch={batch}")
        stay = old.select("chapter_id", F.col("batch").alias("was"))
        new = state.join(actions.where("action <> 'delete'"), "chapter_id").join(stay, "chapter_id", "left")
        new = new.select("chapter_id", "body_hash", "meta_hash", "useful", F.when(F.col("action") == "embed", F.lit(batch)).otherwise(F.col("was")).cast("long").alias("batch"))
        CH.write_version(self.spark, new, f"{self.root}/index")
        self._refresh_lexical()
        return actions.groupBy("action").agg(F.count("*").alias("n"))

    def stale(self) -> DataFrame:
        """One row (new, modified, missing): chapters that the index does not have as they are."""
        state = self.chapters().select("chapter_id", incremental.body_hash(F.col("body")).alias("body_hash"))
        return incremental.staleness(self._version("index", INDEX), state, "chapter_id", "body_hash")

    def passages(self) -> DataFrame:
        """Indexed passages with their vectors and their chapters' current metadata."""
        state = self._version("index", INDEX).select("chapter_id", "batch")
        rows = self.spark.read.parquet(f"{self.root}/passages").withColumn("batch", F.col("batch").cast("long")).join(state, ["chapter_id", "batch"])
        meta = self.chapters().select("chapter_id", "sha", "document", "category", "lang", "chapter", "pages")
        return rows.drop("batch").join(meta, "chapter_id").withColumn("passage_id", F.concat_ws("#", "chapter_id", F.col("passage_no").cast("string")))

    # Questions
    def allowed(self, category: str | None = None, domain: str | None = None, everywhere: bool = False) -> list[str] | None:
        """Categories that a question may see; None for all. One of the three must be chosen."""
        existing = [r[0] for r in self.manifest().where("status = 'ok'").select("category").distinct().collect()]
        catalog.required_cut(category, domain, everywhere, existing, list(self.domains))
        if category is not None:
            return [category]
        if domain is not None:
            mapped = {c for cats in self.domains.values() for c in cats}
            return [c for c in existing if c in self.domains[domain] or c not in mapped]
        return None

    def _vector(self, texts: Sequence[str]) -> list[float]:
        rows = self.embedder()(list(texts)).sum(axis=0)
        length = float((rows * rows).sum() ** 0.5)
        return [float(x) for x in (rows / length if length else rows)]

    def _scores(self, query: Sequence[float], allowed: list[str] | None) -> DataFrame:
        rows = self.passages()
        return dense.scored(rows if allowed is None else rows.where(F.col("category").isin(allowed)), query)

    def _refresh_lexical(self) -> None:
        """The lexical index brought up to date with the useful chapters; remembers the state it is at."""
        lexindex.refresh(self.spark, f"{self.root}/lexical", self.chapters(), "chapter_id", "body", "sha", "category")
        self._at = CH.last_version(self.spark, f"{self.root}/manifest")

    def _lexical(self, questions: Sequence[str]) -> DataFrame:
        """BM25 scores from the index, which is brought up to date if the manifest has changed."""
        if self._at is None or self._at != CH.last_version(self.spark, f"{self.root}/manifest"):
            self._refresh_lexical()
        return lexindex.bm25(self.spark, f"{self.root}/lexical", lexical.questions_of(self.spark, questions), "chapter_id", "sha", "category")

    def search(self, questions: Sequence[str], most: int = 10, allowed: list[str] | None = None) -> DataFrame:
        """(rank, chapter_id, sha, category, score) by BM25, fused over languages, filtered after the cut."""
        fused = ranked(self._lexical(questions), "score", ["chapter_id"], by=["qid"], most=lexical.RRF_CUT).groupBy("chapter_id", "sha", "category").agg(F.max(lexical.rrf()).alias("score"))
        top = ranked(fused, "score", ["chapter_id"], most=lexical.RRF_CUT, name="place").drop("place")
        return ranked(top if allowed is None else top.where(F.col("category").isin(allowed)), "score", ["chapter_id"], most=most)

    def semantic(self, question: str, most: int = 10, allowed: list[str] | None = None, rerank: bool = False) -> DataFrame:
        """Best passage of each chapter by vectors, optionally scored anew by the reranker."""
        scores = self._scores(self._vector([question]), allowed)
        if rerank:
            return models.reranked(scores, question, "text", "score", "passage_id", "chapter_id", self.reranker, most=most)
        return dense.best_per_document(scores, ["chapter_id"], "passage_id", most)

    def consult(self, questions: Sequence[str], *, category: str | None = None, domain: str | None = None, everywhere: bool = False, most: int = hybrid.CARDS, query: Sequence[float] | None = None, shown: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
        """A round: (rank, sha, score, from_dense, from_lex, document, chapter, pages, card) and the query vector.

        A category that runs out is topped up from its domain. ``shown`` documents are left out.
        """
        vector = list(query or self._vector(questions))
        excluded = self.spark.createDataFrame([(s,) for s in shown], "sha string")
        lexical_scores = self._lexical(questions)
        cut = self.allowed(category, domain, everywhere)
        rounds = [cut] + ([self.allowed(domain=d) for d, cats in self.domains.items() if category in cats][:1] if category else [])
        out = None
        for cut in rounds:
            scores = self._scores(vector, cut)
            found = self._round(scores, lexical_scores, excluded, most)
            out = found if out is None else out.unionByName(found.join(out, "sha", "left_anti").withColumn("rank", F.col("rank") + 1_000_000))
        out = out.orderBy("rank").limit(most)
        best = dense.best_per_document(self._scores(vector, None), ["sha"], "passage_id").select("sha", "document", "chapter_id", "chapter", "pages", "passage_id", "start", "n", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 25)).alias("card"))
        return out.join(best, "sha").orderBy("rank"), vector

    @staticmethod
    def _round(scores: DataFrame, lexical_scores: DataFrame, excluded: DataFrame, most: int) -> DataFrame:
        first = dense.best_per_document(scores, ["sha"], "passage_id", hybrid.POOL, excluded)
        second = hybrid.lexical_documents(lexical_scores, "chapter_id", "sha", hybrid.POOL, scores.select("sha").distinct(), excluded)
        fused = hybrid.sum_fused(first, second, "sha", most)
        return fused.select("rank", "sha", "score", F.col("from_first").alias("from_dense"), F.col("from_second").alias("from_lex"))

    def moved(self, query: Sequence[float], relevant: Sequence[str], others: Sequence[str] = ()) -> list[float]:
        """The query vector after judgements of passages."""
        judged = self.passages().where(F.col("passage_id").isin([*relevant, *others])).select("embedding", F.col("passage_id").isin(list(relevant)).alias("relevant"))
        return dense.as_list(dense.rocchio(self.spark.createDataFrame([(list(query),)], "embedding array<double>"), judged))

    def more(self, query: Sequence[float], sha: str, most: int = 6) -> DataFrame:
        """Best passage of each chapter of one document."""
        return dense.best_per_document(dense.scored(self.passages().where(F.col("sha") == sha), query), ["chapter_id"], "passage_id", most)

    def opened(self, passage_id: str, words: int = P.WINDOW) -> str:
        """The window around a passage."""
        row = self.passages().where(F.col("passage_id") == passage_id).select("chapter_id", "start", "n")
        text = row.join(self.chapters().select("chapter_id", "body"), "chapter_id").withColumn("w", T.words(F.col("body")))
        return text.select(P.window(F.col("w"), F.col("start").cast("int"), F.col("n").cast("int"), words)).first()[0]

    # Descriptions
    def labels(self) -> DataFrame:
        return B.labelled(self.chapters(), "chapter_id", "sha", "chapter", "body")

    def facets(self) -> DataFrame:
        """(sha, subjects) from each document's useful chapters, cut to the first characters of each."""
        rows = self.chapters().select("sha", "ord", F.substring("body", 1, catalog.FACET_CHAPTER_CHARS).alias("body"))
        docs = catalog.sampled(rows, "sha", "ord", "body", pages_kept=1 << 30).join(self.manifest().select("sha", "title", "category"), "sha")
        scores = catalog.facet_scores(docs, "sha", "title", "sample", self.vocabulary)
        return catalog.facets(scores, catalog.rarity(scores, docs.count()), docs, "sha", "category")

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(edges, concepts, bridges) of all documents, useful chapters or not."""
        edges, top, bridges, _ = self._graph(G.FLOOR)
        return edges, top, bridges

    def graph_report(self) -> DataFrame:
        """(section, place, line): communities, documents alone, strongest edges and bridges."""
        edges, top, bridges, (docs, pairs, cut, scratch) = self._graph(0.0)
        found = G.communities(docs, pairs, "sha", cut, components(pairs.select("a", "b"), scratch))
        cards = self.chapters(useful_only=False).groupBy("sha").agg(F.first("document").alias("title"), F.first("category").alias("category"), F.count("*").alias("n_chapters"))
        return G.report(cards, "sha", edges, bridges, found, top)

    def _graph(self, least: float):
        scratch, rows = Scratch(self.spark, "graph"), self.chapters(useful_only=False)
        docs = rows.select("sha", "category").distinct()
        n = docs.count()
        tf = scratch.keep(G.term_frequencies(rows, "sha", "body").where(F.col("tf") >= G.LEAST_TF))
        weights = scratch.keep(G.tfidf(tf, "sha", n))
        pairs = scratch.keep(G.cosines(weights, "sha", least))
        top, cut = G.concepts(weights, "sha"), G.edge_cut(pairs.where(F.col("cosine") >= G.FLOOR), n)
        return G.edges(pairs, cut), top, G.bridges(top, docs, "sha", "category"), (docs.select("sha"), pairs, cut, scratch)

    def predicted(self, question: str) -> DataFrame:
        """(category, score, rank): categories whose passages are nearest, by votes."""
        top = ranked(self._scores(self._vector([question]), None), "score", ["passage_id"], most=dense.VOTE_TOP)
        return dense.vote(top, "category")
