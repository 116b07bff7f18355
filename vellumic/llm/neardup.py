"""Near duplicates by chosen-path similarity join.

Texts with the same shingle set are one class, with the least id as its representative.
Representatives carry minwise tokens; each of ``TREES`` independent trees sends them down
paths: a hash of the node chooses two or three sets of tokens (four in a set at 85 percent,
three at 80), and for each set a node has a child for each combination of their values.
Nodes of up to ``SMALL`` members are compared exhaustively, first on sketches, then on full
shingle sets.

Larger nodes branch, for up to ``LEVELS`` levels. Before they do, a few members of each, the
node's hubs, are compared with all others, so near copies of them become one component, whose
least id is their label, at once. Members of one label need not be compared any more: a node
of one label ends, and so does one in which few members, the others, do not have its most
frequent label; the others are compared with all members, in blocks that are dealt out over
tasks. In what is still large behind the last level, hubs are compared once more, and then
others with all members, so nothing is capped and only the product of the two numbers counts.

Method: T. Christiani, R. Pagh, J. Sivertsen, "Scalable and Robust Set Similarity Join", 2018.
Recall: a pair at the threshold of 85 percent meets in a small node of a given tree with
probability 0.85, so 8 trees miss it with 3e-7 (3e-6 at 80 percent). A step keeps such a pair
together in a given child with probability 0.52 (0.85 to the fourth), in one of 2.4 children on average with 0.83; after two
steps 8 trees miss it with 6e-4, after three with 2e-3. Sketches hold a pair at the threshold
back with 1.3e-7 (8e-8 at 80 percent). Closer pairs are missed less often.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.llm._arrow import extended, groups, map_slices, named
from vellumic.llm._shingles import Sketcher, shingle_set
from vellumic.operators.components import components
from vellumic.operators.skew import join_counted
from vellumic.scratch import Scratch

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES, SKETCH, SMALL, LEVELS = 8, 128, 192, 4
#: Members of a large node that are compared with all its members first.
HUBS = 4
#: Probability that a step keeps a pair at the threshold together in a given child, about.
STEP_KEEPS = 0.52
#: Share of nodes, in percent, that branch over three sets of tokens and not two.
THREE_SETS = 40
#: Equal tokens of a sketch, less so many standard deviations, from which sets are compared.
SKETCH_SLACK = 5.5
#: Pairs of a block whose shingles are matched at once, and shingles of a matrix product.
COLUMNS = 4096
#: Words of the filter that keeps other documents' texts where they are (16 bytes each).
FILTER_WORDS = 1 << 20


def features(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, set_hash, keys, sketch) from (id, text); the last three null without words."""
    sketcher = Sketcher(TREES, SKETCH)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            found = shingle_set(text, width)
            if len(found):
                keys, sketch = sketcher(found)
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), keys.view(np.int64), sketch.tobytes()))
            else:
                rows.append((0, None, None, None))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["id", "n_shingles", "set_hash", "keys", "sketch"])

    rows = df.select("id", "text")
    return map_slices(rows, "text", extended(rows.schema[:1], "n_shingles long, set_hash binary, keys array<long>, sketch binary"), run)


def _counted(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` of nodes that have two or more, with the node's size ``c``."""
    members = scratch.keep(members)
    sizes = members.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
    # Members of nodes that have no others are not worth a shuffle, so sizes may be missing.
    return join_counted(members, sizes, "node", "c", members.count())


def _counted_labels(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` of nodes that have two labels or more, with the node's size ``c``.

    ``other`` says of a member that it does not have the node's most frequent label, and
    ``others`` is their number. A member without a label is like no other.
    """
    members = scratch.keep(members)
    sizes = members.groupBy("node", "label").agg(F.count("*").alias("n"))
    most = F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label")))
    sizes = sizes.groupBy("node").agg(F.sum("n").alias("c"), most.alias("t"))
    sizes = sizes.select("node", "c", (F.col("c") - F.coalesce("t.n", F.lit(0))).alias("others"), F.col("t.label").alias("top")).where("c > 1 AND others > 0")
    found = join_counted(members, sizes, "node", "c", members.count())
    return found.withColumn("other", F.coalesce(F.col("label") != F.col("top"), F.lit(True))).drop("top")


def tokens_of_step(percent: int) -> int:
    """Tokens in a set, so that a pair at the threshold agrees in all with ``STEP_KEEPS``."""
    return max(1, round(math.log(STEP_KEEPS) / math.log(min(percent, 99) / 100)))


def least_agreement(percent: int) -> int:
    """Equal tokens that two sketches have at least, if their sets may be linked."""
    p = percent / 100
    return int(SKETCH * p - SKETCH_SLACK * (SKETCH * p * (1 - p)) ** 0.5)


class Search:
    """The candidates of a set of representatives, and the links that full sets confirm."""

    def __init__(self, reps: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int):
        self.reps, self.texts, self.scratch, self.width, self.percent = reps, texts, scratch, width, percent
        self.edges: list[DataFrame] = []
        self.stars: list[DataFrame] = []

    def links(self) -> DataFrame:
        """(a, b): links that join all that may be linked."""
        clusters = _together(self.units()).repartition("unit").sortWithinPartitions("unit").mapInArrow(_sketch_clusters(self.percent), "cluster long, id long")
        self._verify(clusters.distinct().withColumn("hub", F.lit(False)))
        return _all(self.edges)

    def units(self) -> list[DataFrame]:
        """Tables of (unit, id, label, sketch): what has to be compared within each unit of bounded size."""
        level = self.reps.select("id", F.posexplode("keys").alias("tree", "key")).select("id", F.xxhash64("tree", "key").alias("node"))
        level = self.scratch.keep(_counted(level, self.scratch).select("id", "node", "c"))
        sketches = self.reps.select("id", "sketch")
        done = [_small(level.withColumn("label", F.lit(None).cast("long"))).join(sketches, "id")]
        large = level.where(F.col("c") > SMALL)
        if large.isEmpty():
            return done
        large = self._labelled(self.scratch.keep(large.join(sketches, "id")))
        for depth in range(2, LEVELS + 1):
            three = F.pmod(F.xxhash64("node", F.lit(f"three{depth}")), F.lit(100)) < THREE_SETS
            sets = F.when(three, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
            child = large.select("id", "sketch", "label", "node", F.explode(sets).alias("s"))
            places = [F.pmod(F.xxhash64("node", "s", F.lit(k), F.lit(depth)), F.lit(SKETCH)).cast("int") for k in range(tokens_of_step(self.percent))]
            values = [F.substring("sketch", 2 * place + 1, F.lit(2)) for place in places]
            child = child.select("id", "sketch", "label", F.xxhash64("node", "s", *values).alias("node"))
            level = self.scratch.keep(_counted_labels(child, self.scratch))
            done.append(_small(level))
            beyond = level.where(F.col("c") > SMALL)
            few, many = beyond.agg(F.count_if(F.col("others") <= SMALL), F.count_if(F.col("others") > SMALL)).first()
            if few:
                done.append(self._against_others(beyond.where(F.col("others") <= SMALL)))
            if not many:
                return done
            large = beyond.where(F.col("others") > SMALL)
        large = self._labelled(large.select("id", "node", "c", "sketch"))
        return [*done, self._against_others(self.scratch.keep(_counted_labels(large.select("id", "sketch", "label", "node"), self.scratch)))]

    def _labelled(self, large: DataFrame) -> DataFrame:
        """(id, node, c, sketch, label): members, and the least id of what links with hubs join them with, or null.

        Hubs come first in ``HUBS`` orders that all nodes share, so a group has few of them.
        """
        firsts = [F.min(F.struct(F.xxhash64("id", F.lit(f"hub{k}")).alias("h"), "id", "sketch")).alias(f"f{k}") for k in range(HUBS)]
        hubs = large.groupBy("node").agg(*firsts, F.first("c").alias("n"))
        hubs = hubs.select("node", "n", F.array(*(F.col(f"f{k}.id") for k in range(HUBS))).alias("hubs"), F.concat(*(F.col(f"f{k}.sketch") for k in range(HUBS))).alias("hub_sketches"))
        members = join_counted(large.select("id", "node", "sketch"), hubs, "node", "n", large.count())
        pairs = members.select("id", "sketch", "hubs", "hub_sketches").mapInArrow(_near_hubs(self.percent), "hub long, id long")
        pairs = self.scratch.keep(pairs.distinct())
        # Members of about SMALL go to one cluster, and the hub to each cluster of its members.
        sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
        parts = join_counted(pairs, sizes, "hub", "n", pairs.count())
        parts = parts.select("hub", "id", F.pmod(F.xxhash64("id", F.lit("part")), F.ceil(F.col("n") / SMALL)).alias("part"))
        parts = parts.select(F.xxhash64("hub", "part").alias("cluster"), "hub", "id")
        self._verify(parts.select("cluster", "id", F.lit(False).alias("hub")).unionByName(parts.select("cluster", F.col("hub").alias("id"), F.lit(True).alias("hub")).distinct()))
        self.stars.append(self.edges[-1])
        labels = self.scratch.keep(components(_all(self.stars), self.scratch))
        return self.scratch.keep(large.join(labels.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left"))

    @staticmethod
    def _against_others(large: DataFrame) -> DataFrame:
        """Units of about ``SMALL`` other members and ``SMALL`` members: all others meet all members."""
        large = large.withColumn("label", F.coalesce("label", "id"))
        blocks = lambda size: F.ceil(F.col(size) / SMALL).cast("int")
        block_of = lambda size, name: F.pmod(F.xxhash64("id", F.lit(name)), blocks(size)).cast("int")
        range_of = lambda size: F.sequence(F.lit(0), blocks(size) - 1)
        place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        as_member = F.transform(range_of("others"), lambda i: place(i, block_of("c", "all")))
        as_other = F.when(F.col("other"), F.transform(range_of("c"), lambda j: place(block_of("others", "other"), j))).otherwise(F.slice(as_member, 1, 0))
        units = large.select("node", "id", "label", "sketch", F.explode(F.array_union(as_member, as_other)).alias("p"))
        return units.select(F.xxhash64("node", "p.i", "p.j").alias("unit"), "id", "label", "sketch")

    def _verify(self, clusters: DataFrame) -> None:
        """Keep the links among the members of each cluster, as full sets have them; a hub is its component's centre."""
        clusters = self.scratch.keep(clusters)
        texts = _maybe_among(self.texts, clusters, self.scratch).join(clusters, "id").select("cluster", "id", "text", "hub")
        edges = texts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_exact_links(self.width, self.percent), "a long, b long")
        self.edges.append(self.scratch.keep(edges))


def _small(level: DataFrame) -> DataFrame:
    return level.where(F.col("c") <= SMALL).withColumnRenamed("node", "unit").withColumn("label", F.coalesce("label", "id")).drop("c")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _together(parts: list[DataFrame]) -> DataFrame:
    return _all([part.select("unit", "id", "label", "sketch") for part in parts])


def _near_hubs(percent: int):
    least = least_agreement(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(hub, id): members that may be linked with a hub of their node."""
        for batch in batches:
            if batch.num_rows:
                ids, hubs = batch["id"].to_numpy(), pc.list_flatten(batch["hubs"]).to_numpy().reshape(batch.num_rows, -1)
                own = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)
                theirs = np.frombuffer(b"".join(batch["hub_sketches"].to_pylist()), np.uint16).reshape(*hubs.shape, SKETCH)
                near = np.stack([(own == theirs[:, k]).sum(axis=1) >= least for k in range(hubs.shape[1])], axis=1) & (hubs != ids[:, None])
                member, k = np.nonzero(near)
                yield pa.record_batch([hubs[member, k], ids[member]], ["hub", "id"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component, from edges within ``range(n)``."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


def _sketch_clusters(percent: int):
    least = least_agreement(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cluster, id): members of a unit joined by sketches that may belong to linked texts of different labels."""
        clusters, members = [], []
        for unit in groups(batches, "unit"):
            ids, first = np.unique(unit["id"].to_numpy(), return_index=True)
            if len(ids) > 1:
                sketches = np.frombuffer(b"".join(unit["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)[first]
                labels = unit["label"].to_numpy()[first]
                a, b = [], []
                for i in range(len(ids) - 1):
                    apart = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
                    near = apart[(sketches[apart] == sketches[i]).sum(axis=1) >= least]
                    a.append(np.full(len(near), i))
                    b.append(near)
                label = _labels(len(ids), np.concatenate(a), np.concatenate(b))
                for root in np.flatnonzero(np.bincount(label) > 1):
                    group = ids[label == root]
                    clusters.append(np.full(len(group), int.from_bytes(hashlib.blake2b(group.tobytes(), digest_size=8).digest(), "little", signed=True)))
                    members.append(group)
            if len(clusters) >= 1000:
                yield pa.record_batch([np.concatenate(clusters), np.concatenate(members)], ["cluster", "id"])
                clusters, members = [], []
        if clusters:
            yield pa.record_batch([np.concatenate(clusters), np.concatenate(members)], ["cluster", "id"])

    return run


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (i < j) with 100 * intersection >= percent * union, exactly."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        hit = 100 * both >= percent * (size.sum() - both)
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), size), count[where] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[where[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for k in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - k] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    hit = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    return np.nonzero(hit)


def _exact_links(width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b): a star for each component of linked texts in a cluster."""

        def lean() -> Iterator[pa.RecordBatch]:  # texts go as soon as their sets are there
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    part = batch.slice(k, 64)
                    sets = [shingle_set(x, width).tobytes() for x in part.column(2).to_pylist()]
                    yield pa.record_batch([part.column(0), part.column(1), pa.array(sets, pa.large_binary()), part.column(3)], ["cluster", "id", "set", "hub"])

        for cluster in groups(lean(), "cluster"):
            ids = cluster["id"].to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in cluster["set"]]
            a, b = linked(sets, percent)
            if len(a):
                label = _labels(len(ids), a, b)
                for hub in np.flatnonzero(cluster["hub"].to_numpy(zero_copy_only=False)):
                    label[label == label[hub]] = hub
                on = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.record_batch([ids[label[on]], ids[on]], ["a", "b"])

    return run


def _maybe_among(df: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``df`` whose id may be among ``ids``: all that are, and few others.

    A one-hash filter of at most ``FILTER_WORDS`` 64-bit words is joined by broadcast, so that
    texts which no candidate needs are not shuffled. Beyond that size it only filters less.
    """
    wanted = ids.agg(F.approx_count_distinct("id")).first()[0]
    n_words = min(FILTER_WORDS, max(1024, wanted // 8))
    bit = F.xxhash64("id", F.lit("filter"))
    word = F.pmod(bit, F.lit(n_words))
    mask = "shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(id, 'filter'), 40), 64) AS int))"
    words = scratch.keep(ids.groupBy(word.alias("word")).agg(F.bit_or(F.expr(mask)).alias("bits")))
    return df.join(F.broadcast(words), word == F.col("word")).where(F.expr(f"bits & {mask} <> 0")).drop("word", "bits")


def near_classes(df: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(features, roots): features of (id, text), and (set_hash, n, root) of the sets of n rows in larger components."""
    found = scratch.keep(features(df, width))
    reps = scratch.keep(
        found.where("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("set_hash").agg(F.min(F.struct("id", "keys", "sketch")).alias("r"), F.count("*").alias("n")).select("set_hash", "n", "r.id", "r.keys", "r.sketch")
    )
    with Scratch(scratch.spark, "neardup-search") as work:
        links = Search(reps, df.select("id", "text"), work, width, percent).links()
        roots = components(links, work)
        roots = reps.select("set_hash", "n", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
        roots = scratch.keep(roots.where("n > 1 OR root IS NOT NULL").select("set_hash", "n", F.coalesce("root", "id").alias("root")))
    scratch.drop(reps)
    return found, roots


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The near-duplicate component of every document.

    Returns ``id_col`` (long), ``n_shingles``, ``component_id`` (least id reachable over
    links, the document's own included) and ``kept`` (it is that least id). Links join texts
    with 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. Texts that are
    null, empty or without words have an empty set and are linked with nothing. A row with a
    null id is linked with nothing: its component is null and it is kept. Repeated rows have
    the same id, so they share a component and are kept or not together. Other columns are
    not read, an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    found, roots = near_classes(df.select(named(id_col, "id"), named(text_col, "text")), scratch, width, percent)
    # Texts without words get a key of their own, so that they do not meet in one task.
    own = F.coalesce("set_hash", F.col("id").cast("string").cast("binary"))
    rows = found.select("id", "n_shingles", own.alias("set_hash"))
    out = join_counted(rows, roots, "set_hash", "n", found.count(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicate_filter(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns of ``df``: that of the least id.

    Rows that repeat a kept id are one document, of which one row stays. Nulls as in
    :func:`near_duplicates`.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    marks = scratch.keep(near_duplicates(df, id_col=id_col, text_col=text_col, width=width, percent=percent))
    gone = scratch.keep(marks.where("NOT kept").select(F.col(id_col).alias("__gone")).distinct())
    out = df.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    again = scratch.keep(marks.where("kept").where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"))
    if again.isEmpty():
        return out
    same = F.col(f"`{id_col}`") == F.col("__again")
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col]))
