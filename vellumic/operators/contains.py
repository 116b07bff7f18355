"""Which of a stated set of strings each text contains, in one pass over the text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Strings that one automaton holds; more are looked for in further passes.
BLOCK = 50_000


def containing(texts: DataFrame, text: str, marks: DataFrame, mark: str) -> DataFrame:
    """``texts`` joined with each row of ``marks`` whose ``mark`` the text contains.

    The marks are a stated set (questions, a benchmark), which an automaton searches for all at
    once, so no text is compared with each of them. A null mark or text matches nothing, an
    empty mark every text.
    """
    wanted = marks.where(F.col(mark).isNotNull())
    words = sorted(r[0] for r in wanted.select(mark).distinct().collect())
    out = None
    for k in range(0, len(words), BLOCK):
        block = words[k : k + BLOCK]
        found = texts.select("*", F.explode(_places(block)(F.col(text))).alias("__mark"))
        rows = _named(found, block)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return texts.join(wanted, F.lit(False))
    return out.join(F.broadcast(wanted) if wanted.count() <= BLOCK else wanted, F.col("__mark") == F.col(mark)).drop("__mark")


def _named(found: DataFrame, block: list[str]) -> DataFrame:
    names = found.sparkSession.createDataFrame(list(enumerate(block)), "__k long, __name string")
    return found.join(F.broadcast(names), F.col("__mark") == F.col("__k")).withColumn("__mark", F.col("__name")).drop("__k", "__name")


def _places(block: list[str]):
    made: list = []

    @F.arrow_udf(ArrayType(LongType()))
    def places(column: pa.Array) -> pa.Array:
        if not made:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, word in enumerate(block):
                if word:
                    automaton.add_word(word, k)
            automaton.make_automaton() if len(automaton) else None
            made.append(automaton)
        always = [0] if block[0] == "" else []
        rows = [[] if t is None else sorted({*always, *(k for _, k in (made[0].iter(t) if len(made[0]) else ()))}) for t in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.int64()))

    return places
