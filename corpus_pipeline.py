"""From raw documents to a training mix: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; the last adds ``size, source_size, target`` and lists a
document once for every copy the mix takes. An empty table stays empty in every stage, and columns beyond those of ``documents`` are kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, line_dedup, mixing, near_copies as copies, quality_rules
from lodestone.llm.store import Scope, Stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null, empty and very short texts among them; equal ones fare alike."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no line is left; null and empty texts stay as they are. Of repeated rows
    the first keeps its lines."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the first in the input; texts without words are one group."""
    return copies.drop_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, and without items all stay."""
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights, a null source as one of its own; documents without words are taken by their source's rate."""
    size, source_size, target, copies = names = mixing.plan_names(docs)
    return mixing.emit(mixing.mix(docs, out=names), copies)


_RAW = (quality, lines, near_copies, leaks, mix)
_last: dict[int, Scope] = {}


def _alone(k: int):
    """A stage as it is called by itself: tables it stored go when the stage after it starts, by when its result has been written; those
    the given documents are read from stay."""
    stage = _RAW[k]

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _last.pop(k - 1, None)
        if before and not any(t.path in f for t in before.tables for f in docs.inputFiles()):
            before.drop()
        with Scope() as own:
            out = stage(spark, docs, sf_dir)
        _last[k] = own
        return out

    return run


STAGES = [(f.__name__, _alone(k)) for k, f in enumerate(_RAW)]

#: SQL cannot express expectation-maximisation, the joins on sets or connected components; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result stored in the shared folder. A stage's tables go as soon as its result is stored, those that the last
    stage's result is read from go with the session, so results of several runs can be used side by side."""
    docs, before = table(spark, sf_dir, "documents"), None
    for stage in _RAW[:-1]:
        with Scope() as own:
            out = stage(spark, docs, sf_dir)
        held = Stored(out, f"pipeline-{stage.__name__}")
        own.drop()
        if before:
            before.drop()
        docs, before = held.df, held
    return _RAW[-1](spark, docs, sf_dir)
