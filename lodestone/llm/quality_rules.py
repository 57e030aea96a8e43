"""Quality rules under weak supervision.

Each rule votes good, bad or abstains. The corpus is reduced to a contingency table of vote patterns (at most 3 to the
number of rules, whatever the corpus size), expectation-maximisation on that table estimates how often each rule votes how on
good and on bad documents, and the posterior probability of "good" replaces all-must-pass filtering: a rule that the others
bear out counts much, one that they do not counts little, a lone flag may be outvoted, and abstentions that only bad documents
bring about tell against one without a flag. Everything that touches documents is a
DataFrame expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import BLANKS, GAP, Stored, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 8

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Rules that a document of the worse class fails on average, at least. A corpus whose two classes differ by less has no class of bad documents.
FAULTS = 2

#: name, condition for "bad", condition for "good"; else the rule abstains. Columns are those of :func:`features`. Bounds lie near the bulk of
#: ordinary texts, so rules err now and then and overlap: what a vote is worth is for the model to find. The base checks (very few words,
#: mostly repeats) are no rules.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "n_symbols > n_words", "n_symbols * 50 <= n_words"),
    ("symbol_chars", "n_symbols * 10 > word_chars", "n_symbols * 400 <= word_chars"),
    ("some_repeats", "n_repeat_words * 20 > n_words", "n_repeat_words < 1"),
    ("dup_lines", "n_dup_lines * 2 > n_lines", "n_dup_lines * 5 <= n_lines"),
    ("capitals", "n_upper * 5 > n_letters", "n_upper * 20 <= n_letters"),
    ("exclaims", "n_exclaims * 10 > n_words", "n_exclaims * 50 <= n_words"),
    # Different words grow with the square root of a text's words or faster, so the bound does too.
    ("variety", "n_distinct * 20 < n_words * 13 AND n_distinct * n_distinct < n_words * 100", "n_distinct * 10 >= n_words * 7 OR n_distinct * n_distinct >= n_words * 120"),
    ("word_length", "word_chars * 2 < n_words * 9 OR word_chars > n_words * 7", "word_chars * 10 >= n_words * 46 AND word_chars <= n_words * 6"),
    ("sentences", "n_stops * 100 < n_words * 5", "n_stops * 100 >= n_words * 7"),
    ("stops", "n_stops * 8 > n_words", "n_stops * 9 <= n_words"),
    ("brief", "n_words < 60", "n_words >= 120"),
]


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_exclaims", "n_stops")


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def features(docs: DataFrame, text_col: str, at: str) -> DataFrame:
    """``docs`` with columns ``at_<name>`` (see ``NAMES``) of counts over the whole text.

    They are columns and not one struct, and each is used more than once, so the optimizer computes each once a row.

    Null and empty texts count 0 throughout. The repeated-window count hashes every 8-word window to 64 bits, stops
    there when all hashes differ, and otherwise sorts (hash, position) within the row: n log n, however repetitive.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    t, words, keys, ordered, places = (fresh(docs, f"{at}_{x}") for x in ("t", "words", "keys", "ordered", "places"))
    df = docs.withColumn(t, text).withColumn(words, F.array_remove(F.split(F.col(t), GAP), ""))
    n = F.size(words)
    hashes = fresh(docs, f"{at}_hashes")
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)]))
    df = df.withColumn(keys, F.when(n >= WINDOW, window))
    again = F.size(F.array_distinct(F.col(keys))) < F.size(keys)
    df = df.withColumn(ordered, F.when(again, F.sort_array(F.transform(F.col(keys), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda x, j: x["k"].eqNullSafe(F.get(F.col(ordered), j)["k"])
    twice = F.filter(F.col(ordered), lambda x, j: same(x, j + 1) | same(x, F.greatest(j - 1, F.lit(0))) & (j > 0))
    df = df.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    step = F.transform(F.col(places), lambda p, m: F.least(F.coalesce(F.get(F.col(places), m + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")

    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    line_col = fresh(docs, f"{at}_lines")
    df = df.withColumn(line_col, lines)
    without = lambda chars: (F.length(t) - F.length(F.translate(F.col(t), chars, ""))).cast("long")
    letters = "abcdefghijklmnopqrstuvwxyz"
    upper = without(letters.upper())
    counts = [
        _size(F.col(words)).alias("n_words"),
        F.length(F.translate(F.col(t), BLANKS, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        _size(F.col(line_col)).alias("n_lines"),
        (_size(F.col(line_col)) - _size(F.array_distinct(line_col))).alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        _size(F.array_distinct(words)).alias("n_distinct"),
        upper.alias("n_upper"),
        without(letters.upper() + letters).alias("n_letters"),
        without("!").alias("n_exclaims"),
        without(".!?").alias("n_stops"),
    ]
    named = [c.alias(f"{at}_{name}") for c, name in zip(counts, NAMES, strict=True)]
    return df.select("*", *named).drop(t, words, hashes, keys, ordered, places, line_col)


def vote_pattern(at: str) -> Column:
    """The votes of all rules as one base-3 number, first rule lowest."""
    code = F.lit(0)
    for k, (_, bad, good) in enumerate(RULES):
        code = code + F.lit(3**k) * _vote(at, bad, good)
    return code.cast("long")


def _vote(at: str, bad: str, good: str) -> Column:
    def qualify(cond: str) -> Column:
        return F.expr(" ".join(f"`{at}_{w}`" if w in NAMES else w for w in cond.replace("(", "( ").replace(")", " )").split()))

    return F.when(qualify(bad), BAD).when(qualify(good), GOOD).otherwise(ABSTAIN)


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(RULES))]


@dataclass
class LabelModel:
    """``good``: share of good documents. ``table[rule][class][vote]``: probability of the vote on bad (0) and good (1) documents."""

    good: float
    table: list[list[list[float]]]
    rounds: int

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each rule, how often its bad votes and its good votes are right."""
        out = {}
        for (name, _, _), (bad, good) in zip(RULES, self.table, strict=True):
            flags, passes = ([(1 - self.good) * bad[v], self.good * good[v]] for v in (BAD, GOOD))
            out[name] = flags[0] / sum(flags), passes[1] / sum(passes)
        return out

    def apart(self) -> bool:
        """Whether the worse class fails ``FAULTS`` rules on average, and more than the better one."""
        bad, good = (sum(rule[c][BAD] for rule in self.table) for c in (0, 1))
        return bad >= FAULTS and bad > good

    def log_odds(self, pattern: int) -> float:
        """Of "good" against "bad"."""
        out = math.log(self.good) - math.log(1 - self.good)
        for (bad, good), v in zip(self.table, votes_of(pattern), strict=True):
            out += math.log(good[v]) - math.log(bad[v])
        return out

    def posterior(self, pattern: int) -> float:
        """Probability of "good" for a vote pattern; 1 where the corpus has no class of bad documents."""
        return 1 / (1 + math.exp(min(-self.log_odds(pattern), 700))) if self.apart() else 1.0


def expectation_maximisation(counts: dict[int, int], rounds: int = 300, tolerance: float = 1e-10) -> LabelModel:
    """Fit on pattern -> documents: two classes, every probability free. What a rule's votes, abstentions included, say about a document
    comes out of its agreement with the other rules alone. The start only says which class is which: a document is good to the share of
    its votes that are. Every vote counts one document more in either class, so none is impossible; an empty table tells the classes not apart.
    """
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns], np.int64).reshape(-1, len(RULES))
    n = np.array([counts[p] for p in patterns], np.float64)
    cast = (votes != ABSTAIN).sum(axis=1)
    p = np.where(cast > 0, (votes == GOOD).sum(axis=1) / np.maximum(cast, 1), 0.5)
    at, last, table, mass = np.arange(len(RULES)), None, np.full((len(RULES), 2, 3), 1 / 3), np.ones(2)
    for r in range(1, rounds + 1 if patterns else 1):
        soft = np.stack([n * (1 - p), n * p])
        mass = soft.sum(axis=1) + 1
        table = np.array([[np.bincount(votes[:, k], w, 3) + 1 for w in soft] for k in at])
        table /= table.sum(axis=2, keepdims=True)
        bad, good = (np.log(table[at, c, votes]).sum(axis=1) + math.log(mass[c] / mass.sum()) for c in (0, 1))
        p = 1 / (1 + np.exp(np.minimum(bad - good, 700)))
        moved = float(n @ p)
        if last is not None and abs(moved - last) <= tolerance * n.sum():
            break
        last = moved
    return LabelModel(float(mass[1] / mass.sum()), table.tolist(), r if patterns else 0)


def pattern_posteriors(patterns: DataFrame, pattern_col: str) -> DataFrame:
    """``pattern, p_good`` for every vote pattern of the column: at most 3 ** len(RULES) rows, so driver and broadcast hold
    them at any size of the corpus."""
    counts = {int(r[0]): int(r[1]) for r in patterns.groupBy(pattern_col).count().collect()}
    model = expectation_maximisation(counts)
    return patterns.sparkSession.createDataFrame([(c, model.posterior(c)) for c in sorted(counts)], "pattern long, p_good double")


def base_failed(at: str) -> Column:
    return (F.col(f"{at}_n_words") < 20) | (F.col(f"{at}_n_repeat_words") * 100 > F.col(f"{at}_n_words") * 30)


def keep(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base checks and whose posterior of "good" is at least ``threshold``.

    Columns and rows come back unchanged; null, empty and very short texts fail the base check; equal rows fare alike;
    an empty table stays empty. Features are computed once a row and the rows stored with their votes: those are counted first, then
    the rows are filtered.
    """
    at, code, failed, pattern = (fresh(docs, f"quality_{x}") for x in ("features", "votes", "failed", "pattern"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    held = Stored(features(docs, text_col, at).select(*own, vote_pattern(at).alias(code), base_failed(at).alias(failed)), "quality-rows").df
    good = pattern_posteriors(held, code).filter(F.col("p_good") >= threshold).select(F.col("pattern").alias(pattern))
    return held.filter(~F.col(failed)).join(F.broadcast(good), F.col(code) == F.col(pattern), "left_semi").select(*own)
