"""Text functions. Positions and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(s: Column) -> Column:
    """The characters in order; an empty text has none."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.when(s.isNotNull(), F.array().cast("array<string>")))


def words(s: Column) -> Column:
    """Split at runs of white space, without empty words."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def first_char(s: Column) -> Column:
    return F.left(s, F.lit(1))


def first_half(s: Column) -> Column:
    return F.left(s, F.floor(F.length(s) / 2).cast("int"))


def every_other(s: Column) -> Column:
    return F.array_join(F.filter(chars(s), lambda _, i: i % 2 == 0), "")


def remove_spaces(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def strip(s: Column) -> Column:
    """All white space goes from both ends, not only blanks."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def capitalize(s: Column) -> Column:
    """First letter upper, rest lower, over the whole text and not word by word."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def is_palindrome(s: Column) -> Column:
    return s == F.reverse(s)


def letters_sorted(s: Column) -> Column:
    """Equal for anagrams, and only for them."""
    return F.array_join(F.array_sort(chars(s)), "")


def is_anagram(a: Column, b: Column) -> Column:
    return letters_sorted(a) == letters_sorted(b)


def vowel_count(s: Column) -> Column:
    """Lower-case vowels."""
    return F.length(s) - F.length(F.translate(s, "aeiou", ""))


def occurrences(s: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; null for an empty needle."""
    return F.when(F.length(needle) > 0, ((F.length(s) - F.length(F.replace(s, needle, F.lit("")))) / F.length(needle)).cast("int"))


def reverse_words(s: Column) -> Column:
    """A struct (word, reversed) for every different word, in order of first use."""
    return F.transform(F.array_distinct(words(s)), lambda w: F.struct(w.alias("word"), F.reverse(w).alias("reversed")))


def distinct_words(s: Column) -> Column:
    """Words joined by blanks, repeats dropped, first use first."""
    return F.array_join(F.array_distinct(words(s)), " ")


def run_lengths(s: Column) -> Column:
    """Run-length code, ``aab`` -> ``a2b1``: one fold over the characters."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("c"), F.lit(0).alias("n"))
    done = lambda a: F.when(a["n"] > 0, F.concat(a["out"], a["c"], a["n"].cast("string"))).otherwise(a["out"])

    def step(a, c):
        return F.when(a["c"] == c, F.struct(a["out"].alias("out"), c.alias("c"), (a["n"] + 1).alias("n"))).otherwise(
            F.struct(done(a).alias("out"), c.alias("c"), F.lit(1).alias("n"))
        )

    return F.aggregate(chars(s), start, step, done)
