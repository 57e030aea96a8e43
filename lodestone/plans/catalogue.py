"""Queries over the test tables and the SQL that states the same. Computed integers are cast to long on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import errors as E
from lodestone.functions import nested as N
from lodestone.functions import numbers as M
from lodestone.functions import sequences as S
from lodestone.functions import text as T
from lodestone.operators import matrix, regression, relational
from lodestone.store import scratch
from lodestone.streaming import sentinel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def over(table: str, key: str, column: str, out: dict[str, Callable], sql: dict[str, str], where: str | None = None):
    """A query that keeps ``key`` and computes columns from one column; expressions get the column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sources.load(spark, sf_dir, table)
        return (df.filter(where) if where else df).select(key, *[f(F.col(column)).alias(n) for n, f in out.items()])

    return run, f"SELECT {key}, {', '.join(f'{x} AS {n}' for n, x in sql.items())} FROM {table}" + (f" WHERE {where}" if where else "")


def simple(name: str, *args, **kw) -> None:
    QUERIES[name], SQL[name] = over(*args, **kw)


L = "long"
DNA = "translate(md5({k}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dna(c):
    return F.translate(F.md5(c.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


# Text ---------------------------------------------------------------------------------------------------------------
simple("parity", "part", "p_partkey", "p_size", {"parity": M.parity}, {"parity": "CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END"})
simple("vowel_count", "part", "p_partkey", "p_name", {"n": lambda c: T.vowel_count(c).cast(L)}, {"n": "len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT"})
simple("vowel_eq_k", "part", "p_partkey", "p_name", {"p_name": lambda c: c}, {"p_name": "p_name"}, where="length(p_name) - length(translate(p_name, 'aeiou', '')) = 2")
SQL["vowel_eq_k"] = "SELECT p_partkey, p_name FROM part WHERE len(regexp_extract_all(p_name, '[aeiou]')) = 2"
simple("capitalize", "part", "p_partkey", "p_type", {"s": lambda c: T.capitalize(F.lower(c))}, {"s": "concat(upper(left(lower(p_type), 1)), lower(substr(lower(p_type), 2)))"})
simple("palindrome", "orders", "o_orderkey", "o_orderkey", {"p": lambda c: T.is_palindrome(c.cast("string"))}, {"p": "o_orderkey::VARCHAR = reverse(o_orderkey::VARCHAR)"})
simple("first_char", "part", "p_partkey", "p_name", {"c": T.first_char}, {"c": "left(p_name, 1)"})
simple("string_half", "documents", "doc_id", "text", {"half": T.first_half}, {"half": "substr(text, 1, (length(text) // 2)::BIGINT)"})
simple("every_other_char", "part", "p_partkey", "p_name", {"s": T.every_other}, {"s": "array_to_string(list_filter(string_split(p_name, ''), lambda x, i: i % 2 = 1), '')"})
simple("strip", "part", "p_partkey", "p_name", {"s": lambda c: T.strip(F.concat(F.lit(" \t"), c, F.lit("\n ")))}, {"s": r"regexp_replace(concat(' ', chr(9), p_name, chr(10), ' '), '^\s+|\s+$', '', 'g')"})
simple("remove_spaces", "part", "p_partkey", "p_name", {"s": T.remove_spaces}, {"s": "replace(p_name, ' ', '')"})
simple("concat_text", "part", "p_partkey", "p_name", {"s": lambda c: F.concat(c, F.lit("/"), F.col("p_brand"))}, {"s": "concat(p_name, '/', p_brand)"})
simple("starts_with", "part", "p_partkey", "p_name", {"p_name": lambda c: c}, {"p_name": "p_name"}, where="left(p_name, 1) = 's'")
simple("substring_count", "documents", "doc_id", "text", {"n": lambda c: T.occurrences(c, F.lit("th")).cast(L)}, {"n": "((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT"})
simple("string_replace", "documents", "doc_id", "text", {"s": lambda c: F.replace(c, F.lit("a"), F.lit("z"))}, {"s": "replace(text, 'a', 'z')"})
simple("char_arrays", "documents", "doc_id", "text", {"n": lambda c: F.size(T.chars(c)).cast(L)}, {"n": "len(string_split(text, ''))::BIGINT"})
simple("text_length", "documents", "doc_id", "text", {"n": lambda c: F.length(c).cast(L)}, {"n": "length(text)::BIGINT"})
simple("upper_lower", "part", "p_partkey", "p_name", {"u": F.upper, "l": F.lower}, {"u": "upper(p_name)", "l": "lower(p_name)"})
simple("formatted", "part", "p_partkey", "p_size", {"s": lambda c: F.format_string("%05d", c)}, {"s": "printf('%05d', p_size)"})
simple("split_date", "orders", "o_orderkey", "o_orderdate", {"m": lambda c: F.get(F.split(F.date_format(c, "M/d/yyyy"), "/"), F.lit(0))}, {"m": "month(o_orderdate)::VARCHAR"})
simple("formatted_float", "lineitem", "l_orderkey", "l_extendedprice", {"s": lambda c: F.format_string("%.2f", c), "line": lambda c: F.format_string("%s of %s", F.col("l_linenumber"), F.col("l_orderkey"))}, {"s": "printf('%.2f', l_extendedprice)", "line": "concat(l_linenumber, ' of ', l_orderkey)"})
simple("distinct_characters", "part", "p_partkey", "p_name", {"n": lambda c: F.size(F.array_distinct(T.chars(c))).cast(L)}, {"n": "len(list_distinct(string_split(p_name, '')))::BIGINT"})
simple("contains_word", "part", "p_partkey", "p_type", {"b": lambda c: c.contains("ECO")}, {"b": "contains(p_type, 'ECO')"})


@query("SELECT w[1] AS c, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' GROUP BY w[1]")
def words_by_first_char(spark, sf_dir):
    """How many words begin with each character; FLT3 asks for one of them."""
    words = sources.load(spark, sf_dir, "part").select(F.explode(T.words(F.col("p_name"))).alias("w"))
    return words.groupBy(T.first_char(F.col("w")).alias("c")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, string_agg(c || n::VARCHAR, '' ORDER BY first) AS code FROM (SELECT n_nationkey, c, count(*) AS n, min(i) AS first FROM (SELECT n_nationkey, i, c, i - row_number() OVER (PARTITION BY n_nationkey, c ORDER BY i) AS g FROM (SELECT n_nationkey, unnest(range(1, length(s) + 1)) AS i, substr(s, unnest(range(1, length(s) + 1)), 1) AS c FROM (SELECT n_nationkey, concat(n_name, 'aabbb') AS s FROM nation))) GROUP BY n_nationkey, c, g) GROUP BY n_nationkey")
def rle_encode(spark, sf_dir):
    return sources.load(spark, sf_dir, "nation").select("n_nationkey", T.run_lengths(F.concat("n_name", F.lit("aabbb"))).alias("code"))


@query("SELECT p_partkey, w AS word, reverse(w) AS reversed FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''")
def reverse_words(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").select("p_partkey", F.explode(T.reverse_words(F.col("p_name"))).alias("w")).select("p_partkey", "w.*")


@query(r"SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def word_count(spark, sf_dir):
    return sources.load(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS s FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS p FROM (SELECT doc_id, string_split_regex(text, '\s+') AS x FROM documents)) WHERE w <> '' GROUP BY doc_id, w) GROUP BY doc_id")
def dedup_words(spark, sf_dir):
    return sources.load(spark, sf_dir, "documents").select("doc_id", T.distinct_words(F.col("text")).alias("s")).filter("s <> ''")


@query("SELECT k AS letters, count(*)::BIGINT AS n FROM (SELECT array_to_string(list_sort(string_split(p_name, '')), '') AS k FROM part) GROUP BY k HAVING count(*) > 1")
def anagram_groups(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").groupBy(T.letters_sorted(F.col("p_name")).alias("letters")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT p_partkey, c, n::BIGINT AS n FROM (SELECT p_partkey, c, count(*) AS n, max(i) AS last FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, unnest(range(length(p_name))) AS i FROM part) GROUP BY p_partkey, c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, last DESC) = 1)")
def char_mode_last_tie(spark, sf_dir):
    return relational.char_mode(sources.load(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT c, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) GROUP BY c")
def char_frequency(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").select(F.explode(T.chars(F.col("p_name"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


# Sequences ----------------------------------------------------------------------------------------------------------
@query("SELECT kmer, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(0, length(p_name) - 2), lambda i: substr(p_name, i + 1, 3))) AS kmer FROM part WHERE length(p_name) >= 3) GROUP BY kmer")
def kmer_spectrum(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").select(F.explode(S.kmers(F.col("p_name"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, i::BIGINT AS at FROM (SELECT p_partkey, p_name, unnest(range(0, greatest(length(p_name) - 1, 0))) AS i FROM part) WHERE substr(p_name, i + 1, 2) = 'ar'")
def motif_positions(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").select("p_partkey", F.explode(S.motif_starts(F.col("p_name"), F.lit("ar"))).alias("at")).withColumn("at", F.col("at").cast(L))


simple("gc_content", "orders", "o_orderkey", "o_orderkey", {"gc": lambda c: F.round(S.share_of(dna(c), "GC"), 6)}, {"gc": f"round(100.0::DOUBLE * (length(d) - length(translate(d, 'GC', ''))) / length(d), 6)"})
SQL["gc_content"] = SQL["gc_content"].replace("FROM orders", f"FROM (SELECT o_orderkey, {DNA.format(k='o_orderkey')} AS d FROM orders)")
simple("base_shares", "orders", "o_orderkey", "o_orderkey", {x.lower(): lambda c, x=x: F.round(S.share_of(dna(c), x), 6) for x in ("G", "C", "GC")}, {x.lower(): f"round(100.0::DOUBLE * (length(d) - length(translate(d, '{x}', ''))) / length(d), 6)" for x in ("G", "C", "GC")})
SQL["base_shares"] = SQL["base_shares"].replace("FROM orders", f"FROM (SELECT o_orderkey, {DNA.format(k='o_orderkey')} AS d FROM orders)")
simple("transcribe", "orders", "o_orderkey", "o_orderkey", {"rna": lambda c: S.transcribe(dna(c))}, {"rna": f"replace({DNA.format(k='o_orderkey')}, 'T', 'U')"})
simple("reverse_complement", "orders", "o_orderkey", "o_orderkey", {"rc": lambda c: S.reverse_complement(dna(c))}, {"rc": f"reverse(translate({DNA.format(k='o_orderkey')}, 'ACGT', 'TGCA'))"})
simple("translate_complement", "part", "p_partkey", "p_partkey", {"c": lambda c: S.complement(dna(c))}, {"c": f"translate({DNA.format(k='p_partkey')}, 'ACGT', 'TGCA')"})
simple("codon_count", "orders", "o_orderkey", "o_orderkey", {"n": lambda c: F.floor(F.length(dna(c)) / 3).cast(L)}, {"n": f"(length({DNA.format(k='o_orderkey')}) // 3)::BIGINT"})


@query(f"WITH dim(codon, label) AS (VALUES {', '.join(f'({c!r}, {x!r})' for x, cs in S.CODONS.items() for c in cs.split())}), c AS (SELECT o_orderkey, unnest(list_transform(range(0, length(r) - 2, 3), lambda i: substr(r, i + 1, 3))) AS codon FROM (SELECT o_orderkey, replace({DNA.format(k='o_orderkey')}, 'T', 'U') AS r FROM orders)) SELECT label, count(*)::BIGINT AS n FROM c LEFT JOIN dim USING (codon) GROUP BY label")
def codon_translate(spark, sf_dir):
    rna = sources.load(spark, sf_dir, "orders").select(S.transcribe(dna(F.col("o_orderkey"))).alias("rna"))  # once a row, not once a codon
    rna = rna.select(F.explode(S.codons(F.col("rna"))).alias("codon"))
    return rna.join(F.broadcast(S.codon_dim(spark)), "codon", "left").groupBy("label").agg(F.count("*").alias("n"))


MATCHES = "len(list_filter(range(1, least(length(a.n_name), length(b.n_name)) + 1), lambda i: substr(a.n_name, i, 1) = substr(b.n_name, i, 1)))"


@query(f"SELECT a.n_name AS seq_a, b.n_name AS seq_b, ({MATCHES})::BIGINT AS score FROM nation a, nation b WHERE {MATCHES} > 4")
def similar_pairs(spark, sf_dir):
    n = sources.load(spark, sf_dir, "nation").select(F.col("n_name").alias("seq"))
    return relational.similar_pairs(n, n, 4).withColumn("score", F.col("score").cast(L))


@query(f"SELECT DISTINCT a.n_name AS seq_a, b.n_name AS seq_b, ({MATCHES})::BIGINT AS score FROM nation a, nation b WHERE {MATCHES} > 4")
def similar_pairs_blocked(spark, sf_dir):
    n = sources.load(spark, sf_dir, "nation").select(F.col("n_name").alias("seq"))
    return relational.similar_pairs(n, n, 4, blocks=True).withColumn("score", F.col("score").cast(L))


@query("SELECT a.n_name AS a, b.n_name AS b, hamming(a.n_name, b.n_name)::BIGINT AS d FROM nation a, nation b WHERE length(a.n_name) = length(b.n_name) AND a.n_nationkey < b.n_nationkey")
def hamming_pairs(spark, sf_dir):
    n = sources.load(spark, sf_dir, "nation").withColumn("len", F.length("n_name"))
    a, b = (n.select("len", F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in ("a", "b"))
    return a.join(b, "len").filter("ka < kb").select("a", "b", S.hamming(F.col("a"), F.col("b")).cast(L).alias("d"))


NAMES = "(SELECT DISTINCT concat(p_name, ' ', p_type) AS s FROM part)"
SAME = "len(list_filter(range(1, least(length(a.s), length(b.s)) + 1), lambda i: substr(a.s, i, 1) = substr(b.s, i, 1)))"


@query(f"SELECT a.s AS seq_a, b.s AS seq_b, {SAME}::BIGINT AS score FROM {NAMES} a, {NAMES} b WHERE {SAME} > 11")
def similar_names(spark, sf_dir):
    """Parts' names with their types, of many lengths, that agree in more than eleven places."""
    n = sources.load(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("seq"))
    return relational.similar_pairs(n, n, 11, blocks=True).withColumn("score", F.col("score").cast(L))


simple("hamming_status", "part", "p_partkey", "p_name", {"d": lambda c: F.coalesce(S.hamming(c, F.col("p_type")).cast(L), F.lit(-1).cast(L)), "status": lambda c: S.hamming_status(c, F.col("p_type"))}, {"d": "CASE WHEN length(p_name) = length(p_type) THEN hamming(p_name, p_type) ELSE -1 END::BIGINT", "status": "CASE WHEN length(p_name) = length(p_type) THEN 'ok' ELSE 'lengths differ' END"})


# Numbers ------------------------------------------------------------------------------------------------------------
simple("prime_flag", "part", "p_partkey", "p_partkey", {"prime": M.is_prime}, {"prime": "p_partkey > 1 AND len(list_filter(range(2, greatest(2, floor(sqrt(p_partkey))::BIGINT) + 1), lambda i: i < p_partkey AND p_partkey % i = 0)) = 0"})
#: Keys times a number with many small factors and one more: primes are frequent among them, and none has a factor below 17.
WIDE = 30_030 * 1_000_000_007
# The oracle's strong tests take other bases, in 128-bit integers.
simple("prime_flag_wide", "part", "p_partkey", "p_partkey", {"n": lambda c: c % 300_000 * F.lit(WIDE) + 1, "prime": lambda c: M.is_prime(c % 300_000 * F.lit(WIDE) + 1)}, {"n": "n", "prime": "n > 1 AND list_bool_and(list_transform([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37], lambda a: n = a OR len(list_filter(range(s), lambda j: list_reduce(string_split(bin(((n - 1) >> s) << j), ''), lambda r, b: r * r % n * CASE WHEN b = '1' THEN a ELSE 1 END % n, 1::HUGEINT) = n - 1)) > 0 OR list_reduce(string_split(bin((n - 1) >> s), ''), lambda r, b: r * r % n * CASE WHEN b = '1' THEN a ELSE 1 END % n, 1::HUGEINT) = 1))"})
SQL["prime_flag_wide"] = SQL["prime_flag_wide"].replace("FROM part", f"FROM (SELECT *, bit_count(((n - 1) & -(n - 1)) - 1)::INT AS s FROM (SELECT p_partkey, p_partkey % 300000 * {WIDE} + 1 AS n FROM part))")
@query(f"SELECT p_partkey, coalesce(t, factorial(least(n, 33)::INT)::VARCHAR) AS f FROM (SELECT p_partkey, p_size + 50 * (p_partkey % 4) AS n FROM part) LEFT JOIN (VALUES {', '.join(f'({k}, {str(math.factorial(k))!r})' for k in range(34, 201))}) v(k, t) ON k = n")
def factorial_text(spark, sf_dir):
    part = sources.load(spark, sf_dir, "part").withColumn("n", F.col("p_size") + 50 * (F.col("p_partkey") % 4))
    return relational.with_factorial(part, "n", "f").select("p_partkey", "f")


simple("temp_convert", "part", "p_partkey", "p_size", {"up": lambda c: F.round(M.scaled_up(c.cast("double")), 6), "down": lambda c: F.round(M.scaled_down(c.cast("double")), 6)}, {"up": "round((p_size::DOUBLE - 32) * 9 / 5, 6)", "down": "round((p_size::DOUBLE - 32) * 5 / 9, 6)"})
simple("power", "part", "p_partkey", "p_size", {"p": lambda c: F.pow(c, F.lit(3))}, {"p": "pow(p_size, 3)::DOUBLE"})
simple("power_of_columns", "lineitem", "l_orderkey", "l_linenumber", {"p": lambda c: F.pow(c, F.pmod(F.col("l_suppkey"), F.lit(9)))}, {"p": "pow(l_linenumber, l_suppkey % 9)::DOUBLE"})
simple("factorial_small", "part", "p_partkey", "p_size", {"f": lambda c: M.small_factorial(F.pmod(c, F.lit(15)))}, {"f": "factorial((p_size % 15)::INT)::BIGINT"})
simple("price_with_tax", "part", "p_partkey", "p_retailprice", {"p": lambda c: F.round(M.price(c), 4)}, {"p": "round(p_retailprice + p_retailprice * 0.07::DOUBLE - 0.0::DOUBLE, 4)"})
simple("derivative", "part", "p_partkey", "p_size", {"d": lambda c: (2 * c).cast(L)}, {"d": "(2 * p_size)::BIGINT"})
simple("floor_modulo", "orders", "o_orderkey", "o_orderkey", {"q": lambda c: F.floor(-c / 7).cast(L), "m": lambda c: F.pmod(-c, F.lit(7)).cast(L)}, {"q": "floor(-o_orderkey / 7)::BIGINT", "m": "(((-o_orderkey % 7) + 7) % 7)::BIGINT"})
simple("subtract", "lineitem", "l_orderkey", "l_quantity", {"d": lambda c: c - F.col("l_tax")}, {"d": "l_quantity - l_tax"})
simple("case_lookup", "orders", "o_orderkey", "o_orderstatus", {"s": lambda c: F.when(c == "F", "final").when(c == "O", "open").otherwise("other")}, {"s": "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END"})
simple("isin_filter", "part", "p_partkey", "p_size", {"p_size": lambda c: c}, {"p_size": "p_size"}, where="p_size IN (1, 7, 9)")
simple("comparison_logic", "part", "p_partkey", "p_size", {"b": lambda c: (c > 10) & ~(c >= 40) | (c == 1)}, {"b": "(p_size > 10 AND NOT p_size >= 40) OR p_size = 1"})
simple("swap_columns", "lineitem", "l_orderkey", "l_quantity", {"a": lambda c: F.col("l_discount"), "b": lambda c: c}, {"a": "l_discount", "b": "l_quantity"})
simple("tuple_arithmetic", "part", "p_partkey", "p_size", {"a": lambda c: F.struct((c + 3).alias("x"))["x"].cast(L), "b": lambda c: (c - 3).cast(L)}, {"a": "(p_size + 3)::BIGINT", "b": "(p_size - 3)::BIGINT"})
simple(
    "record_of_arguments", "part", "p_partkey", "p_name",
    {f: lambda c, f=f: F.struct(c.alias("bat"), F.col("p_brand").alias("bowl"), F.col("p_type").alias("keep"), F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("none")).alias("last"))[f] for f in ("bat", "bowl", "keep", "last")},
    {"bat": "p_name", "bowl": "p_brand", "keep": "p_type", "last": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'none' END"},
)
simple("record_default", "events", "event_id", "event_type", {"r": lambda c: F.coalesce(F.when(c == "click", c), F.lit("none"))}, {"r": "CASE WHEN event_type = 'click' THEN event_type ELSE 'none' END"})


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0, 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 50) SELECT p_partkey, n::BIGINT AS n, a AS term FROM part JOIN f ON n <= p_size")
def fibonacci(spark, sf_dir):
    """Of every part the terms up to its size."""
    return sources.load(spark, sf_dir, "part").select("p_partkey", F.posexplode(M.fibonacci_terms(F.col("p_size"))).alias("n", "term")).withColumn("n", F.col("n").cast(L))


def _digits(name, f, sql):
    def run(spark, sf_dir):
        return sources.load(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(f(F.col("o_orderkey"))).alias("pos", "digit")).select("o_orderkey", F.col("pos").cast(L).alias("pos"), "digit")

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey, unnest(range(length(s)))::BIGINT AS pos, unnest(string_split(s, '')) AS digit FROM (SELECT o_orderkey, {sql} AS s FROM orders WHERE o_orderkey > 0)"


_digits("binary_digits_lsb", M.binary_digits, "reverse(bin(o_orderkey))")
_digits("digits", M.decimal_digits, "o_orderkey::VARCHAR")


@query("SELECT p_partkey, (SELECT sum(i) FROM range(1, p_size + 1) t(i))::BIGINT AS total, (SELECT sum(i * i) FROM range(1, p_size + 1) t(i))::BIGINT AS squares FROM part")
def sum_1_to_n(spark, sf_dir):
    """Of every part the sums of 1 to its size and of their squares."""
    n = sources.load(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1).cast(L), F.col("p_size").cast(L))).alias("i"))
    return n.groupBy("p_partkey").agg(F.sum("i").alias("total"), F.sum(F.col("i") * F.col("i")).alias("squares"))


@query("SELECT c_custkey, unnest(range(5))::BIGINT AS id, round(c_acctbal + unnest(range(5))::DOUBLE * ((0.0::DOUBLE - c_acctbal) / 4), 6) AS x FROM customer")
def linspace_grid(spark, sf_dir):
    """Five even steps from every balance to nothing."""
    c = sources.load(spark, sf_dir, "customer")
    return c.select("c_custkey", F.posexplode(M.linspace(F.col("c_acctbal"), F.lit(0.0), 5)).alias("id", "x")).select("c_custkey", F.col("id").cast(L).alias("id"), F.round("x", 6).alias("x"))


simple("polynomial_grid", "part", "p_partkey", "p_size", {"y": lambda c: M.polynomial(c.cast("double") - 25, 2, 3, 4), "line": lambda c: M.polynomial(c.cast("double") - 25, 2, 3), "square": lambda c: M.polynomial(c.cast("double") - 25, 1, 0, 0)}, {"y": "(2.0::DOUBLE * (p_size - 25) + 3.0) * (p_size - 25) + 4.0", "line": "2.0::DOUBLE * (p_size - 25) + 3.0", "square": "((p_size - 25) * (p_size - 25))::DOUBLE"})


@query("SELECT l_returnflag, round(sum(exp(-pow(l_quantity, 2.0) / 450.0::DOUBLE) / (15.0::DOUBLE * sqrt(2 * pi()))), 6) AS density FROM lineitem GROUP BY l_returnflag")
def gauss_density(spark, sf_dir):
    return sources.load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(M.gaussian(F.col("l_quantity"))), 6).alias("density"))


@query("SELECT o_orderkey, (o_orderkey * o_orderkey)::BIGINT AS square FROM orders WHERE o_orderkey % 2 <> 0")
def odd_squares(spark, sf_dir):
    """Even keys are skipped, the others squared."""
    return sources.load(spark, sf_dir, "orders").filter(F.pmod("o_orderkey", F.lit(2)) != 0).select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey")).alias("square"))


@query("SELECT p_partkey, unnest(range(3, p_size::BIGINT, 4))::BIGINT AS id FROM part")
def range_udtf(spark, sf_dir):
    """A generator as a table function, called for every row."""

    @F.udtf(returnType="id long")
    class Counting:
        def eval(self, start: int, stop: int, step: int):
            for k in range(start, stop, step):
                yield (k,)

    part = sources.load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return part.lateralJoin(Counting(F.lit(3), F.col("p_size").outer(), F.lit(4))).select("p_partkey", "id")


@query("SELECT p_partkey, unnest(list_transform(range(1, 6), lambda x: (x * x + p_size)::BIGINT)) AS y FROM part")
def square_hof(spark, sf_dir):
    return sources.load(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda x: (x * x + F.col("p_size")).cast(L))).alias("y"))


# Grouped and windowed -----------------------------------------------------------------------------------------------
@query("SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def dup_values(spark, sf_dir):
    return relational.duplicated(sources.load(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having_k(spark, sf_dir):
    return relational.duplicated(sources.load(spark, sf_dir, "orders"), "o_custkey", 12)


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_distinct FROM events GROUP BY event_type ORDER BY n_distinct DESC, min(event_id), event_type LIMIT 1")
def max_distinct_key(spark, sf_dir):
    return relational.max_distinct_key(sources.load(spark, sf_dir, "events"), "event_type", "user_id", F.min("event_id"))


@query("SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def min_max_sum_avg(spark, sf_dir):
    q = F.col("l_quantity")
    return sources.load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY event_type")
def distinct_count(spark, sf_dir):
    return sources.load(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))


def _by_time(end: int = 0):
    return Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, end)


@query("SELECT event_id, m AS running FROM (SELECT event_id, value, max(value) OVER w AS m, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE before IS NULL OR m > before")
def running_max(spark, sf_dir):
    e = sources.load(spark, sf_dir, "events")
    before = F.max("value").over(_by_time(-1))
    return e.withColumn("before", before).filter("before IS NULL OR value > before").select("event_id", F.col("value").alias("running"))


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), ',') AS seen FROM events")
def running_collect(spark, sf_dir):
    """Every row with all up to it, as the survey's accumulating state has it: by its form the output grows with the square of a user's events."""
    return sources.load(spark, sf_dir, "events").select("event_id", F.array_join(F.collect_list("event_type").over(_by_time()), ",").alias("seen"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def running_sum(spark, sf_dir):
    return sources.load(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(_by_time()), 4).alias("total"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS pos FROM events")
def enumerated(spark, sf_dir):
    return sources.load(spark, sf_dir, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast(L).alias("pos"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    li = sources.load(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


UNTIL = "SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (FROM events s WHERE s.event_type = 'error' AND s.user_id IS NOT DISTINCT FROM e.user_id AND (s.ts < e.ts OR s.ts = e.ts AND s.event_id <= e.event_id))"


@query(UNTIL)
def until_sentinel(spark, sf_dir):
    """Every user's events before the first error."""
    e = sources.load(spark, sf_dir, "events")
    return sources.until_sentinel(e, F.struct("ts", "event_id"), "event_type", "error", "user_id").select("event_id", "user_id", "event_type")


@query(UNTIL)
def stream_until_sentinel(spark, sf_dir):
    """The same of the events as a stream, which is stopped once and started again."""
    e = sources.load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    stream = sources.load_stream(spark, sf_dir, "events", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    tick = e.agg(F.lit(None).cast(L).alias("user_id"), (F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 2 HOURS")).alias("ts"), F.lit(None).cast(L).alias("event_id"), F.lit("").alias("event_type"))
    rows = sentinel.replay_until_sentinel(stream, tick, "user_id", "ts", "event_id", "event_type", "error", "1 hour")
    return rows.select("event_id", "user_id", "event_type")


# Sets and joins -----------------------------------------------------------------------------------------------------
def _two(spark, sf_dir):
    o = sources.load(spark, sf_dir, "orders")
    a = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a, o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))


TWO = "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') "
for _name, _op, _sql in (
    ("set_intersect", lambda a, b: a.intersect(b), "SELECT k FROM a INTERSECT SELECT k FROM b"),
    ("set_except", lambda a, b: a.subtract(b), "SELECT k FROM a EXCEPT SELECT k FROM b"),
    ("set_union", lambda a, b: a.union(b).distinct(), "SELECT k FROM a UNION SELECT k FROM b"),
    ("set_symdiff", relational.symmetric_difference, "(SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a)"),
    ("set_subset", relational.is_subset, "SELECT count(*) = 0 AS is_subset FROM (SELECT k FROM a EXCEPT SELECT k FROM b)"),
    ("semi_join", lambda a, b: a.join(b, "k", "left_semi"), "SELECT k FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k)"),
    ("anti_join", lambda a, b: a.join(b, "k", "left_anti"), "SELECT k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k)"),
):
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(*_two(spark, sf_dir))
    SQL[_name] = TWO + _sql


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark, sf_dir):
    return sources.load(spark, sf_dir, "region").select("r_name").crossJoin(sources.load(spark, sf_dir, "nation").select("n_name"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_lookup_join(spark, sf_dir):
    n = sources.load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sources.load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT a.o_orderkey, b.c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p FROM orders) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS p FROM customer) b USING (p)")
def positional_zip(spark, sf_dir):
    o, c = sources.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), sources.load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return relational.zip_by_order(o, c, [F.col("o_totalprice"), F.col("o_orderkey")], [F.col("c_acctbal"), F.col("c_custkey")]).select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return sources.load(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey")


@query("SELECT o_custkey, max(o_totalprice) >= 250000 AS any_large FROM orders GROUP BY o_custkey")
def exists_predicate(spark, sf_dir):
    return sources.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") >= 250000).alias("any_large"))


# Maps and arrays ----------------------------------------------------------------------------------------------------
def _maps(spark, sf_dir):
    c = sources.load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    a = F.create_map(F.lit("a"), k, F.lit("b"), k + 1)
    return c.select("c_custkey", a.alias("m"), F.create_map(F.lit("b"), k * 2, F.lit("c"), k * 3).alias("o"), F.array(k, k + 1, k + 2).alias("arr"))


def _entries(df, m):
    return df.select("c_custkey", F.explode(m).alias("k", "v"))


_K = "SELECT c_custkey, unnest([{k}]) AS k, unnest([{v}])::BIGINT AS v FROM customer"
for _name, _f, _sql in (
    ("map_merge", lambda d: _entries(d, N.merge_maps(F.col("m"), F.col("o"))), _K.format(k="'a', 'b', 'c'", v="c_custkey, c_custkey * 2, c_custkey * 3")),
    ("map_values_min_max", lambda d: d.select("c_custkey", F.array_min(F.map_values("m")).alias("lo"), F.array_max(F.map_values("m")).alias("hi")), "SELECT c_custkey, c_custkey AS lo, c_custkey + 1 AS hi FROM customer"),
    ("map_from_pairs", lambda d: _entries(d, N.map_from_pairs(F.array(*[F.struct(F.lit(k).alias("k"), F.get("arr", F.lit(i)).alias("v")) for i, k in enumerate("pq")]))), _K.format(k="'p', 'q'", v="c_custkey, c_custkey + 1")),
    ("map_from_two_characters", lambda d: d.select("c_custkey", F.explode(N.map_from_two_characters(F.array(F.right(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(2)), F.left(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(2))))).alias("k", "v")), "SELECT c_custkey, s[3] AS k, s[4] AS v FROM (SELECT c_custkey, right('0000' || c_custkey, greatest(4, length(c_custkey::VARCHAR)))[:4] AS s FROM customer) WHERE s[3] <> s[1] UNION ALL SELECT c_custkey, s[1], s[2] FROM (SELECT c_custkey, right('0000' || c_custkey, greatest(4, length(c_custkey::VARCHAR)))[:4] AS s FROM customer)"),
    ("map_comprehension", lambda d: _entries(d, N.map_where(F.col("arr"), lambda x: x % 2 == 0, lambda x: x * x)).withColumn("k", F.col("k").cast(L)), "SELECT c_custkey, k, k * k AS v FROM (SELECT c_custkey, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS k FROM customer) WHERE k % 2 = 0"),
    ("empty_collection", lambda d: d.select("c_custkey", N.truth(F.filter("arr", lambda x: x % 5 == 0)).alias("b")), "SELECT c_custkey, c_custkey % 5 IN (0, 3, 4) AS b FROM customer"),
    ("nested_literal", lambda d: d.select("c_custkey", F.explode(F.array(F.struct(F.lit("a").alias("x"), F.array(F.lit(1), F.col("c_custkey")).alias("y")), F.struct(F.lit("b").alias("x"), F.array(F.lit(2), F.lit(3).cast(L)).alias("y")))).alias("z")).select("c_custkey", "z.x", F.element_at("z.y", -1).alias("last")), "SELECT c_custkey, unnest(['a', 'b']) AS x, unnest([c_custkey, 3]) AS last FROM customer"),
    ("map_delete", lambda d: _entries(d, N.without_key(F.col("m"), F.lit("a"))), _K.format(k="'b'", v="c_custkey + 1")),
    ("map_entries", lambda d: _entries(d, F.col("m")), _K.format(k="'a', 'b'", v="c_custkey, c_custkey + 1")),
    ("map_insert", lambda d: _entries(d, N.merge_maps(F.col("m"), F.create_map(F.lit("z"), F.lit(0).cast(L)))), _K.format(k="'a', 'b', 'z'", v="c_custkey, c_custkey + 1, 0")),
    ("zip_to_map", lambda d: _entries(d, N.zip_to_map(F.array(F.lit("x"), F.lit("y")), F.col("arr"))), _K.format(k="'x', 'y'", v="c_custkey, c_custkey + 1")),
    ("map_get_default", lambda d: d.select("c_custkey", N.get_or(F.map_filter("m", lambda k, v: v % 3 == 0), F.lit("a"), F.lit(-1).cast(L)).alias("v"), F.element_at("m", "a").alias("a")), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 END AS v, c_custkey AS a FROM customer"),
    ("map_values_sum", lambda d: d.select("c_custkey", F.aggregate(F.map_values("m"), F.lit(0).cast(L), lambda a, x: a + x).alias("s"), F.array_max(F.map_values("m")).alias("hi")), "SELECT c_custkey, 2 * c_custkey + 1 AS s, c_custkey + 1 AS hi FROM customer"),
    ("map_key_membership", lambda d: d.select("c_custkey", *[F.map_contains_key(N.map_where(F.col("arr"), lambda x: x % 2 == 0, lambda x: x * x), F.lit(k).cast(L)).alias(f"has_{k}") for k in (4, 7)]), "SELECT c_custkey, c_custkey IN (2, 3, 4) AS has_4, false AS has_7 FROM customer"),
    ("array_get", lambda d: d.select("c_custkey", F.get("arr", F.lit(1)).alias("x"), F.element_at("arr", -1).alias("last"), F.coalesce(F.get("arr", F.lit(9)), F.lit(-1).cast(L)).alias("none")), "SELECT c_custkey, c_custkey + 1 AS x, c_custkey + 2 AS last, -1::BIGINT AS none FROM customer"),
    ("swap_ends", lambda d: d.select("c_custkey", F.posexplode(N.swap_ends(F.col("arr"))).alias("pos", "v")).withColumn("pos", F.col("pos").cast(L)), "SELECT c_custkey, unnest([0, 1, 2])::BIGINT AS pos, unnest([c_custkey + 2, c_custkey + 1, c_custkey]) AS v FROM customer"),
    ("array_append", lambda d: d.select("c_custkey", F.posexplode(F.array_append("arr", F.col("c_custkey") * 7)).alias("pos", "v")).withColumn("pos", F.col("pos").cast(L)), "SELECT c_custkey, unnest([0, 1, 2, 3])::BIGINT AS pos, unnest([c_custkey, c_custkey + 1, c_custkey + 2, c_custkey * 7]) AS v FROM customer"),
    ("remove_value", lambda d: d.select("c_custkey", F.explode(F.array_remove("arr", F.col("c_custkey") + 1)).alias("v")), "SELECT c_custkey, unnest([c_custkey, c_custkey + 2]) AS v FROM customer"),
    ("array_zip_shortest", lambda d: d.select("c_custkey", F.explode(N.zip_shortest(F.col("arr"), F.array(F.lit("p"), F.lit("q")))).alias("z")).select("c_custkey", "z.a", "z.b"), "SELECT c_custkey, unnest([c_custkey, c_custkey + 1]) AS a, unnest(['p', 'q']) AS b FROM customer"),
    ("array_sets", lambda d: d.select("c_custkey", *[F.array_join(F.array_sort(x), ",").alias(n) for n, x in (("both", F.array_intersect("arr", F.array(F.col("c_custkey") + 1, F.lit(5).cast(L)))), ("less", F.array_except("arr", F.array(F.col("c_custkey")))), ("either", F.array_union("arr", F.array(F.col("c_custkey") + 3))), ("one", N.symmetric_difference(F.col("arr"), F.array(F.col("c_custkey"), F.col("c_custkey") + 9))))], N.is_subset(F.array(F.lit(7).cast(L)), F.col("arr")).alias("within")), "SELECT c_custkey, array_to_string(list_sort(list_intersect(arr, [c_custkey + 1, 5])), ',') AS both, concat(c_custkey + 1, ',', c_custkey + 2) AS less, concat(c_custkey, ',', c_custkey + 1, ',', c_custkey + 2, ',', c_custkey + 3) AS either, concat(c_custkey + 1, ',', c_custkey + 2, ',', c_custkey + 9) AS one, c_custkey IN (5, 6, 7) AS within FROM (SELECT c_custkey, [c_custkey, c_custkey + 1, c_custkey + 2] AS arr FROM customer)"),
    ("safe_index", lambda d: d.select("c_custkey", F.try_element_at("arr", F.pmod(F.col("c_custkey"), F.lit(5)).cast("int") + 1).alias("v")).withColumn("v", F.coalesce("v", F.lit(-1).cast(L))), "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN c_custkey + c_custkey % 5 ELSE -1 END AS v FROM customer"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_maps(spark, sf_dir))
    SQL[_name] = _sql


simple("try_cast_safe", "events", "event_id", "props", {"n": lambda c: F.regexp_extract(c, r"([0-9a-z\"]+)\}", 1).try_cast("bigint"), "bad": lambda c: c.try_cast("bigint").isNull()}, {"n": r"try_cast(regexp_extract(props, '([0-9a-z\"]+)\}', 1) AS BIGINT)", "bad": "try_cast(props AS BIGINT) IS NULL"})
simple("json_extract", "events", "event_id", "props", {"k": lambda c: F.get_json_object(c, "$.k")}, {"k": "json_extract_string(props, '$.k')"})


GIVEN = "CASE event_id % 6 WHEN 0 THEN k WHEN 1 THEN props WHEN 2 THEN k || '.25' WHEN 3 THEN repeat('9' || k, 9) WHEN 4 THEN ' ' WHEN 5 THEN CASE WHEN k::INT % 2 = 0 THEN ' -' || k || ' ' END END"


def _parsed(spark, sf_dir):
    """What stands in the events' properties, whole or in part, as numbers."""
    e = sources.load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", E.whole_number(F.expr(GIVEN)).alias("n"))


PARSED = f"(SELECT event_id, {GIVEN} AS given FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"
CLASS = "CASE WHEN given IS NULL THEN 'MISSING' WHEN trim(given) = '' THEN 'EMPTY' WHEN length(given) > 18 AND given[1] = '9' THEN 'OUT_OF_RANGE' WHEN contains(given, '.') THEN 'FRACTION' WHEN given[1] = '{' THEN 'NOT_A_NUMBER' END"


@query(f"SELECT event_id, {CLASS} AS error_class, coalesce(given, '') AS error_input FROM {PARSED} WHERE error_class IS NOT NULL")
def failed_parses(spark, sf_dir):
    """The rows that are put aside, each with why."""
    return E.parted(_parsed(spark, sf_dir), "n")[1].fillna("", ["error_input"])


@query(f"SELECT event_id, trim(given)::BIGINT AS n FROM {PARSED} WHERE {CLASS} IS NULL")
def good_parses(spark, sf_dir):
    return E.parted(_parsed(spark, sf_dir), "n")[0]


@query("SELECT c_custkey, CASE WHEN i BETWEEN -3 AND 2 THEN c_custkey + ((i + 3) % 3) ELSE -1 END AS v, CASE WHEN i NOT BETWEEN -3 AND 2 THEN 'INDEX' ELSE 'none' END AS error, CASE WHEN i NOT BETWEEN -3 AND 2 THEN i::VARCHAR ELSE '' END AS given FROM (SELECT c_custkey, c_custkey % 9 - 4 AS i FROM customer)")
def checked_index(spark, sf_dir):
    x = E.element(F.col("arr"), (F.col("c_custkey") % 9 - 4).cast("int"))
    return _maps(spark, sf_dir).select("c_custkey", F.coalesce(x["value"], F.lit(-1)).alias("v"), F.coalesce(x["error"]["class"], F.lit("none")).alias("error"), F.coalesce(x["error"]["input"], F.lit("")).alias("given"))


# Files: written to the shared folder and read again -------------------------------------------------------------------
PART = ["p_partkey", "p_name", "p_size", "p_retailprice"]


def _part_csv(spark, sf_dir):
    path = scratch(spark, "part")
    sources.load(spark, sf_dir, "part").select(*PART).write.option("header", True).csv(path)
    return path


@query("SELECT p_partkey, p_name, p_size::DOUBLE AS p_size, p_retailprice AS label FROM part")
def csv_declared(spark, sf_dir):
    """A file with a header, its types declared, columns by name, one of them the target."""
    held = sources.read_csv(spark, _part_csv(spark, sf_dir), "p_partkey long, p_name string, p_size int, p_retailprice double")
    return held.select("p_partkey", "p_name").join(sources.features_and_target(held, ["p_partkey", "p_size"], "p_retailprice").withColumn("p_partkey", F.col("p_partkey").cast(L)), "p_partkey")


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice AS label FROM part")
def csv_inferred(spark, sf_dir):
    """The same with types inferred and columns by place."""
    held = sources.by_position(sources.read_csv(spark, _part_csv(spark, sf_dir)), slice(0, 3), 3)
    return held.withColumns({c: F.col(c).cast(L) for c in ("p_partkey", "p_size")})


@query("SELECT sum(length(p_name))::BIGINT AS characters, count(*)::BIGINT AS lines, count(*) FILTER (length(p_name) > 9)::BIGINT AS long_lines FROM part")
def text_written(spark, sf_dir):
    """Lines written, their characters as the writer counted them, and what is read again."""
    path = scratch(spark, "names")
    characters = sources.write_text(sources.load(spark, sf_dir, "part"), path, "p_name", exclusive=True)
    return sources.read_lines(spark, path).agg(F.lit(characters).cast(L).alias("characters"), F.count("*").alias("lines"), F.count_if(F.length("value") > 9).alias("long_lines"))


@query("SELECT n_name, length(concat(n_name, chr(10)))::BIGINT AS n FROM nation")
def text_whole(spark, sf_dir):
    """A file a nation, each read whole."""
    path = scratch(spark, "nations")
    sources.load(spark, sf_dir, "nation").select("n_name", F.col("n_name").alias("value")).write.partitionBy("n_name").text(path)
    return sources.read_whole(spark, path).select("n_name", F.length("value").cast(L).alias("n"))


# Matrices and regression --------------------------------------------------------------------------------------------
def _coo(spark, sf_dir):
    li = sources.load(spark, sf_dir, "lineitem")
    cells = [(0, "l_quantity"), (1, "l_discount"), (2, "l_tax")]
    one = li.groupBy(F.col("l_suppkey").alias("i")).agg(*[F.round(F.sum(c), 2).alias(c) for _, c in cells])
    return one.select("i", F.explode(F.array(*[F.struct(F.lit(j).cast(L).alias("j"), F.col(c).alias("v")) for j, c in cells])).alias("x")).select("i", "x.*")


COO = "WITH g AS (SELECT l_suppkey AS i, round(sum(l_quantity), 2) AS a, round(sum(l_discount), 2) AS b, round(sum(l_tax), 2) AS c FROM lineitem GROUP BY l_suppkey), m AS (SELECT i, unnest([0, 1, 2])::BIGINT AS j, unnest([a, b, c]) AS v FROM g) "
for _name, _f, _sql in (
    ("transpose", matrix.transpose, "SELECT j AS i, i AS j, v FROM m"),
    ("ata_product", lambda m: matrix.gram(m).withColumn("v", F.round("v", 2)), "SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 2) AS v FROM m x JOIN m y USING (i) GROUP BY x.j, y.j"),
    ("matrix_add", lambda m: matrix.add(m, m), "SELECT i, j, v + v AS v FROM m"),
    ("matrix_subtract", lambda m: matrix.subtract(m, m.filter("j < 2")), "SELECT i, j, CASE WHEN j < 2 THEN v - v ELSE v END AS v FROM m"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(_coo(spark, sf_dir))
    SQL[_name] = COO + _sql


@query("WITH m AS (SELECT vec_id AS i, unnest(range(len(embedding)))::BIGINT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM m x JOIN m y USING (i) GROUP BY x.j, y.j")
def gram_tiled(spark, sf_dir):
    """The vectors' components against each other, tile by tile."""
    cells = sources.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return matrix.gram_tiled(cells).withColumn("v", F.round("v", 4))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS label FROM orders")
def positional_columns(spark, sf_dir):
    """Columns by place: the first three, and one by its number."""
    o = sources.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return sources.by_position(o, slice(0, 3), 3)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linreg_simple(spark, sf_dir):
    x, y = "l_quantity", "l_extendedprice"
    return sources.load(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("WITH m AS (SELECT var_pop(l_quantity) AS c0, covar_pop(l_quantity, l_discount) AS c1, var_pop(l_discount) AS c2, covar_pop(l_quantity, l_extendedprice) AS c3, covar_pop(l_discount, l_extendedprice) AS c4, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT *, (c3 * c2 - c4 * c1) / (c0 * c2 - c1 * c1) AS b1, (c4 * c0 - c3 * c1) / (c0 * c2 - c1 * c1) AS b2 FROM m) SELECT round(b1, 3) AS b1, round(b2, 2) AS b2, round(my - b1 * m1 - b2 * m2, 2) AS intercept FROM b")
def linreg_two_feature(spark, sf_dir):
    b = regression.least_squares(sources.load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return b.select(F.round(F.get("coefficients", F.lit(0)), 3).alias("b1"), F.round(F.get("coefficients", F.lit(1)), 2).alias("b2"), F.round("intercept", 2).alias("intercept"))


def gauss_jordan(table: str, features: list[str], label: str) -> str:
    """SQL of the coefficients ``x1 ..`` and the intercept ``x0``, by elimination on the covariances, one WITH step a column."""
    cols, n = [f"({c})::DOUBLE" for c in [*features, label]], len(features)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    steps = [f"e0 AS (SELECT {', '.join(f'covar_pop({cols[i]}, {cols[j]}) AS a{i}_{j}' for i, j in cells)}, {means} FROM {table})"]
    for p in range(n):
        new = (f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i, j in cells)
        steps.append(f"e{p + 1} AS (SELECT {', '.join(new)}, {', '.join(f'm{i}' for i in range(n + 1))} FROM e{p})")
    intercept = f"m{n} - " + " - ".join(f"a{i}_{n} * m{i}" for i in range(n))
    return ", ".join(steps) + f", model AS (SELECT {intercept} AS x0, {', '.join(f'a{i}_{n} AS x{i + 1}' for i in range(n))} FROM e{n})"


PRICE_OF = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
HELD_OUT = "WITH s AS (SELECT *, ('0x' || left(md5('999:' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 8))::BIGINT < (0.2 * 4294967296)::BIGINT AS is_test FROM lineitem), train AS (FROM s WHERE NOT is_test), " + gauss_jordan("train", PRICE_OF, "l_extendedprice")


def _held_out(spark, sf_dir):
    li = sources.load(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    split = regression.hash_split(li, "id", 0.2, 999)
    return split.filter("is_test"), regression.least_squares(split.filter("NOT is_test"), PRICE_OF, "l_extendedprice")


PREDICTED = "x0 + " + " + ".join(f"x{k + 1} * {c}" for k, c in enumerate(PRICE_OF))


@query(f"{HELD_OUT}, p AS (SELECT l_extendedprice AS y, {PREDICTED} AS f FROM s, model WHERE is_test) SELECT round(1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)), 8) AS r2 FROM p")
def linreg_ml_held_out(spark, sf_dir):
    """Five features: fitted on the training part, R2 on the held-out part."""
    test, model = _held_out(spark, sf_dir)
    return regression.r2(regression.apply_row(test, model, PRICE_OF), "l_extendedprice").select(F.round("r2", 8).alias("r2"))


@query(f"{HELD_OUT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({PREDICTED}, 2) AS prediction FROM s, model WHERE is_test")
def linreg_predictions(spark, sf_dir):
    """What the model says of every held-out row."""
    test, model = _held_out(spark, sf_dir)
    return regression.apply_row(test, model, PRICE_OF).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("prediction", 2).alias("prediction"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('999:' || doc_id::VARCHAR), doc_id) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM documents")
def exact_split(spark, sf_dir):
    return regression.exact_split(sources.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 999)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def embedding_norm(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return sources.load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))
