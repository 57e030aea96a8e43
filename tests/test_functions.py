"""Literal goldens and invariants."""

import hashlib
import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone import sources, streaming
from lodestone.functions import errors as E
from lodestone.functions import nested as N
from lodestone.functions import numbers as M
from lodestone.functions import sequences as S
from lodestone.functions import text as T
from lodestone.operators import hooked, matrix, regression, relational, timed
from lodestone.sources import named


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def goldens():
    return [
        (T.run_lengths(F.lit("aabbccddddddeffff")), "a2b2c2d6e1f4"),
        (T.run_lengths(F.lit("aabcecccaaa")), "a2b1c1e1c3a3"),
        (T.run_lengths(F.lit("")), ""),
        (T.capitalize(F.lit("mandarin Orange")), "Mandarin orange"),
        (T.distinct_words(F.lit("a b a c b")), "a b c"),
        (T.occurrences(F.lit("aaaa"), F.lit("aa")), 2),
        (T.is_anagram(F.lit("listen"), F.lit("silent")), True),
        (T.first_half(F.lit("abcde")), "ab"),
        (T.every_other(F.lit("abcde")), "ace"),
        (T.strip(F.lit("\t a b \n")), "a b"),
        (S.hamming(F.lit("GATTACA"), F.lit("GACTATA")), 2),
        (S.hamming(F.lit("A"), F.lit("AB")), None),
        (S.reverse_complement(F.lit("GATTACA")), "TGTAATC"),
        (S.reverse_complement(F.lit("GAXTACA")), None),
        (S.kmers(F.lit("ATCGA"), 3), ["ATC", "TCG", "CGA"]),
        (S.kmers(F.lit("A"), 3), []),
        (S.motif_starts(F.lit("ATATAT"), F.lit("ATA")), [0, 2]),
        (S.codons(S.transcribe(F.lit("ATGTTTTAAG"))), ["AUG", "UUU", "UAA"]),
        (S.share_of(F.lit("GGCA"), "GC"), 75.0),
        (S.share_of(F.lit(""), "GC"), None),
        (M.binary_digits(F.lit(10)), ["0", "1", "0", "1"]),
        (M.binary_digits(F.lit(0)), []),
        (M.decimal_digits(F.lit(507)), ["5", "0", "7"]),
        (M.fibonacci_terms(F.lit(5)), [1, 1, 2, 3, 5, 8]),
        (M.fibonacci_terms(F.lit(0)), [1]),
        (M.small_factorial(F.lit(10)), 3628800),
        (M.parity(F.lit(-3)), "odd"),
        (M.polynomial(F.lit(2.0), 2, 3, 4), 18.0),
        (N.swap_ends(F.array(*map(F.lit, [12, 35, 9, 56, 24]))), [24, 35, 9, 56, 12]),
        (N.swap_ends(F.array(F.lit(1))), [1]),
        (N.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))), {"a": 2}),
        (N.symmetric_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), [1, 3]),
    ]


def test_goldens(spark):
    for column, want in goldens():
        assert one(spark, column) == want, column


def test_primes(spark):
    got = [r[0] for r in spark.range(0, 200).filter(M.is_prime(F.col("id"))).collect()]
    assert got == [n for n in range(2, 200) if all(n % k for k in range(2, n))]


def test_wide_primes(spark):
    """Strong pseudoprimes to few bases, Carmichael numbers, squares of primes, products of two primes and primes up to 2**63 - 25."""
    primes = [2, 41, 1681 + 12, 2147483647, 3037000493, 3037000507, 4294967291, 999999999989, 1000000000000000003, 9223372036854775783]
    others = [-7, 0, 1, 1681, 2047, 561, 1373653, 25326001, 3215031751, 3474749660383, 341550071728321, 3825123056546413051, 2147483647 * 2147483629, 3037000493**2, 2**62, 9223372036854775807]
    got = {r["n"]: r["p"] for r in spark.createDataFrame([(n,) for n in primes + others], "n long").select("n", M.is_prime(F.col("n")).alias("p")).collect()}
    assert got == dict.fromkeys(primes, True) | dict.fromkeys(others, False)
    assert one(spark, M.is_prime(F.lit(None).cast("long"))) is None


def test_large_factorials(spark):
    ks = [-1, 0, 1, 2, 17, 18, 20, 21, 33, 34, 100, 200, 1000, 9001, None]
    got = {r["k"]: r["f"] for r in spark.createDataFrame([(k,) for k in ks], "k int").select("k", M.factorial_text(F.col("k")).alias("f")).collect()}
    assert got == {k: str(math.factorial(k)) if k is not None and 0 <= k <= 9000 else None for k in ks}
    assert got[21] == "51090942171709440000"
    joined = relational.with_factorial(spark.createDataFrame([(k, k) for k in [*ks, 5, 5]], "k int, factorial_of int"), "k", "f")
    assert {r["k"]: r["f"] for r in joined.collect()} == got | {5: "120"} and joined.count() == len(ks) + 2 and joined.columns == ["k", "factorial_of", "f"]


def test_all_codons(spark):
    assert S.codon_dim(spark).select("codon").distinct().count() == 64


def test_similar_pairs(spark):
    a = spark.createDataFrame([("ACGTTTCA",), ("TTTTTTTT",), ("CCCCGGGG",)], "seq string")
    b = spark.createDataFrame([("AGCTTTGA",), ("GGGGCCCC",), ("AAAAAAAA",)], "seq string")
    for blocks in (False, True):
        assert [tuple(r) for r in relational.similar_pairs(a, b, 4, blocks).collect()] == [("ACGTTTCA", "AGCTTTGA", 5)]


def test_similar_pairs_of_all_lengths(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ACGT"), rng.integers(0, 14))) for _ in range(60)]
    a, b = (spark.createDataFrame([(w,) for w in ws], "seq string") for ws in (words[:30], words[30:]))
    every = {tuple(r) for r in relational.similar_pairs(a, b, 3).collect()}
    got = [tuple(r) for r in relational.similar_pairs(a, b, 3, blocks=True).collect()]
    assert set(got) == every and len(got) == len(every) and any(len(x) != len(y) for x, y, _ in every)


def test_ranked(spark):
    rng = np.random.default_rng(6)
    rows = [(None if x > 45 else int(x), k) for k, x in enumerate(rng.integers(-50, 50, 300))]
    df = spark.createDataFrame(rows, "v int, k int")
    got = relational.ranked(df, [F.col("v").desc_nulls_first(), F.col("k")], "at").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r["v"], r["k"]) for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(1, 301))
    assert relational.ranked(df.limit(0), [F.col("v")], "at").count() == 0


def test_ranges_of_skewed_keys_are_even(spark):
    """A third of the rows has one key, the others crowd near it; columns may have the names in use inside."""
    rng = np.random.default_rng(7)
    prices = np.r_[np.full(4000, 10.0), 10 + rng.exponential(0.01, 8000)]
    df = spark.createDataFrame([(float(p), k) for k, p in enumerate(prices)], "price double, ranked_at int")
    got = relational.ranked(df, [F.col("price")], "pos")
    assert sorted(r["pos"] for r in got.collect()) == list(range(1, 12001))
    files = got.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) <= 2 * 12000 / len(files)
    assert [r["price"] for r in got.orderBy("pos").select("price").collect()] == sorted(prices)


def test_exact_split(spark):
    """As many rows as asked for, the same as by sorting; copies of one row, ids of many rows and null ids among them."""
    ids = [*range(900), *[7] * 600, *[None] * 60]
    df = spark.createDataFrame([(i, k % 100) for k, i in enumerate(ids)], "id int, v int")
    for share in (0.0, 0.013, 0.2, 0.5, 1.0):
        assert regression.exact_split(df, "id", share, 5).filter("is_test").count() == math.ceil(len(ids) * share)
    first = sorted(range(900), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())[:180]
    got = regression.exact_split(spark.range(900), "id", 0.2, 5)
    assert {r["id"] for r in got.filter("is_test").collect()} == set(first) and got.columns == ["id", "is_test"]
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Sort"))
    assert regression.exact_split(spark.range(0), "id", 0.2, 5).count() == 0


def test_matrix(spark):
    a = sources.coo(spark, [[1, 2, 3], [4, 5, 6]])
    assert [r["row"] for r in matrix.rows(matrix.gram(a)).orderBy("i").collect()] == [[17, 22, 27], [22, 29, 36], [27, 36, 45]]
    assert sorted(matrix.transpose(matrix.transpose(a)).collect()) == sorted(a.collect())
    assert {r["v"] for r in matrix.subtract(a, a).collect()} == {0.0}


def test_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    model = regression.fit(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want)
    row = regression.least_squares(df, ["a", "b"], "y").first()
    assert np.allclose([*row["coefficients"], row["intercept"]], want)
    assert regression.r2(regression.predict(model, df, ["a", "b"]), "y").first()[0] > 0.99


def test_least_squares_of_many_features(spark):
    """Against a solver, with nulls, names with dots and clashing ones; dependent columns and no rows have no solution."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 9)) @ rng.normal(size=(9, 9)) + rng.normal(50, 20, 9)
    y = 5 + x @ rng.normal(size=9) + rng.normal(scale=0.5, size=500)
    names = [*(f"f.{k}" for k in range(8)), "intercept"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, y]], ", ".join(f"`{c}` double" for c in [*names, "y"]))
    odd = df.union(df.limit(3).withColumn("f.3", F.lit(None).cast("double"))).union(df.limit(2).withColumn("y", F.lit(float("nan"))))
    model = regression.least_squares(odd, names, "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(500)], y, rcond=None)[0]
    assert np.allclose([*model.first()["coefficients"], model.first()["intercept"]], want, rtol=1e-7)
    said = regression.apply_row(df, model, names)
    assert np.allclose([r["prediction"] for r in said.collect()], np.c_[x, np.ones(500)] @ want) and said.columns == [*df.columns, "prediction"]
    twice = df.withColumn("z", F.col("`f.0`") * 2)
    for bad in (regression.least_squares(twice, [*names, "z"], "y"), regression.least_squares(df.limit(0), names, "y")):
        assert tuple(bad.first()) == (None, None)


def test_scores_file(spark, scores_csv):
    """Both targets of a file of simulated scores, by name and by place (``--scores-csv``; values fixed by the file)."""
    df = sources.read_csv(spark, scores_csv)
    names = df.columns
    want = {
        "disease_score": ([2.000003, 1.799989, 3.500002, 4.000005, 1.000091], 29.999383, 0.9999999999757),
        "disease_score_fluct": ([2.056408, 2.237787, 4.419046, 4.350225, -19.158318], -86.831289, 0.690443714),
    }
    assert df.count() == 60
    for target, (coefficients, intercept, r2) in want.items():
        for data in (sources.features_and_target(df, names[:5], target), sources.by_position(df, slice(0, 5), names.index(target))):
            model = regression.least_squares(data, names[:5], "label")
            row = model.first()
            assert np.allclose(row["coefficients"], coefficients, atol=1e-6) and abs(row["intercept"] - intercept) < 1e-6
            assert abs(regression.r2(regression.apply_row(data, model, names[:5]), "label").first()[0] - r2) < 1e-9


def test_text_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("1",), ("2",), ("x",), ("3",)], "value string")
    assert sources.write_text(df, str(tmp_path / "t")) == 4
    with pytest.raises(Exception, match="(?i)exists"):
        sources.write_text(df, str(tmp_path / "t"), exclusive=True)
    assert sources.read_lines(spark, str(tmp_path / "t")).count() == 4
    out = streaming.odd_squares(streaming.text_stream(spark, str(tmp_path / "t")))
    q = out.writeStream.format("memory").queryName("squares").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("squares").collect()) == [1, 9]


def test_sentinel(spark):
    df = spark.createDataFrame([(1, "a"), (2, "q"), (3, "b")], "pos int, v string")
    assert [r["v"] for r in sources.until_sentinel(df, F.col("pos"), "v", "q").collect()] == ["a"]


def test_csv_by_name_with_two_targets(spark, tmp_path):
    """A table with a declared schema; features by name and by place; a fit of each of its two targets."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(20, 80, 60), rng.normal(22, 3, 60), rng.normal(80, 5, 60), rng.normal(90, 4, 60), rng.integers(0, 2, 60)]
    clean = 30 + x @ [2, 1.8, 3.5, 4, 1]
    noisy = clean + rng.normal(0, 20, 60)
    names = ["age", "bmi", "bp", "sugar", "sex", "score", "score_noisy"]
    path = tmp_path / "scores.csv"
    path.write_text("\n".join([",".join(names), *(",".join(map(repr, map(float, r))) for r in np.c_[x, clean, noisy])]))
    df = sources.read_csv(spark, str(path), ", ".join(f"{c} double" for c in names))
    assert df.dtypes == [(c, "double") for c in names] and df.count() == 60
    design = np.c_[x, np.ones(60)]
    for target, y in (("score", clean), ("score_noisy", noisy)):
        named = sources.features_and_target(df, names[:5], target)
        assert sorted(map(tuple, named.collect())) == sorted(map(tuple, sources.by_position(df, slice(0, 5), names.index(target)).collect()))
        model = regression.fit(named, names[:5], "label")
        want = np.linalg.lstsq(design, y, rcond=None)[0]
        assert np.allclose([*model.coefficients, model.intercept], want, rtol=1e-6, atol=1e-6)
        r2 = 1 - ((y - design @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert abs(regression.r2(regression.predict(model, named, names[:5]), "label").first()[0] - r2) < 1e-9


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r["value"] for r in sources.read_whole(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo\n"]


def test_maps_from_pairs(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert one(spark, N.map_from_pairs(pairs)) == {"a": 3, "b": 2}
    assert one(spark, N.map_from_two_characters(F.array(F.lit("ab"), F.lit("cd")))) == {"a": "b", "c": "d"}
    assert one(spark, N.map_where(F.sequence(F.lit(1), F.lit(10)), lambda x: x % 2 == 0, lambda x: x * x)) == {k: k * k for k in range(2, 11, 2)}
    assert [one(spark, N.truth(x)) for x in (F.array(), F.array(F.lit(0)), F.lit(None).cast("array<int>"))] == [False, True, False]


def test_timed(spark):
    told = []
    assert timed(lambda a, b=1: a + b, lambda *x: told.append(x))(2, b=3) == 5 and told[0][::2] == ("<lambda>", None) and told[0][1] >= 0
    slow = F.udf(lambda x: time.sleep(0.05) or x, "long")
    df = timed(lambda: spark.range(20, numPartitions=1).select(slow("id")), lambda *x: told.append(x))()
    assert told[1][2] == 20 and told[1][1] >= 1  # the rows are made, not only planned
    assert df.count() == 20


def test_hooked():
    seen = []
    assert hooked(max, lambda name: seen.append(name), lambda name, out: seen.append((name, out)))(3, 4) == 4 and seen == ["max", ("max", 4)]


def test_characters_are_counted_by_the_write(spark, tmp_path):
    """Of a column that differs every time it is made, the count fits what was written; a null is an empty line."""
    df = spark.range(200).select(F.repeat(F.lit("é"), (F.rand() * 20).cast("int")).alias("a.b"))
    n = sources.write_text(df, str(tmp_path / "t"), "a.b")
    assert n == sources.read_lines(spark, str(tmp_path / "t")).agg(F.sum(F.length("value"))).first()[0]
    assert sources.write_text(spark.createDataFrame([("ab",), (None,)], "value string"), str(tmp_path / "u")) == 2 and sources.read_lines(spark, str(tmp_path / "u")).count() == 2
    assert sources.write_text(df.limit(0), str(tmp_path / "v"), "a.b") == 0


def test_failures_are_told_apart(spark):
    given = {"12": 12, " -7\n": -7, "+0": 0, None: "MISSING", "": "EMPTY", " \t": "EMPTY", "1.5": "FRACTION", "1e3": "FRACTION", ".5": "FRACTION", "1.": "FRACTION", "x": "NOT_A_NUMBER", "1 2": "NOT_A_NUMBER", "--1": "NOT_A_NUMBER", ".": "NOT_A_NUMBER", "9223372036854775807": 2**63 - 1, "9223372036854775808": "OUT_OF_RANGE"}
    df = spark.createDataFrame([(k,) for k in given], "t string").withColumn("n", E.whole_number(F.col("t")))
    good, bad = E.parted(df, "n")
    assert {r["t"]: r["n"] for r in good.collect()} == {k: v for k, v in given.items() if not isinstance(v, str)}
    assert {r["error_input"]: r["error_class"] for r in bad.collect()} == {k: v for k, v in given.items() if isinstance(v, str)} and bad.columns == ["t", "error_class", "error_input"]
    small = E.whole_number(F.lit("300"), "tinyint")
    assert one(spark, small["error"]["class"]) == "OUT_OF_RANGE" and one(spark, E.whole_number(F.lit("30"), "tinyint")["value"]) == 30
    a = F.array(F.lit(5), F.lit(6))
    assert [one(spark, E.element(a, F.lit(i))["value"]) for i in (0, 1, -1, -2, 2, -3)] == [5, 6, 6, 5, None, None]
    assert [one(spark, E.element(a, F.lit(i))["error"]) for i in (1, -2)] == [None, None] and tuple(one(spark, E.element(a, F.lit(-3))["error"])) == ("INDEX", "-3")
    assert one(spark, E.element(a, F.lit(None).cast("int"))["error"]["class"]) == "MISSING"


@pytest.mark.parametrize("block,fan_in", [(2**20, 64), (900, 2)])
def test_tiled_product(spark, monkeypatch, block, fan_in):
    """A sparse matrix wider than two tiles with columns that never meet, as the rows' pairs give it; blocks of few rows added two by two."""
    monkeypatch.setattr(matrix, "BLOCK_CELLS", block)
    monkeypatch.setattr(matrix, "FAN_IN", fan_in)
    rng = np.random.default_rng(11)
    cells = {(int(i), int(j)): float(v) for i, j, v in zip(rng.integers(0, 40, 500), rng.integers(0, 300, 500), rng.integers(-9, 9, 500), strict=True)}
    a = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "i long, j int, v double")
    got, want = ({(r["i"], r["j"]): r["v"] for r in f(a).collect()} for f in (matrix.gram_tiled, matrix.gram))
    assert got == want and len(want) > 5000
    assert matrix.gram_tiled(a.limit(0)).count() == 0


def test_rows_of_similar_pairs_grow_with_the_text(spark):
    """A row a character and some more, however many lengths there are; the old form wrote half the square."""
    for t in (0, 4, 50):
        sizes = {r["n"]: r["rows"] for r in relational._grams(spark.range(1, 1200, 7).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("seq")), t).groupBy("n").agg(F.count("*").alias("rows")).collect()}
        assert all(rows <= n - t + t * (1 + math.log(t + 1)) for n, rows in sizes.items()) and min(sizes) == t + 1 + (-t) % 7


def test_similar_pairs_of_long_and_short_texts(spark):
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("AC"), 40))
    words = {base[: rng.integers(1, 40)] + "".join(rng.choice(list("ACé"), rng.integers(0, 12))) for _ in range(80)} | {"", "A"}
    df = spark.createDataFrame([(w,) for w in words for _ in range(2)], "seq string")
    same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=False))
    for t in (0, 3, 9, 17):
        got = [tuple(r) for r in relational.similar_pairs(df, df, t, blocks=True).collect()]
        want = {(x, y, same(x, y)) for x in words for y in words if same(x, y) > t}
        assert set(got) == want and len(got) == len(want) > 40


def test_hamming_says_why(spark):
    cases = {("GATTACA", "GACTATA"): (2, "ok"), ("A", "AB"): (None, "lengths differ"), ("", ""): (0, "ok"), (None, "A"): (None, "a text is missing"), ("né", "nè"): (1, "ok")}
    df = spark.createDataFrame(list(cases), "a string, b string")
    got = df.select("a", "b", S.hamming(F.col("a"), F.col("b")).alias("d"), S.hamming_status(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r["a"], r["b"]): (r["d"], r["s"]) for r in got} == cases


def test_named_sets(spark, tmp_path):
    """Two files with two row groups each; the fit by name of a set made up for it, and only the columns asked for."""
    rng = np.random.default_rng(13)
    named.register(spark)
    for name in named.SETS:
        columns = named.features(name)
        x = rng.normal(size=(400, len(columns)))
        y = 1 + x @ np.arange(1, len(columns) + 1) + rng.normal(scale=0.1, size=400)
        held = pa.table({"extra": ["x"] * 400} | {c: x[:, k] for k, c in enumerate(columns)} | {named.target(name): y})
        for k in range(2):
            pq.write_table(held.slice(200 * k, 200), tmp_path / f"{name}-{k}.parquet", row_group_size=100)
        df = spark.read.format("named").option("name", name).load(str(tmp_path))
        assert df.columns == [*columns, named.target(name)] and df.count() == 400 and df.rdd.getNumPartitions() == 4
        model = regression.least_squares(df, columns, named.target(name)).first()
        want = np.linalg.lstsq(np.c_[x, np.ones(400)], y, rcond=None)[0]
        assert np.allclose([*model["coefficients"], model["intercept"]], want)
        few = spark.read.format("named").option("name", name).option("columns", f"{columns[2]}, {columns[0]}").load(str(tmp_path))
        assert few.columns == [columns[2], columns[0]] and few.agg(F.sum(columns[0])).first()[0] == pytest.approx(x[:, 0].sum())
    for options, what in (({"name": "iris"}, "no set"), ({"name": "housing", "columns": "age"}, "no column")):
        with pytest.raises(Exception, match=what):
            spark.read.format("named").options(**options).load(str(tmp_path)).count()


def test_character_counts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("aab\n")
    q = streaming.character_counts(streaming.text_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("chars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("chars").collect()} == {("a", 2), ("b", 1)}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("age,score\n1,2.5\n")
    assert sources.read_csv(spark, str(tmp_path / "a.csv")).dtypes == [("age", "int"), ("score", "double")]
