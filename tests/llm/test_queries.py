"""Every registered query and every pipeline stage on a small folder, against brute force or its SQL."""

import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from test_operators import brute_leaks, brute_quality, check_removals, junk, prose

import corpus_pipeline
from lodestone.llm import queries, url_filters


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, out = random.Random(21), tmp_path_factory.mktemp("small")
    items = [(k, prose(rnd, rnd.randint(8, 25)) + ". " + prose(rnd, rnd.randint(2, 8))) for k in range(10)]
    texts = ["\n".join(prose(rnd, rnd.randint(4, 60)) + "." for _ in range(rnd.randint(1, 5))) for _ in range(50)]
    for k in range(12):  # copies with up to four words changed
        w = texts[k].split(" ")
        for _ in range(k % 5):
            w[rnd.randrange(len(w))] = rnd.choice(("changed", "altered"))
        texts.append(" ".join(w))
    texts += [junk(rnd) for _ in range(8)] + [prose(rnd, 40) + " " + items[k][1] + " " + prose(rnd, 20) for k in range(4)]
    texts += [texts[0], texts[1], None, "", "  \n\t", "a", "word " * 3000]
    documents = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": [(None, "b", "a", "c")[k % 4] for k in range(len(texts))], "n_chars": [len(t or "") for t in texts]}
    urls = [None, "no scheme", "http://A.Example.org/es/1?x", "https://example.org/en/12", "http://x.com/de/1", "a://b.example.org#/"] + [f"http://www{k % 7}.example.{('org', 'com', 'net')[k % 3]}/{('en', 'fr', 'de', 'es')[k % 4]}/{k}" for k in range(120)]
    pages = {"page_id": [None, *range(len(urls) - 1)], "url": urls, "html": [None if k % 9 == 0 else f"<p>{'x' * k}" for k in range(len(urls))]}
    labels = {"doc_id": list(range(60)), "quality": [int(k % 3 > 0) for k in range(60)], "toxic": [int(k % 11 == 0) for k in range(60)]}
    vectors = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(150)]
    vectors += [[x + rnd.gauss(0, 0.05) for x in v] for v in vectors[:30]] + [vectors[7]] * 5 + [None, [], [0.0] * 64, [1.0] * 63, [None] + [1.0] * 63]
    embeddings = {"vec_id": list(range(len(vectors))), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [k % 3 for k in range(len(vectors))]}
    for name, t in (("embeddings", embeddings), ("documents", documents), ("pages", pages), ("labels", labels), ("benchmark", {"item_id": [i for i, _ in items], "text": [t for _, t in items]})):
        pq.write_table(pa.table(t), out / f"{name}.parquet")
    return str(out), texts, items


def run(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder[0]).collect()]


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op1_quality_rules")}
    for k, (f, failed, p) in enumerate(brute_quality(folder[1])):
        r = got[k]
        assert {c: r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {c: f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert (r["base_failed"], r["kept"]) == (failed, not failed and p >= 0.5) and r["p_good"] == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    got = run(spark, folder, name)
    names = want.column_names
    assert sorted(repr([r[c] for c in names]) for r in got) == sorted(repr([r[c] for c in names]) for r in want.to_pylist()) and set(got[0]) == set(names)


def test_op3(spark, folder):
    df = queries.op3_suffix_array_dedup(spark, folder[0])
    check_removals(spark.read.parquet(folder[0] + "/documents.parquet"), [(k, (t or "").encode()) for k, t in enumerate(folder[1])])
    assert df.count() == len(folder[1])


def test_op4(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in run(spark, folder, "op4_token_counts"):
        t = folder[1][r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


def test_op5(spark, folder):
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, folder, "op5_decontamination")} == brute_leaks(folder[1], folder[2]) >= {(70 + k, k) for k in range(4)}


def least_linked(n, linked):
    """Of every node the least one that links lead to."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(n)]


def test_op6(spark, folder):
    def print_of(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [print_of(t) for t in folder[1]]
    least = least_linked(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op6_simhash")} == {k: (f"{x:016x}", least[k]) for k, x in enumerate(fp)}


def test_op8(spark, folder):
    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        return host, rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]

    urls = pq.read_table(folder[0] + "/pages.parquet").to_pylist()
    got = run(spark, folder, "op8_url_filters")
    assert len(got) == len(urls)
    by_id = {r["page_id"]: r for r in got}
    for u in urls:
        r, (host, path) = by_id[u["page_id"]], parts(u["url"])
        fit = [(len(x), x, v) for v, x in url_filters.RULES for h, p in [x.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(fit)[1:] if fit else (None, "block" if r["block_probability"] >= 0.5 else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def later_matches(texts):
    """Document, line of every line that an earlier one resembles."""
    lines = [(k, i, frozenset(x.encode().split())) for k, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(k, i) for n, (k, i, w) in enumerate(lines) if any(5 * len(w & v) >= 4 * len(w | v) for _, _, v in lines[:n])}


def test_op9(spark, folder):
    got = run(spark, folder, "op9_line_dedup")
    assert {(r["doc_id"], i) for r in got for i in r["removed"]} == later_matches(folder[1]) and len(got) == len(folder[1])


def test_op10(spark, folder):
    got = run(spark, folder, "op10_katz_scores")
    assert sorted(r["doc_id"] for r in got) == list(range(len(folder[1])))
    assert all(r["n_tokens"] == len((folder[1][r["doc_id"]] or "").encode().split()) + 1 and r["score"] < 0 for r in got)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_pipeline(spark, folder, tmp_path):
    """Each stage on what the one before it left, in the order of the rows written."""
    docs, seen = spark.read.parquet(folder[0] + "/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder[0])
        if name != "mix":
            assert out.dtypes == docs.dtypes
        out.coalesce(1).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        ids, texts = [r[0] for r in before], [r[1] for r in before]
        kept = dict(zip(ids, texts, strict=True))
        if name == "quality":
            kept = {i: t for i, t, (_, failed, p) in zip(ids, texts, brute_quality(texts), strict=True) if not failed and p >= 0.5}
        elif name == "lines":
            gone = defaultdict(set)
            for k, i in later_matches(texts):
                gone[k].add(i)
            rest = {k: [x for i, x in enumerate(t.split("\n")) if i not in gone[k]] for k, t in enumerate(texts)}
            kept = {ids[k]: "\n".join(rest[k]) for k, t in enumerate(texts) if not gone[k] or any(x.split() for x in rest[k])}
        elif name == "near_copies":
            sets = list(map(shingle_set, texts))
            least = least_linked(len(texts), lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4)
            kept = {ids[k]: texts[k] for k in set(least)}
        elif name == "leaks":
            bad = {d for d, _ in brute_leaks(texts, folder[2])}
            kept = {i: t for k, (i, t) in enumerate(zip(ids, texts, strict=True)) if k not in bad}
        else:
            times = Counter(r["doc_id"] for r in docs.collect())
            assert set(times) <= set(ids) and max(times.values()) <= 2
            assert all(r["size"] == len(r["text"].encode().split()) and r["target"] <= 2 * r["source_size"] + 1e-6 for r in docs.collect())
            continue
        assert after == kept, name
        seen[name] = (len(before), len(after))
    assert all(a > b for k, (a, b) in seen.items() if k != "near_copies"), seen


@pytest.fixture(scope="module")
def long_folder(tmp_path_factory):
    """A text of over a megabyte, one like it but for a word, and one that is a line of one word, many times."""
    rnd, out = random.Random(31), tmp_path_factory.mktemp("long")
    item = "which of these words did nobody say before today? " + " ".join(f"rare{k}" for k in range(12)) + "."
    words = [rnd.choice(("alpha", "beta", "gamma", "delta")) + str(rnd.randrange(4000)) for _ in range(120_000)]
    text = "\n".join(" ".join(words[k : k + 40]) for k in range(0, len(words), 40)) + "\n" + item
    texts = [text, text.replace(words[70_000], "changed", 1), "again " * 200_000]
    pq.write_table(pa.table({"doc_id": [0, 1, 2], "text": texts, "lang": ["en"] * 3, "source": ["a", "b", "a"], "n_chars": list(map(len, texts))}), out / "documents.parquet")
    pq.write_table(pa.table({"item_id": [5], "text": [item]}), out / "benchmark.parquet")
    return str(out), texts, words


def test_very_long_texts(spark, long_folder):
    _, texts, words = long_folder
    sizes = [len(t.split()) for t in texts]
    quality = {r["doc_id"]: r for r in run(spark, long_folder, "op1_quality_rules")}
    assert [quality[k]["n_words"] for k in range(3)] == sizes and [quality[k]["base_failed"] for k in range(3)] == [False, False, True]
    assert [r["size"] for r in sorted(run(spark, long_folder, "op2_mixing"), key=lambda r: r["doc_id"])] == sizes
    removed = {r["doc_id"]: r["n_removed"] for r in run(spark, long_folder, "op3_suffix_array_dedup")}
    at = texts[0].index(words[70_000])
    assert removed[2] == len(texts[2]) and len(texts[0]) - removed[0] <= len(words[70_000]) and at > 0
    assert [(r["doc_id"], r["item_id"]) for r in sorted(run(spark, long_folder, "op5_decontamination"), key=lambda r: r["doc_id"])] == [(0, 5), (1, 5)]
    assert {r["doc_id"]: r["component_id"] for r in run(spark, long_folder, "op6_simhash")} == {0: 0, 1: 0, 2: 2}
    lines = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in run(spark, long_folder, "op9_line_dedup")}
    assert lines == {0: (3001, 0), 1: (3001, 3001), 2: (1, 0)}
    assert {r["doc_id"]: r["n_tokens"] for r in run(spark, long_folder, "op10_katz_scores")} == {k: n + 1 for k, n in enumerate(sizes)}
    docs = spark.read.parquet(long_folder[0] + "/documents.parquet")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, long_folder[0]).collect()] == [0, 2]


def test_very_long_texts_are_tokenized_like_the_library(spark, long_folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in run(spark, long_folder, "op4_token_counts")}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(long_folder[1])}


def test_pipeline_with_odd_columns_and_without_rows(spark, folder, tmp_path):
    """Columns with dots and with names of results, null and repeated ids, null texts; and no documents at all."""
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    odd = docs.selectExpr("CASE WHEN doc_id % 7 > 0 THEN doc_id % 20 END AS doc_id", "text", "lang", "source", "n_chars", "doc_id AS `a.b`", "1 AS size", "2 AS copies", "'x' AS shingles", "3 AS line_row", "4 AS Target")
    for name, start in (("odd", odd), ("none", odd.limit(0))):
        now = start
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, now, folder[0])
            out.write.parquet(str(tmp_path / name / stage))
            out = spark.read.parquet(str(tmp_path / name / stage))
            assert out.columns[: len(odd.columns)] == odd.columns and (stage == "mix" or out.columns == odd.columns)
            assert (out.count() > 0) == (name == "odd")
            now = out
        assert now.filter("`a.b` IS NULL OR size <> 1 OR copies <> 2").count() == 0


def test_queries_of_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    pytest.importorskip("public_tokenizers")
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_results_of_two_runs_last(spark, folder):
    """A run, and a stage called by itself, leave the results of others alone."""
    one = corpus_pipeline.run(spark, folder[0])
    n = one.count()
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    direct = stages["lines"](spark, stages["quality"](spark, docs, folder[0]), folder[0])
    two = corpus_pipeline.run(spark, folder[0])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == n > 0
    assert direct.count() > 0
