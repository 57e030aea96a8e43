"""Operators against brute force on small tables with nulls, empty and repeated rows, and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontamination, induced, katz, line_dedup, mixing, near_copies, quality_rules, simhash, suffix_dedup, token_counts, url_filters, warc
from lodestone.llm.store import Scope, Stored

WORDS = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if".split()
EXTRA = "size string, copies int, line_row int, quality_votes int"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", rnd.choice(WORDS), "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    out = ["\n".join(prose(rnd, rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    out += [out[3], out[3] + "\n" + prose(rnd, 9), out[5].replace("the", "The", 1), None, "", " \n\t ", "word", "é " * 300, "\n".join([out[7].split("\n")[0]] * 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, [None, "b", "a", "c"][k % 4], "x", k, None, 1) for k, t in enumerate(texts)] + [(None, "null id", "a", "x", 1, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + EXTRA).repartition(3).cache()


def empty(docs):
    return docs.limit(0)


def brute_features(t):
    w = [x.decode() for x in (t or "").encode().split()]
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    repeated = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
    lines, t = [x for x in (t or "").split("\n") if x.encode().split()], t or ""
    count = lambda chars: sum(map(t.count, chars))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": count("#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_distinct": len(set(w)), "n_upper": count(letters.upper()), "n_letters": count(letters.upper() + letters), "n_exclaims": count("!"), "n_stops": count(".!?"),
    }


def brute_votes(f):
    said = lambda c: eval(c.replace("AND", "and").replace("OR", "or"), {}, f)
    return sum(3**k * (quality_rules.BAD if said(bad) else quality_rules.GOOD if said(good) else quality_rules.ABSTAIN) for k, (_, bad, good) in enumerate(quality_rules.RULES))


def brute_quality(texts):
    """Of every text: its features, whether the base check fails it, its posterior of "good"."""
    found = [brute_features(t) for t in texts]
    patterns = list(map(brute_votes, found))
    model = quality_rules.expectation_maximisation(Counter(patterns))
    return [(f, f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"], model.posterior(p)) for f, p in zip(found, patterns, strict=True)]


def junk(rnd):
    kind, n = rnd.randrange(4), rnd.randint(25, 90)
    w = [rnd.choice(WORDS) for _ in range(n)]
    return (" | ".join(w), " ".join(x + "$$$" for x in w), "BUY NOW!!! " * n, " ".join([w[0]] * n) + ".")[kind]


def test_quality_of_every_column(spark, texts):
    rnd = random.Random(2)
    first = len(texts)
    texts = texts + [prose(rnd, 60) + "." for _ in range(300)] + [prose(rnd, 40) + "." for _ in range(20)] + [junk(rnd) for _ in range(40)] + ["x # y " * 9 + prose(rnd, 400) + "."]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, quality_votes int, `a.b` string")
    want = brute_quality(texts)
    got = {r["doc_id"]: r for r in quality_rules.features(df, "text", "f").collect()}
    assert [{n: got[k][f"f_{n}"] for n in quality_rules.NAMES} for k in range(len(texts))] == [f for f, _, _ in want]
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, failed, p) in enumerate(want) if not failed and p >= 0.5}
    good = {k for k in range(first, len(texts)) if want[k][2] >= 0.5}
    assert good == set(range(first, first + 320))  # prose stays, junk goes
    flagged = {k for k in range(len(texts)) if quality_rules.BAD in quality_rules.votes_of(brute_votes(want[k][0]))}
    assert set(range(first + 300, first + 320)) <= flagged & good  # a lone flag is outvoted
    assert quality_rules.keep(empty(df)).count() == 0


def test_label_model_learns_what_rules_are_worth():
    """Votes made with known error rates: rules that agree are believed, one that guesses is not, and lone flags are outvoted."""
    rnd, m = random.Random(1), len(quality_rules.RULES)
    rates = [(0.7, 0.01)] * (m - 1) + [(0.1, 0.1)]  # bad votes on bad and on good documents; the last rule knows nothing
    counts, truth = Counter(), {}
    for _ in range(20000):
        good = rnd.random() < 0.8
        p = sum(3**k * (quality_rules.ABSTAIN if rnd.random() < 0.1 else quality_rules.BAD if rnd.random() < r[good] else quality_rules.GOOD) for k, r in enumerate(rates))
        counts[p] += 1
        truth.setdefault(p, Counter())[good] += 1
    model = quality_rules.expectation_maximisation(counts)
    assert abs(model.good - 0.8) < 0.02
    worth = [model.accuracies()[name][0] for name, _, _ in quality_rules.RULES]
    assert min(worth[:-1]) > 0.9 and worth[-1] < 0.35
    right = sum(n for p, c in truth.items() for good, n in c.items() if (model.posterior(p) >= 0.5) == good)
    assert right > 0.98 * 20000
    all_good = sum(2 * 3**k for k in range(m))
    assert model.posterior(all_good - 2) > 0.5 > model.posterior(all_good - 2 - 6 - 18 - 54)


def test_label_model_rejects_without_a_flag_and_keeps_with_one():
    """Abstentions that only bad documents have tell against a document without a flag; a rule that errs does not reject alone."""
    all_good = sum(2 * 3**k for k in range(len(quality_rules.RULES)))
    counts = {all_good: 8000, all_good - 2 * 3**10: 700, all_good - 1: 2}
    for flags in combinations(range(1, 7), 3):
        counts[all_good - 1 - sum(2 * 3**k for k in flags)] = 30
    model = quality_rules.expectation_maximisation(counts)
    assert model.apart() and model.posterior(all_good - 1) < 0.5 < model.posterior(all_good - 2 * 3**10)
    assert all(model.posterior(p) < 0.01 for p, n in counts.items() if n == 30)


def test_label_model_leaves_a_clean_corpus_alone():
    all_good = sum(2 * 3**k for k in range(len(quality_rules.RULES)))
    counts = {all_good: 80000, all_good - 9 - 27: 3000, all_good - 3**10: 2000, all_good - 2 * 3**10: 1500}
    model = quality_rules.expectation_maximisation(counts)
    assert all(model.posterior(p) > 0.5 for p in counts)


def test_mixing(docs):
    a, b = (sorted(map(str, mixing.mix(docs.drop("size", "copies")).collect())) for _ in range(2))
    assert a == b
    rows = mixing.mix(docs.drop("size", "copies")).collect()
    per = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    total = sum(s for s, _ in per.values())
    assert abs(sum(t for _, t in per.values()) - min(1.5 * total, 2 * total)) < 1e-6
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    levels = {round(t / weight[s], 6) for s, (size, t) in per.items() if t < 2 * size - 1e-9}
    assert len(levels) <= 1 and all(r["copies"] in (0, 1, 2) for r in rows)
    with pytest.raises(ValueError, match="copies, size"):
        mixing.mix(docs)
    names = mixing.plan_names(docs)
    out = mixing.emit(mixing.mix(docs, out=names), names[3])
    assert out.columns[: len(docs.columns)] == docs.columns and mixing.mix(empty(docs), out=names).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for k in range(150):
        x, cap = rng.integers(0, 3, rng.integers(0, 50)), (255, 4)[k % 2]
        x = np.tile(x[:5], 7) if k % 3 == 0 else x
        x = (x.astype(np.int32) * 200 + rng.integers(0, 2, len(x))) if k % 5 == 0 else x.astype(np.uint8)
        order, common = induced.sort_suffixes(x, 601, cap)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        for a, b, c in zip(order[:-1], order[1:], common[1:], strict=True):
            n = next((i for i in range(len(x) - max(a, b)) if x[a + i] != x[b + i]), len(x) - max(a, b))
            assert c == min(n, cap)


def test_suffix_array_with_tables_on_disk(monkeypatch, tmp_path):
    monkeypatch.setattr(induced, "MEMORY", 4)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    test_suffix_array()


def check_removals(df, data):
    seen = Counter()
    for _, b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        want.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(repr, map(tuple, suffix_dedup.removals(df).collect()))) == sorted(map(repr, want))


def test_repeated_bytes(docs, texts):
    check_removals(docs, [*((k, (t or "").encode()) for k, t in enumerate(texts)), (None, b"null id")])
    assert suffix_dedup.removals(empty(docs)).count() == 0


def test_marks_of_long_texts_read_in_parts(monkeypatch):
    """Every stretch has the same mark, whether texts are read together, alone or in segments."""
    rnd = random.Random(6)
    texts = [prose(rnd, n).encode() for n in (3, 60, 200, 90)] + [b"ab" * 300, b"a" * 450, b"z" * 199, b"z" * 200]

    def of_stretches(groups):
        out = {}
        for base, group in groups:
            for t, i, j, h in zip(*suffix_dedup.marks(group), strict=True):
                out.update({(base + int(t), k): int(h) for k in range(i, j + 1)})
        return out

    together = of_stretches([(0, texts)])
    assert set(together) == {(t, k) for t, x in enumerate(texts) for k in range(len(x) - 199)}
    assert of_stretches(((t, [x]) for t, x in enumerate(texts))) == together
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 70)
    assert of_stretches(((t, [x]) for t, x in enumerate(texts))) == together


@pytest.mark.parametrize("split", [512, 3])
def test_repeated_bytes_around_a_common_passage(spark, monkeypatch, split):
    """Passages of many lengths in many texts, with all sorts of surroundings; with few pieces a mark stretches are dealt by content."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rnd = random.Random(6)
    passage, rows = prose(rnd, 90), []
    for _ in range(60):
        a = rnd.randrange(60)
        rows.append(prose(rnd, rnd.randint(0, 40)) + passage[a : a + rnd.randint(150, 320)] + prose(rnd, rnd.randint(0, 40)))
    rows += ["a" * 1500, "ab" * 700, "abcdefghij" * 90 + "x" + "abcdefghij" * 70, rows[0], "a" * 199, "b" * 200]
    check_removals(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), list(enumerate(x.encode() for x in rows)))


def test_repeated_bytes_of_a_common_passage_make_few_rows(spark, monkeypatch):
    """Pieces of a mark that has too many are not dealt stretch by stretch."""
    made = {}

    class Counted(Stored):
        def __init__(self, df, name, key=None):
            super().__init__(df, name, key)
            made[name] = max(made.get(name, 0), self.df.count())

    monkeypatch.setattr(suffix_dedup, "Stored", Counted)
    monkeypatch.setattr(suffix_dedup, "SPLIT", 20)
    rnd = random.Random(8)
    passage = prose(rnd, 70)[:250]
    rows = [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(80)]
    check_removals(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), list(enumerate(x.encode() for x in rows)))
    pieces = made["suffix-different"]
    assert pieces > 80 and max(made.values()) <= 8 * pieces  # stretches: over 30 times as many


def test_repeated_bytes_of_very_long_texts(spark):
    """Megabytes of one letter and of a short period: one piece each, however long."""
    rows = [(0, "a" * 3_000_000), (1, "abcdefghij" * 300_000), (2, "unlike the others " * 3)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (3_000_000, 1), 1: (3_000_000, 1), 2: (0, 0)}


def test_token_counts(docs, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    with open(path) as f:
        count = token_counts.Counter(f.read())
    reference = Tokenizer.from_file(path)
    rnd = random.Random(1)
    odd = ["".join(rnd.choice(" \n\t'sdtABC12½٣éß中😀<|>!?._\u3000\x85\x1c") for _ in range(rnd.randint(0, 50))) for _ in range(800)] + ["a<|endoftext|> b", " " * 50, "ab" * 400]
    want = [len(x.ids) for x in reference.encode_batch(odd, add_special_tokens=False)]
    assert [count.tokens(t) for t in odd] == want
    old = token_counts.CHUNK
    try:
        for token_counts.CHUNK in (1, 3, 17):
            assert [count.tokens(t) for t in odd] == want
    finally:
        token_counts.CHUNK = old
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    assert got == {k: len(reference.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)} | {None: len(reference.encode("null id").ids)}


@pytest.mark.parametrize("chunk", [7, 40])
def test_token_counts_of_long_texts_in_chunks(spark, monkeypatch, chunk):
    """Chunks counted by different tasks and put together, with repeated and null ids and special tokens on the cuts."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    path, rnd = P.path("byte_bpe_50k.json"), random.Random(11)
    texts = [None, "", "short"] + ["".join(rnd.choice(" \n\t'sdtABC12½é中😀<|>!?._ the of") for _ in range(rnd.randint(0, 400))) for _ in range(60)] + ["ab" * 300, " " * 300, "x " * 200 + "<|endoftext|>" + " y" * 90]
    df = spark.createDataFrame([(None if k % 9 == 0 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    library = Tokenizer.from_file(path)
    want = Counter((None if k % 9 == 0 else k // 2, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts))
    assert Counter(tuple(r)[:3] for r in token_counts.token_counts(df, path).collect()) == want


def test_token_counts_of_ids_named_like_a_result(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("a b",)], "text string")
    out = token_counts.token_counts(df, P.path("byte_bpe_50k.json"), id_col="text")
    assert [tuple(r) for r in out.collect()] == [("a b", 3, 2, False)]
    with pytest.raises(ValueError, match="rename"):
        token_counts.token_counts(df.withColumn("n_bytes", F.lit(1)), P.path("byte_bpe_50k.json"), id_col="n_bytes")


def test_decontamination(spark, docs, texts):
    rnd = random.Random(9)
    items = [(k, prose(rnd, 30) + ". " + prose(rnd, 8)) for k in range(30)] + [(30, None), (31, "")]
    index = decontamination.Index([(i, t) for i, t in items if t])
    for _ in range(60):
        terms = sorted(rnd.sample(range(len(index.terms)), min(40, len(index.terms))))
        score = np.zeros(len(index.items))
        for t in terms:
            for j, x in zip(index.docs[t], index.impacts[t], strict=True):
                score[j] += x
        assert {j for j, _ in index.retrieve(terms)} == set(np.flatnonzero(score >= index.threshold - 1e-12).tolist())
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = docs.withColumn("text", F.when(F.col("doc_id") == 4, F.concat("text", F.lit(" " + items[11][1]))).otherwise(F.col("text")))
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.leaked_passages(planted, bench).collect()] == [(4, 11)]
    assert decontamination.drop_leaked(planted, bench).count() == docs.count() - 1
    assert decontamination.leaked_passages(empty(docs), bench).count() == 0 and decontamination.drop_leaked(docs, empty(bench)).count() == docs.count()


def brute_leaks(texts, items):
    """Every pair of a text and an item by the definition: a passage of the text scores enough and passes the checks."""
    D = decontamination
    index = D.Index(items)
    held, n = [D.bare(D.words(t)) for _, t in items], len(items)
    df = Counter(x for w in held for x in set(w))
    mean = sum(map(len, held)) / n
    idf = {x: np.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    out = set()
    for d, t in enumerate(texts):
        w = D.bare(D.words(t))
        for s in index.windows(len(w)):
            part = w[s : s + index.window]
            for (i, text), item in zip(items, held, strict=True):
                c = Counter(item)
                raw = {x: idf[x] * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(item) / mean)) for x, f in c.items()}
                if sum(v for x, v in raw.items() if x in part) < D.THRESHOLD * sum(raw.values()) - 1e-9:
                    continue
                grams = lambda v, k: {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
                share = lambda v: np.mean([x in grams(part, len(x)) for x in D.shingles(v)]) if v else 1.0
                question, answer = map(D.bare, D.parts(D.words(text)))
                near = any(part[j : j + len(e)] == e for e in one_edit(item, part) for j in range(len(part))) if len(item) >= D.SHINGLE else False
                if min(share(question), share(answer)) >= D.OVERLAP or share(item) >= D.WHOLE or near:
                    out.add((d, i))
    return out


def one_edit(item, part):
    """The item with one place changed, glued, split, lost or added to, as it could stand in the passage."""
    for k in range(len(item) + 1):
        for a, b in decontamination.EDITS:
            rest = item[k + a :]
            for j in range(len(part) - k - b - len(rest) + 1):
                if k + a <= len(item) and part[j : j + k] == item[:k] and part[j + k + b : j + k + b + len(rest)] == rest:
                    yield part[j : j + k + b + len(rest)]


def test_decontamination_against_every_pair(spark, monkeypatch):
    rnd = random.Random(19)
    items = [(k, prose(rnd, rnd.randint(6, 30)) + ". " + prose(rnd, rnd.randint(1, 8))) for k in range(12)]
    texts = [None, "", prose(rnd, 200)]
    for k, t in items * 2:
        w = t.split()
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 5))):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        texts.append(" ".join([prose(rnd, rnd.randint(0, 150)), *w, prose(rnd, rnd.randint(0, 60))]))
    want = brute_leaks(texts, items)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, decontamination.leaked_passages(docs, bench).collect()))]
    assert {r[:2] for r in found[0]} == want and 5 < len(want) < len(texts)
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 400)  # many blocks, one result
    found.append(sorted(map(tuple, decontamination.leaked_passages(docs, bench).collect())))
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]] and np.allclose([r[2:5] for r in found[0]], [r[2:5] for r in found[1]])
    dotted = docs.withColumn("a.b", F.lit(1))
    out = decontamination.drop_leaked(dotted, bench)
    assert out.columns == dotted.columns and {r["doc_id"] for r in out.collect()} == set(range(len(texts))) - {d for d, _ in want}
    with pytest.raises(ValueError, match="rename"):
        decontamination.leaked_passages(docs.withColumnRenamed("doc_id", "item_id"), bench, id_col="item_id")


def test_decontamination_with_one_word_altered(spark):
    rnd = random.Random(10)
    items = [f"{' '.join(f'q{k}w{i}' for i in range(12 if k % 2 else 45))}. {' '.join(f'a{k}w{i}' for i in range(1 + k % 8))}." for k in range(24)]
    prefix, suffix = prose(rnd, 30), prose(rnd, 30)
    texts, want = [], set()
    for k, item in enumerate(items):
        w = item.split()
        m = rnd.randrange(len(w) - 1)
        altered = [[*w[:-1], w[-1] + "***"], [*w[:-1], "\u201c" + w[-1] + "\u201d"], [*w[:-1], w[-1] + "glued"], [*w[:-1], "changed"]]
        altered += [[*w[:m], "changed", *w[m + 1 :]], [*w[:m], w[m] + w[m + 1], *w[m + 2 :]], [*w[:m], "added", *w[m:]]]
        for a in altered:
            want.add((len(texts), k))
            texts.append(" ".join([prefix, *a, suffix]))
        if k % 8 == 7:
            texts.append(" ".join([prefix, *w[:-8], suffix]))  # the question alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaked_passages(docs, bench).collect()} == want


def test_simhash(spark, docs, texts):
    def print_of(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in texts:
        assert simhash.fingerprint(t, 3) == print_of(t)
    rnd = random.Random(4)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        prints.append(rnd.choice(prints) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    hub = rnd.getrandbits(64)
    prints += [hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # a bucket too large to be paired
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r["c"] for r in simhash.with_component(df, "doc_id", "fp", "c").collect()}
    assert got == {k: find(k) for k in range(len(prints))}


def test_simhash_with_null_ids(spark):
    """Rows without an id link others and name nothing; the fingerprint zero, that of texts without words, is linked like any other."""
    rows = [(5, 0b1111 << 40), (None, 0b1100 << 40), (None, 0b1100 << 40 | 0b1), (7, 0b111 | 0b1100 << 40), (0, 0b11111 << 50), (None, 0), (9, 0b11), (None, -1), (3, 0b11111 << 50)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = Counter((r["doc_id"], r["fp"], r["c"]) for r in simhash.with_component(df, "doc_id", "fp", "c").collect())
    names = [5, 5, 5, 5, 0, 5, 5, None, 0]
    assert got == Counter((i, f, c) for (i, f), c in zip(rows, names, strict=True))


def test_dotted_column_names(spark, docs):
    dotted = docs.withColumn("a.b", F.col("doc_id"))
    for out in (near_copies.drop_copies(dotted), simhash.with_fingerprint(dotted, "text", "f.p").drop("f.p")):
        assert out.columns == dotted.columns and out.count() > 0


def test_shared_folder_and_scopes(spark):
    with Scope() as one:
        kept = Stored(spark.range(3), "kept")
    with Scope() as two:
        gone = Stored(spark.range(3), "gone")
    two.drop()
    assert kept.df.count() == 3 and one.tables == [kept]
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST"):
        gone.df.count()


def test_near_copies(spark, docs):
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        base = prose(rnd, rnd.randint(3, 200)).split()
        for _ in range(rnd.randint(1, 5)):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(9))
            rows.append(" ".join(w))
    base = prose(rnd, 150).split()  # a group larger than a bucket
    rows += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(120)]
    rows += [None, "", " ", rows[0], rows[0].upper()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, parent = [shingles(t) for t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or len(s & sets[j]) * 5 >= len(s | sets[j]) * 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {r["doc_id"] for r in near_copies.drop_copies(df).collect()} == {find(k) for k in range(len(rows))}
    kept = near_copies.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count() and near_copies.drop_copies(empty(docs)).count() == 0


def star(rnd, n):
    """A text and ``n`` more that are similar to it, but hardly to each other."""
    base, out = [f"w{rnd.randrange(10**6)}" for _ in range(100)], []
    for k in range(n):
        w = list(base)
        for at in rnd.sample(range(4, 96), 2):
            w[at] = f"x{k}y{at}"
        out.append(" ".join(w))
    return [" ".join(base), *out]


def components_of(sets):
    left, out = set(range(len(sets))), 0
    while left:
        out, todo = out + 1, [left.pop()]
        while todo:
            a = sets[todo.pop()]
            near = {k for k in left if len(a & sets[k]) * 5 >= len(a | sets[k]) * 4}
            left -= near
            todo += near
    return out


@pytest.mark.parametrize("block", [1024, 100])
def test_near_copies_of_one_original(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = star(random.Random(3), 520)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert near_copies.drop_copies(df).count() == components_of(sets) == 1


def test_near_copies_with_repeats(spark):
    """Pairs that share 195 of 213 different shingles, of which one text repeats some often, and pairs of eight or nine words."""
    rnd, rows = random.Random(12), []
    for k in range(40):
        w = [f"p{k}w{i}" for i in range(209)]
        rows += [" ".join(w[:204]), " ".join(w[5:209] + w[30:50] * 12)]
        few = [f"s{k}w{i}" for i in range(9)]
        rows += [" ".join(few[:8]), " ".join(few)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    pairs = sum(len(a & b) * 5 >= len(a | b) * 4 for a, b in zip(sets[::2], sets[1::2], strict=True))
    shuffled = rnd.sample(rows, len(rows))
    df = spark.createDataFrame(list(enumerate(shuffled)), "doc_id long, text string")
    assert len(rows) - near_copies.drop_copies(df).count() == pairs == 80


@pytest.mark.parametrize("shard_records", [1024, 20])
def test_warc(spark, shard_records):
    """Stores with lost, altered, extra and repeated records, null ids among them, against a comparison of all records."""
    rnd = random.Random(7)
    here = [(k % 290 if k % 11 else None, 10 + k % 5, hashlib.sha256(f"{k % 380}".encode()).hexdigest()) for k in range(400)]
    there = [(i, n + 1, hashlib.sha256(d.encode()).hexdigest()) if rnd.random() < 0.05 else (i, n, d) for i, n, d in here if rnd.random() > 0.05]
    there += [(1000 + k, 5, hashlib.sha256(f"new {k}".encode()).hexdigest()) for k in range(9)] + here[:3]
    a, b = Counter(here), Counter(there)
    delta = defaultdict(set)
    for r in a | b:
        delta[r[0]].add((a[r] > b[r]) - (a[r] < b[r]))
    want = {r: "ok" if a[r] == b[r] else "altered" if r[0] is not None and {1, -1} <= delta[r[0]] else "lost" if a[r] > b[r] else "extra" for r in a | b}
    schema = "page_id long, n_bytes long, digest string"
    x, y = spark.createDataFrame(here, schema), spark.createDataFrame(there, schema)
    got = warc.audit(x, y, shard_records=shard_records).collect()
    assert {tuple(r)[:3]: r["status"] for r in got} == want and len(got) == len(want) and set(want.values()) == {"ok", "altered", "lost", "extra"}
    assert all((r["copies"], r["copies_there"]) == (a[tuple(r)[:3]], b[tuple(r)[:3]]) for r in got)
    by_shard = defaultdict(list)
    for r in got:
        if r["copies"]:
            assert r["digest"].startswith(r["shard"])
            by_shard[r["shard"]].append(r)
    for rs in by_shard.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["end"] == at + r["copies"] * r["n_bytes"]
            at = r["end"]
    assert {r["status"] for r in warc.audit(x, x).collect()} == {"ok"}
    assert warc.audit(empty(x), empty(y)).count() == 0 and {r["status"] for r in warc.audit(x, empty(y)).collect()} == {"lost"}


def test_url_filters(spark):
    urls = ["http://A.Example.org/es/1?x=1", "https://example.org/en/12", "http://x.com/fr/2", "http://com/de/9", "http://example.net/en/1", "no scheme", None, "http://org", "a://example.org/en/2#top", "http://b.org?/es/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    train = spark.createDataFrame([(f"http://{'bad--' if k % 3 == 0 else 'fine'}{k}.net/en/{k}", int(k % 3 == 0)) for k in range(300)], "url string, block int")
    model = url_filters.UrlModel.fit(train)
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, model).collect()}
    assert [got[k]["host"] for k in range(10)] == ["a.example.org", "example.org", "x.com", "com", "example.net", "", "", "org", "example.org", "b.org"]
    assert [got[k]["path"] for k in range(10)] == ["/es/1", "/en/12", "/fr/2", "/de/9", "/en/1", "", "", "", "/en/2", ""]
    assert [got[k]["rule"] for k in range(10)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, "org/", None]
    assert [got[k]["verdict"] for k in range(4)] == ["block", "block", "allow", "block"]
    scored = url_filters.filter_urls(train.select("url"), model).join(train, "url")
    assert scored.filter((F.col("verdict") == "block") == (F.col("block") == 1)).count() > 290
    # Held out: suffixes tell in one half of the urls what holds in the other.
    rnd = random.Random(4)
    urls = [(f"http://{'shop' if k % 2 else 'news'}{k}.site.net/{rnd.randrange(10**6)}{'?a=1&b=2' if rnd.random() < 0.5 else ''}", int((k % 2 == 1) == (rnd.random() < 0.95))) for k in range(800)]
    half = [spark.createDataFrame(urls[k::4] + urls[k + 1 :: 4], "url string, block int") for k in (0, 2)]
    held = url_filters.filter_urls(half[1], url_filters.UrlModel.fit(half[0]), rules=())
    assert held.filter((F.col("verdict") == "block") == (F.col("block") == 1)).count() > 0.9 * half[1].count()
    none = url_filters.UrlModel.fit(empty(train))
    assert {r["verdict"] for r in url_filters.filter_urls(pages, none).filter("rule IS NULL").collect()} == {"allow"}


def test_line_dedup(docs, texts):
    lines = [(k, i, frozenset(x.split())) for k, t in enumerate(texts) for i, x in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    want = {(k, i) for n, (k, i, w) in enumerate(lines) if any(5 * len(w & v) >= 4 * len(w | v) for _, _, v in lines[:n])}
    got = line_dedup.removed_lines(docs).collect()
    assert {(r["doc_id"], i) for r in got for i in r["removed"]} == want and want and len(got) == docs.count()
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and line_dedup.dedup_lines(empty(docs)).count() == 0
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[0] == texts[0] and left[43] is None


@pytest.mark.parametrize("hot", [1 << 14, 5, 0])
def test_line_dedup_of_long_lines(spark, monkeypatch, hot):
    """Lines around the sizes where a parity takes 64 or 128 bits, and far beyond, at similarities around the threshold."""
    monkeypatch.setattr(line_dedup, "HOT_WORD", hot)  # at 5 and 0 some or all words are keys only in pairs
    rnd, rows = random.Random(15), []
    for n in (4, 5, 7, 9, 30, 62, 66, 75, 110, 200, 450):
        for _ in range(4):
            base = [f"w{rnd.randrange(10**(5 if n > 9 else 2))}" for _ in range(n)]
            rows.append(" ".join(base))
            for share in (0.02, 0.08, 0.1, 0.12, 0.2):
                w = [x if rnd.random() > share else f"v{rnd.randrange(10**5)}" for x in base]
                rows.append(" ".join(rnd.sample(w, len(w))))
    rnd.shuffle(rows)
    sets = [set(x.split()) for x in rows]
    want = {n for n, w in enumerate(sets) if any(5 * len(w & v) >= 4 * len(w | v) for v in sets[:n])}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.removed_lines(df).collect() if r["n_removed"]} == want and len(want) > 50


@pytest.mark.parametrize("others", [0, 3])
def test_line_dedup_forms_few_pairs_of_many_similar_lines(spark, monkeypatch, others):
    """A group of similar lines is not paired whole, and lines whose closest candidate is not similar still meet all others."""
    made = []

    class Counted(Stored):
        def __init__(self, df, name, key=None):
            super().__init__(df, name, key)
            if name == "lines-pairs":
                made.append(sum(len(line_dedup.unpack(bytes(r["b"]))) for r in self.df.collect()))

    monkeypatch.setattr(line_dedup, "Stored", Counted)
    monkeypatch.setattr(line_dedup, "OTHERS", others)
    rnd = random.Random(4)
    group = [f"w{k}" for k in range(20)]
    rows = [" ".join([*group, f"v{k}"]) for k in range(120)]
    pool = [f"u{k}" for k in range(14)]
    rows += [" ".join(rnd.sample(pool, rnd.randint(7, 11))) for _ in range(80)]
    sets = [set(x.split()) for x in rows]
    want = {k for k in range(len(rows)) if any(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(k))}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.removed_lines(df).collect() if r["n_removed"]} == want
    assert made[0] < 20 * len(rows)  # partitions name a line's closest each for itself


def test_line_dedup_forms_candidates_once_more_for_few_lines(spark, monkeypatch):
    """Lines with many candidates, none similar, are met again by lines with words of theirs only."""
    posted = []

    def counted(*args, f=line_dedup.postings):
        posted.append(spark.sparkContext.accumulator(0))
        run, count = f(*args), posted[-1]

        def told(left, right):
            out = run(left, right)
            count.add(sum(len(line_dedup.unpack(x.as_py())) for x in out.column("keys")))
            return out

        return told

    monkeypatch.setattr(line_dedup, "postings", counted)
    rnd = random.Random(6)
    pool = [f"v{k}" for k in range(300)]  # more frequent than the words of the group, so no early words of a line
    rows = [[*(f"w{k}" for k in range(17)), *rnd.sample(pool, 3)] for _ in range(200)]  # parities of 6 differing words often differ in 4 bits
    rows += [rnd.sample(pool, 20) for _ in range(4000)]
    held = np.zeros((len(rows), 317))
    for k, x in enumerate(rows):
        held[k, [int(w[1:]) if w[0] == "v" else 300 + int(w[1:]) for w in x]] = 1
    shared = held @ held.T
    want = {k for k in range(len(rows)) if (5 * shared[k, :k] >= 4 * (40 - shared[k, :k])).any()}
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.removed_lines(df).collect() if r["n_removed"]} == want and len(want) > 20
    assert len(posted) == 2 and 0 < 2 * posted[1].value < posted[0].value


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 19])
def test_line_words(monkeypatch, size):
    """Slices of any size give the words that split() gives; words of other bytes or lengths get other hashes."""
    monkeypatch.setattr(line_dedup, "SLICE", size)
    rnd = random.Random(7)
    parts = [bytes([k]) for k in range(256)] + [b" ", b"\n"] * 60 + [b"a", b"b", b"\x00", b"x" * 63, b"y" * 64, b"abcdefgh", b"abcdefghi"] * 20
    texts = [None, b"", b"\n \n"] + [b"".join(rnd.choices(parts, k=rnd.choice([0, 1, 2, 9, 60, 300]))) for _ in range(120)] + [b"", None]
    got, begun, whole = {}, 0, True
    for begun, whole, doc, line, sizes, words, hashes in line_dedup.line_words(pa.array([b"before", *texts], pa.binary())[1:]):  # noqa: B007
        ends = np.cumsum(sizes)
        for d, k, lo, hi in zip(doc.tolist(), line.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            assert (d, k) not in got and d < begun
            got[d, k] = sorted(hashes[words[lo:hi]].tolist())
    want = {(d, k): set(x.split()) for d, t in enumerate(texts) for k, x in enumerate((t or b"").split(b"\n")) if x.split()}
    known = sorted(set().union(*want.values()))
    sizes = np.array([len(w) for w in known])
    of = dict(zip(known, line_dedup._hashed(np.frombuffer(b"".join(known), np.uint8), np.cumsum(sizes) - sizes, sizes).tolist(), strict=True))
    assert whole and len(set(of.values())) == len(known) and got == {k: sorted(of[w] for w in v) for k, v in want.items()}


def test_line_dedup_of_short_lines(spark):
    texts = ["All rights reserved.\none two three four\none", "All rights reserved.\nfour three two one", "one\nTwo", "a b a b c d c d a b", "d c b a", "one two three four five", "one two three", "one two\n \n", None, "two one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lines = [(k, i, frozenset(x.split())) for k, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.split()]
    want = {(k, i) for n, (k, i, w) in enumerate(lines) if any(5 * len(w & v) >= 4 * len(w | v) for _, _, v in lines[:n])}
    assert want == {(1, 0), (1, 1), (2, 0), (4, 0), (5, 0), (9, 0)}
    assert {(r["doc_id"], i) for r in line_dedup.removed_lines(df).collect() for i in r["removed"]} == want


def test_ids_that_are_no_integers(spark):
    df = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    for f in (katz.fit_and_score, line_dedup.removed_lines):
        with pytest.raises(TypeError, match="integer"):
            f(df)


@pytest.mark.parametrize(("hot", "order"), [(20, 2), (1, 2), (20, 3), (1, 3)])
def test_katz(docs, texts, monkeypatch, hot, order):
    monkeypatch.setattr(katz, "HOT", hot)
    toks = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in enumerate(texts)} | {None: [b"null", b"id", b"\n"]}
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k in toks}
    past = lambda t, i, m: tuple(([b"\n"] * m + t)[i : i + m])  # noqa: E731 - the m tokens before place i; a text begins after ends
    grams = [Counter((past(t, i, m), t[i]) for k, t in toks.items() if not held[k] for i in range(len(t))) for m in range(order)]
    one = Counter({w: c for (_, w), c in grams[0].items()})
    total = sum(one.values())
    cells = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)])
    factors = [katz.discounts(cells(g)) for g in grams]
    cut = lambda d, c: d[min(c, katz.K + 1)] * c
    unknown = 1 - sum(cut(factors[0], c) for c in one.values()) / total
    sums = [defaultdict(lambda: [0.0, 0.0, 0]) for _ in grams]  # of every context: discounted counts, seen words one order lower, all

    def p(m, context, w):
        if m == 0:
            return cut(factors[0], one[w]) / total if one[w] else unknown
        kept, seen, size = sums[m][context] if context in sums[m] else (0.0, 0.0, 0)
        if not size:
            return p(m - 1, context[1:], w)
        s = size / (size + 1) if kept > size * (1 - 1e-12) else 1.0
        c = grams[m].get((context, w), 0)
        return s * cut(factors[m], c) / size if c else (1 - s * kept / size) / (1 - seen) * p(m - 1, context[1:], w)

    for m in range(1, order):
        for (context, w), c in grams[m].items():
            x = sums[m][context]
            x[0], x[1], x[2] = x[0] + cut(factors[m], c), x[1] + p(m - 1, context[1:], w), x[2] + c
    for context in [(b"\n", b"\n"), (b"the", b"of"), (b"never seen", b"the"), (b"the", b"never seen"), *rnd_contexts(grams[-1])]:
        context = context[-(order - 1) :]
        assert abs(sum(p(order - 1, context, w) for w in one) + p(order - 1, context, b"<unknown>") - 1) < 1e-9
    for r in katz.fit_and_score(docs, order=order).collect():
        t = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(one[w] > 0 for w in t), total)
        assert r["score"] == pytest.approx(sum(np.log10(p(order - 1, past(t, i, order - 1), w)) for i, w in enumerate(t)))
        assert r["base_score"] == pytest.approx(sum(np.log10((one[w] + 1) / (total + len(one) + 1)) for w in t))
    assert katz.fit_and_score(empty(docs), order=order).count() == 0


def rnd_contexts(grams):
    return random.Random(3).sample(sorted({c for c, _ in grams}), 20)


def test_near_copies_from_large_buckets_of_fingerprints(spark, monkeypatch):
    """Seventy copies that differ in a word, when no min-hash band is shared: fingerprints alone must bring them together."""
    rnd = random.Random(33)
    base = prose(rnd, 900).split(" ")
    texts = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in rnd.sample(range(900), 70)] + [prose(rnd, 60) for _ in range(20)]
    original = near_copies.buckets
    monkeypatch.setattr(near_copies, "buckets", lambda nodes: original(nodes).limit(0))
    kept = near_copies.drop_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"] for r in kept.collect()}
    assert set(range(70, 90)) <= got and len(got) < 20 + 35


def test_decontamination_with_null_and_other_ids(spark):
    """Items without an id leak as others do, ids of any type are handed on."""
    rnd = random.Random(34)
    texts = [prose(rnd, 40) + "? " + prose(rnd, 9) for _ in range(4)]
    docs = spark.createDataFrame([(k, prose(rnd, 30) + " " + t + " " + prose(rnd, 30)) for k, t in enumerate(texts)] + [(9, prose(rnd, 80))], "doc_id long, text string")
    for kind, ids in (("string", ["b-1", None, None, "a"]), ("long", [7, None, None, 2])):
        items = spark.createDataFrame([*zip(ids, texts, strict=True), (ids[0], None), (None, "")], f"item_id {kind}, text string")
        got = decontamination.leaked_passages(docs, items)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == list(enumerate(ids)) and dict(got.dtypes)["item_id"] == items.dtypes[0][1]
        assert [r["doc_id"] for r in decontamination.drop_leaked(docs, items).collect()] == [9]
