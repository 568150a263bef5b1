import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline as p
from millrace.llm.decontam import find_passages


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    out = p.run(spark, sf_dir)
    assert out.columns == [*p.COLUMNS, "copy", "shuffle_key"]
    out.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert find_passages(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert 0.4 * before < out.select("doc_id").distinct().count() <= before  # a Poisson draw of mean 1 is 0 for a third
    assert 0.6 * before < out.count() < 1.4 * before


def test_each_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for i, (_, f) in enumerate(p.STAGES[:-1]):
        out = f(spark, docs, sf_dir)
        assert out.columns == p.COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left = docs.count()
        assert 0.7 * n <= left <= n and docs.select("doc_id").distinct().count() == left
        n = left
    assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_near_dedup_against_brute_force(spark):
    """Pairs from 0.7 to 0.95, many of them between 0.80 and 0.85."""
    rng, docs = random.Random(4), []
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(100)]
        docs.append(" ".join(words))
        for n in (1, 2, 3):
            other = list(words)
            for k in rng.sample(range(5, 95), n):
                other[k] = f"n{len(docs)}x{k}"
            docs.append(" ".join(other))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    root = list(range(len(docs)))
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(docs)) for b in range(a)}
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 10
    for _ in docs:
        for (a, b), x in alike.items():
            if x >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in p.near_dedup(spark, df, "").collect()) == [i for i, r in enumerate(root) if i == r]


KIND = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line of this kind stands in many documents"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], KIND).repartition(3)


def _rows():
    """Nulls, empty and very long texts, repeated rows, null ids and sources."""
    words = lambda g, n: " ".join(f"w{g}x{k}" for k in range(n))
    return [
        (1, None, "a"), (2, "", "a"), (None, words(1, 30), "b"), (None, words(1, 30), "b"), (3, words(1, 30), None), (4, words(2, 90), "b"), (4, words(2, 90), "b"), (5, words(2, 89), "c"),
        (6, f"{LINE}\n{words(3, 9)}", "a"), (7, f"{LINE}\n{words(4, 9)}", "b"), (8, f"{words(5, 9)}\n {LINE.upper()} ", "c"), (9, f"{words(6, 4)}\n{LINE}", "c"), (10, "long " * 200_000, "d"), (11, " \n ", "a"),
    ]


def _ids(df):
    assert df.columns == p.COLUMNS
    return sorted(map(str, (r["doc_id"] for r in df.collect())))


def test_language_stage_edges(spark):
    known = {"en": ["the", "river", "and", "with", "house"], "de": ["der", "fluss", "und", "mit", "haus"]}
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice(known[lang]) for _ in range(60)), lang, "s", 1) for i in range(80) for lang in [("en", "de")[i % 2]]]
    odd = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "12 34", "en", "s", 5), (None, rows[0][1], None, "s", 1), (4, rows[1][1], None, None, 1), (4, rows[1][1], None, None, 1), (5, "сегодня мы пошли в лес собирать грибы и ягоды " * 9, None, "s", 1)]
    out = p.language(spark, spark.createDataFrame(rows + odd, KIND), "")
    left = Counter(map(str, (r["doc_id"] for r in out.collect())))
    assert not {"1", "2", "3", "5"} & set(left) and left["None"] == 1 and left["4"] == 2 and len(left) >= 80
    assert {r["lang"] for r in out.filter("doc_id = 4").collect()} == {"de"}
    assert p.language(spark, spark.createDataFrame([], KIND), "").count() == 0


def test_line_stage_against_brute_force(spark):
    rows = _rows()
    out = p.lines(spark, _frame(spark, rows), "")
    holders = {i for i, t, _ in rows if i is not None and t and any(x.strip().lower() == LINE for x in t.split("\n"))}
    assert holders == {6, 7, 8, 9}
    want = Counter()
    for i, t, s in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if i in (None, 9) or x.strip().lower() != LINE)
        want[i, kept, s, None if kept is None else len(kept)] += 1
    assert Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in out.collect()) == want
    assert p.lines(spark, spark.createDataFrame([], KIND), "").count() == 0


def test_near_stage_edges(spark):
    out = p.near_dedup(spark, _frame(spark, _rows()), "")
    # 5 is a near copy of 4; null ids stay, rows of one id stay together; blank texts are like nothing
    assert _ids(out) == sorted(["1", "2", "None", "None", "3", "4", "4", "6", "7", "8", "9", "10", "11"])
    assert p.near_dedup(spark, spark.createDataFrame([], KIND), "").count() == 0


def test_benchmark_stage_edges(spark, tmp_path):
    items = [(1, " ".join(f"w2x{k}" for k in range(40))), (2, None), (3, ""), (4, "w6x0 w6x1 w6x2 w6x3"), (4, "w5x0 w5x1"), (None, "long long")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.benchmark(spark, _frame(spark, _rows()), str(tmp_path))
    assert _ids(out) == sorted(["1", "2", "None", "None", "3", "6", "7", "10", "11"])
    assert p.benchmark(spark, spark.createDataFrame([], KIND), str(tmp_path)).count() == 0


def test_mixing_stage_against_brute_force(spark):
    rows = _rows()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    rate = {s: sum(size.values()) / sum(x > 0 for x in size.values()) / n for s, n in size.items() if n}
    want = Counter()
    for i, t, s in rows:
        key = "null" if i is None else str(i)
        u, n, total = int(hashlib.md5(f"17|{key}".encode()).hexdigest()[:13], 16) / 2**52, 0, 0.0
        while True:
            total += math.exp(n * math.log(rate[s]) - rate[s] - math.lgamma(n + 1))
            if total > u or n > 10 * rate[s] + 50:
                break
            n += 1
        for c in range(n):
            want[i, t, s, c, int(hashlib.md5(f"17-order|{key}|{c}".encode()).hexdigest()[:15], 16)] += 1
    out = p.mixture(spark, _frame(spark, rows), "")
    assert out.columns == [*p.COLUMNS, "copy", "shuffle_key"]
    assert Counter((r["doc_id"], r["text"], r["source"], r["copy"], r["shuffle_key"]) for r in out.collect()) == want
    assert p.mixture(spark, spark.createDataFrame([], KIND), "").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_stages_say_what_they_do(name):
    text = dict(p.STAGES)[name].__doc__
    assert all(word in text for word in ("Null", "empty", "repeated"))
