"""MinHash, embedding and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import embed, linededup, minhash
from millrace.llm.components import connected_components
from millrace.llm.cuckoo import CuckooFilter
from millrace.llm.embed import near_vectors
from millrace.llm.linededup import LineIndex, dedup_lines


def _components(ids, links):
    root = {i: i for i in ids}
    while True:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                moved = True
        if not moved:
            return root


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _near_docs():
    rng, docs = random.Random(1), []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 80, 300, 2500]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, max(1, len(w) // 80), max(1, len(w) // 30)])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            docs.append(rng.choice([" ", "\n", "\t "]).join(w).upper() if g % 2 else " ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs, 10)) + [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "é É"), (7, "É é"), (None, "one two")]


def test_near_duplicates_against_brute_force(spark):
    docs = _near_docs()
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n int, key string").repartition(3)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: _shingles(t) for i, t in docs if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    assert len(found) == len(docs) and len(links) > 20
    for i, s in sets.items():
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(s), want[i], want[i] == i), i
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """A group in which no document is linked with all: the second pass, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[: 200 + 8 * i])) for i in range(18)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_near_duplicates_of_strays(spark, monkeypatch):
    """A large component and a few rows beside it in the same buckets, over many blocks; long texts too."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng, docs = random.Random(7), []
    for size in (40, 1500):
        words = [f"s{size}w{i}" for i in range(size)]
        for n in range(30):
            w = list(words)
            for k in rng.sample(range(size), rng.choice([0, 1, size // 60, size // 35])):
                w[k] = f"x{len(docs)}y{k}"
            docs.append(" ".join(w))
    docs.append("long " * 300_000)
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(docs)], "doc_id long, text string, h1 string, s1 int").repartition(4)
    sets = [_shingles(t) for t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == _components(range(len(docs)), links)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, 300 + i) for i in range(30)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for e in links if e[0] != e[1] for x in e}
    want = _components(ids, [e for e in links if e[0] != e[1]])
    assert found == want


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0, 0.05, 0.15, 0.3)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [1.0] * 23), (905, [None] + [1.0] * 23), (906, [1.0] * 3), (907, (x[0] * 1e200).tolist()), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, table int").repartition(3)
    found = {r["vec_id"]: r for r in near_vectors(df).collect()}
    y = np.concatenate([x, x[:1]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    names = [*range(len(x)), 907]
    near = [(names[a], names[b]) for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.95, 1)), strict=True)]
    n = {i: sum(i in e for e in near) for i in names}
    assert sum(found[i]["n_links"] for i in names) >= 0.95 * sum(n.values()) > 0
    assert all(found[i]["n_links"] <= n[i] for i in names) and found[907]["n_links"] == n[907]
    for i in (900, 901, 902, 903, 904, 905, 906):  # 906 is the only one of its length
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert near_vectors(df.limit(0)).count() == 0 and len(found) == len(rows)


def _brute_vectors(rows):
    """(n_links, component) of each row (vec_id, vector), all lengths, double precision."""
    x = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [(a, b) for a in range(len(x)) for b in range(a) if len(x[a]) == len(x[b]) and float(x[a] @ x[b]) >= 0.95]
    at = _components(range(len(x)), links)
    least = {}
    for i, r in at.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], sum(i in e for e in links), least[at[i]]) for i in range(len(x))]


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dims, n in ((3, 12), (8, 30), (16, 20)):
        base = rng.standard_normal((n, dims))
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(np.concatenate([base, base + 0.02 * rng.standard_normal(base.shape)]))]
    a, b = rng.standard_normal((2, 8))
    rows += [(500, a.tolist()), (500, b.tolist()), (501, (a + 0.01).tolist()), (502, (b + 0.01).tolist()), (503, [1.0, 0.0]), (503, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df).collect())
    assert found == sorted(_brute_vectors(rows))


def test_vectors_in_a_bucket_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.embed.BLOCK", 16)
    monkeypatch.setattr("millrace.llm.embed.FEW", 6)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(12)
    rows = [(i, (centre + 0.04 * rng.standard_normal(12)).tolist()) for i in range(150)] + [(i, rng.standard_normal(12).tolist()) for i in range(150, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df).collect()) == sorted(_brute_vectors(rows))


def test_vectors_meet_as_often_as_promised():
    """Pairs of exactly the threshold, also where all vectors lie to one side, and short ones."""
    rng = np.random.default_rng(8)
    for dims, mean, n in ((64, 0.0, 50_000), (32, 0.0, 50_000), (64, 1.0, 50_000), (64, 0.0, 1_000_000_000)):
        x = rng.standard_normal((4000, dims)) + mean
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = embed.learn(x[:3000], n)
        u = rng.standard_normal((1000, dims))
        u -= (u * x[3000:]).sum(axis=1, keepdims=True) * x[3000:]
        y = 0.95 * x[3000:] + np.sqrt(1 - 0.95**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
        assert (q.keys(x[3000:]) == q.keys(y)).any(axis=1).mean() > 0.9 and q.width >= np.log2(n)
        lone = embed.unlearned(dims, n)
        assert mean or (lone.keys(x[3000:]) == lone.keys(y)).any(axis=1).mean() > 0.9


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 62), 1 << 62, 4000)
    f = CuckooFilter.of(h[:3000])
    assert f.contains(h[:3000]).all() and f.contains(h[3000:]).mean() < 0.01
    f.delete(h[:1500])
    g = CuckooFilter.from_bytes(f.to_bytes())
    assert g.contains(h[1500:3000]).all() and g.contains(h[:1500]).mean() < 0.01
    tiny = CuckooFilter(1)
    tiny.insert(h[:20])  # more than it holds: the stash
    assert tiny.contains(h[:20]).all()
    tiny.delete(h[:19])
    assert tiny.contains(h[19:20]).all()


LINE = ["the first line that many hold", "  The FIRST line that many hold\t", "ÄÖÜ lines with letters beyond ascii", "short", "twenty characters ab", "nineteen characters", "each one its own: "]


def _line_docs():
    rng, docs = random.Random(5), [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 300_000 + "\n" + LINE[0])]
    for i in range(5, 40):
        docs.append((i, "\n".join(rng.choice(LINE[:-1]) if rng.random() < 0.6 else f"{LINE[-1]}{i}" for _ in range(rng.randrange(1, 6)))))
    return docs


def _brute_lines(docs, all_docs=None):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in all_docs or docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or i is None or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def _result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


def test_line_dedup_against_brute_force(spark):
    docs = [*_line_docs(), (None, LINE[0])]
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, h1 string, n_lines int").repartition(3)
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped", "kept_sha256"]
    assert _result(out) == _brute_lines(docs)
    assert {r["doc_id"] for r in out.filter("text is null").collect()} == {1}
    assert dedup_lines(df.limit(0)).count() == 0


def test_line_index_is_reversible(spark):
    docs = _line_docs()
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.build(frame(docs[:20])).insert(frame(docs[15:]))
    assert _result(index.apply(frame(docs))) == _brute_lines(docs)
    gone = [d for d in docs if d[0] % 3]
    index = index.delete(frame([d for d in docs if d[0] % 3 == 0]).select("doc_id"))
    assert _result(index.apply(frame(gone))) == _brute_lines(gone)
    fresh = LineIndex.build(frame(gone))
    key = ["h1", "h2", "n_docs", "keeper"]
    assert sorted(map(tuple, index.counts.select(*key).collect())) == sorted(map(tuple, fresh.counts.select(*key).collect()))


def test_line_index_grows(spark, monkeypatch):
    """From 10 keys to 20,000 and back: filters are made anew and split, no key waits in a stash."""
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 256)
    lines = lambda a, b: "\n".join(f"line number {i} that three hold" for i in range(a, b))
    frame = lambda a, b, ids: spark.createDataFrame([(i, lines(a, b)) for i in ids], "doc_id long, text string")
    index = LineIndex.build(frame(0, 10, (1, 2, 3)))
    first = index.shards
    index = index.insert(frame(10, 20_000, (4, 5, 6)))
    filters = [CuckooFilter.from_bytes(bytes(r["bits"])) for r in index.filters.collect()]
    assert index.shards > first and len(filters) == index.shards and not any(f.stash for f in filters)
    index = index.insert(frame(20_000, 21_000, (7, 8, 9)))
    assert _result(index.apply(frame(10, 20_000, (4,))))[4][:2] == (19_990, 19_990)
    index = index.delete(spark.createDataFrame([(i,) for i in range(10)], "doc_id long"))
    assert index.counts.count() == 0 and all(not CuckooFilter.from_bytes(bytes(r["bits"])).table.any() for r in index.filters.collect())


@pytest.mark.parametrize("size", [1, 2, 200, 5000])
def test_signature_estimates(size):
    rng = np.random.default_rng(size)
    s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    assert len(minhash.signature(s)) == minhash.BINS and set(minhash.signature(s)) <= set(s)
