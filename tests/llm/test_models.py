"""Language ID, quality, language model and secret scan."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import entry, langid, lm, quality, secret_scan
from millrace.llm.common import blocks, bound_batches, word_hashes

EDGES = [(None, "Das ist ein Text."), (9001, None), (9002, ""), (9003, "123 !!"), (9004, "mot " * 60_000), (9005, "x"), (9005, "x")]


def with_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return docs.union(spark.createDataFrame([(*e, None) for e in EDGES], docs.schema))


def test_words_of_bytes():
    texts = ["A bC\nd", "", None, "é\x0bÉ\x0cx", "tail", "head tail"]
    seen = []
    for size in (1, 1 << 20):
        got = []
        for _, data, at in blocks(pa.array(texts), size):
            h, where = word_hashes(data, at)
            got += [tuple(h[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
        seen.append(got)
    assert seen[0] == seen[1] and [len(x) for x in seen[0]] == [3, 0, 0, 3, 1, 2]
    assert seen[0][4][0] == seen[0][5][1] and len({h for x in seen[0] for h in x}) == 8


def test_queries_bound_batches_and_leave_other_choices(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        bound_batches(spark)
        assert spark.conf.get(key) in ("8m", "8388608b")
        spark.conf.set(key, "3m")
        bound_batches(spark)
        assert spark.conf.get(key) in ("3m", "3145728b")
    finally:
        spark.conf.set(key, before)


def test_language_id(spark, sf_dir):
    out = entry.op8_language_id(spark, sf_dir)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95


def test_language_id_edges(spark, sf_dir):
    docs = with_edges(spark, sf_dir)
    model = langid.fit(docs)
    found = langid.identify(docs.withColumn("score", F.lit("old")), model).filter("doc_id > 9000 or doc_id is null").collect()
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (9001, 9002, 9003))
    assert by[None]["lang_pred"] == "de" and len(found) == len(EDGES)
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "这是一些完全不同的文字" * 40)], "doc_id long, text string")
    assert langid.identify(strange, model).first()["rejected"]


STRANGE = [
    "Сегодня мы пошли в лес собирать грибы и ягоды после дождя вместе с друзьями и вернулись домой поздно вечером", "今天天气很好我们一起去公园散步看到很多漂亮的花朵和小鸟在树上唱歌孩子们在草地上玩耍",
    "hän käveli metsään ja löysi sieltä paljon sieniä mutta ei yhtään marjaa koska oli jo myöhäinen syksy ja kylmä", "bugün hava çok güzel olduğu için arkadaşlarımla birlikte parka gidip uzun bir yürüyüş yaptık ve çay içtik",
]


def test_short_strange_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    assert (model.farthest < 1).all()
    strange = spark.createDataFrame([(i, t[:100]) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(strange, model).collect())
    kept = [not r["rejected"] for r in langid.identify(docs.filter(F.col("text").rlike(r"\p{L}")), model).collect()]
    assert np.mean(kept) > 0.99


def test_nearest_centroid_is_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc "), 60)) for _ in range(9)]
    c = np.stack([langid.counts_of(t) for t in texts])
    m = langid.LanguageModel(["a", "b"], np.ones(langid.BUCKETS, np.float32), np.zeros((0, 0)), np.array([0, 0, 1]), np.ones((2, 40)))
    m.centroids = m.vectors(c[:3])
    names, score, _ = m.predict(texts)
    for i, v in enumerate(m.vectors(c)):
        best = max(range(3), key=lambda k: float(v @ m.centroids[k]))
        assert names[i] == ["a", "a", "b"][best] and abs(score[i] - float(v @ m.centroids[best])) < 1e-5


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 60)
    monkeypatch.setattr(secret_scan, "STEPS", 200)
    monkeypatch.setattr(lm, "SAMPLE_TOKENS", 20_000)


def test_quality(spark, quick):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["one", "river", "field", "of", "and"]) for _ in range(120)) for _ in range(60)]
    bad = [" ".join(rng.choice(["one", "river", "field"]) + rng.choice(["***", "%%%"]) for _ in range(90)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(good + bad)] + [(900, None, 1), (901, "", 1), (902, "word " * 60_000, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(5, None), (None, 1), (7777, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert np.mean([out[i]["predicted"] == int(i < 60) for i in range(1, 120, 2)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == 123
    assert out[900]["score"] == pytest.approx(out[901]["score"], abs=1e-5)
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["predicted"] for r in quality.score(docs, one).collect()} == {1}


def test_quality_against_brute_force(spark):
    """Scores of whole texts by plain loops over chunks, places and filters; repeated rows and clashing columns."""
    m = quality.QualityModel(seed=11)
    m.shift = -0.4
    rng = random.Random(5)
    texts = ["", None, "é" * 700, "word " * 900, *("".join(rng.choice("abc \n!") for _ in range(n)) for n in (1, 511, 512, 513, 1400))]

    def plain(text):
        data = (text or "").encode()
        data = data + bytes(max(0, 512 - len(data)))
        starts = [*range(0, len(data) - 512, 448), len(data) - 512]
        peaks = []
        for s in starts:
            e = m.p["embed"][np.frombuffer(data[s : s + 512], np.uint8)].astype(float)
            z = [e[k : k + 8].reshape(-1) @ m.p["filters"].astype(float) for k in range(0, 505, 2)]
            peaks.append(np.maximum(np.max(z, axis=0) + m.p["bias"], 0))
        f = np.concatenate([np.max(peaks, axis=0), np.mean(peaks, axis=0), np.min(peaks, axis=0)])
        h = np.maximum(f @ m.p["hidden"] + m.p["hidden_bias"], 0)
        return 1 / (1 + math.exp(-(float((h @ m.p["out"] + m.p["out_bias"])[0]) + m.shift)))

    df = spark.createDataFrame([(i, t, "old", 7) for i, t in enumerate(texts)] + [(3, texts[3], "old", 7)], "doc_id long, text string, score string, predicted int").repartition(2)
    rows = quality.score(df, m).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-4) and r["predicted"] == int(r["score"] >= quality.THRESHOLD)


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 961, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        c = quality.chunks_of(text)
        assert c.shape[1] == quality.CHUNK
        if n >= quality.CHUNK:
            assert bytes(c[0]) == text[:512].encode() and bytes(c[-1]) == text[-512:].encode() and len(c) >= n / quality.CHUNK


def test_quality_gradients():
    m = quality.QualityModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(1)
    docs, y = [rng.integers(0, 256, (k, quality.CHUNK)).astype(np.uint8) for k in (1, 3)], np.array([1.0, 0.0])

    def loss():
        f = m._combine(m.pooled(np.concatenate(docs)), np.array([1, 3])).astype(np.float64)
        z = m._head(f)[1]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = m._gradients(docs, y)
    for k in ("filters", "hidden", "out", "embed", "bias"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][at], 1e-3
        m.p[k][at] = old + e
        up = loss()
        m.p[k][at] = old - e
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


def test_lm_against_brute_force(spark, sf_dir, quick, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 300)  # so that many words take the join
    docs = with_edges(spark, sf_dir).filter("doc_id <> 9004 or doc_id is null")
    train = docs.filter("doc_id % 5 <> 1")
    model = lm.fit(train)
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for r in train.collect() for w in tok(r["text"]))
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    rows = lm.score(docs.withColumn("row", F.lit("x")), model).collect()
    assert len(rows) == sum(texts.values())
    found, base = {r["doc_id"]: r for r in rows}, 0.0
    for i, t in texts:
        w = tok(t)
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(found[i]["base_score"] - want) < 1e-6 * abs(want) + 1e-9
        assert (found[i]["n_tokens"], found[i]["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
        base += want
    assert sum(r["score"] for r in rows) > base  # a context helps
    assert lm.score(docs.limit(0), model).count() == 0


def test_lm_learns_from_documents_outside_the_sample(spark, monkeypatch):
    """Without any sample, the order of words is still learned from all documents."""
    monkeypatch.setattr(lm, "SAMPLE_TOKENS", 0)
    monkeypatch.setattr(lm, "SHARD_LANES", 8)
    docs = spark.createDataFrame([(i, "one two three four five six seven " * 30) for i in range(400)], "doc_id long, text string").repartition(2)
    held = spark.createDataFrame([(1, "one two three four five six seven " * 9)], "doc_id long, text string")
    r = lm.score(held, lm.fit(docs)).first()
    assert r["score"] > 0.5 * r["base_score"]


def test_lm_ties_keep_a_full_vocabulary(spark, monkeypatch):
    """More words of one count than may be hot: as many as fit are, not none."""
    monkeypatch.setattr(lm, "HOT_WORDS", 500)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(60)], "doc_id long, text string")
    model = lm.fit(docs)
    assert 400 <= len(model.places) <= 500 and model.other[1] == 3000 - len(model.places)
    r = lm.score(docs, model).first()
    assert r["n_known"] == r["n_tokens"] == 51


def test_lm_scores_a_very_long_text_whole(spark):
    docs = spark.createDataFrame([(1, "one two three " * 30_000), (2, "one two"), (3, None)], "doc_id long, text string")
    model = lm.fit(docs)
    by = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert by[1]["n_tokens"] == 90_001 and by[1]["base_score"] < by[1]["score"] < 0 and by[3]["n_tokens"] == 1
    half = lm.score(spark.createDataFrame([(1, "one two three " * 15_000)], "doc_id long, text string"), model).first()
    assert by[1]["score"] < half["score"]


def test_lm_averages_of_averages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five six " * 20) for i in range(64)], "doc_id long, text string").repartition(8)
    whole = lm.fit(docs).network.flat
    monkeypatch.setattr(lm, "FAN_IN", 2)
    monkeypatch.setattr(lm, "SUMS", 1)
    assert np.allclose(lm.fit(docs).network.flat, whole, atol=1e-4)


def test_lm_is_a_distribution_and_carries_state():
    net = lm.WordNetwork(np.array([5, 3, 2, 1, 1]))
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    p = [float(np.exp(net.log_probability(h, np.array([k]))[0][0])) for k in range(5)]
    assert abs(sum(p) - 1) < 1e-4
    long = np.random.default_rng(2).integers(0, 5, 700).astype(np.int32)
    alone = net.score([long])[0]
    beside = net.score([long[:3], long, long[:90], long])
    assert abs(alone - beside[1]) < 1e-2 and abs(alone - beside[3]) < 1e-2
    x, state, total = net.p["embed"] @ net.p["w"] + net.p["b"], np.zeros((1, lm.HIDDEN), np.float32), 0.0
    for a, b in zip([lm._END, *long], [*long, lm._END], strict=True):
        state, _ = net.step(x[[a]], state)
        total += float(net.log_probability(state, np.array([b]))[0][0])
    assert abs(total / math.log(10) - alone) < 1e-2


def test_lm_gradients():
    net = lm.WordNetwork(np.array([5, 3, 2, 1, 1]))
    net.use(net.flat.astype(np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (6, 2)), rng.integers(0, 5, (6, 2))
    starts = np.zeros((6, 2), bool)
    starts[3, 1] = True
    h = rng.standard_normal((2, lm.HIDDEN)) * 0.1

    def loss():
        s, total = h, 0.0
        table = net.p["embed"] @ net.p["w"] + net.p["b"]
        for t in range(6):
            s = np.where(starts[t][:, None], 0, s)
            s, _ = net.step(table[x[t]], s)
            total -= float(net.log_probability(s, y[t])[0].sum())
        return total / 12

    g = net._views(net._gradients(x, y, starts, h)[0])
    for k in ("embed", "w", "b", "u", "c", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = net.p[k][at], 1e-3
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 0.03 * abs(g[k][at]) + 1e-4, k


TEXTS = [
    'password = "abcdefghijkl" and token:short then API_KEY=\'0123456789ab\'', "secret: abcdefghijklmn", "AKIAABCDEFGHIJKLMN x AKIA12", "0123456789abcdef g ABCDEF0123456789", "paſsword=abcdefghijklm toKen=abcdefghijklm",
    "", None, "é password=abcdefghijkl", "passwd=password=abcdefghijkl", "a" * 100_000,
]


def brute(text):
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 18, 0), ("hex", r"[0-9a-f]+", 0, 16, 0)]
    found = [(m.start(), m.end(), k) for k, p, g, n, flags in kinds for m in re.finditer(p, text or "", flags) if len(m.group(g)) >= n]
    return sorted(found, key=lambda s: (s[0], [k[0] for k in kinds].index(s[2])))


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert secret_scan.base_spans(text or "") == brute(text)


def test_candidates_cover_long_runs():
    text = "a" * 11 + " " + "b" * 12 + " " + "c" * 40 + " " + "d" * 41 + " " + "e" * 130
    found = secret_scan.candidates(text)
    assert found[:4] == [(12, 24), (25, 65), (66, 106), (67, 107)]
    assert found[4][0] == 108 and found[-1][1] == len(text) and all(b - a <= 40 for a, b in found) and {c for a, b in found[4:] for c in range(a, b)} == set(range(108, 238))


def test_covered_is_overlap():
    rng = random.Random(1)
    for _ in range(300):
        spans = sorted((a, a + rng.randrange(1, 9), "hex") for a in (rng.randrange(60) for _ in range(rng.randrange(6))))
        covered = secret_scan._Covered(spans)
        for a in range(0, 70, 3):
            assert covered(a, a + 4) == any(s < a + 4 and a < e for s, e, _ in spans)


def test_many_findings_in_one_text():
    """Time grows with the text, not with its square."""
    import time

    rng = random.Random(3)
    text = "\n".join(f"{rng.getrandbits(64):016x}{rng.getrandbits(64):016x} someLongName{i:09d}" for i in range(30_000))
    began = time.process_time()
    spans = secret_scan.find([text, None], secret_scan.SecretModel())
    assert len(spans[0]) == 30_000 and spans[1] == [] and time.process_time() - began < 30


def test_secret_model(spark, quick):
    rng = random.Random(2)
    draw = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    words = lambda n: " ".join("".join(rng.choice(["an", "the", "tion", "er", "in", "ous"]) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    docs = [(i, f"{words(20)} password={draw(rng.randrange(14, 30))} {words(9)} token = \"{draw(40)}\" {words(5)}") for i in range(150)] + [(i, words(40)) for i in range(150, 300)]
    df = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string")
    model = secret_scan.fit(df)
    new = [(1, f"{words(5)} ghp_{draw(30, 'abcXYZ0189qrsTUV')} {words(5)}"), (2, words(60)), (3, None)]
    out = {r["doc_id"]: r["secrets"] for r in secret_scan.scan_secrets(spark.createDataFrame([(*n, 1) for n in new], "doc_id long, text string, secrets int"), model).collect()}
    inside = "/srv/app/v1/callback/" + draw(38, "abcXYZ0189qrsTUV") + "/deploy/production/eu/"
    at = secret_scan.find([f"{words(4)} {inside} {words(4)}"], model)[0]
    assert any(k == "model" for *_, k in at)
    rows = spark.createDataFrame([(1, "password=" + "Zq" * 9), (1, "password=" + "Zq" * 9), (None, "password=" + "Zq" * 9)], "doc_id long, text string")
    assert [len(r["secrets"]) for r in secret_scan.scan_secrets(rows, model).collect()] == [1, 1, 1]
    assert [s["kind"] for s in out[1]] == ["model"] and not out[1][0]["known"] and out[2] == [] == out[3]
    for r in secret_scan.scan_secrets(df, model).collect():  # base findings stay
        assert [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["known"]] == brute(r["text"])
        assert all(s["value"] == r["text"][s["start"] : s["end"]] for s in r["secrets"])
    assert secret_scan.fit(df.filter("doc_id < 0")).threshold > 1 and secret_scan.scan_secrets(df.limit(0), model).count() == 0


def test_secret_model_learns_from_findings_outside_the_sample(spark, quick, monkeypatch):
    """Findings beyond the sample change the network, and the threshold counts all held-out ones."""
    import xxhash

    monkeypatch.setattr(secret_scan, "SAMPLE", 30)
    monkeypatch.setattr(secret_scan, "LEAST", 1 - 1e-9)  # so that the secrets set the threshold
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice(["an", "the", "tion", "er", "in", "ous"]) for _ in range(6))
    texts = [f"{name()} password={draw(rng.randrange(14, 30))} {name()} {name()}" for _ in range(200)]

    def distinct(texts):
        out = {}
        for t in texts:
            covered = secret_scan._Covered(brute(t))
            for a, b in secret_scan.candidates(t):
                x = secret_scan.encode(t, a, b)
                out[int(covered(a, b)), xxhash.xxh64_intdigest(x.tobytes()) >> 1] = x
        return out

    found = distinct(texts)
    last = [sorted(h for label, h in found if label == k)[29] for k in (0, 1)]
    more = [t for t in (f"{name()} token={draw(30)} {name().upper()}" for _ in range(200)) if all(h > last[k] for k, h in distinct([t]))]
    assert len(more) > 20
    fit = lambda rows: secret_scan.fit(spark.createDataFrame([(t,) for t in rows], "text string").repartition(2))
    few, all_ = fit(texts), fit(texts + more)
    assert any(not np.allclose(few.p[k], all_.p[k], atol=1e-6) for k in few.p)
    scores = np.sort(all_.score(np.stack([x for (k, h), x in distinct(texts + more).items() if k == 1 and h % secret_scan.FOLDS == 0])))
    want = scores[len(scores) - math.ceil(secret_scan.RECALL * len(scores))]  # the highest that finds RECALL
    logit = lambda p: math.log(p / (1 - p))
    assert logit(want) - 2 * secret_scan.STEP < logit(all_.threshold) < logit(want) + 1e-3


def test_base_spans_of_drawn_texts():
    rng = random.Random(6)
    bits = ["Token", "api_KEY", "\u212a", "secret", "passwd", "pa\u017fword", "=", ": ", "'", "AKIA", "0123456789abcdef", "ABCDEF", "f" * 9, ".", "-", " ", "\n", "\u0130", "\U0001f600", "zz_+/"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert secret_scan.base_spans(text) == brute(text)


def test_lm_one_long_text_takes_few_windows(monkeypatch):
    """One lane only: the softmax still works on many places at once."""
    net, calls, plain = lm.WordNetwork(np.array([5, 3, 2, 1, 1])), [], lm.WordNetwork.log_probability
    monkeypatch.setattr(lm.WordNetwork, "log_probability", lambda self, h, y, grads=None: calls.append(len(y)) or plain(self, h, y, grads))
    net.score([np.random.default_rng(1).integers(0, 5, 20_000).astype(np.int32)])
    assert sum(calls) == 20_001 and len(calls) <= 3


def test_lm_classes_take_few_columns():
    """A token costs a column for each class and for each word of its own class."""
    counts = np.concatenate([[3e6, 4e4], 1e6 / np.arange(1, 8191)]).astype(np.int64)
    net = lm.WordNetwork(counts)
    sizes = np.diff(net.first)
    assert net.first[0] == 0 and net.first[1] == 1 and net.first[-1] == len(counts) and (sizes > 0).all() and list(net.of[net.first[:-1]]) == list(range(len(sizes)))
    assert len(sizes) + (sizes[net.of] * counts)[1:].sum() / counts.sum() < 125
    for n in (1, 2, 3, 40):
        few = lm.WordNetwork(np.zeros(n, np.int64))
        assert few.first[0] == 0 and few.first[-1] == n and (np.diff(few.first) > 0).all()


def test_lm_window_is_the_layer_step_by_step():
    net, rng = lm.WordNetwork(np.array([5, 3, 2, 1, 1])), np.random.default_rng(3)
    x, starts, h = rng.integers(0, 5, (9, 4)), rng.random((9, 4)) < 0.3, (rng.standard_normal((4, lm.HIDDEN)) * 0.3).astype(np.float32)
    table, want, state = net.p["embed"] @ net.p["w"] + net.p["b"], [], h
    for t in range(9):
        state, _ = net.step(table[x[t]], np.where(starts[t][:, None], 0, state))
        want.append(state)
    for keep in (True, False):
        states, _ = net._forward(x, starts, h.T, keep)
        assert np.allclose(states.transpose(0, 2, 1), want, atol=1e-5)


@pytest.mark.parametrize("scale", [1, 4000])
def test_lm_softmax_at_any_size(scale):
    """With and without shifts, against the logarithm of the softmax in double precision."""
    net, rng = lm.WordNetwork(np.arange(60, 0, -1)), np.random.default_rng(4)
    for k in ("c", "o"):
        net.p[k] *= scale
    h, y = rng.uniform(-1, 1, (200, lm.HIDDEN)).astype(np.float32), rng.integers(0, 60, 200)

    def softmax(z):
        z = z - z.max()
        return z - np.log(np.exp(z).sum())

    p = {k: v.astype(float) for k, v in net.p.items()}
    for state, target, log in zip(h.astype(float), y, net.log_probability(h, y)[0], strict=True):
        k = int(net.of[target])
        words = slice(net.first[k], net.first[k + 1])
        want = softmax(state @ p["c"] + p["cb"])[k] + softmax(p["o"][words] @ state + p["ob"][words])[target - words.start]
        assert abs(log - want) < 1e-4 * max(1, abs(want))
    assert net.log_probability(h[:0], y[:0])[0].shape == (0,)


@pytest.mark.parametrize("size", [1, 9, 1 << 22])
def test_lm_words_of_a_column_are_those_of_split(size):
    texts = ["A bC\nd", "", None, " é\x0bÉ\x0cx\x1cy ", "tail", "head tail", " \t\r\n", "　\x00a\x85b", "z"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array([None, "", " "]), pa.array([], pa.string())):
        got = [w.to_pylist()[a:b] for w, at in lm.words_of(column, size) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [(t or "").encode().lower().split() for t in column.to_pylist()]


def test_lm_counts_in_parts(monkeypatch):
    monkeypatch.setattr(lm, "_COUNTED", 5)
    texts = ["b A a", None, "a é", "", "b " * 20, "É c"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2])], ["text"]) for i in (0, 2, 4)]
    found, made = Counter(), list(lm._count(iter(batches)))
    for r in (r for b in made for r in b.to_pylist()):
        found[r["word"]] += r["n"]
    assert len(made) > 2 and found == {"a": 3, "b": 21, "é": 1, "É": 1, "c": 1, lm.END: 6}
    assert not list(lm._count(iter([])))


def test_lm_work_on_parameters_is_bounded(monkeypatch):
    """Scoring prepares the parameters once, not for each window; a window of training looks up its own words only."""
    net, calls = lm.WordNetwork(np.arange(3000, 0, -1)), []
    for name in ("_table", "_near"):
        plain = getattr(lm.WordNetwork, name)
        monkeypatch.setattr(lm.WordNetwork, name, lambda self, *a, name=name, plain=plain: calls.append((name, *map(len, a))) or plain(self, *a))
    docs = [np.random.default_rng(i).integers(0, 3000, 40_000).astype(np.int32) for i in range(2)]
    net.score(docs)
    assert sorted(calls) == [("_near",), ("_table",)] and net.near is None
    calls.clear()
    net.once([np.tile(np.arange(5, 15, dtype=np.int32), 30)], 4, net.moments(), lambda at: 0.001)
    assert 10 <= max(c[1] for c in calls if c[0] == "_table") <= 11
