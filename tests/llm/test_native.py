"""Mixing, decontamination and licence scan."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, entry, licenses
from millrace.llm.mixing import _distributions, mix, repetition_rates
from tests.compare import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(entry.queries()[name](spark, sf_dir), entry.SQL[name], sf_dir)


def _docs(spark):
    rows = [(i, "word " * (1 + i % 7), "en", f"s{i % 3}" if i % 11 else None, 5) for i in range(900)]
    rows += [(None, "x", None, "s0", 1), (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, "long " * 100_000, "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_meets_weights(spark):
    docs = _docs(spark).filter("n_chars = 5")
    out = mix(docs, {"s0": 3.0, "s1": 1.0})
    size = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert set(size) == {"s0", "s1"} and 2.3 < size["s0"] / size["s1"] < 3.9
    rates = {r["mr_group"]: r["mr_rate"] for r in repetition_rates(docs, {"s0": 3.0, "s1": 1.0}, "source", 1.0).collect()}
    assert rates["s2"] == 0 and rates["s0"] > rates["s1"]
    per = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert len(set(per.values())) > 2  # Poisson, not rounding


def test_mixing_edges(spark):
    docs = _docs(spark).withColumn("copy", F.lit("old")).withColumn("mr_u_", F.lit(1))
    out = mix(docs)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "mr_u_", "copy", "shuffle_key"]
    again = mix(docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert out.filter("source is null").count() > 0
    assert mix(docs.limit(0)).count() == 0


def test_mixing_without_broadcast(spark, monkeypatch):
    docs = _docs(spark)
    whole = sorted(map(str, mix(docs).collect()))
    monkeypatch.setattr("millrace.llm.mixing.MAX_BROADCAST_STEPS", 0)
    assert sorted(map(str, mix(docs).collect())) == whole


def test_mixing_at_a_very_high_rate(spark):
    """A tiny source beside a large one: a million copies of each of its documents."""
    docs = spark.createDataFrame([(i, "x" * 10, "tiny") for i in range(6)] + [(100, "x" * 120_000_000, "large")], "doc_id long, text string, source string")
    rate = {r["mr_group"]: r["mr_rate"] for r in repetition_rates(docs, None, "source", 1.0).collect()}["tiny"]
    assert rate == pytest.approx(1e6, rel=1e-3)
    n = [r["n"] for r in mix(docs).filter("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 6 and all(abs(x - rate) < 6 * rate**0.5 for x in n) and len(set(n)) > 4


def test_distributions_are_poisson(spark):
    import math

    rates = spark.createDataFrame([("a", 0.3), ("b", 9.5), ("c", 700.0), ("d", 0.0)], "mr_group string, mr_rate double")
    for r in _distributions(rates).join(rates, "mr_group").collect():
        if not r["mr_rate"]:
            assert r["mr_cdf"] is None
            continue
        total = math.fsum(math.exp(k * math.log(r["mr_rate"]) - r["mr_rate"] - math.lgamma(k + 1)) for k in range(r["mr_first"]))
        for k, c in enumerate(r["mr_cdf"], r["mr_first"]):
            total += math.exp(k * math.log(r["mr_rate"]) - r["mr_rate"] - math.lgamma(k + 1))
            assert c == pytest.approx(total, abs=1e-9)


def test_masks_miss_nothing():
    for n in range(5, 17):
        for gone in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            ok = set(range(n)) - set(gone)
            assert any(all(i + o in ok for o in m) for m in decontam.MASKS for i in range(n - m[-1]))


def _brute(docs, items):
    """Each item's places in each text: by four fifths of its tokens, or of 13 in a row that both hold."""
    out = {}
    for d, t in docs:
        h = (t or "").lower().split()
        for i, b in items:
            b = (b or "").lower().split()
            if d is None or not b:
                continue
            for at in range(-len(b), len(h) + 1):
                e = [0 <= at + j < len(h) and h[at + j] == b[j] for j in range(len(b))]
                runs = range(max(0, -at), min(len(b), len(h) - at) - 12)
                if sum(e) * 100 >= len(b) * 80 or any(sum(e[s : s + 13]) * 100 >= 13 * 80 for s in runs):
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (sum(e), -at, len(b)))
    return {(d, i, n, equal, -at) for (d, i), (equal, at, n) in out.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("millrace.llm.decontam.MAX_BROADCAST_SEEDS", 0)
        monkeypatch.setattr("millrace.llm.decontam.MAX_BROADCAST_HITS", 0)
    item = [f"w{k}" for k in range(20)]
    long = [f"q{k}" for k in range(200)]
    changed = [w if k % 5 else "zz" for k, w in enumerate(item)]
    docs = [(1, "a b " + " ".join(item).upper() + " c"), (2, " ".join(changed) + " x"), (3, " ".join(changed[:-1]) + " other"), (4, None), (5, ""), (None, " ".join(item)),
            (6, "\n".join(item[2:])), (7, " ".join(item) * 1), (7, "q " + " ".join(item)), (8, "pad " * 3_000 + " ".join(item)), (9, "one two three four"), (10, "one two three fore"),
            (11, " ".join(long[40:140])), (12, "start " + " ".join(long[:13])), (13, " ".join(long[:12])), (14, " ".join([*long[:30], "new", *long[30:60]])), (15, "at the end " + " ".join(long[-13:])),
            (16, "so yes indeed"), (17, "nobody"), (18, " ".join(long * 2)), (19, " ".join("zz" if k % 4 == 0 else w for k, w in enumerate(long)))]
    items = [(1, " ".join(item)), (2, "one two three four"), (3, None), (None, " ".join(item)), (4, "v w x y z"), (5, " ".join(long)), (6, "YES"), (7, "so yes"), (8, "two  three\tfour"), (9, ""), (4, "pad pad pad pad pad")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, d int").repartition(4)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, h int")
    found = {tuple(r[k] for k in ("doc_id", "item_id", "n_item", "n_equal", "at")) for r in decontam.find_passages(d, b).collect()}
    want = _brute(docs, [i for i in items if i[0] is not None])
    assert found == want and {(9, 2), (16, 6), (16, 7), (9, 8), (11, 5), (12, 5), (14, 5), (15, 5), (18, 5)} <= {x[:2] for x in found}
    assert not {10, 13, 17, 19} & {x[0] for x in found}
    kept = [r["doc_id"] for r in decontam.decontaminate(d, b).collect()]
    assert sorted(map(str, kept)) == sorted(["4", "5", "10", "13", "17", "19", "None"])
    assert decontam.find_passages(d.limit(0), b).count() == 0 == decontam.find_passages(d, b.limit(0)).count()


def test_decontamination_of_a_long_text_of_hits(spark):
    """A long item again and again, and one very long text."""
    item = [f"w{k % 300}" for k in range(1200)]
    d = spark.createDataFrame([(1, " ".join(item * 5)), (2, "pad " * 300_000 + " ".join(item[:50]))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r["doc_id"], r["n_equal"], r["at"]) for r in decontam.find_passages(d, b).collect()} == {(1, 1200, 0), (2, 50, 299_100)}


def test_licences(spark):
    mit = next(t for k, t in licenses.LICENSES if k == "MIT")
    docs = [(1, "Copyright (c) 2020 A. Author\n\n" + mit.replace(",", " ;").upper()), (2, mit + " more"), (3, None), (4, ""), (5, "text\n  RELEASED under the MIT  Licence!\nReleased under the MIT License."), (None, "Released under the MIT License."), (6, "Copyright 2021"), (7, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, digest int")
    found = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notice_lines"]) for r in licenses.scan_licenses(df).collect()}
    assert found[1] == ("MIT", "MIT", 1) and found[2][0] is None and found[5] == (None, "MIT", 2)
    assert found[3] == found[4] == found[6] == found[7] == (None, "", 0) and found[None] == ("MIT", "MIT", 1)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    own = spark.createDataFrame([("b", "My own, terms."), ("a", "my own terms"), (None, "zz"), ("e", "")], "license_id string, text string")
    mine = spark.createDataFrame([(1, "MY OWN TERMS")], "doc_id long, text string")
    assert licenses.scan_licenses(mine, own).first()["license_id"] == "a"


def _wrapped(text: str, width: int) -> str:
    import textwrap

    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))


def test_every_licence_however_it_is_wrapped(spark):
    """Under a claim of copyright, in lines of any width, in capitals: always itself."""
    forms = [lambda t: t, lambda t: _wrapped(t, 30), lambda t: _wrapped(t, 72).replace("\n", "\r\n"), lambda t: "Copyright (c) 2019-2024 Some Body. All rights reserved.\n\n" + _wrapped(t, 79), str.upper, lambda t: "© Some Body\n" + t]
    docs = [(i * 100 + k, f(t), name) for i, (name, t) in enumerate(licenses.LICENSES) for k, f in enumerate(forms)]
    found = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, name string")).collect()}
    assert [(i, found[i]) for i, _, name in docs if found[i] != name] == []


@pytest.mark.parametrize(
    "line, claim",
    [
        ("Copyright (c) 2020 A. Author", True), ("  (C) 1999 A", True), ("© A. Author", True), ("Copyright 2021", True), ("# Copyright: 2021 A", True), ("Copyright by A. Author", True), ("All rights reserved.", True),
        ("copyright notice and this permission notice appear in all copies.", False), ("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", False), ("(c) You must retain, in the Source form", False), ("all rights reserved by law are kept", False), ("the copyright 2020", False),
    ],
)
def test_copyright_lines(spark, line, claim):
    made = spark.createDataFrame([(line,)], "text string").select(licenses.canonical_lines(F.col("text"))[0]).first()[0]
    assert (made == "") == claim


def test_licences_of_repeated_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "none"), (2, "a\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (None, None), (3, "word " * 300_000)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, ((r["doc_id"], r["license_id"], r["notices"], r["n_notice_lines"]) for r in out.collect()))) == sorted(map(str, [(1, "MIT", "MIT", 1), (1, "MIT", "MIT", 1), (1, None, "", 0), (2, None, "CC-BY-4.0", 2), (None, None, "", 0), (3, None, "", 0)]))
