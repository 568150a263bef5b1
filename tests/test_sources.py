import json

import pytest

from millrace.operators.lineage import descendants
from millrace.operators.routing import Topology, route, unrouted
from millrace.schema import CsvSourceError
from millrace.sources.resumable import CsvSource, CsvStream, SequenceSource, SequenceStream


def write(tmp_path, data: bytes):
    p = tmp_path / "x.csv"
    p.write_bytes(data)
    return str(p)


def cells(source, cursor=None):
    return [{k: v for k, v in r.value.items() if not k.endswith("_number")} for r in source.open(cursor)]


@pytest.mark.parametrize("data", [b"a,b\r\n1,\r\n", b"\xef\xbb\xbfa,b\n1,\n", b'a,b\n1,""\n'])
def test_csv_forms(tmp_path, data):
    assert cells(CsvSource(write(tmp_path, data))) == [{"a": "1", "b": ""}]


def test_csv_resumes_anywhere(tmp_path):
    p = write(tmp_path, 'id,näme\n1,"a, ""b""\nc"\n2,é\n3, x\n'.encode())
    every = list(CsvSource(p).open())
    assert [r.value["line_number"] for r in every] == [3, 4, 5]
    for i, r in enumerate(every):
        assert [x.value for x in CsvSource(p).open(r.cursor)] == [x.value for x in every[i + 1 :]]


@pytest.mark.parametrize("data", [b"", b"a,a\n1,2\n", b"a,b\n1\n", b"a,b\n1,2,3\n", b"a,b\n\n1,2\n"])
def test_csv_shape_errors(tmp_path, data):
    with pytest.raises(CsvSourceError):
        cells(CsvSource(write(tmp_path, data)))


@pytest.mark.parametrize("cursor", ["", "[]", '{"version":2,"offset":0,"record":0,"line":0}', '{"version":1,"offset":true,"record":0,"line":0}'])
def test_csv_bad_cursor(tmp_path, cursor):
    with pytest.raises(CsvSourceError):
        cells(CsvSource(write(tmp_path, b"a\n1\n")), cursor)


def test_csv_change_and_fingerprint(tmp_path):
    p = write(tmp_path, b"a\n1\n")
    s = CsvSource(p)
    assert s.fingerprint != CsvSource(p, delimiter=";").fingerprint
    write(tmp_path, b"a\n1\n2\n")
    with pytest.raises(CsvSourceError):
        cells(s)
    assert CsvSource(p, fingerprint="v").fingerprint == CsvSource(p, fingerprint="v").fingerprint


def test_csv_bulk(spark, tmp_path):
    p = write(tmp_path, b'\xef\xbb\xbfa,b\n1,\n2,"x ""y""\nz"\n')
    assert sorted(map(tuple, CsvSource(p).bulk(spark).collect())) == [("1", ""), ("2", 'x "y"\nz')]


def test_sequence():
    s = SequenceSource(["a", "b"], "f")
    assert [r.cursor for r in s.open()] == ["1", "2"] and list(s.open("2")) == []
    for bad in ("3", "-1", "x"):
        with pytest.raises(ValueError):
            list(s.open(bad))


@pytest.mark.parametrize("kind", ["sequence", "csv"])
def test_streams_resume(spark, tmp_path, kind):
    spark.dataSource.register(SequenceStream)
    spark.dataSource.register(CsvStream)
    p = write(tmp_path, b"a\n" + b"".join(b"%d\n" % i for i in range(7)))
    for _ in range(2):
        reader = spark.readStream.format(f"millrace_{kind}").option("per_batch", 3)
        df = (reader.option("items", json.dumps(list(range(7)))) if kind == "sequence" else reader.option("path", p)).load()
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (7, 8)], "parent long, child long")
    roots = spark.createDataFrame([("x", 1), ("y", 7)], "execution_id string, node long")
    found = sorted(map(tuple, descendants(edges, roots).collect()))
    assert found == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 7), ("y", 8)]


def test_topology(spark):
    t = Topology({"audit": {"*"}, "sales": {"buy"}}).with_route("sales", "*")
    assert t.subscriptions_for("sell") == ["audit", "sales"]
    with pytest.raises(ValueError):
        Topology({"bad name": {"x"}})
    events = spark.createDataFrame([(1, "buy"), (2, "sell")], "id long, event_type string")
    assert route(events, t.frame(spark)).count() == 4
    assert unrouted(events, Topology({"s": {"buy"}}).frame(spark)).collect()[0]["id"] == 2


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin-1"])
def test_csv_line_ends(tmp_path, end, encoding):
    path = tmp_path / "x.csv"
    rows = ["a,b", "1,x", '2,"y"', "3,é"]
    path.write_bytes(end.join(rows).encode(encoding))
    source = CsvSource(f"file://{path}", encoding=encoding)
    records = list(source.open())
    assert [(r.value["a"], r.value["b"], r.value["record_number"]) for r in records] == [("1", "x", 1), ("2", "y", 2), ("3", "é", 3)]
    assert [r.value["a"] for r in source.open(records[0].cursor)] == ["2", "3"]


def test_csv_header_errors(tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,"b\n1,2\n')
    with pytest.raises(CsvSourceError):
        list(CsvSource(str(path)).open())
