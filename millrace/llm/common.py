"""What the operators of this subpackage share: shared storage, columns, text rules."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import drop_scratch as drop_shared
from ..store import scratch as write_shared

#: Fixed value: the characters that separate words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"

def bound_batches(spark: SparkSession) -> None:
    """For the queries and the pipeline, which own their session: batches of 8 MB to Python tasks, where the
    session leaves Spark's default of 64 MB, so that several tasks fit in a small executor. The
    operators themselves change no setting."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n: int):
    """crc32 of the id as text, mod n, as a column: which fold a document is in."""
    return F.crc32(doc_id.cast("string")) % n


def lower_ascii(c):
    """Lower-case A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches, column: str | int, size: int = 1 << 22):
    """Arrow batches cut so that the texts of column take about size bytes in each; no row is cut.

    (Spark itself bounds what it sends to a Python task by bytes, spark.sql.execution.arrow.maxBytesPerBatch.)
    """
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(lengths, dtype=np.int64), 0
        while first < batch.num_rows or first == batch.num_rows == 0:
            before = ends[first - 1] if first else 0
            last = min(max(int(np.searchsorted(ends, before + size, side="right")), first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            if last >= batch.num_rows:
                break
            first = last


def averaged(networks: DataFrame, sums: int = 4, fan_in: int = 64) -> np.ndarray | None:
    """The mean of vectors p (float32, as bytes) by their weights n; with no rows, none. sums go to the driver, at most."""
    import pyarrow as pa

    def summed(batches):
        n, p = 0, 0.0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, p = n + k, p + k * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(p / n).astype(np.float32).tobytes()], pa.binary())], ["n", "p"])

    parts = write_shared(networks, "networks")
    while (tasks := parts.count()) > sums * fan_in:  # averages of averages: no task reads more than some fan_in networks
        fewer = write_shared(parts.repartition(-(-tasks // fan_in)).mapInArrow(summed, "n long, p binary"), "networks")
        drop_shared(parts)
        parts = fewer
    rows = parts.coalesce(sums).mapInArrow(summed, "n long, p binary").collect()
    drop_shared(parts)
    if not rows:
        return None
    total = sum(r["n"] * np.frombuffer(r["p"], np.float32).astype(np.float64) for r in rows)
    return (total / sum(r["n"] for r in rows)).astype(np.float32)


def group_runs(batches, names: tuple[str, ...]):
    """Whole groups of rows with equal values in names of a sorted stream of Arrow batches, several
    at a time: a table, and where its groups begin."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        held = np.stack([t.column(k).to_numpy() for k in names])
        cuts = np.flatnonzero((held[:, 1:] != held[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield t.slice(0, cuts[-1]), np.append(0, cuts[:-1])
        rest = t.slice(cuts[-1]) if len(cuts) else t
    if rest is not None:
        yield rest, np.zeros(1, int)


def groups(batches, names: tuple[str, ...]):
    """The same, one group at a time."""
    for t, starts in group_runs(batches, names):
        for x, y in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            yield t.slice(x, y - x)


@contextlib.contextmanager
def one_thread():
    """Small matrix products on one thread: tasks already fill the cores. Where numpy's own
    library isn't an OpenBLAS that can be found, its setting stays."""
    put = get = None
    maps = Path("/proc/self/maps")
    for path in {x.split()[-1] for x in maps.read_text().splitlines() if "openblas" in x} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for form in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(library, form.format("set")):
                put, get = getattr(library, form.format("set")), getattr(library, form.format("get"))
                break
    before = get() if get else 0
    if put:
        put(1)
    try:
        yield
    finally:
        if put:
            put(before)


# --- vectorised words of UTF-8 text ---------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, _BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def blocks(column, size: int = _BLOCK) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """Of an Arrow string column: runs of rows of about size bytes, as (first row, bytes, offsets).

    A null counts as empty text. A row is never cut; a row over the size is a run of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased; and where each row's words begin (with the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)  # a word begins or has ended here
    edge[1:n] = word[1:] != word[:-1]
    edge[0], edge[n] = word[0], word[-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[word[inner] & word[inner - 1]]  # one row's word ends where the next row's begins
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, np.unique(both), np.unique(both)]))
    starts, ends = at[0::2], at[1::2]
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)
