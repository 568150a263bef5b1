"""Versioned tables on a shared file system with optimistic commits.

A commit is one small file, created exclusively, that names the parts of each table. Readers
see the newest commit whole; a writer that finds a newer one than its base fails and starts
anew where that one changed what it has read, and else is put on top. So one commit can
change several tables together, or none. Paths go through Spark's file systems; nothing is
written beside them.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import tempfile
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .schema import TABLES, MillraceError, upcast


class Conflict(MillraceError):
    """Another writer has committed first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used on a local master only; on a
    cluster that is an error, since other machines would not see the files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="millrace-")
    return f"file://{shared_dir.own}"


_made: dict[str, SparkSession] = {}


def _clean() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the session may have ended: then nothing can be deleted through it
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again.

    A lost executor costs no work before this point. The files go with drop_scratch(), or when
    Python ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables of scratch() that no later plan reads."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)
            for known in [k for k in _made if k.rpartition("/")[2] == path.rpartition("/")[2]]:
                del _made[known]


#: What names a row of each table.
KEYS = {
    "messages": ["id"], "checkpoints": ["bus_name", "checkpoint_name"], "executions": ["execution_id"], "deliveries": ["execution_id", "message_id"],
    "edges": ["parent_message_id", "child_message_id"], "runtime": ["execution_id"],
}
#: Columns of a part of changes beside the table's: the version it was made for, whether the row goes.
VERSION, DELETED = "mr_version", "mr_deleted"
#: Keys of changes are broadcast up to so many bytes of their parts; beyond, joined.
BROADCAST_BYTES = 64_000_000
#: So many parts of a queue (or table) are merged after a commit; parts of rows from SMALL_BYTES on stay as they are.
MANY_PARTS, SMALL_BYTES = 24, 64_000_000
#: So many commits' files stay, for writers that look back at those after their base.
OLD_COMMITS = 200


@dataclass
class Change:
    """What a commit adds to a table: rows, or (kind 'changes') whole rows that replace those of their
    keys, deleting where a column mr_deleted is true. queue: that of all rows, where it is known."""

    rows: DataFrame
    kind: str = "rows"
    queue: str | None = None


def changed(rows: DataFrame, queue: str | None = None) -> Change:
    return Change(rows, "changes", queue)


def removed(keys: DataFrame, queue: str | None = None) -> Change:
    """keys: the key columns of rows that go (and queue, of messages)."""
    return Change(keys.withColumn(DELETED, F.lit(True)), "changes", queue)


def _marked(name: str) -> StructType:
    return StructType([*TABLES[name], StructField(VERSION, LongType()), StructField(DELETED, BooleanType())])


class Store:
    """Tables messages, checkpoints, executions, deliveries, edges and runtime under one folder.

    A table is a list of parts. A part of rows adds rows; a part of changes holds whole rows
    that replace those with the same key in all parts before it, or delete them. Readers merge
    the two; a commit writes what changed and no more. Parts of messages name their queues, so
    that a reader of one queue opens no other's files. compact() merges parts, small ones with
    small ones.
    """

    def __init__(self, spark: SparkSession, path: str, *, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    # --- files

    def _names(self, folder: str) -> list[str]:
        fs, p = _fs(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> dict:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, name: str, body: dict) -> None:
        """Write a file that must not exist, whole or not at all: under another name first, then by a step
        that fails where the name exists (a rename, or a link on a local disk)."""
        folder = name.rpartition("/")[0]
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        temp, tp = _fs(self.spark, f"{self.path}/{folder}/.{uuid.uuid4().hex}")
        out = temp.create(tp, False)
        try:
            out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename would replace the file
                os.link(tp.toUri().getPath(), p.toUri().getPath())
            elif fs.exists(p) or not fs.rename(tp, p):
                raise FileExistsError(name)
        finally:
            if fs.exists(tp):
                fs.delete(tp, False)

    def _bytes(self, path: str) -> int:
        fs, p = _fs(self.spark, f"{self.path}/{path}")
        return fs.getContentSummary(p).getLength()

    # --- reading

    def version(self) -> int:
        found = [int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json")]
        return max(found, default=0)

    def commit_at(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "last_id": 0, "scope": []}
        found = self._read(f"commits/{version:012d}.json")
        # commits of the first form named one whole folder for each table
        found["tables"] = {k: [{"path": v, "kind": "rows", "queues": None, "bytes": 0}] if isinstance(v, str) else v for k, v in found["tables"].items()}
        return found

    def parts(self, name: str, version: int | None = None, queue: str | None = None) -> list[dict]:
        found = self.commit_at(self.version() if version is None else version)["tables"].get(name, [])
        return [p for p in found if queue is None or p["queues"] is None or queue in p["queues"]]

    def table(self, name: str, version: int | None = None, queue: str | None = None) -> DataFrame:
        """A table as of a version (the newest by default), in today's columns; of messages, one queue's."""
        out = self._merged(name, self.parts(name, version, queue))
        return out if queue is None else out.filter(F.col("queue") == queue)

    def _merged(self, name: str, parts: list[dict]) -> DataFrame:
        schema, key = TABLES[name], KEYS[name]
        rows, changes = ([p for p in parts if p["kind"] == kind] for kind in ("rows", "changes"))
        out = self._files(rows, schema) if rows else self.spark.createDataFrame([], schema)
        if not changes:
            return out
        newest = self._changes(name, changes)
        gone = newest.select(*key)
        if sum(p["bytes"] for p in changes) <= BROADCAST_BYTES:
            gone = F.broadcast(gone)
        return out.join(gone, key, "left_anti").select(*out.columns).unionByName(newest.filter(F.coalesce(~F.col(DELETED), F.lit(True))).select(*out.columns))

    def _files(self, parts: list[dict], schema: StructType) -> DataFrame:
        """Rows of parts; columns that a file of an older version lacks are null."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['path']}" for p in parts])

    def _changes(self, name: str, changes: list[dict]) -> DataFrame:
        """The last change of each key."""
        key, found = KEYS[name], self._files(changes, _marked(name))
        if len(changes) == 1:  # a commit changes a key once
            return found
        last = found.groupBy(*key).agg(F.max(VERSION).alias(VERSION))
        return found.join(last, [*key, VERSION])

    # --- writing

    def reserve(self, n: int) -> int:
        """n ids after the returned one, which no other writer gets. Those that a failed commit doesn't use are skipped."""
        fs, p = _fs(self.spark, f"{self.path}/ids")
        fs.mkdirs(p)
        while True:
            held = [x for x in self._names("ids") if x.endswith(".json")]
            top = max(self._read(f"ids/{held[-1]}")["top"] if held else 0, 0 if held else self.commit_at(self.version())["last_id"])
            with contextlib.suppress(FileExistsError):
                self._create(f"ids/{int(held[-1].removesuffix('.json')) + 1 if held else 1:012d}.json", {"top": top + n})
                for old in held[:-8]:
                    of, op = _fs(self.spark, f"{self.path}/ids/{old}")
                    of.delete(op, False)
                return top

    def _written(self, base: int, name: str, kind: str, df: DataFrame, queue: str | None = None) -> list[dict]:
        """Write a part; of messages, one for each queue."""
        path, schema = f"data/{name}-{uuid.uuid4().hex}", TABLES[name]
        if kind == "changes":
            df, schema = df.withColumn(VERSION, F.coalesce(F.col(VERSION), F.lit(base + 1)) if VERSION in df.columns else F.lit(base + 1)), _marked(name)
        df = upcast(df, schema)
        if name != "messages" or queue is not None:
            df.write.parquet(f"{self.path}/{path}")
            return [{"path": path, "kind": kind, "queues": [queue] if queue else None, "bytes": self._bytes(path)}]
        df.withColumn("mr_queue", F.col("queue")).write.partitionBy("mr_queue").parquet(f"{self.path}/{path}")
        folders = [f for f in self._names(path) if f.startswith("mr_queue=")]
        return [{"path": f"{path}/{f}", "kind": kind, "queues": [unquote(f.partition("=")[2])], "bytes": self._bytes(f"{path}/{f}")} for f in folders]

    def commit(self, base: int, changes: dict[str, list[Change]], scope: Iterable[str] = ("*",), **facts) -> int:
        """Write parts and make them a version after base, or raise Conflict.

        scope names what the changes were derived from: where a commit after base has a name in
        common (or either has "*"), this one fails; else it is put on top of it. So writers of
        different queues don't meet. Facts are kept in the commit (last_id only grows).
        """
        scope = sorted(set(scope))
        added = {n: [p for c in some for p in self._written(base, n, c.kind, c.rows, c.queue)] for n, some in changes.items()}
        at = base
        while True:
            old = self.commit_at(at)
            tables = dict(old["tables"])
            for name, parts in added.items():
                tables[name] = [*tables.get(name, []), *parts]
            body = {**old, **facts, "tables": tables, "scope": scope, "last_id": max(old["last_id"], facts.get("last_id") or 0)}
            try:
                self._create(f"commits/{at + 1:012d}.json", body)
                return at + 1
            except FileExistsError:
                other = self.commit_at(at + 1).get("scope", ["*"])
                if "*" in scope or "*" in other or set(scope) & set(other):
                    raise Conflict(f"version {at + 1} has changed the same") from None
                at += 1

    def change(self, f: Callable[[int, Store], tuple[dict[str, list[Change]], dict]], scope: Iterable[str] = ("*",), *, seconds: float = 30) -> int:
        """Run f on the newest version and commit what it returns; again while others change the same first."""
        until, pause = time.monotonic() + seconds, 0.005
        while True:
            base = self.version()
            changes, facts = f(base, self)
            if not changes:
                return base
            try:
                done = self.commit(base, changes, scope, **facts)
            except Conflict:
                if time.monotonic() > until:
                    raise
                time.sleep(pause)
                pause = min(pause * 2, 0.1)
                continue
            self._tidy(done, set(changes))
            return done

    # --- keeping

    def _tidy(self, version: int, names: set[str]) -> None:
        for name in names:
            counts = Counter((p["queues"] or [None])[0] for p in self.parts(name, version))
            for queue, n in counts.items():
                if n > MANY_PARTS:
                    with contextlib.suppress(Conflict):  # the next writer will try again
                        self.compact(name, queue)

    def compact(self, name: str, queue: str | None = None) -> int:
        """Merge the parts that hold just this queue (or, for None, those without queues); returns how many went.

        Changes become one part with the last of each key; where they are more than half of the
        rows' bytes, rows and changes become one part of rows. Otherwise of the parts of rows only
        those under SMALL_BYTES are put together, so large ones aren't written again and again.
        """
        base = self.version()
        old = self.commit_at(base)
        parts = old["tables"].get(name, [])
        mine = [p for p in parts if p["queues"] == ([queue] if queue else None)]
        rows, changes = ([p for p in mine if p["kind"] == kind] for kind in ("rows", "changes"))
        others = [p for p in parts if p not in mine and (queue is None or p["queues"] is None or queue in p["queues"])]
        made, gone = [], []
        # changes may go only with all rows that they replace
        if changes and not others and sum(p["bytes"] for p in changes) * 2 > sum(p["bytes"] for p in rows):
            made += self._written(base, name, "rows", self._merged(name, mine), queue)
            gone = mine
        else:
            small = [p for p in rows if p["bytes"] < SMALL_BYTES]
            if len(small) > 1:
                made += self._written(base, name, "rows", self._files(small, TABLES[name]), queue)
                gone += small
            if len(changes) > 1:
                made += self._written(base, name, "changes", self._changes(name, changes), queue)
                gone += changes
        if not gone:
            return 0
        kept = [p for p in parts if p not in gone]
        scope = [f"{name}:{queue}" if queue else name, *([] if queue else ["*"])]
        body = {**old, "tables": {**old["tables"], name: [*made, *kept]}, "scope": scope}
        try:
            self._create(f"commits/{base + 1:012d}.json", body)
        except FileExistsError:
            raise Conflict(f"version {base + 1} exists") from None
        return len(gone)

    def vacuum(self) -> int:
        """Merge parts, then delete folders that none of the last keep versions names, and the files of commits
        long before them; returns how many folders."""
        tables = self.commit_at(self.version())["tables"]
        for name, parts in tables.items():
            for q in {(p["queues"] or [None])[0] for p in parts}:
                with contextlib.suppress(Conflict):
                    self.compact(name, q)
        newest = self.version()
        held = {"/".join(p["path"].split("/")[:2]) for v in range(max(1, newest - self.keep + 1), newest + 1) for parts in self.commit_at(v)["tables"].values() for p in parts}
        gone = [n for n in self._names("data") if f"data/{n}" not in held]
        for n in gone:
            fs, p = _fs(self.spark, f"{self.path}/data/{n}")
            fs.delete(p, True)
        for n in self._names("commits"):
            if n.endswith(".json") and int(n.removesuffix(".json")) <= newest - max(self.keep, OLD_COMMITS):
                fs, p = _fs(self.spark, f"{self.path}/commits/{n}")
                fs.delete(p, False)
        return len(gone)

    def backup(self, target: str) -> dict:
        """Copy the newest version to a new folder: written beside it, read back, counted, then renamed."""
        fs, goal = _fs(self.spark, target)
        if fs.exists(goal):
            raise FileExistsError(target)
        if target.rstrip("/").startswith(self.path + "/"):
            raise ValueError("a backup must lie outside its source")
        version, temp = self.version(), f"{target}.{uuid.uuid4().hex}"
        copy, counts = Store(self.spark, temp), {}
        old = self.commit_at(version)
        copy.commit(0, {n: [Change(self.table(n, version))] for n in old["tables"]}, last_id=old["last_id"])
        for n in old["tables"]:
            counts[n] = self.table(n, version).count()
            if copy.table(n).count() != counts[n]:
                raise MillraceError(f"the copy of {n} differs")
        if not fs.rename(_fs(self.spark, temp)[1], goal):
            raise FileExistsError(target)
        return {"version": version, "rows": counts}

    def metrics(self) -> dict:
        """Bytes and folders held, newest version."""
        fs, p = _fs(self.spark, self.path)
        size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return {"version": self.version(), "bytes": size, "folders": len(self._names("data"))}
