"""Tables in hash buckets whose changes become visible all at once, by one commit file.

A change writes new folders and then one numbered file that says which folders make up each bucket of each table. Readers take the
newest number, so they see all of a change or nothing; of two writers at once the second one fails. A change may have an id: once
committed, the same id changes nothing again, so a retried job is harmless. What a failed change left is never read; ``vacuum``
removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of the newest changes that a commit remembers.
REMEMBERED = 10_000
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was committed meanwhile."""


class VersionedTables:
    """Tables under one path. tables: by name their schema (or none: that of the first rows) and the columns whose hash gives the bucket."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[T.StructType | None, list[str]]], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket_of(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def _list(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def state(self) -> dict:
        """The newest commit: its number, the ids of changes, and the folders of each bucket of each table."""
        names = [x for x in self._list(f"{self.path}/commits") if x.endswith(".json")]
        if not names:
            return {"number": 0, "ids": [], "schemas": {}, "tables": {name: {} for name in self.tables}}
        stream = self._files.open(self._hadoop.Path(f"{self.path}/commits/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def schema(self, name: str, state: dict) -> T.StructType | None:
        known = state["schemas"].get(name)
        return T.StructType.fromJson(known) if known else self.tables[name][0]

    def write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Write rows to new folders that nothing reads yet; the folder of each bucket that has rows."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        if self.tables[name][0] is None:
            self.tables[name] = rows.schema, self.tables[name][1]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.tables[name][0]], self.bucket_of(name).alias(BUCKET))
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return {x.partition("=")[2]: f"{folder}/{x}" for x in self._list(f"{self.path}/{folder}") if x.startswith(f"{BUCKET}=")}

    def commit(self, before: dict, tables: dict[str, dict[str, list[str]]], id_: str | None) -> None:
        """Make ``tables`` (of those that change, all folders by bucket) the state after ``before``; fails if there is a newer one."""
        after = {"number": before["number"] + 1, "ids": [*before["ids"], *([id_] if id_ else [])][-REMEMBERED:], "tables": before["tables"] | tables}
        after["schemas"] = before["schemas"] | {name: self.tables[name][0].jsonValue() for name in tables if name not in before["schemas"] and self.tables[name][0] is not None}
        place = self._hadoop.Path(f"{self.path}/commits/{after['number']:012}.json")
        draft = self._hadoop.Path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(json.dumps(after).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(draft, place, never)  # never over a file
        except Exception as e:
            self._files.delete(draft, False)
            raise Conflict(f"{self.path} has a commit {after['number']}") from e

    def change(self, id_: str | None, how: Callable[[dict], dict[str, dict[str, list[str]]]]) -> bool:
        """Commit what ``how`` makes of the state, unless the id is committed already; whether it did."""
        before = self.state()
        if id_ is not None and id_ in before["ids"]:
            return False
        self.commit(before, how(before), id_)
        return True

    def read(self, name: str, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        state = state or self.state()
        own, schema = state["tables"][name], self.schema(name, state)
        folders = [f for b, x in own.items() if buckets is None or int(b) in buckets for f in x]
        if schema is None:
            raise ValueError(f"{name} has no rows and no schema yet")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, rows: dict[str, DataFrame], id_: str | None = None) -> bool:
        """Add rows to several tables in one change."""

        def added(before: dict) -> dict:
            new = {name: self.write(name, df) for name, df in rows.items()}
            return {name: {b: [*own.get(b, []), *([new[name][b]] if b in new[name] else [])] for b in {*own, *new[name]}} for name in rows for own in [before["tables"][name]]}

        return self.change(id_, added)

    def rewrite(self, name: str, touched: list[int], rows: DataFrame, before: dict) -> dict[str, list[str]]:
        """Folders of all buckets once ``rows`` stand in place of what the touched ones hold."""
        new = self.write(name, rows)
        kept = {b: x for b, x in before["tables"][name].items() if int(b) not in touched}
        return kept | {b: [f] for b, f in new.items()}

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of(name).alias(BUCKET)).distinct().collect())

    def vacuum(self) -> int:
        """Remove folders that the newest commit doesn't read, and older commits; how many folders went. No writer or old reader may be at work."""
        state, gone = self.state(), 0
        live = {f for own in state["tables"].values() for x in own.values() for f in x}
        for name in self.tables:
            for folder in (f"data/{name}/{x}" for x in self._list(f"{self.path}/data/{name}")):
                own = [f"{folder}/{x}" for x in self._list(f"{self.path}/{folder}")]
                dead = [f for f in own if f not in live] if live & {*own} else [folder]
                gone += sum(self._files.delete(self._hadoop.Path(f"{self.path}/{f}"), True) for f in dead)
        for file in self._list(f"{self.path}/commits"):
            if file != f"{state['number']:012}.json":
                self._files.delete(self._hadoop.Path(f"{self.path}/commits/{file}"), False)
        return gone


class KeyedTable(VersionedTables):
    """One table with unique keys, upserted in place: only buckets that a change touches are written again."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        super().__init__(spark, path, {"rows": (schema, keys)}, buckets)
        self.keys = keys

    def rows(self) -> DataFrame:
        return self.read("rows")

    def upsert(self, changes: DataFrame, id_: str | None = None, deleted: str | None = None) -> bool:
        """Put rows in place of those with their keys; where column ``deleted`` is true, remove them. Keys of changes are unique and not null."""

        def merged(before: dict) -> dict:
            touched = self.touched("rows", changes)
            old = self.read("rows", touched, before).join(changes.select(*self.keys), self.keys, "left_anti")
            new = changes.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
            return {"rows": self.rewrite("rows", touched, old.unionByName(new.select(*old.columns)), before)}

        return self.change(id_, merged)


def change_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What makes ``old`` into ``new``: their columns and ``change`` (insert, update, delete); unchanged rows are left out."""
    rest = [c for c in old.columns if c not in keys]
    pack = lambda df, side: df.select(*keys, F.struct(*rest).alias(side))
    both = pack(old, "_old").join(pack(new, "_new"), keys, "full")
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    both = both.withColumn("change", kind).filter("change is not null").withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "change")
