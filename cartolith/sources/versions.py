"""A table of upserts: buckets of Parquet files and a manifest for each version.

A version's manifest names the folder of each bucket. An upsert reads the buckets that its rows fall into, merges
them, writes these buckets anew into a folder of its own, and then commits by giving the next manifest its name,
which fails if it exists. Readers see whole versions only; what a lost attempt leaves is in no manifest. A
transaction's number is kept with its version, so repeating a batch changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer committed in between, again and again."""


@dataclass
class VersionedTable:
    """The table at path: rows are told apart by keys, and of rows of one key the one of the largest order counts.

    filled: each column takes its last value that isn't null, rather than the last row's, in whatever order upserts come. fixed: columns that
    keep their first value that isn't null. by: the key columns that buckets are dealt by (all keys, if none are named). Of equal order a
    later upsert wins (fixed: an earlier one), within one the row of the larger hash."""

    spark: SparkSession
    path: str
    keys: list[str]
    order: list[str]
    buckets: int = 64
    filled: bool = False
    fixed: tuple[str, ...] = ()
    by: list[str] = field(default_factory=list)

    def _at(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *names]))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._at("commits")
        return sorted(int(s.getPath().getName()[:-5]) for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last if none is named; before the first commit an empty one of version 0."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "parts": {}, "txns": {}}
        stream = self._fs().open(self._at("commits", f"{version if version is not None else known[-1]:020d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Whether the manifest became the version that it names."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        draft, at = self._at("commits", f".{uuid.uuid4().hex}"), self._at("commits", f"{manifest['version']:020d}.json")
        out = self._fs().create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, at, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.by or self.keys]), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        at = [f"{self.path.rstrip('/')}/{p}" for b, p in manifest["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last if none is named."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("the table has no version yet")
        out = self._read(manifest)
        return out.select(*[c for c in out.columns if not c.startswith("__place")])

    def _stamped(self, rows: DataFrame, version: int) -> DataFrame:
        """rows with the place in order of what they set: of the whole row, or (filled, fixed) of each column that isn't null."""
        parts = [*(F.col(f"`{c}`") for c in self.order), F.lit(version).cast("long").alias("version"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("hash")]
        place = F.struct(*parts)
        apart = [c for c in rows.columns if c not in self.keys and (self.filled or c in self.fixed)]
        return rows.select("*", place.alias("__place"), *[F.when(F.col(f"`{c}`").isNotNull(), place).alias(f"__place_{c}") for c in apart])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Rows of _stamped(), one of each key."""
        aggs = []
        for c in rows.columns:
            if c in self.keys or c.startswith("__place"):
                continue
            own = f"__place_{c}" if f"__place_{c}" in rows.columns else "__place"
            pick = "min" if c in self.fixed else "max"
            aggs.append(F.expr(f"{pick}_by(`{c}`, `{own}`)").alias(c))
            if own != "__place":
                aggs.append(F.expr(f"{pick}(`{own}`)").alias(own))
        return rows.groupBy(*self.keys).agg(*aggs, F.max("__place").alias("__place")).select(*rows.columns)

    def upsert(self, rows: DataFrame, txn: tuple[str, int] | None = None, remove: DataFrame | None = None, attempts: int = 5) -> int:
        """Merges rows in, after rows that remove (some of the key columns) names are taken out; the version that holds the result.

        txn: a writer's name and its batch number; a batch that isn't above the last one committed changes nothing.
        rows are read more than once: they must not change meanwhile."""
        for _ in range(attempts):
            now = self.manifest()
            if txn and now["txns"].get(txn[0], -1) >= txn[1]:
                return now["version"]
            new = self._stamped(rows, now["version"] + 1)
            now["schema"] = now["schema"] or new.schema.jsonValue()
            for f in now["schema"]["fields"]:
                f["nullable"] = True
            new = new.withColumn("__b", self._bucket())
            touched = {r["__b"] for r in new.select("__b").distinct().collect()}  # as many as there are buckets
            if remove is not None:
                gone = remove.distinct()
                whole = set(self.by or self.keys) <= set(gone.columns)
                touched |= {r["b"] for r in gone.select(self._bucket().alias("b")).distinct().collect()} if whole else set(map(int, now["parts"]))
            old = self._read(now, sorted(touched))
            if remove is not None:
                old = old.join(gone, gone.columns, "left_anti")
            folder = f"data/{uuid.uuid4().hex}"
            out = self._merged(old.unionByName(new.drop("__b"))).withColumn("__b", self._bucket()).hint("rebalance", "__b")
            out.write.partitionBy("__b").parquet(f"{self.path.rstrip('/')}/{folder}")
            fs = self._fs()
            parts = {b: p for b, p in now["parts"].items() if int(b) not in touched}
            parts |= {str(b): f"{folder}/__b={b}" for b in sorted(touched) if fs.exists(self._at(folder, f"__b={b}"))}
            if self._commit(now | {"version": now["version"] + 1, "parts": parts, "txns": now["txns"] | ({txn[0]: txn[1]} if txn else {})}):
                return now["version"] + 1
            fs.delete(self._at(folder), True)
        raise ConflictError(f"{attempts} attempts met other writers' commits")

    def evict(self, most: int) -> int:
        """Keeps the most rows of largest order, of equals those of the larger hash of their keys; 0 keeps all. The version that holds the result."""
        rows = self.read()
        n = rows.count()
        if not most or n <= most:
            return self.manifest()["version"]
        # the n - most rows that go are named by their keys
        place = [*(F.col(c) for c in self.order), F.xxhash64(*self.keys)]
        gone = rows.orderBy(*place).limit(n - most).select(*self.keys)
        return self.upsert(rows.limit(0), remove=gone)

    def vacuum(self, keep: int = 10, older_than_s: float = 86_400) -> int:
        """Deletes versions but the last keep, and folders that none of these names and that are older than a writer may take; how many folders went."""
        known, fs = self.versions(), self._fs()
        for v in known[:-keep]:
            fs.delete(self._at("commits", f"{v:020d}.json"), False)
        named = {p.split("/")[1] for v in known[-keep:] for p in self.manifest(v)["parts"].values()}
        before, n = (time.time() - older_than_s) * 1000, 0
        for s in fs.listStatus(self._at("data")) if fs.exists(self._at("data")) else []:
            if s.getPath().getName() not in named and s.getModificationTime() < before:
                n += fs.delete(s.getPath(), True)
        return n
