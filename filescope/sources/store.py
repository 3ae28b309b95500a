"""Tables whose rows change: hash buckets, change sets on top of a base, and one commit file a version.

Every table is keyed by `id` and dealt into buckets by the file its rows belong to, so that a file's rows of all tables
lie in buckets of the same number. Writing adds a folder of changed rows; deleting adds the files' ids once, for all
tables. A version is a small JSON file that names the folders that count, and is made only if no other writer has made
it meanwhile; folders that no version names are of writers that failed. Readers take one version, and see it whole.

Compaction rewrites the buckets that have changes and leaves the others where they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: The catalogue's tables, by the column that names the file a row belongs to.
TABLES = {"files": "id", "findings": "file_id", "analyses": "file_id", "messages": "file_id"}


class Conflict(RuntimeError):
    """Another writer has made the version: read again, and try again."""


class Store:
    """Tables under a folder of any store that Spark writes to. `buckets` is fixed when the first version is made."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), dict(tables or TABLES)
        found = self._latest()
        self.buckets = found["buckets"] if found else buckets

    # --- versions -----------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        system, folder = self._hadoop(f"{self.path}/_commits")
        if not system.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in system.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def _read(self, version: int) -> dict:
        # One small file, by Spark's reader: its lines come in order from one partition.
        return json.loads("".join(r[0] for r in self.spark.read.option("wholetext", "true").text(f"{self.path}/_commits/{version:012d}.json").collect()))

    def _latest(self) -> dict | None:
        own = self.versions()
        return self._read(own[-1]) if own else None

    def _state(self, version: int | None = None) -> dict:
        found = self._latest() if version is None else self._read(version)
        return found or {"version": 0, "buckets": self.buckets, "base": {t: {} for t in self.tables}, "changes": [], "schemas": {}}

    def _commit(self, state: dict) -> int:
        version = state["version"] + 1
        state = state | {"version": version}
        system, target = self._hadoop(f"{self.path}/_commits/{version:012d}.json")
        _, own = self._hadoop(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        with_text = system.create(own, False)
        with_text.write(bytearray(json.dumps(state).encode()))
        with_text.close()
        try:  # a rename onto a file that is there fails, or says so
            made = not system.exists(target) and system.rename(own, target)
        except Exception as e:  # noqa: BLE001 - py4j wraps whatever the file system throws
            raise Conflict(str(e)) from e
        if not made:
            system.delete(own, False)
            raise Conflict(f"version {version} is there")
        return version

    # --- writing ------------------------------------------------------

    def bucket(self, file: Column) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, file: str) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket(F.col(file)))
        rows.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, tables: dict[str, DataFrame]) -> int:
        """A version with these rows in place of those with the same id, which stay with their file. Of rows that repeat an id, one; null ids go."""
        state = self._state()
        changes, schemas = [], dict(state["schemas"])
        for name, df in tables.items():
            rows = df.filter("id is not null").dropDuplicates(["id"])
            plain = StructType([StructField(f.name, f.dataType) for f in df.schema]).json()  # nulls are allowed everywhere
            if schemas.setdefault(name, plain) != plain:
                raise ValueError(f"{name} has other columns in the store")
            changes.append({"table": name, "folder": self._write(rows, self.tables[name])})
        return self._commit(state | {"changes": [*state["changes"], {"version": state["version"] + 1, "rows": changes}], "schemas": schemas})

    def delete(self, ids: DataFrame) -> int:
        """A version without these files (id) and what belongs to them; a file that is written again later is there again."""
        state = self._state()
        folder = self._write(ids.select("id").filter("id is not null").distinct(), "id")
        return self._commit(state | {"changes": [*state["changes"], {"version": state["version"] + 1, "gone": folder}]})

    # --- reading ------------------------------------------------------

    def _folder(self, folder: str, schema=None) -> DataFrame:
        own = self.spark.read.schema(schema.add("_bucket", IntegerType()) if schema is not None else "id string, _bucket int")
        return own.parquet(f"{self.path}/{folder}")

    def _schema(self, state: dict, table: str) -> StructType:
        if table not in state["schemas"]:
            raise LookupError(f"{table} has no rows yet")
        return StructType.fromJson(json.loads(state["schemas"][table]))

    def _merged(self, state: dict, table: str, only: Column | None = None) -> DataFrame:
        """The rows of a version with their _bucket, of the buckets that `only` (of _bucket) keeps."""
        file, schema = self.tables[table], self._schema(state, table)
        names = schema.fieldNames()
        kept = (lambda df: df.filter(only)) if only is not None else (lambda df: df)
        read = lambda folder: kept(self._folder(folder, self._schema(state, table)))
        parts = {}
        for bucket, folder in state["base"][table].items():
            parts.setdefault(folder, []).append(int(bucket))
        out = None
        for folder, own in parts.items():
            some = read(folder).filter(F.col("_bucket").isin(own)).withColumn("_version", F.lit(0))
            out = some if out is None else out.unionByName(some)
        changed = None
        for c in state["changes"]:
            for r in c.get("rows", []):
                if r["table"] == table:
                    some = read(r["folder"]).withColumn("_version", F.lit(c["version"]))
                    changed = some if changed is None else changed.unionByName(some)
        if changed is not None:
            # The base is not gathered: only what has changed is, and its ids are taken out of the base.
            last = changed.groupBy("id").agg(F.max_by(F.struct("_bucket", "_version", *(n for n in names if n != "id")), "_version").alias("x")).select("id", "x.*")
            out = last if out is None else out.join(last.select(F.col("id").alias("_id"), F.col("_bucket").alias("_in")), (F.col("id") == F.col("_id")) & (F.col("_bucket") == F.col("_in")), "left_anti").unionByName(last)
        if out is None:
            out = self.spark.createDataFrame([], schema.add("_bucket", IntegerType()).add("_version", IntegerType()))
        gone = None
        for c in state["changes"]:
            if "gone" in c:
                some = kept(self._folder(c["gone"])).select("id", "_bucket").withColumn("_at", F.lit(c["version"]))
                gone = some if gone is None else gone.unionByName(some)
        if gone is not None:
            gone = gone.groupBy(F.col("id").alias("_gone"), F.col("_bucket").alias("_in")).agg(F.max("_at").alias("_at"))
            out = out.join(gone, (F.col(file) == F.col("_gone")) & (F.col("_bucket") == F.col("_in")) & (F.col("_at") > F.col("_version")), "left_anti")
        return out.select(*names, "_bucket")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last if none is given."""
        return self._merged(self._state(version), table).drop("_bucket")

    def lookup(self, table: str, file: str) -> DataFrame:
        """The rows of one file: other buckets are not read."""
        state = self._state()
        # The bucket is a number when the plan is made, so that partitions are pruned.
        number = self.spark.range(1).select(self.bucket(F.lit(file))).first()[0]
        return self._merged(state, table, F.col("_bucket") == number).filter(F.col(self.tables[table]) == file).drop("_bucket")

    # --- compaction ---------------------------------------------------

    def compact(self) -> int:
        """A version with the same rows and no changes: buckets with changes are written anew, others stay where they are."""
        state = self._state()
        folders = [(r["table"], r["folder"]) for c in state["changes"] for r in c.get("rows", [])]
        gone = [c["gone"] for c in state["changes"] if "gone" in c]
        base = {t: dict(b) for t, b in state["base"].items()}
        for table in self.tables:
            if table not in state["schemas"]:
                continue
            touched = self._touched([f for t, f in folders if t == table] + gone)
            if not touched:
                continue
            rows = self._merged(state, table, F.col("_bucket").isin(touched)).drop("_bucket")
            folder = self._write(rows, self.tables[table])
            filled = set(self._touched([folder]))
            for b in touched:
                base[table].pop(str(b), None)
                if b in filled:
                    base[table][str(b)] = folder
        return self._commit(state | {"base": base, "changes": []})

    def _touched(self, folders: list[str]) -> list[int]:
        """The buckets that folders have, by their names."""
        out = set()
        for folder in folders:
            system, target = self._hadoop(f"{self.path}/{folder}")
            out |= {int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(target) if f.getPath().getName().startswith("_bucket=")}
        return sorted(out)

    def vacuum(self) -> int:
        """Delete the folders that the last version does not name; earlier versions can't be read any more. Gives how many."""
        state = self._state()
        named = {f for b in state["base"].values() for f in b.values()} | {r["folder"] for c in state["changes"] for r in c.get("rows", [])} | {c["gone"] for c in state["changes"] if "gone" in c}
        system, folder = self._hadoop(f"{self.path}/data")
        old = [f.getPath() for f in system.listStatus(folder) if f"data/{f.getPath().getName()}" not in named] if system.exists(folder) else []
        for p in old:
            system.delete(p, True)
        return len(old)
