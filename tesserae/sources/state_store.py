"""Keyed state in files: point lookups, deletes by key and atomic replacement of rows in several tables at once.

Rows of all tables of a store are bucketed by one column, the owner (a sector, a campaign), so what belongs to an owner is in one bucket of each table. A commit writes the touched
buckets anew into a folder of its own and then adds a manifest, which names the folder of every bucket. Readers take the newest manifest, so they see all of a commit or none
of it; a writer that fails or loses the race leaves files that nothing names and ``vacuum`` deletes. The driver holds one manifest, whose size is tables times buckets.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.checks import required


class ConflictError(RuntimeError):
    """Another writer has committed since the state that this one began from."""


class StateStore:
    """Tables of rows with keys; ``tables`` gives the key columns of each, and ``owner`` is a column that all of them have."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, ...]], owner: str, buckets: int = 64):
        self.spark, self.path, self.tables, self.owner, self.buckets = spark, path.rstrip("/"), tables, owner, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def version(self) -> int:
        """The number of the newest commit, 0 before the first."""
        return max((int(n) for n in self._names("manifests") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The folders of all buckets and the schemas of all tables as of a commit."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schemas": {}, "buckets": {}}
        stream = self._files.open(self._path(f"manifests/{version:012}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.owner).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, table: str, owners: DataFrame | list | None = None, manifest: dict | None = None) -> DataFrame:
        """Rows of a table: all, those of a list of owners, or of a table of them. Only their buckets are read."""
        manifest = manifest or self.manifest()
        schema = manifest["schemas"].get(table)
        if schema is None:
            raise KeyError(f"table {table} holds nothing yet")
        held = manifest["buckets"][table]
        if isinstance(owners, list):
            kind = StructType.fromJson(schema)[self.owner].dataType
            owners = self.spark.createDataFrame([(x,) for x in owners], StructType().add(self.owner, kind))
        wanted = held if owners is None else {str(r[0]) for r in owners.select(self._bucket()).distinct().collect()} & held.keys()  # one number for each bucket at most
        rows = self._rows(table, [held[b] for b in sorted(wanted)], schema)
        return rows if owners is None else rows.join(owners.select(self.owner).distinct(), self.owner, "left_semi")

    def _rows(self, table: str, folders: list[str], schema: dict) -> DataFrame:
        kind = StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], kind)

    def put(self, rows: dict[str, DataFrame], replace: bool = False) -> int:
        """Rows of one or more tables, in one commit; those of equal keys are replaced. With ``replace``, all that the owners in any of ``rows`` had in these tables goes.

        Keys that are null or occur twice fail the commit, as does anything that fails while the rows are computed; the state is then what it was.
        """
        owners = reduce(DataFrame.unionByName, [df.select(self.owner) for df in rows.values()]).distinct() if replace else None
        return self._commit(lambda base: {t: self._merged(t, df, base, owners) for t, df in rows.items()})

    def delete(self, owners: DataFrame | list) -> int:
        """Delete all rows of some owners from all tables, in one commit."""

        def without(base: dict) -> dict:
            out = {}
            for table in base["schemas"]:
                gone = owners if isinstance(owners, DataFrame) else self.spark.createDataFrame([(x,) for x in owners], StructType().add(self.owner, StructType.fromJson(base["schemas"][table])[self.owner].dataType))
                touched = self._touched(gone)
                old = self._rows(table, [f for b, f in base["buckets"][table].items() if b in touched], base["schemas"][table])
                out[table] = (old.join(gone.select(self.owner).distinct(), self.owner, "left_anti"), touched)
            return out

        return self._commit(without)

    def _touched(self, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}

    def _merged(self, table: str, new: DataFrame, base: dict, owners: DataFrame | None) -> tuple[DataFrame, set[str]]:
        keys = list(self.tables[table])
        count = new.groupBy(*keys).agg(F.count("*").alias("__n"))
        checked = new.join(count, keys, "left").withColumn(keys[0], required(F.col(keys[0]), F.col("__n") == 1, "a key is null or occurs twice").cast(new.schema[keys[0]].dataType)).select(*new.columns)
        touched = self._touched(new if owners is None else owners)
        if table not in base["schemas"]:
            return checked, touched
        old = self._rows(table, [f for b, f in base["buckets"][table].items() if b in touched], base["schemas"][table])
        left = old.join(new.select(*keys).distinct(), keys, "left_anti") if owners is None else old.join(owners, self.owner, "left_anti")
        return left.unionByName(checked), touched

    def _commit(self, build) -> int:
        base = self.manifest()
        after = {"version": base["version"] + 1, "schemas": dict(base["schemas"]), "buckets": {t: dict(b) for t, b in base["buckets"].items()}}
        for table, (rows, touched) in build(base).items():
            folder = f"data/{table}/{uuid.uuid4().hex}"
            rows.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            written = {n.rpartition("=")[2] for n in self._names(folder) if n.startswith("__bucket=")}
            held = after["buckets"].setdefault(table, {})
            for b in touched:
                held.pop(b, None)
            held |= {b: f"{folder}/__bucket={b}" for b in written}
            after["schemas"][table] = json.loads(rows.schema.json())
        self._publish(after)
        return after["version"]

    def _publish(self, manifest: dict) -> None:
        """Give the manifest its number; of writers that began from one state, the first does."""
        draft, final = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:012}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # of this class's renames, this one doesn't overwrite
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(draft, final, kinds)
        except Exception as e:
            self._files.delete(draft, False)
            raise ConflictError(f"commit {manifest['version']} has been taken") from e

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the newest ``keep`` commits names, of failed writers too; the number of folders deleted. Not while others write."""
        newest = self.version()
        kept = {f.rpartition("/")[0] for v in range(max(1, newest - keep + 1), newest + 1) for b in self.manifest(v)["buckets"].values() for f in b.values()}
        gone = [f"data/{t}/{n}" for t in self._names("data") for n in self._names(f"data/{t}") if f"data/{t}/{n}" not in kept]
        gone += [f"manifests/{n}" for n in self._names("manifests") if not n.isdigit() or int(n) <= newest - keep]
        for name in gone:
            self._files.delete(self._path(name), True)
        return len(gone)
