"""Saved states of runs: tables kept under a name, with a hash, a registry, retention, export and import.

A state is a DataFrame written as Parquet under folder/data/<name>/<version>; the registry is a Parquet table of one row
for each state saved or removed, so nothing is ever rewritten. The folder must be shared by all executors.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..operators import state

REGISTRY = "name string, version string, created_at timestamp, description string, data_hash string, row_count bigint, size_bytes bigint, format string, compression string, removed boolean"


def rows_hash(df: DataFrame) -> tuple[str, int]:
    """A hash of df's rows and column types that doesn't depend on their order, and the number of rows. Each row's hash
    is added up and xor-ed, so no row leaves its task."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) if df.columns else F.lit(0).cast("bigint")
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).select("n", F.sha2(F.concat_ws("|", F.lit(df.schema.simpleString()), "n", F.coalesce("x", F.lit(0)), F.coalesce("s", F.lit(0))), 256).alias("h")).first()
    return got["h"], got["n"]


class SavedStates:
    """States in one folder. keep: how many versions of a name stay; older ones are removed when a new one is saved."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 5, compression: str = "zstd") -> None:
        self.spark, self.folder, self.keep, self.compression = spark, folder.rstrip("/"), keep, compression

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _size(self, path: str) -> int:
        p, fs = self._path(path)
        return fs.getContentSummary(p).getLength()

    def _data(self, name: str, version: str) -> str:
        return f"{self.folder}/data/{quote(name, safe='')}/{version}"

    def _note(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/registry")

    def registry(self) -> DataFrame:
        """One row for each state that is there."""
        p, fs = self._path(f"{self.folder}/registry")
        if not fs.exists(p):
            return self.spark.createDataFrame([], REGISTRY).drop("removed")
        noted = self.spark.read.schema(REGISTRY).parquet(f"{self.folder}/registry")
        gone = noted.where("removed").select("name", "version")
        return noted.where("NOT removed").join(gone, ["name", "version"], "left_anti").drop("removed")

    def _newest(self, name: str, version: str | None = None):
        own = self.registry().where(F.col("name") == name)
        own = own if version is None else own.where(F.col("version") == version)
        return own.orderBy(F.desc("version")).first()

    def save(self, name: str, df: DataFrame, description: str = "") -> str:
        """Writes df as a new version of `name`, prunes older ones, and returns the version."""
        if not name:
            raise ValueError("a state needs a name")
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", self.compression).parquet(self._data(name, version))
        self._register(name, version, description)
        self.prune(self.keep, name)
        return version

    def _register(self, name: str, version: str, description: str, expected: str | None = None) -> None:
        data_hash, n = rows_hash(self.spark.read.parquet(self._data(name, version)))
        if expected is not None and data_hash != expected:
            self._delete(self._data(name, version))
            raise ValueError(f"the hash of {name} doesn't match its rows")
        row = (name, version, description, data_hash, n, self._size(self._data(name, version)), "parquet", self.compression, False)
        rows = self.spark.createDataFrame([row], "name string, version string, description string, data_hash string, row_count bigint, size_bytes bigint, format string, compression string, removed boolean")
        self._note(rows.withColumn("created_at", F.current_timestamp()).select(*[x.split()[0] for x in REGISTRY.split(", ")]))

    def load(self, name: str, version: str | None = None) -> DataFrame | None:
        """The newest version, or the one named; None where there is none. Rows that don't match their hash raise
        ValueError."""
        noted = self._newest(name, version)
        if noted is None:
            return None
        df = self.spark.read.parquet(self._data(name, noted["version"]))
        if rows_hash(df)[0] != noted["data_hash"]:
            raise ValueError(f"the rows of {name} aren't those that were saved")
        return df

    def exists(self, name: str) -> bool:
        return self._newest(name) is not None

    def info(self, name: str):
        """The registry's row of the newest version, or None."""
        return self._newest(name)

    def listed(self) -> DataFrame:
        """All states, newest first, with readable sizes."""
        return self.registry().withColumn("size_human", human_size(F.col("size_bytes"))).orderBy(F.desc("version"))

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def _remove(self, which: DataFrame) -> int:
        """Notes the removal first: a state that is half deleted is never listed. One row per state goes to the driver."""
        rows = which.select("name", "version").collect()
        if rows:
            self._note(self.spark.createDataFrame([(r["name"], r["version"]) for r in rows], "name string, version string").selectExpr("name", "version", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in REGISTRY.split(", ")[2:-1]], "true AS removed"))
            for r in rows:
                self._delete(self._data(r["name"], r["version"]))
        return len(rows)

    def clear(self, name: str) -> bool:
        """Removes all versions of a name; whether there were any."""
        return self._remove(self.registry().where(F.col("name") == name)) > 0

    def clear_all(self) -> int:
        return self._remove(self.registry())

    def prune(self, keep: int, name: str | None = None) -> int:
        """Removes all but the newest `keep` versions of each name, or of one."""
        rows = self.registry() if name is None else self.registry().where(F.col("name") == name)
        return self._remove(state.beyond_newest(rows, "name", "version", "created_at", keep))

    def expire(self, days: int = 30, now: Column | None = None) -> int:
        """Removes states older than so many days."""
        return self._remove(state.expired(self.registry(), "created_at", F.current_timestamp() if now is None else now, days))

    def statistics(self) -> DataFrame:
        """One row: states, bytes, oldest, newest, counts by format and compression; zeros where there are none."""
        return state.statistics(self.registry(), "created_at", "size_bytes", "format", "compression")

    def export(self, name: str, target: str) -> bool:
        """Copies the newest version and its registry row to a folder elsewhere; False where there is none."""
        noted = self._newest(name)
        if noted is None:
            return False
        self.spark.read.parquet(self._data(name, noted["version"])).write.mode("overwrite").parquet(f"{target}/data")
        self.spark.createDataFrame([noted], self.registry().schema).write.mode("overwrite").json(f"{target}/metadata")
        return True

    def import_from(self, source: str, name: str | None = None) -> str | None:
        """Takes over what export wrote, under its own name or another; None where nothing is there. Without metadata
        the state gets a name by time, and its hash is worked out; with it, rows that don't match raise ValueError."""
        p, fs = self._path(f"{source}/data")
        if not fs.exists(p):
            return None
        p, fs = self._path(f"{source}/metadata")
        noted = self.spark.read.json(f"{source}/metadata").first() if fs.exists(p) else None
        name = name or (noted["name"] if noted else f"imported_{time.strftime('%Y%m%d_%H%M%S')}")
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.spark.read.parquet(f"{source}/data").write.option("compression", self.compression).parquet(self._data(name, version))
        self._register(name, version, (noted["description"] if noted else None) or "Imported state", noted["data_hash"] if noted else None)
        return name
