"""A knowledge base's tables as versions of Parquet folders.

A write makes a new version beside the old one and then moves a pointer file,
so readers see the one or the other. Deletes and upserts are rewrites without
the rows that go; appends of rows with new keys add files to a version.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import DatabaseError
from siftwell.operators.relational import latest
from siftwell.schemas import SET_NULL, TABLES, empty, language_configs, violations

#: The tables that hold rows of a table, by the column that points to it.
CHILDREN = {parent: [(name, column) for name, t in TABLES.items() for column, p in t.references.items() if p == parent] for parent in TABLES}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _pointer(self, name: str) -> str:
        return f"{self.path}/{name}/CURRENT"

    def version(self, name: str) -> str | None:
        """The folder of a table's current version."""
        fs, pointer = self._fs(self._pointer(name))
        if not fs.exists(pointer):
            return None
        line = self.spark.read.text(self._pointer(name)).first()
        return f"{self.path}/{name}/{line[0]}" if line else None

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise DatabaseError(f"no table {name}")
        folder = self.version(name)
        return self.spark.read.schema(TABLES[name].schema).parquet(folder) if folder else empty(self.spark, name)

    def write(self, name: str, rows: DataFrame, checked: bool = True) -> None:
        """Makes ``rows`` the table's current version; rows that break a rule raise before anything is written."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema]
        rows = rows.select(*columns)
        if checked and (bad := violations(rows, name).limit(1).collect()):
            raise DatabaseError(f"rows of {name} break {', '.join(bad[0]['broken'])}", {"row": bad[0].asDict()})
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}/{version}")
        fs, fresh = self._fs(f"{self.path}/{name}/.next-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(version + "\n", "utf-8"))
        out.close()
        self._replace(fresh, self._fs(self._pointer(name))[1])

    def _replace(self, fresh, pointer) -> None:
        """Moves a file over another in one step, so that a crash leaves the one or the other."""
        fs_package = self.spark._jvm.org.apache.hadoop.fs
        files = fs_package.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs_package.Options.Rename, 1)
        options[0] = fs_package.Options.Rename.OVERWRITE
        files.rename(fresh, pointer, options)

    def vacuum(self, name: str) -> int:
        """Deletes versions that aren't current, and returns their number."""
        fs, folder = self._fs(f"{self.path}/{name}")
        current = (self.version(name) or "").rsplit("/", 1)[-1]
        old = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName() != current] if fs.exists(folder) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds files with ``rows`` to the current version, whose keys are new by the way they were made; nothing else is read or written."""
        rows = self._shaped(name, rows)
        if bad := violations(rows, name).limit(1).collect():
            raise DatabaseError(f"rows of {name} break {', '.join(bad[0]['broken'])}", {"row": bad[0].asDict()})
        folder = self.version(name)
        if folder is None:
            self.write(name, rows, checked=False)
        else:
            rows.write.mode("append").parquet(folder)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """The table's columns of ``rows``, null where they are missing."""
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].schema))

    def upsert(self, name: str, rows: DataFrame, key: tuple[str, ...] | None = None) -> None:
        key = list(key or TABLES[name].key)
        fresh = self._shaped(name, rows)
        order = [F.desc_nulls_last("updated_at")] if "updated_at" in fresh.columns else [F.desc_nulls_last("created_at")] if "created_at" in fresh.columns else [F.lit(0)]
        fresh = latest(fresh, key, *order).select(*[f.name for f in TABLES[name].schema])
        kept = self.read(name).join(fresh.select(*key), key, "left_anti").select(*fresh.columns)
        self.write(name, kept.unionByName(fresh))

    def insert_missing(self, name: str, rows: DataFrame) -> int:
        """Adds rows whose key isn't there yet, and returns their number."""
        key = list(TABLES[name].key)
        fresh = rows.dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti")
        count = fresh.count()
        if count:
            self.upsert(name, fresh)
        return count

    def delete(self, name: str, condition: Column) -> dict[str, int]:
        """Deletes rows and what points to them; the numbers of rows that went by table."""
        return self.delete_keys(name, self.read(name).where(condition).select(*TABLES[name].key), TABLES[name].key)

    def delete_keys(self, name: str, keys: DataFrame, key: tuple[str, ...]) -> dict[str, int]:
        """As delete, of the rows whose ``key`` columns are among ``keys``."""
        counts: dict[str, int] = {}
        self._delete(name, keys.select(*key).distinct(), list(key), counts)
        return counts

    def _delete(self, name: str, gone: DataFrame, key: list[str], counts: dict[str, int]) -> None:
        rows = self.read(name)
        going = rows.join(gone, key, "left_semi")
        count = going.count()
        counts[name] = counts.get(name, 0) + count
        if not count:
            return
        own = TABLES[name].key
        for child, column in CHILDREN[name]:
            keys = going.select(F.col(own[0]).alias(column)).distinct()
            if (child, column) in SET_NULL:
                at = keys.withColumn("__gone", F.lit(True))
                fixed = self.read(child).join(at, column, "left").withColumn(column, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(column))).drop("__gone")
                self.write(child, fixed)
                rows = self.read(name) if child == name else rows
            else:
                self._delete(child, keys, [column], counts)
        self.write(name, rows.join(gone, key, "left_anti"))

    def delete_older(self, name: str, now: datetime, days: int, column: str = "created_at") -> dict[str, int]:
        return self.delete(name, F.col(column) < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))

    def truncate(self) -> None:
        for name in TABLES:
            self.write(name, empty(self.spark, name), checked=False)

    def create(self) -> None:
        """Makes tables that aren't there, empty but for the language configurations."""
        for name in TABLES:
            if self.version(name) is None:
                self.write(name, language_configs(self.spark) if name == "text_search_configs" else empty(self.spark, name), checked=False)

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1
