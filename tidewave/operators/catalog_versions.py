"""Versions of a stored catalogue: each upgrade rewrites the tables it changes beside the old ones and then names them in a
new manifest, by one rename. What a crash leaves is the old manifest with the old tables; running again does the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import catalog

#: The version that upgrades lead to.
CURRENT = 4
HISTORY = "id long, sport string, since date, until date, ftp_w double, source string"
META = "key string, value string, updated_at timestamp"
GROUPS = "id long, primary_activity_id string, match_method string, created_at timestamp"


def _with(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


def to_2(spark: SparkSession, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A history of threshold power, and which of its rows a ride was scored with."""
    return {"ftp_history": spark.createDataFrame([], HISTORY), "activities": _with(t["activities"], "ftp_history_id", "long")}


def to_3(spark: SparkSession, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys and values of the catalogue itself."""
    return {"catalog_meta": spark.createDataFrame([], META)}


def to_4(spark: SparkSession, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Groups of recordings of one session. Rows that are there count for load, are primary, and are told their pipeline."""
    a = t["activities"]
    for c, kind in (("source_platform", "string"), ("manufacturer", "string"), ("ingest_pipeline", "string"), ("external_id", "string"), ("session_group_id", "long"), ("counts_for_load", "boolean"), ("is_primary", "boolean"), ("match_reason", "string")):
        a = _with(a, c, kind)
    s = F.col("source_file")
    email = s.contains("/email/") | s.startswith("email/") | s.contains("inbox/")
    polar = s.contains("/polar/") | s.startswith("polar/") | (F.lower("source_platform") == "polar") | F.lower("manufacturer").contains("polar")
    pipe = F.coalesce("ingest_pipeline", F.when(email, "email").when(F.coalesce(polar, F.lit(False)), "polar").otherwise("manual"))
    a = a.withColumns({"ingest_pipeline": pipe, "counts_for_load": F.coalesce("counts_for_load", F.lit(True)), "is_primary": F.coalesce("is_primary", F.lit(True))})
    return {"session_groups": spark.createDataFrame([], GROUPS), "activities": a}


UPGRADES: dict[int, Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]] = {2: to_2, 3: to_3, 4: to_4}


def upgraded(spark: SparkSession, tables: dict[str, DataFrame], version: int, to: int = CURRENT) -> dict[str, DataFrame]:
    """The tables of a version as plans of those of a later one; nothing is written."""
    for v in range(version + 1, to + 1):
        tables = tables | UPGRADES[v](spark, tables)
    return tables


class Store:
    """A folder of tables, and of manifests that say which files are the catalogue's.

    A manifest is written under a temporary name and renamed to its number, which no other can take: of two writers one
    gets an error. Tables that no manifest names are what a crash left, and are never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _numbers(self) -> list[int]:
        where = self._path("manifests")
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The newest: version and the folder of each table; version 0 and no tables if there is none."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "tables": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.folder}/{p}") for n, p in self.manifest()["tables"].items()}

    def commit(self, version: int, changed: dict[str, DataFrame]) -> None:
        """Write the changed tables into folders of their own, then name them beside the others in the next manifest."""
        numbers, old = self._numbers(), self.manifest()
        paths = {}
        for name, df in changed.items():
            paths[name] = f"tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{paths[name]}")
        self._fs.mkdirs(self._path("manifests"))
        part = self._path(f"manifests/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps({"version": version, "tables": old["tables"] | paths}).encode()))
        out.close()
        final = self._path(f"manifests/{(numbers[-1] if numbers else 0) + 1}.json")
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError("another writer came first")

    def create(self, activities: DataFrame | None = None, version: int = 1) -> None:
        """A catalogue of the version, with the given activities or none. One that is there already stays."""
        if not self._numbers():
            self.commit(version, {"activities": activities if activities is not None else self.spark.createDataFrame([], catalog.ACTIVITIES)})

    def upgrade(self, to: int = CURRENT) -> int:
        """Lead the catalogue to the version, one manifest a version, and say how many were made; none if it is there."""
        made = 0
        while (v := self.manifest()["version"]) < to:
            self.commit(v + 1, UPGRADES[v + 1](self.spark, self.tables()))
            made += 1
        return made
