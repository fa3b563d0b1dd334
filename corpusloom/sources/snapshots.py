"""Several tables that change together, without a transaction log.

Data folders are written once and never changed. A version is one small file that names, for each table, the folders (of
each part of the table, if it has parts) that hold its rows; it appears whole or not at all, after all folders are there.
A job that dies in between leaves the version before. Readers stay with the version they opened. Two writers that start
from the same version: the second is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "version long, note string, `table` string, part long, folder string, ddl string"


@dataclass
class Staged:
    """Rows of a table in a folder that no version names yet; the parts that they make up, if they have any."""

    rows: DataFrame
    by: str | None
    files: list[tuple]


@dataclass
class Change:
    """What a commit does to a table: staged rows replace it (or, if they have parts, those parts and the ones named in
    `parts`; all others stay); with `more`, rows are added to what is there. Without rows, the named parts are empty from
    then on, or the table is gone."""

    staged: Staged | None = None
    parts: list[int] = field(default_factory=list)
    more: bool = False


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self) -> DataFrame:
        """The files of all versions. A folder that has no file yet is no version."""
        try:
            return self.spark.read.schema(_FILES).json(f"{self.path}/versions/*/*.json")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _FILES)

    def versions(self) -> list[int]:
        return sorted(r[0] for r in self._listed().select("version").distinct().collect())

    def open(self, version: int | None = None) -> Snapshot:
        """The latest version, or an older one that is still kept; of a store without versions, an empty one."""
        known = self._listed()
        if version is None:
            version = known.agg(F.max("version")).first()[0]
        files = [] if version is None else known.filter(F.col("version") == version).collect()
        if version is not None and not files:
            raise ValueError(f"there is no version {version} in {self.path}")
        return Snapshot(self.spark, version or 0, files)

    def stage(self, table: str, rows: DataFrame, by: str | None = None) -> Staged:
        """Writes rows, by parts (whole numbers) if `by` names a column, where no reader looks yet."""
        folder = f"{self.path}/data/{table}-{uuid.uuid4().hex}"
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != by)
        if not by:
            rows.write.parquet(folder)
            return Staged(self.spark.read.schema(rows.schema).parquet(folder), None, [(table, None, folder, ddl)])
        rows.repartition(by).write.partitionBy(by).parquet(folder)
        read = self.spark.read.schema(f"{ddl}, `{by}` long").parquet(folder)
        parts = [r[0] for r in read.select(by).distinct().collect()]
        return Staged(read, by, [(table, p, f"{folder}/{by}={p}", ddl) for p in parts])

    def commit(self, base: Snapshot, changes: dict[str, Change], note: str = "") -> Snapshot:
        """The version behind `base`, with all changes or none; an error if another one has come first."""
        files = [(f["table"], f["part"], f["folder"], f["ddl"]) for f in base.files if f["table"] is not None]
        for table, change in changes.items():
            new = change.staged.files if change.staged else []
            by_parts = change.parts or (change.staged and change.staged.by)
            gone = {*change.parts, *(f[1] for f in new)}
            if not change.more:
                files = [f for f in files if f[0] != table or (by_parts and f[1] not in gone)]
            files += new
        version = base.version + 1
        rows = [(version, note, *f) for f in files] or [(version, note, None, None, None, None)]
        self.spark.createDataFrame(rows, _FILES).coalesce(1).write.mode("errorifexists").json(f"{self.path}/versions/{version:012d}")
        return self.open(version)

    def compacted(self, *tables: str) -> Snapshot:
        """A version in which each of the tables, which have no parts, lies in one folder."""
        base = self.open()
        return self.commit(base, {t: Change(self.stage(t, base.table(t))) for t in tables}, base.note)

    def forget(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions, and the folders that only those had; how many folders went.

        For times without writers: what a running commit has written is not yet named by a version."""
        files = self._listed().collect()
        kept = set(sorted({f["version"] for f in files})[-keep:])
        used = {f["folder"] for f in files if f["version"] in kept}
        old = {f["folder"] for f in files if f["folder"]} - used
        for version in {f["version"] for f in files} - kept:
            self._removed(f"{self.path}/versions/{version:012d}")
        for folder in old:
            self._removed(folder)
        return len(old)

    def _removed(self, folder: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Snapshot:
    """One version; what it reads doesn't change while others commit."""

    def __init__(self, spark: SparkSession, version: int, files: list):
        self.spark, self.version, self.files = spark, version, files
        self.note = files[0]["note"] if files else ""

    def tables(self) -> list[str]:
        return sorted({f["table"] for f in self.files if f["table"] is not None})

    def table(self, name: str, parts: list[int] | None = None, by: str | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts; with `by`, the part is a column of that name."""
        own = [f for f in self.files if f["table"] == name]
        if not own:
            raise ValueError(f"version {self.version} has no table {name}")
        ddl = own[0]["ddl"]
        if any(f["ddl"] != ddl for f in own):
            raise ValueError(f"folders of {name} differ in their columns")
        own = [f for f in own if parts is None or f["part"] in parts]
        if not by:
            return self.spark.read.schema(ddl).parquet(*[f["folder"] for f in own]) if own else self.spark.createDataFrame([], ddl)
        roots: dict[str, list[str]] = {}
        for f in own:
            roots.setdefault(f["folder"].rsplit("/", 1)[0], []).append(f["folder"])
        read = self.spark.createDataFrame([], f"{ddl}, `{by}` long")
        for root, folders in roots.items():
            read = read.unionByName(self.spark.read.schema(f"{ddl}, `{by}` long").option("basePath", root).parquet(*folders))
        return read

    def folders(self, name: str) -> dict[int | None, str]:
        return {f["part"]: f["folder"] for f in self.files if f["table"] == name}
