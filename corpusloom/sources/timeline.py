"""A log of records by moment: files hold a stretch of time each, readers remember how far they are.

Every append is dealt out by moment, so that a file covers a short stretch; a table of the files with their first and last
moments says which of them a reader that asks from some moment on has to open. The high-water mark of each reader is a
table of the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import Change, Snapshot, Snapshots

_FILES = "file string, least timestamp, most timestamp, n long"
_MARKS = "reader string, mark timestamp"


class Timeline:
    def __init__(self, spark: SparkSession, path: str, moment: str, rows_per_file: int = 1_000_000):
        self.spark, self.store, self.moment, self.rows_per_file = spark, Snapshots(spark, path), moment, rows_per_file

    def append(self, rows: DataFrame) -> Snapshot:
        """Rows without a moment lie in files of their own and are read by those who ask for everything."""
        at = self.store.open()
        n = max(1, -(-rows.count() // self.rows_per_file))
        staged = self.store.stage("rows", rows.repartitionByRange(n, F.col(self.moment).asc_nulls_first()).sortWithinPartitions(self.moment))
        moment = F.col(self.moment).cast("timestamp")
        files = staged.rows.groupBy(F.input_file_name().alias("file")).agg(F.min(moment).alias("least"), F.max(moment).alias("most"), F.count("*").alias("n"))
        return self.store.commit(at, {"rows": Change(staged, more=True), "files": Change(self.store.stage("files", files), more=True)})

    def files(self, since: Column | None = None, at: Snapshot | None = None) -> list[str]:
        """The files that may hold rows of `since` or later."""
        at = at or self.store.open()
        if "files" not in at.tables():
            return []
        listed = at.table("files")
        return [r["file"] for r in (listed if since is None else listed.filter(F.col("most") >= since)).select("file").collect()]

    def since(self, moment: Column, at: Snapshot | None = None) -> DataFrame:
        """Rows of that moment or later."""
        at = at or self.store.open()
        rows, files = at.table("rows"), self.files(moment, at)
        rows = self.spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)
        return rows.filter(F.col(self.moment).cast("timestamp") >= moment)

    def mark(self, reader: str, at: Snapshot | None = None):
        at = at or self.store.open()
        if "marks" not in at.tables():
            return None
        return at.table("marks").filter(F.col("reader") == reader).agg(F.max("mark")).first()[0]

    def unread(self, reader: str) -> tuple[DataFrame, Snapshot]:
        """What `reader` has to read, from its mark on (the mark's own moment again, which more rows may have), and the
        version to give to advanced() once it is dealt with."""
        at = self.store.open()
        mark = self.mark(reader, at)
        return (at.table("rows") if mark is None else self.since(F.lit(mark), at)), at

    def advanced(self, reader: str, read: Snapshot) -> Snapshot:
        """The reader's mark is the last moment of the version it has read; marks never fall."""
        at = self.store.open()
        last = read.table("files").agg(F.max("most")).first()[0]
        marks = at.table("marks") if "marks" in at.tables() else self.spark.createDataFrame([], _MARKS)
        marks = marks.unionByName(self.spark.createDataFrame([(reader, last)], _MARKS)).groupBy("reader").agg(F.max("mark").alias("mark"))
        return self.store.commit(at, {"marks": Change(self.store.stage("marks", marks))})
