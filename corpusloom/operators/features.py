"""Features that are dear to compute, kept by content hash: only what is new or has changed is computed, and what one stage
has computed is there for the next attempt when a later stage fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import Change, Snapshot, Snapshots


def computed(records: DataFrame, store: Snapshots, name: str, compute: Callable[[DataFrame], DataFrame], ddl: str, parts: int = 64) -> tuple[DataFrame, Snapshot]:
    """(id, hash, and the columns of ddl for all records; the version that has them).

    records has id, hash and what compute needs; ids are unique. compute gets the records whose id has no feature of that
    hash and gives id and the columns of ddl; it may leave records out, which are tried again next time. Features are
    committed before anything else is done with them. Of the store only parts (by hash of the id) with new features are
    written again; a feature of an older content goes when the new one comes."""
    at = store.open()
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long").alias("part")
    kept = at.table(name) if name in at.tables() else store.spark.createDataFrame([], f"id {records.schema['id'].dataType.simpleString()}, hash string, {ddl}")
    missing = records.join(kept.select("id", "hash"), ["id", "hash"], "left_anti")
    columns = [c for c in kept.columns if c not in ("id", "hash")]
    fresh = store.stage("fresh", compute(missing).select("id", *columns).join(records.select("id", "hash"), "id"))
    touched = [r[0] for r in fresh.rows.select(part).distinct().collect()]
    if touched:
        old = (at.table(name, touched, by="part") if name in at.tables() else kept.withColumn("part", F.lit(0).cast("long"))).join(fresh.rows.select("id"), "id", "left_anti")
        rows = old.unionByName(fresh.rows.select("*", part))
        at = store.commit(at, {name: Change(store.stage(name, rows, "part"), touched)}, f"{name} computed")
    kept = at.table(name) if name in at.tables() else kept
    return records.select("id", "hash").join(kept, ["id", "hash"]), at
