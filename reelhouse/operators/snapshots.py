"""Versioned publish, daily snapshots and retention.

Parquet files are not updated in place and a table cannot be overwritten
while it is read, so every change of the library is written to a new
``v=N`` directory and readers take the highest complete version.  Daily
snapshots are ``snapshot_date=yyyyMMdd`` directories; the newest ``keep``
survive.  Directory listing and deletion go through the Hadoop FileSystem of
the session, so the same code works on HDFS, object stores and local disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelhouse import constants as K
from reelhouse.schema import validate_library


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, root: str, prefix: str) -> list[str]:
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path) if st.isDirectory()]
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def _complete(spark: SparkSession, d: str) -> bool:
    fs, path = _fs(spark, d + "/_SUCCESS")
    return fs.exists(path)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest ``v=N`` under ``root`` that finished writing."""
    vs = [int(v) for v in _children(spark, root, "v=") if v.isdigit()]
    for v in sorted(vs, reverse=True):
        if _complete(spark, f"{root}/v={v}"):
            return v
    return None


def prune_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Drop all complete versions but the newest ``keep``."""
    done = sorted((int(v) for v in _children(spark, root, "v=") if v.isdigit() and _complete(spark, f"{root}/v={v}")), reverse=True)
    for v in done[keep:]:
        fs, path = _fs(spark, f"{root}/v={v}")
        fs.delete(path, True)


def publish(df: DataFrame, root: str, check: bool = True, keep: int | None = None) -> str:
    """Write ``df`` as the next version; returns its path.  Readers of the
    previous version are unaffected.

    ``check``: the written version must keep the library's rules (NOT NULL
    columns, unique links); one that does not is deleted and the call fails.
    ``keep``: complete versions to keep, older ones are deleted.
    """
    spark = df.sparkSession
    taken = [int(v) for v in _children(spark, root, "v=") if v.isdigit()]
    # past every folder, complete or not: a crashed writer's leftovers are never reused
    path = f"{root}/v={max(taken) + 1 if taken else 0}"
    df.write.mode("errorifexists").parquet(path)
    if check:
        broken = validate_library(spark.read.schema(df.schema).parquet(path)).collect()  # one row a rule
        if broken:
            fs, at = _fs(spark, path)
            fs.delete(at, True)
            raise ValueError("not published: " + ", ".join(f"{r['rule']} ({r['rows']} rows)" for r in broken))
    if keep is not None:
        prune_versions(spark, root, keep)
    return path


def read_latest(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The newest complete version."""
    v = latest_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no published version under {root}")
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(f"{root}/v={v}")


def expired_snapshots(manifest: DataFrame, keep: int = K.SNAPSHOT_KEEP) -> DataFrame:
    """``(snapshot_date, keep)`` with ``keep`` false beyond the newest ``keep``.

    One row per snapshot date; the ordering runs over that bounded list.
    """
    w = Window.orderBy(F.col("snapshot_date").desc())
    return manifest.select("snapshot_date").distinct() \
                   .withColumn("keep", F.row_number().over(w) <= keep)


def snapshot(library: DataFrame, root: str, as_of: str, keep: int = K.SNAPSHOT_KEEP) -> str | None:
    """K5: write today's snapshot unless it exists, then drop expired ones.

    Returns the snapshot path, or ``None`` when today's already existed.
    """
    spark = library.sparkSession
    stamp = spark.range(1).select(F.date_format(F.lit(as_of).cast("timestamp_ntz"),
                                                K.SNAPSHOT_DATE_FORMAT)).first()[0]
    path = f"{root}/snapshot_date={stamp}"
    existing = [d for d in _children(spark, root, "snapshot_date=")
                if _complete(spark, f"{root}/snapshot_date={d}")]
    if stamp in existing:
        return None
    # an unfinished folder from a failed run is replaced
    library.write.mode("overwrite").parquet(path)
    dates = sorted(set(existing) | {stamp}, reverse=True)
    fs, _ = _fs(spark, root)
    for old in dates[keep:]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot_date={old}"), True)
    return path
