"""The stored library: immutable files, bucket by bucket, under versioned manifests.

K2, J4 (copy-on-write updates), J1 (link index), K1, K5, A7 (atomic versions,
snapshots by reference), K6 (stored rejects), A1 (maintained counts), S2
(validation of what is new), T1, T2, P11 (pruned reads).

Rows are clustered by id: bucket ``b`` holds the ids ``b * bucket_rows`` up to
the next bucket's, so new items land in the last buckets, the newest ones are
read without opening the others, and no bucket can grow past its size.  A
change writes new folders for the buckets it touches and nothing else; a
version is a manifest, a small JSON file that names the folders of each bucket
(its size follows the number of buckets, never the number of rows).

Every stored link is also in a link index, dealt by hash into ``link_buckets``;
an import reads only the index folders that its links fall into, and a commit
checks its new links against the same folders.

A commit renames its finished manifest to the next version number, which fails
if that number is taken: the loser reads the winner's version and builds its
change anew on it (ids, known links and counts included).  Readers hold the
folders of the version they opened, which stay until ``vacuum`` finds them in
no version and no snapshot.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import fields as FF
from reelhouse.operators import ingest as I
from reelhouse.operators import library as L
from reelhouse.operators import updates as U
from reelhouse.operators.joins import stable
from reelhouse.operators.snapshots import _fs, expired_snapshots
from reelhouse.operators.vocabulary import fold_renames
from reelhouse.schema import LIBRARY_SCHEMA, NOT_NULL, conform

REJECT_SCHEMA = "link string, stage string, attempts bigint, problem string, last_version bigint"
COUNT_SCHEMA = "category string, hidden boolean, n bigint"
#: Columns that an update may not set: rows are clustered by one and indexed by the other.
FIXED = ("id", "link")
#: Names of commits that a manifest remembers, so that a job started again does not commit twice.
RUNS = 1000
#: Changes of at most so many bytes are sent to the tasks that read the buckets, so that no stored row is shuffled.
SENT_BYTES = 10 * 2 ** 20
#: Losing a race this many times ends a commit.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer took the version number again and again."""


@dataclass(frozen=True)
class Manifest:
    """One version: the folders of each bucket, and what is maintained along with them."""
    version: int = -1
    bucket_rows: int = 100_000
    link_buckets: int = 256
    max_id: int = 0
    data: dict[str, list[str]] = field(default_factory=dict)    # bucket -> folders
    visible: dict[str, int] = field(default_factory=dict)       # bucket -> rows not hidden
    links: dict[str, list[str]] = field(default_factory=dict)   # link bucket -> folders
    counts: str | None = None
    rejects: str | None = None
    runs: list[str] = field(default_factory=list)               # the last ``RUNS`` named commits

    def folders(self) -> set[str]:
        """Every folder that this version needs."""
        named = [f for part in (self.data, self.links) for own in part.values() for f in own]
        return {*named, *(f for f in (self.counts, self.rejects) if f)}


# ---- manifests ---------------------------------------------------------------------

def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` with ``text`` unless it exists; it is complete as soon as it can be seen."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, to = _fs(spark, path)
    fs.mkdirs(to.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, to, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def _manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(**json.loads(_read_text(spark, path)))


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json"))


def open_version(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The given version's manifest, or the newest."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise FileNotFoundError(f"no library under {root}")
        version = known[-1]
    return _manifest(spark, f"{root}/versions/{version:012d}.json")


def try_commit(spark: SparkSession, root: str, new: Manifest) -> Manifest | None:
    """``new`` under the number after its own, or None if another writer took that number."""
    new = replace(new, version=new.version + 1)
    claimed = _claim(spark, f"{root}/versions/{new.version:012d}.json", json.dumps(asdict(new), sort_keys=True))
    return new if claimed else None


def commit(spark: SparkSession, root: str, build: Callable[[Manifest], Manifest | None]) -> Manifest:
    """Make ``build(newest version)`` the next version; built anew whenever another writer was faster.

    ``build`` writes its folders and returns the manifest that names them, or
    None if there is nothing to change.
    """
    for _ in range(TRIES):
        known = versions(spark, root)
        base = open_version(spark, root, known[-1]) if known else Manifest()
        new = build(base)
        if new is None:
            return base
        done = try_commit(spark, root, new)
        if done is not None:
            return done
    raise Conflict(f"{root}: no version number free in {TRIES} tries")


# ---- reading -----------------------------------------------------------------------

def _read(spark: SparkSession, root: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in sorted(folders)])


def read(spark: SparkSession, root: str, manifest: Manifest | None = None, buckets: list[str] | None = None) -> DataFrame:
    """The library of a version (the newest if none is given), or some buckets of it."""
    m = open_version(spark, root) if manifest is None else manifest
    wanted = m.data if buckets is None else buckets
    return _read(spark, root, [f for b in wanted for f in m.data.get(b, [])], LIBRARY_SCHEMA)


def _bucket(column: str, rows: int) -> Column:
    return F.floor(F.col(column) / rows).cast("bigint").cast("string")


def _link_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("link"), F.lit(buckets)).cast("string")


def newest(spark: SparkSession, root: str, n: int = K.PAGE_SIZE, category: str | None = None) -> DataFrame:
    """The newest ``n`` visible rows, opening buckets from the newest down.

    Without a category the manifest tells how many buckets hold ``n`` visible
    rows; with one, twice as many buckets are opened until enough are found.
    """
    m = open_version(spark, root)
    order = sorted(m.data, key=int, reverse=True)
    if category is None:
        found, take = 0, 0
        while take < len(order) and found < n:
            found += m.visible[order[take]]
            take += 1
        return L.library_top(read(spark, root, m, order[:take]), None, n)
    take = 1
    while True:
        rows = read(spark, root, m, order[:take])
        if take >= len(order) or L.in_category(L.visible(rows), category).limit(n).count() >= n:
            return L.library_top(rows, category, n)
        take *= 2


def lookup(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """``(id, link)`` of the given ids, from their buckets only."""
    m = open_version(spark, root)
    ids = stable(ids.select(F.col("id").cast("bigint").alias("id")).where("id is not null"))
    touched = _touched(ids, "id", m.bucket_rows, m.data)
    return L.lookup(read(spark, root, m, touched), ids)


def category_counts(spark: SparkSession, root: str) -> DataFrame:
    """A1 from the maintained counts: visible items of each category, with its label."""
    m = open_version(spark, root)
    counts = stored_categories(spark, root, m)
    shown = counts.where("not hidden and category is not null").groupBy("category").agg(F.sum("n").alias("n"))
    return shown.select("category", "n", FF.count_label("category", "n").alias("label")).orderBy("category")


def distinct_categories(spark: SparkSession, root: str, include_hidden: bool = True) -> DataFrame:
    """A2 from the maintained counts."""
    m = open_version(spark, root)
    counts = stored_categories(spark, root, m).where("category is not null")
    shown = counts if include_hidden else counts.where("not hidden")
    return shown.select("category").distinct().orderBy("category")


def stored_categories(spark: SparkSession, root: str, m: Manifest) -> DataFrame:
    """``(category, hidden, n)`` of a version, as maintained."""
    return _read(spark, root, [m.counts] if m.counts else [], COUNT_SCHEMA)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """K6: ``(link, stage, attempts, problem, last_version)`` of what could not be stored so far."""
    m = open_version(spark, root)
    return _read(spark, root, [m.rejects] if m.rejects else [], REJECT_SCHEMA)


def _touched(rows: DataFrame, column: str, size: int, known: dict) -> list[str]:
    """Buckets of ``rows`` that exist; at most one row a bucket comes to the driver."""
    found = rows.select(_bucket(column, size).alias("b")).distinct().collect()
    return sorted((r.b for r in found if r.b in known), key=int)


def unknown(spark: SparkSession, root: str, m: Manifest, items: DataFrame) -> DataFrame:
    """The items whose link the index lacks; only the index folders that their links fall into are read."""
    touched = [r.b for r in items.select(_link_bucket(m.link_buckets).alias("b")).distinct().collect() if r.b in m.links]
    known = _read(spark, root, [f for b in touched for f in m.links[b]], "link string, id bigint")
    return items.join(known.select("link"), "link", "left_anti")


# ---- writing -----------------------------------------------------------------------

def _written(rows: DataFrame, root: str, bucket: Column, order: str, kind: str,
             links: int | None = None, clustered: bool = False) -> tuple[str, list[str]]:
    """Write ``rows`` sorted by ``order`` into one folder a bucket; the folder and its buckets.

    ``links``: about how many links a bucket holds, which is what the filter of a
    file is made for (else it takes a megabyte).  ``clustered`` rows lie bucket by bucket already (a task holds few buckets) and are not shuffled.
    """
    folder = f"{kind}/{uuid.uuid4().hex}"
    out = rows.withColumn("bucket", bucket)
    out = (out if clustered else out.repartitionByRange("bucket", order)).sortWithinPartitions("bucket", order)
    writer = out.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#link", "true")
    if links is not None:
        writer = writer.option("parquet.bloom.filter.expected.ndv#link", str(links))
    writer.partitionBy("bucket").parquet(f"{root}/{folder}")
    names = [n for n in _names(rows.sparkSession, f"{root}/{folder}") if n.startswith("bucket=")]
    return folder, [n[len("bucket="):] for n in names]


def _visible(rows: DataFrame, size: int) -> dict[str, int]:
    """Rows not hidden of each bucket (one row a bucket)."""
    return {r.b: r.n for r in rows.groupBy(_bucket("id", size).alias("b")).agg(
        F.coalesce(F.sum((~F.col("hidden")).cast("bigint")), F.lit(0)).alias("n")).collect()}


def _counted(spark: SparkSession, root: str, m: Manifest, added: DataFrame, removed: DataFrame | None = None) -> str:
    """The category counts after rows came and went, from those rows and the counts before."""
    def counts(rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy("category", "hidden").agg((F.count(F.lit(1)) * sign).alias("n"))

    total = stored_categories(spark, root, m).unionByName(counts(added, 1))
    if removed is not None:
        total = total.unionByName(counts(removed, -1))
    folder = f"counts/{uuid.uuid4().hex}"
    total.groupBy("category", "hidden").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(f"{root}/{folder}")
    return folder


def _refuse(spark: SparkSession, root: str, folder: str, problems: dict[str, int]) -> None:
    broken = {rule: n for rule, n in problems.items() if n}
    if broken:
        fs, at = _fs(spark, f"{root}/{folder}")
        fs.delete(at, True)
        raise ValueError("not stored: " + ", ".join(f"{rule} ({n} rows)" for rule, n in broken.items()))


def _nulls(rows: DataFrame) -> dict[str, int]:
    got = rows.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0)).alias(c) for c in NOT_NULL]).first()
    return {f"{c} is null": got[c] for c in NOT_NULL}


def _appended(spark: SparkSession, root: str, m: Manifest, rows: DataFrame) -> Manifest:
    """``m`` with new library rows; they are checked, everything stored before is not read again."""
    rows = conform(rows)
    folder, buckets = _written(rows, root, _bucket("id", m.bucket_rows), "id", "data", m.bucket_rows)
    new = _read(spark, root, [f"{folder}/bucket={b}" for b in buckets], LIBRARY_SCHEMA)
    fresh = unknown(spark, root, m, new)
    got = new.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.min("id").alias("first")).first()
    _refuse(spark, root, folder, {
        **_nulls(new), "link is stored already": got.n - fresh.count(),
        "link is not unique": got.n - new.select("link").distinct().count(),
        "id is not unique": got.n - new.select("id").distinct().count(),
        "id is not after the last": int(got.n > 0 and got.first is not None and got.first <= m.max_id and m.version >= 0)})
    index, parts = _written(new.select("link", "id"), root, _link_bucket(m.link_buckets), "link", "links")
    data, links, visible = dict(m.data), dict(m.links), dict(m.visible)
    for b in buckets:
        data[b] = [*data.get(b, []), f"{folder}/bucket={b}"]
    for b, n in _visible(new, m.bucket_rows).items():
        visible[b] = visible.get(b, 0) + n
    for b in parts:
        links[b] = [*links.get(b, []), f"{index}/bucket={b}"]
    return replace(m, data=data, visible=visible, links=links, counts=_counted(spark, root, m, new),
                   max_id=max(m.max_id, got.last or 0))


def create(library: DataFrame, root: str, bucket_rows: int = 100_000, link_buckets: int = 256) -> Manifest:
    """The first version, from a whole library.  Ids are kept."""
    spark = library.sparkSession

    def build(base: Manifest) -> Manifest:
        if base.version >= 0:
            raise FileExistsError(f"{root} holds a library already")
        return _appended(spark, root, replace(base, bucket_rows=bucket_rows, link_buckets=link_buckets), library)

    return commit(spark, root, build)


def append(items: DataFrame, root: str, as_of: str, failed: DataFrame | None = None,
           stage: str = "import", run: str | None = None) -> Manifest:
    """K1, K6: store the items whose link is new, numbered after the newest version's last id.

    ``items``: cleaned cards with ``page_id`` and ``pos``; it is read for every
    try of the commit, so it should be a table.  ``failed (link, problem)``
    goes to the stored rejects, where each further failure of a link at a stage
    counts as one more attempt; what is stored at last leaves them.  A ``run``
    that is committed already changes nothing.
    """
    spark = items.sparkSession

    def build(base: Manifest) -> Manifest | None:
        if run is not None and run in base.runs:
            return None
        fresh = unknown(spark, root, base, items)
        rows = I.to_library_rows(I.assign_ids(fresh, base.max_id, ["page_id", "pos"]), as_of)
        new = base if fresh.isEmpty() else _appended(spark, root, base, rows)
        if failed is not None:
            again = unknown(spark, root, new, failed.select("link", "problem"))
            new = replace(new, rejects=_rejected(spark, root, new, again, stage))
        if run is not None:
            new = replace(new, runs=[*new.runs, run][-RUNS:])
        return None if new is base else new

    return commit(spark, root, build)


def _rejected(spark: SparkSession, root: str, m: Manifest, failed: DataFrame, stage: str) -> str | None:
    """The stored rejects with this run's; a link with several problems in a run counts once."""
    once = failed.groupBy("link").agg(F.min("problem").alias("problem")).select(
        "link", F.lit(stage).alias("stage"), F.lit(1).cast("bigint").alias("attempts"), "problem",
        F.lit(m.version + 1).cast("bigint").alias("last_version"))
    before = _read(spark, root, [m.rejects] if m.rejects else [], REJECT_SCHEMA)
    folder = f"rejects/{uuid.uuid4().hex}"
    rows = unknown(spark, root, m, before).unionByName(once).groupBy("link", "stage").agg(
        F.sum("attempts").alias("attempts"), F.max(F.struct("last_version", "problem")).alias("last"))
    rows.select("link", "stage", "attempts", "last.problem", "last.last_version").write.parquet(f"{root}/{folder}")
    return folder


def _bytes(rows: DataFrame) -> int:
    """About how many bytes the rows take in memory."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in rows.columns), F.lit(16))
    return rows.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def update(changes: DataFrame, cols: list[str], root: str, order: str | None = None) -> Manifest:
    """Set ``cols`` of the rows whose ids ``changes`` holds; only their buckets are written anew.

    Up to ``SENT_BYTES`` of changes go to the rows: a bucket is written by the
    tasks that read it.  More of them are joined by a shuffle.
    """
    wrong = [c for c in cols if c in FIXED]
    if wrong:
        raise ValueError(f"an update cannot set {wrong}")
    spark = changes.sparkSession
    changes = stable(changes.where("id is not null").select("id", *cols, *([order] if order and order not in cols else [])))

    sent = _bytes(changes) <= SENT_BYTES

    def build(base: Manifest) -> Manifest | None:
        touched = _touched(changes, "id", base.bucket_rows, base.data)
        if not touched:
            return None
        old = read(spark, root, base, touched)
        folder, buckets = _written(conform(U.apply_updates(old, changes, cols, order, sent)), root,
                                   _bucket("id", base.bucket_rows), "id", "data", base.bucket_rows, clustered=sent)
        new = _read(spark, root, [f"{folder}/bucket={b}" for b in buckets], LIBRARY_SCHEMA)
        _refuse(spark, root, folder, _nulls(new))
        return replace(base, data={**base.data, **{b: [f"{folder}/bucket={b}"] for b in buckets}},
                       visible={**base.visible, **_visible(new, base.bucket_rows)},
                       counts=_counted(spark, root, base, new, old) if {"category", "hidden"} & set(cols) else base.counts)

    return commit(spark, root, build)


def set_hidden(flags: DataFrame, root: str, order: str | None = None) -> Manifest:
    """K3 on the stored library."""
    return update(flags, ["hidden"], root, order)


def rename_categories(spark: SparkSession, root: str, renames: list[tuple[str, str]]) -> Manifest:
    """K4, L5 on the stored library: only buckets that hold a renamed category are written anew."""
    mapping = spark.createDataFrame(list(fold_renames(renames).items()), "old string, new string")
    # found by a scan of two columns; the rename list is user input
    held = read(spark, root).select("id", F.col("category").alias("old"))
    return update(held.join(F.broadcast(mapping), "old").select("id", F.col("new").alias("category")), ["category"], root)


# ---- snapshots ---------------------------------------------------------------------

def snapshot(spark: SparkSession, root: str, as_of: str, keep: int = K.SNAPSHOT_KEEP) -> str | None:
    """today's snapshot names the newest version's folders and copies nothing; the newest ``keep`` dates stay.

    Returns the date, or None if today's snapshot exists.
    """
    stamp = spark.range(1).select(F.date_format(F.lit(as_of).cast("timestamp_ntz"), K.SNAPSHOT_DATE_FORMAT)).first()[0]
    m = open_version(spark, root)
    if not _claim(spark, f"{root}/snapshots/{stamp}.json", json.dumps(asdict(m), sort_keys=True)):
        return None
    dates = spark.createDataFrame([(d,) for d in snapshots(spark, root)], "snapshot_date string")
    for r in expired_snapshots(dates, keep).where("not keep").collect():  # one row a date
        fs, at = _fs(spark, f"{root}/snapshots/{r.snapshot_date}.json")
        fs.delete(at, False)
    return stamp


def snapshots(spark: SparkSession, root: str) -> list[str]:
    return [n[:-5] for n in _names(spark, f"{root}/snapshots") if n.endswith(".json")]


def read_snapshot(spark: SparkSession, root: str, date: str) -> DataFrame:
    return read(spark, root, _manifest(spark, f"{root}/snapshots/{date}.json"))


def vacuum(spark: SparkSession, root: str, keep_versions: int = 1, grace_seconds: float = 86_400.0) -> int:
    """Drop old versions, and the folders that no version and no snapshot names; returns how many folders went.

    Folders younger than ``grace_seconds`` stay: a writer may be about to
    commit them.
    """
    known = versions(spark, root)
    for v in known[:-keep_versions] if keep_versions else []:
        fs, at = _fs(spark, f"{root}/versions/{v:012d}.json")
        fs.delete(at, False)
    held = [open_version(spark, root, v) for v in versions(spark, root)]
    held += [_manifest(spark, f"{root}/snapshots/{d}.json") for d in snapshots(spark, root)]
    needed = {f for m in held for f in m.folders()}
    gone = 0
    for kind in ("data", "links", "counts", "rejects"):
        fs, at = _fs(spark, f"{root}/{kind}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if time.time() - status.getModificationTime() / 1000 < grace_seconds:
                continue
            name = f"{kind}/{status.getPath().getName()}"
            parts = [f"{name}/{n}" for n in _names(spark, f"{root}/{name}") if n.startswith("bucket=")] or [name]
            unused = [p for p in parts if p not in needed]
            for p in parts if name not in needed and len(unused) == len(parts) else unused:
                fs.delete(_fs(spark, f"{root}/{p}")[1], True)
                gone += 1
            if name not in needed and len(unused) == len(parts):
                fs.delete(status.getPath(), True)
    return gone
