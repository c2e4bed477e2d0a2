"""Incremental import on Structured Streaming (ST1).

New card files arrive in a folder.  Each micro-batch runs the batch import's
set operations in ``foreachBatch``: cards are cleaned with the same Column
expressions, the first card of every link in feed order ``(page_id, pos)``
is kept (a grouped minimum, partially aggregated before the shuffle, so a
link that fills a third of a batch leaves every map task as one row), and
links already stored are skipped: the library and the output of every
earlier micro-batch.  The skip is the batch import's known-link skip (the
batch's links are broadcast after a size check and the stored ``link``
columns are scanned, never shuffled).  A link therefore comes out once, in
the first micro-batch that holds it, without a state store that grows with
every link ever seen.

``trigger(availableNow=True)`` processes what is there and stops, so a
scheduler can run it as a job; the checkpoint folder makes a restarted run
resume where the last one stopped.  Each micro-batch writes its own folder
``batch=<epoch>``, overwritten on replay, and reads only the folders of
earlier epochs, so a replayed batch never duplicates or hides rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.operators import ingest as I
from reelhouse.operators import store as ST
from reelhouse.operators.joins import stable
from reelhouse.schema import CARD_SCHEMA

OUTPUT_COLUMNS = ["link", "page_id", "pos", "title"]


def card_stream(spark: SparkSession, cards_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw cards as they arrive (extractor schema, no inference)."""
    reader = spark.readStream.schema(CARD_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(cards_dir)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def import_batch(cards: DataFrame, known_links: DataFrame, as_of: str,
                 site_base: str = K.SITE_BASE) -> DataFrame:
    """One micro-batch: first card per link, links not in ``known_links``."""
    items = I.first_per_link(I.clean_cards(cards, as_of, site_base))
    return I.skip_known(items, known_links).select(*OUTPUT_COLUMNS)


def run_import(spark: SparkSession, cards_dir: str, library: DataFrame, out_dir: str,
               checkpoint: str, as_of: str, site_base: str = K.SITE_BASE,
               files_per_batch: int | None = None) -> None:
    """Run the incremental import until the folder is drained.

    Output rows are ``(link, page_id, pos, title)`` of links neither in the
    library nor output by an earlier micro-batch, one folder per epoch.
    """
    stored = library.select("link")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        known = stored
        if epoch > 0 and _exists(spark, out_dir):
            earlier = spark.read.parquet(out_dir).where(F.col("batch") < epoch).select("link")
            known = known.unionByName(earlier)
        import_batch(batch, known, as_of, site_base) \
            .write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    q = (card_stream(spark, cards_dir, files_per_batch)
         .writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def run_stored_import(spark: SparkSession, cards_dir: str, root: str, checkpoint: str, as_of: str,
                      site_base: str = K.SITE_BASE, files_per_batch: int | None = None, two_field: str = "ms") -> None:
    """The incremental import into the bucketed library under ``root``, until the folder is drained.

    Whole rows with ids are committed, rejects are stored.  The link index is
    the state: a micro-batch reads the index folders that its links fall into,
    never what earlier batches wrote.  A commit is named by the stream's
    checkpoint and the epoch, so a replayed micro-batch commits nothing more.
    """
    def write_batch(batch: DataFrame, epoch: int) -> None:
        cards = stable(I.first_cards(batch, site_base))
        fresh = ST.unknown(spark, root, ST.open_version(spark, root), cards).drop("link")
        items = stable(I.with_length(I.clean_cards(fresh, as_of, site_base), two_field))
        ok, bad = I.split_rejects(items)
        ST.append(ok, root, as_of, failed=bad.select("link", "problem"), run=f"{checkpoint}#{epoch}")

    (card_stream(spark, cards_dir, files_per_batch).writeStream.foreachBatch(write_batch)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def read_output(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir).drop("batch")


def stage_cards(cards: DataFrame, cards_dir: str) -> None:
    """Write cards as one folder of files per page (what a collector would drop)."""
    cards.repartition("page_id").write.mode("append").parquet(cards_dir)
