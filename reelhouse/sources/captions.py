"""Caption tracks (S4): pick one track per link, attach transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import text as TX


def pick_track(captions: DataFrame, track: str = K.CAPTION_TRACK) -> DataFrame:
    """``(link, json)`` of the wanted track (automatic English by default),
    exactly one row per link.

    A link with several copies of the track keeps the smallest JSON text.
    The grouping is combined map side, so a link with a third of all copies
    leaves every task as one row, and its output is already partitioned on
    ``link`` for the join that attaches it (no second exchange).
    """
    return captions.where(F.col("track") == track).groupBy("link").agg(F.min("json").alias("json"))


def transcripts(captions: DataFrame, track: str = K.CAPTION_TRACK) -> DataFrame:
    """``(link, transcript)``: the track's caption JSON flattened to text."""
    return pick_track(captions, track).select("link", TX.captions_to_text("json").alias("transcript"))


def attach(items: DataFrame, captions: DataFrame, out_col: str = "subtitles",
           track: str = K.CAPTION_TRACK) -> DataFrame:
    """Left join transcripts on ``link``; items without captions get NULL."""
    t = transcripts(captions, track).withColumnRenamed("transcript", out_col)
    base = items.drop(out_col) if out_col in items.columns else items
    return base.join(t, "link", "left")
