"""reelhouse: a Spark-native media-library curation engine.

Feed pages become item rows, item fields are cleaned with native Column
expressions, duplicates and already-known items are removed with set-based
joins, transcripts are attached, and text is summarised, themed and
categorised in bulk through a pluggable model.  Every step is a DataFrame
transformation so Catalyst plans it and the cluster runs it.
"""

from reelhouse.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
