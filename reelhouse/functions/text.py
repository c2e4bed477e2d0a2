"""Text operators as native Column expressions.

Chunking, re-assembly, caption flattening and model-answer cleanup all stay
inside the JVM (higher-order functions and regex), so a long transcript is
processed where it lives, in one task per row, without Python serialisation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelhouse import constants as K
from reelhouse.functions.fields import ColumnOrName, _col, strip

# Nested caption document: {"events": [{"segs": [{"utf8": "..."}]}]}.
CAPTION_SCHEMA = T.StructType([
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("segs", T.ArrayType(T.StructType([
            T.StructField("utf8", T.StringType()),
        ]))),
    ]))),
])

# Token = maximal run of letters/digits (Java regex and RE2 agree on \p{L}).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def chunks(text: ColumnOrName, size: int) -> Column:
    """Fixed-size character chunks covering the whole text, in order.

    ``''`` gives an empty array, NULL gives NULL.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    t = _col(text)
    # one pass over the text: a substring for each chunk would count characters from the start each time
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def strip_preamble(text: ColumnOrName) -> Column:
    """Drop a leading "Here is/are/'s ..." line that is followed by a blank line."""
    return F.regexp_replace(_col(text), K.PREAMBLE_PATTERN, "")


def join_responses(responses: ColumnOrName) -> Column:
    """Per-chunk answers -> one answer: newline-joined, preamble dropped, stripped.

    Each answer is followed by a newline before the preamble rule runs, so a
    first answer ending in a newline counts as the blank line.
    """
    joined = F.concat(F.array_join(_col(responses), "\n"),
                      F.when(F.size(_col(responses)) > 0, F.lit("\n")).otherwise(F.lit("")))
    return strip(strip_preamble(joined))


def ordered_join(pos: ColumnOrName, value: ColumnOrName) -> Column:
    """Aggregate: values ordered by ``pos`` as an array (for re-assembly)."""
    pairs = F.array_sort(F.collect_list(F.struct(_col(pos).alias("p"), _col(value).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def captions_to_text(doc: ColumnOrName) -> Column:
    """Caption JSON -> transcript: all pieces in order, no separator, newline -> space.

    Events without ``segs`` are skipped, a piece without text counts as empty,
    NULL JSON stays NULL.
    """
    parsed = F.from_json(_col(doc), CAPTION_SCHEMA)
    events = F.filter(parsed["events"], lambda e: e["segs"].isNotNull())
    pieces = F.flatten(F.transform(events, lambda e: F.transform(
        e["segs"], lambda s: F.coalesce(s["utf8"], F.lit("")))))
    return F.replace(F.array_join(pieces, ""), F.lit("\n"), F.lit(" "))


def clean_category(answer: ColumnOrName) -> Column:
    """Free-form category answer -> category text.

    Strip, drop "Category: ", keep the text inside the first ``**...**``.
    """
    s = F.replace(strip(answer), F.lit(K.CATEGORY_PREFIX), F.lit(""))
    inner = F.regexp_extract(s, K.BOLD_PATTERN, 1)
    return F.when(s.contains("**") & (inner != ""), inner).otherwise(s)


def final_category(answer: ColumnOrName) -> Column:
    """Last cleanup of an accepted answer: no ``*`` and no newlines."""
    return F.replace(F.replace(_col(answer), F.lit("*"), F.lit("")), F.lit("\n"), F.lit(""))


def word_count(text: ColumnOrName) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    ws = K.WHITESPACE_CLASS
    return F.size(F.filter(F.split(_col(text), f"{ws}+"), lambda w: w != "")).cast("bigint")


def tokens(text: ColumnOrName) -> Column:
    """Lower-cased letter/digit tokens, empty pieces removed."""
    return F.filter(F.split(F.lower(_col(text)), TOKEN_SPLIT), lambda w: w != "")


def tool_call_category(arguments: ColumnOrName) -> Column:
    """``category`` field of a tool-call argument JSON."""
    return F.get_json_object(_col(arguments), "$.category")


def summary_input(title: ColumnOrName, text: ColumnOrName, with_title: bool) -> Column:
    """Text handed to the summariser: ``title - text`` at import, else ``text``."""
    if with_title:
        return F.concat(_col(title), F.lit(" - "), _col(text))
    return _col(text)


def category_text(title: ColumnOrName, summary: ColumnOrName | None = None,
                  themes: ColumnOrName | None = None) -> Column:
    """Title first, then summary and themes when present (what a categoriser reads)."""
    parts = [_col(title)]
    for c in (summary, themes):
        if c is not None:
            parts.append(F.coalesce(_col(c), F.lit("")))
    return F.concat_ws("\n", *parts)
