"""Field cleaning as native Column expressions (whole-stage codegen, no UDFs).

Each function takes Columns (or column names) and returns a Column, so the
same expression serves batch jobs, streaming jobs and SQL users alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelhouse import constants as K

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    ws = K.WHITESPACE_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def normalize_length(c: ColumnOrName) -> Column:
    """Length badge text -> "M:SS" / "H:MM:SS" text, "00:00" when malformed.

    NULL stays NULL.  The text is stripped first.
    """
    valid = F.regexp_substr(strip(c), F.lit(K.LENGTH_PATTERN))   # NULL when no match
    return F.when(_col(c).isNotNull(), F.coalesce(valid, F.lit(K.LENGTH_FALLBACK)))


def length_seconds(normalized: ColumnOrName, two_field: str = "ms") -> Column:
    """Seconds of a normalised length; NULL when a field is out of range.

    ``two_field="ms"`` reads "5:30" as 5 min 30 s (the intended meaning);
    ``"hm"`` reads it as 5 h 30 min, which is what an INTERVAL column stores.
    A minute or second field above 59 cannot be stored and yields NULL (see
    :func:`length_problem`).  The fields are folded base-60 left to right.
    """
    if two_field not in ("ms", "hm"):
        raise ValueError("two_field must be 'ms' or 'hm'")
    parts = F.split(_col(normalized), ":")
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x.try_cast("bigint"))
    if two_field == "hm":
        total = F.when(F.size(parts) == 2, total * 60).otherwise(total)
    return F.when(length_problem(normalized).isNull(), total)


def length_problem(normalized: ColumnOrName) -> Column:
    """Reason a normalised length cannot be stored, else NULL."""
    later = F.slice(F.split(_col(normalized), ":"), 2, 2)
    return F.when(F.exists(later, lambda x: x.try_cast("bigint") > 59), F.lit("length field out of range"))


def badge_length(text: ColumnOrName) -> Column:
    """Badge text as extracted: "UPCOMING"/"LIVE" (any case) mean no length."""
    return F.when(F.upper(_col(text)).isin(*K.NO_LENGTH_BADGES),
                  F.lit(None).cast("string")).otherwise(_col(text))


def canonical_link(href: ColumnOrName, site_base: str = K.SITE_BASE) -> Column:
    """Relative links get the site prefix; cut at the first "&"; '' -> NULL."""
    h = _col(href)
    full = F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(site_base), h))
    return F.when(h.isNull() | (h == ""), F.lit(None).cast("string")) \
            .otherwise(F.substring_index(full, "&", 1))


def video_id(link: ColumnOrName) -> Column:
    """The ``v=`` query parameter of a link, NULL when absent."""
    v = F.regexp_extract(_col(link), K.VIDEO_ID_PATTERN, 1)
    return F.when(v != "", v)


def thumbnail(thumb_src: ColumnOrName, link: ColumnOrName) -> Column:
    """Image source if present, else a URL built from the video id."""
    src = _col(thumb_src)
    vid = video_id(link)
    built = F.concat(F.lit(K.THUMBNAIL_TEMPLATE[0]), vid, F.lit(K.THUMBNAIL_TEMPLATE[1]))
    return F.when(src.isNotNull() & (src != ""), src).otherwise(built)


def progress_pct(style: ColumnOrName) -> Column:
    """Integer percent from a progress-bar style; 0 when absent or unmatched."""
    m = F.regexp_extract(F.coalesce(_col(style), F.lit("")), K.PROGRESS_PATTERN, 1)
    return F.coalesce(m.try_cast("int"), F.lit(0))     # '' (no match) -> NULL -> 0


def title(attr: ColumnOrName, text: ColumnOrName) -> Column:
    """Title attribute unless empty, else the stripped element text."""
    a = _col(attr)
    return F.when(a.isNotNull() & (a != ""), a).otherwise(strip(text))


def date_stamp(ts: ColumnOrName) -> Column:
    """``yyyyMMdd`` stamp used to name daily snapshots."""
    return F.date_format(_col(ts), K.SNAPSHOT_DATE_FORMAT)


def count_label(category: ColumnOrName, n: ColumnOrName) -> Column:
    """``"category (n)"`` label of the category picker."""
    return F.format_string("%s (%d)", _col(category), _col(n))


def bold(c: ColumnOrName) -> Column:
    """Markdown bold title."""
    return F.concat(F.lit("**"), _col(c), F.lit("**"))


def link_markdown(c: ColumnOrName) -> Column:
    """Markdown link labelled "link"."""
    return F.concat(F.lit("[link]("), _col(c), F.lit(")"))
