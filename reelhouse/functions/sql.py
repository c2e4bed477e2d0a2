"""The field rules as Spark SQL functions, for users who write SQL.

``register(spark)`` creates temporary functions with SQL bodies, which Spark
puts in place of their calls: they plan like the Column functions of
:mod:`reelhouse.functions.fields` and :mod:`reelhouse.functions.dates`, and take
their parameters (site, reading of a two-field length, reference time) as
arguments.  With the table function ``extract_cards`` of
:mod:`reelhouse.sources.html_cards` an import can be written in SQL alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from reelhouse import constants as K
from reelhouse.functions import dates as D


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup(table: dict[str, int], key: str) -> str:
    pairs = ", ".join(f"{_text(k)}, {v}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def definitions() -> dict[str, str]:
    """``name(parameters) RETURNS type`` and body of every function, in the order they use each other."""
    ws, badges = K.WHITESPACE_CLASS, ", ".join(map(_text, K.NO_LENGTH_BADGES))
    before, after = map(_text, K.THUMBNAIL_TEMPLATE)
    is_date = " OR ".join(f"contains(s, {_text(w)})" for w in K.DATE_WORDS)

    def ago(group: int) -> str:
        low = "trim(lower(t))"
        return (f"if(contains({low}, 'ago'), regexp_extract({low}, {_text(D.AGO_PATTERN)}, {group}), "
                f"regexp_extract({low}, {_text(D.BARE_PATTERN)}, {group}))")

    day = "trim(lower(t)) IN ('yesterday', 'today')"
    amount = (f"if({day}, if(trim(lower(t)) = 'yesterday', 1L, 0L), coalesce(cast({_lookup(D.AMOUNTS, ago(1))} AS BIGINT), "
              f"try_cast({ago(1)} AS BIGINT)))")
    unit = f"if({day}, 'day', regexp_replace({ago(2)}, 's$', ''))"
    seconds, months = _lookup(D.SECONDS, "relative_unit(t)"), _lookup(D.MONTHS, "relative_unit(t)")
    return {
        "strip_text(t STRING) RETURNS STRING": f"regexp_replace(t, {_text(f'^{ws}+|{ws}+$')}, '')",
        "length_text(badge STRING) RETURNS STRING":
            f"CASE WHEN upper(badge) IN ({badges}) OR badge IS NULL THEN NULL "
            f"ELSE coalesce(regexp_substr(strip_text(badge), {_text(K.LENGTH_PATTERN)}), {_text(K.LENGTH_FALLBACK)}) END",
        "length_problem(n STRING) RETURNS STRING":
            "CASE WHEN exists(slice(split(n, ':'), 2, 2), x -> try_cast(x AS BIGINT) > 59) THEN 'length field out of range' END",
        "length_seconds(n STRING, two_field STRING DEFAULT 'ms') RETURNS BIGINT":
            "CASE WHEN length_problem(n) IS NULL THEN aggregate(split(n, ':'), 0L, (a, x) -> a * 60 + try_cast(x AS BIGINT)) "
            "* if(two_field = 'hm' AND size(split(n, ':')) = 2, 60, 1) END",
        f"canonical_link(href STRING, site STRING DEFAULT {_text(K.SITE_BASE)}) RETURNS STRING":
            "CASE WHEN href <> '' THEN substring_index(if(startswith(href, 'http'), href, concat(site, href)), '&', 1) END",
        "thumbnail_url(src STRING, link STRING) RETURNS STRING":
            f"CASE WHEN src <> '' THEN src ELSE concat({before}, nullif(regexp_extract(link, {_text(K.VIDEO_ID_PATTERN)}, 1), ''), {after}) END",
        "progress_percent(style STRING) RETURNS INT":
            f"coalesce(try_cast(regexp_extract(coalesce(style, ''), {_text(K.PROGRESS_PATTERN)}, 1) AS INT), 0)",
        "card_title(attr STRING, t STRING) RETURNS STRING": "CASE WHEN attr <> '' THEN attr ELSE strip_text(t) END",
        "date_span(spans ARRAY<STRING>) RETURNS STRING": f"try_element_at(filter(spans, s -> s <> '' AND ({is_date})), 1)",
        "relative_amount(t STRING) RETURNS BIGINT": amount,
        "relative_unit(t STRING) RETURNS STRING": unit,
        "relative_created(t STRING, as_of TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ":
            f"CASE WHEN relative_amount(t) IS NOT NULL AND ({seconds} IS NOT NULL OR {months} IS NOT NULL) THEN "
            f"timestampadd(SECOND, -relative_amount(t) * coalesce({seconds}, 0), "
            f"timestampadd(MONTH, -relative_amount(t) * coalesce({months}, 0), as_of)) END",
    }


def register(spark: SparkSession) -> None:
    """Create all functions in the session."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
