"""Page extraction queries."""

from __future__ import annotations

from reelhouse.operators import ingest as I
from reelhouse.plans.registry import query
from reelhouse.sources import fixtures as X
from reelhouse.sources import html_cards as H
from reelhouse.sources.tables import read_table


@query("page_facts")
def page_facts(spark, sf_dir):
    return H.page_facts(read_table(spark, sf_dir, "pages"))


@query("page_links")
def page_links(spark, sf_dir):
    return H.page_anchors(read_table(spark, sf_dir, "pages"))


IMPORT_SQL = """
WITH cards AS (
  SELECT c.*, canonical_link(c.href, '{site}') AS link
  FROM {pages} p, LATERAL extract_cards(p.page_id, p.html) c
  WHERE NOT (coalesce(c.is_ad, false) OR coalesce(c.is_sponsored, false) OR coalesce(c.is_collection, false))),
kept AS (SELECT * FROM cards WHERE link IS NOT NULL AND title_text IS NOT NULL),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id NULLS LAST, pos NULLS LAST) AS place FROM kept) WHERE place = 1),
fresh AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM {library} l WHERE l.link = f.link))
SELECT page_id, pos, link, card_title(title_attr, title_text) AS title, channel, thumbnail_url(thumb_src, link) AS thumbnail,
       progress_percent(progress_style) AS progress, length_text(length_text) AS length_text,
       relative_created(date_span(meta_spans), TIMESTAMP_NTZ '{as_of}') AS video_created,
       length_seconds(length_text(length_text)) AS length_seconds, length_problem(length_text(length_text)) AS problem
FROM fresh"""


@query("import_sql")
def import_sql(spark, sf_dir):
    """The import of feed pages up to the new items, in SQL alone."""
    H.register_sql_functions(spark)
    X.feed_pages(spark, sf_dir).createOrReplaceTempView("import_sql_pages")
    X.library(spark, sf_dir).createOrReplaceTempView("import_sql_library")
    return spark.sql(IMPORT_SQL.format(site=X.MEDIA_BASE, as_of=X.AS_OF, pages="import_sql_pages", library="import_sql_library"))


@query("feed_html_cards")
def feed_html_cards(spark, sf_dir):
    cards = H.extract_cards(X.feed_pages(spark, sf_dir))
    return I.clean_cards(cards, X.AS_OF, X.MEDIA_BASE)
