"""Independent DuckDB SQL for every query that SQL can express.

Each entry is written from the operator's definition, not generated from the
Spark plan.  Derived tables are common table expressions over the given
tables, mirroring :mod:`reelhouse.sources.fixtures`.
"""

from __future__ import annotations

AS_OF = "timestamp '2024-02-01 00:00:00'"

LIBRARY = f"""
library AS (
  SELECT d.doc_id AS id,
         substring(d.text, 1, 40) AS title,
         'https://media.example/watch?v=' || CAST(d.doc_id AS VARCHAR) AS link,
         d.source AS channel,
         'https://i.ytimg.com/vi/' || CAST(d.doc_id AS VARCHAR) || '/hqdefault.jpg' AS thumbnail,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.text END AS subtitles,
         CASE WHEN d.doc_id % 5 = 0 OR d.doc_id % 3 = 0 THEN NULL
              ELSE regexp_extract(d.text, '^[^.!?]*[.!?]?', 0) END AS summary,
         CAST(NULL AS VARCHAR) AS blurb,
         CASE WHEN d.doc_id % 4 = 0 THEN NULL
              ELSE '- ' || d.lang || chr(10) || '- ' || d.source END AS themes,
         CAST(d.doc_id % 101 AS INTEGER) AS progress,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 'cat_' || d.lang END AS category,
         {AS_OF} - to_seconds((d.doc_id * 4099) % 40000000) AS video_created,
         CAST(CASE d.doc_id % 6 WHEN 0 THEN 330 WHEN 1 THEN 5025 WHEN 2 THEN 0
                               WHEN 4 THEN 727 ELSE NULL END AS BIGINT) AS length_seconds,
         {AS_OF} AS record_created,
         coalesce(l.toxic = 1, false) AS hidden
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

SQL: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL["category_counts"] = _with(LIBRARY) + """
SELECT category, count(*) AS n, category || ' (' || CAST(count(*) AS VARCHAR) || ')' AS label
FROM library WHERE category IS NOT NULL AND NOT hidden
GROUP BY category ORDER BY category"""

SQL["library_top50"] = _with(LIBRARY) + """
SELECT id, title, link, channel, category, progress, length_seconds
FROM library WHERE hidden = false ORDER BY id DESC LIMIT 50"""

SQL["library_top50_category"] = _with(LIBRARY) + """
SELECT id, title, link, category
FROM library WHERE hidden = false AND category = 'cat_fr' ORDER BY id DESC LIMIT 50"""

_AGE_SECONDS = f"CAST(trunc(epoch({AS_OF} - video_created)) AS BIGINT)"


def _age_phrase(unit_secs: int, unit: str) -> str:
    k = f"(s // {unit_secs})"
    return (f"CAST({k} AS VARCHAR) || ' {unit}' || CASE WHEN {k} = 1 THEN '' ELSE 's' END || ' ago'")


_AGE = f"""CASE WHEN s IS NULL THEN NULL WHEN s < 0 THEN 'in the future'
     WHEN s < 60 THEN 'just now'
     WHEN s < 3600 THEN {_age_phrase(60, 'minute')}
     WHEN s < 86400 THEN {_age_phrase(3600, 'hour')}
     WHEN s < 604800 THEN {_age_phrase(86400, 'day')}
     WHEN s < 2592000 THEN {_age_phrase(604800, 'week')}
     WHEN s < 31536000 THEN {_age_phrase(2592000, 'month')}
     ELSE {_age_phrase(31536000, 'year')} END"""

SQL["library_view"] = _with(LIBRARY, f"""
top AS (SELECT *, {_AGE_SECONDS} AS s, row_number() OVER (ORDER BY id DESC) AS rk
        FROM library WHERE NOT hidden ORDER BY id DESC LIMIT 50)""") + f"""
SELECT id, thumbnail, channel, category, '**' || title || '**' AS title_md, length_seconds,
       {_AGE} AS age,
       CAST(progress AS VARCHAR) AS progress_text, hidden, '[link](' || link || ')' AS link_md,
       length(coalesce(subtitles, '')) > 0 AS has_subtitles,
       CASE WHEN rk = 1 THEN summary END AS summary_shown, rk = 1 AS expanded
FROM top"""

SQL["distinct_categories"] = _with(LIBRARY) + """
SELECT DISTINCT category FROM library WHERE category IS NOT NULL ORDER BY category"""

SQL["queue_subtitles"] = _with(LIBRARY) + """
SELECT id, link FROM library WHERE NOT hidden AND subtitles IS NULL ORDER BY id DESC"""

SQL["queue_themes"] = _with(LIBRARY) + """
SELECT id, title FROM library WHERE NOT hidden AND themes IS NULL AND subtitles IS NOT NULL"""

SQL["queue_summaries"] = _with(LIBRARY) + """
SELECT id, CAST(length(subtitles) AS BIGINT) AS subtitle_chars
FROM library WHERE NOT hidden AND subtitles IS NOT NULL AND summary IS NULL ORDER BY id DESC"""

SQL["lookup_links"] = _with(LIBRARY) + """
SELECT id, link FROM library WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)"""

SQL["validate_library"] = _with(LIBRARY, """
torn AS (SELECT id, CASE WHEN id % 10 = 3 THEN NULL ELSE title END AS title, link, record_created, hidden FROM library
         UNION ALL SELECT id, title, link, record_created, hidden FROM library WHERE id % 7 = 0)""") + """
SELECT rule, rows FROM (
  SELECT 'id is null' AS rule, CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS rows FROM torn
  UNION ALL SELECT 'title is null', count(*) FILTER (WHERE title IS NULL) FROM torn
  UNION ALL SELECT 'link is null', count(*) FILTER (WHERE link IS NULL) FROM torn
  UNION ALL SELECT 'record_created is null', count(*) FILTER (WHERE record_created IS NULL) FROM torn
  UNION ALL SELECT 'hidden is null', count(*) FILTER (WHERE hidden IS NULL) FROM torn
  UNION ALL SELECT 'link is not unique', CAST(coalesce(sum(n), 0) AS BIGINT)
            FROM (SELECT link, count(*) AS n FROM torn GROUP BY link HAVING count(*) > 1)
) WHERE rows > 0"""

SQL["queue_subtitles_retry"] = _with(LIBRARY) + """
SELECT id, link FROM library WHERE NOT hidden AND subtitles IS NULL AND id % 3 <> 0"""


# ---- feed cards and their cleaning ----------------------------------------

WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_VID = "CAST(user_id * 10 AS VARCHAR)"
FEED = f"""
feed AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS page_id,
         event_id AS pos,
         CASE WHEN event_id % 97 = 0 THEN ''
              WHEN event_id % 2 = 0 THEN '/watch?v=' || {_VID} || '&t=' || CAST(event_id AS VARCHAR)
              ELSE 'https://media.example/watch?v=' || {_VID} || '&t=' || CAST(event_id AS VARCHAR) END AS href,
         CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Video ' || {_VID} END AS title_attr,
         ' Video ' || {_VID} || ' ' AS title_text,
         event_type AS channel,
         CASE WHEN event_id % 2 = 0 THEN NULL
              ELSE 'https://media.example/img/' || {_VID} || '.jpg' END AS thumb_src,
         CASE event_id % 7 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'upcoming' WHEN 2 THEN '5:75'
              WHEN 3 THEN '1:02:03' WHEN 4 THEN ' 4:05 ' WHEN 5 THEN 'SHORTS'
              ELSE CAST(CAST(floor(value / 60) AS BIGINT) % 100 AS VARCHAR) || ':' ||
                   lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS length_text,
         CASE event_id % 4 WHEN 0 THEN 'width: 61%;' WHEN 1 THEN 'width:7%'
              WHEN 2 THEN 'width: 61.5%' ELSE NULL END AS progress_style,
         CASE WHEN event_id % 13 = 0 THEN NULL
              ELSE CAST(1 + event_id % 11 AS VARCHAR) || ' ' ||
                   CASE event_id % 6 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'days'
                        WHEN 3 THEN 'weeks' WHEN 4 THEN 'months' ELSE 'years' END || ' ago' END AS created_text,
         event_id % 50 IN (7, 8, 9) AS skipped
  FROM events
)"""


def link_sql(href: str, base: str = "https://media.example") -> str:
    return (f"CASE WHEN {href} IS NULL OR {href} = '' THEN NULL ELSE split_part("
            f"CASE WHEN starts_with({href}, 'http') THEN {href} ELSE '{base}' || {href} END, '&', 1) END")


def thumb_sql(src: str, link: str) -> str:
    return (f"CASE WHEN {src} IS NOT NULL AND {src} <> '' THEN {src} ELSE "
            f"'https://i.ytimg.com/vi/' || nullif(regexp_extract({link}, '[?&]v=([^&]+)', 1), '') "
            f"|| '/hqdefault.jpg' END")


def progress_sql(style: str) -> str:
    return (f"coalesce(TRY_CAST(nullif(regexp_extract(coalesce({style}, ''), "
            f"'width:\\s*([0-9]+)%', 1), '') AS INTEGER), 0)")


def norm_len_sql(text: str) -> str:
    b = f"(CASE WHEN upper({text}) IN ('UPCOMING', 'LIVE') THEN NULL ELSE {text} END)"
    s = strip_sql(b)
    return (f"CASE WHEN {b} IS NULL THEN NULL WHEN regexp_matches({s}, "
            f"'^[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN {s} ELSE '00:00' END")


def seconds_sql(n: str, mode: str) -> str:
    f1 = f"TRY_CAST(split_part({n}, ':', 1) AS BIGINT)"
    f2 = f"TRY_CAST(split_part({n}, ':', 2) AS BIGINT)"
    f3 = f"TRY_CAST(nullif(split_part({n}, ':', 3), '') AS BIGINT)"
    nf = f"len(string_split({n}, ':'))"
    two = f"{f1} * 60 + {f2}" if mode == "ms" else f"{f1} * 3600 + {f2} * 60"
    return (f"CASE WHEN {f2} > 59 OR coalesce({f3}, 0) > 59 THEN NULL "
            f"WHEN {nf} = 3 THEN {f1} * 3600 + {f2} * 60 + {f3} ELSE {two} END")


def problem_sql(n: str) -> str:
    f2 = f"TRY_CAST(split_part({n}, ':', 2) AS BIGINT)"
    f3 = f"TRY_CAST(nullif(split_part({n}, ':', 3), '') AS BIGINT)"
    return (f"CASE WHEN {n} IS NOT NULL AND ({f2} > 59 OR coalesce({f3}, 0) > 59) "
            f"THEN 'length field out of range' END")


def created_sql(text: str) -> str:
    pat = r"([0-9]+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    n = f"TRY_CAST(regexp_extract(lower({text}), '{pat}', 1) AS BIGINT)"
    u = f"regexp_extract(lower({text}), '{pat}', 2)"
    return (f"CASE WHEN {n} IS NULL THEN NULL WHEN {u} = 'second' THEN {AS_OF} - to_seconds({n}) "
            f"WHEN {u} = 'minute' THEN {AS_OF} - to_minutes({n}) WHEN {u} = 'hour' THEN {AS_OF} - to_hours({n}) "
            f"WHEN {u} = 'day' THEN {AS_OF} - to_days({n}) WHEN {u} = 'week' THEN {AS_OF} - to_days(7 * {n}) "
            f"WHEN {u} = 'month' THEN {AS_OF} - to_months({n}) WHEN {u} = 'year' THEN {AS_OF} - to_months(12 * {n}) END")


def title_sql(attr: str, text: str) -> str:
    return f"CASE WHEN {attr} IS NOT NULL AND {attr} <> '' THEN {attr} ELSE {strip_sql(text)} END"


def items_sql(src: str) -> str:
    return f"""
items AS (
  SELECT page_id, pos, {link_sql('href')} AS link,
         CASE WHEN title_text IS NOT NULL THEN {title_sql('title_attr', 'title_text')} END AS title,
         channel, {thumb_sql('thumb_src', link_sql('href'))} AS thumbnail,
         {progress_sql('progress_style')} AS progress,
         {norm_len_sql('length_text')} AS length_text,
         {created_sql('created_text')} AS video_created
  FROM {src} WHERE NOT skipped
),
clean AS (SELECT * FROM items WHERE link IS NOT NULL AND title IS NOT NULL),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM clean) WHERE rn = 1
),
fresh AS (
  SELECT *, {seconds_sql('length_text', 'ms')} AS length_seconds, {problem_sql('length_text')} AS problem
  FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.link = f.link)
)"""


ITEMS = items_sql("feed")

SQL["length_normalised"] = _with(FEED) + f"""
SELECT pos, {norm_len_sql('length_text')} AS length_text FROM feed"""

SQL["length_seconds"] = _with(FEED, f"""
n AS (SELECT pos, {norm_len_sql('length_text')} AS n FROM feed)""") + f"""
SELECT pos, {seconds_sql('n', 'ms')} AS seconds_ms, {seconds_sql('n', 'hm')} AS seconds_hm,
       {problem_sql('n')} AS problem FROM n"""

SQL["progress_pct"] = _with(FEED) + f"""
SELECT pos, {progress_sql('progress_style')} AS progress FROM feed"""

SQL["link_thumbnail"] = _with(FEED) + f"""
SELECT pos, {link_sql('href')} AS link, {thumb_sql('thumb_src', link_sql('href'))} AS thumbnail FROM feed"""

SQL["created_from_relative"] = _with(FEED) + f"""
SELECT pos, {created_sql('created_text')} AS video_created FROM feed"""

SQL["card_title"] = _with(FEED) + f"""
SELECT pos, {title_sql('title_attr', 'title_text')} AS title FROM feed"""

SQL["clean_cards"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT * FROM clean"""

SQL["first_per_link"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT * FROM firsts"""

SQL["import_new_links"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT link, page_id, pos, title FROM fresh"""

SQL["ingest_rejects"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT link, length_text, problem FROM fresh WHERE problem IS NOT NULL"""

SQL["append_items"] = _with(LIBRARY, FEED, ITEMS) + f"""
SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY page_id, pos) AS id,
       title, link, channel, thumbnail, CAST(NULL AS VARCHAR) AS subtitles,
       CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS blurb, CAST(NULL AS VARCHAR) AS themes,
       progress, CAST(NULL AS VARCHAR) AS category, video_created, length_seconds,
       {AS_OF} AS record_created, false AS hidden
FROM fresh WHERE problem IS NULL"""

# ---- transcripts, chunks, answers ------------------------------------------

CAPTIONS = """
captions AS (
  SELECT 'https://media.example/watch?v=' || CAST(conv_id * 15 AS VARCHAR) AS link,
         CASE WHEN conv_id % 4 = 3 THEN 'en' ELSE 'a.en' END AS track,
         replace(string_agg(text, '' ORDER BY turn), chr(10), ' ') AS transcript
  FROM conversations GROUP BY conv_id
)"""

PREAMBLE = r"'^Here( are| is|''s)\s[^\n]*?\n\n'"


def join_answers_sql(agg: str) -> str:
    """Joined answers (already newline-joined by ``agg``) -> cleaned answer."""
    return strip_sql(f"regexp_replace({agg} || chr(10), {PREAMBLE}, '')")


ANSWERS = """
answers AS (
  SELECT conv_id AS id, turn AS chunk,
         CASE WHEN conv_id % 3 = 0 THEN 'Here is a summary:' || chr(10) || chr(10) || text
              WHEN conv_id % 3 = 1 THEN 'Here are notes' || chr(10) || text || chr(10)
              ELSE '  ' || text || ' ' || chr(10) END AS response
  FROM conversations WHERE role = 'assistant'
)"""

_NAME = "('cat_' || lang)"
CAT_ANSWERS = f"""
cat_answers AS (
  SELECT doc_id AS id,
         CASE doc_id % 5 WHEN 0 THEN 'Category: **' || {_NAME} || '** fits'
                         WHEN 1 THEN ' ' || {_NAME} || chr(10)
                         WHEN 2 THEN 'The best one is ' || {_NAME}
                         WHEN 3 THEN '"' || {_NAME} || '"'
                         ELSE '*' || upper({_NAME}) || '*' END AS answer
  FROM documents
)"""


def clean_cat_sql(answer: str) -> str:
    s = f"replace({strip_sql(answer)}, 'Category: ', '')"
    inner = f"regexp_extract({s}, '\\*\\*([^*]+)\\*\\*', 1)"
    return f"CASE WHEN contains({s}, '**') AND {inner} <> '' THEN {inner} ELSE {s} END"


def words_sql(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) AS BIGINT)"


CONFIGURED = "News, Music ,,Science & Tech, cat_en, uncategorized"
VOCAB = f"""
configured AS (
  SELECT DISTINCT {strip_sql('x')} AS category
  FROM (SELECT unnest(string_split('{CONFIGURED}', ',')) AS x) WHERE {strip_sql('x')} <> ''
),
vocab AS (
  SELECT category FROM configured
  UNION SELECT DISTINCT category FROM library WHERE category IS NOT NULL AND NOT category ILIKE 'Uncategorized'
)"""

SQL["captions_to_text"] = _with(CAPTIONS) + """
SELECT link, transcript FROM captions WHERE track = 'a.en'"""

SQL["backfill_subtitles"] = _with(LIBRARY, CAPTIONS) + """
SELECT id, CAST(length(s) AS BIGINT) AS subtitle_chars, sha256(coalesce(s, '')) AS subtitle_hash
FROM (SELECT l.id, CASE WHEN NOT l.hidden AND l.subtitles IS NULL AND c.transcript IS NOT NULL
                        THEN c.transcript ELSE l.subtitles END AS s
      FROM library l LEFT JOIN captions c ON c.link = l.link AND c.track = 'a.en')"""

SQL["text_chunks"] = """
SELECT doc_id, CAST(i // 4096 AS BIGINT) AS chunk_no, substring(text, i + 1, 4096) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 4096)) AS i FROM documents)"""

SQL["chunks_rejoined"] = """
WITH parts AS (
  SELECT doc_id, i, substring(text, i + 1, 4096) AS c
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 4096)) AS i FROM documents))
SELECT p.doc_id, count(*) AS n_chunks, string_agg(p.c, '' ORDER BY p.i) = any_value(d.text) AS same
FROM parts p JOIN documents d USING (doc_id) GROUP BY p.doc_id"""

SQL["clean_response"] = _with(ANSWERS) + f"""
SELECT id, CAST(chunk AS BIGINT) AS chunk, {join_answers_sql('response')} AS answer FROM answers"""

SQL["reassemble_answers"] = _with(ANSWERS) + f"""
SELECT id, {join_answers_sql("string_agg(response, chr(10) ORDER BY chunk)")} AS answer
FROM answers GROUP BY id"""

SQL["clean_category"] = _with(CAT_ANSWERS, f"""
c AS (SELECT id, {clean_cat_sql('answer')} AS category FROM cat_answers)""") + f"""
SELECT id, category, {words_sql('category')} AS words, contains(category, '"') AS has_quote FROM c"""

SQL["category_membership"] = _with(LIBRARY, CAT_ANSWERS, f"""
pats AS (SELECT -doc_id - 1 AS id, (['AC\\DC', 'cat\\', '%', 'cat\\_en', 'c_t\\_FR', '______', '_', 'c%\\n', 'zz%', 'C%_d%'])
                [(doc_id % 10 + 1)::INT] AS category FROM documents),
c AS (SELECT id, {clean_cat_sql('answer')} AS category FROM cat_answers UNION ALL SELECT id, category FROM pats),
names AS (SELECT DISTINCT category FROM library WHERE category IS NOT NULL),
-- a backslash before an ordinary character stands for nothing, one at the end matches nothing
u AS (SELECT DISTINCT category, regexp_replace(category, '(\\\\[%_\\\\])|\\\\', '\\1', 'g') AS pattern,
             length(regexp_extract(category, '(\\\\*)$', 1)) % 2 = 1 AS dangling FROM c),
kn AS (SELECT category, NOT dangling AND EXISTS (SELECT 1 FROM names l WHERE l.category ILIKE u.pattern ESCAPE '\\') AS known FROM u),
k AS (SELECT c.id, c.category, kn.known FROM c JOIN kn ON kn.category = c.category)""") + f"""
SELECT id, category, known,
       known AND NOT contains(category, '"') AND {words_sql('category')} <= 3 AS valid FROM k"""

SQL["candidate_vocabulary"] = _with(LIBRARY, VOCAB) + """
SELECT category FROM vocab"""

SQL["vocabulary_text"] = _with(LIBRARY, VOCAB) + """
SELECT string_agg(category, chr(10) ORDER BY category) AS vocabulary FROM vocab"""

SQL["tool_call_category"] = """
SELECT conv_id AS id, arg_max('cat_' || role, turn) AS category FROM conversations GROUP BY conv_id"""

SQL["rename_categories"] = _with(LIBRARY) + """
SELECT id, CASE category WHEN 'cat_de' THEN 'Deutsch' WHEN 'German' THEN 'Deutsch'
                         WHEN 'cat_fr' THEN 'cat_en' ELSE category END AS category
FROM library"""

SQL["set_hidden"] = _with(LIBRARY) + """
SELECT l.id, CASE WHEN b.doc_id % 2 = 0 THEN b.quality = 1 WHEN b.doc_id IS NOT NULL THEN b.quality = 0 ELSE l.hidden END AS hidden
FROM library l LEFT JOIN labels b ON b.doc_id = l.id"""

SQL["apply_updates"] = _with(LIBRARY) + """
SELECT l.id,
       CASE WHEN b.doc_id % 3 = 0 THEN NULL
            WHEN b.doc_id IS NOT NULL THEN CASE WHEN b.quality = 1 THEN 'reviewed' END ELSE l.summary END AS summary,
       CASE WHEN b.doc_id % 3 = 0 THEN NULL WHEN b.doc_id IS NOT NULL THEN '- toxic ' || CAST(b.toxic AS VARCHAR) ELSE l.themes END AS themes,
       l.category
FROM library l LEFT JOIN labels b ON b.doc_id = l.id"""

# ---- model passes ------------------------------------------------------------

SENTENCES = "regexp_extract_all(c, '[^.!?]+[.!?]?')"


def sentence_sql(sign: str) -> str:
    """The longest (``-``) or shortest (``+``) sentence of chunk ``c``, the earliest of equals."""
    ranked = (f"list_transform(range(1, len({SENTENCES}) + 1), lambda i: struct_pack("
              f"o := {sign}length({SENTENCES}[i]), i := i, s := {SENTENCES}[i]))")
    return strip_sql(f"coalesce(list_sort({ranked})[1].s, '')")


LONGEST = sentence_sql("-")
SHORTEST = sentence_sql("+")
TOKEN = r"'[^\p{L}\p{N}]+'"
TERMS = f"""array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(list_filter(
  regexp_split_to_array(lower(c), {TOKEN}), lambda t: t <> '')), lambda t: struct_pack(o := -length(t), t := t))), 1, 3),
  lambda r: '- ' || r.t), chr(10))"""


def passes_sql(src: str, name: str, size: int, model: str, passes: int = 4, chunk: int = 4096) -> str:
    """CTEs answering ``x`` of ``src(id, x)`` once, then again while longer than
    ``size``; the final CTE is ``{name}`` with columns (id, x)."""
    ctes = []
    prev = src
    for k in range(passes + 1):
        out = name if k == passes else f"{name}_{k}"
        cond = "TRUE" if k == 0 else f"length(s.x) > {size}"
        ctes.append(f"""
{out}_c AS (
  SELECT id, i, substring(x, i + 1, {chunk}) AS c
  FROM (SELECT s.id, s.x, unnest(range(0, length(s.x), {chunk})) AS i FROM {prev} s
        WHERE s.x IS NOT NULL AND {cond})),
{out}_a AS (
  SELECT id, {join_answers_sql(f"string_agg({model}, chr(10) ORDER BY i)")} AS y FROM {out}_c GROUP BY id),
{out} AS (
  SELECT s.id, CASE WHEN s.x IS NULL THEN NULL WHEN {cond} THEN coalesce(a.y, '') ELSE s.x END AS x
  FROM {prev} s LEFT JOIN {out}_a a USING (id))""")
        prev = out
    return ",".join(ctes)


SQL["summarize_lead"] = _with(LIBRARY, """
q AS (SELECT id, subtitles AS x FROM library WHERE NOT hidden AND subtitles IS NOT NULL AND summary IS NULL)""",
                               passes_sql("q", "summ", 4096, LONGEST)) + """
SELECT id, x AS summary FROM summ"""

SQL["summarize_batch"] = SQL["summarize_lead"]

SQL["summarize_import"] = _with(LIBRARY, """
q AS (SELECT id, title || ' - ' || subtitles AS x FROM library WHERE subtitles IS NOT NULL)""",
                                 passes_sql("q", "summ", 4096, LONGEST)) + """
SELECT id, x AS summary FROM summ"""

SQL["blurb_lead"] = _with(LIBRARY, """
q AS (SELECT id, subtitles AS x FROM library WHERE subtitles IS NOT NULL)""",
                           passes_sql("q", "bl", 0, SHORTEST, passes=0)) + """
SELECT id, x AS blurb FROM bl"""



def keyword_scores_sql(items: str) -> str:  # noqa: D401
    """CTEs kw and sc: candidate keywords and (id, category, score) for ``items(id, t)``."""
    return f"""
kw AS (SELECT DISTINCT category, token FROM
         (SELECT category, unnest(regexp_split_to_array(lower(category), {TOKEN})) AS token FROM vocab)
       WHERE token <> ''),
tok AS (SELECT id, unnest(regexp_split_to_array(lower(t), {TOKEN})) AS token FROM {items}),
sc AS (SELECT id, category, count(*) AS score FROM tok JOIN kw USING (token) GROUP BY id, category),
rk AS (SELECT id, category, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS rank FROM sc)"""


SQL["backfill_themes"] = _with(LIBRARY, VOCAB, """
q AS (SELECT id, title, title || ' - ' || subtitles AS x FROM library
      WHERE NOT hidden AND themes IS NULL AND subtitles IS NOT NULL)""",
                                passes_sql("q", "th", 1024, TERMS), """
items AS (SELECT id, title AS t FROM q)""", keyword_scores_sql("items")) + """
SELECT th.id, th.x AS themes, rk.category FROM th LEFT JOIN rk ON rk.id = th.id AND rk.rank = 1"""

SQL["categorize_keyword"] = _with(LIBRARY, VOCAB, """
items AS (SELECT l.id, l.title || chr(10) || coalesce(d.text, '') AS t
          FROM library l JOIN documents d ON d.doc_id = l.id WHERE NOT hidden)""",
                                   keyword_scores_sql("items")) + """
SELECT items.id, rk.category FROM items LEFT JOIN rk ON rk.id = items.id AND rk.rank = 1"""

SQL["categorize_free"] = _with(LIBRARY, VOCAB, """
items AS (SELECT l.id, l.title || chr(10) || coalesce(d.text, '') || chr(10) || coalesce(themes, '') AS t
          FROM library l JOIN documents d ON d.doc_id = l.id WHERE NOT hidden)""", keyword_scores_sql("items"), f"""
ans AS (SELECT id, rank, {clean_cat_sql('category')} AS answer FROM rk WHERE rank <= 4),
val AS (SELECT *, (EXISTS (SELECT 1 FROM library l WHERE l.category ILIKE ans.answer))
                  AND NOT contains(answer, '"') AND {words_sql('answer')} <= 3 AS valid,
               {words_sql('answer')} > 3 AS too_long FROM ans),
per AS (SELECT id, min(rank) FILTER (WHERE valid) AS kv,
               min(rank) FILTER (WHERE NOT valid AND too_long) AS kl, count(*) AS m FROM val GROUP BY id),
pick AS (SELECT p.id,
           CASE WHEN p.kv IS NOT NULL AND (p.kl IS NULL OR p.kv < p.kl)
                  THEN (SELECT answer FROM val v WHERE v.id = p.id AND v.rank = p.kv)
                WHEN p.kl IS NOT NULL THEN 'Uncategorized'
                WHEN p.m >= 4 THEN (SELECT answer FROM val v WHERE v.id = p.id AND v.rank = 4)
                ELSE 'Uncategorized' END AS c FROM per p)""") + """
SELECT items.id, coalesce(replace(replace(pick.c, '*', ''), chr(10), ''), 'Uncategorized') AS category
FROM items LEFT JOIN pick USING (id)"""

# ---- pages -------------------------------------------------------------------


def unescape_sql(x: str) -> str:
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "\u00a9"),
                 ("&middot;", "\u00b7"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


SQL["page_facts"] = f"""
SELECT page_id,
       {strip_sql(unescape_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title,
       {strip_sql(unescape_sql("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS heading,
       regexp_matches(html, '<[a-z0-9]+ [^>]*class="([^"]* )?ad( [^"]*)?"') AS has_ad,
       CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_links
FROM pages"""

_A = """'<a href="([^"]*)">([^<]*)</a>'"""
SQL["page_links"] = f"""
SELECT page_id, CAST(k AS BIGINT) AS pos, {unescape_sql('hrefs[k + 1]')} AS href,
       {strip_sql(unescape_sql('texts[k + 1]'))} AS text
FROM (SELECT page_id, hrefs, texts, unnest(range(len(hrefs))) AS k
      FROM (SELECT page_id, regexp_extract_all(html, {_A}, 1) AS hrefs,
                   regexp_extract_all(html, {_A}, 2) AS texts FROM pages))"""

FEED_HTML = """
feed_html AS (
  SELECT * REPLACE (pos // 100 AS page_id, pos % 100 AS pos,
                    CASE WHEN pos % 11 = 0 THEN '' ELSE href END AS href)
  FROM feed)"""

SQL["feed_html_cards"] = _with(FEED, FEED_HTML, items_sql("feed_html").split(",\nfirsts AS")[0]) + """
SELECT * FROM clean"""

# ---- maintenance, streaming, full import -------------------------------------

SQL["snapshot_retention"] = """
SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) <= 5 AS keep
FROM (SELECT DISTINCT strftime(ts, '%Y%m%d') AS snapshot_date FROM events)"""

SQL["snapshot_publish"] = _with(LIBRARY) + """
SELECT '20240201' AS snapshot_date, count(*) AS n, CAST(sum(CAST(hidden AS BIGINT)) AS BIGINT) AS hidden FROM library"""

SQL["stream_import_links"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT link FROM fresh"""

SQL["ingest_full"] = _with(LIBRARY, FEED, ITEMS, CAPTIONS, VOCAB, """
ok AS (SELECT * FROM fresh WHERE problem IS NULL),
q AS (SELECT o.link AS id, o.title || ' - ' || c.transcript AS x
      FROM ok o LEFT JOIN captions c ON c.link = o.link AND c.track = 'a.en')""",
                            passes_sql("q", "summ", 4096, LONGEST), """
citems AS (SELECT o.link AS id, o.title || chr(10) || coalesce(s.x, '') AS t FROM ok o JOIN summ s ON s.id = o.link)""",
                            keyword_scores_sql("citems")) + """
SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY o.page_id, o.pos) AS id,
       o.link, o.title, o.length_seconds, o.video_created,
       sha256(coalesce(c.transcript, '')) AS subtitle_hash, s.x AS summary, rk.category
FROM ok o LEFT JOIN captions c ON c.link = o.link AND c.track = 'a.en'
     LEFT JOIN summ s ON s.id = o.link LEFT JOIN rk ON rk.id = o.link AND rk.rank = 1"""

SQL["backfill_summaries"] = _with(LIBRARY, """
q AS (SELECT id, subtitles AS x FROM library WHERE NOT hidden AND subtitles IS NOT NULL AND summary IS NULL)""",
                                   passes_sql("q", "summ", 4096, LONGEST)) + """
SELECT l.id, CASE WHEN s.id IS NOT NULL THEN s.x ELSE l.summary END AS summary,
       CASE WHEN s.id IS NOT NULL THEN NULL ELSE l.themes END AS themes,
       CAST(NULL AS VARCHAR) AS blurb
FROM library l LEFT JOIN summ s ON s.id = l.id"""

SQL["retry_summaries"] = _with(LIBRARY, """
q AS (SELECT id, subtitles AS x FROM library
      WHERE subtitles IS NOT NULL AND id IN (SELECT doc_id FROM labels WHERE quality = 1))""",
                                passes_sql("q", "summ", 4096, LONGEST)) + """
SELECT l.id, CASE WHEN s.id IS NOT NULL THEN s.x ELSE l.summary END AS summary
FROM library l LEFT JOIN summ s ON s.id = l.id"""

SQL["cards_found"] = """
SELECT CAST(event_id // 100 AS BIGINT) AS page_id, count(*) AS cards FROM events GROUP BY 1"""


SQL["created_phrases"] = f"""
SELECT event_id, CASE event_id % 14 WHEN 0 THEN {AS_OF} - INTERVAL 1 HOUR WHEN 1 THEN {AS_OF} - INTERVAL 1 DAY
  WHEN 2 THEN {AS_OF} - INTERVAL 1 DAY WHEN 3 THEN {AS_OF} - INTERVAL 2 HOUR WHEN 4 THEN {AS_OF}
  WHEN 5 THEN {AS_OF} - INTERVAL 7 DAY WHEN 6 THEN {AS_OF} - INTERVAL 3 MONTH WHEN 7 THEN {AS_OF} - INTERVAL 3 MINUTE
  WHEN 9 THEN {AS_OF} - INTERVAL 120 MONTH WHEN 13 THEN {AS_OF} - INTERVAL 5 DAY END AS video_created
FROM events"""

SQL["enrich_rejects"] = _with(LIBRARY, f"""
q AS (SELECT id, subtitles AS x FROM library WHERE NOT hidden AND subtitles IS NOT NULL AND summary IS NULL),
c AS (SELECT id, i, substring(x, i + 1, 4096) AS c FROM (SELECT id, x, unnest(range(0, length(x), 4096)) AS i FROM q)),
a AS (SELECT id, bool_or(length(c) % 5 = 0) AS failed, {join_answers_sql("string_agg(right(c, 20), chr(10) ORDER BY i)")} AS y
      FROM c GROUP BY id)""") + """
SELECT q.id, CASE WHEN coalesce(a.failed, false) THEN NULL ELSE coalesce(a.y, '') END AS summary,
       CASE WHEN a.failed THEN 'ValueError: refused' END AS problem
FROM q LEFT JOIN a USING (id)"""

SQL["categorize_model"] = _with(LIBRARY, VOCAB) + """
SELECT l.id, CASE WHEN l.id % 5 = 0 THEN (SELECT min(category) FROM vocab WHERE lower(category) = 'cat_en') END AS category,
       CASE WHEN l.id % 5 = 4 THEN 'ValueError: no answer' END AS problem
FROM library l WHERE NOT hidden"""

SQL["categorize_free_model"] = _with(LIBRARY) + """
SELECT id, CASE id % 5 WHEN 0 THEN 'cat_EN' WHEN 1 THEN 'Uncategorized' WHEN 2 THEN 'cat_fr' WHEN 3 THEN 'nothing known' END AS category,
       CASE WHEN id % 5 = 4 THEN 'ValueError: no answer' END AS problem
FROM library WHERE NOT hidden"""


SQL["ingest_pages"] = _with(LIBRARY, FEED, FEED_HTML, items_sql("feed_html"), CAPTIONS, VOCAB, """
ok AS (SELECT * FROM fresh WHERE problem IS NULL),
q AS (SELECT o.link AS id, o.title || ' - ' || c.transcript AS x
      FROM ok o LEFT JOIN captions c ON c.link = o.link AND c.track = 'a.en')""",
                             passes_sql("q", "summ", 4096, LONGEST), """
citems AS (SELECT o.link AS id, o.title || chr(10) || coalesce(s.x, '') AS t FROM ok o JOIN summ s ON s.id = o.link)""",
                             keyword_scores_sql("citems")) + """
SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY o.page_id, o.pos) AS id,
       o.link, o.title, rk.category, sha256(coalesce(s.x, '')) AS summary_hash
FROM ok o LEFT JOIN summ s ON s.id = o.link LEFT JOIN rk ON rk.id = o.link AND rk.rank = 1
UNION ALL SELECT id, link, title, category, sha256(coalesce(summary, '')) FROM library"""

# ---- the stored library ------------------------------------------------------------

SQL["update_stored"] = SQL["apply_updates"]
SQL["append_stored"] = SQL["append_items"]
SQL["library_top50_stored"] = SQL["library_top50"]
SQL["library_top50_category_stored"] = SQL["library_top50_category"]
SQL["lookup_links_stored"] = SQL["lookup_links"]
SQL["import_stored"] = SQL["ingest_pages"]

SQL["publish_race"] = _with(LIBRARY, FEED, ITEMS) + """
SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY pos % 2, page_id, pos) AS id, link, title
FROM fresh WHERE problem IS NULL"""

SQL["category_counts_stored"] = _with(LIBRARY, FEED, ITEMS, """
every AS (
  SELECT category, CASE WHEN b.doc_id IS NOT NULL THEN b.quality = 0 ELSE l.hidden END AS hidden
  FROM library l LEFT JOIN labels b ON b.doc_id = l.id
  UNION ALL SELECT CASE WHEN pos % 3 = 0 THEN 'cat_new' ELSE 'cat_fr' END, false FROM fresh WHERE problem IS NULL),
renamed AS (
  SELECT CASE category WHEN 'cat_de' THEN 'Deutsch' WHEN 'German' THEN 'Deutsch'
                       WHEN 'cat_fr' THEN 'cat_en' ELSE category END AS category, hidden FROM every)""") + """
SELECT category, count(*) AS n, category || ' (' || CAST(count(*) AS VARCHAR) || ')' AS label
FROM renamed WHERE category IS NOT NULL AND NOT hidden GROUP BY category"""

SQL["snapshots_by_reference"] = _with(LIBRARY) + """
SELECT '202402' || lpad(CAST(d AS VARCHAR), 2, '0') AS snapshot_date, count(*) AS n,
       CAST(sum(CAST(l.hidden OR (b.doc_id IS NOT NULL AND l.id % 7 BETWEEN 1 AND d - 1) AS BIGINT)) AS BIGINT) AS hidden
FROM range(3, 8) r(d), library l LEFT JOIN labels b ON b.doc_id = l.id GROUP BY d"""

SQL["ingest_rejects_stored"] = _with(LIBRARY, FEED, FEED_HTML, items_sql("feed_html")) + """
SELECT link, 'import' AS stage, CAST(2 AS BIGINT) AS attempts, problem FROM fresh WHERE problem IS NOT NULL"""

SQL["stream_import"] = _with(LIBRARY, FEED, ITEMS, f"""
timed AS (
  SELECT *, {seconds_sql('length_text', 'ms')} AS length_seconds, {problem_sql('length_text')} AS problem, page_id > 15 AS late
  FROM clean c WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.link = c.link)),
early AS (
  SELECT * FROM timed WHERE NOT late QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1),
later AS (
  SELECT * FROM timed t WHERE late AND NOT EXISTS (SELECT 1 FROM early e WHERE e.link = t.link AND e.problem IS NULL)
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1),
stored AS (SELECT * FROM early WHERE problem IS NULL UNION ALL SELECT * FROM later WHERE problem IS NULL)""") + f"""
SELECT (SELECT max(id) FROM library) + row_number() OVER (ORDER BY late, page_id, pos) AS id,
       title, link, channel, thumbnail, CAST(NULL AS VARCHAR) AS subtitles,
       CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS blurb, CAST(NULL AS VARCHAR) AS themes,
       progress, CAST(NULL AS VARCHAR) AS category, video_created, length_seconds,
       {AS_OF} AS record_created, false AS hidden
FROM stored"""

SQL["import_sql"] = _with(LIBRARY, FEED, FEED_HTML, items_sql("feed_html")) + """
SELECT * FROM fresh"""
