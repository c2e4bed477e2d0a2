"""Field-cleaning expressions: one case per quirk of the original behaviour."""

import datetime as dt

from pyspark.sql import functions as F

from reelhouse.functions import dates as D
from reelhouse.functions import fields as FF
from reelhouse.functions import text as TX
from tests.conftest import SF_CHECK, SF_SMALL, col_values, one_col


def test_length_normalise_and_seconds(spark):
    df = one_col(spark, ["5:30", "1:23:45", " 4:05 ", "SHORTS", "", None, "5:75"])
    n = FF.normalize_length("x")
    out = df.select(n.alias("n"), FF.length_seconds(n).alias("s"),
                    FF.length_seconds(n, "hm").alias("hm"), FF.length_problem(n).alias("p")).collect()
    assert [r.n for r in out] == ["5:30", "1:23:45", "4:05", "00:00", "00:00", None, "5:75"]
    assert [r.s for r in out] == [330, 5025, 245, 0, 0, None, None]
    assert out[0].hm == 19800
    assert [r.p is not None for r in out] == [False] * 6 + [True]


def test_unicode_digits_and_newline_do_not_match(spark):
    df = one_col(spark, ["\u0665:30", "5:30\n", "123:45"])
    assert col_values(df.select(FF.normalize_length("x"))) == ["00:00", "5:30", "00:00"]


def test_live_badges(spark):
    df = one_col(spark, ["LIVE", "upcoming", "Live now"])
    assert col_values(df.select(FF.badge_length("x"))) == [None, None, "Live now"]


def test_progress(spark):
    df = one_col(spark, ["width: 61%;", "width: 61.5%", "color: red", "", None, "width:7%"])
    assert col_values(df.select(FF.progress_pct("x"))) == [61, 0, 0, 0, 0, 7]


def test_link_and_thumbnail(spark):
    df = one_col(spark, ["/watch?v=a&t=1", "https://h/x?v=b", "", None, "/shorts/zz"])
    link = FF.canonical_link("x", "https://site")
    out = df.select(link.alias("l"), FF.thumbnail(F.lit(None).cast("string"), link).alias("t")).collect()
    assert [r.l for r in out] == ["https://site/watch?v=a", "https://h/x?v=b", None, None, "https://site/shorts/zz"]
    assert out[0].t.endswith("/a/hqdefault.jpg") and out[1].t.endswith("/b/hqdefault.jpg")
    assert out[4].t is None


def test_title(spark):
    df = spark.createDataFrame([("", " T "), (None, "U"), ("A", "B")], "a string, t string")
    assert col_values(df.select(FF.title("a", "t"))) == ["T", "U", "A"]


def test_strip_is_unicode_aware(spark):
    df = one_col(spark, ["\u00a0 x \n", "\u2003y\u3000"])
    assert col_values(df.select(FF.strip("x"))) == ["x", "y"]


def test_relative_created(spark):
    df = one_col(spark, ["2 hours ago", "1 month ago", "Streamed 3 days ago", "1.2K views", "3 Weeks ago"])
    as_of = D.as_of_literal("2024-03-31 00:00:00")
    got = col_values(df.select(D.relative_created("x", as_of)))
    assert got == [dt.datetime(2024, 3, 30, 22), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 28),
                   None, dt.datetime(2024, 3, 10)]


def test_date_span_choice(spark):
    from reelhouse.operators.ingest import first_date_span
    df = spark.createDataFrame([(["1.2K views", "2 hours ago"],), (["Holiday special", "1 day ago"],),
                                ([],), (None,)], "s array<string>")
    assert col_values(df.select(first_date_span(F.col("s")))) == ["2 hours ago", "Holiday special", None, None]


def test_age_text(spark):
    as_of = D.as_of_literal("2024-02-01 00:00:00")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23, 59, 30),), (dt.datetime(2024, 1, 31, 21),),
                                (dt.datetime(2024, 1, 31),), (dt.datetime(2023, 1, 1),)], "c timestamp_ntz")
    assert col_values(df.select(D.age_text("c", as_of))) == ["just now", "3 hours ago", "1 day ago", "1 year ago"]


def test_captions_to_text(spark):
    docs = ['{"events":[{"tStartMs":0},{"segs":[{"utf8":"a\\n"},{"utf8":"b"}]}]}',
            '{"events":[{"segs":[{"x":1}]}]}', None]
    assert col_values(one_col(spark, docs).select(TX.captions_to_text("x"))) == ["a b", "", None]


def test_chunks(spark):
    df = one_col(spark, ["", "abcdefgh", None, "abcdefghijklmnopqrstu"])
    out = col_values(df.select(TX.chunks("x", 3)))
    assert out[:3] == [[], ["abc", "def", "gh"], None]
    assert len(out[3]) == 7


def test_preamble(spark):
    df = one_col(spark, ["Here are x:\n\nA", "Here are a\nb\n\nc", "Here's it\n\nB\n\nC"])
    assert col_values(df.select(TX.join_responses(F.array("x")))) == ["A", "Here are a\nb\n\nc", "B\n\nC"]


def test_category_cleanup(spark):
    df = one_col(spark, ["Category: **News** ok", " Music\n", "**", "one two three four"])
    c = TX.clean_category("x")
    out = df.select(c.alias("c"), TX.word_count(c).alias("w")).collect()
    assert [r.c for r in out] == ["News", "Music", "**", "one two three four"]
    assert [r.w for r in out] == [1, 1, 1, 4]


def test_tool_call(spark):
    df = one_col(spark, ['{"category": "News"}', '{"other": 1}'])
    assert col_values(df.select(TX.tool_call_category("x"))) == ["News", None]


def test_date_stamp(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 1, 13),)], "t timestamp_ntz")
    assert col_values(df.select(FF.date_stamp("t"))) == ["20240201"]


def test_declared_table_schemas_match_files(spark):
    from reelhouse.sources.tables import GIVEN_SCHEMAS, read_table, table_path
    for sf in (SF_SMALL, SF_CHECK):
        for name in GIVEN_SCHEMAS:
            inferred = spark.read.parquet(table_path(sf, name)).schema
            assert read_table(spark, sf, name).schema.simpleString() == inferred.simpleString(), name


def test_dates_ahead_are_no_dates(spark):
    texts = ["premieres in 2 hours", "live in 3 days", "scheduled for today", "in an hour", "not yesterday", "2 hours",
             " Yesterday ", "today", "streamed 2 hrs ago", "a few days ago", "99999999999999999999 days ago", "ago", ""]
    got = col_values(one_col(spark, texts).select(D.relative_created("x", D.as_of_literal("2024-03-31 00:00:00"))))
    day = dt.datetime(2024, 3, 31)
    assert got == [None] * 5 + [day - dt.timedelta(hours=2), day - dt.timedelta(days=1), day, day - dt.timedelta(hours=2),
                                day - dt.timedelta(days=3), None, None, None]


def test_chunks_of_a_long_text_take_linear_time(spark):
    import time

    from reelhouse.functions import text as TX
    text = "añ\n日\U0001f600\r " * 750_000  # over 5 million characters
    df = one_col(spark, [text, "", None, "ab"])
    start = time.time()
    got = col_values(df.select(TX.chunks("x", 4096)))
    assert time.time() - start < 30
    assert "".join(got[0]) == text and {len(c) for c in got[0][:-1]} == {4096}
    assert got[1:] == [[], None, ["ab"]]
