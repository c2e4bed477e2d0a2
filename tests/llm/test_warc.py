import base64
import hashlib

from pyspark.sql import functions as F

from reelhouse.llm import warc
from reelhouse.llm.common import shared_path
from tests.llm.helpers import as_counter

COLUMNS = "page_id long, url string, html string, digest string, file int, key double"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], COLUMNS)


def rows():
    out = [(i, f"http://h{i % 5}.example.com/p?x={i}", f"<p>{i % 9}é</p>" * (i % 7)) for i in range(120)]
    out += [(i, "https://hot.example.org/", "same" * 50) for i in range(200, 900)]  # a hot url and payload
    out += [(None, "http://a.b/", "null id"), (5, None, "null url"), (6, None, None), (-3, "x", ""), (7, "HTTP://U@A.B:80/ q\r\n", "z"),
            (50, "http://b.c/", "twice"), (50, "http://b.c/", "twice"), (50, "http://a.c/", "twice"), (1000, "not a url [", "z" * 300000)]
    return out


def expected(rows_):
    best = {}
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    for r in rows_:
        h = r[2] or ""
        best[h] = min(best.get(h, r), r, key=order)
    out, done = [], set()
    for i, url, html in rows_:
        h = html or ""
        payload = h.encode()
        first = best[h][:2] == (i, url) and h not in done
        if first:
            done.add(h)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if first else "revisit", None if first else best[h][0]))
    return as_counter(out)


def read_all(df, folder, index, **how):
    return warc.read_records(warc.look_up(warc.keys_of(df), index), folder, **how)


def test_captures_read_back_through_the_index(spark):
    df = pages(spark, rows())
    folder = shared_path(spark, "test-archives")
    index = warc.build_index(warc.write_archives(df, folder), folder, block_lines=8)
    got = read_all(df, folder, index).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert as_counter([tuple(r[n] for n in names) for r in got]) == expected(rows())
    texts = {r[2].encode() for r in rows() if r[2]} | {b""}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == texts
    assert {r.url for r in got if r.page_id == 7} == {"http://h2.example.com/p?x=7", "HTTP://U@A.B:80/ q%0D%0A"}


def test_lookup_of_some_and_of_unknown_keys(spark):
    df = pages(spark, rows())
    folder = shared_path(spark, "test-archives")
    index = warc.archive(df, folder)
    some = df.where("page_id in (3, 250)")
    got = {r.page_id for r in read_all(some, folder, index, with_payload=False).collect()}
    assert got == {3, 250}
    assert read_all(pages(spark, [(4000, "http://none/", "")]), folder, index).collect() == []


def test_empty_table(spark):
    df, folder = pages(spark, []), shared_path(spark, "test-archives")
    index = warc.archive(df, folder)
    assert index.files == () and read_all(df, folder, index).collect() == []


def test_what_a_lost_attempt_leaves_is_not_read(spark):
    df, folder = pages(spark, rows()[:20]), shared_path(spark, "test-archives")
    captures = warc.write_archives(df, folder)
    where, path = warc.opened(folder)
    with where.open_output_stream(f"{path}/response-000000-lost") as f:
        f.write(b"half a record")
    index = warc.build_index(captures, folder)
    assert read_all(df, folder, index).count() == 20


def test_keys_and_records():
    assert warc.surt("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.surt("https://e.org:8443") == "org,e:8443)/"
    assert warc.surt(None) == "-" and " " not in warc.surt("not a url [ x")
    assert warc.capture_key("http://a/", -5) < warc.capture_key("http://a/", 7) < warc.capture_key("http://a/", None)
    fields, http, payload = warc.parse(warc.record("response", 1, "u", "D", 3, b"\r\n\r"))
    assert payload == b"\r\n\r" and http["Content-Length"] == "3" and fields["X-Page-Id"] == "1"


def test_base32_column_is_the_librarys(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(50)], "t string").withColumn("d", F.unhex(F.sha1("t")))
    for r in df.withColumn("b", warc._base32_column("d")).collect():
        assert r.b == warc.base32(bytes(r.d))


def test_reading_is_dealt_over_all_partitions(spark):
    hits = spark.createDataFrame([(f"f{i}", 0, 1) for i in range(64)], "file string, at bigint, length bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = warc.read_records(hits, "/nowhere")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
