"""Card extraction from feed HTML (S1, H1-H4) on small hand-written pages."""

import datetime as dt

from reelhouse.operators import ingest as I
from reelhouse.sources import html_cards as H
from tests import markup_reference as R

ROW = "yt-content-metadata-view-model__metadata-row"
SPAN = "yt-content-metadata-view-model__metadata-text"


def card(body: str) -> str:
    return f"<ytd-rich-item-renderer>{body}</ytd-rich-item-renderer>"


def title(t="T", attr=None):
    a = f' title="{attr}"' if attr is not None else ""
    return f'<h3 class="yt-lockup-metadata-view-model__heading-reset"{a}> {t} </h3>'


def image_link(href="/watch?v=a&t=1"):
    return f'<a class="yt-lockup-view-model__content-image" href="{href}"></a>'


def rows(*row_spans):
    out = []
    for spans in row_spans:
        out.append(f'<div class="{ROW}">' + "".join(f'<span class="{SPAN}">{s}</span>' for s in spans) + "</div>")
    return "".join(out)


PAGE = "<html><body>" + "".join([
    card(image_link() + title(attr="") + f'<div class="{ROW}"><a href="/c"> Chan </a></div>'
         + rows(["1.2K views", "2 hours ago"])
         + '<yt-thumbnail-badge-view-model><div class="yt-badge-shape__text"> 4:05 </div></yt-thumbnail-badge-view-model>'
         + '<div class="ytThumbnailOverlayProgressBarHostWatchedProgressBarSegment" style="width: 61%;"></div>'),
    card('<a class="yt-lockup-metadata-view-model__title"></a>' + image_link("/watch?v=b") + title()),
    card(image_link("/watch?v=c") + title() + "<ytd-ad-slot-renderer></ytd-ad-slot-renderer>"),
    card(image_link("/watch?v=d") + title() + "<span>Sponsored</span>"),
    card(image_link("/watch?v=e") + title() + "<span>Sponsored by X</span>"),
    card(image_link("/watch?v=f") + title() + '<div class="ytCollectionsStackCollectionStack2"></div>'),
    card(image_link("/watch?v=g")),
    card(image_link("/watch?v=h") + title("Only row") + rows(["1 day ago"])),
    card(image_link("/watch?v=i") + title("Holiday", attr="Attr &amp; more")
         + rows(["x"], ["Holiday special", "1 day ago"])
         + '<div class="ytThumbnailViewModelImage"><img src="https://img/i.jpg"></div>'
         + '<yt-thumbnail-badge-view-model><div class="yt-badge-shape__text">LIVE</div></yt-thumbnail-badge-view-model>'),
]) + "</body></html>"


def test_raw_cards():
    cards = R.cards_of_page(7, PAGE)
    assert len(cards) == 9
    c0 = cards[0]
    assert c0["href"] == "/watch?v=a&t=1" and c0["title_attr"] == "" and c0["title_text"] == "T"
    assert c0["channel"] == "Chan" and c0["length_text"] == "4:05" and c0["progress_style"] == "width: 61%;"
    assert c0["meta_spans"] == ["1.2K views", "2 hours ago"]
    assert cards[1]["href"] == ""                      # first selector wins even without href
    assert cards[2]["is_ad"] and cards[3]["is_sponsored"] and not cards[4]["is_sponsored"]
    assert cards[5]["is_collection"]
    assert cards[6]["title_text"] is None
    assert cards[7]["meta_spans"] is None
    assert cards[8]["title_attr"] == "Attr & more" and cards[8]["thumb_src"] == "https://img/i.jpg"


def test_extract_and_clean(spark):
    pages = spark.createDataFrame([(7, "u", PAGE)], "page_id bigint, url string, html string")
    items = I.clean_cards(H.extract_cards(pages), "2024-02-01 00:00:00", "https://site")
    got = {r.link: r for r in items.collect()}
    assert sorted(got) == ["https://site/watch?v=a", "https://site/watch?v=e",
                           "https://site/watch?v=h", "https://site/watch?v=i"]
    a = got["https://site/watch?v=a"]
    assert a.title == "T" and a.progress == 61 and a.length_text == "4:05"
    assert a.video_created == dt.datetime(2024, 1, 31, 22) and a.channel == "Chan"
    assert a.thumbnail.endswith("/a/hqdefault.jpg")
    assert got["https://site/watch?v=h"].video_created is None
    i = got["https://site/watch?v=i"]
    assert i.video_created is None and i.length_text is None and i.title == "Attr & more"
    assert i.thumbnail == "https://img/i.jpg" and i.progress == 0


def test_malformed_html_does_not_fail():
    assert R.cards_of_page(1, "<div><ytd-rich-item-renderer><a class='x'>") [0]["href"] is None
    assert R.cards_of_page(1, "") == []


def test_sql_table_function(spark):
    pages = spark.createDataFrame([(7, "u", PAGE)], "page_id bigint, url string, html string")
    pages.createOrReplaceTempView("feed_pages_t")
    H.register_sql_functions(spark)
    rows = spark.sql("SELECT c.pos, c.href FROM feed_pages_t, LATERAL extract_cards(page_id, html) c "
                     "ORDER BY c.pos").collect()
    assert [r.href for r in rows] == [c["href"] for c in R.cards_of_page(7, PAGE)]


def test_frame_and_page_agree(spark):
    from reelhouse.sources import fixtures as X
    from tests.conftest import SF_SMALL
    pages = X.feed_pages(spark, SF_SMALL)
    whole = []
    for r in pages.collect():
        whole.extend(R.cards_of_page(r.page_id, r.html))
    got = [r.asDict(recursive=True) for r in H.extract_cards(pages).collect()]
    key = lambda d: (d["page_id"], d["pos"])
    assert sorted(got, key=key) == sorted(whole, key=key)
    # the hand-written page, including malformed bits
    one = spark.createDataFrame([(7, "u", PAGE)], "page_id bigint, url string, html string")
    assert sorted(r.asDict(recursive=True)["href"] or "" for r in H.extract_cards(one).collect()) == \
        sorted(c["href"] or "" for c in R.cards_of_page(7, PAGE))


def test_tokenizer_rules():
    root = R.parse('<!DOCTYPE html><HTML><head><script>var t="</p><b>";</SCRIPT >'
                   '<style>p{x:"</div>"}</style></head><body>'
                   '<!-- <a href="/hidden">no</a> --><?pi x?>'
                   '<A HREF="/x?a=1&amp;b=2" data-x a=1 a=2>One &amp; two</a>'
                   '<a href=/y/>y</a><br/><p>a < b</p></b></body></html>')
    scripts = [n for n in root.iter() if n.tag == "script"]
    assert scripts[0].children == ['var t="</p><b>";']        # raw text up to </script>
    anchors = [n for n in root.iter() if n.tag == "a"]
    assert [a.attrs.get("href") for a in anchors] == ["/x?a=1&b=2", "/y/"]
    assert anchors[0].attrs["data-x"] == "" and anchors[0].attrs["a"] == "2"   # last value wins
    assert anchors[0].text() == "One & two"
    assert anchors[1].text() == "y"                            # href=/y/> is not self-closing
    p = [n for n in root.iter() if n.tag == "p"][0]
    assert p.text() == "a<b"                                   # a lone "<" is its own text node
    assert [n.tag for n in root.iter() if n.tag in ("b", "br")] == ["br"]   # stray </b> ignored


def test_descendants_are_document_order():
    root = R.parse("<div><p><i>x</i></p><p>y<img src=a></p></div><span>z</span>")
    div = root.iter()[0]
    assert [n.tag for n in div.iter()] == ["p", "i", "p", "img"]
    assert [n.tag for n in root.iter()] == ["div", "p", "i", "p", "img", "span"]


def test_comments_case_nesting_and_scripts(spark):
    card = '<{t}><a id="thumbnail" href="/{h}"></a>{inner}</{t}>'
    name = "ytd-rich-item-renderer"
    html = ("<!-- " + card.format(t=name, h="comment", inner="") + " --><script>'<" + name + ">'</script>"
            + card.format(t=name.upper(), h="upper", inner="")
            + card.format(t=name, h="outer", inner=card.format(t=name, h="inner", inner="")))
    assert [c["href"] for c in R.cards_of_page(1, html)] == ["/upper", "/outer", "/inner"]
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id bigint, url string, html string")
    assert sorted(r.href for r in H.extract_cards(pages).collect()) == ["/inner", "/outer", "/upper"]
    assert [(r.page_id, r.cards) for r in H.card_counts(pages).where("cards > 0").collect()] == [(1, 3)]


def test_rules_are_a_parameter():
    rules = H.CardRules(card="item", links=((("a", "l", None),),), title=(("b", None, None),))
    got = R.cards_of_page(1, '<item><a class="l" href="/x"></a><b title="T">t</b></item>', rules)
    assert (got[0]["href"], got[0]["title_attr"], got[0]["title_text"]) == ("/x", "T", "t")


def test_malformed_markup_takes_linear_time():
    import time
    n = 1 << 20
    for piece in ("<a ", "</a ", "<!", "<a b='", '<a b="', "<a =", "<", "<i>", "</b>", "<script>", "<!--", "<a b=c>", "a='<a =\"", "< a/ "):
        began = time.time()
        R.parse(piece * (n // len(piece)))
        assert time.time() - began < 20, piece  # a quadratic scan of 1 MB takes hours
    assert R.parse("<p>x</p><a href='y").iter()[0].text() == "x"


def test_rules_are_an_argument_in_sql(spark):
    page = ('<article><a class="go" href="/x&y">n</a><h1 title="A">b</h1></article>' + card(image_link() + title()))
    spark.createDataFrame([(1, page)], "page_id long, html string").createOrReplaceTempView("sql_pages")
    H.register_sql_functions(spark)
    rules = '{"card": "article", "links": [[["a", "go", null]]], "title": [["h1", null, null]]}'
    got = spark.sql(f"SELECT canonical_link(c.href, 'https://m') AS link, card_title(c.title_attr, c.title_text) AS t "
                    f"FROM sql_pages p, LATERAL extract_cards(p.page_id, p.html, '{rules}') c").collect()
    assert [tuple(r) for r in got] == [("https://m/x", "A")]
    assert spark.sql("SELECT c.* FROM sql_pages p, LATERAL extract_cards(p.page_id, p.html) c").count() == 1


def test_sql_functions_are_the_column_functions(spark):
    from pyspark.sql import functions as F

    from reelhouse.functions import dates as D
    from reelhouse.functions import fields as FF
    H.register_sql_functions(spark)
    texts = [None, "", " 4:05 ", "5:75", "1:02:03", "live", "UPCOMING", "x", "/watch?v=a&t=1", "http://h/?v=b", "width: 61%;",
             "width:61.5%", "2 hours ago", "in 2 hours", "a few days ago", "yesterday", " Today ", "5 mos", " t\n"]
    df = spark.createDataFrame([(t, u) for t in texts for u in texts], "a string, b string")
    as_of = D.as_of_literal("2024-03-31 00:00:00")
    n = FF.normalize_length(FF.badge_length("a"))
    want = [FF.strip("a"), n, FF.length_seconds(n), FF.length_seconds(n, "hm"), FF.length_problem(n), FF.canonical_link("a", "https://s"),
            FF.thumbnail("a", "b"), FF.progress_pct("a"), FF.title("a", "b"), D.relative_created("a", as_of)]
    got = ["strip_text(a)", "length_text(a)", "length_seconds(length_text(a))", "length_seconds(length_text(a), 'hm')",
           "length_problem(length_text(a))", "canonical_link(a, 'https://s')", "thumbnail_url(a, b)", "progress_percent(a)",
           "card_title(a, b)", "relative_created(a, TIMESTAMP_NTZ '2024-03-31 00:00:00')"]
    both = df.select("a", "b", *[F.struct(w.alias("w"), F.expr(g).alias("g")).alias(f"c{i}") for i, (w, g) in enumerate(zip(want, got))])
    for r in both.collect():
        for i, g in enumerate(got):
            assert r[f"c{i}"].w == r[f"c{i}"].g, (g, r.a, r.b)


def test_expressions_and_parser_agree(spark):
    """Cards and anchors of made-up pages: nested cards, open and stray tags, references, quotes, comments, scripts."""
    import random
    draw = random.Random(11)
    pieces = ["<!-- <a> -->", "x", "&amp;", "&#8364;", "&#x41", "&notit;", "&copy", "&nosuch;", " < ", "<br>", "<i>t</i>", "&#0;", "&#128;",
              "&#xD800;", "&#99999999999999999999;", "&#xfdd0;", "&", title("A &lt; b"), title("q", attr="a 'b' > c"), image_link(),
              "<a href=/y/>y</a>", "<a id=thumbnail HREF='/z?a=1&amp;b=2' data-x>n</a>", rows(["a", "b <b>c</b> d"]), rows(["x"], [" y ", "&nbsp;z"]),
              f'<div class="{ROW} other"><a> Chan <i> nel</i></a></div>', "<ytd-ad-slot-renderer/>", "<p>Sponsored</p>",
              "<script>'<a>' </b></script>", '<div class="ytThumbnailViewModelImage"><img src="i.jpg?a&b"/></div>', "</b>", "<?p x?>",
              '<yt-thumbnail-badge-view-model><div class="yt-badge-shape__text">4<b>:</b>05</div></yt-thumbnail-badge-view-model>',
              f'<span class="{SPAN}">loose</span>', "<p class='ytThumbnailOverlayProgressBarHostWatchedProgressBarSegment' style>"]

    def some(n):
        return "".join(draw.choice(pieces) for _ in range(draw.randint(0, n)))

    def page():
        made = [card(some(9) + (card(some(4)) + some(2) if draw.random() < 0.3 else "")) + some(2) for _ in range(draw.randint(1, 4))]
        return "".join(made) + draw.choice(["", "", "<a b=c", "<!-", "<ytd-rich-item-renderer><i>open"])

    pages = dict(enumerate(page() for _ in range(300)))
    df = spark.createDataFrame([(i, "u", p) for i, p in pages.items()], "page_id bigint, url string, html string")
    want = {(c["page_id"], c["pos"]): c for i, p in pages.items() for c in R.cards_of_page(i, p)}
    assert {(r.page_id, r.pos): r.asDict(recursive=True) for r in H.extract_cards(df).collect()} == want
    anchors = {(i, j): (n.attrs.get("href", ""), n.text()) for i, p in pages.items()
               for j, n in enumerate(n for n in R.parse(p).iter() if n.tag == "a")}
    assert {(r.page_id, r.pos): (r.href, r.text) for r in H.page_anchors(df).collect()} == anchors


def test_extraction_runs_in_the_jvm_without_a_shuffle(spark):
    spark.createDataFrame([(7, "u", PAGE)], "page_id bigint, url string, html string").createOrReplaceTempView("plan_pages")
    H.register_sql_functions(spark)
    for df in (H.extract_cards(spark.table("plan_pages")), H.page_facts(spark.table("plan_pages")),
               spark.sql("SELECT c.* FROM plan_pages, LATERAL extract_cards(page_id, html) c")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("EvalPython", "MapIn", "UDTF", "Exchange", "SortMerge", "HashJoin"))


def test_hostile_pages_take_linear_time(spark):
    import time
    name = "ytd-rich-item-renderer"
    for n, page in ((0, "<a b='" * 50000), (0, "<" * 100000), (1, f"<{name}>" + "<i>" * 50000), (5000, f"<{name}>x</{name}>" * 5000)):
        began = time.time()
        assert H.extract_cards(spark.createDataFrame([(1, page)], "page_id bigint, html string")).count() == n
        assert time.time() - began < 30


def test_only_tags_that_can_hold_an_asked_id_are_read_for_it(spark):
    page = '<p class="zz b" id="x"></p></1><p class="c" id="y"></p><i id="&#120;"></i><b width="id"></b>'
    tokens = spark.createDataFrame([(page,)], "html string").selectExpr(
        H.M.let(H._REFERENCES, "r", H.M.tokens("html", True, "array('x')")) + " AS t").first().t
    assert [(t.classes, t.id) for t in tokens if t.step == 1] == [(["zz", "b"], "x"), (["c"], None), (None, "x"), (None, None)]


def test_fixed_rules_stand_in_the_expression_and_given_ones_agree(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    assert "r.links" not in H.cards_sql("page_id", "html")
    H.register_sql_functions(spark)
    pages.createOrReplaceTempView("rule_pages")
    given = spark.sql("SELECT c.* FROM rule_pages, LATERAL extract_cards(page_id, html, '{\"card\": \"ytd-rich-item-renderer\"}') c")
    assert given.collect() == H.extract_cards(pages).collect()


def test_tokens_hold_the_bits_of_the_selectors_they_match(spark):
    table = H.M.bits([("a", "x", None), (None, "y", None), (None, None, "k"), ("b", None, None), "said"])
    page = '<a class="x y">said</a><A class=x id=k><b class="z">said so</b><script class="y"></script><br class="x&#32;y"/>'
    tokens = spark.createDataFrame([(page,)], "html string").selectExpr(
        H.M.let(H._REFERENCES, "r", H.M.tokens("html", True, "array('k')", table)) + " AS t").first().t
    assert [(t.tag, t.step, t.bits) for t in tokens] == [
        ("a", 1, 3), (None, None, 16), ("a", -1, 0), ("a", 1, 5), ("b", 1, 8), (None, None, 0), ("b", -1, 0), ("script", 0, 0), ("br", 0, 2)]
    assert "classes" not in H.cards_sql("page_id", "html")


def test_bits_and_selectors_agree(spark, monkeypatch):
    """Chains of one to three selectors over few tags, many of them nested, open or closed too early."""
    import random
    draw = random.Random(7)
    rules = H.CardRules(card="card", links=((("a", "x", None),), (("p", None, None), ("a", None, "k"))), title=(("i", None, None), ("i", "y", None)),
                        channel=(("p", None, None), ("i", None, None), ("a", None, None)), thumbnail=((None, "x", None), ("img", None, None)),
                        length=(("p", "x", None), (None, "y", None)), progress=((None, None, "k"),), row=(("p", None, None),),
                        span=(("i", None, None), ("a", None, None)), ad="br", sponsored="s", collection="z")
    marks = ["", "", ' class="x"', ' class="y x"', ' id="k"', " class=z", ' href="/h" class="x" title="t&amp;"', ' style="w" src="u" id=k', ' class="z y"']
    pieces = [f"<{t}{m}>" for t in ("a", "i", "p", "p", "i") for m in marks] + ["</a>", "</i>", "</p>"] * 12 + ["s", " t \r", "\x85u", "<br>", '<img src="s">'] * 3

    def page():
        return "".join("<card>" + "".join(draw.choice(pieces) for _ in range(draw.randint(0, 16))) + draw.choice(["</card>", "</card>", ""])
                       for _ in range(3))

    pages = dict(enumerate(page() for _ in range(400)))
    df = spark.createDataFrame(list(pages.items()), "page_id bigint, html string")
    for own in (rules, H.CardRules(**{**vars(rules), "span": (("i", None, None),), "row": (("p", None, None), ("p", None, None))})):
        got = []
        for most in (62, 0):  # without bits every token is asked for every selector
            monkeypatch.setattr(H.M, "MAX_BITS", most)
            got.append({(r.page_id, r.pos): r for r in H.extract_cards(df, own).collect()})
        assert got[0] == got[1] and len(got[0]) == 1200


def test_spans_of_a_row_take_linear_time(spark):
    import time
    html = card(image_link() + title() + rows(["x"], ["1 day ago"] * 20000))
    began = time.time()
    got = H.extract_cards(spark.createDataFrame([(1, html)], "page_id bigint, html string")).selectExpr("size(meta_spans) AS n").first().n
    assert got == 20000 and time.time() - began < 30
