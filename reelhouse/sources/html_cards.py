"""Feed pages -> raw card rows (S1, H1-H4), and generic page facts.

Pages are rows of ``(page_id, url, html)``.  Cards are cut and their fields
read by the expressions of :mod:`reelhouse.sources.markup`, in the JVM, in the
task that reads the page: no HTML is shuffled.  Only raw strings come out;
every cleaning rule is a Column expression applied afterwards (see
:func:`reelhouse.operators.ingest.clean_cards`).

Element rules are plain tuples, not CSS text: a *simple selector* is
``(tag, class, id)`` with ``None`` for "any", and a *chain* is a tuple of
simple selectors read as "descendant of".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions.sql import _text, register
from reelhouse.schema import CARD_SCHEMA
from reelhouse.sources import markup as M


@dataclass(frozen=True)
class CardRules:
    """What is read of a card: chains of simple selectors, the first match counts.

    The defaults are the fixed selectors of the feed markup.
    """
    card: str = K.CARD_TAG
    links: tuple = tuple((sel,) for sel in K.LINK_SELECTORS)
    title: tuple = ((K.TITLE_SELECTOR[0], K.TITLE_SELECTOR[1], None),)
    channel: tuple = ((None, K.METADATA_ROW_CLASS, None), ("a", None, None))
    thumbnail: tuple = ((None, K.THUMBNAIL_IMAGE_CLASS, None), ("img", None, None))
    length: tuple = ((K.LENGTH_BADGE_TAG, None, None), (None, K.LENGTH_TEXT_CLASS, None))
    progress: tuple = ((None, K.PROGRESS_CLASS, None),)
    row: tuple = ((None, K.METADATA_ROW_CLASS, None),)
    span: tuple = ((K.METADATA_TEXT_SELECTOR[0], K.METADATA_TEXT_SELECTOR[1], None),)
    ad: str = K.AD_TAG
    sponsored: str = K.SPONSORED_TEXT
    collection: str = K.COLLECTION_CLASS


CARD_RULES = CardRules()

_CHAIN = "ARRAY<ARRAY<STRING>>"
RULES_DDL = (f"card STRING, links ARRAY<{_CHAIN}>, " + ", ".join(f"{f} {_CHAIN}" for f in (
    "title", "channel", "thumbnail", "length", "progress", "row", "span")) + ", ad STRING, sponsored STRING, collection STRING")


_REFERENCES = f"named_struct('refs', {M.references()})"


def _literal(value) -> str:
    """A rule as SQL."""
    if value is None or isinstance(value, str):
        return "cast(NULL AS STRING)" if value is None else _text(value)
    return f"array({', '.join(map(_literal, value))})"


def _given(rules: CardRules, json: str) -> str:
    """A struct of the rules and the character references; those that the JSON object ``json`` names come from there."""
    fields = ", ".join(f"'{k}', coalesce(g.{k}, {_literal(v)})" for k, v in vars(rules).items())
    return M.let(f"from_json({json}, '{RULES_DDL}')", "g", f"named_struct('refs', {M.references()}, {fields})")


def cards_sql(page_id: str, html: str, rules: CardRules = CARD_RULES, json: str | None = None) -> str:
    """SQL of one page's cards, an array of structs (fields of :data:`reelhouse.schema.CARD_SCHEMA`).

    A card inside another is a card of its own as well.  Rules that the JSON
    object ``json`` (SQL) names are looked up in it for every token; without it
    they stand in the expression, and tokens hold which of them they match.
    """
    if json is None and len(_selectors(rules)) <= M.MAX_BITS:
        return M.let(_REFERENCES, "r", _marked_cards(page_id, html, rules))

    def rule(name: str):
        return f"r.{name}" if json is not None else getattr(rules, name)

    def value(name: str) -> str:
        return f"r.{name}" if json is not None else _literal(getattr(rules, name))

    # places of the links, the title, the thumbnail and the progress bar
    if json is not None:
        places, n_links = f"transform(concat(r.links, array(r.title, r.thumbnail, r.progress)), l -> {M.place('c', 'l')})", "size(r.links)"
    else:
        places, n_links = f"array({', '.join(M.place('c', l) for l in (*rules.links, rules.title, rules.thumbnail, rules.progress))})", len(rules.links)
    link = f"coalesce(get(filter(slice(at, 1, {n_links}), l -> l > 0), 0), 0)"
    wanted = [(link, "href"), ("element_at(at, -3)", "title"), ("element_at(at, -2)", "src"), ("element_at(at, -1)", "style")]
    tags = "array(" + ", ".join(f"named_struct('at', {at}, 'name', '{name}')" for at, name in wanted) + ")"
    names = tuple(name for _, name in wanted)
    read = f"if(z.at > 0, {M.let(M.attribute('element_at(c, z.at).raw', 'z.name', names), 'h', M.unescape('h'))}, NULL)"
    attributes = M.let(places, "at", f"transform({tags}, z -> named_struct('found', z.at > 0, 'value', {read}))")

    def first_text(chain) -> str:
        return M.let(M.find("c", chain, "1"), "f", f"if(f.start > 0, {M.text(M.content('c', 'f'))}, NULL)")

    if json is not None:
        texts = f"transform(array(r.title, r.channel, r.length), l -> {first_text('l')})"
    else:
        texts = f"array({', '.join(map(first_text, (rules.title, rules.channel, rules.length)))})"
    spans = M.let(M.content("c", "f"), "w", M.let(M.find("w", rule("span"), "0"), "u", "if(u.seen = 0, cast(array() AS ARRAY<STRING>), "
                  f"transform(sequence(1, u.seen), y -> {M.let(M.find('w', rule('span'), 'y'), 'h', M.text(M.content('w', 'h')))}))"))
    flags = {
        "is_ad": f"coalesce(exists(c, e -> coalesce(e.tag = {value('ad')} AND e.step >= 0, false)), false)",
        "is_sponsored": f"exists(c, x -> x.step IS NULL AND x.raw = {value('sponsored')})",
        "is_collection": f"exists(c, e -> coalesce(array_contains(e.classes, {value('collection')}), false))",
    }
    row = M.let(M.find("c", rule("row"), "2"), "f", f"if(f.start > 0, {spans}, NULL)")
    card = M.let(f"named_struct('attributes', {attributes}, 'texts', {texts})", "m", _card(page_id, row, flags))
    fields = ("title", "channel", "thumbnail", "length", "progress", "row", "span")
    if json is not None:
        chains = f"concat(r.links, array({', '.join(map(rule, fields))}))"
        ids = f"filter(transform(flatten({chains}), s -> get(s, 2)), s -> s IS NOT NULL)"
    else:
        ids = f"cast({_literal(_ids(_selectors(rules)))} AS ARRAY<STRING>)"
    page = M.let(ids, "ids", M.let(M.tokens(html, True, "ids"), "els", M.elements("els", value("card"), card)))
    return M.let(_REFERENCES if json is None else _given(rules, json), "r", page)


def _card(page_id: str, row: str, flags: dict) -> str:
    """A card's struct, of ``m.attributes`` (link, title, thumbnail, progress) and ``m.texts`` (title, channel, length)."""
    values = {
        "page_id": f"cast({page_id} AS BIGINT)", "pos": "cast(j AS BIGINT)",
        "href": "if(m.attributes[0].found, coalesce(m.attributes[0].value, ''), NULL)",
        "title_attr": "m.attributes[1].value", "title_text": "m.texts[0]", "channel": "m.texts[1]",
        "thumb_src": "m.attributes[2].value", "length_text": "m.texts[2]",
        "progress_style": "if(m.attributes[3].found, coalesce(m.attributes[3].value, ''), NULL)",
        "meta_spans": row, **flags,
    }
    return "named_struct(" + ", ".join(f"'{f.name}', {values[f.name]}" for f in CARD_SCHEMA.fields) + ")"


def _selectors(rules: CardRules) -> list:
    """Every selector the rules ask for, the text of a sponsored card among them."""
    chains = (*rules.links, rules.title, rules.channel, rules.thumbnail, rules.length, rules.progress, rules.row, rules.span)
    wanted = [tuple(s) for chain in chains for s in chain] + list(filter(None, _flags(rules).values()))
    return list(dict.fromkeys(wanted))


def _flags(rules: CardRules) -> dict:
    """What each flag of a card looks for, None if for nothing."""
    return {"is_ad": rules.ad and (rules.ad, None, None), "is_sponsored": rules.sponsored, "is_collection": rules.collection and (None, rules.collection, None)}


def _ids(selectors: list) -> tuple:
    return tuple(dict.fromkeys(s[2] for s in selectors if not isinstance(s, str) and s[2] is not None))


def _marked_cards(page_id: str, html: str, rules: CardRules) -> str:
    """One page's cards by the bits of its tokens; wants ``r.refs``."""
    selectors = _selectors(rules)
    table = M.bits(selectors)

    def chain(name: str) -> tuple:
        return tuple(table[tuple(s)] for s in getattr(rules, name))

    links = [M.marked_place("c", tuple(table[tuple(s)] for s in link)) for link in rules.links]
    link = M.let(f"filter(array({', '.join(links)}), l -> l > 0)", "ls", "coalesce(get(ls, 0), 0)") if links else "0"
    names = ("href", "title", "src", "style")
    places = [link, *(M.marked_place("c", chain(f)) for f in ("title", "thumbnail", "progress"))]
    tags = "array(" + ", ".join(f"named_struct('at', {at}, 'name', '{name}')" for at, name in zip(places, names)) + ")"
    read = f"if(z.at > 0, {M.let(M.attribute('element_at(c, z.at).raw', 'z.name', names), 'h', M.unescape('h'))}, NULL)"
    attributes = f"transform({tags}, z -> named_struct('found', z.at > 0, 'value', {read}))"
    texts = (f"transform(array({', '.join(M.marked_place('c', chain(f)) for f in ('title', 'channel', 'length'))}), "
             f"y -> if(y > 0, {M.text(M.inside('c', 'y'))}, NULL))")
    span = chain("span")
    if len(span) == 1:
        spans = (f"transform(filter(transform(w, (e, i) -> if({M.matches('e', span[0])}, i + 1, NULL)), y -> y IS NOT NULL), "
                 f"y -> {M.text(M.inside('w', 'y'))})")
    else:
        spans = M.let(M.find("w", span, "0"), "u", "if(u.seen = 0, cast(array() AS ARRAY<STRING>), "
                      f"transform(sequence(1, u.seen), y -> {M.let(M.find('w', span, 'y'), 'f', M.text(M.content('w', 'f')))}))")
    row = M.let(M.marked_place("c", chain("row"), 2), "y", f"if(y > 0, {M.let(M.inside('c', 'y'), 'w', spans)}, NULL)")
    flags = {f: f"exists(marks, h -> {M.matches('h', table[s])})" if s else "false" for f, s in _flags(rules).items()}
    card = M.let(f"named_struct('attributes', {attributes}, 'texts', {texts})", "m", _card(page_id, row, flags))
    ids = f"cast({_literal(_ids(selectors))} AS ARRAY<STRING>)"
    return M.let(M.tokens(html, True, ids, table), "els",
                 M.elements("els", _literal(rules.card), M.let(M.marked("c"), "marks", card)))


def extract_cards(pages: DataFrame, rules: CardRules = CARD_RULES) -> DataFrame:
    """Pages -> raw cards (schema :data:`reelhouse.schema.CARD_SCHEMA`)."""
    return pages.select(F.inline(F.expr(cards_sql("page_id", "html", rules))))


def card_counts(pages: DataFrame, card: str = K.CARD_TAG) -> DataFrame:
    """``(page_id, cards)``, by counting start tags outside comments and raw text."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\z)", "")
    return pages.select("page_id", F.regexp_count(bare, F.lit(rf"(?i)<{card}(?=[\s/>])")).cast("bigint").alias("cards"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: ``<title>`` text, first ``<h1>`` text, ad block present, link count."""
    def first(tag: str) -> str:
        return M.let(M.find("els", ((tag, None, None),), "1"), "f",
                     f"if(f.start > 0, {M.text(M.content('els', 'f'))}, NULL)")

    facts = (f"named_struct('title', {first('title')}, 'heading', {first('h1')}, "
             "'has_ad', exists(els, e -> coalesce(array_contains(e.classes, 'ad'), false)), "
             "'n_links', cast(size(filter(els, e -> e.tag = 'a' AND e.step >= 0)) AS BIGINT))")
    page = M.let(_REFERENCES, "r", M.let(M.tokens("coalesce(html, '')", classes=True), "els", facts))
    return pages.select("page_id", F.inline(F.array(F.expr(page))))


def page_anchors(pages: DataFrame) -> DataFrame:
    """Every ``<a>`` of every page: position, ``href`` ('' when absent), text."""
    href = M.let(M.attribute("element_at(els, a).raw", "'href'", ("href",)), "h", M.unescape("h"))
    anchor = f"named_struct('pos', cast(j AS BIGINT), 'href', coalesce({href}, ''), 'text', {M.text('c')})"
    page = M.let(_REFERENCES, "r", M.let(M.tokens("html"), "els", M.elements("els", "'a'", anchor)))
    return pages.select("page_id", F.inline(F.expr(page)))


def register_sql_functions(spark) -> None:
    """Register the field rules and the table function ``extract_cards`` for SQL users::

        SELECT c.* FROM pages, LATERAL extract_cards(page_id, html) c
        SELECT c.* FROM pages, LATERAL extract_cards(page_id, html, '{"card": "article"}') c

    The third argument is a JSON object of the rules to change: selectors
    ``[tag, class, id]``, chains as lists of them.
    """
    register(spark)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CARD_SCHEMA.fields)
    page = ("extract_cards.page_id", "extract_cards.html", CARD_RULES)
    body = f"if(extract_cards.rules IS NULL, {cards_sql(*page)}, {cards_sql(*page, 'extract_cards.rules')})"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION extract_cards(page_id BIGINT, html STRING, rules STRING DEFAULT NULL) "
              f"RETURNS TABLE ({fields}) RETURN SELECT * FROM inline({body})")
