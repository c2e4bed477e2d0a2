"""Markup as Spark SQL expressions: tokens, elements, selectors, attributes, text.

Every function returns the text of one SQL expression, so that DataFrames
(``F.expr``) and SQL functions run the same code in the JVM.  A page becomes an
array of tokens in one pass of one pattern; a token is ``(tag, step, classes,
id, raw)`` with step 1 for a start tag, 0 for an element without content, -1
for an end tag and null for text; raw is a start tag as it stands, or the text with
its character references read.  Classes are read where somebody asks for any, an id
only of start tags that can hold one that somebody asks for.

An element ends where its own tag is balanced; one that is never closed ends
with what it is looked for in.  Comments, declarations, stray end tags and tags
without their ``>`` are no tokens, ``script`` and ``style`` are elements without
content.  All passes take time linear in the tokens.

A selector is ``(tag, class, id)`` with None for any; a chain is a tuple of
selectors, each somewhere inside an element of the one before.  Either may be the
SQL of such an array (null for any) instead, which costs more for every token.
Selectors known beforehand are numbered (``bits``): a token then holds the bits of
those that it matches in place of its classes and id, and a card lists its tokens
with any (``marked``), so that nobody asks every token for every selector.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

from reelhouse import constants as K
from reelhouse.functions.sql import _text

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

_NAME = r"[a-zA-Z][^\t\n\r\f />]*+"
# up to the ">" of a start tag; quotes count right after "=" only
_REST = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = (r"<!--[\s\S]*?(?:-->|\z)"
         rf"|(?i:<(script|style)(?=[\s/>])){_REST}(?<!/)>[\s\S]*?(?:(?i:</\1)(?=[\s/>])[^>]*+>|\z)"
         r"|<[!?/][^>]*+(?:>|\z)"
         rf"|<{_NAME}{_REST}(?:>|\z)"
         r"|[^<]++|<")
# a name, and the value after "=" (quoted, or up to a space)
ATTRIBUTE = r"""[\s/]*+([^\s/=>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
SELF_CLOSED = rf"""(?:["'\s]|^<{_NAME}|\s[^\s/=>"']++)\s*+/\s*+>$"""
#: Text that begins and ends with what is no space for sure.
BARE_TEXT = r"(?s)^[!-~](?:.*[!-~])?\z"
QUOTED = r"""^(["'])([\s\S]*)\1\z"""
#: Character references that need no semicolon, longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
NONE = "cast(NULL AS STRING)"
#: Code points that a numeric reference may not name.
NO_CHARACTER = "n BETWEEN 64976 AND 65007 OR n % 65536 IN (65534, 65535)"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def references() -> str:
    """What character references stand for: names, and numbers below 160 (many of which stand for others)."""
    table = {name: text for name, text in html5.items()} | {f"#{n}": html.unescape(f"&#{n};") for n in range(160)}
    pairs = "\x01".join(f"{name}\x02{text}" for name, text in table.items())
    return f"str_to_map({_text(pairs)}, '\\u0001', '\\u0002')"


def unescape(text: str) -> str:
    """Text with character references replaced, by the rules of HTML5; wants ``r.refs`` (see ``references``)."""
    number = ("try_cast(CASE WHEN lower(p) LIKE '&#x%' THEN conv(regexp_extract(p, '[xX]([0-9a-fA-F]+)', 1), 16, 10) "
              "ELSE regexp_extract(p, '[0-9]+', 0) END AS BIGINT)")
    by_number = let(number, "n", "CASE WHEN n < 160 THEN try_element_at(r.refs, concat('#', n)) "
                                 "WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '�' "
                                 f"WHEN {NO_CHARACTER} THEN '' "
                                 "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END")
    head = f"regexp_extract(p, {_text(f'^&({_BARE})')}, 1)"
    bare = f"if({head} = '', p, concat(try_element_at(r.refs, {head}), substring(p, length({head}) + 2)))"
    piece = ("CASE WHEN p = '&amp;' THEN '&' WHEN p = '&lt;' THEN '<' WHEN p = '&gt;' THEN '>' WHEN p = '&quot;' THEN '\"' "
             f"WHEN p RLIKE '^&#' THEN {by_number} WHEN p RLIKE '^&[a-zA-Z]' "
             f"THEN coalesce(try_element_at(r.refs, substring(p, 2)), {bare}) ELSE p END")
    pattern = _text(r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[a-zA-Z][a-zA-Z0-9]*+;?+)|[^&]++|&")
    return f"if(contains({text}, '&'), array_join(transform(regexp_extract_all({text}, {pattern}, 0), p -> {piece}), ''), {text})"


def attribute(tag: str, name: str, plain: tuple = ()) -> str:
    """Value of the start tag's attribute ``name`` (SQL), its references unread.

    The last one of that name, '' without a value, null if there is none.  The
    names it can have as ``plain`` spare the list of attributes where all are quoted.
    """
    pattern = _text(ATTRIBUTE)  # it takes "<" and the tag's name for an attribute, which nobody asks for
    at = f"array_position(reverse(transform(regexp_extract_all({tag}, {pattern}, 1), x -> lower(x))), {name})"
    value = f"element_at(regexp_extract_all({tag}, {pattern}, 2), cast(-k AS INT))"
    listed = let(at, "k", f"if(k > 0, regexp_replace({value}, {_text(QUOTED)}, '$2'), NULL)")

    def only(n):  # the value behind its quote; every attribute is quoted or bare, and one has the name
        other = rf"""\s++(?!{n}[\s=/>])[^\s/=>"']++"""
        return _text(rf"""(?i)^<{_NAME}(?:{other}(?:="[^"]*+")?+)*+\s++{n}=("[^"]*+")(?:{other}(?:="[^"]*+")?+)*+\s*+/?+>$""")

    if plain:
        quoted = " ".join(f"WHEN {_text(n)} THEN regexp_extract({tag}, {only(n)}, 1)" for n in plain)
        near = _text(rf"""(?i)["'\s/](?:{'|'.join(plain)})""")
        listed = let(f"CASE {name} {quoted} ELSE '' END", "v",
                     f"CASE WHEN v <> '' THEN substring(v, 2, length(v) - 2) WHEN {tag} RLIKE {near} THEN {listed} END")
    return f"if(contains(lower({tag}), {name}), {listed}, NULL)"


#: Selectors that the bits of a token can tell apart.
MAX_BITS = 62


def bits(selectors) -> dict:
    """A bit for each distinct selector; a str stands for a piece of text that is equal to it."""
    return {s: 1 << n for n, s in enumerate(dict.fromkeys(selectors))}


def _fitting(table: dict, part: int, value: str) -> str:
    """Bits of the selectors whose tag, class or id (part 0, 1, 2) ``value`` is, or that ask for none."""
    chosen = {s: b for s, b in table.items() if not isinstance(s, str)}
    free = sum(b for s, b in chosen.items() if s[part] is None)
    # what holds a space is no class
    named = {s[part] for s in chosen if s[part] is not None and not (part == 1 and re.search(r"\s", s[part], re.ASCII))}
    if not named:
        return f"{free}L"
    pairs = ", ".join(f"{_text(n)}, {free + sum(b for s, b in chosen.items() if s[part] == n)}L" for n in sorted(named))

    def known(v: str) -> str:
        return f"try_element_at(map({pairs}), {v})"

    if part != 1:
        return f"coalesce({known(value)}, {free}L)"
    space = _text(chr(92) + "s")
    several = f"aggregate(split({value}, {_text(chr(92) + 's+')}), {free}L, (m, x) -> m | coalesce({known('x')}, 0L))"
    return f"if({value} IS NULL, {free}L, coalesce({known(value)}, if({value} RLIKE {space}, {several}, {free}L)))"


def tokens(page: str, classes: bool = False, ids: str | None = None, table: dict | None = None) -> str:
    """The page's tokens in order; an id is null where a start tag holds none of ``ids`` (an array).

    With a ``table`` (see ``bits``) a token is ``(tag, step, bits, raw)``.
    """
    def token(tag, step, classes="cast(NULL AS ARRAY<STRING>)", ident="cast(NULL AS STRING)", raw="cast(NULL AS STRING)", own="0L"):
        if table is not None:
            return f"named_struct('tag', {tag}, 'step', {step}, 'bits', {own}, 'raw', {raw})"
        return f"named_struct('tag', {tag}, 'step', {step}, 'classes', {classes}, 'id', {ident}, 'raw', {raw})"

    def name(mark):
        return f"lower(regexp_extract(t, {_text(f'^{mark}({_NAME})')}, 1))"

    void = ", ".join(f"'{v}'" for v in VOID)
    def read(attr):
        return let(attribute("t", _text(attr), (attr,)), "h", f"if(contains(h, '&'), {unescape('h')}, h)")

    css = read("class") if classes else "cast(NULL AS STRING)"
    # a character reference may stand for any part of an id
    ident = "cast(NULL AS STRING)" if ids is None else f"if(exists({ids}, h -> contains(t, h)) OR contains(t, '&'), {read('id')}, NULL)"
    space = _text(chr(92) + "s")
    start = let(f"named_struct('tag', {name('<')}, 'class', {css}, 'id', {ident})", "a", token(
        "a.tag", f"if(a.tag IN ({void}) OR (NOT endswith(t, '\">') AND contains(t, '/') AND t RLIKE {_text(SELF_CLOSED)}), 0, 1)",
        f"CASE WHEN a.class RLIKE {space} THEN split(a.class, {_text(chr(92) + 's+')}) WHEN a.class IS NOT NULL THEN array(a.class) END", "a.id", "t",
        " & ".join(_fitting(table, n, f"a.{part}") for n, part in enumerate(("tag", "class", "id"))) if table is not None else ""))
    said = " ".join(f"WHEN {_text(s)} THEN {b}L" for s, b in (table or {}).items() if isinstance(s, str))
    text_ = token("cast(NULL AS STRING)", "cast(NULL AS INT)", raw="x", own=f"CASE x {said} ELSE 0L END" if said else "0L")
    text_ = let(unescape("t"), "x", text_) if said else token("cast(NULL AS STRING)", "cast(NULL AS INT)", raw=unescape("t"))
    kinds = (f"CASE WHEN NOT startswith(t, '<') OR t = '<' THEN {text_} "
             f"WHEN startswith(t, '</') THEN if(endswith(t, '>'), {token(name('</'), '-1')}, NULL) "
             "WHEN startswith(t, '<!') OR startswith(t, '<?') THEN NULL "
             "WHEN (startswith(t, '<s') OR startswith(t, '<S')) AND t RLIKE '(?i)^<(script|style)(?=[ \\t\\n\\r\\f/>])' "
             f"THEN {token(name('<'), '0', raw='t', own=_fitting(table, 0, name('<')) + ' & ' + _fitting(table, 1, NONE) + ' & ' + _fitting(table, 2, NONE) if table is not None else '')} WHEN endswith(t, '>') THEN {start} END")
    return f"filter(transform(regexp_extract_all({page}, {_text(TOKEN)}, 0), t -> {kinds}), e -> e IS NOT NULL AND (e.tag IS NULL OR e.tag <> ''))"  # '' is no end tag


def matches(e: str, selector: tuple | int | str) -> str:
    if isinstance(selector, int):
        return f"({e}.bits & {selector}L) <> 0"
    if not isinstance(selector, str):
        tag, css, ident = map(lambda v: v and _text(v), selector)
        tests = [tag and f"{e}.tag = {tag}", css and f"array_contains({e}.classes, {css})", ident and f"{e}.id = {ident}"]
        return f"coalesce({' AND '.join([f'{e}.step >= 0', *filter(None, tests)])}, false)"
    return (f"coalesce({e}.step >= 0 AND (get({selector}, 0) IS NULL OR {e}.tag = get({selector}, 0)) AND "
            f"(get({selector}, 1) IS NULL OR array_contains({e}.classes, get({selector}, 1))) AND "
            f"(get({selector}, 2) IS NULL OR {e}.id = get({selector}, 2)), false)")


def extent(els: str, tag: str, at: str = "a") -> str:
    """How many tokens after place ``at`` come before the end tag that balances ``tag`` (all, if none does)."""
    return (f"aggregate(slice({els}, {at} + 1, size({els})), named_struct('bal', 1, 'n', 0), (s, e) -> if(s.bal = 0, s, "
            f"named_struct('bal', s.bal + if(e.tag = {tag}, e.step, 0), 'n', s.n + 1)), s -> if(s.bal = 0, s.n - 1, s.n))")


def find(els: str, chain: tuple | str, nth: str) -> str:
    """``(start, end, seen)`` of the nth element of the chain; start 0 if there are fewer, ``seen`` of them.

    start is its place in the tokens, end that of its end tag.  A chain of one
    selector asks every token.  Others take one pass from the first token of the
    chain's first selector to the last one of its last: open elements of the
    earlier selectors are kept with the balance of their tags.
    """
    given = not isinstance(chain, str)
    size = str(len(chain)) if given else f"size({chain})"

    def level(n: str | int) -> tuple | str:
        return chain[n] if given else f"get({chain}, {n})"

    head, tail = level(0), level(-1 if given else f"{size} - 1")

    def result(a: str, seen: str) -> str:
        own = f"element_at({els}, {a})"
        return (f"named_struct('start', {a}, 'end', CASE WHEN {a} = 0 THEN size({els}) + 1 WHEN {own}.step = 0 THEN {a} + 1 "
                f"ELSE {a} + 1 + {extent(els, own + '.tag', a)} END, 'seen', {seen})")

    every = f"filter(transform({els}, (e, i) -> if({matches('e', head)}, i + 1, NULL)), a -> a IS NOT NULL)"
    alone = let(every, "ps", let(f"if({nth} > 0, coalesce(get(ps, {nth} - 1), 0), 0)", "a", result("a", "size(ps)")))

    def state(i="s.i + 1", open_="s.levels", seen="s.seen", start="s.start"):
        return f"named_struct('i', {i}, 'levels', {open_}, 'seen', {seen}, 'start', {start})"

    # levels whose tag is balanced now are closed, and all inside them
    balanced = "transform(s.levels, l -> named_struct('tag', l.tag, 'bal', l.bal + if(l.tag = e.tag, e.step, 0)))"
    left = let(balanced, "u", "if(exists(u, l -> l.bal <= 0), slice(u, 1, cast(array_position(transform(u, l -> l.bal <= 0), true) AS INT) - 1), u)")
    hit = f"size(o) = {size} - 1 AND {matches('e', tail)}"
    opened = (" OR ".join(f"(size(o) = {n} AND {matches('e', chain[n])})" for n in range(len(chain) - 1)) or "false") if given else matches(
        "e", level("size(o)"))
    opens = f"size(o) < {size} - 1 AND e.step = 1 AND ({opened})"
    step = (f"CASE WHEN s.start > 0 THEN s WHEN e.step IS NULL THEN {state()} ELSE "
            + let(f"if(size(s.levels) = 0, s.levels, {left})", "o",
                  f"CASE WHEN {hit} THEN {state(open_='o', seen='s.seen + 1', start=f'if(s.seen + 1 = {nth}, s.i + 1, 0)')} "
                  f"WHEN {opens} THEN {state(open_='concat(o, array(named_struct(%s)))' % chr(39).join(['', 'tag', ', e.tag, ', 'bal', ', 1']))} "
                  f"ELSE {state(open_='o')} END") + " END")
    first = state("b.first - 1", "cast(array() AS ARRAY<STRUCT<tag: STRING, bal: INT>>)", "0", "0")
    bounds = (f"named_struct('first', cast(array_position(transform({els}, e -> coalesce(e.step = 1, false) AND {matches('e', head)}), true) AS INT), "
              f"'after', cast(array_position(reverse(transform({els}, e -> {matches('e', tail)})), true) AS INT))")
    part = f"slice({els}, greatest(b.first, 1), if(b.first = 0 OR b.after = 0, 0, greatest(size({els}) + 2 - b.after - b.first, 0)))"
    chained = let(bounds, "b", f"aggregate({part}, {first}, (s, e) -> {step}, d -> {result('d.start', 'd.seen')})")
    if given:
        return alone if len(chain) == 1 else chained
    return f"if({size} = 1, {alone}, {chained})"


def place(els: str, chain: tuple | str) -> str:
    """Place of the first element of the chain, 0 if there is none."""
    given = not isinstance(chain, str)
    alone = f"cast(array_position(transform({els}, e -> {matches('e', chain[0] if given else f'get({chain}, 0)')}), true) AS INT)"
    if given and len(chain) == 1:
        return alone
    chained = f"{find(els, chain, '1')}.start"
    return chained if given else f"if(size({chain}) = 1, {alone}, {chained})"


def marked(els: str) -> str:
    """``(at, bits, opens)`` of the tokens that have bits, in order; the functions below want it as ``marks``."""
    own = "named_struct('at', i + 1, 'bits', e.bits, 'opens', coalesce(e.step = 1, false))"
    return f"filter(transform({els}, (e, i) -> if(e.bits <> 0, {own}, NULL)), h -> h IS NOT NULL)"


def marked_place(els: str, chain: tuple, nth: int = 1) -> str:
    """Place of the nth element of a chain of bits, 0 if there are fewer.

    The first element of a chain of two is mostly the first that fits behind the
    first token that opens the outer one; if that was closed in between, all
    tokens are gone through.
    """
    if len(chain) == 1:
        return f"coalesce(get(filter(marks, h -> {matches('h', chain[0])}), {nth - 1}).at, 0)"
    whole = f"{find(els, chain, str(nth))}.start"
    if len(chain) > 2 or nth > 1:
        return whole
    outer = f"get(filter(marks, h -> h.opens AND {matches('h', chain[0])}), 0).at"
    inner = f"get(filter(marks, h -> h.at > p AND {matches('h', chain[1])}), 0).at"
    closed = f"exists(slice({els}, p + 1, b - p - 1), e -> coalesce(e.step = -1 AND e.tag = element_at({els}, p).tag, false))"
    return let(outer, "p", f"if(p IS NULL, 0, {let(inner, 'b', f'CASE WHEN b IS NULL THEN 0 WHEN {closed} THEN {whole} ELSE b END')})")


def inside(els: str, a: str) -> str:
    """The tokens between the tags of the element at place ``a``; only one that holds another of its kind is balanced."""
    own = f"element_at({els}, {a})"
    near = f"cast(array_position(transform(slice({els}, {a} + 1, size({els})), e -> coalesce(e.step <> 0 AND e.tag = g, false)), true) AS INT)"
    n = let(f"{own}.tag", "g", let(near, "n", f"CASE WHEN n = 0 THEN size({els}) - {a} WHEN element_at({els}, {a} + n).step = -1 THEN n - 1 "
                                              f"ELSE {extent(els, 'g', a)} END"))
    # most hold one piece of text
    plain = f"get({els}, {a}).step IS NULL AND get({els}, {a} + 1).step = -1 AND get({els}, {a} + 1).tag = {own}.tag"
    return f"slice({els}, {a} + 1, CASE WHEN {own}.step = 0 THEN 0 WHEN {plain} THEN 1 ELSE {n} END)"


def content(els: str, at: str) -> str:
    """The tokens between an element's tags, as ``find`` gives its place."""
    return f"slice({els}, {at}.start + 1, greatest({at}.end - {at}.start - 1, 0))"


def text(els: str) -> str:
    """Text of tokens: each piece stripped, joined without a separator."""
    ws = K.WHITESPACE_CLASS
    stripped = f"if(x.raw RLIKE {_text(BARE_TEXT)}, x.raw, regexp_replace(x.raw, {_text(f'^{ws}+|{ws}+$')}, ''))"
    return f"array_join(transform(filter({els}, x -> x.step IS NULL), x -> {stripped}), '')"


def elements(els: str, tag: str, body: str) -> str:
    """``body`` for every element of a tag, in order: ``a`` is the place of its start tag, ``c`` its content, ``j`` its number from 0.

    Up to the next element of the tag if the element is closed there; only one
    that holds another of its kind is balanced over all that follows.
    """
    starts = f"filter(transform({els}, (e, i) -> if(e.tag = {tag} AND e.step >= 0, i + 1, NULL)), a -> a IS NOT NULL)"
    close = f"cast(array_position(transform(q, e -> coalesce(e.tag = {tag} AND e.step = -1, false)), true) AS INT)"
    # a number of tokens, not the tokens: what a let gives is copied
    n = let(f"slice({els}, a + 1, coalesce(get(st, j + 1), size({els}) + 1) - a - 1)", "q",
            let(close, "k", f"if(k > 0, k - 1, {extent(els, tag)})"))
    own = let(f"slice({els}, a + 1, if(element_at({els}, a).step = 0, 0, {n}))", "c", body)
    return let(starts, "st", f"transform(st, (a, j) -> {own})")
