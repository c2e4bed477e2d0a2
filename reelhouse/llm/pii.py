"""Personal data by weak supervision (operator 7); DataFrame functions only.

Spans come from the base patterns, which always count, and from looser
patterns, whose spans are candidates.  Labelers vote for or against every span
or abstain: the strict form, gazetteers (top-level domains, card issuers,
address blocks, dialling codes), words before it, and what touches it.
Expectation-maximisation over the counts of vote patterns (at most 3^5 a kind)
estimates how reliable each labeler is and how likely a pattern is true.  With
these soft labels a naive Bayes classifier over the spans' shape is trained,
and it decides about the candidates.

The texts are read once, in one projection; what is kept of them is a row of
spans, votes and shapes.  The groupings that follow have a fixed number of
keys.  A pattern starts only where it could not have started before and is
possessive, so that matching is linear in the length of a text.

Cases: a null text counts as the empty text; null ids and repeated rows are
kept, one result row each; without any span all models are flat; an empty table
gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns.  A match starts at the start of its run of characters (an
#: e-mail's also where the one before ends); runs are matched whole.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with single separators, those of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.)-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])(?! [0-9])",
}
#: A text without a match of the hint has no span of the pattern: every match of a pattern holds one of its own hint.
BASE_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
LOOSE_HINT = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"[0-9]{3}"}
TOP_LEVEL = r"(?i)[.\])] ?(com|org|net|edu|gov|mil|int|info|io|de|fr|es|it|uk|eu|nl|ch|at|us|ca|jp|cn|in|br|ru|au)$"
ISSUER = r"^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|62|64|65|35)"
NO_HOST = r"^(0|10|127|22[4-9]|2[3-5][0-9])\."
DIALLING = r"^\+?(1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS_FOR = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|address|from|to)\W*$",
    "ip": r"(?i)(ip|ipv[46]|host|server|address|addr|gateway|client)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|payment|pan)\W*(number|no|nr)?\W*$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|whatsapp|number)\W*$",
}
WORDS_AGAINST = r"(?i)(version|ver|v|order|isbn|issn|serial|section|chapter|figure|page|invoice|ticket|rev|build|id)\W*$"
LABELERS = 5
ROUNDS = 12
#: A candidate counts from this probability on.
THRESHOLD = 0.75
SMOOTH = 0.5

_SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:array<string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits has a valid check digit."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), lambda i: (
        F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _valid(kind: str, text: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":  # every part at most 255, leading zeros allowed
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _loose_valid(kind: str, text: Column) -> Column:
    return luhn(_digits(text)) if kind == "card" else F.lit(True)


def _matches(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """(matches, what stands between them) of a pattern."""
    some = text.rlike(hint)
    none = F.array().cast("array<string>")
    return (F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(some, F.split(text, pattern, -1)).otherwise(none))


def _placed(found: Column, between: Column) -> Column:
    """``(start, end, text, left, right)`` of every match, in code points."""
    n = F.size(found)
    rows = F.arrays_zip(F.slice(between, 1, n).alias("left"), found.alias("text"), F.slice(between, 2, n).alias("right"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<start:int,end:int,text:string,left:string,right:string>>").alias("spans"))

    def step(held: Column, row: Column) -> Column:
        start = held["at"] + F.length(row["left"])
        end = start + F.length(row["text"])
        span = F.struct(start.alias("start"), end.alias("end"), row["text"].alias("text"),
                        F.right(row["left"], F.lit(24)).alias("left"), F.left(row["right"], F.lit(1)).alias("right"))
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    return F.when(n > 0, F.aggregate(rows, empty, step, lambda held: held["spans"]))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, "+").when(against, "-").otherwise("0")


def _votes(kind: str, span: Column, base: bool) -> Column:
    """One character a labeler: + for, - against, 0 abstains."""
    text, digits = span["text"], _digits(span["text"])
    strict = {
        "email": text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?(@|\(at\)|\[at\])"),
        "ip": ~text.rlike(r"(^|\.)0[0-9]"),
        "card": F.length(digits).between(15, 16),
        "phone": F.length(digits).between(10, 13),
    }[kind]
    gazetteer = {
        "email": _vote(text.rlike(TOP_LEVEL), F.lit(True)),
        "ip": _vote(text.contains(":"), text.rlike(NO_HOST)),
        "card": _vote(digits.rlike(ISSUER), F.lit(True)),
        "phone": _vote(text.rlike(DIALLING), F.lit(False)),
    }[kind]
    context = _vote(span["left"].rlike(WORDS_FOR[kind]), span["left"].rlike(WORDS_AGAINST))
    touched = span["left"].rlike(r"[\w@#/=.-]$") | span["right"].rlike(r"^[\w@#/=-]")
    form = _vote(F.lit(base), F.lit(False))
    return F.concat(form, _vote(strict, ~strict), gazetteer, context, _vote(~touched, touched))


def _shape(kind: str, span: Column) -> Column:
    """What the classifier sees of a span: a few values for each feature."""
    text = span["text"]
    n, digits = F.length(text), F.length(_digits(text))
    bucket = F.when(n < 12, "a").when(n < 16, "b").when(n < 20, "c").when(n < 26, "d").otherwise("e")
    return F.array(
        bucket, F.when(digits * 4 >= n * 3, "a").when(digits * 2 >= n, "b").when(digits > 0, "c").otherwise("d"),
        F.when(text.rlike(r"[\s()]"), "a").when(text.contains("-"), "b").otherwise("c"),
        F.when(text.rlike("[A-Z]"), "a").otherwise("b"),
        F.when(text.rlike(r"(\w)\1\1\1"), "a").otherwise("b"),
        F.when(span["left"].rlike(r"(^|\s)$"), "a").when(span["left"].rlike(r"\w$"), "b").otherwise("c"),
        F.when(span["right"].rlike(r"^(\s|$)"), "a").when(span["right"].rlike(r"^\w"), "b").otherwise("c"))


FEATURES = 7


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, spans)``: base spans and candidates with their votes and shapes."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    for kind in KINDS:
        for name, patterns, hints in (("base", BASE, BASE_HINT), ("loose", LOOSE, LOOSE_HINT)):
            found, between = _matches(F.col("_text"), patterns[kind], hints[kind])
            rows = rows.withColumns({f"{kind}_{name}_m": found, f"{kind}_{name}_s": between})
    rows = rows.drop("_text")
    parts = []
    for k, kind in enumerate(KINDS):
        for name in ("base", "loose"):
            base = name == "base"
            valid = _valid if base else _loose_valid
            spans = F.filter(_placed(F.col(f"{kind}_{name}_m"), F.col(f"{kind}_{name}_s")), lambda s: valid(kind, s["text"]))
            parts.append(F.coalesce(F.transform(spans, lambda s: F.struct(
                F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
                _votes(kind, s, base).alias("votes"), _shape(kind, s).alias("shape"))), F.array().cast(f"array<{_SPAN}>")))
    return written(rows.select("_id", F.concat(*parts).alias("spans")), "pii-spans")


def reliabilities(spans: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation: the probability of every ``kind:votes`` that occurs."""
    seen = written(spans.select(F.explode("spans").alias("s")).groupBy(
        F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    sign = [F.substring("votes", j + 1, 1) for j in range(LABELERS)]
    # to begin with, the share of votes for among those cast
    cast = F.length(F.regexp_replace("votes", "0", ""))
    truth = (F.length(F.regexp_replace("votes", "[^+]", "")) + 1) / (cast + 2)
    for _ in range(rounds):
        sums = [F.sum(F.col("n") * y * F.when(sign[j] == v, 1.0).otherwise(0.0)).alias(f"{v}{j}{t}")
                for j in range(LABELERS) for v in "+-" for t, y in (("y", truth), ("n", 1 - truth))]
        total = [F.sum(F.col("n") * y).alias(t) for t, y in (("y", truth), ("n", 1 - truth))]
        odds = F.lit(0.0)
        for row in seen.groupBy("kind").agg(*total, *sums).collect():  # one row a kind
            own = F.lit(math.log((row["y"] + SMOOTH) / (row["n"] + SMOOTH)))
            for j in range(LABELERS):
                voted = {t: row[f"+{j}{t}"] + row[f"-{j}{t}"] + 2 * SMOOTH for t in "yn"}
                for v in "+-":  # an abstention says nothing
                    gain = math.log((row[f"{v}{j}y"] + SMOOTH) / voted["y"]) - math.log((row[f"{v}{j}n"] + SMOOTH) / voted["n"])
                    own = own + F.when(sign[j] == v, gain).otherwise(0.0)
            odds = F.when(F.col("kind") == row["kind"], own).otherwise(odds)
        truth = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))
    rows = seen.select("kind", "votes", truth.alias("p")).collect()  # at most 3^5 a kind
    return {f"{r['kind']}:{r['votes']}": r["p"] for r in rows}


def train(spans: DataFrame, truth: dict[str, float]) -> dict[str, float]:
    """Naive Bayes log odds of ``kind:feature:value``, and of ``kind``, from soft labels."""
    if not truth:
        return {}
    soft = F.element_at(_table(truth), F.concat_ws(":", F.col("s.kind").cast("string"), F.col("s.votes")))
    each = spans.select(F.explode("spans").alias("s")).select(
        F.col("s.kind").alias("kind"), soft.alias("y"), F.posexplode("s.shape").alias("feature", "value"))
    rows = each.groupBy("kind", "feature", "value").agg(
        F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("n")).collect()  # kinds x features x values
    out: dict[str, float] = {}
    for kind in {r["kind"] for r in rows}:
        own = [r for r in rows if r["kind"] == kind]
        y, n = (sum(r[t] for r in own if r["feature"] == 0) for t in "yn")
        out[f"{kind}"] = math.log((y + SMOOTH) / (n + SMOOTH))
        for r in own:
            out[f"{kind}:{r['feature']}:{r['value']}"] = math.log((r["y"] + SMOOTH) / (y + 5 * SMOOTH)) - math.log(
                (r["n"] + SMOOTH) / (n + 5 * SMOOTH))
    return out


def _table(values: dict[str, float]) -> Column:
    """A map literal; at most some hundred entries."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(float(v)) for v in values.values()]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, base, spans)``: base spans and all spans as ``(kind, start, end)`` in order."""
    rows = candidates(docs, id_col, text_col)
    truth = reliabilities(rows)
    model = train(rows, truth)
    names = F.array(*[F.lit(k) for k in KINDS])

    def accepted(s: Column) -> Column:
        if not model:
            return F.lit(False)
        table, kind = _table(model), s["kind"].cast("string")
        known = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))
        odds = known(kind)
        for f in range(FEATURES):
            odds = odds + known(F.concat_ws(":", kind, F.lit(str(f)), s["shape"][f]))
        # the votes speak as well as the shape
        votes = F.coalesce(F.element_at(_table(truth), F.concat_ws(":", kind, s["votes"])), F.lit(0.5))
        return (odds >= math.log(threshold / (1 - threshold))) & (votes >= threshold)

    def overlaps(s: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))

    named = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))),
                                      lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumn("_base", F.filter("spans", lambda s: s["base"]))
    rows = rows.withColumn("_more", F.filter("spans", lambda s: ~s["base"] & accepted(s) & ~overlaps(s, F.col("_base"))))
    # of overlapping candidates, the one of the earlier kind
    rows = rows.withColumn("_more", F.filter("_more", lambda s: ~overlaps(s, F.filter("_more", lambda o: o["kind"] < s["kind"]))))
    return rows.select(F.col("_id").alias(id_col), named(F.col("_base")).alias("base"),
                       named(F.concat("_base", "_more")).alias("spans"))
