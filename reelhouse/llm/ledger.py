"""Secret scans with an incremental blob ledger (operator 9).

Every version of every path is addressed by the SHA-256 of its content, a
blob.  The ledger is a Parquet folder of ``(blob, rules, findings)``: the rule
versions a scan applied to the blob and the spans they found.  A run scans each
distinct blob only with the rule versions that the ledger lacks for it, appends
what it found (also "nothing"), and joins the findings back to all paths.

Only blobs to be scanned are shuffled (by digest, copies dropped first); the
join back moves digests and findings.

Cases: a null content counts as the empty text; null paths and repeated rows
are kept, one result row each; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.llm.common import text_of, tidy, written
from reelhouse.llm.distinct import distinct_contents
from reelhouse.llm.token_cache import _exists

FINDINGS = "array<struct<rule:string,start:int,end:int>>"
SCHEMA = f"blob binary, rules array<string>, findings {FINDINGS}"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Rule:
    """A named pattern; a match counts if ``group`` has ``least`` characters.

    Raise ``version`` when a rule changes: blobs are then scanned by it again.
    """

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    version: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        find = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0)).finditer

        def spans(text: str) -> list[tuple[int, int]]:
            if self.hint and self.hint not in text:
                return []
            return [m.span() for m in find(text) if m.end(self.group) - m.start(self.group) >= self.least]
        return spans


#: What stands between the pieces of a key's body: white space, also escaped, and the marks of quoted or indented lines.
_GAP = r"""(?:\\[nrt]|[\s"'`,;>#*|\\])++"""
_BASE64 = r"(?:[A-Za-z0-9+/=]|\\/)"
#: A private key from its BEGIN line to the END line before any other BEGIN; without one, to the end of
#: its base64 lines.  Short pieces count there if they are a line of their own or end in padding.
PEM = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
       r"(?:[^-]++|-(?!----BEGIN ))*?-----END [A-Z ]{0,40}PRIVATE KEY-----|"
       rf"(?:{_GAP}(?:Proc-Type|DEK-Info): ?[\w,-]++)*+"
       rf"(?:{_GAP}{_BASE64}{{16,}}+|{_GAP}[A-Za-z0-9+/]++={{1,2}}+|"
       rf"""[\x20\t"']*+(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t>#*|"']*+{_BASE64}++(?=[\x20\t"',]*+(?:\Z|[\r\n]|\\[nr])))*+)""")

#: The base kinds in their order, then kinds with a fixed shape of their own.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=6, group=2, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hint="AKIA"),
    # runs are maximal, so asking for 24 in the pattern finds the same runs
    Rule("hex", r"[0-9a-f]{24,}", least=24),
    Rule("pem", PEM, hint="PRIVATE KEY-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {r.key: (r.name, r.finder()) for r in rules}
        for batch in batches:
            found = [[{"rule": name, "start": a, "end": b} for key in todo for name, find in (finders[key],)
                      for a, b in find(text)]
                     for text, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _FOUND)],
                                             ["blob", "rules", "findings"])
    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What is known of each blob: the rule versions applied and the findings."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"),
                                    F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def unseen(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``(blob, _text, rules)``: distinct blobs with the rule versions they still need."""
    spark = versions.sparkSession
    rows = versions.select(blob(text_of(text_col)).alias("blob"), text_of(text_col).alias("_text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if not _exists(spark, path):
        return distinct_contents(rows.withColumn("rules", every))
    # digests only; texts then meet nothing but the digests that are missing
    known = ledger(spark, path).select("blob", F.col("rules").alias("_done"))
    todo = written(rows.select("blob").distinct().join(known, "blob", "left").select("blob", F.array_except(
        every, F.coalesce("_done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0), "unseen")
    return distinct_contents(rows.join(todo, "blob"))


def scan_versions(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES,
                  key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``(key columns, blob, findings)`` of every version; the ledger at ``path`` grows.

    ``findings`` holds the spans of the given rules by start, then rule order.
    """
    unseen(versions, path, rules, text_col).mapInArrow(tidy(_scan(rules)), SCHEMA).write.mode("append").parquet(path)
    names = F.array(*[F.lit(r.name) for r in rules])
    order = F.transform("findings", lambda f: F.struct(
        f["start"].alias("start"), F.array_position(names, f["rule"]).alias("at"), f["rule"].alias("rule"),
        f["end"].alias("end")))
    known = ledger(versions.sparkSession, path).select("blob", F.transform(
        F.array_sort(F.filter(order, lambda f: f["at"] > 0)),
        lambda f: F.struct(f["rule"], f["start"], f["end"])).alias("findings"))
    rows = versions.select(*key_cols, blob(text_of(text_col)).alias("blob"))
    # written: with a bare shuffle on either side Spark can split a blob that very many paths hold
    return rows.join(written(known, "findings").hint("merge"), "blob").select(*key_cols, "blob", "findings")


def _marked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with one mark for every run of overlapping spans."""
    out, end = [], 0
    for a, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
           mark: str = "[secret]") -> DataFrame:
    """``versions`` with every span found replaced by ``mark``; other columns as they are.

    Texts are joined to the findings of their blobs; only blobs with findings
    are on the other side.
    """
    unseen(versions, path, rules, text_col).mapInArrow(tidy(_scan(rules)), SCHEMA).write.mode("append").parquet(path)
    names = [r.name for r in rules]
    found = ledger(versions.sparkSession, path).select("blob", F.filter(
        "findings", lambda f: f["rule"].isin(*names)).alias("_found")).where(F.size("_found") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, last = batch.schema.get_field_index(text_col), batch.num_columns - 1
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(last).to_pylist()):
                if spans:
                    texts[i] = _marked(texts[i], sorted((f["start"], f["end"]) for f in spans), mark)
            columns = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1:last]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    # the ledger's column must not meet one of the same name
    known = found.withColumnRenamed("blob", "_blob")
    rows = versions.join(known.hint("merge"), blob(text_of(text_col)) == F.col("_blob"), "left").select(
        *[versions[c] for c in versions.columns], "_found")
    return rows.mapInArrow(tidy(run), versions.schema)
