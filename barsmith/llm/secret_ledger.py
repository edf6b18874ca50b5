"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger, a
Parquet folder that only grows, holds one row for each pair of blob and rule
version that was scanned, with the spans found. A scan takes the pairs that the
ledger doesn't hold, reads each such blob once however many paths have it,
appends what it finds, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, new_path

#: Base kinds, in the order that breaks ties.
BASE = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_SIMPLE = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
KINDS = ("assign", *_SIMPLE)
_RANK = {k: i for i, k in enumerate(KINDS)}

SPANS = "array<struct<kind:string,start:int,stop:int>>"


def rule_version() -> str:
    """Name of the rules in force: changes whenever a pattern does."""
    body = "\n".join([_ASSIGN.pattern, *(f"{k} {p.pattern}" for k, p in _SIMPLE.items())])
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text (code points, end exclusive) by start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, pattern in _SIMPLE.items():
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(t)] for t in batch["_text"]]
        yield pd.DataFrame({"blob": batch["_blob"], "spans": spans})


class SecretLedger:
    """The ledger in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def rows(self) -> DataFrame:
        """blob, rule_version, spans: one row for each pair that was scanned."""
        schema = f"blob string, rule_version string, spans {SPANS}"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scan(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """Findings of every row: id, blob and ``spans`` (empty array if none), one row per input row.

        Null texts count as empty; an empty table gives no rows. Texts of any
        length are scanned whole. Rows may repeat ids or texts and give their
        findings each; a blob is read from the row with the smallest id that has
        it. Spans that start together stand in the order of their kinds. Ids
        keep their type, and columns beside id and text are not read, whatever
        their names. A retried append may repeat a pair; readers take one.
        """
        version = F.lit(rule_version())
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_blob", F.sha2(F.col("_text").cast("binary"), 256))
        paths = materialize(rows.select("_id", "_blob"), "paths")
        known = self.rows().where(F.col("rule_version") == version).select(F.col("blob").alias("_blob"))
        todo = paths.groupBy("_blob").agg(F.min("_id").alias("_rep")).join(known, "_blob", "left_anti")
        todo = todo.withColumnRenamed("_blob", "_want").hint("shuffle_hash")
        unseen = rows.join(todo, (F.col("_blob") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_blob", "_text")
        unseen.mapInPandas(_scan, f"blob string, spans {SPANS}").withColumn("rule_version", version).write.mode("append").parquet(self.path)

        found = self.rows().where((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), "spans").dropDuplicates(["_blob"])
        joined = paths.join(found, "_blob", "left")
        return joined.select(F.col("_id").alias(id_col), F.col("_blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        if found is None or not len(found):
            out.append(text)
            continue
        parts, at = [], 0
        for s in found:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[SECRET]"]
            at = max(at, s["stop"])
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ledger: SecretLedger | None = None) -> DataFrame:
    """The rows with every secret replaced by ``[SECRET]``; overlapping spans become one.

    All columns stay; ``n_chars``, if there is one, is set anew for rows that
    change. Null texts stay null, and empty ones empty; an empty table gives an
    empty one. Repeated rows and rows of equal text all stay and change alike, in
    any order (there are no ties to break). Very long texts are scanned and
    rewritten whole. Only blobs with findings are joined and rewritten.
    """
    ledger = ledger or SecretLedger(docs.sparkSession)
    ledger.scan(docs, text_col, id_col)
    key, blob, spans, new = fresh(docs, "_key", "_blob", "_spans", "_new")
    found = ledger.rows().where((F.col("rule_version") == rule_version()) & (F.size("spans") > 0))
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    joined = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).join(found, F.col(key) == F.col(blob), "left")
    hit = F.col(spans).isNotNull()
    rewrite = F.pandas_udf(_redacted, "string")
    joined = joined.withColumn(new, F.when(hit, rewrite(F.when(hit, F.col(text_col)), F.col(spans))).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        joined = joined.withColumn("n_chars", F.when(hit, F.char_length(new).cast(kind)).otherwise(F.col("n_chars")))
    return joined.withColumn(text_col, F.col(new)).select(*docs.columns)
