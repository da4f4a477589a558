"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, table, unwrapped, whole

#: Version of RULES: findings of another version never count as seen.
RULE_VERSION = 1

#: kind -> (pattern, least length, group whose length counts), in the order that breaks ties of start. The first three are the base.
RULES: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24, 0),
    "pem": (re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"), 60, 0),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 40, 0),
    "hosted": (re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"), 15, 0),
    "url_login": (re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/:@]{3,100})@", re.A), 3, 1),
}
BASE = ("assign", "access", "hex")
#: Whatever a rule can match holds one of these; only such texts go through the rules (RE2, over the whole batch at once).
_MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_|xox[abprs]-|AIza|://"

SCANNED = "blob string, spans array<struct<kind:string,start:int,end:int>>"
FINDINGS = "blob string, rule_version int, spans array<struct<kind:string,start:int,end:int>>"


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive. Leftmost and non-overlapping per kind."""
    found = []
    for order, (kind, (pattern, least, group)) in enumerate(RULES.items()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches):
    for b in batches:
        text = b.column(1)
        hot = pc.match_substring_regex(text, _MAY_HOLD).to_pylist()
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(text[i].as_py())] if h else [] for i, h in enumerate(hot)]
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kinds)], ["blob", "spans"])


def address(text_col: str = "text"):
    """Content address of a text: SHA-256 of its UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Findings (FINDINGS) of the blobs in `versions` that `ledger` has not seen under RULE_VERSION; append them to the ledger.

    Copies of a blob are combined before and after one shuffle of the texts, so each is scanned once; a blob with no finding gets a
    row with no spans, which marks it as seen.
    """
    blobs = versions.select(address(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.groupBy("blob", "body").agg(F.lit(1).alias("one")).select("blob", "body").mapInArrow(_scan, SCANNED).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")


class Ledger:
    """The ledger as a table in a folder: findings by blob and rule version, in a folder for each rule version. Runs read it and append what is new.

    A run that is repeated, or two at once, may append a blob twice; readers take one row.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(self.folder)

    def holds(self) -> bool:
        return not self.read().where(F.col("rule_version") == RULE_VERSION).isEmpty()

    def update(self, versions: DataFrame, text_col: str = "text") -> "Ledger":
        """Scans the blobs of `versions` that the ledger has not seen under RULE_VERSION, and appends their findings."""
        found = scan_unseen(versions, self.read() if self.holds() else None, text_col)
        found.write.mode("append").partitionBy("rule_version").parquet(self.folder)
        return self

    def findings(self) -> DataFrame:
        """blob and spans of the blobs with a finding under RULE_VERSION, each once."""
        rows = self.read().where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
        return rows.dropDuplicates(["blob"]).select("blob", "spans")


def findings_by_path(versions: DataFrame, ledger: Ledger, text_col: str = "text") -> DataFrame:
    """(doc, spans): the whole row of every version (see common.whole), without its text, with the findings of its blob."""
    paths = versions.select(whole(versions.drop(text_col)), address(text_col).alias("blob"))
    return paths.join(ledger.findings(), "blob", "left").select("doc", F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each maximal run of overlapping spans replaced by `mark`; other columns as they are, null texts stay null.

    The ledger is brought up to date first; then the texts are cut where they lie.
    """
    held = ledger.update(docs, text_col).findings()
    joined = docs.select(whole(docs), address(text_col).alias("blob")).join(held, "blob", "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: _cut(t, s, mark))

    text = F.col(f"doc.`{text_col}`").cast("string")
    new = F.when(F.size("spans") > 0, cut(text, F.col("spans"))).otherwise(text)
    return unwrapped(joined, docs.columns, **{text_col: new})


def _cut(text, spans, mark):
    if text is None or spans is None or not len(spans):
        return text
    out, at, open_to = [], 0, -1
    for s in spans:
        if s["start"] >= open_to:
            out += [text[at : s["start"]], mark]
        open_to = at = max(open_to, s["end"])
    return "".join(out) + text[at:]


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Findings of every row of documents, by way of a ledger that is stored and read back: a new one, so that all texts are scanned.

    Null text counts as empty; rows with the same text or the same doc_id (or none) each get their findings; extra columns do not matter; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings_by_path(docs, Ledger(spark, new_folder(spark, "secret-ledger")).update(docs)).select("doc.doc_id", "spans")
    written = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(written(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"),
        written(lambda s: F.lit(True)).alias("spans"),
    )


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base for one text, read off its words: for tests."""
    text, found = text or "", []
    base = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"AKIA[A-Z0-9]+", 20), "hex": (r"[0-9a-f]+", 24)}
    counts = []
    for order, (kind, (pattern, least)) in enumerate(base.items()):
        hits = [m for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0) if len(m[2] if kind == "assign" else m[0]) >= least]
        counts.append(len(hits))
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    return (*counts, hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest())
