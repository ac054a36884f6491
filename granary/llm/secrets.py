"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, text_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: A change of what is found must change this: it stands for the rules in the ledger.
RULES = hashlib.sha256("\n".join(["1", _ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, *KINDS]).encode()).hexdigest()[:16]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret in order; leftmost non-overlapping within a kind. Offsets count code points."""
    raw, out = text.encode("utf-8", "surrogatepass"), []
    lower = raw.lower()
    if any(name in lower for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Ledger:
    """A table of (rules, blob, starts, kinds, ends), one row for each blob and version of the rules that has been scanned.

    Its folder may be any that Spark writes to. Each scan appends its batch in one commit: a job that fails leaves none.
    """

    SCHEMA = "blob string, starts array<int>, kinds array<int>, ends array<int>, rules string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger"

    def read(self, rules: str = RULES) -> DataFrame | None:
        """What these rules have scanned so far; None before the first batch."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        # Two scans at the same time may both have added a blob; its findings are the same.
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("rules") == rules).dropDuplicates(["blob"])

    def scan(self, rows: DataFrame) -> None:
        """Scans the blobs of rows (blob, text) that these rules haven't seen yet, and appends the findings, none included."""
        seen = self.read()
        if seen is not None:
            rows = rows.join(seen.select("blob"), "blob", "left_anti")

        def first(c: dict) -> Iterator[tuple]:
            """A blob's copies within a task's slice are one; a hot blob is a row of each slice at most from here on."""
            return dict(zip(c["blob"], c["text"])).items()

        def found(c: dict) -> Iterator[tuple]:
            for blob, text in zip(c["blob"], c["text"]):
                spans = find(text)
                yield blob, *(([s[k] for s in spans]) for k in (0, 1, 2))

        rows = arrow_map(rows, first, "blob string, text string", 2048)
        made = arrow_map(rows, found, "blob string, starts array<int>, kinds array<int>, ends array<int>")
        made = made.groupBy("blob").agg(*(F.first(x).alias(x) for x in ("starts", "kinds", "ends")))
        made.withColumn("rules", F.lit(RULES)).write.mode("append").parquet(self.path)


def scan(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, blob, starts, kinds, ends) for each row of docs, by way of the ledger.

    Every text, null as empty, is addressed by its SHA-256. Only pairs of blob and rules that the ledger doesn't hold are
    scanned; findings are joined back to every row, copies and all. Repeated rows and null doc_ids are kept.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    ledger.scan(rows.select("blob", "text"))
    return rows.select("doc_id", "blob").join(ledger.read().drop("rules"), "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans, from the findings of scan()."""
    spans = F.transform(F.sequence(F.lit(1), F.size("starts")), lambda i: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.element_at("kinds", i) + 1), F.element_at("starts", i), F.element_at("ends", i)))
    spans = F.when(F.size("starts") > 0, F.array_join(spans, ",")).otherwise(F.lit(""))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(3)), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
