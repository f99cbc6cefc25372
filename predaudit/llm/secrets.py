"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger has, per blob, which rules in which version it was scanned
with, and the spans they found. A scan looks for pairs of blob and rule version that the ledger lacks, reads each such blob once, whatever the
number of paths that hold it, and appends a row for it; findings are then joined back to all paths.

Positions come from two built-in functions of one pattern: the pieces between the matches and the matches alternate, so the running
sum of their lengths is where a match begins. Sums run within one blob and rule.

Defined results: a null text is the empty blob; paths with a null doc_id or repeated rows are reported like any other; a rule whose version
changed is scanned again and its older findings are no longer reported; an empty table gives no rows and leaves the ledger as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predaudit.functions.lineage import store
from predaudit.llm.prefilter import among


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),  # the same spans as AKIA[A-Z0-9]+ of 18 characters or more
    Rule("hex", "[0-9a-f]{16,}"),  # the same spans as [0-9a-f]+ of 16 characters or more
)
RULES = (
    *BASE,
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

LEDGER = "blob binary, rules array<string>, spans array<struct<rule: string, start: bigint, end: bigint>>"


def blob(column: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"), 256))


def _matches(rule: Rule) -> Column:
    """Array of ``(rule, i, gap, length, value)``: characters before each match since the last one, of it and of its group."""
    text, pattern = F.col("_text"), F.lit(rule.pattern)

    def lengths(strings: Column) -> Column:
        return F.transform(strings, lambda x: F.length(x).cast("long"))

    gaps = lengths(F.split(text, rule.pattern, -1))
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    value = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    zipped = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("length"), value.alias("value")),
        lambda x, i: F.struct(
            F.lit(rule.id).alias("rule"), F.lit(rule.least).alias("least"), i.alias("i"), x["gap"].alias("gap"),
            x["length"].alias("length"), x["value"].alias("value"),
        ),
    )
    return F.when(F.array_contains("_todo", rule.id) & text.rlike(rule.pattern), F.filter(zipped, lambda x: x["length"].isNotNull()))


def _findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, spans)`` of the blobs in which anything is found. ``blobs`` has blob, _text and _todo."""
    hits = (
        blobs.select("blob", F.explode(F.array(*[_matches(r) for r in rules])).alias("m")).where("m is not null")
        .select("blob", F.explode("m").alias("m")).select("blob", "m.*")
    )
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = hits.dropDuplicates(["blob", "rule", "i"]).withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far))
    return (
        ends.where("value >= least")
        .select("blob", F.struct("rule", (F.col("end") - F.col("length")).alias("start"), "end").alias("span"))
        .groupBy("blob").agg(F.collect_list("span").alias("spans"))  # of one document
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows to append to the ledger: every blob that it lacks under some rule version, with the rules scanned and the spans found."""
    ids = [r.id for r in rules]
    paths = store(docs.select("doc_id", blob().alias("blob")), "secret-paths")
    least = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        lacking = least.withColumn("_todo", F.array(*[F.lit(i) for i in ids]))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # rules ever had
        missing = F.array_except(F.array(*[F.lit(i) for i in ids]), F.coalesce("seen", F.array().cast("array<string>")))
        lacking = least.join(seen, "blob", "left").withColumn("_todo", missing).where(F.size("_todo") > 0).drop("seen")
    key = F.xxhash64("doc_id", "blob").alias("_key")
    wanted = store(lacking.select("blob", "doc_id", "_todo", key), "secret-todo")
    others = paths.select(key).join(wanted.select("_key"), "_key", "left_anti")
    texts = docs.select("doc_id", blob().alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_key", key)
    sure, doubtful = among(texts, "_key", wanted.select("_key"), others)
    if ledger is None:  # every wanted blob has the same rules to do
        sure = sure.withColumn("_todo", F.array(*[F.lit(i) for i in ids]))
        doubtful = doubtful.join(wanted.select("_key", "_todo"), "_key")
    else:
        sure, doubtful = (x.join(wanted.select("_key", "_todo"), "_key") for x in (sure, doubtful))
    columns = ["blob", "_text", "_todo"]
    found = _findings(sure.select(*columns).unionByName(doubtful.select(*columns)), rules)
    none = F.array().cast("array<struct<rule: string, start: bigint, end: bigint>>")
    return wanted.join(found, "blob", "left").select("blob", F.col("_todo").alias("rules"), F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, findings)``: for every path the spans ``(start, rank, end, kind)`` of its blob under the current rules, in order."""
    known = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(n).alias("rank"), F.lit(r.kind).alias("kind")))])
    current = F.filter("spans", lambda s: s["rule"].isin([r.id for r in rules]))
    ordered = F.array_sort(
        F.transform(
            current,
            lambda s: F.struct(
                s["start"].alias("start"), known[s["rule"]]["rank"].alias("rank"), s["end"].alias("end"), known[s["rule"]]["kind"].alias("kind")
            ),
        )
    )
    one_row = ledger.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row per scan of the blob
    found = store(one_row.where(F.size("spans") > 0).select("blob", ordered.alias("findings")), "secret-findings")
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    return (
        docs.select("doc_id", blob().alias("blob")).join(found, "blob", "left")
        .select("doc_id", F.coalesce("findings", none).alias("findings"))
    )


def _spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(reported: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every path."""
    kinds = [r.kind for r in BASE]
    base = F.filter("findings", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return reported.select(
        "doc_id", *[count(k) for k in kinds], F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("findings")).alias("spans")
    )
