"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every text is addressed by its content. The ledger records which rules, by
version, have scanned which blob, with what they found there. A scan runs only the pairs of
blob and rule version that the ledger lacks, however many paths hold the blob, and joins
the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    #: A string that every match holds, to look for first.
    holds: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. A run of 32 or more, or of 16 or more with its start,
# is what is left of all runs after the shorter ones are dropped.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", holds="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
# A private key: its header, and all up to the END line. Where that is missing, the base64 run (lines, a text
# on one line, or what a cut leaves at the end of the text). Loops of groups are bounded, as Java's recurse.
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:[ \t\r\n]*(?:Proc-Type|DEK-Info):[^\r\n]*){0,4}[ \t\r\n]*[A-Za-z0-9+/=\r\n\\]{16,}(?:[ \t]+[A-Za-z0-9+/=\r\n\\]{8,}){0,125}(?:[ \t]+[A-Za-z0-9+/]{1,7}={0,2})?"
    r"|[ \t\r\n\\]*[A-Za-z0-9+/]{1,15}={0,2}[ \t\r\n]*\z)?"
)
RULES = (
    *BASE,
    Rule("pem", 2, _PEM, holds="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
)

LEDGER = "blob string, rule string, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _pieces(rule: Rule, rank: int) -> Column:
    """One entry a match: characters before it since the last match, its length, and whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    lists = [F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, rule.pattern, -1).alias("between")]
    if rule.least:
        lists.append(F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("group"))

    def entries(made: Column) -> Column:
        return F.transform(
            made["found"],
            lambda match, i: F.struct(
                F.lit(rank).alias("rank"),
                i.alias("i"),
                F.length(F.get(made["between"], i)).cast("bigint").alias("before"),
                F.length(match).cast("bigint").alias("size"),
                (F.length(F.get(made["group"], i)) >= rule.least if rule.least else F.lit(True)).alias("fine"),
            ),
        )

    made = F.transform(F.array(F.struct(*lists)), entries)[0]  # the lists are made once a text, not once a match
    wanted = F.array_contains("rules", rule.name) & (F.contains(text, F.lit(rule.holds)) if rule.holds else F.lit(True)) & F.regexp(text, pattern)
    return F.when(wanted, made).otherwise(F.array().cast("array<struct<rank:int,i:int,before:bigint,size:bigint,fine:boolean>>"))


def scan(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: pairs of blob and rule version that it lacks, scanned.

    Reads text of ``versions``; a null text is an empty one. Other columns are ignored. No row
    gives none; a ledger that holds all pairs gives none. Each blob is read once, whole.
    """
    rules = tuple(rules)
    names = F.array(*(F.lit(r.name) for r in rules))
    # one text a blob: equal texts meet after each task has kept one of its own
    texts = versions.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    known = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    pending = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    looked = materialize(pending.select("blob", "rules", F.concat(*(_pieces(r, k) for k, r in enumerate(rules))).alias("pieces")))

    # lengths up to a match, summed in the order of the matches, are its place in the text
    order = "partition by blob, rank order by i rows unbounded preceding"
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = (
        looked.select("blob", F.inline("pieces"))
        .withColumn("end", F.expr(f"sum(before + size) over ({order})"))
        .where("fine")
        .groupBy("blob", "rank")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "rank", F.get(kinds, F.col("rank")).alias("kind"), "end"))).alias("spans"))
    )
    scanned = looked.select("blob", F.explode("rules").alias("rule"))
    found = spans.withColumn("rule", F.get(names, F.col("rank"))).select("blob", "rule", "spans")
    return scanned.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.expr(f"cast(array() as {LEDGER.split('spans ')[1]})")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with spans: what the ledger's rules found in each row's text.

    Adds spans, an array of (start, rank, kind, end) sorted by start and then by the rules' order; empty where there
    are none. Positions count code points and ends are exclusive. All columns of ``versions``
    but a ``spans`` of its own are kept as they are; every path of a blob gets its findings.
    """
    own = versions.drop("spans")
    names = [f"_{i}" for i in range(len(own.columns))]
    rows = own.toDF(*names)
    text = names[own.columns.index("text")]
    rows = rows.withColumn("blob", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    hits = (
        ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    none = F.expr(f"cast(array() as {LEDGER.split('spans ')[1]})")
    return rows.join(hits, "blob", "left").select(*(F.col(n).alias(c) for n, c in zip(names, own.columns, strict=True)), F.coalesce("spans", none).alias("spans"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, counts of the base rules' spans, their digest, and all spans spelled out."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in base),
        F.sha2(spelled(of(*(r.kind for r in base))).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap are replaced as one."""
    grown = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.when(s["start"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("done"),
                s["end"].alias("at"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(grown["done"], F.substring(text, (grown["at"] + 1).cast("int"), F.length(text))))
