"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of every path is named by the SHA-256 of its text. The
ledger has one row per blob: the rule versions it was scanned with and the spans
they found. A scan groups versions to distinct blobs, runs only the rule
versions the ledger lacks for a blob, and appends what it found; findings then
join back to every path and version that holds the blob. All of it is built-in
functions.

Defined results: a null text counts as empty; an empty text is a blob without
spans; any number of equal texts is scanned once and reported for each of them,
rows repeated or not; a null path is kept as a path; an empty table gives an
empty result; columns of the input beyond the named ones are never read, so
their names cannot clash. Lengths are code points, and a span's end is exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.skew import spread_join

LEDGER = "blob string, rules array<string>, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches, and how long the given group must be at least."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns and least lengths of each kind.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
# A private key runs to its END line, over up to 64 runs of hyphens, such as those of
# header fields or of a diff, but not past the next line of five. Where no END line
# follows, it runs over header fields and lines of base64, in breaks that may be
# escaped, indented, quoted or commented out; up to 200 such lines not directly
# below each other, as repeating a group takes stack. The last word may be prose.
_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_CLOSED = r"[^-]*(?:-{1,4}[^-]+){0,64}-{5,}END [A-Z ]*PRIVATE KEY-----"
_BREAK = r"""[\t "'>|#*,;]*[\r\n\\][\t\r\n\\ "'>|#*,;]*"""
_FIELDS = rf"(?:{_BREAK}[A-Za-z]+-[A-Za-z]+: [^\r\n\\]*){{0,8}}"
_LINES = (
    rf"""(?:(?:{_BREAK}(?:-[\t "'>|#*,;]*)?[A-Za-z0-9+/=]|[\t ]*{'[A-Za-z0-9+/=]' * 16})"""
    r"(?:[A-Za-z0-9+/=\r\n\\]*[A-Za-z0-9+/=])?){0,200}"
)
PEM = f"{_HEAD}(?:{_CLOSED}|{_FIELDS}{_LINES})"
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"

# In the order that breaks ties between spans of one start. Hex runs are maximal,
# so asking for 16 digits in the pattern equals dropping shorter runs afterwards.
BASE = (Rule("assign", ASSIGN, 2, 12), Rule("access", ACCESS, 0, 18), Rule("hex", HEX, 0, 16))
RULES = (*BASE, Rule("pem", PEM, version=2), Rule("jwt", JWT))


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def versions_of(table: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(path, blob, text) of a table with one row for each version of each path."""
    body = F.coalesce(F.col(text), F.lit(""))
    return table.select(F.col(path).alias("path"), content_address(body).alias("blob"), body.alias("text"))


def _pieces(rule: Rule, rank: int, wanted: Column) -> Column:
    """For each match in order: what lies before it, its length, and whether it counts.

    Splitting by the pattern gives the stretches between matches, so lengths alone
    place every match. Texts without any match cost one search.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(matches, F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )
    found = F.transform(
        F.filter(parts, lambda part: part["size"].isNotNull()),
        lambda part, i: F.struct(
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            i.alias("i"),
            part["gap"].cast("bigint").alias("gap"),
            part["size"].cast("bigint").alias("size"),
            (part["value"] >= rule.shortest).alias("valid"),
        ),
    )
    nothing = F.array().cast(
        "array<struct<rank:int,kind:string,i:int,gap:bigint,size:bigint,valid:boolean>>"
    )
    return F.when(wanted & F.rlike(text, pattern), found).otherwise(nothing)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for the blob and rule-version pairs that the ledger lacks."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(
        F.collect_set("rule").alias("done")  # at most one entry per rule version ever used
    )
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    unseen = blobs.join(done, "blob", "left").select(
        "blob", "text", F.array_except(keys, F.coalesce("done", F.array())).alias("rules")
    ).filter(F.size("rules") > 0)
    pieces = F.concat(
        *[
            _pieces(rule, rank, F.array_contains("rules", rule.key))
            for rank, rule in enumerate(rules)
        ]
    )
    # Running sums in a window keep a text with very many matches linear.
    along = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(along)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end")
    return (
        unseen.select("blob", "rules", F.explode_outer(pieces).alias("piece"))
        .select("blob", "rules", "piece.*")
        .withColumn("end", end)
        .groupBy("blob")
        .agg(
            F.first("rules").alias("rules"),
            F.array_sort(F.collect_list(F.when(F.col("valid"), span))).alias("spans"),
        )
    )


def update_ledger(
    spark: SparkSession, versions: DataFrame, path: str, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen, append it, and return the ledger.

    The ledger may be missing at first. Appending is one committed write, so a
    lost executor repeats tasks and never leaves half a batch.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = (
        spark.read.schema(LEDGER).parquet(path)
        if store.exists(where)
        else spark.createDataFrame([], LEDGER)
    )
    scan_unseen(versions, known, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per version of a path: (path, blob, spans), the spans of all its rules in order.

    Spans that other versions of a rule found are left out.
    Only blobs with findings take part in the join, which is what makes that side small;
    the versions of a blob with very many of them spread over several tasks.
    """

    def current(span: Column) -> Column:
        return reduce(
            Column.__or__, [(span["kind"] == rule.kind) & F.array_contains("rules", rule.key) for rule in rules]
        )

    hits = (
        ledger.filter(F.size("spans") > 0)
        .select("blob", F.filter("spans", current).alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return (
        spread_join(versions.select("path", "blob"), hits, ["blob"], "path")
        .select("path", "blob", F.coalesce("spans", empty).alias("spans"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that touch or overlap become one mark."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, span: F.when(
            (F.size(done) > 0) & (span["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], span["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(
            F.concat(done, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))))
        ),
    )
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda span: span["end"]))
    starts = F.concat(
        F.transform(merged, lambda span: span["start"]), F.array(F.length(text).cast("bigint"))
    )
    kept = F.zip_with(
        ends, starts, lambda begin, end: F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))
    )
    return F.array_join(kept, mark)


def secret_counts(table: DataFrame, ledger_path: str) -> DataFrame:
    """The digest of findings per document: counts of base kinds, a hash of the base spans, all spans."""
    spark = table.sparkSession
    versions = versions_of(table, "doc_id")
    found = findings(versions, update_ledger(spark, versions, ledger_path))
    names = [rule.kind for rule in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda span: reduce(Column.__or__, [span["kind"] == name for name in names]))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(name).alias(f"n_{name}") for name in names],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


_DUCK = """
SELECT doc_id, row_id, '{kind}' AS kind, {rank} AS rank, i, m[i] AS m, v[i] AS v,
       (list_sum(list_transform(s[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
FROM (SELECT doc_id, row_id, m, v, s, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, row_id, regexp_extract_all(t, P, 0) AS m, regexp_extract_all(t, P, {group}) AS v,
         string_split_regex(t, P) AS s
  FROM (SELECT *, {pattern} AS P FROM d)))
"""


def oracle() -> str:
    """The same digest as SQL for the checking engine."""
    parts = " UNION ALL ".join(
        f"SELECT * FROM ({_DUCK.format(kind=rule.kind, rank=rank, group=rule.group, pattern=_quoted(rule.pattern))})"
        f" WHERE length(v) >= {rule.shortest}"
        for rank, rule in enumerate(RULES)
    )
    base = ", ".join(f"'{rule.kind}'" for rule in BASE)
    counts = ", ".join(
        f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
hits AS (SELECT row_id, kind, rank, start,
                kind || ':' || start || ':' || (start + length(m)) AS span FROM ({parts})),
found AS (SELECT row_id, {counts},
                 string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base,
                 string_agg(span, ',' ORDER BY start, rank) AS spans
          FROM hits GROUP BY row_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (row_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
