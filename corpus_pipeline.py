"""A corpus pipeline of five stages: toxicity, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``docs``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, mixing, packing, secrets, toxicity
from ledgerloom.llm.identity import one_id_per_text
from ledgerloom.llm.skew import spread_join
from ledgerloom.session import materialise, release, scratch_path

FRACTION, POWER = 0.9, 0.8
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Null and empty texts hold no toxic word and stay unless such rows were labelled
    toxic; rows that repeat share one fate; an empty table gives no rows; extra
    columns are carried along unread.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs, labels, toxicity.teaching_fold(F.col("doc_id")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = toxicity.score_documents(rows, lexicon, ["row"])
    return scored.filter(F.col("predicted") == 0).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked by five-word shingles with J >= 0.8.

    Rows with a null id are kept, and so are null and empty texts, which link with
    nothing; rows that repeat id and text are one document; further texts of an id
    are documents of their own that come after all ids; an empty table gives no
    rows; extra columns are carried along unread.
    """
    rows = one_id_per_text(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    found = jaccard.similar_documents(rows.select(F.col("text_id").alias("doc_id"), "text"), 5, 8, 10)
    later = found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("text_id")).distinct()
    return rows.join(later, "text_id", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew.

    A null text stays null and an empty one empty; rows without a secret stay as
    they are, other columns too, whatever their names; rows that repeat are
    redacted alike; an empty table gives no rows.
    """
    versions = secrets.versions_of(docs, "doc_id")
    ledger = secrets.update_ledger(spark, versions, scratch_path(spark, "ledger"))
    hits = ledger.filter(F.size("spans") > 0).select("blob", "spans")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        secrets.content_address(docs["text"]).alias("blob"),
        docs["doc_id"].alias("by"),
    )
    text, before = F.col("row")["text"], F.col("row")
    clean = F.when(F.col("spans").isNotNull(), secrets.redact(text, F.col("spans")))
    marked = spread_join(rows, hits, ["blob"], "by").withColumn("clean", clean)
    new = {"text": F.coalesce("clean", text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.coalesce(F.length("clean").cast(kind), before["n_chars"])
    return marked.select(*[new.get(name, before[name]).alias(name) for name in docs.columns])


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights: nine tenths of all tokens, margins tempered.

    A null source, language or layout is a class of its own; rows without tokens
    weigh nothing on the margins; extra columns are carried along unread; an empty
    table gives no rows.
    """
    cells = docs.select(
        F.struct(*docs.columns).alias("row"),
        "doc_id",
        "source",
        "lang",
        F.coalesce(mixing.layout_topic(F.col("text")), F.lit(mixing.NONE)).alias("topic"),
    )
    features = materialise(
        cells.select("source", "lang", "topic", mixing.token_count(F.col("row.text")).alias("tokens")), "features"
    )
    return mixing.mixed(cells, features, FRACTION, POWER).filter("selected").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null text is one end token, an empty table no rows."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", draw_mix),
    ("packing", pack),
]

ORACLE_SQL = None  # learned scores and tokenizer ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written out before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
