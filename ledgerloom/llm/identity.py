"""Documents told apart where one id names several texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise


def body_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def ambiguous_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, least): the ids that name more than one text, and the least hash of theirs."""
    hashed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", body_hash().alias("body"))
    return materialise(
        hashed.groupBy("doc_id")
        .agg(F.min("body").alias("least"), F.max("body").alias("most"))
        .filter("least < most")
        .select("doc_id", "least"),
        "ambiguous",
    )


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, body): ``body`` is a hash of the text where its id names several, else 0.

    Where no id does, which is the rule, the texts are not joined with anything.
    """
    ambiguous = ambiguous_ids(docs)
    plain = docs.select("doc_id", "text")
    if ambiguous.isEmpty():
        return plain.withColumn("body", F.lit(0).cast("bigint"))
    body = F.when(F.col("least").isNotNull(), body_hash()).otherwise(F.lit(0))
    return plain.join(ambiguous, "doc_id", "left").select("doc_id", "text", body.cast("bigint").alias("body"))


def one_id_per_text(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_id``: the doc_id, or for further texts of an id a number above all ids.

    The text of least hash keeps the id. Numbers of the others are drawn from 2^61
    by hash, or less where ids come close to the largest number.
    """
    ambiguous = ambiguous_ids(docs)
    if ambiguous.isEmpty():
        return docs.withColumn("text_id", F.col("doc_id"))
    most = docs.agg(F.max("doc_id")).first()[0]
    room = min(1 << 61, (1 << 63) - 1 - most)
    if room < 1 << 32:
        raise ValueError("doc_ids leave no room for numbers of texts that share an id")
    known = ambiguous.toDF("_doc_id", "_least")
    number = F.lit(most + 1) + F.pmod(F.xxhash64("doc_id", body_hash()), F.lit(room))
    further = F.col("_least").isNotNull() & (body_hash() != F.col("_least"))
    return docs.join(known, docs["doc_id"] == known["_doc_id"], "left").select(
        *[docs[name] for name in docs.columns],
        F.when(further, number).otherwise(docs["doc_id"]).cast("bigint").alias("text_id"),
    )
