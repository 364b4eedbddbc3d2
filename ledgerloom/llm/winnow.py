"""Benchmark passages in training texts by winnowing, in built-in functions alone.

Words are hashed in grams of k. The smallest gram hash of every window of words is
its fingerprint, and consecutive windows mostly share one, so a text has far fewer
fingerprints than words. Two texts that share a window of words share its
fingerprint: no span of at least that many words is missed. Fingerprints of the
texts are looked up among those of the items; a hit is extended over all windows
that its fingerprint stands for, each compared by its first and last gram, which
together cover its words and make a name of 128 bits. Items of fewer words than a
window are one window of their own length, looked for in the same way.

Results depend on a text alone, so texts are known by a 128-bit address, and
copies are answered once. Long texts are taken in pieces of bounded length that end
with a word and carry the words that their last windows need. Fingerprints of items
are sent to all tasks only if they number at most ``SENT``; more are joined.

Defined results: null, empty and wordless texts have no words and no hits; a text
shorter than all windows has none; items without words, or with null text, occur
nowhere; an item without an id marks words but is not counted; rows of items that
repeat an id are one item with the windows of all of them; rows of documents that
repeat, or have no id, each keep a row; empty tables give no rows or no hits.
Columns besides ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise

GRAM = 5
PIECE = 1 << 16  # characters
SENT = 1 << 21

# What separates words, after A-Z became a-z.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a lowered text; splitting is several times faster than finding matches."""
    return F.array_remove(F.split(text, f"[{SEPARATORS}]+"), "")


def pieces(frame: DataFrame, width: int, *carried: str) -> DataFrame:
    """(carried, a, b, piece, pieces, own, words): the words of each piece of each text.

    ``own`` of the words belong to the piece; up to ``width - 1`` more follow them
    in the text.
    """
    body = rf"(?s)(.{{1,{PIECE}}}+[^{SEPARATORS}]*+)"
    after = rf"(?=((?:[{SEPARATORS}]*+[^{SEPARATORS}]++){{0,{width - 1}}}))"
    text, whole = F.col("_text"), F.length("_text") <= PIECE

    def found(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(body + after), F.lit(group))

    cut = F.when(whole, F.array(F.struct(text.alias("body"), F.lit("").alias("after")))).otherwise(
        F.arrays_zip(found(1).alias("body"), found(2).alias("after"))
    )
    return (
        frame.select(*carried, lowered(F.col("text")).alias("_text"))
        .select(
            *carried,
            F.xxhash64(text).alias("a"),
            F.xxhash64(F.lit(1), text).alias("b"),
            cut.alias("_cut"),
        )
        .select(*carried, "a", "b", F.size("_cut").alias("pieces"), F.posexplode_outer("_cut").alias("piece", "_cut"))
        .withColumn("words", words(F.concat("_cut.body", "_cut.after")))
        .withColumn("own", F.when(F.col("_cut.after") == "", F.size("words")).otherwise(F.size(words(F.col("_cut.body")))))
        .drop("_cut")
    )


def over_windows(
    frame: DataFrame, name: str, width: int, join: Callable[[Column, Column], Column]
) -> DataFrame:
    """Replace each element of an array by ``join`` over the ``width`` elements that begin there.

    Stretches double, so a few passes do; the last ``width - 1`` results cover less.
    """
    size = 1
    while size < width:
        step = min(size, width - size)
        shifted = F.slice(name, step + 1, F.size(name))
        frame = frame.withColumn(name, F.zip_with(name, shifted, lambda x, y: join(x, y)))
        size += step
    return frame


def with_runs(texts: DataFrame, length: int, name: str) -> DataFrame:
    """Add the runs of windows of ``length`` words that share a fingerprint.

    A run is (print, start, grams): its windows begin at words start, start + 1 and
    so on, and ``grams`` are the hashes of all grams in them.
    """
    width = min(GRAM, length)
    span = length - width + 1
    kept = texts.columns
    count = F.least(F.col("own"), F.size("words") - length + 1)
    nothing = F.array().cast("array<int>")
    places = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.col("_count") - 1)).otherwise(nothing)
    starts = F.filter("_places", lambda j: (j == 0) | (F.get("_least", j) != F.get("_least", j - 1)))

    def run(start: Column, i: Column) -> Column:
        after = F.coalesce(F.get("_starts", i + 1), F.col("_count"))
        return F.struct(
            F.get("_least", start).alias("print"),
            start.alias("start"),
            F.transform(F.sequence(start, after + (span - 2)), lambda k: F.get("_grams", k)).alias("grams"),
            F.lit(length).alias("length"),
        )

    hashed = texts.withColumn("_count", count).withColumn("_places", places)
    hashed = hashed.withColumn("_grams", F.transform("words", lambda word: F.xxhash64(F.lit(length), word)))
    hashed = over_windows(hashed, "_grams", width, F.xxhash64).withColumn("_least", F.col("_grams"))
    return (
        over_windows(hashed, "_least", span, F.least)
        .withColumn("_starts", starts)
        .withColumn(name, F.transform("_starts", run))
        .select(*kept, name)
    )


def in_run(length: Column) -> Column:
    """(offset, first, last) of the windows of a run: their place after its start and their two grams."""
    span = length - F.least(length, F.lit(GRAM)) + 1
    return F.transform(  # elements one by one: a slice would copy its whole array
        F.sequence(F.lit(0), F.size("grams") - span),
        lambda i: F.struct(
            i.alias("offset"),
            F.get("grams", i).alias("first"),
            F.get("grams", i + (span - 1)).alias("last"),
        ),
    )


def item_windows(items: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """(item_id, length, print, first, last) of every window of the items, and the window lengths there are."""
    cut = pieces(items, width, "item_id")
    totals = (
        cut.select("a", "b", "piece", "own").distinct().groupBy("a", "b").agg(F.sum("own").alias("total"))
    )
    sized = materialise(
        cut.join(totals.filter("total > 0"), ["a", "b"]).withColumn("size", F.least("total", F.lit(width))), "items"
    )
    lengths = sorted(row["size"] for row in sized.select("size").distinct().collect())  # at most ``width``
    found = items.sparkSession.createDataFrame(
        [], f"item_id {items.schema['item_id'].dataType.simpleString()}, length int, print bigint, first bigint, last bigint"
    )
    for length in lengths:
        runs = with_runs(sized.filter(F.col("size") == length), length, "runs")
        windows = runs.select("item_id", F.explode_outer("runs").alias("run")).select("item_id", "run.*").filter("start >= 0")
        found = found.unionByName(
            windows.select("item_id", "length", "print", F.explode_outer(in_run(F.lit(length))).alias("w"))
            .select("item_id", "length", "print", "w.first", "w.last")
        )
    return materialise(found.distinct(), "windows"), lengths


def marked(docs: DataFrame, prints: DataFrame, lengths: list[int], width: int) -> DataFrame:
    """(doc_id, a, b, piece, pieces, own, start, length, grams): runs of texts whose fingerprint an item has.

    Beside them one row for every piece, whose start is -1. Everything comes from
    one scan of the texts.
    """
    cut = pieces(docs, width, "doc_id")
    keys = [name for name in cut.columns if name != "words"]
    for length in lengths:
        cut = with_runs(cut, length, f"runs{length}")
    marker = F.array(
        F.struct(
            F.xxhash64("a", "piece").alias("print"),
            F.lit(-1).alias("start"),
            F.lit(None).cast("array<bigint>").alias("grams"),
            F.lit(0).alias("length"),
        )
    )
    runs = cut.select(*keys, F.explode_outer(F.concat(marker, *[f"runs{n}" for n in lengths])).alias("run"))
    few = prints.count() <= SENT
    known = prints.withColumn("known", F.lit(True))
    return (
        runs.select(*keys, "run.*")
        .join(F.broadcast(known) if few else known, "print", "left")
        .filter((F.col("start") < 0) | F.col("known"))
        .drop("print", "known")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of an item's window, ``item_ids``
    holds the sorted ids, as text, of the items with such windows.
    """
    windows, lengths = item_windows(items, width)
    found = materialise(marked(docs, windows.select("print").distinct(), lengths, width), "marked")
    heads = found.filter("start < 0")
    # Where the pieces of long texts begin, and how many words these texts have.
    later = heads.filter("pieces > 1").select("a", "b", "piece", "own").distinct()
    before = Window.partitionBy("a", "b").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = later.withColumn("begin", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    totals = later.groupBy("a", "b").agg(F.sum("own").alias("total"))

    named = windows.select("first", "last", "length").distinct()
    occurring = (
        found.filter("start >= 0")
        .select("a", "b", "piece", "start", "length", F.explode_outer(in_run(F.col("length"))).alias("w"))
        .select("a", "b", "piece", (F.col("start") + F.col("w.offset")).alias("at"), "length", "w.first", "w.last")
        .distinct()
        .join(named, ["first", "last", "length"], "left_semi")
        .join(begins, ["a", "b", "piece"], "left")
        .select("a", "b", (F.col("at") + F.coalesce("begin", F.lit(0))).alias("at"), "length", "first", "last")
    )
    occurring = materialise(occurring, "occurring")

    so_far = Window.partitionBy("a", "b").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    fresh = F.greatest(end - F.greatest(F.col("at"), F.coalesce("seen", F.lit(0))), F.lit(0))
    hits = (
        occurring.select("a", "b", "at", "length")
        .distinct()
        .withColumn("seen", F.max(end).over(so_far))
        .groupBy("a", "b")
        .agg(F.sum(fresh).alias("n_hit"))
    )

    # Windows of the same items are one class, so a text has about as many classes as items.
    lists = windows.groupBy("first", "last").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    classes = lists.withColumn("class", F.xxhash64("ids"))
    sets = (
        occurring.select("a", "b", "first", "last")
        .distinct()
        .join(classes.drop("ids"), ["first", "last"])
        .groupBy("a", "b")
        .agg(F.array_sort(F.collect_set("class")).alias("set"))
    )
    named_sets = (
        sets.select("set")
        .distinct()
        .select("set", F.explode_outer("set").alias("class"))
        .join(classes.select("class", "ids").dropDuplicates(["class"]), "class")
        .groupBy("set")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    )
    answers = hits.join(sets.join(named_sets, "set"), ["a", "b"]).select("a", "b", "n_hit", "item_ids")
    return (
        heads.filter("piece = 0")
        .join(totals, ["a", "b"], "left")
        .join(answers, ["a", "b"], "left")
        .select(
            "doc_id",
            F.coalesce("total", "own").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def contamination_digest(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``contamination`` with the SHA-256 of the comma-joined ids in place of their list."""
    joined = F.sha2(F.array_join("item_ids", ","), 256)
    return contamination(docs, items, width).select(
        "doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), "contaminated"
    )


def oracle(width: int = 10) -> str:
    """All windows of all texts, as SQL for the checking engine."""
    cut = f"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')""".replace("\\\\", "\\")
    return f"""
WITH item AS (SELECT item_id, {cut} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {width}) AS n FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
doc AS (SELECT row_number() OVER () AS row, doc_id, {cut} AS w FROM documents),
found AS (SELECT row, n, i, s FROM (
            SELECT row, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
            FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM doc, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n))
          WHERE s IN (SELECT s FROM windows)),
hits AS (SELECT row, count(*) AS n_hit
         FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS word FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM found JOIN windows USING (n, s)
                WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""
