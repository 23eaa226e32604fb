"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of both tables become codes: 37 bits of the hash of ``gram`` consecutive words above 27 bits of
their place.  The least code of each run of ``window - gram + 1`` codes is kept (winnowing), so two
texts that share ``window`` consecutive words keep a common hash there.  Training and benchmark
fingerprints are joined, each hit is extended to the windows around it, and those are compared word
for word with the item's, so hash collisions never count.

The benchmark's fingerprints and windows are broadcast where their counted rows are at most ``small``:
then the documents are read once and only hits are shuffled.  Beyond that the documents' codes are
shuffled without their words, what they meet is gathered by document and joined to the texts once, and
the windows around hits are joined by their words.  Both plans give the same rows.

Items of fewer words than ``window`` are one window each, looked up at every place.  Null texts have
no words.  A very long text is one array of words in one task.  Rows without a doc_id, and items without an id, are left out; rows that repeat both doc_id
and text give one row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = (1 << 27) - 1
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, UNDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; other letters stay as they are."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UNDER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), APART), "")


def _codes(n: int) -> Column:
    """Codes of all runs of n words; the hash depends on n."""
    at = lambda i: F.xxhash64(F.lit(n), F.slice("words", i, n)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))
    return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), at)).otherwise(F.array().cast("array<long>"))


def _fingerprints(rows: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """Adds words and codes (winnowed ones, and all of the lengths in ``short``)."""
    run = window - gram + 1
    rows = rows.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("all", _codes(gram))
    least = F.transform(F.sequence(F.lit(1), F.size("all") - (run - 1)), lambda j: F.array_min(F.slice("all", j, run)))
    rows = rows.withColumn("codes", F.when(F.size("all") >= run, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))).drop("all")
    return rows.withColumn("codes", F.concat("codes", *(_codes(m) for m in short))) if short else rows


def hits(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5, small: int = 200_000) -> DataFrame:
    """doc_id, text_hash, n_words, and for each hit item_id, first, last (words, from 1); a row without item for each document."""
    bench = bench.where("item_id is not null").select("item_id", "text")
    sized = bench.withColumn("words", words_of(F.col("text"))).withColumn("m", F.least(F.size("words"), F.lit(window))).where("m > 0")
    short = sorted(r.m for r in sized.select("m").distinct().collect() if r.m < window)  # at most window - 1 values
    places = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    windows = sized.select("item_id", "words", "m", F.explode(places).alias("s")).select("item_id", "m", F.array_join(F.slice("words", F.col("s"), F.col("m")), " ").alias("run")).distinct()
    marks = _fingerprints(sized.where(F.col("m") == window).select("item_id", "text"), window, gram, []).select(F.explode("codes").alias("c"), F.lit(window).alias("m"))
    for n in short:
        marks = marks.unionByName(sized.where(F.col("m") == n).withColumn("codes", _codes(n)).select(F.explode("codes").alias("c"), F.lit(n).alias("m")))
    marks = marks.select(F.shiftright("c", 27).alias("mark"), "m").distinct()
    fits = max(marks.count(), windows.count()) <= small

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    none = F.lit(None).cast("long")
    if fits:
        rows = _fingerprints(rows, window, gram, short).select("doc_id", "text_hash", "words", F.explode(F.array_append("codes", none)).alias("c"))
        rows = rows.withColumn("mark", F.shiftright("c", 27)).join(F.broadcast(marks), "mark", "left")
    else:  # codes travel without their texts, which meet what was found for them again
        codes = _fingerprints(rows, window, gram, short).select("doc_id", "text_hash", F.explode("codes").alias("c")).withColumn("mark", F.shiftright("c", 27))
        met = codes.join(marks, "mark").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("c", "m")).alias("met"))
        rows = rows.join(met, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", words_of(F.col("text")).alias("words"), "met")
        blank = F.struct(none.alias("c"), F.lit(None).cast("int").alias("m"))
        rows = rows.select("doc_id", "text_hash", "words", F.explode(F.array_append(F.coalesce("met", F.array().cast("array<struct<c:bigint,m:int>>")), blank)).alias("x")).select("doc_id", "text_hash", "words", "x.c", "x.m")
    # a code of a short length may meet a long item's mark in a document that has no whole window
    rows = rows.where(F.col("c").isNull() | (F.col("m") <= F.size("words")))
    place = F.col("c").bitwiseAND(F.lit(PLACE)).cast("int")
    low = F.when(F.col("m") == window, F.greatest(F.lit(1), place - (window - gram))).otherwise(place)
    high = F.when(F.col("m") == window, F.least(place, F.size("words") - (window - 1))).otherwise(place)
    rows = rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), "m", low.alias("low"), high.alias("high"), F.when(F.col("m").isNotNull(), F.slice("words", low, high - low + F.col("m"))).alias("near"))
    found = rows.select("doc_id", "text_hash", "n_words", "m", "low", "near", F.explode(F.when(F.col("m").isNotNull(), F.sequence("low", "high")).otherwise(F.array(F.lit(0)))).alias("first"))
    found = found.select("doc_id", "text_hash", "n_words", "m", "first", F.array_join(F.slice("near", F.col("first") - F.col("low") + 1, F.col("m")), " ").alias("run"))
    found = found.join(F.broadcast(windows) if fits else windows, ["m", "run"], "left").where("item_id is not null or first = 0")
    return found.select("doc_id", "text_hash", "n_words", "item_id", "first", (F.col("first") + F.col("m") - 1).alias("last"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5, small: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), spans (sorted [first, last] of hit windows), contaminated."""
    spans = F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("first", "last"))))
    rows = hits(docs, bench, window, gram, small).groupBy("doc_id", "text_hash", "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a.reach, x.last).alias("reach"), (a.n + F.greatest(F.lit(0), x.last - F.greatest(x.first - 1, a.reach))).alias("n"))
    hit = F.aggregate("spans", none, step, lambda a: a.n)
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("items") > 0).alias("contaminated"))
