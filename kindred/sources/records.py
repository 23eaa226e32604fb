"""Readers, writers and stand-in views.

A record has entity_id, business_name, business_address and country, all text and never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header and no quoting."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False, encoding="UTF-8")
    return raw.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS))


def read_split(spark: SparkSession, folder: str, split: str, ext: str = "tsv") -> tuple[DataFrame, DataFrame]:
    """(reference records, pool of sources 2 and 3)."""
    one, two, three = (read_source(spark, f"{folder}/{split}_source{i}.{ext}") for i in (1, 2, 3))
    return one, two.unionByName(three)


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((s1_id, cand_id) pairs, (s1_id) of all entities, those without a match included)."""
    schema = "s1_id string, ids string"
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema).withColumn("ids", F.coalesce("ids", F.lit("")))
    pairs = rows.select("s1_id", F.explode(F.array_remove(F.transform(F.split("ids", ","), F.trim), "")).alias("cand_id")).distinct()
    return pairs, rows.select("s1_id").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Different values of a file's first column, without header and blank lines."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t")[0].alias("id"))
    return lines.where(~F.col("id").isin("entity_id", "source1_entity_id")).distinct()


def id_lists(ids: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """One row for each s1_id of ``ids`` with its list as text: without repeats, and only ids of the pool's sources."""
    allowed = F.filter(F.array_distinct(F.col("ids")), lambda x: x.startswith("S2-") | x.startswith("S3-"))
    rows = ids.join(lists, "s1_id", "left")
    return rows.select(*[c for c in ids.columns if c != "s1_id"], F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join(allowed, ","), F.lit("")).alias(column))


def write_id_lists(rows: DataFrame, path: str, order: str = "source1_entity_id") -> None:
    """A tab-separated file (the output format asks for a single one) in the order of a column."""
    columns = [c for c in rows.columns if c != "pos"]
    rows.orderBy(order).select(columns).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents_as_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents: the whole text as name, language as country; sources 0 to 2 are the reference."""
    side = F.when(F.col("source").isin("src0", "src1", "src2"), "S1-").when(F.col("doc_id") % 2 == 0, "S2-").otherwise("S3-")
    return table(spark, folder, "documents").select(F.concat(side, F.col("doc_id").cast("string")).alias("entity_id"), F.col("text").alias("business_name"), F.lit("").alias("business_address"), F.col("lang").alias("country"))


def parts_as_records(spark: SparkSession, folder: str) -> DataFrame:
    """Parts: few different names, addresses with house numbers, type as country."""
    key = F.col("p_partkey").cast("string")
    side = F.concat(F.lit("S"), (F.lit(1) + F.col("p_partkey") % 3).cast("string"), F.lit("-"))
    address = F.concat(F.lit("No. "), (F.col("p_partkey") % 40 + 1).cast("string"), F.lit(", "), F.col("p_brand"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit(" St"))
    return table(spark, folder, "part").select(F.concat(side, key).alias("entity_id"), F.concat(F.col("p_name"), F.lit(" Pvt. Ltd.")).alias("business_name"), address.alias("business_address"), F.col("p_type").alias("country"))


def companies_as_records(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as reference, customers as pool; country by nation."""
    nation = F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_name"))  # one row for each nation
    s = table(spark, folder, "supplier").select(F.concat(F.lit("S1-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("business_name"), F.col("s_nationkey").alias("n_nationkey"))
    c = table(spark, folder, "customer").select(F.concat(F.lit("S2-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("business_name"), F.col("c_nationkey").alias("n_nationkey"))
    return s.unionByName(c).join(nation, "n_nationkey").select("entity_id", "business_name", F.lit("").alias("business_address"), F.col("n_name").alias("country"))


def hosts_as_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pages: the last two labels of the host as name."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    return table(spark, folder, "pages").select(F.concat(F.lit("S2-"), F.col("page_id").cast("string")).alias("entity_id"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("business_name"), F.lit("").alias("business_address"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("country"))


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference, pool) by the prefix of the id."""
    one = F.substring("entity_id", 1, 2) == "S1"
    return records.where(one), records.where(~one)
