"""Features of candidate pairs: scores, string and set similarity, ambiguity, competition, rank.

Pairs carry both records' columns with suffixes 1 (reference) and 2 (candidate).  Counts that depend
on other rows are windows or one grouped count joined by its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions.text import split_tokens
from kindred.operators.settle import settled

RECORD = ("name_norm", "name_core", "name_nospace", "is_domain", "name_nonlatin", "addr_norm", "addr_words", "addr_nums", "house_num", "addr_empty")
SCORES = ("cos_all", "cos_name", "cos_addr", "cos_namechar", "cos_emb")
UNKNOWN_IDF = 12.0
#: Records of the pool that a task holds at once, about.
BUCKET = 1 << 17

COMPETITION = ("cand_n_s1", "cand_best_cos", "cand_gap_cos", "cand_rank_cos", "cand_n_s1_name_hi", "s1_n_name_hi")
AMBIGUITY = ("s1_addr_dup", "s1_name_dup", "s1_name_addr_key_dup", "cand_name_n_s1", "src_is_s3")
CONTEXT = ("score0", "n_cands", "rank0", "margin0", "best0_gap")


def idf_table(records: DataFrame) -> DataFrame:
    """kind, token, idf = ln(n) - ln(df + 1) over all records of a split."""
    kinds = F.array(F.struct(F.lit("name").alias("kind"), F.col("name_core").alias("s")), F.struct(F.lit("addr").alias("kind"), F.col("addr_words").alias("s")))
    rows = records.select(F.explode(kinds).alias("k")).select("k.kind", F.explode(F.array_distinct(split_tokens(F.col("k.s")))).alias("token"))
    n = records.agg(F.count("*").alias("n"))  # a single row
    return rows.groupBy("kind", "token").agg(F.count("*").alias("df")).join(n).select("kind", "token", (F.log("n") - F.log(F.col("df") + 1)).alias("idf"))


def with_idf(records: DataFrame, idf: DataFrame) -> DataFrame:
    """Records with ``name_idf`` and ``addr_idf``: maps of their tokens' idf, by one join on the tokens."""
    for kind, column in (("name", "name_core"), ("addr", "addr_words")):
        tokens = records.select("entity_id", F.explode(F.array_distinct(split_tokens(F.col(column)))).alias("token"))
        got = tokens.join(idf.where(F.col("kind") == kind).select("token", "idf"), "token", "left").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(UNKNOWN_IDF))))).alias(f"{kind}_idf"))
        records = records.join(got, "entity_id", "left").withColumn(f"{kind}_idf", F.coalesce(f"{kind}_idf", F.expr("cast(map() as map<string,double>)")))
    return records


def joined(cands: DataFrame, reference: DataFrame, pool: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs with both records' columns, or those in ``only``; missing scores are 0. A candidate is looked up in the country of its entity.

    An entity's columns go once to each bucket of its country that has candidates of it, and not once for each
    pair.  Ids that repeat, and entities that the reference lacks, are joined pair by pair.
    """
    wanted = lambda c: c.endswith("_idf") or c in RECORD and (only is None or c in only)
    side = lambda df, key, n: df.select(F.col("entity_id").alias(key), "country", *(F.col(c).alias(f"{c}{n}") for c in df.columns if wanted(c)))
    one, two = side(reference, "s1_id", 1), side(pool, "cand_id", 2)
    present = [c for c in SCORES if c in cands.columns]
    scores = [c if c in present else F.lit(0.0).alias(c) for c in SCORES]
    pair = F.struct("cand_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in present))
    lists = settled(cands.groupBy("s1_id").agg(F.collect_list(pair).alias("x")).join(one, "s1_id", "left"), zipped=True)
    again = lists.groupBy("s1_id").agg((F.count("country") != 1).alias("odd")).where("odd")
    ids = pool.groupBy("entity_id").agg(F.count("country").alias("n"), F.count("*").alias("m"), F.first("country").alias("country"))
    sizes = settled(ids.groupBy("country").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"), F.max((F.col("n") != 1) | (F.col("m") != 1)).alias("odd")))
    texts = [c for c in one.columns if c.endswith("1")]
    if not sizes.where("odd").isEmpty() or not again.isEmpty():
        out = lists.select("s1_id", "country", *texts, F.inline("x")).join(two.drop("country"), "cand_id", "left")
    else:
        out = _met(lists, two, sizes, texts, present)
    return out.select("s1_id", "cand_id", *scores, "country", *texts, *(c for c in two.columns if c.endswith("2")))


def _met(lists: DataFrame, two: DataFrame, sizes: DataFrame, texts: list[str], present: list[str]) -> DataFrame:
    """Each entity's candidates with the columns of both, by buckets of a country: its records of the pool first, then the entities."""
    bucket = lambda c: F.coalesce(F.pmod(F.xxhash64(c), "buckets").cast("int"), F.lit(0))
    known = F.broadcast(sizes.select("country", "buckets"))  # a row for each country
    pairs = lists.join(known, "country", "left").withColumn("each", F.explode(F.array_distinct(F.transform("x", lambda x: bucket(x["cand_id"])))))
    mine = F.filter("x", lambda x: bucket(x["cand_id"]) == F.col("each"))
    pairs = pairs.select("country", F.col("each").alias("bucket"), F.lit(1).alias("side"), "s1_id", mine.alias("x"), *texts)
    theirs = two.join(known, "country").select("country", bucket("cand_id").alias("bucket"), F.lit(0).alias("side"), "cand_id", *(c for c in two.columns if c.endswith("2")))
    both = pairs.unionByName(theirs, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("bucket", "side", "x")]
    schema = both.select(*names).schema
    for c in present:
        schema = schema.add(c, "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at = None, [], {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            group = list(zip(*(t[c].to_pylist() for c in ("country", "bucket", "side")), strict=True))
            cuts = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]] + [len(group)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part, (*key, which) = t.slice(x, y - x), group[x]
                if key != now:
                    now, held, at, pool_rows = key, [], {}, None
                if which == 0:
                    at |= {c: len(at) + i for i, c in enumerate(part["cand_id"].to_pylist())}
                    held.append(part.select([c for c in part.column_names if c.endswith("2")]))
                    continue
                if pool_rows is None:
                    pool_rows = pa.concat_tables(held).combine_chunks() if held else part.slice(0, 0).select([c for c in part.column_names if c.endswith("2")])
                for z in range(0, part.num_rows, 512):
                    some = part.slice(z, 512).combine_chunks()
                    x_s = some["x"].combine_chunks()
                    flat = x_s.flatten()
                    row = pc.list_parent_indices(x_s)
                    ids = flat.field("cand_id")
                    rows, theirs_ = some.take(row), pool_rows.take(pa.array([at.get(c) for c in ids.to_pylist()], pa.int64()))
                    got = {c: rows[c] for c in names if not c.endswith("2")} | {c: theirs_[c] for c in names if c.endswith("2")} | {"cand_id": ids} | {c: flat.field(c) for c in present}
                    yield from pa.table({f.name: got[f.name] for f in schema.fields}).combine_chunks().to_batches()

    dealt = both.repartition("country", "bucket").sortWithinPartitions("country", "bucket", "side")
    return dealt.mapInArrow(each, schema)


def _sets(c: str) -> Column:
    return F.array_distinct(split_tokens(F.col(c)))


def set_features() -> dict[str, Column]:
    t1, t2, w1, w2, u1, u2 = (_sets(c) for c in ("name_core1", "name_core2", "addr_words1", "addr_words2", "addr_nums1", "addr_nums2"))
    x1, x2 = F.array_except(_sets("name_norm1"), t1), F.array_except(_sets("name_norm2"), t2)
    return {
        "name_jacc": S.jaccard(t1, t2), "name_inter": S.shared(t1, t2), "name_cov1": S.coverage(t1, t2, t1), "name_cov2": S.coverage(t1, t2, t2), "name_len1": F.size(t1), "name_len2": F.size(t2),
        "name_exact": (F.col("name_core1") == F.col("name_core2")).cast("int"),
        "name_first_eq": (F.coalesce(F.get(split_tokens(F.col("name_core1")), F.lit(0)) == F.get(split_tokens(F.col("name_core2")), F.lit(0)), F.lit(False))).cast("int"),
        "name_first_in": F.coalesce(F.array_contains(t1, F.get(split_tokens(F.col("name_core2")), F.lit(0))), F.lit(False)).cast("int"),
        "suffix_jacc": F.when((F.size(x1) == 0) & (F.size(x2) == 0), -1.0).otherwise(S.jaccard(x1, x2)),
        "cand_domain": F.col("is_domain2"), "cand_nonlatin": F.col("name_nonlatin2"), "s1_domain": F.col("is_domain1"), "addr_empty": F.col("addr_empty2"),
        "addr_words_jacc": S.jaccard(w1, w2), "addr_words_inter": S.shared(w1, w2), "addr_words_cov1": S.coverage(w1, w2, w1), "addr_words_cov2": S.coverage(w1, w2, w2),
        "addr_nums_jacc": S.jaccard(u1, u2), "addr_nums_inter": S.shared(u1, u2), "addr_nums_n1": F.size(u1), "addr_nums_n2": F.size(u2), "addr_len2": F.size(split_tokens(F.col("addr_norm2"))),
    }


def house_features() -> dict[str, Column]:
    h1, h2 = F.col("house_num1"), F.col("house_num2")
    both = (h1 != "") & (h2 != "")
    u1, u2 = _sets("addr_nums1"), _sets("addr_nums2")
    v1, v2 = F.array_except(u1, F.array(h1)), F.array_except(u2, F.array(h2))
    d1, d2 = (F.filter(F.array_except(a, b), lambda x: F.char_length(x) >= 2) for a, b in ((u1, u2), (u2, u1)))
    lev = F.when(both, F.levenshtein(h1, h2)).otherwise(-1)
    touch = F.startswith(h1, h2) | F.startswith(h2, h1) | F.endswith(h1, h2) | F.endswith(h2, h1)
    return {
        "house_eq": (both & (h1 == h2)).cast("int"), "house_both": both.cast("int"), "house_in_nums": ((h1 != "") & F.array_contains(u2, h1)).cast("int"),
        "house_lev": lev, "house_one_edit": (lev == 1).cast("int"), "house_prefix": (both & (h1 != h2) & touch).cast("int"), "house_neq": (both & (h1 != h2)).cast("int"),
        "sec_nums_inter": S.shared(v1, v2), "sec_nums_jacc": S.jaccard(v1, v2),
        "nums_near": F.size(F.filter(d1, lambda x: F.exists(d2, lambda y: F.levenshtein(x, y) <= 1))),
    }


def ratio_features() -> dict[str, Column]:
    c = F.col
    filled = lambda x, y, e: F.when((c(x) == "") | (c(y) == ""), 0.0).otherwise(e)
    return {
        "name_ratio": S.ratio(c("name_core1"), c("name_core2")), "name_tsort": S.token_sort_ratio(split_tokens(c("name_core1")), split_tokens(c("name_core2"))),
        "name_ns_ratio": S.ratio(c("name_nospace1"), c("name_nospace2")), "nums_ratio": filled("addr_nums1", "addr_nums2", S.ratio(c("addr_nums1"), c("addr_nums2"))),
    }


def arrow_features() -> dict[str, Column]:
    c = F.col
    filled = lambda e: F.when((c("addr_norm1") == "") | (c("addr_norm2") == ""), 0.0).otherwise(e)
    return {
        "name_tsr": S.token_set_ratio(c("name_core1"), c("name_core2")), "addr_tsr": S.token_set_ratio(c("addr_norm1"), c("addr_norm2")), "addr_ratio": filled(S.ratio(c("addr_norm1"), c("addr_norm2"))),
        "name_partial": S.partial_ratio(c("name_core1"), c("name_core2")), "name_ns_partial": S.partial_ratio(c("name_nospace1"), c("name_nospace2")),
        "addr_partial": S.partial_ratio(c("addr_norm1"), c("addr_norm2")), "name_jw": S.jaro_winkler(c("name_core1"), c("name_core2")),
    }


def _weighted(kind: str, c: str) -> dict[str, Column]:
    a, b = _sets(f"{c}1"), _sets(f"{c}2")
    known = lambda t: F.coalesce(F.col(f"{kind}_idf1")[t], F.col(f"{kind}_idf2")[t], F.lit(UNKNOWN_IDF))
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, t: acc + known(t))
    most = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, t: F.greatest(acc, known(t)))
    both, every = F.array_intersect(a, b), F.array_union(a, b)
    return {f"{kind}_widf_jacc": F.coalesce(F.try_divide(total(both), total(every)), F.lit(0.0)), f"{kind}_shared_maxidf": most(both), f"{kind}_unshared_maxidf": most(F.array_except(every, both))}


def idf_features() -> dict[str, Column]:
    known = lambda t: F.coalesce(F.col("name_idf2")[t], F.lit(UNKNOWN_IDF))
    return _weighted("name", "name_core") | {"name2_idf_sum": F.aggregate(_sets("name_core2"), F.lit(0.0), lambda acc, t: acc + known(t))} | _weighted("addr", "addr_words")


def competition(cands: DataFrame) -> DataFrame:
    """Windows over the whole candidate table: how contested a candidate and how sure an entity's names are."""
    cand, s1 = Window.partitionBy("cand_id"), Window.partitionBy("s1_id")
    best = F.max("cos_all").over(cand)
    return cands.withColumns({
        "cand_n_s1": F.count("*").over(cand), "cand_best_cos": best, "cand_gap_cos": best - F.col("cos_all"), "cand_rank_cos": F.row_number().over(cand.orderBy(F.desc("cos_all"), "s1_id")),
        "cand_n_s1_name_hi": F.count_if(F.col("cos_name") >= 0.7).over(cand), "s1_n_name_hi": F.count_if(F.col("cos_name") >= 0.9).over(s1),
    })


def ambiguity(reference: DataFrame) -> DataFrame:
    """s1_id with the numbers of reference records that share address, name, and name and house number (empty ones are ordinary keys)."""
    count = lambda *k: F.count("*").over(Window.partitionBy("country", *k))
    return reference.select(F.col("entity_id").alias("s1_id"), count("addr_norm").alias("s1_addr_dup"), count("name_core").alias("s1_name_dup"), count("name_core", "house_num").alias("s1_name_addr_key_dup"))


def name_owners(pool: DataFrame, reference: DataFrame) -> DataFrame:
    """cand_id, cand_name_n_s1: reference records with the candidate's name in its country; and whether it is of source 3."""
    names = reference.groupBy("country", "name_core").agg(F.count("*").alias("n"))
    return pool.select(F.col("entity_id").alias("cand_id"), "country", "name_core").join(names, ["country", "name_core"], "left").select("cand_id", F.coalesce("n", F.lit(0)).alias("cand_name_n_s1"), F.startswith("cand_id", F.lit("S3-")).cast("int").alias("src_is_s3"))


def context(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """score0 and an entity's ranking by it; needs name_tsr, addr_tsr, cos_all and house_eq. The weights sum to 1.1."""
    s1 = Window.partitionBy("s1_id")
    order = s1.orderBy(F.desc("score0"), "cand_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    score = 0.4 * F.col("name_tsr") / 100 + 0.3 * F.col("addr_tsr") / 100 + 0.3 * F.col("cos_all") + 0.1 * F.col("house_eq")
    best = F.max("score0").over(s1)
    return pairs.withColumn("score0", F.round(score, digits)).withColumns({
        "n_cands": F.count("*").over(s1), "rank0": F.row_number().over(order), "margin0": F.round(best - F.col("score0"), digits), "best0_gap": F.round(F.coalesce(best - F.nth_value("score0", 2).over(whole), F.lit(1.0)), digits),
    })


def build(cands: DataFrame, reference: DataFrame, pool: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The whole feature table: s1_id, cand_id, 72 features, and label if the truth is given."""
    idf = idf_table(reference.unionByName(pool))
    cands = cands.select("s1_id", "cand_id", *(F.coalesce(c, F.lit(0.0)).alias(c) if c in cands.columns else F.lit(0.0).alias(c) for c in SCORES))
    pairs = joined(cands, with_idf(reference, idf), with_idf(pool, idf))
    groups = set_features() | house_features() | ratio_features() | idf_features()
    pairs = pairs.withColumns(groups).withColumns(arrow_features())
    own = competition(cands).select("s1_id", "cand_id", *COMPETITION)
    pairs = pairs.join(own, ["s1_id", "cand_id"]).join(ambiguity(reference), "s1_id", "left").join(name_owners(pool, reference), "cand_id", "left")
    pairs = context(pairs)
    names = [*SCORES, *groups, *arrow_features(), *COMPETITION, *AMBIGUITY, *CONTEXT]
    out = pairs.select("s1_id", "cand_id", *(F.col(c).cast("double").alias(c) for c in names))
    if truth is not None:
        out = out.join(truth.select("s1_id", "cand_id", F.lit(1).alias("label")), ["s1_id", "cand_id"], "left").fillna(0, ["label"])
    return out
