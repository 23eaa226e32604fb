"""All registered queries of the linkage engine, each beside its SQL.

Where scores take part in ranking or output they are rounded first, so that the order of a sum can't
change a result; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.functions.text import normalise, split_tokens
from kindred.operators import candidates, check, consistency, decide, dense, features, learn, metrics, tokenmap
from kindred.operators.settle import settled
from kindred.plans import sql, views
from kindred.sources import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


REC = f"with rec as ({sql.norm(sql.DOC)}),\n"
PREC = f"with rec as ({sql.norm(sql.PART)}),\n"


@query(f"""select substring(entity_id, 1, 2) as src, country, count(*)::bigint as n, count(distinct business_name)::bigint as names
from (({sql.DOC}) union all ({sql.PART}) union all ({sql.COMPANY})) group by 1, 2""")
def src_union_split(spark: SparkSession, d: str) -> DataFrame:
    every = R.documents_as_records(spark, d).unionByName(R.parts_as_records(spark, d)).unionByName(R.companies_as_records(spark, d))
    one, pool = R.sides(every)
    return one.unionByName(pool).groupBy(F.substring("entity_id", 1, 2).alias("src"), "country").agg(F.count("*").alias("n"), F.countDistinct("business_name").alias("names"))


NAMES = ["entity_id", "name_norm", "name_core", "name_nospace", "is_domain", "name_nonlatin"]


@query(f"select {', '.join(NAMES)} from ({sql.norm(f'({sql.DOC}) union all ({sql.PART}) union all ({sql.COMPANY})')})")
def norm_name(spark: SparkSession, d: str) -> DataFrame:
    every = R.documents_as_records(spark, d).unionByName(R.parts_as_records(spark, d)).unionByName(R.companies_as_records(spark, d))
    return normalise(every).select(*NAMES)


ADDRESSES = ["entity_id", "addr_norm", "addr_words", "addr_nums", "house_num", "addr_empty"]


@query(f"select {', '.join(ADDRESSES)} from ({sql.norm(f'({sql.PART}) union all ({sql.COMPANY})')})")
def norm_address(spark: SparkSession, d: str) -> DataFrame:
    return normalise(R.parts_as_records(spark, d).unionByName(R.companies_as_records(spark, d))).select(*ADDRESSES)


@query(f"select {', '.join(NAMES)} from ({sql.norm(sql.HOST)})")
def norm_domain(spark: SparkSession, d: str) -> DataFrame:
    return normalise(R.hosts_as_records(spark, d)).select(*NAMES)


def _text_pairs(spark: SparkSession, d: str, least: float) -> DataFrame:
    """a, b: names of pairs of documents whose cosine says they are versions of one text, of equal numbers of tokens: only these align."""
    one, pool = views.documents(spark, d)
    sides = [(x.select(F.col("entity_id").alias(key), F.col("name_norm").alias(name)), F.size(split_tokens(F.col(name))).alias("n")) for x, key, name in ((one, "s1_id", "a"), (pool, "cand_id", "b"))]
    pairs = views.scored(spark, d).where(F.col("prob") >= least).select("s1_id", "cand_id")
    # numbers first, so that only texts of pairs that align are shuffled
    (a, n), (b, m) = sides
    pairs = settled(pairs.join(a.select("s1_id", n), "s1_id").join(b.select("cand_id", m), ["cand_id", "n"]).select("s1_id", "cand_id"))
    return pairs.join(a, "s1_id").join(b, "cand_id").select("a", "b")


PAIRS = sql.SCORED + "pairs as (select a.name_norm as a, b.name_norm as b from scored join rec a on s1_id = a.entity_id join rec b on cand_id = b.entity_id where prob >= {least}),\n"


#: Suppliers and customers of one number, under names that stand for each other.
ALIKE = """with pairs as (select case s_suppkey % 4 when 0 then 'supplier' when 1 then 'trading house' else 'vendor' end || ' ' || s_suppkey as a,
 case s_suppkey % 4 when 0 then 'suppl' when 1 then 'th' else 'vndr' end || ' ' || c_custkey as b from supplier join customer on s_suppkey = c_custkey),
"""


@query(ALIKE + """d as (select la, list_filter(list_distinct(la), lambda t: not list_contains(lb, t)) as da, list_filter(list_distinct(lb), lambda t: not list_contains(la, t)) as db
 from (select list_filter(str_split(a, ' '), lambda t: t <> '') as la, list_filter(str_split(b, ' '), lambda t: t <> '') as lb from pairs)),
e as (select * from d where len(da) between 1 and 2 and len(db) between 1 and 2),
na as (select x, count(*) as na from (select unnest(da) as x from e) group by x), nb as (select y, count(*) as nb from (select unnest(db) as y from e) group by y),
uses as (select t, count(*) as n from (select unnest(list_distinct(la)) as t from d) group by t),
two0 as (select db[1] as y, array_to_string(list_filter(la, lambda t: list_contains(da, t)), ' ') as x, count(*) as c from e where len(db) = 1 and len(da) = 2 group by 1, 2),
two as (select y, x, c from (select *, row_number() over (partition by y order by c desc, x) as r from two0 join nb using (y) where c >= 2 and not regexp_full_match(y, '[0-9]+') and length(y) >= 2 and c / nb >= 0.05) where r = 1),
one0 as (select db[1] as y, da[1] as x, count(*) as c from e where len(db) = 1 and len(da) = 1 group by 1, 2),
one1 as (select *, row_number() over (partition by y order by c desc, x) as r from one0 join nb using (y) join na using (x) where c >= 2 and not regexp_full_match(y, '[0-9]+') and not regexp_full_match(x, '[0-9]+')
 and length(x) >= 2 and length(y) >= 2 and c / nb >= 0.05 and c / na >= 0.05 and y not in (select y from two)),
one2 as (select o.y, o.x, o.c, coalesce(u.n, 0) > coalesce(v.n, 0) as turned from one1 o left join uses u on u.t = o.y left join uses v on v.t = o.x where r = 1 and o.x not in (select y from two)),
both_ as (select y, x, c from two union all select case when turned then x else y end, case when turned then y else x end, c from one2)
select y, x, c::bigint as c from (select *, row_number() over (partition by y order by c desc, x) as r from both_) where r = 1""")
def tokenmap_mine_pairs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    named = lambda x, y, z: F.concat(F.when(key % 4 == 0, x).when(key % 4 == 1, y).otherwise(z), F.lit(" "), key.cast("string"))
    rows = R.table(spark, d, "supplier").join(R.table(spark, d, "customer"), key == F.col("c_custkey"))
    return tokenmap.mine(rows.select(named("supplier", "trading house", "vendor").alias("a"), named("suppl", "th", "vndr").alias("b")), least=2, share=0.05, most=2, back=0.05)


@query(PAIRS.replace("{least}", "0.06") + """z as (select unnest(la) as x, unnest(lb) as y from (select list_filter(str_split(a, ' '), lambda t: t <> '') as la, list_filter(str_split(b, ' '), lambda t: t <> '') as lb from pairs) where len(la) = len(lb)),
c as (select y, x, count(*) as c from z where x <> y group by 1, 2), n as (select *, sum(c) over (partition by y) as nb from c)
select y, x, c::bigint as c from (select *, row_number() over (partition by y order by c desc, x) as r from n where c >= 2 and length(y) >= 3 and not regexp_full_match(y, '[0-9]+') and not regexp_full_match(x, '[0-9]+') and c / nb >= 0.1) where r = 1""")
def tokenmap_mine_aligned(spark: SparkSession, d: str) -> DataFrame:
    return tokenmap.mine_aligned(_text_pairs(spark, d, 0.06), least=2, share=0.1)


MAPS = {"addr": {"brand": "make", "standard": "usual size", "promo": "offer"}, "name": {"red": "rouge"}}


@query(PREC + """m as (select map(['brand','standard','promo'], ['make','usual size','offer']) as m)
select entity_id, name_norm, name_core, name_nospace, array_to_string(list_transform(str_split(addr_norm, ' '), lambda t: coalesce(m[t], t)), ' ') as addr_norm,
 array_to_string(list_transform(str_split(addr_words, ' '), lambda t: coalesce(m[t], t)), ' ') as addr_words, addr_nums, house_num from rec, m""")
def tokenmap_apply(spark: SparkSession, d: str) -> DataFrame:
    out = tokenmap.apply(normalise(R.parts_as_records(spark, d)), MAPS)
    return out.select("entity_id", "name_norm", "name_core", "name_nospace", "addr_norm", "addr_words", "addr_nums", "house_num")


@query(PREC + """t as (select distinct 'name' as kind, entity_id, unnest(list_filter(str_split(name_core, ' '), lambda x: x <> '')) as token from rec
 union all select distinct 'addr', entity_id, unnest(list_filter(str_split(addr_words, ' '), lambda x: x <> '')) from rec)
select kind, token, round(ln((select count(*) from rec)) - ln(count(*) + 1), 6) as idf from t group by 1, 2""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.idf_table(normalise(R.parts_as_records(spark, d))))


def _channel(spark: SparkSession, d: str, name: str, most: float = views.MOST, source=views.documents) -> DataFrame:
    one, pool = source(spark, d)
    return candidates.topk(one, pool, candidates.channels(most, most)[name])


@query(REC + f"c as ({sql.topk('rec', sql.ALL, 15, 0.1, name='cos_all')}) select * from c")
def blk_all_topk(spark: SparkSession, d: str) -> DataFrame:
    return _channel(spark, d, "all")


@query(REC + f"c as ({sql.topk('rec', 'name_core', 6, 0.1, name='cos_name')}) select * from c")
def blk_name_topk(spark: SparkSession, d: str) -> DataFrame:
    return _channel(spark, d, "name")


@query(PREC + f"c as ({sql.topk('rec', sql.ADDR, 8, 0.5, name='cos_addr')}) select * from c")
def blk_addr_topk(spark: SparkSession, d: str) -> DataFrame:
    return _channel(spark, d, "addr", 0.5, views.parts)


HOSTS = f"""with rec as ({sql.norm("""select case when page_id % 3 = 0 then 'S1-' else 'S2-' end || page_id as entity_id, regexp_extract(url, '([^./]+)[.]example[.]', 1) || '.com' as business_name,
 '' as business_address, 'web' as country from pages""")}),\n"""


def _hosts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    side = F.when(F.col("page_id") % 3 == 0, "S1-").otherwise("S2-")
    name = F.concat(F.regexp_extract("url", r"([^./]+)[.]example[.]", 1), F.lit(".com"))
    rows = R.table(spark, d, "pages").select(F.concat(side, F.col("page_id").cast("string")).alias("entity_id"), name.alias("business_name"), F.lit("").alias("business_address"), F.lit("web").alias("country"))
    return R.sides(normalise(rows))


@query(HOSTS + f"c as ({sql.topk('rec', 'name_nospace', 8, 0.5, chars=True, pool=sql.ODD, name='cos_namechar')}) select * from c")
def blk_char3_topk(spark: SparkSession, d: str) -> DataFrame:
    return _channel(spark, d, "namechar", 0.5, _hosts)


@query(PREC + f"""a as ({sql.topk('rec', sql.ALL, 15, 0.5, name='cos_all')}), n as ({sql.topk('rec', 'name_core', 6, 0.5, name='cos_name')}),
b as ({sql.topk('rec', sql.ADDR, 8, 0.5, name='cos_addr')}), c as ({sql.topk('rec', 'name_nospace', 8, 0.5, chars=True, pool=sql.ODD, name='cos_namechar')})
select coalesce(a.s1_id, n.s1_id, b.s1_id, c.s1_id) as s1_id, coalesce(a.cand_id, n.cand_id, b.cand_id, c.cand_id) as cand_id, coalesce(cos_addr, 0.0)::double as cos_addr, coalesce(cos_all, 0.0)::double as cos_all,
 coalesce(cos_name, 0.0)::double as cos_name, coalesce(cos_namechar, 0.0)::double as cos_namechar
from a full join n on a.s1_id = n.s1_id and a.cand_id = n.cand_id full join b on coalesce(a.s1_id, n.s1_id) = b.s1_id and coalesce(a.cand_id, n.cand_id) = b.cand_id
 full join c on coalesce(a.s1_id, n.s1_id, b.s1_id) = c.s1_id and coalesce(a.cand_id, n.cand_id, b.cand_id) = c.cand_id""")
def blk_union(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    return candidates.block(one, pool, candidates.channels(0.5, 0.5))


DENSE = """with v as (select case when vec_id % 5 = 0 then 'S1-' else 'S2-' end || vec_id as id, label, embedding::double[] as e from embeddings),
s as (select q.id as s1_id, p.id as cand_id, round(list_dot_product(q.e, p.e), 5) as cos_emb from v q join v p using (label) where q.id like 'S1%' and p.id like 'S2%'),
dense as (select s1_id, cand_id, cos_emb from (select *, row_number() over (partition by s1_id order by cos_emb desc, cand_id) as r from s) where r <= 3 or (r <= 6 and cos_emb >= 0.93))
"""


@query(DENSE + "select * from dense")
def dense_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    return dense.exact(*views.vectors(spark, d))


@query()
def dense_topk_cells(spark: SparkSession, d: str) -> DataFrame:
    return dense.cells(*views.vectors(spark, d))


@query(DENSE + """, old as (select s1_id, cand_id, round(cos_emb / 2, 6) as cos_all from dense where cos_emb >= 0.3 union all select s1_id, 'S3-0', 0.5 from (select distinct s1_id from dense))
select coalesce(d.s1_id, o.s1_id) as s1_id, coalesce(d.cand_id, o.cand_id) as cand_id, coalesce(cos_all, 0.0)::double as cos_all, coalesce(cos_emb, 0.0)::double as cos_emb
from dense d full join old o on d.s1_id = o.s1_id and d.cand_id = o.cand_id""")
def dense_merge(spark: SparkSession, d: str) -> DataFrame:
    top = dense.exact(*views.vectors(spark, d))
    old = top.where("cos_emb >= 0.3").select("s1_id", "cand_id", F.round(F.col("cos_emb") / 2, 6).alias("cos_all"), F.lit(0.1).alias("cos_emb"))
    old = old.unionByName(top.select("s1_id", F.lit("S3-0").alias("cand_id"), F.lit(0.5).alias("cos_all"), F.lit(0.1).alias("cos_emb")).distinct())
    return dense.merge(old, top).select("s1_id", "cand_id", "cos_all", "cos_emb")


@query(sql.SCORED + sql.TRUTH + """hit as (select t.*, prob from truth t left join scored s using (s1_id, cand_id))
select round((select count(prob) from hit) / greatest(1, (select count(*) from hit)), 6) as pair_recall, round((select count(*) from scored) / greatest(1, (select count(*) from ents)), 6) as cands_per_s1,
 round((select count(*) from hit where prob > 0) / greatest(1, (select count(*) from hit)), 6) as recall_cos_all""")
def cand_recall(spark: SparkSession, d: str) -> DataFrame:
    true, ids = views.truth(spark, d)
    return rounded(candidates.recall(views.scored(spark, d).withColumnRenamed("prob", "cos_all"), true, ids))


PPAIRS = PREC + f"""c as ({sql.topk('rec', sql.ADDR, 8, 0.5, name='cos_addr')}),
lists as (select *, list_distinct(list_filter(str_split(name_core, ' '), lambda x: x <> '')) as t, list_distinct(list_filter(str_split(name_norm, ' '), lambda x: x <> '')) as tn,
 list_distinct(list_filter(str_split(addr_words, ' '), lambda x: x <> '')) as w, list_distinct(list_filter(str_split(addr_nums, ' '), lambda x: x <> '')) as u from rec),
j as (select c.s1_id, c.cand_id, c.cos_addr, a.name_core as nc1, b.name_core as nc2, a.name_nospace as ns1, b.name_nospace as ns2, a.addr_norm as an1, b.addr_norm as an2, a.addr_nums as nu1, b.addr_nums as nu2, a.house_num as h1, b.house_num as h2,
 a.t as t1, b.t as t2, a.tn as tn1, b.tn as tn2, a.w as w1, b.w as w2, a.u as u1, b.u as u2, a.is_domain as d1, b.is_domain as d2, b.name_nonlatin as l2, b.addr_empty as e2, a.country
 from c join lists a on c.s1_id = a.entity_id join lists b on c.cand_id = b.entity_id)
"""


def _inter(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: list_contains({b}, x)))"


def _jacc(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) = 0 then 0.0::double else {_inter(a, b)} / (len({a}) + len({b}) - {_inter(a, b)}) end)"


def _minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: not list_contains({b}, x))"


@query(PPAIRS + f"""select s1_id, cand_id, round({_jacc('t1', 't2')}, 6) as name_jacc, {_inter('t1', 't2')}::int as name_inter, round({_inter('t1', 't2')} / greatest(1, len(t1)), 6) as name_cov1, round({_inter('t1', 't2')} / greatest(1, len(t2)), 6) as name_cov2,
 len(t1)::int as name_len1, len(t2)::int as name_len2, (nc1 = nc2)::int as name_exact, coalesce(t1[1] = t2[1], false)::int as name_first_eq, coalesce(list_contains(t1, t2[1]), false)::int as name_first_in,
 round(case when len({_minus('tn1', 't1')}) = 0 and len({_minus('tn2', 't2')}) = 0 then -1.0::double else {_jacc(_minus('tn1', 't1'), _minus('tn2', 't2'))} end, 6) as suffix_jacc,
 d2 as cand_domain, l2 as cand_nonlatin, d1 as s1_domain, e2 as addr_empty, round({_jacc('w1', 'w2')}, 6) as addr_words_jacc, {_inter('w1', 'w2')}::int as addr_words_inter, round({_inter('w1', 'w2')} / greatest(1, len(w1)), 6) as addr_words_cov1,
 round({_inter('w1', 'w2')} / greatest(1, len(w2)), 6) as addr_words_cov2, round({_jacc('u1', 'u2')}, 6) as addr_nums_jacc, {_inter('u1', 'u2')}::int as addr_nums_inter, len(u1)::int as addr_nums_n1, len(u2)::int as addr_nums_n2,
 len(list_filter(str_split(an2, ' '), lambda x: x <> ''))::int as addr_len2 from j""".replace("t1[1] = t2[1]", "list_filter(str_split(nc1, ' '), lambda x: x <> '')[1] = list_filter(str_split(nc2, ' '), lambda x: x <> '')[1]").replace("list_contains(t1, t2[1])", "list_contains(t1, list_filter(str_split(nc2, ' '), lambda x: x <> '')[1])"))
def feat_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.part_pairs(spark, d, "name_core", "name_norm", "addr_words", "addr_nums", "addr_norm", "is_domain", "name_nonlatin", "addr_empty").select("s1_id", "cand_id", *(c.alias(k) for k, c in features.set_features().items())))


_V1, _V2 = "list_filter(u1, lambda x: x <> h1)", "list_filter(u2, lambda x: x <> h2)"


@query(PPAIRS + f"""select s1_id, cand_id, (h1 <> '' and h1 = h2)::int as house_eq, (h1 <> '' and h2 <> '')::int as house_both, (h1 <> '' and list_contains(u2, h1))::int as house_in_nums,
 (case when h1 <> '' and h2 <> '' then levenshtein(h1, h2) else -1 end)::int as house_lev, (h1 <> '' and h2 <> '' and levenshtein(h1, h2) = 1)::int as house_one_edit,
 (h1 <> '' and h2 <> '' and h1 <> h2 and (starts_with(h1, h2) or starts_with(h2, h1) or suffix(h1, h2) or suffix(h2, h1)))::int as house_prefix, (h1 <> '' and h2 <> '' and h1 <> h2)::int as house_neq,
 {_inter(_V1, _V2)}::int as sec_nums_inter, round({_jacc(_V1, _V2)}, 6) as sec_nums_jacc,
 len(list_filter({_minus('u1', 'u2')}, lambda x: length(x) >= 2 and len(list_filter(u2, lambda y: not list_contains(u1, y) and length(y) >= 2 and levenshtein(x, y) <= 1)) > 0))::int as nums_near from j""")
def feat_house_nums(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.part_pairs(spark, d, "addr_nums", "house_num").select("s1_id", "cand_id", *(c.alias(k) for k, c in features.house_features().items())))


@query(PPAIRS + """, n as (select count(*) as n from rec), idf as (select kind, token, ln((select n from n)) - ln(count(*) + 1) as idf from (select 'name' as kind, unnest(t) as token from lists union all select 'addr', unnest(w) from lists) group by 1, 2),
p as (select 'name' as kind, s1_id, cand_id, unnest(list_distinct(list_concat(t1, t2))) as token, t1 as a, t2 as b from j union all select 'addr', s1_id, cand_id, unnest(list_distinct(list_concat(w1, w2))), w1, w2 from j),
g as (select kind, s1_id, cand_id, coalesce(sum(idf) filter (list_contains(a, token) and list_contains(b, token)), 0) / nullif(sum(idf), 0) as jacc, coalesce(max(idf) filter (list_contains(a, token) and list_contains(b, token)), 0) as s,
 coalesce(max(idf) filter (not (list_contains(a, token) and list_contains(b, token))), 0) as u, coalesce(sum(idf) filter (list_contains(b, token)), 0) as total from p join idf using (kind, token) group by 1, 2, 3)
select j.s1_id, j.cand_id, round(coalesce(a.jacc, 0), 6) as name_widf_jacc, round(greatest(coalesce(a.s, 0), 0), 6) as name_shared_maxidf, round(greatest(coalesce(a.u, 0), 0), 6) as name_unshared_maxidf, round(coalesce(a.total, 0), 6) as name2_idf_sum,
 round(coalesce(b.jacc, 0), 6) as addr_widf_jacc, round(greatest(coalesce(b.s, 0), 0), 6) as addr_shared_maxidf, round(greatest(coalesce(b.u, 0), 0), 6) as addr_unshared_maxidf
from j left join g a on a.kind = 'name' and a.s1_id = j.s1_id and a.cand_id = j.cand_id left join g b on b.kind = 'addr' and b.s1_id = j.s1_id and b.cand_id = j.cand_id""")
def feat_idf_overlap(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    idf = features.idf_table(one.unionByName(pool))
    pairs = features.joined(candidates.topk(one, pool, candidates.channels(0.5)["addr"]), features.with_idf(one, idf), features.with_idf(pool, idf), ("name_core", "addr_words"))
    return rounded(pairs.select("s1_id", "cand_id", *(c.alias(k) for k, c in features.idf_features().items())))


_SORT = lambda x: f"array_to_string(list_sort({x}), ' ')"


@query(PPAIRS + f""", p as (select *, {_SORT("str_split(nc1, ' ')")} as so1, {_SORT("str_split(nc2, ' ')")} as so2 from j)
select s1_id, cand_id, round({sql.ratio('nc1', 'nc2')}, 6) as name_ratio, round({sql.ratio('so1', 'so2')}, 6) as name_tsort, round({sql.ratio('ns1', 'ns2')}, 6) as name_ns_ratio,
 round(case when an1 = '' or an2 = '' then 0.0::double else {sql.ratio('an1', 'an2')} end, 6) as addr_ratio, round(case when nu1 = '' or nu2 = '' then 0.0::double else {sql.ratio('nu1', 'nu2')} end, 6) as nums_ratio from p""")
def feat_ratio(spark: SparkSession, d: str) -> DataFrame:
    own = features.ratio_features() | {"addr_ratio": features.arrow_features()["addr_ratio"]}
    return rounded(views.part_pairs(spark, d, "name_core", "name_nospace", "addr_norm", "addr_nums").select("s1_id", "cand_id", *(c.alias(k) for k, c in own.items())))


def _token_set(a: str, b: str) -> str:
    """SQL of the token-set ratio of two space-joined texts."""
    t = lambda x: f"list_sort(list_distinct(list_filter(str_split({x}, ' '), lambda x: x <> '')))"
    return f"select s1_id, cand_id, array_to_string(list_filter(x, lambda z: list_contains(y, z)), ' ') as o, array_to_string(list_filter(x, lambda z: not list_contains(y, z)), ' ') as l, array_to_string(list_filter(y, lambda z: not list_contains(x, z)), ' ') as r, len(x) as nx, len(y) as ny from (select s1_id, cand_id, {t(a)} as x, {t(b)} as y from j)"


def _set_ratio(rel: str) -> str:
    more = f"(select *, trim(o || ' ' || l) as p, trim(o || ' ' || r) as q from ({rel}))"
    return f"""select s1_id, cand_id, round(case when nx = 0 or ny = 0 then 0.0::double when o <> '' and (l = '' or r = '') then 100.0::double
 else greatest({sql.ratio('p', 'q')}, case when o <> '' then {sql.ratio('o', 'p')} else 0.0::double end, case when o <> '' then {sql.ratio('o', 'q')} else 0.0::double end) end, 6) as v from {more}"""


@query(PPAIRS + f", n as ({_set_ratio(_token_set('nc1', 'nc2'))}), a as ({_set_ratio(_token_set('an1', 'an2'))}) select s1_id, cand_id, n.v as name_tsr, a.v as addr_tsr from n join a using (s1_id, cand_id)")
def feat_token_set(spark: SparkSession, d: str) -> DataFrame:
    own = features.arrow_features()
    return rounded(views.part_pairs(spark, d, "name_core", "addr_norm").select("s1_id", "cand_id", *(own[k].alias(k) for k in ("name_tsr", "addr_tsr"))))


@query(PPAIRS + "select s1_id, cand_id, round(case when nc1 = nc2 then 1.0::double when nc1 = '' or nc2 = '' then 0.0::double else jaro_winkler_similarity(nc1, nc2) end, 6) as name_jw from j")
def feat_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.part_pairs(spark, d, "name_core").select("s1_id", "cand_id", similarity.jaro_winkler(F.col("name_core1"), F.col("name_core2")).alias("name_jw")))


@query()
def feat_partial(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.part_pairs(spark, d, "name_core", "addr_norm").select("s1_id", "cand_id", similarity.partial_ratio(F.col("name_core1"), F.col("name_core2")).alias("name_partial"), similarity.partial_ratio(F.col("addr_norm1"), F.col("addr_norm2")).alias("addr_partial")))


@query()
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    return rounded(features.build(candidates.block(one, pool, candidates.channels(0.5, 0.5)), one, pool))


@query(PREC + """a as (select entity_id as s1_id, count(*) over (partition by country, addr_norm) as s1_addr_dup, count(*) over (partition by country, name_core) as s1_name_dup, count(*) over (partition by country, name_core, house_num) as s1_name_addr_key_dup from rec where src = 'S1'),
n as (select country, name_core, count(*) as n from rec where src = 'S1' group by 1, 2)
select 'S1' as side, s1_id as id, s1_addr_dup, s1_name_dup, s1_name_addr_key_dup, null::bigint as cand_name_n_s1, null::int as src_is_s3 from a
union all select 'pool', entity_id, null, null, null, coalesce(n, 0), (src = 'S3')::int from rec left join n using (country, name_core) where src <> 'S1'""")
def ctx_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    a = features.ambiguity(one).withColumnRenamed("s1_id", "id").withColumn("side", F.lit("S1"))
    b = features.name_owners(pool, one).withColumnRenamed("cand_id", "id").withColumn("side", F.lit("pool"))
    return a.unionByName(b, allowMissingColumns=True).select("side", "id", "s1_addr_dup", "s1_name_dup", "s1_name_addr_key_dup", "cand_name_n_s1", "src_is_s3")


@query(sql.SCORED + """c as (select s1_id, cand_id, prob as cos_all, round(1 - prob, 6) as cos_name from scored)
select s1_id, cand_id, count(*) over (partition by cand_id) as cand_n_s1, max(cos_all) over (partition by cand_id) as cand_best_cos, round(max(cos_all) over (partition by cand_id) - cos_all, 6) as cand_gap_cos,
 row_number() over (partition by cand_id order by cos_all desc, s1_id)::int as cand_rank_cos, count(*) filter (cos_name >= 0.7) over (partition by cand_id) as cand_n_s1_name_hi, count(*) filter (cos_name >= 0.9) over (partition by s1_id) as s1_n_name_hi from c""")
def ctx_competition(spark: SparkSession, d: str) -> DataFrame:
    c = views.scored(spark, d).select("s1_id", "cand_id", F.col("prob").alias("cos_all"), F.round(1 - F.col("prob"), 6).alias("cos_name"))
    return rounded(features.competition(c).drop("cos_all", "cos_name"))


@query(sql.SCORED + """s as (select s1_id, cand_id, round(0.4 * (prob * 100) / 100 + 0.3 * ((1 - prob) * 100) / 100 + 0.3 * prob + 0.1 * (prob >= 0.5)::int, 6) as score0 from scored)
select s1_id, cand_id, score0, count(*) over w as n_cands, row_number() over o::int as rank0, round(max(score0) over w - score0, 6) as margin0,
 round(coalesce(max(score0) over w - nth_value(score0, 2) over (o rows between unbounded preceding and unbounded following), 1.0), 6) as best0_gap from s window w as (partition by s1_id), o as (partition by s1_id order by score0 desc, cand_id)""".replace("row_number() over o::int", "(row_number() over o)::int"))
def ctx_rank_margin(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prob")
    rows = views.scored(spark, d).select("s1_id", "cand_id", (p * 100).alias("name_tsr"), ((1 - p) * 100).alias("addr_tsr"), p.alias("cos_all"), (p >= 0.5).cast("int").alias("house_eq"))
    return features.context(rows).select("s1_id", "cand_id", *features.CONTEXT)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return views.scored(spark, d).withColumnRenamed("prob", "p")


PR = sql.SCORED + "pruned as (select s1_id, cand_id, prob as p from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as r from scored) where prob >= 0.2 or r <= 1),\n"


@query(PR + "x as (select 1) select s1_id, cand_id, p from pruned")
def prune_pairs(spark: SparkSession, d: str) -> DataFrame:
    return consistency.prune(_p(spark, d), 0.2).select("s1_id", "cand_id", "p")


TOP2 = "top2 as (select cand_id, max(prob) filter (r = 1) as max1, coalesce(max(prob) filter (r = 2), 0.0)::double as max2 from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as r from scored) group by 1)\n"


@query(sql.SCORED + TOP2 + "select * from top2")
def cand_top2(spark: SparkSession, d: str) -> DataFrame:
    return consistency.top2(_p(spark, d))


@query(PR + TOP2 + """, a as (select *, least(greatest(p, 1e-6), 1 - 1e-6) as c, (p >= 0.9)::int as s, max(p) over (partition by s1_id) as m, coalesce(nth_value(p, 2) over (partition by s1_id order by p desc, cand_id rows between unbounded preceding and unbounded following), 0.0) as second from pruned)
select s1_id, cand_id, p, round(ln(c / (1 - c)), 6) as p_logit, (row_number() over (partition by s1_id order by p desc, cand_id))::int as p_rank, round(sum(p) over (partition by s1_id) - p, 6) as p_sum_others, (case when p = m then second else m end)::double as p_max_other,
 (sum(s) over (partition by s1_id) - s)::bigint as n_conf_others, (case when p >= max1 then max2 else max1 end)::double as cand_p_max_other_s1, round(p - case when p >= max1 then max2 else max1 end, 6) as cand_p_gap from a left join top2 using (cand_id)""")
def stage2_prob_ctx(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)
    out = consistency.probabilities(consistency.prune(p, 0.2).select("s1_id", "cand_id", "p"), consistency.top2(p))
    return out.select("s1_id", "cand_id", "p", "p_logit", "p_rank", "p_sum_others", "p_max_other", "n_conf_others", "cand_p_max_other_s1", "cand_p_gap")


@query(PR + """tok as (select entity_id as cand_id, unnest(list_distinct(list_filter(str_split(name_core, ' '), lambda x: x <> ''))) as t from rec where src <> 'S1'),
a as (select s1_id, cand_id, t, sum((p >= 0.9)::int) over (partition by s1_id, t) - (p >= 0.9)::int as o from pruned join tok using (cand_id)),
g as (select s1_id, cand_id, round(avg((o >= 1)::int), 6) as cov, count(*) as n from a group by 1, 2)
select s1_id, cand_id, coalesce(cov, 0.0)::double as prof_name_cov, coalesce(n, 0)::bigint as prof_name_n from pruned left join g using (s1_id, cand_id)""")
def stage2_profile(spark: SparkSession, d: str) -> DataFrame:
    _, pool = views.documents(spark, d)
    return consistency.profile(consistency.prune(_p(spark, d), 0.2), pool, "name_core", "name")


PROFILE = f"""scored as ({sql.topk('rec', sql.ADDR, 8, 0.5, name='p')}), tok as (select entity_id as cand_id, kind, unnest(list_distinct(list_filter(str_split(s, ' '), lambda x: x <> ''))) as t
 from (select entity_id, unnest([{{'kind': 'addr', 's': addr_words}}, {{'kind': 'nums', 's': addr_nums}}], recursive := true) from rec where src <> 'S1')),
a as (select s1_id, cand_id, kind, sum((p >= 0.9)::int) over (partition by s1_id, kind, t) - (p >= 0.9)::int as o from scored join tok using (cand_id)),
g as (select s1_id, cand_id, kind, round(avg((o >= 1)::int), 6) as cov, count(*) as n from a group by 1, 2, 3)
select s.s1_id, s.cand_id, coalesce(x.cov, 0.0)::double as prof_addr_cov, coalesce(x.n, 0)::bigint as prof_addr_n, coalesce(y.cov, 0.0)::double as prof_nums_cov, coalesce(y.n, 0)::bigint as prof_nums_n
from scored s left join g x on x.s1_id = s.s1_id and x.cand_id = s.cand_id and x.kind = 'addr' left join g y on y.s1_id = s.s1_id and y.cand_id = s.cand_id and y.kind = 'nums'"""


@query(PREC + PROFILE)
def stage2_profile_address(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    p = candidates.topk(one, pool, candidates.channels(0.5)["addr"]).withColumnRenamed("cos_addr", "p")
    return consistency.profile(p, pool, "addr_words", "addr").join(consistency.profile(p, pool, "addr_nums", "nums"), ["s1_id", "cand_id"])


@query(PREC + f"""scored as ({sql.topk('rec', sql.ADDR, 8, 0.5, name='p')}), a as (select s1_id, cand_id, house_num, (p >= 0.9 and house_num <> '')::int as own, house_num <> '' as has from scored join rec on cand_id = entity_id),
b as (select s1_id, cand_id, case when has then sum(own) over (partition by s1_id, house_num) - own else 0 end as same, sum(own) over (partition by s1_id) - own as every_ from a)
select s1_id, cand_id, same::bigint as prof_house_support, round(same / greatest(1, every_), 6) as conf_house_agree from b""")
def stage2_house(spark: SparkSession, d: str) -> DataFrame:
    one, pool = views.parts(spark, d)
    p = candidates.topk(one, pool, candidates.channels(0.5)["addr"]).withColumnRenamed("cos_addr", "p")
    return consistency.houses(p, pool).withColumn("prof_house_support", F.col("prof_house_support").cast("long"))


@query(sql.SCORED + sql.ONE + "x as (select 1) select s1_id, cand_id, prob from one")
def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return decide.one_to_one(views.scored(spark, d)).select("s1_id", "cand_id", "prob")


@query(sql.SCORED + sql.ONE + "x as (select 1) select s1_id, cand_id, prob from one where prob >= 0.3")
def decide_threshold(spark: SparkSession, d: str) -> DataFrame:
    return decide.threshold(views.scored(spark, d), 0.3)


@query(sql.SCORED + sql.ONE + "x as (select *, max(prob) over (partition by s1_id) as m from one) select s1_id, cand_id, prob from x where prob >= 0.6 or (prob = m and prob >= 0.15)")
def decide_top_threshold(spark: SparkSession, d: str) -> DataFrame:
    return decide.threshold(views.scored(spark, d), 0.6, 0.15)


EF = sql.SCORED + sql.ONE + """a as (select s1_id, cand_id, prob, row_number() over o as k, sum(prob) over (o rows between unbounded preceding and current row) as cum, sum(prob) over w as tot,
 round(case when max(prob) over w >= 1 then 0 else exp(sum(case when prob < 1 then ln(1 - prob) end) over w) end, 6) as none from one where prob >= 0.05 window w as (partition by s1_id), o as (partition by s1_id order by prob desc, cand_id)),
b as (select *, round(1.25 * cum / (0.25 * k + tot), 6) as ef from a), c as (select *, max(ef) over (partition by s1_id) as top from b),
e as (select *, min(case when ef = top and top > none then k end) over (partition by s1_id) as star from c), chosen as (select s1_id, cand_id, prob, k from e where k <= star)\n"""


@query(EF + "select s1_id, cand_id, prob, k::int as k from chosen")
def decide_expected_f(spark: SparkSession, d: str) -> DataFrame:
    return decide.expected_f(views.scored(spark, d))


F_SQL = "(case when np = 0 and nt = 0 then 1.0::double when tp = 0 then 0.0::double else 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) end)"


@query(sql.SCORED + sql.TRUTH + sql.ONE + f"""g as (select 0.3::double + 0.1::double * i::double as t from range(0, 6) r(i)), p as (select t, s1_id, cand_id from one, g where prob >= t),
per as (select p.t, p.s1_id, count(*) as np, count(tr.cand_id) as tp from p left join truth tr on p.s1_id = tr.s1_id and p.cand_id = tr.cand_id group by 1, 2),
nt as (select e.s1_id, count(t.s1_id) as nt from ents e left join truth t on e.s1_id = t.s1_id group by 1),
f as (select g.t, nt.s1_id, nt, coalesce(np, 0) as np, coalesce(tp, 0) as tp from g cross join nt left join per on per.t = g.t and per.s1_id = nt.s1_id)
select round(t, 6) as threshold, round(sum({F_SQL}) / count(*), 6) as macro_f05 from f group by t""")
def tune_grid(spark: SparkSession, d: str) -> DataFrame:
    true, ids = views.truth(spark, d)
    return decide.grid(views.scored(spark, d), true, ids, [0.3 + 0.1 * i for i in range(6)]).select(F.round("threshold", 6).alias("threshold"), "macro_f05")


@query(sql.SCORED + sql.TRUTH + sql.ONE + f"""p as (select s1_id, cand_id from one where prob >= 0.5), np as (select s1_id, count(*) as np from p group by 1), nt as (select s1_id, count(*) as nt from truth group by 1), tp as (select s1_id, count(*) as tp from p join truth using (s1_id, cand_id) group by 1),
f as (select s1_id, coalesce(np, 0) as np, coalesce(nt, 0) as nt, coalesce(tp, 0) as tp from ents left join np using (s1_id) left join nt using (s1_id) left join tp using (s1_id))
select round(sum({F_SQL}) / greatest(1, count(*)), 6) as macro_f05, count(*) as n, round(sum(tp) / greatest(1, sum(np)), 6) as pair_precision, round(sum(tp) / greatest(1, sum(nt)), 6) as pair_recall,
 round(count(*) filter (nt = 0 and np = 0) / greatest(1, count(*) filter (nt = 0)), 6) as singleton_acc from f""")
def macro_fbeta(spark: SparkSession, d: str) -> DataFrame:
    true, ids = views.truth(spark, d)
    return metrics.report(decide.threshold(views.scored(spark, d), 0.5), true, ids)


@query(sql.SCORED + sql.TRUTH + sql.ONE + "x as (select s1_id, string_agg(cand_id, ',' order by prob desc, cand_id) as l from one where prob >= 0.3 group by 1) select s1_id as source1_entity_id, coalesce(l, '') as matched_entity_ids from ents left join x using (s1_id)")
def match_lists(spark: SparkSession, d: str) -> DataFrame:
    _, ids = views.truth(spark, d)
    return R.id_lists(ids, decide.lists(decide.threshold(views.scored(spark, d), 0.3)), "matched_entity_ids")


@query(sql.SCORED + sql.TRUTH + "x as (select s1_id, string_agg(cand_id, ',' order by prob desc, cand_id) as l from scored group by 1) select s1_id as source1_entity_id, coalesce(l, '') as candidate_entity_ids from ents left join x using (s1_id)")
def cand_lists(spark: SparkSession, d: str) -> DataFrame:
    _, ids = views.truth(spark, d)
    return R.id_lists(ids, decide.lists(views.scored(spark, d)), "candidate_entity_ids")


BROKEN = """o as (select s1_id, case when n % 7 = 0 then l || ',' || split_part(l, ',', 1) when n % 7 = 1 then l || ',S1-5' when n % 7 = 2 then l || ',X9-1' when n % 7 = 3 then l || ',S2-none' else l end as l, n from
 (select s1_id, string_agg(cand_id, ',' order by prob desc, cand_id) as l, substring(s1_id, 4)::bigint as n from scored group by 1)),
outp as (select s1_id, l from o where n % 11 <> 0 union all select s1_id, l from o where n % 11 = 1 union all select 'S1-none', 'S2-none'), flat as (select s1_id, unnest(str_split(l, ',')) as id from outp),
cand as (select s1_id, cand_id as id from scored), f as (
 select 'error' as level, 'duplicate_s1_row' as rule, s1_id as x from outp group by s1_id having count(*) > 1
 union all select 'error', 'duplicate_id', id from flat group by s1_id, id having count(*) > 1 union all select 'error', 'self_match', id from flat where id like 'S1-%'
 union all select 'error', 'wrong_prefix', id from flat where not regexp_matches(id, '^S[123]-') union all select 'error', 'missing_s1', s1_id from ents where s1_id not in (select s1_id from outp)
 union all select distinct 'error', 'unexpected_s1', s1_id from outp where s1_id not in (select s1_id from ents) union all select 'error', 'unknown_id', id from flat where regexp_matches(id, '^S[23]-') and id not in (select entity_id from rec where src <> 'S1')
 union all select 'warning', 'match_outside_candidates', f.id from flat f where not exists (select 1 from cand c where c.s1_id = f.s1_id and c.id = f.id)),
g as (select level, rule, x, count(*) as m, row_number() over (partition by level, rule order by x) as r from f group by 1, 2, 3)
select level, rule, sum(m)::bigint as n, string_agg(x, ',' order by x) filter (r <= 5) as examples from g group by 1, 2"""


@query(sql.SCORED + sql.TRUTH + BROKEN)
def validate_outputs(spark: SparkSession, d: str) -> DataFrame:
    _, ids = views.truth(spark, d)
    n = F.substring("s1_id", 4, 20).cast("long")
    cand = decide.lists(views.scored(spark, d)).select("s1_id", F.array_join("ids", ",").alias("ids"))
    more = F.when(n % 7 == 0, F.concat(F.lit(","), F.split("ids", ",")[0])).when(n % 7 == 1, ",S1-5").when(n % 7 == 2, ",X9-1").when(n % 7 == 3, ",S2-none").otherwise("")
    bad = cand.withColumn("ids", F.concat("ids", more))
    bad = bad.where(n % 11 != 0).unionByName(bad.where(n % 11 == 1)).unionByName(spark.createDataFrame([("S1-none", "S2-none")], "s1_id string, ids string"))
    _, pool = R.sides(R.documents_as_records(spark, d))
    return check.findings(bad, ids, pool.select(F.col("entity_id").alias("id")), cand)


@query("""with a as (select entity_id, md5('42:' || entity_id) as h, row_number() over (order by md5('42:' || entity_id)) as r, count(*) over () as n from (""" + sql.DOC + """) where entity_id like 'S1-%')
select entity_id, case when r <= least(100000, n // 4) then 'valid' when r <= least(100000, n // 4) + 700000 then 'train' end as part from a""")
def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    one, _ = R.sides(R.documents_as_records(spark, d))
    return learn.split(one.select("entity_id"), 700_000, 100_000)


@query("select entity_id as s1_id, (substring(md5('43:' || entity_id), 32, 1) not in ('0','1','2','3','4','5','6','7'))::int as fold from (" + sql.DOC + ") where entity_id like 'S1-%'")
def oof_fold(spark: SparkSession, d: str) -> DataFrame:
    _, ids = views.truth(spark, d)
    return ids.withColumn("fold", learn.fold())


ML = ["n_chars", "n_words", "n_types", "mean_word", "marks"]


def _ml_rows(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_remove(F.split("text", r"\s+"), "")
    rows = R.table(spark, d, "documents").join(R.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    rows = rows.select("doc_id", "label", F.char_length("text").cast("double").alias("n_chars"), F.size(words).cast("double").alias("n_words"), F.size(F.array_distinct(words)).cast("double").alias("n_types"), F.regexp_count("text", F.lit(r"[^\p{L}\s.,]")).cast("double").alias("marks"))
    return rows.withColumn("mean_word", F.col("n_chars") / F.greatest(F.lit(1.0), F.col("n_words")))


@query()
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _ml_rows(spark, d)
    own = learn.fold("doc_id")
    model = learn.fit(rows.withColumn("_valid", F.substring(learn.digest("doc_id", 44), 32, 1).isin("0", "1", "2")).where(own == 0), ML, rounds=20, valid="_valid", leaf=20)
    return rounded(learn.predict(model, rows).select("doc_id", "label", "p"))


@query()
def gbt_oof_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learn.out_of_fold(_ml_rows(spark, d), ML, "doc_id", rounds=20, leaf=20).select("doc_id", "label", "fold", "p"))


@query(sql.SCORED + """one as (select * from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as r from scored) where r = 1),
x as (select s1_id, string_agg(cand_id, ',' order by prob desc, cand_id) as l from one where prob >= 0.3 group by 1)
select entity_id as source1_entity_id, coalesce(l, '') as matched_entity_ids from rec left join x on s1_id = entity_id where src = 'S1'""")
def flagship_link(spark: SparkSession, d: str) -> DataFrame:
    """Normalise, block, score by cosine, assign one-to-one, decide, list."""
    one, pool = views.documents(spark, d)
    pairs = candidates.topk(one, pool, candidates.channels(views.MOST)["all"]).withColumnRenamed("cos_all", "prob")
    return R.id_lists(one.select(F.col("entity_id").alias("s1_id")), decide.lists(decide.threshold(pairs, 0.3)), "matched_entity_ids")
