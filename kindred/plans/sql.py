"""The same relations in SQL, as text: building blocks of the oracles."""

from __future__ import annotations

from kindred.functions import vocabulary as V

quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
ABBR = f"map([{quoted(V.ABBREVIATIONS)}], [{quoted(V.ABBREVIATIONS.values())}])"
DOMAIN = V.DOMAIN

DOC = """select case when source in ('src0','src1','src2') then 'S1-' when doc_id % 2 = 0 then 'S2-' else 'S3-' end || doc_id as entity_id,
 text as business_name, '' as business_address, lang as country from documents"""
PART = """select 'S' || (1 + p_partkey % 3) || '-' || p_partkey as entity_id, p_name || ' Pvt. Ltd.' as business_name,
 'No. ' || (p_partkey % 40 + 1) || ', ' || p_brand || ' ' || p_size || ' ' || p_type || ' St' as business_address, p_type as country from part"""
COMPANY = """select 'S1-' || s_suppkey as entity_id, s_name as business_name, '' as business_address, n_name as country from supplier join nation on s_nationkey = n_nationkey
 union all select 'S2-' || c_custkey, c_name, '', n_name from customer join nation on c_nationkey = n_nationkey"""
HOST = r"""select 'S2-' || page_id as entity_id, regexp_extract(regexp_extract(url, '^https?://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1) as business_name,
 '' as business_address, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as country from pages"""


def tokens(c: str) -> str:
    s = f"regexp_replace({c}, '{V.MARKS}', ' ', 'g')"
    s = f"lower(strip_accents(replace(replace(replace({s}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')))"
    s = f"regexp_replace(replace(replace({s}, '&', ' and '), '+', ' plus '), '[^a-z0-9]+', ' ', 'g')"
    n = f"list_transform(list_filter(str_split({s}, ' '), lambda t: t <> ''), lambda t: case when regexp_full_match(t, '[0-9]+') then coalesce(nullif(ltrim(t, '0'), ''), '0') else t end)"
    return f"flatten(list_transform({n}, lambda t: str_split(coalesce({ABBR}[t], t), ' ')))"


def norm(rel: str) -> str:
    """Normalised records of a relation."""
    core = f"list_filter(nt, lambda t: t not in ({quoted(V.LEGAL_SUFFIXES)}))"
    house = f"list_filter(list_transform(str_split(business_address, ','), lambda p: regexp_extract(regexp_replace(lower(trim(p)), '{V.HOUSE_MARKER}', ''), '{V.HOUSE_NUMBER}', 1)), lambda p: p <> '')"
    return f"""select entity_id, country, business_name, substring(entity_id, 1, 2) as src,
 case when stem <> '' then stem else array_to_string(nt, ' ') end as name_norm,
 case when stem <> '' then stem else array_to_string(core, ' ') end as name_core,
 case when stem <> '' then stem else array_to_string(core, '') end as name_nospace,
 (stem <> '')::int as is_domain, regexp_matches(business_name, '{V.NON_LATIN}')::int as name_nonlatin,
 case when blank then '' else array_to_string(ad, ' ') end as addr_norm,
 case when blank then '' else array_to_string(list_filter(ad, lambda t: regexp_full_match(t, '[a-z][a-z]+') and t not in ({quoted(V.ADDRESS_STOP)})), ' ') end as addr_words,
 case when blank then '' else array_to_string(list_sort(list_distinct(list_filter(ad, lambda t: regexp_full_match(t, '[0-9]+')))), ' ') end as addr_nums,
 case when blank or len(house) = 0 then '' else coalesce(nullif(ltrim(house[1], '0'), ''), '0') end as house_num, blank::int as addr_empty
from (select *, case when len(c0) > 0 then c0 else nt end as core from (select *, {core} as c0, {house} as house from (
 select *, {tokens("business_name")} as nt, {tokens("business_address")} as ad, trim(business_address) = '' as blank,
 replace(regexp_extract(replace(lower(trim(business_name)), ' ', ''), '{DOMAIN}', 1), '-', '') as stem from ({rel}))))"""


WORDS = "list_filter(str_split({t}, ' '), lambda x: x <> '')"
GRAMS = "case when length({t}) >= 3 then list_transform(range(1, length({t}) - 1), lambda i: substring({t}, i, 3)) else [] end"


def topk(rel: str, text: str, top: int, most: float, chars: bool = False, pool: str = "true", name: str = "cos") -> str:
    """s1_id, cand_id, <name> of the normalised relation named ``rel``."""
    split = (GRAMS if chars else WORDS).format(t=text)
    return f"""select s1_id, cand_id, {name} from (select *, row_number() over (partition by s1_id order by {name} desc, cand_id) as r from (
 with tf as (select entity_id, country, src, ok, term, count(*) as tf from (select entity_id, country, src, ({pool}) as ok, unnest({split}) as term from {rel}) group by all),
 n as (select country, count(*) as n from {rel} where src <> 'S1' and ({pool}) group by country),
 idf as (select country, term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 as idf from tf join n using (country) where src <> 'S1' and ok group by country, term, n
  having count(*) >= 2 and count(*) <= {most} * n),
 w as (select entity_id, country, src, ok, term, (1.0 + ln(tf)) * idf as w from tf join idf using (country, term)),
 u as (select *, w / sqrt(sum(w * w) over (partition by entity_id)) as v from w)
 select q.entity_id as s1_id, p.entity_id as cand_id, round(sum(q.v * p.v), 6) as {name} from u q join u p using (country, term)
 where q.src = 'S1' and p.src <> 'S1' and p.ok group by 1, 2) where {name} > 0.05) where r <= {top}"""


ALL = "concat_ws(' ', name_core, addr_words, addr_nums)"
ADDR = "concat_ws(' ', house_num, addr_words, addr_nums)"
ODD = "is_domain = 1 or name_nonlatin = 1"
#: Documents blocked by all words; every scored query builds on it.
SCORED = f"with rec as ({norm(DOC)}), scored as (select s1_id, cand_id, cos as prob from ({topk('rec', ALL, 15, 0.1)})),\n"
#: Pairs of documents with one text across the sides, and all reference entities.
TRUTH = """truth as (select a.entity_id as s1_id, b.entity_id as cand_id from rec a join rec b on a.business_name = b.business_name and a.country = b.country where a.src = 'S1' and b.src <> 'S1'),
ents as (select entity_id as s1_id from rec where src = 'S1'),
"""
ONE = "one as (select * from (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as r from scored) where r = 1),\n"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by masks of up to 62 characters, the shorter string first."""
    s, g = f"(case when length({a}) <= length({b}) then {a} else {b} end)", f"(case when length({a}) <= length({b}) then {b} else {a} end)"
    mask = f"list_sum(list_transform(range(0, length({s})), lambda i: case when substring({s}, i::int + 1, 1) = ch then (1::bigint << i::int) else 0::bigint end))"
    masks = f"list_transform(str_split({g}, ''), lambda ch: coalesce({mask}, 0)::bigint)"
    full = "((1::bigint << 62) - 1)"
    return f"(case when length({s}) = 0 then 0 else length({s}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: (((v + (v & m)) | (v - (v & m))) & {full})) & ((1::bigint << length({s})) - 1)) end)"


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100.0::double when {a} = {b} then 100.0::double else 200.0::double * {lcs(a, b)} / (length({a}) + length({b})) end)"
