"""Token equivalences mined from true pairs (a: reference text, b: candidate text), and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import split_tokens
from kindred.operators.settle import settled


def _digits(c: str) -> Column:
    return F.col(c).rlike("^[0-9]+$")


def mine(pairs: DataFrame, least: int = 30, share: float = 0.5, most: int = 2, back: float = 0.2, length: int = 2) -> DataFrame:
    """y, x, c: side-B token y stands for x (one token, or two in their order), seen c times; before chains are resolved.

    One-token rules point at the form that the reference uses more often. Ties go to the smaller x.
    """
    d = pairs.select(split_tokens(F.col("a")).alias("la"), split_tokens(F.col("b")).alias("lb"))
    d = d.select("la", F.array_except("la", "lb").alias("da"), F.array_except("lb", "la").alias("db"))
    differ = F.size("da").between(1, most) & F.size("db").between(1, most)
    item = lambda kind, y, x: F.struct(F.lit(kind).alias("kind"), y.alias("y"), x.alias("x"))
    none, y = F.lit(""), F.get("db", F.lit(0))
    lone = differ & (F.size("db") == 1)
    items = F.concat(
        F.transform(F.array_distinct("la"), lambda t: item("use", none, t)), F.when(differ, F.transform("da", lambda t: item("a", none, t))).otherwise(F.array()), F.when(differ, F.transform("db", lambda t: item("b", t, none))).otherwise(F.array()),
        F.when(lone & (F.size("da") == 2), F.array(item("two", y, F.array_join(F.filter("la", lambda t: F.array_contains("da", t)), " ")))).otherwise(F.array()), F.when(lone & (F.size("da") == 1), F.array(item("one", y, F.get("da", F.lit(0))))).otherwise(F.array()),
    )
    counts = settled(d.select(F.explode(items).alias("i")).select("i.*").groupBy("kind", "y", "x").agg(F.count("*").alias("c")))
    of = lambda kind, *names: counts.where(F.col("kind") == kind).select(*names)
    only_a, only_b, uses = of("a", "x", F.col("c").alias("na")), of("b", "y", F.col("c").alias("nb")), of("use", F.col("x").alias("t"), F.col("c").alias("uses"))
    best = Window.partitionBy("y").orderBy(F.desc("c"), "x")
    first = lambda df: df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")
    two, one = of("two", "y", "x", "c"), of("one", "y", "x", "c")
    two = first(two.where((F.col("c") >= least) & ~_digits("y") & (F.char_length("y") >= length)).join(only_b, "y").where(F.col("c") / F.col("nb") >= share)).select("y", "x", "c")
    one = one.where((F.col("c") >= least) & ~_digits("y") & ~_digits("x") & (F.char_length("y") >= length) & (F.char_length("x") >= length))
    one = one.join(two.select("y"), "y", "left_anti").join(only_b, "y").join(only_a, "x").where((F.col("c") / F.col("nb") >= share) & (F.col("c") / F.col("na") >= back))
    one = first(one).join(two.select(F.col("y").alias("x")), "x", "left_anti")
    one = one.join(uses.select(F.col("t").alias("y"), F.col("uses").alias("uy")), "y", "left").join(uses.select(F.col("t").alias("x"), F.col("uses").alias("ux")), "x", "left").fillna(0, ["uy", "ux"])
    turned = F.col("uy") > F.col("ux")
    one = one.select(F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), "c")
    return first(two.unionByName(one))


def mine_aligned(pairs: DataFrame, least: int = 5, share: float = 0.5, length: int = 3) -> DataFrame:
    """y, x, c from texts of equally many tokens, place by place."""
    rows = pairs.select(split_tokens(F.col("a")).alias("la"), split_tokens(F.col("b")).alias("lb")).where((F.size("la") == F.size("lb")) & (F.size("la") > 0))
    rows = rows.select(F.explode(F.arrays_zip("la", "lb")).alias("z")).select(F.col("z.la").alias("x"), F.col("z.lb").alias("y")).where("x != y")
    c = rows.groupBy("y", "x").agg(F.count("*").alias("c")).withColumn("nb", F.sum("c").over(Window.partitionBy("y")))
    c = c.where((F.col("c") >= least) & (F.char_length("y") >= length) & ~_digits("y") & ~_digits("x") & (F.col("c") / F.col("nb") >= share))
    return c.withColumn("_r", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("c"), "x"))).where(F.col("_r") == 1).select("y", "x", "c")


def resolved(rules: DataFrame, limit: int = 100_000) -> dict[str, str]:
    """The rules as a dictionary with chains followed (a rule table is small: a row for each abbreviation found)."""
    rows = rules.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    table = {r.y: r.x for r in rows}
    out = {}
    for y in table:
        x, seen = table[y], {y}
        while " " not in x and x in table and x not in seen:
            seen.add(x)
            x = table[x]
        if x != y:
            out[y] = x
    return out


def learn(reference: DataFrame, pool: DataFrame, truth: DataFrame) -> dict[str, dict[str, str]]:
    """{"addr": ..., "name": ...}: addresses by replaced tokens, names of non-Latin candidates by place."""
    a = reference.select(F.col("entity_id").alias("s1_id"), F.col("addr_norm").alias("a1"), F.col("name_norm").alias("n1"))
    b = pool.select(F.col("entity_id").alias("cand_id"), F.col("addr_norm").alias("a2"), F.col("name_norm").alias("n2"), "name_nonlatin")
    both = truth.join(a, "s1_id").join(b, "cand_id")
    names = both.where("name_nonlatin = 1").select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    return {"addr": resolved(mine(both.select(F.col("a1").alias("a"), F.col("a2").alias("b")))), "name": resolved(mine_aligned(names))}


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A space-joined text with its tokens replaced."""
    if not table:
        return c
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(known[t], t)), " ")


def apply(records: DataFrame, maps: dict[str, dict[str, str]]) -> DataFrame:
    """Address texts of all records, name texts of the non-Latin ones; the spaceless name follows for all."""
    name, addr = maps.get("name", {}), maps.get("addr", {})
    odd = F.col("name_nonlatin") == 1
    out = records.withColumns({c: mapped(F.col(c), addr) for c in ("addr_norm", "addr_words")} | {c: F.when(odd, mapped(F.col(c), name)).otherwise(F.col(c)) for c in ("name_norm", "name_core")})
    return out.withColumn("name_nospace", F.replace("name_core", F.lit(" "), F.lit("")))
