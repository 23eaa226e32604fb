"""Normalisation of names and addresses as column expressions.

Accented Latin letters fold natively.  Indic scripts need ``transliterated``, an Arrow function built
from Unicode's character names; ``normalise(..., indic=True)`` adds it.  Latin folding comes from
canonical decompositions and covers letters, not symbols such as currency signs.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import vocabulary as V

#: Latin letters without a canonical decomposition, by what they are written as.
WIDE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
NARROW = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "’": "'", "‘": "'"}


def _accents() -> tuple[str, str]:
    pairs = dict(NARROW)
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(i))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(i)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def folded(c: Column) -> Column:
    """Latin letters without accents; ASCII stays as it is."""
    out = c
    for a, b in WIDE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(out, ACCENTED, PLAIN))


_letters: dict[str, str] = {}


def _letter(ch: str) -> str:
    """Romanised form of one Indic character from its Unicode name; consonants carry 'a' until a vowel sign or virama."""
    if ch not in _letters:
        name = unicodedata.name(ch, "")
        m = re.search(r"(LETTER|VOWEL SIGN|DIGIT|SIGN) (.+)$", name)
        out = ""
        if m:
            kind, what = m.groups()
            if kind == "DIGIT":
                out = str(unicodedata.digit(ch))
            elif kind == "VOWEL SIGN" or kind == "LETTER":
                out = what.split()[-1].lower()
            elif what in ("ANUSVARA", "CANDRABINDU"):
                out = "n"
            elif what == "VISARGA":
                out = "h"
        _letters[ch] = out
    return _letters[ch]


def transliterate(s: str) -> str:
    """Indic text in Latin letters, squashed; other characters stay."""
    out: list[str] = []
    indic = False
    for ch in s:
        if "ऀ" <= ch <= "෿":
            indic = True
            name = unicodedata.name(ch, "")
            if "VIRAMA" in name or "AL-LAKUNA" in name:
                if out and out[-1].endswith("a"):
                    out[-1] = out[-1][:-1]
            elif "VOWEL SIGN" in name and out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1] + _letter(ch)
            else:
                out.append(_letter(ch))
        else:
            out.append(ch)
    return squash("".join(out)) if indic else s


def squash(s: str) -> str:
    """Long vowels and doubled consonants once; a single pass over each."""
    s = s.replace("N", "n").replace("'", "")
    for v in "aiueo":
        s = s.replace(v + v, v)
    return re.sub(r"([bcdfghjklmnpqrstvwxyz])\1", r"\1", s)


def transliterated(c: Column) -> Column:
    def each(s: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() else transliterate(x) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def joined(tokens: Column, sep: str = " ") -> Column:
    return F.array_join(tokens, sep)


def split_tokens(c: Column) -> Column:
    """Tokens of a space-joined string; none of an empty one."""
    return F.array_remove(F.split(c, " "), "")


def _dictionary(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def basic_tokens(c: Column) -> Column:
    """Marks out, accents folded, lower case, signs as words, numbers without leading zeros, abbreviations expanded."""
    s = F.lower(folded(F.regexp_replace(c, V.MARKS, " ")))
    s = F.regexp_replace(F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus ")), "[^a-z0-9]+", " ")
    number = F.transform(split_tokens(s), lambda t: F.regexp_replace(t, "^0+(?=[0-9]+$)", ""))
    known = _dictionary(V.ABBREVIATIONS)
    return F.flatten(F.transform(number, lambda t: F.when(t.isin(*V.ABBREVIATIONS), F.split(known[t], " ")).otherwise(F.array(t))))  # a hashed test before the map


def name_columns(raw: Column) -> dict[str, Column]:
    """name_norm, name_core, name_nospace, is_domain, name_nonlatin."""
    stem, tokens, core = F.col("_stem"), F.col("_name_tokens"), F.col("_core")
    is_domain = stem != ""
    core = F.when(F.size(core) > 0, core).otherwise(tokens)
    pick = lambda plain: F.when(is_domain, stem).otherwise(plain)
    return {
        "name_norm": pick(joined(tokens)),
        "name_core": pick(joined(core)),
        "name_nospace": pick(joined(core, "")),
        "is_domain": is_domain.cast("int"),
        "name_nonlatin": raw.rlike(V.NON_LATIN).cast("int"),
    }


def address_columns(raw: Column) -> dict[str, Column]:
    """addr_norm, addr_words, addr_nums, house_num, addr_empty."""
    tokens = F.col("_addr_tokens")
    numbers = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))))
    words = F.filter(tokens, lambda t: t.rlike("^[a-z]{2,}$") & ~t.isin(*V.ADDRESS_STOP))
    parts = F.transform(F.split(raw, ","), lambda p: F.regexp_extract(F.regexp_replace(F.lower(stripped(p)), V.HOUSE_MARKER, ""), V.HOUSE_NUMBER, 1))
    house = F.coalesce(F.try_element_at(F.filter(parts, lambda p: p != ""), F.lit(1)), F.lit(""))
    blank = stripped(raw) == ""
    pick = lambda c: F.when(blank, F.lit("")).otherwise(c)
    return {
        "addr_norm": pick(joined(tokens)),
        "addr_words": pick(joined(words)),
        "addr_nums": pick(joined(numbers)),
        "house_num": pick(F.regexp_replace(house, "^0+(?=[0-9]+$)", "")),
        "addr_empty": blank.cast("int"),
    }


def normalise(records: DataFrame, indic: bool = False) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) with the ten normalised columns and src."""
    records = records.fillna("", ["business_name", "business_address"])
    if indic:
        records = records.withColumns({"_name": transliterated(F.col("business_name")), "_addr": transliterated(F.col("business_address"))})
    name, addr = (F.col("_name"), F.col("_addr")) if indic else (F.col("business_name"), F.col("business_address"))
    bare = F.replace(F.lower(stripped(F.col("business_name"))), F.lit(" "), F.lit(""))
    stem = F.replace(F.regexp_extract(bare, V.DOMAIN, 1), F.lit("-"), F.lit(""))
    out = records.withColumns({"_name_tokens": basic_tokens(name), "_addr_tokens": basic_tokens(addr), "_stem": stem})
    out = out.withColumn("_core", F.filter("_name_tokens", lambda t: ~t.isin(*V.LEGAL_SUFFIXES)))
    out = out.withColumns(name_columns(F.col("business_name")) | address_columns(addr) | {"src": F.substring("entity_id", 1, 2)})
    return out.drop("_name_tokens", "_addr_tokens", "_name", "_addr", "_stem", "_core")
