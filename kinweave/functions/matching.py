"""Levels of agreement between two names, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import text as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct words; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def extra_tokens(a: Column, b: Column) -> Column:
    """Distinct words that only one of the arrays has."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def phonetic_level(a: Column, b: Column) -> Column:
    """2: each array of codes lies in the other; 1: one does; 0: none, or one has no codes."""
    a, b = F.filter(a, lambda x: x != ""), F.filter(b, lambda x: x != "")
    inside = (F.size(F.array_except(a, b)) == 0).cast("int") + (F.size(F.array_except(b, a)) == 0).cast("int")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(inside)


def subset_level(a: Column, b: Column) -> Column:
    """How the shorter word sequence lies in the longer one: 2 at an edge (a single word: at the end), 1 elsewhere, 0 not at all."""
    shorter = F.size(a) <= F.size(b)
    short, long = F.when(shorter, a).otherwise(b), F.when(shorter, b).otherwise(a)
    n, m = F.size(short), F.size(long)
    prefix = F.slice(long, 1, F.greatest(n, F.lit(1))) == short
    suffix = F.slice(long, F.greatest(m - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == short
    inside = F.size(F.array_except(short, long)) == 0
    return F.when((n == 0) | (n == m) | ~inside, 0).when(suffix | (prefix & (n > 1)), 2).otherwise(1)


def type_level(mention_type: Column, entity_type: Column) -> Column:
    """3 equal, 2 unknown on a side, 1 organization against product, 0 conflict."""
    m, e = F.lower(F.coalesce(mention_type, F.lit(""))), F.lower(F.coalesce(entity_type, F.lit("")))
    vague = m.isin("", "unknown", "other") | e.isin("", "unknown", "other")
    mixed = ((m == "organization") & (e == "product")) | ((m == "product") & (e == "organization"))
    return F.when(vague, 2).when(m == e, 3).when(mixed, 1).otherwise(0)


def acronym_level(mention: Column, m_content: Column, canonical: Column, c_content: Column) -> Column:
    """1 if a short form's letters are (or end) the initials of the other name, -1 if not, 0 if neither is a short form."""

    def fits(short: Column, content: Column) -> Column:
        letters = F.replace(T.normalize(short), F.lit(" "), F.lit(""))
        return F.when(F.endswith(T.initials(content), letters), 1).otherwise(-1)

    m, c = T.is_acronym(mention), T.is_acronym(canonical)
    return F.when(m & (F.size(c_content) >= 2), fits(mention, c_content)).when(c & (F.size(m_content) >= 2), fits(canonical, m_content)).when(m | c, -1).otherwise(0)
