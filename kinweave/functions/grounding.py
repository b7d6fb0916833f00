"""Whether a text supports a relation between two names."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from kinweave import vocab


def grounded(text: Column, mention: Column) -> Column:
    """The trimmed mention, of two bytes or more, occurs in the text, whatever the case."""
    m = F.lower(F.trim(mention))
    return (F.octet_length(m) >= 2) & F.lower(text).contains(m)


def occurring_name(text: Column, names: Column) -> Column:
    """The first of an array of names that occurs in the text."""
    return F.get(F.filter(names, lambda n: (F.octet_length(n) >= 2) & F.lower(text).contains(F.lower(n))), F.lit(0))


def types_ok(relation: Column, a: Column, b: Column) -> Column:
    """Whether a relation may hold between entities of two types."""
    placed = lambda t: t.isin("location", "event")
    bad = relation.isin(*vocab.ROLE_RELATIONS) & ~a.isin("person", "other")
    bad = bad | (relation.isin(*vocab.NO_PERSON_OBJECT) & (b == "person"))
    bad = bad | (relation.isin(*vocab.DEALS) & (placed(a) | placed(b) | (a == "person")))
    return ~(bad | (relation.isin(*vocab.PLACED) & ~b.isin("location", "other")))


_END = re.compile(rb"\n|[.!?](?=[ \t\n\x0c\r]|\Z)")


class Grounds:
    """A text in lower case as bytes; places of names and ends of sentences are found once."""

    def __init__(self, text: str):
        self.raw, self.known, self.ends = text.lower().encode(), {}, None

    def places(self, name: bytes) -> list[int]:
        """Where a name of two bytes or more begins, without overlaps."""
        if name not in self.known:
            out, at = [], self.raw.find(name) if len(name) >= 2 else -1
            while at >= 0:
                out.append(at)
                at = self.raw.find(name, at + len(name))
            self.known[name] = out
        return self.known[name]

    def bounds(self, at: int) -> tuple[int, int]:
        """Bytes of the sentence around a place: from after the last end mark to the next one."""
        if self.ends is None:
            self.ends = [m.start() for m in _END.finditer(self.raw)]
        i = bisect_left(self.ends, at)
        return self.ends[i - 1] + 1 if i else 0, self.ends[i] if i < len(self.ends) else len(self.raw)

    def nearest(self, x: bytes, y: bytes) -> tuple[int, int] | None:
        """The nearest places of two names that are within PROXIMITY; of equals the first ones."""
        ours, theirs = self.places(x), self.places(y)
        best, found = vocab.PROXIMITY + 1, None
        for p in ours if theirs else []:
            j = bisect_left(theirs, p)
            for q in theirs[max(j - 1, 0) : j + 1]:
                if abs(p - q) < best:
                    best, found = abs(p - q), (p, q)
        return found

    def near_and_cued(self, a: str, b: str, relation: str) -> bool:
        x, y = a.strip().lower().encode(), b.strip().lower().encode()
        if not x or not y or x == y or (found := self.nearest(x, y)) is None:
            return False
        words = vocab.CUES_OF.get(relation)
        if words is None:
            return True
        (low_a, high_a), (low_b, high_b) = self.bounds(found[0]), self.bounds(found[1])
        if relation in vocab.SAME_SENTENCE and low_a != low_b:
            return False
        window = self.raw[min(low_a, low_b) : max(high_a, high_b)]
        return any(w.encode() in window for w in words)


def sentence_bounds(text: bytes, at: int) -> tuple[int, int]:
    """Bytes of the sentence around a place: from after the last end mark to the next one."""
    return Grounds(text.decode()).bounds(at)


def near_and_cued(text: str, a: str, b: str, relation: str) -> bool:
    """Both names stand within PROXIMITY bytes, and their sentences hold a word that the relation needs, if it needs one."""
    return Grounds(text).near_and_cued(a, b, relation)


@F.pandas_udf(BooleanType())
def _near(text: pd.Series, a: pd.Series, b: pd.Series, relation: pd.Series) -> pd.Series:
    return pd.Series([None not in row and near_and_cued(*row) for row in zip(text, a, b, relation, strict=True)])


@F.arrow_udf(ArrayType(BooleanType()))
def near_each(text: pa.Array, a: pa.Array, b: pa.Array, relation: pa.Array) -> pa.Array:
    """near_and_cued() of a text for arrays of names and relations, so that a text goes to Python once for all of its pairs."""
    out = []
    for t, *lists in zip(text, a, b, relation, strict=True):
        g = Grounds(t.as_py() or "")
        out.append([None not in row and g.near_and_cued(*row) for row in zip(*(x.as_py() or [] for x in lists), strict=True)])
    return pa.array(out, pa.list_(pa.bool_()))


def relation_grounded(text: Column, a: Column, b: Column, relation: Column, type_a: Column, type_b: Column) -> Column:
    """Types fit and the text has both names near each other with the words that the relation needs."""
    return types_ok(relation, type_a, type_b) & _near(text, a, b, relation)
