"""Lenient reading of a model's JSON answers, and of dates in feeds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

_ENTITY = StructType().add("mention", StringType()).add("canonical_name", StringType()).add("entity_type", StringType()).add("confidence", DoubleType())
_RELATION = StructType().add("a", StringType()).add("b", StringType()).add("relation", StringType())
EXTRACTION = StructType().add("entities", ArrayType(_ENTITY)).add("relations", ArrayType(_RELATION))


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text; braces inside strings do not count."""
    start = (text or "").find("{")
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(text or ""):
        if i < start or start < 0:
            continue
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def _field(item: dict, *keys: str) -> str | None:
    for k in keys:
        if isinstance(item.get(k), str):
            return item[k].strip() or None
    return None


def decode(text: str | None) -> dict:
    """Entities and relations of an answer: objects, arrays or plain strings; other names of fields; what is missing has defaults."""
    out: dict = {"entities": [], "relations": []}
    try:
        value = json.loads(first_object(text) or "")
    except ValueError:
        return out
    string = lambda x: x if isinstance(x, str) else None
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    for item in value.get("entities") if isinstance(value.get("entities"), list) else []:
        if isinstance(item, dict):
            got = (_field(item, "mention", "text", "name"), _field(item, "canonical_name", "canonical", "name"), _field(item, "entity_type", "type", "label"), number(item.get("confidence")))
        elif isinstance(item, list):
            padded = [*item, None, None, None, None]
            got = (string(padded[0]), string(padded[1]), string(padded[2]), number(padded[3]))
        else:
            got = (string(item), string(item), None, None)
        mention = got[0] if got[0] is not None else got[1]
        if mention is not None:
            out["entities"].append({"mention": mention, "canonical_name": got[1] if got[1] is not None else mention, "entity_type": (got[2] or "other").lower(), "confidence": min(1.0, max(0.0, 0.6 if got[3] is None else got[3]))})
    for item in value.get("relations") if isinstance(value.get("relations"), list) else []:
        if isinstance(item, dict):
            got = (_field(item, "a", "from", "subject", "source"), _field(item, "b", "to", "object", "target"), _field(item, "relation_type", "relation", "type", "predicate"))
        else:
            got = tuple(string(x) for x in item[:3]) if isinstance(item, list) and len(item) >= 3 else (None,)
        if None not in got:
            out["relations"].append(dict(zip(("a", "b", "relation"), got, strict=True)))
    return out


@F.pandas_udf(EXTRACTION)
def decode_extraction(answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(a) for a in answers], columns=["entities", "relations"])


@F.pandas_udf(StringType())
def extract_json_object(answers: pd.Series) -> pd.Series:
    return pd.Series([first_object(a) for a in answers], dtype=object)


def parse_feed_date(raw: Column) -> Column:
    """A feed's date as a timestamp (UTC where no zone is given), or null. A weekday in front is not looked at."""
    s = F.trim(raw)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(F.replace(s, F.lit(" "), F.lit("T"))))
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    compact = F.when(s.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(F.replace(s, F.lit("Z"), F.lit("")), F.lit("yyyyMMdd'T'HHmmss")))
    mail = F.regexp_replace(F.trim(F.regexp_replace(s, "^[^,]*,", "")), r" (GMT|UTC|Z)$", " +0000")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm"]
    return F.coalesce(iso, compact, day, *[F.try_to_timestamp(mail, F.lit(f)) for f in formats])


def end_of_day(as_of: Column) -> Column:
    """A point in time; a bare day means its last second, so that facts of that day count."""
    t = F.try_to_timestamp(as_of)
    return F.when(F.length(as_of) == 10, t + F.expr("INTERVAL 86399 SECONDS")).otherwise(t)


def gmst_radians(at: Column) -> Column:
    """Greenwich mean sidereal time of a timestamp, by the IAU 1982 polynomial."""
    t = (F.unix_millis(at) / 86_400_000.0 + 2_440_587.5 - 2_451_545.0) / 36_525.0
    seconds = 67_310.548_41 + (876_600.0 * 3_600.0 + 8_640_184.812_866) * t + 0.093_104 * t * t - 6.2e-6 * t * t * t
    return F.radians(F.pmod(seconds, F.lit(86_400.0)) / 240.0)


def teme_to_geo(x: Column, y: Column, z: Column, at: Column, radius: float = 6371.0) -> Column:
    """Latitude, longitude (degrees) and altitude (km) of a position in the TEME frame over a spherical earth."""
    g = gmst_radians(at)
    r = F.sqrt(x * x + y * y + z * z)
    return F.struct(F.degrees(F.asin(z / r)).alias("lat"), F.degrees(F.atan2(y * F.cos(g) - x * F.sin(g), x * F.cos(g) + y * F.sin(g))).alias("lon"), (r - radius).alias("alt_km"))
