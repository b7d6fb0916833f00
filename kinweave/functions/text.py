"""Text functions as Column builders: all of them stay in the JVM."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from kinweave import vocab

ALNUM = r"\p{IsAlphabetic}\p{N}"
NAME_PATTERN = r"(?U)\b([A-Z][a-zA-Z0-9&\-]*(?:\s+[A-Z][a-zA-Z0-9&\-]*){0,3})\b"


def strings(words: list[str]) -> Column:
    """An array literal."""
    return F.array(*[F.lit(w) for w in words])


def normalize(name: Column) -> Column:
    """Lower case, '&' as a word, all but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), f"[^{ALNUM}]+", " "))


def tokens(norm: Column) -> Column:
    """Words of a normalised name."""
    return F.filter(F.split(norm, r"\s+"), lambda t: t != "")


def content_tokens(norm: Column) -> Column:
    """Words without company suffixes and fillers, or all words if nothing else is left."""
    words = tokens(norm)
    kept = F.filter(words, lambda t: ~t.isin(*vocab.IGNORABLE))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def ascii_fold(name: Column) -> Column:
    """Latin letters without their marks; what else is not ASCII goes."""
    source, target = "".join(vocab.FOLD), "".join(t * len(s) for s, t in vocab.FOLD.items())
    return F.regexp_replace(F.translate(F.replace(name, F.lit("ß"), F.lit("ss")), source, target), r"[^\x00-\x7F]", "")


def is_acronym(name: Column) -> Column:
    """Short forms such as FTC, U.S. or H100: at least two letters, at most seven bytes, nothing in lower case."""
    t = F.trim(name)
    letters = F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}]", ""))
    return (letters >= 2) & (F.octet_length(t) <= 7) & t.rlike(r"^[\p{IsUppercase}0-9.&]+$")


def initials(content: Column) -> Column:
    """First letters of words."""
    return F.array_join(F.transform(content, lambda t: F.left(t, F.lit(1))), "")


def is_generic(text: Column) -> Column:
    """No capital letter and no digit: a common noun."""
    return ~text.rlike(r"[\p{IsUppercase}0-9]")


def plausible_name(text: Column, kind: Column) -> Column:
    """Whether a string looks like a name rather than a description. kind: the entity type."""
    t = F.trim(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    low = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    all_caps = ~t.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")
    filler = F.forall(words, lambda w: F.lower(w).isin(*vocab.IGNORABLE))
    counted = F.filter(words, lambda w: ~F.lower(w).isin(*vocab.CONNECTORS))
    capital = F.size(F.filter(counted, lambda w: w.rlike(r"[\p{IsUppercase}0-9]")))
    lower = F.size(counted) - capital
    first = F.get(words, F.lit(0))
    clause = F.lit(False)
    for marker in vocab.CLAUSE_MARKERS:
        clause = clause | low.contains(marker)
    bad = (
        (F.length(t) == 0) | (F.length(t) > 80)
        | ((n == 1) & F.lower(t).isin(*vocab.GENERIC_SINGLE))
        | (filler & ~((n == 1) & all_caps & (kind == "location")))
        | (n > 10) | ((kind == "other") & (n >= 4))
        | ((n > 1) & F.lower(first).isin(*vocab.LEADING_DETERMINERS) & first.rlike(r"^\p{IsLowercase}"))
        | clause
        | ((kind == "other") & (low.contains(" and ") | low.contains(" & ")))
        | ((n >= 2) & ((lower > capital) | ((n > 7) & (lower > 0))))
    )
    return F.coalesce(~bad, F.lit(False))


def clean_mention(raw: Column) -> Column:
    """A raw span without outer marks, leading conjunctions and articles, and possessive endings."""
    s = F.regexp_replace(F.regexp_replace(raw, rf"^[^{ALNUM}$&]+", ""), rf"[^{ALNUM}$&]+$", "")
    s = F.regexp_replace(s, rf"(?i)^(?:(?:{'|'.join(vocab.LEADING_WORDS)}) \s*(?=.))+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "'s$", ""), "’s$", ""))


def split_sentences(text: Column) -> Column:
    """Sentences with their end marks; a mark or line end counts before white space or at the end of the text."""
    return F.filter(F.split(text, r"(?<=[.!?\n])(?=[ \t\n\x0B\f\r]|\z)"), lambda s: s != "")


def chunk_text(text: Column, most: int = 1200) -> Column:
    """Sentences packed in order into chunks of at most `most` characters (a longer sentence stays whole): array of (start, chunk)."""
    state = F.struct(F.array().cast("array<struct<start:int,chunk:string>>").alias("done"), F.lit("").alias("current"), F.lit(0).alias("at"), F.lit(0).alias("pos"))

    def add(acc: Column, sentence: Column) -> Column:
        full = (F.length(acc["current"]) > 0) & (F.length(acc["current"]) + F.length(sentence) > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["at"].alias("start"), acc["current"].alias("chunk"))))).otherwise(acc["done"])
        fresh = full | (F.length(acc["current"]) == 0)
        return F.struct(done.alias("done"), F.when(fresh, sentence).otherwise(F.concat(acc["current"], sentence)).alias("current"), F.when(fresh, acc["pos"]).otherwise(acc["at"]).alias("at"), (acc["pos"] + F.length(sentence)).alias("pos"))

    end = lambda acc: F.filter(F.concat(acc["done"], F.array(F.struct(acc["at"].alias("start"), acc["current"].alias("chunk")))), lambda c: F.length(F.regexp_replace(c["chunk"], r"\s+", "")) > 0)
    return F.aggregate(split_sentences(text), state, add, end)


def html_to_text(html: Column) -> Column:
    """The readable lines of a page: containers and tags gone, entities decoded in order, lines of at least 80 characters."""
    s = html
    for tag in vocab.CONTAINERS:
        s = F.regexp_replace(F.regexp_replace(s, f"(?is)<{tag}.*?</{tag}>", " "), f"(?is)<{tag}.*$", "")
    s = F.regexp_replace(s, rf"(?i)<(?:[^>]*<)?/*(?:{'|'.join(vocab.BLOCK_TAGS)})(?:[^\p{{L}}\p{{N}}/<>][^<>]*)?>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), "<[^>]*$", "")
    for entity, char in vocab.ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) >= vocab.LEAST_BLOCK), "\n")


def strip_tags(html: Column) -> Column:
    """Text without tags, white space collapsed; entities stay."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(html, "<[^>]*>?", " "), F.lit(">"), F.lit("")), r"\s+", " "))


def normalize_relation(name: Column) -> Column:
    """A relation's name in lower case with single underscores, at most 48 characters."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(name)), f"[^{ALNUM}]+", "_"), F.lit("_"))
    return F.when(s == "", "related_to").otherwise(F.left(s, F.lit(48)))


def contains_word(text: Column, word: Column) -> Column:
    """Whether word stands in text with no letter or digit next to it."""
    return F.regexp_like(text, F.concat(F.lit(rf"(?<![{ALNUM}])\Q"), word, F.lit(rf"\E(?![{ALNUM}])")))


def question_words(question: Column) -> Column:
    """Words of a question; apostrophes and hyphens belong to words."""
    return F.filter(F.split(F.lower(question), rf"[^{ALNUM}'\-]+"), lambda w: w != "")


def ngrams(words: Column, k: Column) -> Column:
    """Runs of k words, joined by spaces."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def relation_intents(question: Column) -> Column:
    """Relation types that a question's wording asks for, in order and without repeats; cues match inside words too."""
    q, parts = F.lower(question), []
    for cues, types in vocab.INTENTS:
        hit = F.lit(False)
        for c in cues:
            hit = hit | q.contains(c)
        parts.append(F.when(hit, strings(types)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def citation_count(text: Column) -> Column:
    """How often [digits] stands in the text."""
    return F.regexp_count(text, F.lit(r"\[[0-9]+\]"))


WARNING = "⚠ UNVERIFIED — the model cited no sources; treat every claim below as unconfirmed.\n\n"


def flag_uncited(text: Column, source_refs: Column) -> Column:
    """The text, with a warning in front if it cites neither a number nor a source's address."""
    url = F.exists(source_refs, lambda u: (F.octet_length(u) > 12) & text.contains(u))
    return F.when((citation_count(text) == 0) & ~url, F.concat(F.lit(WARNING), text)).otherwise(text)


_SPAN = re.compile(r"\b[A-Z][a-zA-Z0-9&\-]*(?:\s+[A-Z][a-zA-Z0-9&\-]*){0,3}\b")
SPANS = ArrayType(StructType().add("text", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("score", DoubleType()))


def find_mentions(text: str | None, score: float = 0.3) -> list[dict]:
    """Capitalised spans of up to four words with their places in characters: the first of each by lower case, single words of three
    bytes or more."""
    out: dict[str, dict] = {}
    for m in _SPAN.finditer(text or ""):
        span = m.group()
        if len(span.encode()) >= 3 or any(c.isspace() for c in span):
            out.setdefault(span.lower(), {"text": span, "start": m.start(), "end": m.end(), "score": score})
    return list(out.values())


@F.arrow_udf(SPANS)
def mentions(texts: pa.Array) -> pa.Array:
    """find_mentions() over a column. Spark's regular expressions tell what matches, not where; hence Arrow batches."""
    found = [find_mentions(t) for t in texts.to_pylist()]
    flat = [m for ms in found for m in ms]
    kinds = {"text": pa.string(), "start": pa.int32(), "end": pa.int32(), "score": pa.float64()}
    values = pa.StructArray.from_arrays([pa.array([m[k] for m in flat], t) for k, t in kinds.items()], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), values)


def mention_texts(text: Column) -> Column:
    """The distinct spans of mentions() by lower case, without their places."""
    found = F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda m: m.rlike(r"\s") | (F.octet_length(m) >= 3)), lambda m: F.lower(m)))
