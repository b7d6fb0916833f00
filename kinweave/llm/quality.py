"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source replace fixed cutoffs.

DataFrame functions only. A sketch is a histogram of whole numbers in bins of under 1.6 % relative width (about 450 for each factor of eight
beyond 1,024), so sketches merge by adding counts, in any order and with one result; sources merge into languages and into the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = "[\\x20\\x09-\\x0D]+"
#: Fixed rules that come first: fewest words, and the share of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules by metric: least distance of the threshold from the median, in the metric's unit; whether low values fail too.
RULES = {"word_length": (100, True), "symbols": (100, False), "duplicate_lines": (340, False), "repetition": (200, False)}
#: A threshold lies so many interquartile ranges from the median; sketches of fewer documents give way to their language's, then to the whole's.
RANGES, LEAST_DOCS = 4, 100
#: Groups up to which the thresholds are broadcast (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to rows with a `text` (null: none)."""
    spaces = " \t\n\x0b\x0c\r"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("__text", text)
    df = df.withColumn("__words", F.filter(F.split("__text", SPACE), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    # Three-word windows by hash, sorted: windows found twice or more lie side by side.
    window = lambda w, i: F.struct(F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("__windows", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.slice("__words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), window))))
    twice = F.filter("__windows", lambda e, j: e["h"].eqNullSafe(F.get("__windows", j - 1)["h"]) | e["h"].eqNullSafe(F.get("__windows", j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return (
        df.withColumn("word_chars", F.length(F.translate("__text", spaces, "")).cast("long"))
        .withColumn("n_symbols", (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
        .drop("__text", "__words", "__lines", "__windows")
    )


def base_failed() -> Column:
    """The fixed rules, over measured() columns."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole-number metrics by rule: hundredths of characters a word; thousandths of symbols a word, of duplicate lines, of repeated words."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    whole = lambda n, d: F.floor(n / d).cast("long")
    return {"word_length": whole(100 * F.col("word_chars"), words), "symbols": whole(1000 * F.col("n_symbols"), words), "duplicate_lines": whole(1000 * F.col("n_dup_lines"), lines), "repetition": whole(1000 * F.col("n_repeat_words"), words)}


#: Steps of the bins: below the first number every whole number has its own, below each next one they are so wide. Metrics of texts of any
#: length Spark can hold lie below the last step.
BINS = [(1 << (13 + 3 * k), 16 << (3 * k)) for k in range(12)]


def bin_of(v: Column) -> Column:
    """The sketch's bin, named by its lower end."""
    out = F.when(v < 1024, v)
    for below, width in BINS:
        out = out.when(v < below, v - v % width)
    return out.otherwise(v - v % BINS[-1][1])


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): the sketch of each rule for each language and source, over rows that pass the fixed rules."""
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), bin_of(m).alias("bin")) for rule, m in metrics().items()])).alias("m")
    return rows.where(~base_failed()).select("lang", "source", each).groupBy("lang", "source", "m.rule", "m.bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high): what metrics may be, for each language and source of the sketches."""
    levels = {2: ["lang", "source"], 1: ["lang"], 0: []}
    marks = []
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "rule")
        ranked = merged.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
        at = lambda quarter: F.min(F.when(F.col("below") * 4 >= F.col("all") * quarter, F.col("bin")))
        marks.append(ranked.groupBy(*keys, "rule").agg(F.max("all").alias(f"n{level}"), F.struct(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3")).alias(f"q{level}")))
    own, language, whole = marks
    joined = own.join(language, ["lang", "rule"]).join(whole, "rule")
    q = F.when(F.col("n2") >= LEAST_DOCS, F.col("q2")).when(F.col("n1") >= LEAST_DOCS, F.col("q1")).otherwise(F.col("q0"))
    least = F.element_at(F.create_map(*[F.lit(x) for rule, (slack, _) in RULES.items() for x in (rule, slack)]), F.col("rule"))
    joined = joined.withColumn("q", q).withColumn("reach", F.greatest((F.col("q.q3") - F.col("q.q1")) * RANGES, least.cast("long")))
    pick = lambda rule, value: F.max(F.when(F.col("rule") == rule, value))
    cols = []
    for rule, (_, low) in RULES.items():
        cols.append(pick(rule, F.col("q.q2") + F.col("reach")).alias(f"{rule}_high"))
        cols += [pick(rule, F.col("q.q2") - F.col("reach")).alias(f"{rule}_low")] if low else []
    return joined.groupBy("lang", "source").agg(*cols)


def verdicts(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to measured rows whose group is in __lang and __source."""
    limits = common.cut(limits.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source"))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = rows.join(limits, ["__lang", "__source"], "left")
    within = F.lit(True)
    for rule, m in metrics().items():
        within = within & F.coalesce(m <= F.col(f"{rule}_high"), F.lit(True))
        if RULES[rule][1]:
            within = within & F.coalesce(m >= F.col(f"{rule}_low"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    A null text has no words and fails the fixed rules; a null language or source counts as an empty one. Repeated rows count each.
    An empty table gives an empty one.
    """
    narrow = docs.select("doc_id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in ("lang", "source")])
    rows = common.cut(measured(narrow).drop("text"))
    limits = thresholds(common.cut(sketches(rows.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *[c for c in rows.columns if c[0] != "_"]))))
    return verdicts(rows, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs; measured once, and written with their texts until the thresholds are known."""
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    place = {c: names[columns.index(c)] for c in ("text", "lang", "source")}
    whole = whole.select("*", F.col(place["text"]).alias("text"), *[F.coalesce(F.col(place[c]).cast("string"), F.lit("")).alias(f"__{c}") for c in ("lang", "source")])
    held = common.stash(measured(whole).drop("text"), "quality")
    limits = thresholds(common.cut(sketches(held.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))))
    return verdicts(held, limits).where("kept").select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])
