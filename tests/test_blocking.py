import random
import time

from pyspark.sql import functions as F

from kinweave.operators import blocking


def brute_candidates(mentions, entities, most):
    """Every mention against every entity: the `most` with most keys in common, ties to the smaller id."""
    out = set()
    for m, ks in mentions.items():
        hits = sorted((-len(ks & es), e) for e, es in entities.items() if ks & es)
        out |= {(m, e, -h) for h, e in hits[:most]}
    return out


def test_candidates_by_hot_keys(spark):
    """Keys that many names share: the rows are those of all pairs, and the joins make far fewer."""
    rng = random.Random(5)
    names = lambda tag, n: {f"{tag}{i:04d}": {f"k{int(rng.random() ** 3 * 12)}" for _ in range(rng.randint(1, 4))} | {f"w{rng.randint(0, 150)}"} for i in range(n)}
    m, e = names("m", 150), names("e", 300)
    frame = lambda d, c: spark.createDataFrame([(i, "token", k) for i, ks in d.items() for k in sorted(ks)], f"{c} string, key_type string, key string")
    for most in (3, 50):
        got = {(r.mention_id, r.entity_id, r.hits) for r in blocking.candidates(frame(m, "mention_id"), frame(e, "entity_id"), most).collect()}
        assert got == brute_candidates(m, e, most)
    # 20,000 names of one key each way: 400 million pairs, if they were made.
    many = spark.range(20_000).select(F.format_string("%05d", "id").alias("entity_id"), F.lit("phon").alias("key_type"), F.lit("ANTN").alias("key"))
    began = time.time()
    top = blocking.candidates(many.withColumnRenamed("entity_id", "mention_id"), many, 50)
    assert top.agg(F.count("*"), F.max("entity_id")).first() == (1_000_000, "00049") and time.time() - began < 60
