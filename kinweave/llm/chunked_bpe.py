"""Byte-level BPE with content-defined chunk reuse: chunks shared across documents are encoded once, then joins are repaired."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: The rolling hash: bytes it spans, its odd multiplier, and the bits that are zero at a cut (chunks of 2^11 bytes on average).
SPAN, MULTIPLIER, CUT_BITS = 32, 0x9E3779B97F4A7C15, 11
#: Chunks of fewer bytes are not worth sharing; longer ones than the most are cut.
LEAST_SHARED, LONGEST = 256, 1 << 16
#: The fixed pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a single space between such characters the pre-tokenizer always starts anew, whatever else the text holds.
SAFE = re.compile("[!-~À-ÖØ-öø-ÿ] (?=[!-~À-ÖØ-öø-ÿ])")

#: What the pattern splits in all its ways.
PROBE = "It's what they'll say, I'd think:  two  spaces\n\n\ttabs 12 345,678 ÄÖ naïve 日本語 テキスト!! ... don't (x) #1 $2.50 \u00a0nbsp ' 's'T trailing  "

_powers: dict[str, np.ndarray] = {}
_encoders: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(text: str) -> list[bytes]:
    """The text's bytes cut where the hash of the last SPAN bytes has zeros on top (and did not, a byte before), between characters."""
    raw = text.encode()
    if len(raw) <= SPAN:
        return [raw] if raw else []
    b = np.frombuffer(raw, np.uint8)
    up, down = _power(len(b))
    total = np.cumsum(b * up, dtype=np.uint64)
    span = (total[SPAN:] - total[:-SPAN]) * down[1 : len(b) - SPAN + 1]
    hit = (span >> np.uint64(64 - CUT_BITS)) == 0
    at = np.flatnonzero(hit[1:] & ~hit[:-1]) + SPAN + 2
    at = at[at < len(b)]
    at = at[(b[at] & 0xC0) != 0x80]
    edges = [0, *at.tolist(), len(raw)]
    if max(np.diff(edges)) > LONGEST:
        within = np.concatenate([np.arange(i, j, LONGEST) for i, j in zip(edges[:-1], edges[1:], strict=True)])
        while (inside := (b[within] & 0xC0) == 0x80).any():
            within = within - inside
        edges = [*within.tolist(), len(raw)]
    return [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _encoder(path: str):
    """Encodes text as the tokenizers library does with the file: the same vocabulary, merges and special tokens, in a faster encoder.

    Only for byte-level files with the fixed pattern whose ids are the order of their merges, which is checked, as is a probe text; for
    others the library itself encodes.
    """
    if path not in _encoders:
        made = tokens.load(path)
        table = tokens.token_bytes(path)
        special = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
        ranks = {raw: i for i, raw in enumerate(table) if i not in special.values()}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = made.normalizer is None and len(ranks) == len(table) - len(special) and all(len(x) == 1 for x in table[:256])
        plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain &= model.get("type") == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        _encoders[path] = library = lambda text: made.encode(text, add_special_tokens=False).ids
        if plain:
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            encode = lambda text: fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)
            if encode(PROBE) == library(PROBE):
                _encoders[path] = encode
    return _encoders[path]


def encode_chunk(text: str, encode) -> tuple[list[int], int, int, int, int]:
    """A chunk's ids, its first and last safe places (-1: none), and how many ids lie before the first and after the last."""
    ids = encode(text)
    first = SAFE.search(text)
    if first is None:
        return ids, -1, -1, 0, 0
    head = first.start() + 1
    last, reach = head, 64
    while True:
        found = [m.start() + 1 for m in SAFE.finditer(text, max(0, len(text) - reach))]
        if found or reach >= len(text):
            last = max(found[-1] if found else head, head)
            break
        reach *= 4
    return ids, head, last, len(encode(text[:head])), len(encode(text[last:]))


def encode_text(parts: list[str], known: list[tuple | None], encode) -> list[int]:
    """Ids of the whole text from its chunks; known: what encode_chunk() gave for those encoded elsewhere.

    A join is repaired by encoding anew the text over it, from the last safe place before it to one after it, and on to the next
    one: when the longer text gives the same ids and then just those that the chunk has there, the chunk's ids go on from the first
    of the two. Else the repair goes on from the second. A chunk without such places becomes part of that text as a whole.
    """
    out: list[int] = []
    over = ""  # text over the join, since the last safe place
    for k, part in enumerate(parts):
        ids, first, last, before, after = known[k] or encode_chunk(part, encode)
        if first < 0:
            over += part
            continue
        if k:
            made = encode(over + part[:first])
            for place in SAFE.finditer(part, first):
                place = place.start() + 1
                if place > last:
                    break
                if place == first:
                    continue
                upto = before + len(encode(part[first:place]))
                longer = encode(over + part[:place])
                if longer == made + ids[before:upto]:
                    break
                made, first, before = longer, place, upto
            else:
                place = last
            if place > last or first >= last:
                # no agreement within the chunk: all of it up to its last safe place has been encoded anew
                out += encode(over + part[:last])
            else:
                out += made
                out += ids[before : len(ids) - after]
        else:
            out += ids[: len(ids) - after]
        over = part[last:]
    return out + encode(over) if over else out


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs.

    Ids are those of the tokenizers library for the whole text (null: empty); ids_sha256 is of the decimal ids joined by commas,
    decoded_sha256 of the text decoded from them. Chunks found more than once in the corpus are encoded by one of the documents
    that hold them and sent to the rest; rows with a null doc_id share none. Repeated rows come out as often as they came in.
    An empty table gives an empty one.
    """
    # One key that is never null, so that both joins below read one and the same shuffle of the texts.
    none = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = [xxhash.xxh3_128_digest(c) for c in chunks(text) if len(c) >= LEAST_SHARED]
            ids += [doc] * len(own)
            hashes += own
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["key", "hash"])

    held = common.cut(rows.where(F.col("key") != none).mapInArrow(common.by_batch(index), "key long, hash binary"))
    shared = common.cut(held.groupBy("hash").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    owners = shared.groupBy(F.col("owner").alias("key")).agg(F.collect_list("hash").alias("hashes"))

    def encode_shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, cols = _encoder(tokenizer), [[] for _ in range(6)]
        width = "<u2" if len(tokens.token_bytes(tokenizer)) <= 1 << 16 else "<u4"
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left = set(wanted)
            for c in chunks(text):
                if len(c) >= LEAST_SHARED and (h := xxhash.xxh3_128_digest(c)) in left:
                    left.discard(h)
                    ids, *rest = encode_chunk(c.decode(), encode)
                    for col, v in zip(cols, (h, np.array(ids, width).tobytes(), *rest), strict=True):
                        col.append(v)
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), *[pa.int32()] * 4), strict=True)], names=["hash", "ids", "first", "last", "before", "after"])

    made = rows.join(owners.hint("shuffle_merge"), "key").select("text", "hashes").mapInArrow(common.by_batch(encode_shared), "hash binary, ids binary, first int, last int, before int, after int").dropDuplicates(["hash"])
    got = held.distinct().join(made, "hash").groupBy("key").agg(F.collect_list(F.struct("hash", "ids", "first", "last", "before", "after")).alias("known"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, table = _encoder(tokenizer), tokens.token_bytes(tokenizer)
        small = len(table) <= 1 << 16
        decimal = _encoders.setdefault(("decimal", len(table)), [str(i) for i in range(len(table))])
        out: list[list] = [[], [], []]
        for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cut = chunks(text)
            sent = {k["hash"]: (np.frombuffer(k["ids"], "<u2" if small else "<u4").tolist(), k["first"], k["last"], k["before"], k["after"]) for k in known or ()}
            ready = [sent.get(xxhash.xxh3_128_digest(c)) if sent and len(c) >= LEAST_SHARED else None for c in cut]
            ids = encode_text([c.decode() for c in cut], ready, encode)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
            out[2].append(hashlib.sha256(b"".join([table[i] for i in ids]).decode("utf-8", "replace").encode()).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    whole = rows.join(got.hint("shuffle_merge"), "key", "left").select(F.nullif("key", none).alias("doc_id"), "text", "known")
    return whole.mapInArrow(common.by_batch(finish), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
