"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are three segments of 22, 21 and 21 bits. Of two fingerprints that differ in at most two bits,
one segment is equal in both (pigeonhole) and the next one differs in at most two bits. The binary Golay code is perfect:
every 23-bit word has one codeword within three bits. A segment is decoded together with its one-bit neighbours, which gives
one or several codeword indices; two words within two bits have a common neighbour, so a common index. A key is the number
of the equal segment, its bits and an index of the next segment. Fingerprints with a common key are joined and verified.

Each fingerprint takes part once, however many documents have it. Two of a key are within two bits exactly when they have a
one-bit neighbour in common (or one is the other's). The pairs of a key with at most ``DENSE`` fingerprints are compared; a
larger key is split by those neighbours, of which each is shared by 65 fingerprints at most, and all of one key that share one
are linked. Both find the same links from the same keys; the bound only says which of them costs less.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; very long texts are
read whole; repeated rows get their own result rows; null ids never name a component unless it has no other; of rows tied in id
and text ``one_of_each`` keeps one; an empty table gives no rows; ids must be integers; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_python, small_batches, stage, unstage
from .components import components

SHINGLE, SEED, BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DENSE = 64
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def fingerprint_of(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_of(x) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return in_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id bigint, text_hash bigint, fp bigint")


def remainder(word: np.ndarray) -> np.ndarray:
    """Of 23-bit words by the generator."""
    r = word.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


@cache
def error_table() -> np.ndarray:
    """The pattern of at most three errors for each of the 2,048 remainders."""
    one = 1 << np.arange(23)
    patterns = {0, *one.tolist(), *(one[:, None] | one).ravel().tolist(), *(one[:, None, None] | one[:, None] | one).ravel().tolist()}
    word = np.array(sorted(patterns), np.int64)
    table = np.full(1 << 11, -1, np.int64)
    table[remainder(word)] = word
    return table


def decode(word: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword next to each 23-bit word."""
    return (word ^ error_table()[remainder(word)]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs, each once: key = number of the equal segment, its bits, an index of the next segment."""
    rows, keys = [], []
    word = fps.view(np.uint64)
    part = [((word >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for s in range(3):
        near = (s + 1) % 3
        flips = np.concatenate(([0], 1 << np.arange(SEGMENTS[near][1])))
        found = np.sort(decode(part[near][:, None] ^ flips), axis=1)
        first = np.concatenate((np.ones((len(fps), 1), bool), found[:, 1:] != found[:, :-1]), axis=1)
        row, column = np.nonzero(first)
        rows.append(row)
        keys.append((s << 40) | (part[s][row] << 12) | found[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                row, key = keys_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    return in_python(distinct.select("fp"), run, "key bigint, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that join all that are within ``BITS`` bits."""
    keys = stage(golay_keys(distinct), "golay")
    size = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "n")
    shared = stage(keys.join(size, F.col("key") == F.col("k")).select("key", "fp", "n"), "shared")
    thin = shared.filter(F.col("n") <= DENSE)
    a, b = thin.select("key", F.col("fp").alias("a")), thin.select(F.col("key").alias("k"), F.col("fp").alias("b"))
    near = a.join(b, (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v if v < 1 << 63 else v - (1 << 64)) for v in (1 << i for i in range(64))])
    around = shared.filter(F.col("n") > DENSE).select("key", "fp", F.explode(flips).alias("flip")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    balls = around.groupBy("key", "middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    star = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    found = stage(near.unionAll(star).distinct(), "links")
    unstage(keys, shared)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint of the component) and component_id of each row."""
    own = stage(fingerprints(docs), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = stage(distinct, "distinct")
    linked = links(distinct)
    roots = components(linked)
    found = roots.withColumnRenamed("node", "n")
    placed = distinct.join(found, F.col("fp") == F.col("n"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "placed")
    unstage(distinct, linked, roots)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of = placed.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return own.join(of, F.col("fp") == F.col("f")).select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the least id, then text hash."""
    found = near_duplicates(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    keep = found.groupBy("root").agg(F.min(rank).alias("keep")).select(F.col("keep.doc_id").alias("d"), F.col("keep.text_hash").alias("h"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    kept = packed.join(keep, same, "left_semi")
    first = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"))  # rows that are repeated as they are
    return kept.withColumn("copy", F.row_number().over(first)).filter("copy = 1").select("row.*")


def op7_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
