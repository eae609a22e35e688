"""Token files: ids compressed per document with one shared zstandard dictionary.

Layout of a token file set (two Parquet tables, so any store that Spark writes will do):

* ``dictionary``: dict_hash (SHA-256 of the dictionary's bytes), dictionary, id_bytes (2 or 4).
* ``blocks``: shard, block, dict_hash, payload (the documents' zstandard frames back to back) and, position by position,
  the offset index: doc_ids, offsets (where a frame starts; one more gives the end), counts (ids in it); first_id and last_id
  bound the ids, so that a search by id skips blocks.

A short document is read by one slice of one payload. Shards are id ranges in ascending order. The dictionary is trained on
the serialized ids of at most ``SAMPLE`` documents, those with the least hashes of their ids (copies under one id count once),
from each a stretch of ``SAMPLE_IDS`` ids at a hashed place; that bounds the fit alone, everything is encoded whole.

Defined cases: a null text is an empty one and gets the end id only; repeated rows get their own frames; null ids come first;
an empty table gives empty files; very long texts are one frame; ids that aren't numbers are an error, other columns aren't
read; too few samples to train on give an unstructured dictionary or none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_python, new_path, partitions_for, small_batches

SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 600, 4096, 64 * 1024
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 4096
CACHE_UNITS = 1 << 19
LEVEL = 3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """A table of units: open addressing by a 64-bit hash in arrays, so a batch of units is looked up in a few vector steps.

    The hash is a sum of random numbers for the bytes times a power of the place. The bytes are kept too, and ``same`` tells
    whether what was found is what was asked for.
    """

    def __init__(self, dtype: np.dtype, bits: int):
        r = np.random.default_rng(20)
        self.values = r.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
        self.step = 0x9E3779B97F4A7C15
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.bits, self.dtype = bits, dtype
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.key = np.zeros(n, np.uint64)
        self.start, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.begin, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used, self.size = np.zeros(1 << 16, self.dtype), 0, 0
        self.raw, self.filled = np.zeros(1 << 16, np.uint8), 0

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(raw):
            n = 1 << len(raw).bit_length()
            back = pow(self.step, -1, 1 << 64)
            self.powers, self.inverse = np.full(n, self.step, np.uint64), np.full(n, back, np.uint64)
            for x in (self.powers, self.inverse):
                x[0] = 1
                np.cumprod(x, out=x)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverse[starts] | np.uint64(1)  # nought is an empty place

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of the units, -1 for those that aren't there."""
        at, mask = self._slot(key), (1 << self.bits) - 1
        left = np.nonzero(self.key[at] != key)[0]
        while len(left):
            empty = self.key[at[left]] == 0
            at[left[empty]] = -1
            left = left[~empty]
            at[left] = (at[left] + 1) & mask
            left = left[self.key[at[left]] != key[left]]
        return at

    def add(self, key: np.ndarray, units: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """New units, each key once."""
        text, sizes = np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.filled + len(text) > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.raw[self.filled : self.filled + len(text)] = text
        start, begin = self.used + np.cumsum(counts) - counts, self.filled + np.cumsum(sizes) - sizes
        at, mask = self._slot(key), (1 << self.bits) - 1
        left = np.arange(len(key))
        while len(left):
            free = left[self.key[at[left]] == 0]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[put]] = key[put]
            self.start[at[put]], self.count[at[put]] = start[put], counts[put]
            self.begin[at[put]], self.length[at[put]] = begin[put], sizes[put]
            left = left[self.key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & mask
        self.used += len(ids)
        self.filled += len(text)
        self.size += len(key)

    def same(self, at: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Are the units at these places, byte for byte, the ones that make up ``raw``?"""
        sizes = ends - starts
        if (self.length[at] != sizes).any():
            return False
        return bool((self.raw[np.repeat(self.begin[at] - starts.astype(np.int32), sizes) + np.arange(len(raw), dtype=np.int32)] == raw).all())

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units at these places, one after the other, and where each unit ends."""
        counts = self.count[at].astype(np.int64)
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Encodes whole texts with the tokenizers library, a unit at a time.

    The byte-level pattern starts a piece at every space that stands between two characters other than white space, and
    makes such a line break a piece of its own. So the units in between can be encoded apart and remembered, up to
    ``CACHE_UNITS``. New units are encoded many in one text and cut by the bytes of their ids. What comes out of the table is
    compared with the text byte for byte; if it isn't the same, the texts are encoded whole. So are texts in which an added
    token of the tokenizer, such as its end mark, is spelled out: the library finds those before it cuts pieces.
    """

    SINGLE = re.compile(r"(?<=\S)([ \n])(?=\S)")
    #: White space other than blank and line break, and what else sends a text the slower way.
    RARE = "\x02\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    RARE_PAIRS = ("  ", " \n", "\n ", "\n\n")
    GROUP_BYTES = 192 * 1024

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a byte-level token has a character for each byte
        self.end = np.zeros(1, self.dtype)
        self.units = Units(self.dtype, (2 * CACHE_UNITS - 1).bit_length())

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in self.RARE_PAIRS) and not any(c in text for c in self.RARE)

    def _parts(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units without white space but for a space before, and how many each has."""
        led = [u if u[:1] == b" " else b"\n" + u for u in units]
        ids = self._encode([b"".join(led).decode()])[0]
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(u) for u in led])
        at = np.searchsorted(ends, wanted)
        if at[-1] < len(ends) and (ends[at] == wanted).all():
            extra = np.array([v is not u for u, v in zip(units, led, strict=True)])
            first = np.concatenate(([0], at[:-1] + 1))
            keep = np.ones(len(ids), bool)
            keep[first[extra]] = False  # the line breaks
            return ids[keep], at + 1 - first - extra
        each = self._encode([u.decode() for u in units])
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> None:
        _, once = np.unique(key, return_index=True)
        units = [raw[a:z] for a, z in zip(starts[once].tolist(), ends[once].tolist(), strict=True)]
        ids, counts = [], []
        single = {b"\x02": self.end, b"\n": None}
        simple = [u for u in units if u not in single]
        for i in range(0, len(simple), 256):
            x, n = self._parts(simple[i : i + 256])
            ids.append(x)
            counts.append(n)
        order = [i for i, u in enumerate(units) if u not in single]
        for i, u in enumerate(units):
            if u in single:
                order.append(i)
                ids.append(self.end if u == b"\x02" else self._encode(["\n"])[0])
                counts.append(np.array([len(ids[-1])]))
        at = once[order]
        self.units.add(key[at], [units[i] for i in order], np.concatenate(ids), np.concatenate(counts))

    def _group(self, texts: list[str]) -> list[bytes]:
        raw = "\x02".join([*texts, ""]).encode()
        data = np.frombuffer(raw, np.uint8)
        alone = (data == 10) | (data == 2)
        begins = alone | (data == 32)
        begins[1:] |= alone[:-1]
        begins[0] = True
        starts = np.nonzero(begins)[0]
        ends = np.append(starts[1:], len(data))
        key = self.units.hashes(data, starts, ends)
        at = self.units.find(key)
        if (at < 0).any():
            if self.units.size > CACHE_UNITS:
                self.units.clear()
                at[:] = -1
            new = np.nonzero(at < 0)[0]
            self._learn(raw, starts[new], ends[new], key[new])
            at[new] = self.units.find(key[new])
        if not self.units.same(at, data, starts, ends):
            return [self._whole(x) for x in texts]
        ids, until = self.units.ids(at)
        cuts = until[data[starts] == 2].tolist()
        return [ids[a:z].tobytes() for a, z in zip([0, *cuts], cuts, strict=False)]

    def _whole(self, text: str) -> bytes:
        return np.concatenate((self._encode([text])[0], self.end)).tobytes()

    def _apart(self, text: str) -> bytes:
        first, *rest = self.SINGLE.split(text)
        out = [first]
        for mark, unit in zip(rest[::2], rest[1::2], strict=True):
            out += [" " + unit] if mark == " " else ["\n", unit]
        return b"".join(x.tobytes() for x in [*self._encode(out), self.end])

    def serialize(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes."""
        out: list[bytes] = [self.end.tobytes()] * len(texts)
        easy, size = [], 0
        for i, text in enumerate(texts):
            if text and any(x in text for x in self.added):
                out[i] = self._whole(text)
            elif text and self._plain(text):
                easy.append(i)
                size += len(text)
            elif text:
                out[i] = self._apart(text)
            if easy and (size >= self.GROUP_BYTES or i + 1 == len(texts)):
                for k, ids in zip(easy, self._group([texts[k] for k in easy]), strict=True):
                    out[k] = ids
                easy, size = [], 0
        return out


@lru_cache(2)
def encoder_for(path: str) -> Encoder:
    """One for each Python worker, whatever tasks it runs."""
    return Encoder(path)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes; raw content where there is too little to train on."""
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size >= 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def fit_dictionary(docs: DataFrame, path: str) -> tuple[bytes, int]:
    """The dictionary and the bytes of an id, from a sample that does not grow with the table."""
    h = F.xxhash64("doc_id").alias("h")
    least = docs.select(h).distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = docs.select(h, "text").filter(F.col("h") <= least).groupBy("h").agg(F.min("text").alias("text")) if least is not None else docs.limit(0)

    def encode(batches):
        encoder = encoder_for(path)
        cut = SAMPLE_IDS * encoder.dtype.itemsize
        for b in batches:
            serial = encoder.serialize(_texts(b.column(0)))
            at = [zlib.crc32(x) % -(-len(x) // cut) * cut for x in serial]
            yield pa.RecordBatch.from_arrays([pa.array([x[a : a + cut] for a, x in zip(at, serial, strict=True)], pa.binary())], ["ids"])

    rows = in_python(sample.select("text"), encode, "ids binary").collect()  # SAMPLE rows of SAMPLE_IDS ids at most
    return train([bytes(r.ids) for r in rows]), encoder_for(path).dtype.itemsize


BLOCKS = "shard int, block int, dict_hash string, payload binary, doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, first_id bigint, last_id bigint"


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None) -> None:
    """Write the whole texts of ``docs`` in ascending doc_id order under ``out``."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    path = tokenizer or tokenizer_path()
    raw, id_bytes = fit_dictionary(docs, path)
    dict_hash = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(dict_hash, raw, id_bytes)], "dict_hash string, dictionary binary, id_bytes int").write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # at most DICTIONARY_BYTES
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("payload", pa.binary()), *((x, pa.list_(pa.int64())) for x in ("doc_ids", "offsets", "counts")), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def pack(batches):
        import zstandard
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        encoder = encoder_for(path)
        words = _dictionary(shared.value)
        pressed = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        payload, ids, offsets, counts = [], [], [0], []

        def flush():
            known = [x for x in ids if x is not None] or [None]
            row = (shard, block, dict_hash, b"".join(payload), ids, offsets, counts, known[0], known[-1])
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            texts = _texts(b.column(1))
            for doc_id, serial in zip(b.column(0).to_pylist(), encoder.serialize(texts), strict=True):
                frame = pressed.compress(serial)
                payload.append(frame)
                ids.append(doc_id)
                offsets.append(offsets[-1] + len(frame))
                counts.append(len(serial) // encoder.dtype.itemsize)
                if offsets[-1] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    block += 1
                    payload, ids, offsets, counts = [], [], [0], []
        if ids:
            yield flush()

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    dealt = order.repartitionByRange(partitions_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    in_python(dealt, pack, BLOCKS).write.parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read from the files. A wrong dictionary is an error."""
    small_batches(spark)
    blocks = spark.read.parquet(f"{out}/blocks")
    meta = spark.read.parquet(f"{out}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(meta.dictionary))
    wanted, id_bytes = meta.dict_hash, meta.id_bytes
    if hashlib.sha256(shared.value).hexdigest() != wanted:
        raise ValueError("the dictionary doesn't have the hash on record")
    # Starts: totals of shards, then of the blocks in a shard, then inside a block.
    sums = blocks.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    before = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before(order="shard")), F.lit(0)).alias("base"))  # a row per shard
    inside = sums.select("shard", "block", F.coalesce(F.sum("n").over(before("shard", order="block")), F.lit(0)).alias("lead"))
    starts = inside.join(F.broadcast(shards), "shard").select("shard", "block", (F.col("base") + F.col("lead")).alias("first"))
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    names = [x.split()[0] for x in kind.split(", ")]

    def unpack(batches):
        import zstandard

        words = _dictionary(shared.value)
        opened = zstandard.ZstdDecompressor(dict_data=words)
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != wanted:
                    raise ValueError("a block was written with another dictionary")
                out_rows, start = [], row["first"]
                for doc_id, a, z, n in zip(row["doc_ids"], row["offsets"], row["offsets"][1:], row["counts"], strict=False):
                    ids = np.frombuffer(opened.decompress(row["payload"][a:z]), f"<u{id_bytes}")
                    if len(ids) != n:
                        raise ValueError("a frame doesn't have the ids that the index says")
                    out_rows.append((doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] * with_ids)))
                    start += n
                if out_rows:
                    columns = list(zip(*out_rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    return in_python(blocks.join(starts, ["shard", "block"]), unpack, kind)


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """The ids of the rows of one document, through the offset index alone."""
    import zstandard

    meta = spark.read.parquet(f"{out}/dictionary").first()
    opened = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(meta.dictionary)))
    at = F.explode(F.arrays_zip("doc_ids", "offsets", F.expr("slice(offsets, 2, size(offsets))").alias("ends")))
    held = spark.read.parquet(f"{out}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    rows = held.select("payload", at.alias("x")).filter(F.col("x.doc_ids") == doc_id)
    frames = rows.select(F.expr("substring(payload, cast(x.offsets + 1 as int), cast(x.ends - x.offsets as int))").alias("frame"), "x.offsets").collect()
    return [np.frombuffer(opened.decompress(bytes(r.frame)), f"<u{meta.id_bytes}").tolist() for r in frames]


def op5_digest(docs: DataFrame) -> DataFrame:
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out)
    return read_tokens(docs.sparkSession, out)
