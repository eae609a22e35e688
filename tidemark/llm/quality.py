"""Quality rules: compression bands.

A whole text and each of its fixed chunks are compressed with zstandard. Text that shrinks far more than prose repeats
itself; text that hardly shrinks is noise. The limits depend on the length, as a short text has little to refer back to.
A document is kept when the base rules hold, its whole ratio (bytes over compressed bytes) lies in the band of its length,
and no more than ``BAD_CHUNKS`` of its full chunks lie outside the band for chunks.

Defined cases: a null text has no words and fails the base rules, as does an empty one; repeated rows are judged apart and alike;
texts are read whole whatever their length; ids and other columns may be null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_python, small_batches

LEVEL = 3
CHUNK = 4096
#: Bytes from which a band holds, least and most ratio. The upper limits lie a twelfth or more above the
#: greatest ratio of labelled good prose of that length (2.02 at 1 KB, 2.23 at 4 KB, 2.42 at 16 KB, 2.54 at 64 KB).
BANDS = ((0, 0.0, 2.4), (512, 1.15, 2.25), (1024, 1.2, 2.3), (2048, 1.3, 2.42), (4096, 1.4, 2.55), (8192, 1.5, 2.65), (16384, 1.5, 2.76), (65536, 1.5, 3.0))
CHUNK_BAND = (1.4, 2.48)
BAD_CHUNKS = 0.5
LEAST_WORDS = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")

COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, bad_chunks double, base_failed boolean, kept boolean"
_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that is found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = np.unique(code[:-1] * len(seen) + code[1:], return_inverse=True)[1]
    window = pair[:-1] * len(seen) + code[2:]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(len(words), bool)
    for j in range(3):
        hit[j : j + len(twice)] |= twice
    return int(hit.sum())


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float]:
    _, low, high = BANDS[bisect_right(BANDS, size, key=lambda x: x[0]) - 1]
    return low, high


class Judge:
    def __init__(self):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.zstd.compress(raw)) if raw else 0.0

    def bad_chunks(self, raw: bytes) -> float:
        """Share of the full chunks outside the band; 0 if there is none."""
        ratios = [self.ratio(raw[at : at + CHUNK]) for at in range(0, len(raw) - CHUNK + 1, CHUNK)]
        low, high = CHUNK_BAND
        return sum(not low <= x <= high for x in ratios) / len(ratios) if ratios else 0.0

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        joined = b"".join(words)
        chars = len(joined.decode("utf-8", "surrogatepass"))
        repeated = repeat_words(words)
        ratio, bad = self.ratio(raw), self.bad_chunks(raw)
        failed = len(words) < LEAST_WORDS or 100 * repeated > 50 * len(words)
        low, high = band(len(raw))
        return len(words), chars, len(SYMBOLS.findall(text)), dup_lines(raw), repeated, ratio, bad, failed, not failed and low <= ratio <= high and bad <= BAD_CHUNKS


def judged(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and a struct column ``quality`` (named with ``prefix``)."""
    small_batches(docs.sparkSession)
    fields = [x.split() for x in COLUMNS.split(", ")]
    kind = pa.struct([(name, _TYPES[t]) for name, t in fields])
    name = f"{prefix}quality"
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Judge()
        for b in batches:
            rows = list(zip(*map(rule, b.column(at).to_pylist()), strict=True)) or [[] for _ in fields]
            made = pa.StructArray.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(rows, fields, strict=True)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return in_python(docs, judge, T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(COLUMNS))]))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return judged(packed.select("row", "text")).filter("quality.kept").select("row.*")


def op8_digest(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{x.split()[0]}") for x in COLUMNS.split(", ")])
