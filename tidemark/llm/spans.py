"""What both searches for repeated passages share: word codes, hashes of word ranges, seeds dealt out in a global order,
neighbours in that order, and stretches merged into passages.

A document is known by ``ref``, a 64-bit hash of doc_id and text, so rows that share an id are told apart and rows that are
repeated as they are count as one document. A null id stands as ``NO_ID`` inside; ids must be integers (another id is an error
of the cast). Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_python, partitions, partitions_for, small_batches, stage

NO_ID = -(1 << 63)
ROWS = 100_000
TEXTS = 500
#: Documents and seeds of each that the bounds of partitions are chosen from; only the balance depends on them.
SPLIT_DOCS, SPLIT_SEEDS = 1000, 2000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_codes(text: str | None) -> np.ndarray:
    """A 32-bit code for each white-space word, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(_MIX[0])
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MIX[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, as many as the longest text so far asked for."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_MIX[1], pow(_MIX[1], -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS


class Ranges:
    """64-bit hashes of any ranges of words, each from one difference of running sums."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every run of k words (fewer words: none)."""
        start = np.arange(max(0, self.n - k + 1))
        return self.of(start, start + k)


def least_of(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w neighbours, the position of the first least hash."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.concatenate([view[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(view))) for i in range(0, len(view), 65536)])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("ref"), "text")


Pick = Callable[[np.ndarray], dict[str, np.ndarray]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def split_points(docs: DataFrame, pick: Pick, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and refs that part the seeds into n ranges of about one size, read from a bounded sample."""
    rows = docs.count()
    sample = keyed(docs.sample(min(1.0, SPLIT_DOCS / max(rows, 1)), 20)).select("ref", "text")

    def run(batches):
        for b in batches:
            found = [_signed(pick(word_codes(x))["code"]) for x in b.column(1).to_pylist()]
            found = [x[:: max(1, len(x) // SPLIT_SEEDS)] for x in found]
            if found:
                refs = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(refs)], ["code", "ref"])

    got = in_python(sample, run, "code bigint, ref bigint").toArrow()
    code, ref = got.column(0).to_numpy(), got.column(1).to_numpy()
    at = np.lexsort((ref, code))[np.arange(1, n) * len(code) // n] if len(code) else np.zeros(0, np.int64)
    return code[at], ref[at]


def part_of(code: np.ndarray, ref: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of each seed; a code that takes several ranges is parted by ref."""
    codes, refs = points
    at, end = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
    hot = np.nonzero(end > at)[0]
    for a in np.unique(at[hot]).tolist():
        rows = hot[at[hot] == a]
        z = int(end[rows[0]])
        end[rows] = a + np.searchsorted(refs[a:z], ref[rows], "right")
    return end.astype(np.int32)


def seeds(docs: DataFrame, pick: Pick, kinds: str) -> DataFrame:
    """The columns named in ``kinds`` (code and others that ``pick`` gives for each word array, doc and ref of the document), in as
    many ranges of code, then ref, as suit the size of the table; a partition each."""
    spark = docs.sparkSession
    small_batches(spark, TEXTS)
    n = partitions_for(docs)
    points = split_points(docs, pick, n)
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches):
        for b in batches:
            found = [pick(word_codes(x)) for x in b.column(2).to_pylist()]
            counts = [len(x["code"]) for x in found]
            if sum(counts):
                made = {k: _signed(np.concatenate([x[k] for x in found])) for k in found[0]}
                for i, k in enumerate(("doc", "ref")):
                    made[k] = np.repeat(b.column(i).to_numpy(), counts)
                made["part"] = part_of(made["code"], made["ref"], points)
                yield pa.RecordBatch.from_arrays([pa.array(made[k]) for k in (*names, "part")], [*names, "part"])

    return in_python(keyed(docs), run, f"{kinds}, part int").repartitionById(n, "part").drop("part")


ORDER = ("code", "ref", "pos")
_LINKS = "kind int, code bigint, a_ref bigint, a_pos int, b_ref bigint, b_pos int"


def by_document(columns: tuple[np.ndarray, ...], low: int) -> tuple[np.ndarray, ...]:
    """Rows in ORDER -> rows whose whole code no other document has, put in order of the document inside their group: they stand
    beside no one who goes on alike, and so a document meets the same neighbours at all its seeds of that kind."""
    code, ref, pos = columns
    if not low or not len(code):
        return columns
    start = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
    size = np.diff(np.append(start, len(code)))
    several = np.add.reduceat(ref != np.repeat(ref[start], size), start) > 0
    code = np.where(np.repeat(several, size), code, code >> low << low)
    order = np.lexsort((pos, ref, code))
    return code[order], ref[order], pos[order]


def _link(low: int, settle: bool = False):
    """Rows in ORDER -> kind 0: a row and its mate in the document before it that has its group (its code without the ``low``
    last bits): the one of the same number among the document's rows with the group, or else the last. Kind 1: rows that begin a
    partition and may have theirs in an earlier one. Kind 2: what later partitions may look for, the last document with its
    group and the one before. Kind 3: rows of a group's first document beyond the next one's count, each as the mate of that
    one's last row. Kind 4: the last row of the document behind the one that begins the partition, for such rows in an earlier
    partition."""

    def surplus(group, start, closed):
        """Numbers of first rows and of the rows that take them; the last document's rows count if they are all there."""
        at = np.unique(start)
        if len(at) < 2:
            return np.zeros((2, 0), np.int64)
        size = np.diff(np.append(at, len(group)))
        i = np.arange(1, len(at) if closed else len(at) - 1)
        first = (i == 1) | (group[at[np.maximum(i - 2, 0)]] != group[at[i - 1]])
        i = i[(group[at[i]] == group[at[i - 1]]) & first & (size[i - 1] > size[i])]
        over = size[i - 1] - size[i]
        number = np.arange(over.sum()) - np.repeat(np.cumsum(over) - over, over)
        return np.stack([np.repeat(at[i - 1] + size[i], over) + number, np.repeat(at[i] + size[i] - 1, over)])

    def rows(kind, a, z, columns):
        code, ref, pos = columns
        values = (np.full(len(a), kind, np.int32), code[a], ref[a], pos[a], ref[z], pos[z])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in values], [x.split()[0] for x in _LINKS.split(", ")])

    def starts(group, ref):
        fresh = np.ones(len(group), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (ref[1:] != ref[:-1])
        return np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0))

    def run(batches):
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
        opening, seen, behind = None, False, False
        for b in batches:
            if not b.num_rows:
                continue
            lead = len(kept[0])
            fresh = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            columns = tuple(np.concatenate(x) for x in zip(kept, by_document(fresh, low if settle else 0), strict=True))
            group, ref = columns[0] >> low, columns[1]
            start = starts(group, ref)
            before = start - 1
            has = (before >= 0) & (group[np.maximum(before, 0)] == group)
            if not seen:
                opening, seen = (group[0], ref[0]), True
            new = np.arange(len(group)) >= lead
            a = np.nonzero(new & has)[0]
            yield rows(0, a, np.minimum(start[before[a]] + a - start[a], before[a]), columns)
            o = np.nonzero(new & ~has & (group == opening[0]) & (ref == opening[1]))[0]
            yield rows(1, o, o, columns)
            z, a = surplus(group, start, False)
            yield rows(3, a, z, columns)
            other = np.nonzero((group == opening[0]) & (ref != opening[1]))[0]
            if not behind and len(other):
                behind, e = True, other[np.nonzero(start[other] == start[other[0]])[0][-1:]]
                yield rows(4, e, e, columns)
            kept = tuple(x[start[before[-1]] if has[-1] else start[-1] :] for x in columns)
        if seen:
            group = kept[0] >> low
            z, a = surplus(group, starts(group, kept[1]), True)
            yield rows(3, a, z, kept)
            every = np.arange(len(group))
            yield rows(2, every, every, kept)

    return run


def neighbours(found: DataFrame, low: int = 0) -> tuple[DataFrame, DataFrame]:
    """a_ref, a_pos, b_ref, b_pos, and the staged table behind it: each seed with the one before it in the order of code, ref and position that has its group in
    another document, the greater ref as a.

    No query uses it now: it leaves out all partners but one, see ``partners``. The ``low`` last bits of a code only order the rows of a group (those that no other document has too come first, in order
    of the document). Rows of a group's first document that the next one's leave
    over are linked too, so no shared seed is without a link. Rows at the bounds of partitions are linked in a second, small
    pass (a few documents' rows from each partition), again in parallel.
    """
    linked = stage(in_python(found.sortWithinPartitions(*ORDER), _link(low, True), _LINKS), "neighbours", ROWS)
    own = linked.select("kind", "code", F.col("a_ref").alias("ref"), F.col("a_pos").alias("pos"))
    edges = own.filter("kind in (1, 2, 4)").select(*ORDER).distinct().repartition(partitions(found.sparkSession), F.shiftright("code", low)).sortWithinPartitions(*ORDER)
    across = in_python(edges, _link(low), _LINKS)
    begun = own.filter("kind in (1, 4)").select(F.col("code").alias("c"), F.col("ref").alias("r"), F.col("pos").alias("p")).distinct()
    wanted = (F.col("kind") == 0) & (F.col("code") == F.col("c")) & (F.col("a_ref") == F.col("r")) & (F.col("a_pos") == F.col("p"))
    pairs = linked.filter("kind in (0, 3)").unionAll(across.join(begun, wanted, "left_semi")).unionAll(across.filter("kind = 3"))
    later = F.col("a_ref") > F.col("b_ref")
    side = lambda p, q: F.struct(F.col(f"{p}_ref").alias("ref"), F.col(f"{p}_pos").alias("pos"))
    pairs = pairs.select(F.when(later, side("a", "b")).otherwise(side("b", "a")).alias("a"), F.when(later, side("b", "a")).otherwise(side("a", "b")).alias("b"))
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("ref", "pos")]), linked


def merged(found: DataFrame) -> DataFrame:
    """Passages doc, ref, start, stop, mate, earlier (mate comes before doc), score -> disjoint ones of each document.

    Spans that overlap or touch become one; its mate is an earlier document if there is one, and ``first`` says there is none.
    """
    order = Window.partitionBy("doc", "ref").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    mate = F.max(F.struct("earlier", (F.col("stop") - F.col("start")).alias("n"), F.bitwise_not("mate").alias("mate")))  # the least mate; no overflow
    out = found.withColumn("reach", reach).select("*", island.alias("island")).groupBy("doc", "ref", "island")
    out = out.agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), mate.alias("m"), F.max("score").alias("score"))
    no = lambda c: F.when(c != NO_ID, c)
    return out.select(
        no(F.col("doc")).alias("doc_id"),
        F.col("start_word").cast("long").alias("start_word"),
        F.col("end_word").cast("long").alias("end_word"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
        no(F.bitwise_not(F.col("m.mate"))).alias("mate_id"),
        (~F.col("m.earlier")).alias("first"),
        "score",
    )
