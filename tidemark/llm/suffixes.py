"""Suffix-array dedup with sparse suffix arrays: runs of ``LEAST`` words or more that documents share.

Of each text only the suffixes at content-selected positions are kept: for every run of ``LEAST`` words the least hash among its
first ``WINDOW`` 8-word grams, its minimiser. They are sorted over all documents by their first ``HEAD`` words (as a hash, so
equal heads are neighbours), and a suffix whose neighbours with its head are all of its own document is dropped.

What is left is extended to both sides. First each suffix takes along all runs that it is the minimiser of, as one ``wide``
stretch, and equal stretches of different documents are a match as they stand. Where some suffix of a head has no such mate, its
surroundings differ somewhere, and each run of ``LEAST`` words around every suffix of that head is taken by itself (extension by
0 to WINDOW - 1 words to the left, the rest to the right), and equal ones are the matches. Matches that overlap or touch are
put together, so a passage gets as long as its words are in such runs.

This is whole: a run that two documents share has the same minimiser in both, hence the same head. If all stretches of the head
have mates, the run lies in one that another document has; if not, it is compared by itself. Ranges of words are compared by
64-bit hashes.

Defined cases: null, empty and short texts have no passage; very long texts are read whole; rows repeated as they are count as
one document; a passage that occurs twice in one document alone isn't reported; a null id comes first and shows as null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_python, stage, unstage
from .spans import ROWS, TEXTS, Ranges, keyed, least_of, merged, mixed, seeds, word_codes

GRAM, WINDOW, LEAST = 8, 12, 51
HEAD = LEAST - WINDOW + 1
_SUFFIXES = "code bigint, wide bigint, doc bigint, ref bigint, at int, low int, high int"


def kept_suffixes(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Sparse suffixes: hash of the head, of the stretch of all runs they are the minimiser of, position, first and last of
    those runs. Runs of one minimiser follow each other."""
    runs = max(0, len(codes) - LEAST + 1)
    ranges = Ranges(codes)
    chosen = least_of(ranges.grams(GRAM)[: runs + WINDOW - 1], WINDOW) if runs else np.zeros(0, np.int64)
    at, low, many = np.unique(chosen, return_index=True, return_counts=True)
    high = low + many - 1
    wide = mixed(ranges.of(low, high + LEAST) + (at - low).astype(np.uint64))
    return {"code": ranges.of(at, at + HEAD), "wide": wide, "at": at.astype(np.int32), "low": low.astype(np.int32), "high": high.astype(np.int32)}


def _shared(batches):
    """Rows in the order of code -> those whose code another document has too, and those that begin or end the partition."""
    opening, known, held = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b])
        code, ref = table.column("code").to_numpy(), table.column("ref").to_numpy()
        opening = code[0] if opening is None else opening
        start = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
        size = np.diff(np.append(start, len(code)))
        several = np.add.reduceat(ref != np.repeat(ref[start], size), start) > 0
        several |= (code[start] == opening) | (code[start] == known if known is not None else False)
        known = code[-1] if several[-1] else None
        end = len(code) if several[-1] else start[-1]
        kept = np.repeat(several, size)[:end]
        yield from table.slice(0, end).filter(pa.array(kept)).to_batches()
        held = table.slice(end).to_batches()
    yield from held


def _document(doc: str = "doc", ref: str = "ref"):
    return F.struct(F.col(doc).alias("doc"), F.col(ref).alias("ref"))


def _mate(least: str, most: str):
    """The least other document of a group that has these least and greatest ones."""
    own = (F.col(f"{least}.doc") == F.col("doc")) & (F.col(f"{least}.ref") == F.col("ref"))
    return F.when(own, F.col(most)).otherwise(F.col(least))


def _runs(docs: DataFrame, around: DataFrame) -> DataFrame:
    """key, doc, ref, start: the runs of LEAST words from ``low`` to ``high`` of each row of ``around``."""
    wanted = around.groupBy("doc", "ref").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))  # of one document

    def run(batches):
        for b in batches:
            out = []
            for text, low, high in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                low, many = np.array(low), np.array(high) - np.array(low) + 1
                start = np.unique(np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum()))
                out.append((Ranges(word_codes(text)).of(start, start + LEAST).view(np.int64), start.astype(np.int32)))
            if out:
                rows = pa.array(np.repeat(np.arange(len(out)), [len(x) for x, _ in out]))
                made = [pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([made[0], b.column(0).take(rows), b.column(1).take(rows), made[1]], ["key", "doc", "ref", "start"])

    texts = keyed(docs).join(wanted, ["doc", "ref"]).select("doc", "ref", "text", "low", "high")
    return in_python(texts, run, "key bigint, doc bigint, ref bigint, start int")


def matches(docs: DataFrame) -> DataFrame:
    """doc, ref, start, stop, mate (a document): stretches of LEAST words or more that the mate has too."""
    sorted_ = seeds(docs, kept_suffixes, _SUFFIXES).sortWithinPartitions("code", "wide")
    near = stage(in_python(sorted_, _shared, _SUFFIXES), "suffixes", TEXTS)
    wide = near.groupBy("code", "wide").agg(F.min(_document()).alias("least"), F.max(_document()).alias("most"))
    head = wide.groupBy("code").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.max(F.col("least") == F.col("most")).alias("apart"))
    head = head.filter("first <> last").select(F.col("code").alias("c"), "apart")
    groups = wide.join(head, F.col("code") == F.col("c")).select("c", F.col("wide").alias("w"), "least", "most", "apart")
    placed = near.join(groups, (F.col("code") == F.col("c")) & (F.col("wide") == F.col("w"))).drop("code", "wide", "c", "w", "at")
    placed = stage(placed, "stretches", ROWS)
    whole = placed.filter("least <> most").select("doc", "ref", F.col("low").alias("start"), (F.col("high") + LEAST).alias("stop"), _mate("least", "most").alias("mate"))
    runs = stage(_runs(docs, placed.filter("apart")), "runs", TEXTS)
    twice = runs.groupBy("key").agg(F.min(_document()).alias("least"), F.max(_document()).alias("most")).filter("least <> most").withColumnRenamed("key", "k")
    single = runs.join(twice, F.col("key") == F.col("k")).select("doc", "ref", "start", (F.col("start") + LEAST).alias("stop"), _mate("least", "most").alias("mate"))
    found = stage(whole.unionAll(single), "matches", ROWS)
    unstage(near, placed, runs)
    return found


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, mate_id, first: the passages of each document that other documents have too."""
    found = matches(docs).select("doc", "ref", "start", "stop", F.col("mate.doc").alias("mate"), (F.col("mate") < _document()).alias("earlier"), F.lit(1.0).alias("score"))
    return merged(found).drop("score")


def op9_digest(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
