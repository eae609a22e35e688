"""Graph features over link columns: incremental components in one ordered pass, static components by iteration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import long
from tidemark.session import ship


def fit_hubs(train: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """column, value: what so large a share of rows carries that it says nothing."""
    from tidemark.operators.profile import heaviest

    return heaviest(train, columns, share).select("column", "value")


def link_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    g = long(df, columns, kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return g.groupBy("column").agg(F.count("value").alias("n_distinct"), F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("heaviest"))


_OUT = "id bigint, component_size bigint, n_labelled bigint, n_positive bigint"


def _walk(frames: Iterator[pd.DataFrame], links: list[str], lag: int) -> Iterator[pd.DataFrame]:
    """Rows in time order: read the whole block of an instant, then add it. Labels count from day + lag on, and before t."""
    up: dict = {}
    size: dict = {}
    marks: dict = {}
    waiting: list = []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            up[b] = a
            size[a] += size.pop(b)
            n, k = marks.pop(b)
            marks[a] = (marks[a][0] + n, marks[a][1] + k)

    def flush(block):
        t, day = block[0].ts, block[0].day
        out = []
        keep = []
        for w in waiting:
            if w[0] + lag <= day and w[1] < t:
                r = find(w[2])
                marks[r] = (marks[r][0] + 1, marks[r][1] + w[3])
            else:
                keep.append(w)
        waiting[:] = keep
        for r in block:
            anchor = (links[0], getattr(r, links[0]))
            root = find(anchor) if anchor in up else None
            out.append((r.id, size[root] if root is not None else 0, *(marks[root] if root is not None else (0, 0))))
        for r in block:
            nodes = [(c, v) for c in links if not pd.isna(v := getattr(r, c))]
            for x in nodes:
                if x not in up:
                    up[x], size[x], marks[x] = x, 0, (0, 0)
            for x in nodes[1:]:
                tie(nodes[0], x)
            if nodes:
                size[find(nodes[0])] += 1
                if not pd.isna(r.label):
                    waiting.append((r.day, r.ts, nodes[0], int(r.label)))
        return out

    block: list = []
    for frame in frames:
        done = []
        for r in frame.itertuples(index=False):
            if block and r.ts != block[0].ts:
                done += flush(block)
                block = []
            block.append(r)
        if done:
            yield pd.DataFrame(done, columns=["id", "component_size", "n_labelled", "n_positive"])
    if block:
        yield pd.DataFrame(flush(block), columns=["id", "component_size", "n_labelled", "n_positive"])


def incremental_components(df: DataFrame, links: list[str], lag: int, day: str = "day") -> DataFrame:
    """id, component_size (earlier rows in the component of the first link's value), matured labels and positives in it.

    What a component is at t depends on all rows before it, so this is one ordered pass; only ids, codes and times take part.
    The labels of rows outside the training window must be null.
    """
    ship(df.sparkSession)
    rows = df.select("id", "ts", F.col(day).alias("day"), *[F.col(c).cast("string").alias(c) for c in links], F.col("label").cast("double").alias("label"))
    return rows.repartition(1).sortWithinPartitions("ts", "id").mapInPandas(lambda it: _walk(it, links, lag), _OUT)


def static_components(df: DataFrame, links: list[str], row: str = "id") -> DataFrame:
    """row -> component: least row id that can be reached over shared values. Rounds of least labels by value and by row, with
    a checkpoint each, until nothing changes."""
    edges = long(df, links, row, kind="string").filter("value is not null").select(F.col(row).alias("id"), F.concat_ws("=", "column", "value").alias("node")).checkpoint()
    state = edges.select("id", F.col("id").alias("component")).distinct()
    while True:
        node = edges.join(state, "id").groupBy("node").agg(F.min("component").alias("c"))
        best = edges.join(node, "node").groupBy("id").agg(F.min("c").alias("c"))
        # jump: the component of the least row found
        jump = state.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = best.join(jump, "c").select("id", F.least("c", "cc").alias("component")).checkpoint()
        same = new.join(state, ["id", "component"], "left_anti").isEmpty()
        state = new
        if same:
            return df.select(F.col(row).alias("id")).join(state, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("giant"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("rows")).withColumn("giant_share", F.col("giant") / F.col("rows"))


def leave_one_out_rate(components: DataFrame, df: DataFrame, row: str = "id") -> DataFrame:
    """The rate of the others in the final component: a leak, kept to be measured."""
    g = components.join(df.select(F.col(row).alias("id"), "label"), "id")
    t = g.groupBy("component").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    return g.join(t, "component").select("id", F.try_divide((F.col("k") - F.col("label")).cast("double"), F.col("n") - 1).alias("rate"))
