r"""Chat formatting of reply trees.

Messages form trees: a node has a parent or is a root. Paths from root to leaf are enumerated by iterative self-joins, first
along runs without branches (a run of n messages takes log2(n) joins by pointer doubling), then from branching to branching in
the same way: only sums of scores go down. Leaves are ranked in their tree by the mean score of their path; the paths of the best
``keep`` alone are read back, again in log2 steps, and formatted, one conversation each.

A turn is ``<|turn|>role\\n`` text ``<|end|>``. Control strings inside texts are escaped reversibly: a backslash is doubled,
``<|`` gets a backslash in its middle, and a line break in a role becomes ``<\;``. The loss mask is a list of spans of code
points over the output that cover the assistant's escaped texts.

Defined cases: a null text or role is empty, a null score 0; a node whose parent isn't there is a root; nodes on a cycle
can't be reached from a root and are left out; repeated rows are nodes of their own; a null tree id is one tree; leaves tied in
mean score go by more turns, then by node; very long texts are formatted whole; an empty table gives no conversation; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TURN, END = "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\;"), F.lit("\n")))


def _runs(links: DataFrame) -> DataFrame:
    """node -> (head, offset) of its run: a node goes on the run of its parent if it is the parent's only child."""
    rest = links.filter("parent is not null")
    fan = rest.groupBy("parent").agg(F.count("*").alias("fan")).withColumnRenamed("parent", "p")
    tied = rest.join(fan, F.col("parent") == F.col("p")).select("node", F.when(F.col("fan") == 1, F.col("parent")).otherwise(F.col("node")).alias("up"))
    at = links.filter("parent is null").select("node", F.col("node").alias("up")).unionAll(tied)
    follows = F.col("up") != F.col("node")
    at = stage(at.select("node", "up", follows.cast("long").alias("far"), (~follows).alias("ended")), "runs")
    ended, last = at.filter("ended"), -1
    open_ = at.filter("not ended").count()
    while open_ and open_ != last:  # each round ends some, unless only cycles are left
        b = at.select(F.col("node").alias("n"), F.col("up").alias("u"), F.col("far").alias("f"), F.col("ended").alias("e"))
        moved = at.filter("not ended").join(b, F.col("up") == F.col("n")).select("node", F.col("u").alias("up"), (F.col("far") + F.col("f")).alias("far"), F.col("e").alias("ended"))
        at = stage(moved.unionAll(ended), "runs")
        ended = at.filter("ended")
        last, open_ = open_, at.filter("not ended").count()
    return ended.drop("ended")


def _sums(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """run, score, turns summed from the root down, for runs that hang on a root; and tables run, up of 1, 2, 4, ... runs up."""
    at = stage(runs.select("run", F.col("parent_run").alias("up"), "score", "turns"), "sums")
    done, jumps, left = at.filter("up is null"), [], None
    while (open_ := at.filter("up is not null").count()) and open_ != left:  # each round ends some, unless only cycles are left
        jumps.append(at.filter("up is not null").select("run", "up"))
        b = at.select(F.col("run").alias("n"), F.col("up").alias("u"), F.col("score").alias("s"), F.col("turns").alias("t"))
        moved = at.filter("up is not null").join(b, F.col("up") == F.col("n"))
        moved = moved.select("run", F.col("u").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("turns") + F.col("t")).alias("turns"))
        at, left = stage(moved.unionAll(done), "sums"), open_
        done = at.filter("up is null")
    return done.drop("up"), jumps


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """nodes: tree, node, parent, score -> tree, branch (rank from 1), turn (from 0), node, for the best ``keep`` leaves of each tree."""
    links = nodes.select("tree", "node", F.col("parent").alias("wanted"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    have = links.select(F.col("node").alias("parent"))
    # Roots have no key to be joined on, and would all meet in one task.
    placed = links.filter("wanted is not null").join(have, F.col("wanted") == F.col("parent"), "left")
    roots = links.filter("wanted is null").withColumnRenamed("wanted", "parent")
    links = stage(placed.select("tree", "node", "parent", "score").unionByName(roots), "links")
    at = _runs(links).select("node", F.col("up").alias("run"), F.col("far").alias("offset"))
    placed = stage(links.join(at, "node"), "placed")
    runs = placed.groupBy("run").agg(
        F.first("tree").alias("tree"), F.sum("score").alias("score"), F.count("*").alias("turns"), F.max(F.when(F.col("offset") == 0, F.struct("parent"))).alias("top")
    )
    parent_run = placed.select(F.col("node").alias("n"), F.col("run").alias("parent_run"))
    runs = runs.select("run", "tree", "score", "turns", F.col("top.parent").alias("parent"))
    below = runs.filter("parent is not null").join(parent_run, F.col("parent") == F.col("n")).drop("n")
    runs = stage(below.unionByName(runs.filter("parent is null"), allowMissingColumns=True), "runs-of")
    leaf = runs.join(runs.select(F.col("parent_run").alias("r")).filter("r is not null").distinct(), F.col("run") == F.col("r"), "left_anti").select("run")
    sums, jumps = _sums(runs)
    leaves = runs.select("run", "tree").join(sums, "run").join(leaf, "run", "left_semi")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("turns")), F.desc("turns"), "run")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= keep)  # cut to the best before the exchange
    steps = chosen.select("tree", "branch", "run", F.lit(0).cast("long").alias("step"))
    for k, jump in enumerate(jumps):
        above = steps.join(jump, "run").select("tree", "branch", F.col("up").alias("run"), (F.col("step") - (1 << k)).alias("step"))
        steps = stage(steps.unionAll(above), "steps")
    members = placed.select("run", "offset", "node")
    order = Window.partitionBy("tree", "branch").orderBy("step", "offset")
    return steps.join(members, "run").select("tree", "branch", (F.row_number().over(order) - 1).alias("turn"), "node")


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """messages: node, role, text -> tree, branch, formatted, loss_spans (array of start, end in code points)."""
    m = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(m, "node").select(
        "tree",
        "branch",
        "turn",
        F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    )
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "branch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start.cast("long"))
    span = F.when(F.col("learn"), F.struct("turn", "start", (F.col("start") + F.length("body")).alias("end")))
    grouped = turns.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("spans"))
    return grouped.select(
        "tree",
        "branch",
        F.array_join(F.transform("pieces", lambda x: x.piece), "").alias("formatted"),
        F.transform("spans", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Read the turns back: array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(1), at - 1)
        body = F.substring(piece, at + 1, F.length(piece) - at - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: tree (struct of conv_id), node, parent, score, role, text."""
    picked = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    line = picked.withColumn("row", F.row_number().over(order))
    key = lambda at: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), at.cast("string"))
    return line.select(
        F.struct("conv_id").alias("tree"), key(F.col("row")).alias("node"), F.when(F.col("row") > 1, key(F.col("row") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def op6_digest(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    nodes = stage(conversation_nodes(rows), "nodes")
    out = format_paths(nodes, paths(nodes))
    read = out.select(F.col("tree.conv_id").alias("conv_id"), "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\;')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 16 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
