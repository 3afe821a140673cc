"""Chat formatting of reply trees, with DataFrame functions only.

A message table (tree_id, msg_id, parent_id, role, text, score) holds trees of
replies. Iterative self-joins find the paths from the roots to the leaves; the
branches of a tree are ranked by the sum of their scores; each chosen path
becomes one conversation in the template, with a loss mask over what the
assistant says.

Self-joins over single replies would take as many rounds as the longest
conversation has turns. So runs of messages without a branch are joined first:
each message points at its parent, and pointers are doubled until they stand
at the run's first message. The joins that follow go from run to run, and their
number is that of the branch points on a path.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and
texts ``\\``, ``<`` and ``[`` become ``\\e``, ``\\l`` and ``\\b`` (in roles a
line feed ``\\k``), so no control string, of this template or of another one
that opens with these brackets, can appear inside them; ``unescape`` takes that
back exactly.

Defined results: null texts, roles and scores count as empty, empty and 0. A
message whose parent is missing is a root. Messages on a cycle have no root and
are left out. Of equal scores the smaller leaf comes first. Rows that repeat a
(tree_id, msg_id) are the caller's error; ``from_turns`` numbers rows, so
repeated rows stay as turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\k", "\n"), ("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _same_tree(a: str, b: str) -> Column:
    return F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id"))


def runs(messages: DataFrame) -> DataFrame:
    """tree_id, msg_id, parent_id, head (first message of its run) and dist (messages from there)."""
    m = messages.select("tree_id", "msg_id", "parent_id")
    children = m.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.count("*").alias("n"))
    parents = children.join(m.select("tree_id", F.col("msg_id").alias("id")).alias("p"), F.col("parent_id").eqNullSafe(F.col("id")) & children["tree_id"].eqNullSafe(F.col("p.tree_id")), "left_semi")
    joined = m.alias("m").join(parents.alias("c"), _same_tree("m", "c") & (F.col("m.parent_id") == F.col("c.parent_id")), "left")
    link = F.coalesce(F.col("c.n") == 1, F.lit(False))
    # A message with a missing parent becomes a root.
    state = joined.select(
        F.col("m.tree_id"), F.col("m.msg_id"), F.when(F.col("c.n").isNotNull(), F.col("m.parent_id")).alias("parent_id"),
        F.when(link, F.col("m.parent_id")).otherwise(F.col("m.msg_id")).alias("head"), link.cast("long").alias("dist"), (~link).alias("done"),
    )
    state = materialize(state, "runs")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        todo = state.filter("not done")
        if todo.isEmpty():
            break
        to = state.select("tree_id", F.col("msg_id").alias("at"), F.col("head").alias("next"), F.col("dist").alias("more"), F.col("done").alias("end"))
        step = todo.alias("m").join(to.alias("t"), _same_tree("m", "t") & (F.col("m.head") == F.col("t.at")))
        step = step.select("m.tree_id", "m.msg_id", "m.parent_id", F.col("t.next").alias("head"), (F.col("m.dist") + F.col("t.more")).alias("dist"), F.col("t.end").alias("done"))
        new = materialize(state.filter("done").unionByName(step), "runs")
        discard(state)
        state = new
    return state.filter("done").drop("done")


def format_paths(messages: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree_id, leaf, score, rank, formatted, loss (spans of UTF-8 bytes: start, length).

    ``best``: so many branches of each tree, or all if None.
    """
    own = messages.select("tree_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    placed = runs(messages)
    lead = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\k")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = placed.alias("r").join(own.alias("o"), _same_tree("r", "o") & (F.col("r.msg_id") == F.col("o.msg_id")))
    rows = rows.select("r.tree_id", "r.head", "r.dist", "r.msg_id", "r.parent_id", "score", F.octet_length(lead).alias("lead_len"), F.octet_length(body).alias("body_len"), (F.col("role") == loss_role).alias("lost"), F.concat(lead, body, F.lit(END)).alias("piece"))
    before = Window.partitionBy("tree_id", "head").orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.col("lead_len"))
    run = rows.groupBy("tree_id", "head").agg(
        F.sort_array(F.collect_list(F.struct("dist", "piece", F.struct(F.col("at").cast("long").alias("start"), F.col("body_len").cast("long").alias("length")).alias("span"), "lost"))).alias("turns"),
        F.sum("score").alias("score"), F.max_by("msg_id", "dist").alias("last"), F.min_by("parent_id", "dist").alias("parent_id"),
    )
    spans = F.transform(F.filter("turns", lambda t: t["lost"]), lambda t: t["span"])
    run = run.select("tree_id", "head", "parent_id", "last", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss"))
    run = materialize(run, "segments")
    # A run hangs on the last message of another run.
    paths, chosen = run.filter("parent_id is null").drop("parent_id", "head"), None
    hanging = run.filter("parent_id is not null").select("tree_id", "parent_id", "last", "score", "formatted", "loss")
    if hanging.isEmpty():
        chosen = paths
    parents = hanging.select("tree_id", F.col("parent_id").alias("at")).distinct()
    while chosen is None or not paths.isEmpty():
        if hanging.isEmpty():
            break
        on = paths["last"].eqNullSafe(parents["at"]) & paths["tree_id"].eqNullSafe(parents["tree_id"])
        leaves = paths.join(parents, on, "left_anti")
        chosen = leaves if chosen is None else chosen.unionByName(leaves)
        shift = F.octet_length("p.formatted").cast("long")
        loss = F.concat("p.loss", F.transform("h.loss", lambda s: F.struct((s["start"] + shift).alias("start"), s["length"].alias("length"))))
        step = paths.alias("p").join(hanging.alias("h"), _same_tree("p", "h") & (F.col("p.last") == F.col("h.parent_id")))
        step = step.select("p.tree_id", F.col("h.last").alias("last"), (F.col("p.score") + F.col("h.score")).alias("score"), F.concat("p.formatted", "h.formatted").alias("formatted"), loss.alias("loss"))
        paths = materialize(step, "paths")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "last"))
    out = chosen.withColumn("rank", rank)
    if best is not None:
        out = out.filter(F.col("rank") <= best)
    return out.select("tree_id", F.col("last").alias("leaf"), "score", "rank", "formatted", "loss")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.slice(F.split(formatted, "<\\|im_end\\|>\n"), 1, F.size(F.split(formatted, "<\\|im_end\\|>\n")) - 1)

    def one(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)
        text = F.substr(x, F.char_length(role) + F.lit(len(START) + 2))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, one)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    raw = F.encode(formatted, "UTF-8")
    parts = F.transform(loss, lambda s: F.decode(F.substr(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return unescape(F.array_join(parts, ""))
