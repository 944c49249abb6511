"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins.

A message names its parent.  Joining the messages with themselves along the parent,
then along the pointers so found, doubles the reach of every pointer, so the depth and
the score of each path from the root are known after as many rounds as the deepest
tree has binary digits.  The leaves of a tree are ranked by the score of their path;
the chosen ones walk back along the same pointers, longest first, which gives every
message of a path once.  Only ids and scores move in these rounds; texts are joined to
the chosen paths at the end.  DataFrame functions throughout.

The template marks a turn as ``### role:``, a line break, the text and ``</turn>``.
Inside texts and roles ``\\`` becomes ``\\b``, ``</turn>`` becomes ``\\e`` and ``### ``
becomes ``\\h``; a role's ``:`` becomes ``\\c``.  So neither mark can occur inside a
text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut

# fixed values: the marks of the template, and the codes of control strings inside texts
HEAD, COLON, END, BREAK = "### ", ":", "</turn>", "\n"
CODES = {"\\": "\\b", END: "\\e", HEAD: "\\h"}
ROLE_CODES = {**CODES, COLON: "\\c"}
LOSS_ROLE = "assistant"


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    """The escape sign first, so that each one left in the result begins a code."""
    for plain, code in codes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: dict[str, str] = CODES) -> Column:
    for plain, code in reversed(codes.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _step(rows: DataFrame, to: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the row of ``to`` whose node is ``key``, in the same tree;
    the columns of ``to`` get the prefix ``to_``."""
    to = to.select(*(F.col(c).alias(f"to_{c}") for c in to.columns))
    return rows.join(to, F.col("tree").eqNullSafe(F.col("to_tree")) & F.col(key).eqNullSafe(F.col("to_node")))


def distinct_nodes(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node): the highest score, then the lowest of the rest."""
    w = Window.partitionBy("tree", "node").orderBy(F.desc_nulls_last("score"), "parent", "role", "text")
    return messages.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor pointers of 1, 2, 4, ... steps, and ``tree, node, depth, total`` for each
    node with a path from a root (``total``: the sum of scores along it).

    A node whose parent is not in its tree is a root.  Nodes on or below a cycle reach
    no root; their pointers are still open when they are as long as the table.
    """
    ids = cut(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    linked = (_step(ids.where(F.col("parent").isNotNull()), ids.select("tree", "node"), "parent")
              .select("tree", "node", F.col("parent").alias("up")))
    state = ids.join(linked.select(F.col("tree").alias("to_tree"), F.col("node").alias("to_node"), "up"),
                     F.col("tree").eqNullSafe(F.col("to_tree")) & F.col("node").eqNullSafe(F.col("to_node")), "left")
    state = cut(state.select("tree", "node", "up", F.lit(1).cast("long").alias("depth"), "total"))
    jumps, n = [], ids.count()
    while 2 ** len(jumps) <= n and not (open_ := state.where(F.col("up").isNotNull())).isEmpty():
        jumps.append(open_.select("tree", "node", "up"))
        further = _step(open_, state, "up").select(
            "tree", "node", F.col("to_up").alias("up"), (F.col("depth") + F.col("to_depth")).alias("depth"),
            (F.col("total") + F.col("to_total")).alias("total"))
        state = cut(state.where(F.col("up").isNull()).unionByName(further))
    return jumps, state.where(F.col("up").isNull()).drop("up")


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree, leaf, rank, score, node, pos`` for each message of the ``branches`` best
    paths of a tree (None: all); ``pos`` counts from 1 at the root.  The score of a path
    is the sum along it; ties go to the smaller leaf."""
    jumps, reached = pointers(nodes)
    leaves = reached
    if jumps:
        inner = jumps[0].select(F.col("tree").alias("to_tree"), F.col("up").alias("to_node")).distinct()
        leaves = leaves.join(inner, F.col("tree").eqNullSafe(F.col("to_tree"))
                             & F.col("node").eqNullSafe(F.col("to_node")), "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    if branches is not None:
        leaves = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches)
    else:  # no rank: a window over one large tree would be a single task
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    out = leaves.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("score"), "node",
                        F.col("depth").alias("pos"))
    for k in reversed(range(len(jumps))):
        out = cut(out)
        above = _step(out, jumps[k], "node").select(
            "tree", "leaf", "rank", "score", F.col("to_up").alias("node"), (F.col("pos") - 2 ** k).alias("pos"))
        out = out.unionByName(above)
    return out


def format_paths(turns: DataFrame) -> DataFrame:
    """``tree, leaf, rank, score, text, spans`` from ``turns`` with ``pos, role, content``:
    each path as one text, and for each turn where its content stands (code points, end
    exclusive) and whether it is learnt (``loss``)."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(HEAD), escape(role, ROLE_CODES), F.lit(COLON + BREAK))
    turns = (turns.withColumn("head", head)
             .withColumn("body", escape(F.coalesce("content", F.lit(""))))
             .withColumn("turn", F.concat("head", "body", F.lit(END + BREAK))))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.length("head")
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"), (role == LOSS_ROLE).alias("loss"))
    rows = (turns.withColumn("start", start)
            .groupBy("tree", "leaf", "rank", "score")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "turn", span.alias("span")))).alias("all")))
    return rows.select("tree", "leaf", "rank", "score", F.array_join(F.col("all.turn"), "").alias("text"),
                       F.col("all.span").alias("spans"))


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best ``branches`` conversations of each reply tree, see ``format_paths``.

    ``messages`` has ``tree, node, parent, role, text, score``; other columns are left
    out.  A null parent, or one that is not in the tree, makes a root; a null role or text
    counts as empty, a null score as 0; rows of one (tree, node) count once; rows with a
    null tree form one tree; messages on or below a cycle have no root and are left out;
    an empty table gives no rows.
    """
    nodes = distinct_nodes(messages.select("tree", "node", "parent", "role", "text", "score"))
    chosen = _step(paths(nodes, branches), nodes.select("tree", "node", "role", F.col("text").alias("content")), "node")
    return format_paths(chosen.select("tree", "leaf", "rank", "score", "pos", F.col("to_role").alias("role"),
                                      F.col("to_content").alias("content")))


def as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations ``conv_id, turn, role, text`` as reply trees: each row
    answers the one before it.  Rows of one turn follow by role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.nullif(F.col("node") - 1, F.lit(0)).alias("parent"),
                       "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (array of role, text, loss) from the text and the spans of ``formatted``."""
    parts = F.split("text", END + BREAK, -1)

    def turn(part: Column, span: Column) -> Column:
        head = F.substring_index(part, COLON, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(HEAD) + 1)), ROLE_CODES).alias("role"),
                        unescape(F.substr(part, F.length(head) + 1 + len(COLON + BREAK))).alias("text"),
                        span["loss"].alias("loss"))
    turns = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.col("spans"), turn)
    return formatted.withColumn("turns", turns)


def digests(formatted: DataFrame) -> DataFrame:
    """The columns of ``op11_reply_trees``, read back from the formatted conversations."""
    rows = read_back(formatted)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return rows.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
                       F.length(learnt).cast("long").alias("loss_chars"),
                       F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
                       F.length("text").cast("long").alias("formatted_chars"))
