"""Conversations out of reply trees, formatted for chat training.

Messages name the message they answer. Pointer doubling joins the table with itself: round
k knows of every message what stands 2^k steps above it, so a tree of depth d takes log2 d
rounds of joins over ids, whatever its shape. The branches (root-to-leaf paths) of a tree
are ranked by their score; the chosen ones alone are spelled out, from the leaf up, by
joins with the same rounds in reverse. Texts are joined last, once, to the messages that
stand on a chosen path, and each path is written as one conversation.

The template marks turns by control strings; where a text holds one, a backslash goes
behind the string's first character, one more for each that stands there already. What
was formatted can so be read back exactly.

Built of DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import forget, with_row_key, written

#: Keys looked up from over HOT_ROWS rows are dealt out over SALTS tasks: the HOT_KEYS most
#: frequent of them, so that what is broadcast is bounded; any other key has fewer than one
#: HOT_KEYS-th of all rows.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 1000, 64


@dataclass(frozen=True)
class Template:
    """open + role + line end + text + close is a turn. controls are the strings that may
    not stand in a text as they are: none may begin inside another or hold a backslash.
    learned is the role whose texts are under the loss mask."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        if not {self.open, self.close.strip()} <= {*self.controls} or any(c[0] in d[1:] or "\\" in c for c in self.controls for d in self.controls):
            raise ValueError("controls must hold the marks of a turn; none may begin inside another or hold a backslash")

    def _within(self) -> tuple[str, str]:
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"(?<=[{heads}])", "|".join(re.escape(c[1:]) for c in self.controls)

    def escaped(self, text: Column) -> Column:
        head, rest = self._within()
        return F.regexp_replace(text, rf"{head}(\\*+)(?={rest})", r"$1\\")

    def unescaped(self, text: Column) -> Column:
        head, rest = self._within()
        return F.regexp_replace(text, rf"{head}\\(?=\\*+(?:{rest}))", "")

    def escaped_role(self, role: Column) -> Column:
        """A role on one line: a backslash as \\b, a line end as \\n, then as a text."""
        return self.escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))

    def unescaped_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


# -- reply trees -----------------------------------------------------------------------


def _looked_up(left: DataFrame, key: str, right: DataFrame) -> DataFrame:
    """left with right's columns (its key column is `key` too, each value once), where
    right has the key. Rows of a hot key meet in many tasks, each with a copy of right's."""
    hot = F.broadcast(left.groupBy(key).count().filter(F.col("count") > HOT_ROWS).orderBy(F.desc("count")).limit(HOT_KEYS).select(key, F.lit(True).alias("_hot")))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), 1 + F.floor(F.rand(1) * SALTS)).otherwise(0).cast("int")).drop("_hot")
    copies = right.join(hot, key).withColumn("_salt", F.explode(F.sequence(F.lit(1), F.lit(SALTS)))).drop("_hot")
    return dealt.join(right.withColumn("_salt", F.lit(0)).unionByName(copies), [key, "_salt"]).drop("_salt")


def links(messages: DataFrame) -> DataFrame:
    """node, up, score of messages (_row, tree_id, message_id, parent_id, score): the row
    itself and the row it answers, null for a root. A parent that its tree lacks, or that
    is the message itself, is none. Where rows share an id the first is answered."""
    first = messages.filter("message_id is not null").groupBy("tree_id", "message_id").agg(F.min("_row").alias("up"))
    key = F.xxhash64("tree_id", "parent_id")
    asked = messages.filter("parent_id is not null").select("_row", F.col("tree_id").alias("_tree"), "parent_id", key.alias("_key"))
    held = first.select(F.xxhash64("tree_id", "message_id").alias("_key"), "tree_id", "message_id", "up")
    held = held.groupBy("_key").agg(F.collect_list(F.struct("tree_id", "message_id", "up")).alias("same"))  # one but for colliding hashes
    met = _looked_up(asked, "_key", held).select("_row", "_tree", "parent_id", F.explode("same").alias("s"))
    met = met.filter(F.col("s.tree_id").eqNullSafe(F.col("_tree")) & (F.col("s.message_id") == F.col("parent_id")) & (F.col("s.up") != F.col("_row")))
    return messages.select(F.col("_row").alias("node"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).join(met.select(F.col("_row").alias("node"), F.col("s.up").alias("up")), "node", "left").select("node", "up", "score")


def branches(replies: DataFrame, top: int | None = 1) -> DataFrame:
    """branch (its leaf), rank, position (from 0 at the root), node: the messages of the
    `top` root-to-leaf paths of each tree, or of all, of replies (node, up, score; node
    each once). A branch's score is the sum of its messages'; of equal ones the smaller
    leaf is first. Messages on a cycle, and beneath one, have no root and so no path."""
    start = replies.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.lit(1).cast("long").alias("depth"), "score")
    rounds = [written(start, "replies")]  # what each round has moved: a node is done in the round that finds it no more above
    n = rounds[0].count()
    while len(rounds) <= n.bit_length() + 1 and not (active := rounds[-1].filter("up is not null")).isEmpty():
        known = reduce(DataFrame.unionByName, [r.filter("up is null") for r in rounds[:-1]], rounds[-1])
        above = known.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("score").alias("extra"))
        moved = _looked_up(active.drop("root"), "up", above).select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("extra")).alias("score"))
        rounds.append(written(moved, "paths"))
    state = reduce(DataFrame.unionByName, [r.filter("up is null") for r in rounds])
    leaves = state.join(rounds[0].filter("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc(F.round("score", 9)), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best))
    chosen = chosen if top is None else chosen.filter(F.col("rank") <= top)
    path = written(chosen.select(F.col("node").alias("branch"), "rank", (F.col("depth") - 1).alias("position"), "node"), "chosen")
    for k in reversed(range(len(rounds) - 1)):
        up = rounds[k].filter("up is not null").select("node", "up")
        higher = _looked_up(path, "node", up).select("branch", "rank", (F.col("position") - (1 << k)).alias("position"), F.col("up").alias("node"))
        longer = written(path.unionByName(higher), "chosen")
        forget(path)
        path = longer
    forget(*rounds)
    return path


# -- formatting ------------------------------------------------------------------------


def formatted(path: DataFrame, messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One conversation for each branch of path (branches) over messages (node, tree_id,
    role, text): branch, tree_id, rank, conversation, mask. mask lists what is to be
    learned: turn (from 1), start and length (in characters, start within the turn), at
    (the same start within the conversation). A null text or role counts as empty.

    Texts are joined to their places first, so only those on a path are shuffled again,
    to their branch; a branch is one row, as a text is."""
    said = messages.select("node", "tree_id", template.escaped_role(F.coalesce("role", F.lit(""))).alias("role"), template.escaped(F.coalesce("text", F.lit(""))).alias("text"), (F.col("role") == template.learned).alias("learned"))
    turns = _looked_up(path, "node", said)
    start = len(template.open) + F.length("role").cast("long") + 1
    turn = turns.select("branch", "rank", "position", "tree_id", F.concat(F.lit(template.open), "role", F.lit("\n"), "text", F.lit(template.close)).alias("turn"), F.when(F.col("learned"), start).alias("start"), F.length("text").cast("long").alias("length"))
    before = Window.partitionBy("branch", "rank").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("before", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    whole = turn.groupBy("branch", "rank").agg(F.min("tree_id").alias("tree_id"), F.array_sort(F.collect_list(F.struct("position", "turn", "start", "length", "before"))).alias("t"))
    learned = F.filter("t", lambda x: x["start"].isNotNull())
    mask = F.transform(learned, lambda x: F.struct((x["position"] + 1).cast("int").alias("turn"), x["start"].alias("start"), x["length"].alias("length"), (x["before"] + x["start"]).alias("at")))
    return whole.select("branch", "tree_id", "rank", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("conversation"), mask.alias("mask"))


def conversations(messages: DataFrame, top: int | None = 1, template: Template = Template()) -> DataFrame:
    """The `top` branches of each tree of messages (tree_id, message_id, parent_id, role,
    text, score), each formatted as one conversation: branch, tree_id, rank, conversation,
    mask.

    Every row is a message: rows that repeat an id are answers beside the first, which
    alone is answered; a null message_id is answered by none, a null parent_id or one that
    isn't there makes a root, a null score counts as 0, null trees are one tree of that
    id. Equal scores: the row that comes first in the table. Cycles have no root and are
    in no conversation. Texts are kept whole. An empty table gives no rows; other columns
    are not read."""
    keyed = with_row_key(messages.select("tree_id", "message_id", "parent_id", "role", "text", "score"))
    path = branches(links(keyed.drop("role", "text")), top)
    return formatted(path, keyed.select(F.col("_row").alias("node"), "tree_id", "role", "text"), template)


def read_back(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """rows of formatted() with what their conversation says: turns (array of role, text)
    and learned (array of the texts under the mask), unescaped."""
    pieces = F.split("conversation", re.escape(template.close).replace("\\\n", "\\n"))
    body = lambda p: F.substring(p, len(template.open) + 1, F.length(p))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    text = lambda p: F.substring(body(p), F.length(role(p)) + 2, F.length(p))
    parsed = rows.withColumn("_pieces", pieces).withColumn("_pieces", F.slice("_pieces", F.lit(1), F.size("_pieces") - 1))
    under = F.transform("mask", lambda m: template.unescaped(F.substring(F.get("_pieces", m["turn"] - 1), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return parsed.withColumn("turns", F.transform("_pieces", lambda p: F.struct(template.unescaped_role(role(p)).alias("role"), template.unescaped(text(p)).alias("text")))).withColumn("learned", under).drop("_pieces")


# -- chats by turn ---------------------------------------------------------------------

#: A conversation whose texts are nothing but control strings, formatted with every table.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Conversations of rows (conv_id, turn, role, text), and the probe, formatted: the
    columns of formatted(). A chat is a tree of one branch: each turn answers the one
    before. Rows of one turn stand in the order of role and text; repeated rows all stay;
    null conv_ids are one conversation. The ids alone are ordered and linked, texts wait
    for their places. No turns: the probe alone. Other columns are not read."""
    spark = turns.sparkSession
    keyed = with_row_key(turns.select(F.col("conv_id").alias("tree_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), "node")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast(keyed.schema["tree_id"].dataType).alias("tree_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(template.learned).alias("role"), F.lit(PROBE).alias("text"), (-1 - F.col("id")).alias("node"))
    every = keyed.unionByName(probe)
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "_text", "node")
    ids = every.select("tree_id", "turn", "role", F.sha2("text", 256).alias("_text"), "node")
    replies = ids.select("node", F.lag("node").over(order).alias("up"), F.lit(0.0).alias("score"))
    return formatted(branches(replies), every.select("node", "tree_id", "role", "text"), template)


def digest(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id and what reading each conversation back gives: n_turns, turns_sha256 (role,
    line end, text, line end of each turn), loss_chars and loss_sha256 of all that is
    under the mask, and formatted_chars."""
    read = read_back(rows, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("_said", said).withColumn("_loss", F.array_join("learned", ""))
    return read.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2("_said", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"),
    )
