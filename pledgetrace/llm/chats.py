"""Chat formatting of reply trees, with DataFrame operations only.

A tree has messages with a parent each. Iterative self-joins double the reach of every message
until it knows its root, its depth and the score of its path, then collect the messages of the
chosen paths the same way: a tree of depth d takes log2(d) joins, whatever its width. The best
branches of a tree by score become one conversation each.

The template writes ``[INST] user [/INST]``, `` assistant</s>``, ``<<SYS>>system<</SYS>>`` and, for
other roles, ``[ROLE]role[/ROLE]text</s>``. In texts a backslash becomes ``\\0`` and the n-th control
string ``\\n``, so no control string is left in them, and the way back is exact. The loss mask spans
the texts of the assistant.

Defined cases. A null text or role is empty. Null tree ids are one tree. A message whose parent is
missing is a root; messages on or below a cycle belong to no path. Of equal scores the least leaf
comes first. Messages of equal node ids in one tree are not supported by trees; rows of a plain
conversation are numbered first (by turn, role, text), repeated rows each. Empty tables give no
rows. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..session import stage

#: fixed values: the n-th control string is written \n inside texts
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TURN = r"(?s)\[INST\] .*?\[/INST\]|<<SYS>>.*?<</SYS>>|\[ROLE\].*?</s>| .*?</s>"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0"))
    for n, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"\\{n}"))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for n, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"\\{n}"), F.lit(control))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def rendered(role: Column, text: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(role == "assistant", F.concat(F.lit(" "), text, F.lit("</s>")))
            .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
            .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"), text, F.lit("</s>"))))


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, place, node): the messages of the ``best`` branches of each tree, root
    at place 0. ``messages`` has (tree, node, parent, score), tree and node not null."""
    known = messages.select("tree", F.col("node").alias("parent"))
    up = (messages.join(known.withColumn("_found", F.lit(True)), ["tree", "parent"], "left")
          .select("tree", "node", F.when(F.col("_found"), F.col("parent")).alias("up"),
                  F.when(F.col("_found"), 1).otherwise(0).cast("long").alias("depth"),
                  F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")))
    first = stage(up, "reach")
    done, active, steps = [first.filter("up is null")], first.filter("up is not null"), []
    # a path has no more messages than there are; what is not done then is on or below a cycle
    for _ in range(first.count().bit_length()):
        if active.isEmpty():
            break
        above = active
        for part in done:
            above = above.union(part)
        above = above.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"),
                             F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        steps.append(active)
        # only messages that have not met their root go on
        moved = stage(active.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("total") + F.col("_total")).alias("total")), "reach")
        done.append(moved.filter("up is null"))
        active = moved.filter("up is not null")
    reach = done[0]
    for part in done[1:]:
        reach = reach.union(part)
    leaves = reach.join(first.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    path = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        "tree", F.col("node").alias("leaf"), "rank", "node")
    for step in steps:
        # each round adds the messages 1, 2, 4, … above those already there
        path = stage(path, "path")
        path = path.union(path.join(step.select("tree", "node", "up"), ["tree", "node"]).filter("up is not null").select(
            "tree", "leaf", "rank", F.col("up").alias("node")))
    return path.join(reach.select("tree", "node", F.col("depth").alias("place")), ["tree", "node"]).select(
        "tree", "leaf", "rank", "place", "node")


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of the best branches; spans are [begin, end) in
    characters of ``formatted``. ``messages`` has (tree, node, parent, role, text, score)."""
    held = stage(messages, "messages")
    turns = best_paths(held.select("tree", "node", "parent", "score"), best).join(
        held.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("text")).alias("text")),
        ["tree", "node"])
    turn = F.struct("place", rendered(F.col("role"), F.col("text")).alias("shown"),
                    F.when(F.col("role") == "assistant", F.length("text")).alias("loss"))
    said = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    spans = F.aggregate("turns", start, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["shown"])).alias("at"),
        # behind the blank that opens an assistant's turn
        F.when(t["loss"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + 1).alias("begin"), (acc["at"] + 1 + t["loss"]).alias("end"))))).alias("spans")))
    return said.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
                       spans["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) back from a formatted conversation."""
    def turn(t: Column) -> Column:
        role = (F.when(t.startswith("[INST]"), "user").when(t.startswith("<<SYS>>"), "system")
                .when(t.startswith("[ROLE]"), unescaped(F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
                .otherwise("assistant"))
        text = (F.when(t.startswith("[INST]"), F.substring(t, F.lit(8), F.length(t) - 15))
                .when(t.startswith("<<SYS>>"), F.substring(t, F.lit(8), F.length(t) - 15))
                .when(t.startswith("[ROLE]"), F.regexp_extract(t, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)</s>$", 1))
                .otherwise(F.substring(t, F.lit(2), F.length(t) - 5)))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")


def chain(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees of one branch each."""
    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = numbered(keyed, ["tree"], [F.asc_nulls_first("turn"), "role", "text"], "node")
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                         F.lit(0.0).alias("score"))


#: fixed values: the conversation that the query adds
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESC = "replace(coalesce(text, ''), '\\', '\\0')"
for _n, _c in enumerate(CONTROLS, 1):
    _ESC = f"replace({_ESC}, '{_c}', '\\{_n}')"
ORACLE = f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, {_ESC} as e from r)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum(length(case role when 'user' then '[INST] ' || e || ' [/INST]' when 'assistant' then ' ' || e || '</s>'
  when 'system' then '<<SYS>>' || e || '<</SYS>>' else '[ROLE]' || role || '[/ROLE]' || e || '</s>' end))::bigint as formatted_chars
from t group by conv_id
"""
