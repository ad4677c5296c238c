"""Chat formatting of reply trees with DataFrame operations only.

``reply_paths`` doubles ancestor links by self-joins (a round for each power of two of the depth),
sums scores along root-to-leaf paths on the way, ranks the leaves of each tree, and expands only the
chosen ones back into their messages. ``format_paths`` renders each path as one conversation, with
control characters inside texts escaped reversibly and the loss mask given as code point spans.

Defined cases: null text and null role count as empty; an unknown or null parent makes a root;
messages that only hang on a cycle have no root and are left out; of rows repeating a message id all
but the least (by parent, role, text) are dropped; ties between leaves go to the smaller leaf id; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BEGIN, END = "<s>", "</s>"
#: Escapes in order; decoding applies them backwards. Encoded text has no "<", "[" or "]" and each backslash starts a pair.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d"))


def escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), ESCAPES[::-1], text)


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each reply tree: (root, leaf, rank, id, step), step 0 at the root.

    messages: id (any orderable type), parent (same type, null at a root), score (double).
    """
    nodes = messages.groupBy("id").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    nodes = materialize(nodes.join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score")))
    # links: id -> the ancestor 2^k steps up; those that reach past the root are done
    links, jumps, done = nodes.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), "score", F.lit(1).cast("long").alias("depth")), [], []
    limit = nodes.count()
    for k in range(limit.bit_length() + 1):
        done.append(links.filter("up is null").select("id", "root", "score", "depth"))
        links = links.filter("up is not null")
        if links.isEmpty():
            break
        jumps.append(links.select("id", F.col("up").alias("to")))
        if (1 << k) > limit:  # only cycles are left
            break
        finished = reduce(DataFrame.unionByName, [d.select("id", F.lit(None).cast(nodes.schema["up"].dataType).alias("up"), "root", "score", "depth") for d in done])
        far = finished.unionByName(links.select("id", "up", F.lit(None).cast(nodes.schema["up"].dataType).alias("root"), "score", "depth"))
        far = far.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        links = materialize(links.drop("root").join(far, "up").select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth")))
    whole = reduce(DataFrame.unionByName, done)
    parents = nodes.filter("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = whole.join(parents, "id", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc(F.col("score") / F.col("depth")), "id")
    chosen = materialize(leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches).select("root", F.col("id").alias("leaf"), "rank", "depth"))
    paths = chosen.select("root", "leaf", "rank", F.col("leaf").alias("id"), (F.col("depth") - 1).alias("step"))
    for k, jump in enumerate(jumps):
        # the top 2^k messages of a path have no link that long
        up = paths.join(jump, "id").select("root", "leaf", "rank", F.col("to").alias("id"), (F.col("step") - (1 << k)).alias("step"))
        paths = materialize(paths.unionByName(up))  # else the plan doubles with each round
    return paths


def format_paths(turns: DataFrame) -> DataFrame:
    """One row (path, formatted, loss_spans, n_turns) for each path of turns (path, step, role, text)."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = turns.select("path", "step", F.concat(F.lit("["), role, F.lit("]")).alias("_head"), text.alias("_text"), (F.coalesce("role", F.lit("")) == "assistant").alias("_loss"))
    before = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("_head") + F.char_length("_text") + len(END)
    rows = rows.withColumn("_start", len(BEGIN) + F.coalesce(F.sum(length).over(before), F.lit(0)) + F.char_length("_head"))
    span = F.when(F.col("_loss"), F.struct(F.col("_start").cast("long").alias("start"), (F.col("_start") + F.char_length("_text")).cast("long").alias("end")))
    part = F.struct("step", F.concat("_head", "_text", F.lit(END)).alias("part"))
    return rows.groupBy("path").agg(
        F.concat(F.lit(BEGIN), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "")).alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.count("*").alias("n_turns"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, "]", 1), F.lit(2))).alias("role"),
        unescape(F.substr(p, F.locate("]", p) + 1)).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def thread(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the one before it; ids are (conv_id, n).

    Rows of a conversation are numbered by (turn, role, text), nulls first, so repeated turns stay.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", (F.row_number().over(order) - 1).cast("long").alias("n"))
    return rows.select(F.struct("conv_id", "n").alias("id"), F.when(F.col("n") > 0, F.struct(F.col("conv_id"), (F.col("n") - 1).alias("n"))).alias("parent"), "role", "text")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    messages = materialize(thread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
    score = F.char_length(F.coalesce("text", F.lit(""))).cast("double")
    paths = reply_paths(messages.select("id", "parent", score.alias("score")))
    turns = paths.join(messages.select("id", "role", "text"), "id").select(F.col("root.conv_id").alias("path"), "step", "role", "text")
    out = format_paths(turns).withColumns({"_turns": parse(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("path").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '[', '\\b'), ']', '\\d')"
QUERIES = {"op6_chat_trees": op6_chat}
ORACLES = {
    "op6_chat_trees": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), joined as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as learned,
    {len(BEGIN)} + sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {2 + len(END)}) as formatted_chars
  from rows group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(said) as turns_sha256, length(learned)::bigint as loss_chars,
  sha256(learned) as loss_sha256, formatted_chars::bigint as formatted_chars
from joined
""",
}
