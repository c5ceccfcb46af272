"""Chat formatting into a prefix tree.

Every turn is written `<s>role\\ntext</s>`; control strings inside role and text are
escaped reversibly, and a loss mask notes which code points of the turn count for the
loss (an assistant's text).  A turn's key is a pair of sums of hashes of the turns so
far and their places, so that conversations that share initial turns share keys; turns
are numbered and summed within blocks of a conversation first, so that a long
conversation is worked on by several tasks.  Along a conversation the number of
conversations that hold a key falls; the last key of each number is its path in the
compressed tree.  Conversations sorted by their paths are in depth-first order; a node
belongs to the first conversation that has it and is emitted once, there.  Along a
conversation the owners of its nodes change only where it branches off, so what it may
attend to is one interval of the stream per owner, however many turns it has.  All
tables have a row per turn or per interval.

Defined results: rows of a conversation are taken by turn, ties by role and text
(repeated rows stay repeated turns); a null turn comes first; a null role or text is
empty; rows without conv_id form one conversation of their own; an empty table gives
an empty stream; conv_id of any orderable type; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table

OPEN, CLOSE = "<s>", "</s>"
#: Control strings; with n backslashes behind the first sign a string means itself with n - 1.
CONTROL = r"(/?(?:s>|INST\]))"
ROLE_WITH_LOSS = "assistant"
#: Parameters: turn numbers of a block of a conversation; code points of the stream in one bucket of read_back's join.
BLOCK, BUCKET = 1024, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1$2\\$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*){CONTROL}", r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def written(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted and the loss mask (loss_from, loss_to: code points of formatted, end exclusive)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    a = rows.select("conv_id", "turn", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    begin = F.char_length("head")
    end = F.when(F.col("role") == ROLE_WITH_LOSS, begin + F.char_length("body")).otherwise(begin)
    return a.select("conv_id", "turn", "role", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"), begin.cast("long").alias("loss_from"), end.cast("long").alias("loss_to"))


def _same_place(a: DataFrame, b: DataFrame, *also: str) -> Column:
    same = a["conv_id"].eqNullSafe(b["conv_id"])
    for c in also:
        same &= a[c].eqNullSafe(b[c])
    return same


def format_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, turns), a row per turn each.

    texts: conv_id, block and at (place in it), formatted and its loss mask.  turns: the same place, rank (of the conversation in
    depth-first order), i (place in the conversation), key (of all turns so far) and size, without the text.
    """
    own = written(rows).withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "formatted")
    texts = materialize(own.withColumn("at", F.row_number().over(order)).drop("turn", "role"), "chat-texts")
    hashed = texts.select("conv_id", "block", "at", F.md5("formatted").alias("h"), F.char_length("formatted").cast("long").alias("size"))
    held = hashed.groupBy("conv_id", "block").agg(F.max("at").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    firsts = materialize(held.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv_id", "block", "first"), "chat-blocks")
    placed = hashed.join(firsts, _same_place(hashed, firsts, "block")).select(hashed["conv_id"], hashed["block"], "at", (F.col("first") + F.col("at") - 1).alias("i"), "h", "size")
    # the sums of a prefix: of the blocks before, and within the block
    term = lambda seed: F.xxhash64("i", "h", F.lit(seed)).cast("decimal(38,0)")
    placed = materialize(placed.select("conv_id", "block", "at", "i", "size", term(1).alias("s"), term(2).alias("t")), "chat-placed")
    sums = placed.groupBy("conv_id", "block").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    zero = F.lit(0).cast("decimal(38,0)")
    ahead = materialize(sums.select("conv_id", "block", F.coalesce(F.sum("s").over(before), zero).alias("s0"), F.coalesce(F.sum("t").over(before), zero).alias("t0")), "chat-sums")
    so_far = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("s", F.sum("s").over(so_far)).withColumn("t", F.sum("t").over(so_far))
    key = F.concat_ws(":", (F.col("s") + F.col("s0")).cast("string"), (F.col("t") + F.col("t0")).cast("string"))
    keyed = summed.join(ahead, _same_place(summed, ahead, "block")).select(summed["conv_id"], summed["block"], "at", "i", F.md5(key.cast("binary")).alias("key"), "size")
    keyed = materialize(keyed, "chat-keyed")
    # the path of a conversation: the last key of each number of conversations that hold it
    spread = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "chat-spread")
    ends = keyed.select("conv_id", "i", "key").join(spread, "key").groupBy("conv_id", "held").agg(F.max(F.struct("i", "key")).alias("x"))
    paths = ends.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["key"]).alias("path"))
    in_order = materialize(paths, "chat-paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranks = materialize(in_order.select(F.monotonically_increasing_id().alias("rank"), "conv_id"), "chat-ranks")
    turns = keyed.join(ranks, _same_place(keyed, ranks)).select("rank", keyed["conv_id"], "block", "at", "i", "key", "size")
    return texts, materialize(turns, "chat-turns")


def prefix_tree(texts: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, attention).

    stream, a row per distinct node: start (place in the stream), position (place in the conversation), formatted and
    its loss mask.  attention, a row per conversation and owner of nodes in it: rank, conv_id, start, size; its rows up to a node's
    own interval are what the node attends to.
    """
    owners = materialize(turns.groupBy("key").agg(F.min("rank").alias("segment")), "chat-owners")
    owned = materialize(turns.join(owners, "key").drop("key"), "chat-owned")
    emitted = owned.where("segment = rank").groupBy("rank").agg(F.sum("size").alias("n"))
    parted = materialize(emitted.withColumn("part", F.shiftright("rank", 33)), "chat-emitted")
    sums = parted.groupBy("part").agg(F.sum("n").alias("sum"))  # a row per partition of the sort
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = materialize(parted.withColumn("within", within).join(before, "part").select(F.col("rank").alias("segment"), (F.col("before") + F.col("within")).alias("start")), "chat-starts")
    runs = owned.groupBy("rank", "segment").agg(F.first("conv_id").alias("conv_id"), F.sum("size").alias("size"))
    attention = materialize(runs.join(starts, "segment").select("rank", "conv_id", "segment", "start", "size"), "chat-attention", keep=True)
    # a node's place: its segment's start and position and the sizes of the segment's nodes before it
    held = Window.partitionBy("rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    own = owned.where("segment = rank").withColumn("inside", F.sum("size").over(held) - F.col("size")).select("rank", "conv_id", "block", "at", "inside")
    lead = attention.groupBy("rank").agg(F.sum(F.when(F.col("segment") != F.col("rank"), F.col("size")).otherwise(0)).alias("shared"), F.max(F.when(F.col("segment") == F.col("rank"), F.col("start"))).alias("start"))
    own = own.join(materialize(lead, "chat-lead"), "rank").select("conv_id", "block", "at", (F.col("start") + F.col("inside")).alias("start"), (F.col("shared") + F.col("inside")).alias("position"))
    own = materialize(own, "chat-nodes")
    stream = texts.join(own, _same_place(texts, own, "block", "at")).select("start", "position", "formatted", "loss_from", "loss_to")
    return materialize(stream, "chat-stream", keep=True), attention.drop("segment")


def read_back(stream: DataFrame, attention: DataFrame) -> DataFrame:
    """conv_id, rank and nodes (array of {position, formatted, loss_from, loss_to}, in order) of each conversation: what stands in the
    stream under its intervals."""
    buckets = F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.col("size") - 1) / BUCKET))
    wanted = attention.select("rank", "conv_id", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"), F.explode(buckets).alias("bucket"))
    parts = wanted.join(stream.withColumn("bucket", F.floor(F.col("start") / BUCKET)), "bucket").where("start >= begin and start < end")
    nodes = F.sort_array(F.collect_list(F.struct("position", "formatted", "loss_from", "loss_to")))
    return parts.groupBy("rank").agg(F.first("conv_id").alias("conv_id"), nodes.alias("nodes"))


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, text = formatted[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape_role(role), unescape(text)


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for nodes in batch["nodes"]:
            whole, loss, n_loss, n_all = hashlib.sha256(), hashlib.sha256(), 0, 0
            for x in nodes:
                role, text = parse(x["formatted"])
                whole.update(f"{role}\n{text}\n".encode())
                counted = unescape(x["formatted"][x["loss_from"] : x["loss_to"]])
                loss.update(counted.encode())
                n_loss, n_all = n_loss + len(counted), n_all + len(x["formatted"])
            out.append((len(nodes), whole.hexdigest(), n_loss, loss.hexdigest(), n_all))
        frame = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield pd.concat([batch["conv_id"].reset_index(drop=True), frame], axis=1)


#: The conversation of control strings that the contract adds.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    with scratch(spark):
        stream, attention = prefix_tree(*format_turns(rows.unionByName(spark.createDataFrame(ADDED, rows.schema))))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return read_back(stream, attention).select("conv_id", "nodes").mapInPandas(digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


QUERIES = {"op10_chat_format": op10_chat_format}
SQL: dict[str, str] = {}
SQL["op10_chat_format"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), own AS (
  SELECT *, '<s>' || role || chr(10) || regexp_replace(text, '([<\\[])(\\\\*)(/?(?:s>|INST\\]))', '\\1\\2\\\\\\3', 'g') || '</s>' AS formatted FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, formatted)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, formatted), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM own GROUP BY conv_id
"""
