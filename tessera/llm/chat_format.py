"""Conversations as training windows within a token budget.

A turn is written as ``### role:``, its text, and ``</turn>``, each on lines of their own, with a
backslash before every backslash, ``###`` and ``</turn>`` of the text (and ``:`` and line ends of the
role), so that the marks can be told from the text and the text can be read back.

Windows come from prefix sums of turn tokens. With ``room`` for what the system turn leaves of
the budget and a history of ``h`` tokens, turns that begin in the same stretch of ``room - h``
tokens form a window; a turn of more than ``h`` tokens has a window of its own. So new turns
never exceed the room unless one turn alone does, and the turns before them fill what is left,
up to ``h`` tokens, as repeated history. Every window opens with the conversation's system
turn. The loss covers assistant texts where they are new; repeated ones are masked.

Prefix sums are taken in two steps, within blocks of ``BLOCK`` turn numbers and over the blocks'
sums, so one long conversation is spread over many tasks; history is found by an equi-join on
stretches of ``h`` tokens.

Defined cases: a null text is empty, a null role is the role ``""``; null ids form one
conversation; turns are ordered by number (nulls first), then role, then text, and repeated
rows are turns of their own; a system turn elsewhere than at the start is an ordinary turn; a
system turn that leaves less than twice the history in the budget makes windows exceed it by
what is missing; other columns are not read; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

BUDGET = 1024
HISTORY = 256
#: Turn numbers in one block of the first prefix sum.
BLOCK = 256

OPEN, CLOSE = "### ", "\n</turn>\n"
_MARKED = r"\\|###|</turn>"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n(.*?)\n</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_MARKED})", r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.regexp_replace(role, f"({_MARKED}|:|\n)", r"\\$1"), F.lit(":\n"))


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted window."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURN.findall(text)]


def word_pieces(text: Column) -> Column:
    """Runs of letters or digits, and single other signs: a count of tokens without a tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count_tokens: Callable[[Column], Column] = word_pieces,
    conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Columns: the conversation, ``first_turn`` (place of the first new turn), ``n_tokens``, ``repeated``
    (turns at the start that other windows hold as new), ``text``, ``loss`` (spans in code points)."""
    if not 0 < history < budget // 2:
        raise ValueError("history must be positive and less than half the budget")
    body = escaped(F.coalesce(turns[text], F.lit("")))
    named = F.coalesce(turns[role], F.lit(""))
    df = turns.select(
        turns[conversation].alias("conv"), turns[turn].alias("turn"), named.alias("role"), opening(named).alias("open"), body.alias("body"),
    )
    df = df.withColumns({
        "tokens": F.greatest(F.lit(1), count_tokens(F.concat("open", "body", F.lit(CLOSE)))).cast("long"),
        "block": F.floor(F.col("turn") / BLOCK),
    })
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body"), F.col("open")]
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    long = (F.col("tokens") > history).cast("long")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({
        "nth": F.row_number().over(inside) - 1,
        "sum": F.sum("tokens").over(upto),
        "longs": F.sum(long).over(upto),
    })
    # a row for each block: what lies before it, and the conversation's system turn
    blocks = df.groupBy("conv", "block").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("b_sum"), F.sum(long).alias("b_longs"),
        F.max_by(F.struct("role", "open", "body", "tokens"), -F.col("nth")).alias("first"),
    )
    over = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first())
    before = lambda name: F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.select(
        F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), before("n").alias("n_before"), before("b_sum").alias("sum_before"),
        before("b_longs").alias("longs_before"), F.sum("n").over(Window.partitionBy("conv")).alias("of"),
        F.when(start["role"] == "system", start).alias("system"),
    )
    df = df.join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    own = F.coalesce(F.col("system")["tokens"], F.lit(0))
    own_long = (own > history).cast("long")
    df = df.withColumns({"place": F.col("n_before") + F.col("nth"), "room": F.greatest(F.lit(budget) - own, F.lit(2 * history))})
    is_system = F.isnotnull("system") & (F.col("place") == 0)
    df = df.where(~is_system | (F.col("of") == 1)).withColumns({
        # a conversation of a system turn alone is one window of that turn
        "system": F.when(F.col("of") > 1, F.col("system")),
        "at": F.when(is_system, 0).otherwise(F.col("sum_before") + F.col("sum") - F.col("tokens") - own),
        "seq": F.when(is_system, 0).otherwise(2 * (F.col("longs_before") + F.col("longs") - own_long) - long),
    })
    df = df.withColumn("k", F.floor(F.col("at") / (F.col("room") - history)))
    df = stage(df.select("conv", "k", "seq", "place", "role", "open", "body", "tokens", "at", "room", "system"), "placed-turns")
    key = ["conv", "k", "seq"]
    piece = lambda new: F.struct(
        F.col("place"), F.lit(new).alias("new"), F.col("open"), F.col("body"), (F.lit(new) & (F.col("role") == "assistant")).alias("loss"), F.col("tokens")
    ).alias("piece")
    heads = df.groupBy(*key).agg(F.min("at").alias("w_at"), F.sum("tokens").alias("w_tokens"), F.first("room").alias("w_room"))
    heads = heads.select(
        F.col("conv").alias("w_conv"), F.col("k").alias("w_k"), F.col("seq").alias("w_seq"), "w_at",
        F.least(F.lit(history), F.greatest(F.lit(0), F.col("w_room") - F.col("w_tokens"))).alias("cap"), F.floor(F.col("w_at") / history).alias("w_cell"),
    )
    near = df.select("conv", "place", "open", "body", "role", "tokens", "at", "system", F.explode(
        F.array(F.floor(F.col("at") / history), F.floor(F.col("at") / history) + 1)).alias("cell"))
    past = near.join(heads, near["conv"].eqNullSafe(heads["w_conv"]) & (near["cell"] == heads["w_cell"])).where(
        (F.col("at") < F.col("w_at")) & (F.col("w_at") - F.col("at") <= F.col("cap"))
    )
    members = df.select(*key, "system", piece(True)).union(
        past.select(F.col("w_conv").alias("conv"), F.col("w_k").alias("k"), F.col("w_seq").alias("seq"), "system", piece(False))
    )
    # at most a window's tokens in one group, as every turn has a token or more
    built = members.groupBy(*key).agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.first("system", ignorenulls=True).alias("system"))
    first = F.filter("pieces", lambda p: p["new"])[0]["place"]
    lead = F.struct(
        F.lit(0).cast("long").alias("place"), F.lit(False).alias("new"), F.col("system")["open"].alias("open"), F.col("system")["body"].alias("body"),
        F.lit(False).alias("loss"), F.col("system")["tokens"].alias("tokens"),
    )
    built = built.withColumns({
        "first_turn": first,
        "pieces": F.when(F.isnull("system"), F.col("pieces")).otherwise(F.concat(F.array(lead), F.col("pieces"))),
    })
    length = lambda p: F.length(p["open"]) + F.length(p["body"]) + len(CLOSE)
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + length(p)).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(p["open"])).alias("start"), (a["at"] + F.length(p["open"]) + F.length(p["body"])).alias("end")
            )))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    # the system turn is new in the window of the turn that follows it
    unseen = F.isnotnull("system") & (F.col("first_turn") == 1)
    return built.select(
        F.col("conv").alias(conversation), F.when(unseen, 0).otherwise(F.col("first_turn")).cast("long").alias("first_turn"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
        F.size(F.filter("pieces", lambda p: ~p["new"])).alias("masked") - unseen.cast("int"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit(CLOSE))), "").alias("text"),
        spans.alias("loss"),
    ).toDF(conversation, "first_turn", "n_tokens", "repeated", "text", "loss")


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of every conversation, read from its windows in order: they stream through the tasks,
    so a conversation takes the memory of one window."""
    kind = formatted.schema[conversation].dataType.simpleString()
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, fresh = None, lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        done: list[list] = []

        def close(name, s) -> None:
            done.append([name, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]])

        def out() -> pa.RecordBatch:
            rows = list(zip(*done, strict=True)) if done else [[]] * 6
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows, types, strict=True)], names=["conv", *columns])

        for batch in batches:
            id_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv"]:
                    if state is not None:
                        close(*state)
                    state = (row["conv"], fresh())
                s = state[1]
                for role, text in read_turns(row["text"])[row["repeated"] :]:
                    s[0] += 1
                    s[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescaped(row["text"][span["start"] : span["end"]])
                    s[2] += len(text)
                    s[3].update(text.encode())
                s[4] += len(row["text"])
            yield out()
        if state is not None:
            close(*state)
            yield out()

    ordered = formatted.select(F.col(conversation).alias("conv"), "first_turn", "repeated", "text", "loss")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "first_turn")
    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(work, schema).withColumnRenamed("conv", conversation)
