"""Chat formatting in budgeted windows with a loss mask.

A conversation is cut into windows of whole turns. Prefix sums of the turns'
tokens decide: with ``s`` half the budget left beside the system turn and the
history, a turn belongs to cell ``floor((end - 1) / s)`` of its conversation,
and a turn longer than ``s`` is a window alone, so that no window exceeds the
budget unless one turn (or the system turn) does by itself. Each window starts with the system
turn, repeats up to ``HISTORY`` tokens of the turns before it, and holds its
own turns. The loss mask covers assistant texts of the window's own turns
only: a repeated target is never trained on twice.

The template writes a system turn as ``<<SYS>>text<</SYS>>``, a user turn as
``[INST]text[/INST]``, an assistant turn as ``<s>text</s>`` and any other role
as ``[TURN]role`` line feed ``text[/TURN]``. In texts and roles each ``<``,
``[`` is followed by, and each backslash doubled to, a backslash; so no control
string occurs in them, and reading the output back gives the same turns.

Prefix sums are distributed: turns are range-partitioned by conversation and
turn and summed inside partitions, then shifted, so a conversation may span
many partitions. Windows hold bounded groups of turns. Only the digests of
``read_back`` pass a whole conversation through one task, as a stream.

Defined results: a null text or role is empty; turns with equal numbers are
ordered by role and text; null conversation ids are one conversation; repeated
rows are turns of their own; an empty table gives no windows; other columns
are not read. A token is four characters of formatted text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsearch.llm.common import join_hot, python_ready, stored

BUDGET, HISTORY, LEAST_SPAN = 2048, 256, 256

#: Control strings by role; other roles use ``OTHER``.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")
TURN = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
    r"|\[TURN\](?P<role>.*?)\n(?P<text>.*?)\[/TURN\]", re.S,
)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\(\\)", lambda m: m[1] or m[2], text)


def _formatted(role: Column, text: Column) -> Column:
    out = F.concat(
        F.lit(OTHER[0]), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(text), F.lit(OTHER[1])
    )
    for name, (first, last) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(first), escape(text), F.lit(last))).otherwise(out)
    return out


def _role(text: str) -> str:
    return re.sub(r"([<\[])\\|\\([\\n])", lambda m: m[1] or ("\n" if m[2] == "n" else m[2]), text)


def parse(window: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    out = []
    for m in TURN.finditer(window):
        role = m.lastgroup if m.lastgroup != "text" else _role(m["role"])
        out.append((role, unescape(m[m.lastgroup])))
    return out


def _summed(turns: DataFrame) -> DataFrame:
    """Turns in order with ``end``, the tokens of all turns up to theirs, and
    ``nth``, their place, both over the whole table."""

    def run(batches):
        part = TaskContext.get().partitionId()
        tokens = rows = 0
        for b in batches:
            ends = np.cumsum(b["tokens"].to_numpy()) + tokens
            places = np.arange(rows, rows + b.num_rows, dtype=np.int64)
            tokens, rows = int(ends[-1]) if len(ends) else tokens, rows + b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ends), pa.array(places)],
                [*b.schema.names, "part", "end", "nth"],
            )

    order = [F.col("key"), F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in turns.dtypes)
    placed = stored(
        turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .mapInArrow(run, f"{kinds}, part int, end long, nth long")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = placed.groupBy("part").agg(F.max("end").alias("tokens_in"), F.count(F.lit(1)).alias("rows_in"))
    shift = sums.select(
        "part", F.coalesce(F.sum("tokens_in").over(before), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("r0"),
    )
    return placed.join(shift, "part").withColumns({"end": F.col("end") + F.col("t0"), "nth": F.col("nth") + F.col("r0")}).drop(
        "part", "t0", "r0"
    )


def windows(conversations: DataFrame, budget=BUDGET, history=HISTORY, least_span=LEAST_SPAN, id_col="conv_id",
            turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``conv_id, window, text, n_repeated, loss``: one row per window.

    ``n_repeated`` leading turns stand in earlier windows too. ``loss`` holds
    the spans of the mask, ``start, end`` in code points of ``text``.
    """
    python_ready(conversations.sparkSession)
    col = {c: F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col)}
    role, text = (F.coalesce(col[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        col[id_col].alias("conv_id"),
        F.coalesce(F.concat(F.lit("c"), col[id_col].cast("string")), F.lit("null")).alias("key"),
        col[turn_col].alias("turn"), role.alias("role"), text.alias("text"), _formatted(role, text).alias("piece"),
    ).withColumn("tokens", F.ceil(F.length("piece") / 4).cast("long"))
    summed = _summed(turns)
    heads = summed.groupBy("key").agg(
        F.min(F.col("end") - F.col("tokens")).alias("base"), F.min("nth").alias("first"),
        F.min_by(F.struct("role", "piece", "tokens"), "nth").alias("head"),
    )
    is_system = F.col("head.role") == "system"
    heads = stored(heads.select(
        "key", "base", "first",
        F.when(is_system, F.col("head.piece")).otherwise("").alias("system"),
        F.when(is_system, F.col("head.tokens")).otherwise(F.lit(0).cast("long")).alias("system_tokens"),
    ))
    span = F.greatest(F.lit(least_span).cast("long"), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    mine = join_hot(summed, heads.drop("system"), "key").withColumns({
        "span": span, "end": F.col("end") - F.col("base"), "nth": F.col("nth") - F.col("first"),
    })
    is_head = (F.col("nth") == 0) & (F.col("system_tokens") > 0)
    # a turn longer than the span is a window alone: the cell of its end, apart
    # from the short turns that end in the cell before (0) and after (2) it
    long = F.col("tokens") > F.col("span")
    mine = stored(mine.withColumns({
        "is_head": is_head, "start": F.col("end") - F.col("tokens"),
        "cell": F.floor((F.col("end") - 1) / F.col("span")), "alone": long & ~is_head,
    }).drop("base", "first", "turn"))
    # at most one long turn ends in a cell, as it is longer than the cell
    longs = mine.where("alone").select("key", "cell", F.col("nth").alias("long_nth"))
    placed = mine.join(longs, ["key", "cell"], "left")
    side = F.when(F.col("long_nth").isNull() | (F.col("nth") < F.col("long_nth")), 0).when(
        F.col("nth") == F.col("long_nth"), 1).otherwise(2)
    placed = stored(placed.withColumn("window", F.col("cell") * 3 + side).drop("long_nth", "alone"))
    own = placed.where("not is_head")
    opened = own.groupBy("key", "window").agg(F.min("start").alias("opens"))
    # history: whole turns that end before a window opens and start at most
    # ``history`` tokens earlier; equi-join on history-wide buckets of the opening
    bucket = F.floor(F.col("opens") / history)
    near = F.explode(F.array(F.floor(F.col("start") / history), F.floor(F.col("start") / history) + 1))
    before = own.withColumn("bucket", near).alias("t").join(
        opened.withColumn("bucket", bucket).select(F.col("key").alias("wkey"), F.col("bucket").alias("wbucket"),
                                                   F.col("window").alias("of"), "opens").alias("w"),
        (F.col("key") == F.col("wkey")) & (F.col("bucket") == F.col("wbucket")),
    ).where((F.col("opens") >= F.col("end")) & (F.col("opens") - F.col("start") <= history))
    parts = own.select("key", "conv_id", "window", "nth", "role", "piece", F.lit(False).alias("repeated")).unionByName(
        before.select("key", "conv_id", F.col("of").alias("window"), "nth", "role", "piece", F.lit(True).alias("repeated"))
    )
    # a conversation of a system turn alone still has one window
    no_parts = F.array().cast("array<struct<nth:bigint,role:string,piece:string,repeated:boolean>>")
    lone = placed.where("is_head").join(own.select("key").distinct(), "key", "left_anti").select(
        "key", "conv_id", F.lit(-1).cast("long").alias("window"), no_parts.alias("parts")
    )
    grouped = parts.groupBy("key", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(F.struct("nth", "role", "piece", "repeated"))).alias("parts"),
    ).select("key", "conv_id", "window", "parts").unionByName(lone)
    first = opened.groupBy("key").agg(F.min("window").alias("opening"))
    full = join_hot(join_hot(grouped, heads.select("key", "system"), "key"), first, "key", "left")
    later = F.coalesce(F.col("window") > F.col("opening"), F.lit(False))
    parsed = full.select(
        "conv_id", "window", "system", "parts",
        (F.when((F.col("system") != "") & later, 1).otherwise(0)
         + F.size(F.filter("parts", lambda p: p["repeated"]))).alias("n_repeated"),
    )
    begin = F.aggregate(
        "parts", F.struct(F.length("system").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                ~p["repeated"] & (p["role"] == "assistant"),
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + len(MARKS["assistant"][0])).alias("start"),
                    (acc["at"] + F.length(p["piece"]) - len(MARKS["assistant"][1])).alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return parsed.select(
        "conv_id", "window",
        F.concat("system", F.array_join(F.transform("parts", lambda p: p["piece"]), "")).alias("text"),
        "n_repeated", begin["spans"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from the windows alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Windows stream through the task of their conversation in order; a task
    holds one window and two running hashes.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches):
        now = None

        def done():
            conv, n, turns, chars, loss, size = now
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        out.append(done())
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"])[r["n_repeated"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    target = unescape(r["text"][s["start"] : s["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(r["text"])
            if out:
                yield _batch(out, b.schema.field("conv_id").type)
            last = b.schema.field("conv_id").type
        if now is not None:
            yield _batch([done()], last)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _batch(rows: list, kind) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
