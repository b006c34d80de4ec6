"""Operator 3, chat formatting in budgeted windows.

Turns are put in order by conversation, turn, role and text and given their token counts and prefix
sums. Prefix sums choose the windows: a conversation is cut into stripes of ``budget`` tokens, a turn belongs
to the stripe in which it begins, and a stripe is packed into windows of consecutive turns that fit the
budget (a longer turn is a window of its own). Each window begins with the system turn of its conversation
and with repeated history: the turns before it that begin within the last ``history`` tokens. Repeated turns,
targets among them, are masked: the loss spans hold each assistant text once.

Prefix sums are taken over range partitions: sums within a partition, shifted by the sums of
the partitions before, so one conversation may spread over many tasks. A stripe and its history have a bounded
number of tokens but for turns longer than the budget, so what a task holds at a time stays small however long a conversation is.

The template marks the turns with control strings. Where a text holds a control string, behind any
number of backslashes, one backslash is added; texts and control strings are parted by a space. Reading
takes the backslash away again, so every text comes back exactly.

Defined results: null texts and roles are empty; turns that share all of their keys keep any order, since they are
equal; a null conversation is a conversation; empty turns count their marks; roles other than
user, assistant and system get a general mark; an empty table gives no windows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, table
from srclens.llm.tokens import VOCABULARY, Counter
from srclens.session import written

BUDGET, HISTORY = 2048, 256
MARK_TOKENS = 2
"""What the two marks of a turn count; so no turn is free and no stripe holds endless empty turns."""
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
WINDOWS = "conv_id long, stripe long, window int, n_repeated int, n_turns int, text string, loss array<struct<start:long,end:long>>"
_WINDOW_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("stripe", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_HEAD, _PAST, _OWN = 0, 1, 2
_CONTROL = "|".join(map(re.escape, sorted({x for pair in MARKS.values() for x in pair} | set(OTHER))))
_IN_TEXT = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")


def escape(text: str) -> str:
    return _IN_TEXT.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its escaped text begins and ends in it."""
    body = escape(text)
    if role in MARKS:
        head, tail = f"{MARKS[role][0]} ", f" {MARKS[role][1]}"
    else:
        head, tail = f"{OTHER[0]} {escape(role)} {OTHER[1]} ", f" {OTHER[2]}"
    return head + body + tail, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """``role, text, start, end`` of each turn of a window; places are those of the escaped text."""
    opens, found, at = {a: (role, b) for role, (a, b) in MARKS.items()}, [], 0
    marks = [(m.start(), m.end(), m.group(2)) for m in _IN_TEXT.finditer(formatted) if not m.group(1)]
    while at < len(marks):
        _, end, mark = marks[at]
        if mark in opens:
            role, close = opens[mark]
            assert marks[at + 1][2] == close, "a turn that does not close"
            start, stop, step = end + 1, marks[at + 1][0] - 1, 2
        else:
            assert mark == OTHER[0] and marks[at + 1][2] == OTHER[1] and marks[at + 2][2] == OTHER[2], "a turn that does not close"
            role = unescape(formatted[end + 1 : marks[at + 1][0] - 1])
            start, stop, step = marks[at + 1][1] + 1, marks[at + 2][0] - 1, 3
        found.append((role, unescape(formatted[start:stop]), start, stop))
        at += step
    return found


def _numbered(turns: DataFrame, order: list[str], tokens: Column) -> DataFrame:
    """``turns`` with ``tokens``, ``before``: the tokens of their conversation before them, and ``place``, their global order.

    Tokens are counted after the range partitioning, which reads its input twice.
    """
    local = F.monotonically_increasing_id()
    kept = turns.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*order)
    kept = written(kept.withColumn("tokens", tokens).withColumn("place", local).withColumn("part", F.shiftright("place", 33)), "turns")
    inside = Window.partitionBy("part", "conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("part", "conv_id").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sums.select(F.col("part").alias("__part"), F.col("conv_id").alias("__conv"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("__offset"))
    offsets = written(offsets.filter("__offset > 0"), "offsets")  # conversations that a partition border cuts
    same = (F.col("part") == F.col("__part")) & F.col("conv_id").eqNullSafe(F.col("__conv"))
    return (
        kept.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, same, "left")
        .withColumn("before", F.col("inside") + F.coalesce("__offset", F.lit(0)))
        .drop("inside", "__part", "__conv", "__offset", "part")
    )


def pack(rows: list[dict], budget: int, history: int) -> list[dict]:
    """The windows of one stripe; ``rows``: its head, the turns before it and its own turns, in order."""
    head = next((r for r in rows if r["kind"] == _HEAD), None)
    at_head = lambda r: head is not None and r["place"] == head["place"]
    old = [r for r in rows if r["kind"] == _PAST and not at_head(r)]
    new = [r for r in rows if r["kind"] == _OWN]
    out: list[dict] = []
    at = 0
    while at < len(new):
        shown = [head] if head is not None and not at_head(new[at]) else []
        room = min(history, budget - sum(r["tokens"] for r in shown) - new[at]["tokens"])
        again: list[dict] = []
        for r in reversed(old):  # the last turns before the window that fit
            if r["tokens"] > room:
                break
            again.insert(0, r)
            room -= r["tokens"]
        shown += again
        used, end = sum(r["tokens"] for r in shown), at
        while end < len(new) and (end == at or used + new[end]["tokens"] <= budget):
            used += new[end]["tokens"]
            end += 1
        text, spans = "", []
        for k, r in enumerate(shown + new[at:end]):
            marked, start, stop = turn_text(r["role"], r["text"])
            if r["role"] == "assistant" and k >= len(shown):
                spans.append({"start": len(text) + start, "end": len(text) + stop})
            text += marked + "\n"
        key = {c: rows[0][c] for c in ("conv_id", "stripe")}
        out.append(key | {"window": len(out), "n_repeated": len(shown), "n_turns": len(shown) + end - at, "text": text, "loss": spans})
        old += [r for r in new[at:end] if not at_head(r)]
        at = end
    return out


def format_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """``conv_id, stripe, window, n_repeated, n_turns, text, loss``: windows are ordered by stripe and window.

    ``n_turns`` turns, the first ``n_repeated`` of them repeated; ``loss`` spans are code points of ``text``.
    """
    assert 0 <= history < budget
    bounded_batches(turns.sparkSession)
    path = tokenizer_path or public_tokenizers.path(VOCABULARY)

    @pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series([n + MARK_TOKENS for n in counter.counts(texts.tolist())])

    named = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    placed = written(_numbered(named, ["conv_id", "turn", "role", "text"], tokens("text")), "placed")
    first = placed.groupBy("conv_id").agg(F.min_by(F.struct("role", "text", "tokens", "place"), "place").alias("head"))
    system = written(first.filter("head.role = 'system'").select(F.col("conv_id").alias("__conv"), "head"), "systems")

    stripe = F.floor(F.col("before") / budget)
    turn = ["place", "role", "text", "tokens"]
    own = placed.select("conv_id", stripe.alias("stripe"), F.lit(_OWN).alias("kind"), *turn)
    late = placed.filter(F.col("before") >= (stripe + 1) * budget - history)
    past = late.select("conv_id", (stripe + 1).alias("stripe"), F.lit(_PAST).alias("kind"), *turn)
    stripes = own.select("conv_id", "stripe").distinct()
    heads = stripes.join(system, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "stripe", F.lit(_HEAD).alias("kind"), *[f"head.{c}" for c in turn])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes come in order, one after another; only one is held."""
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (row["conv_id"], row["stripe"]) != (held[0]["conv_id"], held[0]["stripe"]):
                    out += pack(held, budget, history)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist(pack(held, budget, history), schema=_WINDOW_SCHEMA)

    together = own.union(past).union(heads).repartition("conv_id", "stripe").sortWithinPartitions("conv_id", "stripe", "kind", "place")
    return together.mapInArrow(packed, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the windows.

    A digest of a whole conversation takes its turns one after another; they stream through a task in order, one
    window at a time, and are never gathered.
    """
    bounded_batches(windows.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=schema)

        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        now, state = None, None

        def close() -> dict:
            n, all_turns, chars, loss, size = state
            return {"conv_id": now, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(close())
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(row["text"])
                assert len(turns) == row["n_turns"], "turns were lost"
                for role, text, _, _ in turns[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(row["text"])
            yield result(done)
        if state is not None:
            yield result([close()])

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "stripe", "window")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    fixed = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(fixed)
    return digests(format_windows(turns))
