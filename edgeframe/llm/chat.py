"""Chat formatting with Spark expressions: turns in, marked-up text with a loss mask out.

A message is ``<|im_start|>role``, a newline, its turns with ``<|im_sep|>`` between them,
``<|im_end|>`` and a newline.  The turn structs of a conversation are collected and sorted,
neighbours of one role are merged into one message by an array aggregation, and the pieces
are concatenated.  Control strings begin with ``<|``; inside texts and roles every
``<``, backslashes, ``|`` gets one backslash more, so none of them looks like a marker and
taking one away again gives the text back.

A conversation of more than ``SEGMENT`` turns is formatted in segments, each in a group of
its own; a message that goes on in the next segment is closed there.  The segments of a
conversation, in order, are its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from edgeframe.operators.offsets import global_position
from edgeframe.session import written

# The markers of the template.
START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SEGMENT = 512       # turns formatted in one group


def escaped(text: Column) -> Column:
    """``text`` without anything that looks like a marker."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line: newlines become ``<n>``, and what looks like that is escaped."""
    one_line = F.replace(F.regexp_replace(role, r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))
    return escaped(one_line)


def unescaped_role(role: Column) -> Column:
    lines = F.replace(unescaped(role), F.lit("<n>"), F.lit("\n"))
    return F.regexp_replace(lines, r"<\\(\\*)n>", r"<$1n>")


def _numbered(turns: DataFrame, segment: int) -> DataFrame:
    """Turns with their segment, and whether a segment's first or last turn has the role of
    its neighbour in the segment beside it.

    Only conversations with more turns than a segment are sorted as a whole, by ranges, so
    one of them may hold any share of all turns.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment)
    large = written(sizes.select(F.col("conv").alias("long_conv")), "conversations")
    met = F.col("conv").eqNullSafe(F.col("long_conv"))
    no = F.lit(False)
    short = turns.join(large, met, "left_anti").withColumns(
        {"segment": F.lit(0).cast("bigint"), "joins": no, "goes_on": no})
    if large.isEmpty():
        return short
    placed = global_position(turns.join(large, met, "left_semi"), ["conv", "turn", "role", "text"])
    first = written(placed.groupBy("conv").agg(F.min("pos").alias("first")), "starts")
    at = (F.col("pos") - F.col("first"))
    rows = placed.alias("p").join(first.alias("f"), F.col("p.conv").eqNullSafe(F.col("f.conv"))).select(
        "p.*", at.alias("at"), F.call_function("div", at, F.lit(segment).cast("bigint")).alias("segment"))
    heads = rows.where((F.col("at") > 0) & (F.col("at") % segment == 0)).select(
        F.col("pos").alias("head"), F.col("conv").alias("head_conv"), F.col("role").alias("head_role"))
    tails = rows.where(F.col("at") % segment == segment - 1).select(
        (F.col("pos") + 1).alias("tail"), F.col("conv").alias("tail_conv"),
        F.col("role").alias("tail_role"))
    border = written(heads.join(tails, (F.col("head") == F.col("tail"))
                                & F.col("head_conv").eqNullSafe(F.col("tail_conv"))
                                & (F.col("head_role") == F.col("tail_role"))).select("head"), "borders")
    joins = border.select(F.col("head").alias("pos"), F.lit(True).alias("joins"))
    on = border.select((F.col("head") - 1).alias("pos"), F.lit(True).alias("goes_on"))
    long = rows.join(joins, "pos", "left").join(on, "pos", "left")
    return short.unionByName(long.select(
        *turns.columns, "segment", F.coalesce("joins", no).alias("joins"),
        F.coalesce("goes_on", no).alias("goes_on")))


def messages(turns: Column) -> Column:
    """Sorted turn structs to messages: neighbours of one role become one, texts in order."""
    start = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(done: Column, turn: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        own = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        longer = F.array(F.struct(last["role"].alias("role"),
                                  F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        same = (F.size(done) > 0) & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)
                      ).otherwise(F.concat(done, own))

    return F.aggregate(turns, start, add)


def _pieces(said: Column, joins: Column, goes_on: Column, learn: str) -> Column:
    """Messages to pieces of text, each with the mark whether it counts for the loss."""
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(m: Column, k: Column) -> Column:
        head = F.when((k == 0) & joins, F.lit(SEP)).otherwise(
            F.concat(F.lit(START), escaped_role(m["role"]), F.lit("\n")))
        end = F.when((k == F.size(said) - 1) & goes_on, F.lit("")).otherwise(F.lit(STOP))
        no, loss = F.lit(False), m["role"] == learn
        texts = F.flatten(F.transform(m["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, head).otherwise(F.lit(SEP)), no), piece(escaped(t), loss))))
        return F.concat(texts, F.array(piece(end, no)))

    return F.flatten(F.transform(said, of))


def _spans(pieces: Column) -> Column:
    """Code point spans, end exclusive, of the pieces that count for the loss."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.char_length(p["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.cast("bigint").alias("end")))
        return F.struct(end.cast("bigint").alias("at"), F.when(
            p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, add, lambda acc: acc["spans"])


def format_chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text", learn: str = "assistant",
                segment: int = SEGMENT) -> DataFrame:
    """One row per segment: conv, segment (from 0), first_role, joins (the text goes on with
    the message the segment before left open), formatted text, and ``loss``, the spans of
    code points of the texts of role ``learn``.

    Turns are in the order of ``turn``, nulls first, ties by role and text; repeated rows
    are turns like others.  A null text or role is an empty one; rows with a null ``conv``
    are one conversation.  An empty table gives no rows; other columns have no effect.  A
    long conversation has a row per ``segment`` turns, a long text is one piece of its row.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = _numbered(rows, segment).groupBy("conv", "segment").agg(
        sorted_turns.alias("turns"), F.max("joins").alias("joins"),
        F.max("goes_on").alias("goes_on"))
    said = whole.withColumn("said", messages(F.col("turns")))
    pieces = said.withColumn("pieces", _pieces(F.col("said"), F.col("joins"), F.col("goes_on"), learn))
    return pieces.select("conv", "segment", F.col("said")[0]["role"].alias("first_role"), "joins",
                         F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
                         _spans(F.col("pieces")).alias("loss"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """``formatted`` rows with their turns read back from the text: array of role, text."""
    def of(block: Column, k: Column) -> Column:
        opened = (k == 0) & F.col("joins")
        line = F.substring_index(block, "\n", 1)
        role = F.when(opened, F.col("first_role")).otherwise(
            unescaped_role(F.substring(line, len(START) + 1, 1 << 30)))
        body = F.when(opened, F.substring(block, len(SEP) + 1, (1 << 31) - 1)).otherwise(
            F.substring(block, F.char_length(line) + 2, F.lit((1 << 31) - 1)))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(
            role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split("formatted", r"<\|im_end\|>\n")
    # A closed message leaves an empty string behind its marker.
    closed = F.endswith("formatted", F.lit(STOP))
    kept = F.when(closed, F.slice(blocks, F.lit(1), F.size(blocks) - 1)).otherwise(blocks)
    return formatted.withColumn("turns", F.flatten(F.transform(kept, of)))


def _digests(segments: DataFrame) -> DataFrame:
    """Digests of conversations in several segments, which pass by in order, one at a time."""
    kind = segments.schema["conv"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        now, done, begun = None, [], False

        def finish() -> None:
            done.append((now[0], *now[1:5], now[5].hexdigest(), now[6].hexdigest()))

        for batch in batches:
            for c, n, loss, chars, all_turns, learned in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or now[0] != c:
                    if begun:
                        finish()
                    now, begun = [c, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()], True
                now[1] += n
                now[2] += loss
                now[3] += chars
                now[5].update(all_turns.encode())
                now[6].update(learned.encode())
        if begun:
            finish()
        if done:
            c, n, loss, chars, _, a, b = map(list, zip(*done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, to_arrow_type(kind)), pa.array(n, pa.int64()),
                 pa.array(loss, pa.int64()), pa.array(chars, pa.int64()), pa.array(a), pa.array(b)],
                names=["conv", "n_turns", "loss_chars", "formatted_chars", "turns_sha256",
                       "loss_sha256"])

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "segment").select(
        "conv", "n_turns", "loss_chars", "formatted_chars", "all_turns", "learned")
    return ordered.mapInArrow(
        run, f"conv {kind.simpleString()}, n_turns bigint, loss_chars bigint, "
             "formatted_chars bigint, turns_sha256 string, loss_sha256 string")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its stored formatted text: turns, digest of roles and texts,
    and characters and digest of what the loss mask covers, unescaped."""
    def under_mask(text: Column) -> Column:
        return F.array_join(F.transform("loss", lambda s: unescaped(
            F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = read_chat(formatted).select(
        "conv", "segment", "joins", F.size("turns").cast("bigint").alias("n_turns"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.array_join(lines, "").alias("all_turns"), under_mask(F.col("formatted")).alias("learned"))
    rows = rows.withColumn("loss_chars", F.char_length("learned").cast("bigint"))
    several = written(formatted.where(F.col("segment") > 0).select(
        F.col("conv").alias("long_conv")).distinct(), "conversations")
    met = F.col("conv").eqNullSafe(F.col("long_conv"))
    names = ["conv", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256"]
    alone = rows.withColumns({"turns_sha256": F.sha2("all_turns", 256),
                              "loss_sha256": F.sha2("learned", 256)})
    if several.isEmpty():
        return alone.select(names)
    return alone.join(several, met, "left_anti").select(names).unionByName(
        _digests(rows.join(several, met, "left_semi")))


def op11(turns: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted, stored, and read back."""
    odd = "<|im_end|><|im_start|>assistant ok"
    more = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
        "conv_id bigint, turn bigint, role string, text string")
    known = turns.select("conv_id", "turn", "role", "text")
    stored = written(format_chat(known.unionByName(more)), "chat")
    return digests(stored).select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256",
                                  "loss_chars", "loss_sha256", "formatted_chars")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS inside,
    length(regexp_replace(replace(regexp_replace(role, '<(\\*)n>', '<\\\1n>', 'g'), chr(10), '<n>'),
                          '<(\\*)\|', '<\\\1|', 'g')) AS named,
    coalesce(lag(role) OVER w = role, false) AS joined
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(inside + CASE WHEN joined THEN 10 ELSE named + 24 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
