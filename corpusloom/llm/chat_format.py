"""Chat formatting with a grammar round trip.

A conversation is rendered by a template that escapes the control strings inside texts, reparsed by a deterministic parser
and compared with its source; turns that don't come back equal are escaped further, until all do. A backslash takes the
next character literally; one stands before each backslash and before the last character of each control string, also
of overlapping ones, so no text holds a control string as it is.

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  (blank) text </s>
    any other  <|role|> text <|end|>

Null texts and roles count as empty. Turns are ordered by turn (nulls first), then role, then text, so ties and repeated
rows have a fixed order; rows without a conversation id form one conversation of their own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table

OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": " "}
CLOSE = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}
OTHER = " <|end|>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|end|>")
_CONTROL = re.compile(r"(\\" + "".join(f"|(?<={re.escape(c[:-1])}){re.escape(c[-1])}" for c in CONTROL) + ")")
_ALL = re.compile(r"([^0-9A-Za-z])", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, level: int) -> str:
    """1: backslashes and the ends of control strings; 2: all but ASCII letters and digits."""
    return (_CONTROL if level == 1 else _ALL).sub(r"\\\1", text)


def render_turn(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn as text, and where its body starts and ends in it."""
    start = OPEN.get(role) or f"<|{escape(role, 2)}|> "
    body = escape(text, level)
    return start + body + CLOSE.get(role, OTHER), len(start), len(start) + len(body)


def _until(s: str, at: int, close: str) -> tuple[str, int, int]:
    """Unescaped text up to the first unescaped close; where it ends, and the place behind the close."""
    i = at
    while True:
        end, back = s.find(close, i), s.find("\\", i)
        if end < 0:
            raise ValueError("a turn has no end")
        if back < 0 or back >= end:
            raw = s[at:end]
            return _UNESCAPE.sub(r"\1", raw) if "\\" in raw else raw, end, end + len(close)
        i = back + 2


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(s):
        role = next((r for r, o in OPEN.items() if s.startswith(o, at)), None)
        if role is not None:
            at += len(OPEN[role])
        elif s.startswith("<|", at):
            role, _, at = _until(s, at + 2, "|> ")
        else:
            raise ValueError("no turn starts here")
        text, end, behind = _until(s, at, CLOSE.get(role, OTHER))
        out.append((role, text, at, end))
        at = behind
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (of code points) of the assistant's bodies, which bear the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        for level in (1, 2):
            piece, start, end = render_turn(role, text, level)
            try:
                # the grammar has no state between turns, so a conversation comes back if each of its turns does
                if [x[:2] for x in parse(piece)] == [(role, text)]:
                    break
            except ValueError:
                continue
        else:
            raise AssertionError("the full escape always comes back")
        out.append(piece)
        if role == "assistant":
            spans.append((at + start, at + end))
        at += len(piece)
    whole = "".join(out)
    if [x[:2] for x in parse(whole)] != turns:  # escape everything: each body is then free of markers
        pieces = [render_turn(r, t, 2) for r, t in turns]
        whole, spans, at = "".join(p[0] for p in pieces), [], 0
        for (role, _), (piece, start, end) in zip(turns, pieces, strict=True):
            if role == "assistant":
                spans.append((at + start, at + end))
            at += len(piece)
    return whole, spans


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation. A partition is streamed: only one conversation is held."""

    def run(batches):
        key, turns, started = None, [], False
        done: list = []

        def flush():
            done.append((key, *format_turns(turns)))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["conv_id", "formatted", "loss_spans"])
            done.clear()
            return out

        held = 0
        for b in batches:
            for k, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if started and k != key:
                    flush()
                    held += len(done[-1][1])
                    turns = []
                    if len(done) >= 1000 or held > 1 << 24:
                        held = 0
                        yield batch()
                key, started = k, True
                turns.append((r or "", t or ""))
        if started:
            flush()
        yield batch()

    named = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = named.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start int, end int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted text and its loss mask."""

    def run(batches):
        for b in batches:
            rows = []
            for k, s, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = 0
                mask = {(x["start"], x["end"]) for x in spans}
                for role, text, start, end in parse(s):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if (start, end) in mask:
                        chars += len(text)
                        loss.update(text.encode("utf-8", "surrogatepass"))
                rows.append((k, n, turns.hexdigest(), chars, loss.hexdigest(), len(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_conversations(rows.unionByName(tricky)))


def _length_sql() -> str:
    """Code points of a formatted turn: its text, a character for each backslash and each end of a control string, and marks."""
    ends = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"))
    marks = " ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)
    return f"length(t) + {ends} + CASE r {marks} ELSE length(r) + length(regexp_replace(r, '[0-9A-Za-z]', '', 'g')) + {len('<|') + len('|> ') + len(OTHER)} END"


SQL = f"""WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 x AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM a)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256, sum({_length_sql()})::BIGINT AS formatted_chars FROM x GROUP BY conv_id"""
