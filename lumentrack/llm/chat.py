"""Chat formatting with a grammar round trip.

A turn is rendered as an opening mark, its text and a closing mark:

    user       <s>[INST]text[/INST]
    assistant  <s>[ANS]text</s>
    other      <s>[ROLE=name]text[/ROLE]     (a null role: <s>[ROLE]text[/ROLE])

A backslash before a backslash, ``<`` or ``[`` escapes it. Text is first rendered as it is; the
rendered turn is parsed by a deterministic parser and compared with its source, and where they
differ the conflicting content (control strings and backslashes) is escaped and the turn is
rendered and parsed again, until they are identical.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the template; fixed values that the SQL below repeats.
CONTROL = r"<s>|</s>|\[/?INST\]|\[ANS\]|\[/?ROLE"
_CONFLICT = re.compile(rf"\\|{CONTROL}")
_ESCAPED = re.compile(r"\\([\\<\[])")
_TOKEN = re.compile(r"(?P<esc>\\[\\<\[])|(?P<user><s>\[INST\])|(?P<answer><s>\[ANS\])|(?P<other><s>\[ROLE(?:=(?P<name>(?:\\[\\<\[\]]|[^\]\\])*))?\])|(?P<close>\[/INST\]|</s>|\[/ROLE\])|(?P<stray><s>|\[INST\]|\[ANS\]|\[ROLE)")
_CLOSE = {"user": "[/INST]", "answer": "</s>", "other": "[/ROLE]"}
#: Turns of a conversation that are rendered into one row.
BLOCK_TURNS = 64


class ParseError(ValueError):
    """Rendered text that the grammar does not allow."""


def _open(role: str | None) -> tuple[str, str]:
    if role == "user":
        return "<s>[INST]", "[/INST]"
    if role == "assistant":
        return "<s>[ANS]", "</s>"
    name = "" if role is None else "=" + re.sub(r"([\\<\[\]])", r"\\\1", role)
    return f"<s>[ROLE{name}]", "[/ROLE]"


def parse(rendered: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text in ``rendered``."""
    turns, opened, at = [], None, 0
    for m in _TOKEN.finditer(rendered):
        kind = m.lastgroup if m.lastgroup != "name" else "other"
        if kind == "esc" and opened:
            continue
        if kind in _CLOSE and opened is None and m.start() == at:
            role = {"user": "user", "answer": "assistant"}.get(kind, None if m["name"] is None else re.sub(r"\\(.)", r"\1", m["name"], flags=re.S))
            opened, start = (kind, role), m.end()
        elif kind == "close" and opened and m[0] == _CLOSE[opened[0]]:
            turns.append((opened[1], _ESCAPED.sub(r"\1", rendered[start : m.start()]), start, m.start()))
            opened, at = None, m.end()
        else:
            raise ParseError(f"{m[0]!r} at {m.start()}")
    if opened or at != len(rendered):
        raise ParseError("rendered text ends within a turn")
    return turns


def render(role: str | None, text: str) -> str:
    """A turn that parses back to exactly (role, text)."""
    before, after = _open(role)
    for body in (text, _CONFLICT.sub(lambda m: "\\" + m[0], text)):
        turn = f"{before}{body}{after}"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn
        except ParseError:
            continue
    raise AssertionError(f"no rendering of {text!r} parses back")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, part, rendered, loss_spans): conversations in order of turn, up to BLOCK_TURNS turns a row, parts in order.

    loss_spans are (start, end) of the assistant texts in ``rendered``. Rows are ordered by turn,
    then role, then text, nulls first; null text is empty; a null conv_id is a conversation of its
    own; repeated rows stay. Rows are dealt by ranges of conv_id and turn (no text is a key), so a conversation of any length is
    rendered by as many tasks as its turns ask for, with only a block of turns in memory; a text of any length is one turn.
    An empty table gives no rows; other columns are not read, whatever their names.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    schema = T.StructType.fromDDL("conv_id long, part long, rendered string, loss_spans array<struct<start: int, end: int>>")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        conv, block, part, out = object(), [], 0, []

        def close():
            nonlocal block, part
            if block:
                rendered = "".join(block)
                marks = [{"start": lo, "end": hi} for role, _, lo, hi in parse(rendered) if role == "assistant"]
                out.append((conv, part, rendered, marks))
                block, part = [], part + 1

        def batch_out():
            nonlocal out
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], spans)], ["conv_id", "part", "rendered", "loss_spans"])

        for batch in batches:
            for conv_id, role, text, task in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if conv_id != conv or len(block) >= BLOCK_TURNS:
                    close()
                    part = part if conv_id == conv else task << 32
                    conv = conv_id
                block.append(render(role, text))
            yield batch_out()
        close()
        yield batch_out()

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest runs over a conversation in order, so a conversation's rendered rows meet in one
    task; they stream through it, and only the running digests are kept. Null roles read as empty
    in the digest; an empty table gives no rows; other columns are not read.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        conv, state = object(), None

        def row():
            n, turns, chars, loss, size = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            out = []
            for conv_id, rendered, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv_id != conv:
                    if state:
                        out.append(row())
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role or ''}\n{text}\n".encode())
                for s in spans:
                    text = _ESCAPED.sub(r"\1", rendered[s["start"] : s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(rendered)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The turns plus conversation -1, whose texts are themselves control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.unionByName(conversations.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, CASE WHEN regexp_matches(text, '<s>|</s>|\[/?INST\]|\[ANS\]|\[/?ROLE|\\[\\<\[]|\\$')
    THEN length(regexp_replace(text, '(\\|<s>|</s>|\[/?INST\]|\[ANS\]|\[/?ROLE)', '\\\1', 'g')) ELSE length(text) END
  + CASE WHEN role = 'user' THEN 16 WHEN role = 'assistant' THEN 12 WHEN role IS NULL THEN 16 ELSE 17 + length(regexp_replace(role, '([\\<\[\]])', '\\\1', 'g')) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
