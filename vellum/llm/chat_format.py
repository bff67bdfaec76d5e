r"""Chat formatting with a grammar round trip.

    turn = "### " role ": " text "\n</turn>\n"

A control string, `### name:` or `</turn>`, anywhere in the output is a mark of the template
unless backslashes stand before it; then it is text, with one backslash less.  No text
is escaped at first: a conversation is rendered, parsed again by the grammar and compared with
its source, and the turns that don't come back get a backslash before each of their
control strings, until all come back.  Roles that aren't a word of A-Z, a-z, 0-9 and _ are
written as x_ and the hex digits of their UTF-8.

Rows are dealt by ranges of conversation and turn, so that a conversation of any size is
rendered by many tasks, in order, in pieces of CHUNK code points or one turn.  The files
hold the pieces with the spans of the loss mask.  A conversation that one piece holds, as
nearly all are, is read back where it lies; only those cut by a piece's or a range's end
are brought together.  SHA-256 runs over a text from first to last, so one task streams
through such a conversation, a piece at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common

OPEN, END, LEARNT = "### ", "</turn>", "assistant"
WORD = r"[A-Za-z0-9_]+"
#: Code points of a piece, more where one turn is longer.
CHUNK = 1_000_000
#: What order of equal turns goes by before their whole texts are compared.
PREFIX = 64

_CONTROL = re.compile(rf"(\\*)({OPEN}{WORD}:|{END})")
_HEAD = re.compile(rf"{OPEN}({WORD}): ")
_PLAIN = re.compile(rf"(?!x_){WORD}")


def role_name(role: str) -> str:
    return role if _PLAIN.fullmatch(role) else "x_" + role.encode().hex()


def role_of(name: str) -> str | None:
    """None for a name that role_name() doesn't give."""
    if not name.startswith("x_"):
        return name
    try:
        role = bytes.fromhex(name[2:]).decode()
    except ValueError:
        return None
    return role if role_name(role) == name else None


def frame(role: str, body: str) -> str:
    return f"{OPEN}{role_name(role)}: {body}\n{END}\n"


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(body: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the body) of each turn; None where the grammar is broken."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        role = role_of(head[1]) if head else None
        if role is None:
            return None
        start = head.end()
        mark = next((m for m in _CONTROL.finditer(text, start) if not m[1]), None)
        if mark is None or mark[2] != END:
            return None
        end = mark.start() - 1
        if end < start or text[end] != "\n" or text[mark.end() : mark.end() + 1] != "\n":
            return None
        turns.append((role, unescaped(text[start:end]), start, end))
        at = mark.end() + 1
    return turns


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The text of the turns and the spans of it that the loss mask covers."""

    def comes_back(text: str, source: list[tuple[str, str]]):
        got = parse(text)
        return got if got is not None and [t[:2] for t in got] == source else None

    bodies = [text for _, text in turns]
    while True:
        out = "".join(frame(role, body) for (role, _), body in zip(turns, bodies, strict=True))
        if (got := comes_back(out, turns)) is not None:
            return out, [{"start": a, "end": b} for role, _, a, b in got if role == LEARNT]
        again = [body if comes_back(frame(turn[0], body), [turn]) else escaped(body) for turn, body in zip(turns, bodies, strict=True)]
        if again == bodies:
            raise ValueError("turns that come back one by one don't come back together")
        bodies = again


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ROW = "part int, seq long, conv_id {kind}, text string, n_turns long, loss array<struct<start:int,end:int>>, whole boolean"


def _pieces(chunk: int):
    """Sorted batches of (part, conv_id, role, text) -> pieces.

    whole: the piece is all of its conversation.  That isn't known of the first and the last
    conversation of a partition, which may go on in its neighbours.
    """

    def run(batches):
        part, seq, conv, first = None, 0, None, True
        turns: list[tuple[str, str]] = []
        size = cut = 0
        out: list[tuple] = []

        def end(last_of_all: bool, closing: bool) -> None:
            nonlocal seq, turns, size, cut
            text, loss = rendered(turns)
            out.append((seq, conv, text, len(turns), loss, closing and not cut and not first and not last_of_all))
            seq, turns, size, cut = seq + 1, [], 0, 0 if closing else 1

        def batch(kind):
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[0], pa.int64()), pa.array(rows[1], kind), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], _SPANS), pa.array(rows[5])],
                ["part", "seq", "conv_id", "text", "n_turns", "loss", "whole"],
            )

        kind = None
        for b in batches:
            kind = b.schema.field(1).type
            for p, key, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part is None:
                    part, conv = p, key
                elif key != conv:
                    end(False, True)
                    conv, first = key, False
                elif size >= chunk:
                    end(False, False)
                turns.append((role, text))
                size += len(text)
            if out:
                yield batch(kind)
        if part is not None:
            end(True, True)
            yield batch(kind)

    return run


def formatted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """part, seq (the order of all pieces), conv_id, text, n_turns, loss (spans), whole.

    A conversation's turns go by their number, those of equal number by role and text, null
    numbers last; repeated rows are turns of their own.  Null roles and texts are empty, a null
    conv_id is a conversation.  An empty table gives no rows; other columns play no part.
    """
    spark = conversations.sparkSession
    common.ship(spark)
    base = conversations.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    order = [F.col("c"), F.col("n").asc_nulls_last(), F.col("r")]
    dealt = base.repartitionByRange(common.partitions(base), *order, F.substring("t", 1, PREFIX)).sortWithinPartitions(*order, "t")
    kind = base.schema["c"].dataType.simpleString()
    return dealt.select(F.spark_partition_id().alias("part"), "c", "r", "t").mapInArrow(_pieces(chunk), _ROW.format(kind=kind))


def write_formatted(conversations: DataFrame, path: str, **columns) -> None:
    """The pieces of formatted() as Parquet files."""
    formatted(conversations, **columns).write.mode("overwrite").parquet(path)


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _read(batches):
    """Pieces in order -> digests of the turns and of the text under the mask, by conversation."""
    conv = state = None
    done: list[tuple] = []

    def close() -> None:
        done.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

    def batch(kind):
        rows = list(zip(*done, strict=True))
        done.clear()
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for key, text, n, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or key != conv:
                if state is not None:
                    close()
                conv, state = key, {"n": 0, "chars": 0, "size": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            turns = parse(text)
            if turns is None or len(turns) != n or [(a, z) for r, _, a, z in turns if r == LEARNT] != [(s["start"], s["end"]) for s in loss]:
                raise ValueError(f"the formatted text of conversation {key} doesn't follow the grammar")
            state["n"] += n
            state["size"] += len(text)
            for role, said, _, _ in turns:
                state["turns"].update(f"{role}\n{said}\n".encode())
            for s in loss:
                learnt = unescaped(text[s["start"] : s["end"]])
                state["chars"] += len(learnt)
                state["loss"].update(learnt.encode())
        if done:
            yield batch(kind)
    if state is not None:
        close()
        yield batch(kind)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the
    pieces that read_formatted() gives, by parsing their texts."""
    common.ship(pieces.sparkSession)
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ("conv_id", "text", "n_turns", "loss")
    whole = pieces.filter("whole").select(*columns).mapInArrow(_read, schema)
    cut = pieces.filter("NOT whole").repartition(common.partitions(pieces), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(cut.select(*columns).mapInArrow(_read, schema))


#: A conversation that both speakers fill with control strings.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def oracle_sql(table: str = "conversations") -> str:
    """The digests from the source itself, and the length by the template and the number of control strings."""
    made = f"(({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, 'assistant', '{PROBE}'))"
    name = f"CASE WHEN regexp_full_match(role, '{WORD}') AND NOT starts_with(role, 'x_') THEN role ELSE 'x_' || lower(hex(role)) END"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table} UNION ALL SELECT * FROM (VALUES {made[1:-1]}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
 CAST(sum({len(frame("", "")) - 2} + length({name}) + length(text) + len(regexp_extract_all(text, '{OPEN}{WORD}:|{END}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
