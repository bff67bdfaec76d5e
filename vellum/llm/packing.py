"""Bounded-space online packing of documents into fixed windows.

Each partition keeps a fixed number of open windows.  A document's full windows leave at
once; its remainder goes to the open window that it fills best; when none has room the
fullest window is emitted and a new one opened.  What is still open at the end, a bounded
number of windows for each partition, is written down and merged by best fit, in rounds
over a falling number of groups, until one group is left.
"""

from __future__ import annotations

import bisect
import functools
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common, tokens

WINDOW = 2048
#: Open windows of each partition.
OPEN_WINDOWS = 128
#: Groups of leftovers that one merge takes together.
MERGE_FAN_IN = 16
END_ID = 1

PIECE = "__row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tokens.PieceEncoder:
    return tokens.PieceEncoder(path, False)


class OpenWindows:
    """At most `most` open windows, sorted by free room; place() is best fit."""

    def __init__(self, window: int, most: int, emit):
        self.window, self.most, self.emit = window, most, emit
        self.room: list[tuple[int, int]] = []  # (free, window number), ascending
        self.content: dict[int, list] = {}
        self.made = 0

    def place(self, item, length: int) -> None:
        k = bisect.bisect_left(self.room, (length, -1))
        if k < len(self.room):
            free, w = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                _, full = self.room.pop(0)
                self.emit(full, self.content.pop(full))
            free, w = self.window, self.made
            self.made += 1
            self.content[w] = []
        self.content[w].append((item, length))
        if free == length:
            self.emit(w, self.content.pop(w))
        else:
            bisect.insort(self.room, (free - length, w))

    def close(self):
        """The windows still open, as (number, content)."""
        left = [(w, self.content.pop(w)) for _, w in self.room]
        self.room = []
        return left


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


#: A sequence id is the merge round, the task or group, and a running number.
def _sequence(round_no: int, task: int, k: int) -> int:
    return round_no << 56 | task << 28 | k


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the library without special tokens, then END_ID; a null or
    empty text is END_ID alone.  Null and repeated keys are kept, each row as a document
    of its own.  Memory is bounded by the open windows, whose content is only row numbers
    and lengths.  An empty table gives no rows.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    common.ship(spark)
    path = tokenizer or _default_path()
    kind = docs.schema[key].dataType.simpleString()
    cols = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = [*cols, "left"]
    out = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left boolean"
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def arrow(batch_key_type) -> pa.Schema:
        return pa.schema([("key", batch_key_type), *[(n, pa.int64()) for n in cols[1:]], ("left", pa.bool_())])

    def first(batches):
        enc, task = _encoder(path), TaskContext.get().partitionId()
        rows: list[tuple] = []

        def emit(w, content, left=False):
            at = 0
            for (k, s, crc, total), n in content:
                rows.append((k, s, n, crc, total, _sequence(0, task, w), at, left))
                at += n

        bins, schema = OpenWindows(window, open_windows, emit), None
        for b in batches:
            schema = schema or arrow(b.column(0).type)
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in tokens.chunks(texts):
                ids, sizes = tokens.with_end(*enc.encode(texts.slice(i, j - i)), END_ID)
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                for k, n in zip(keys[i:j], sizes.tolist(), strict=True):
                    for s in range(0, n, window):
                        size = min(window, n - s)
                        bins.place((k, s, zlib.crc32(data[4 * (at + s) : 4 * (at + s + size)]), n), size)
                    at += n
                if rows:
                    yield _rows(schema, rows)
                    rows.clear()
        for w, content in bins.close():
            emit(w, content, True)
        enc.rest()
        if rows:
            yield _rows(schema, rows)

    def again(round_no: int, last: bool):
        def merge(batches):
            rows: list[tuple] = []

            def solve(group: int, got: list[tuple]):
                def emit(w, content, left=False):
                    at = 0
                    for (k, s, crc, total), n in content:
                        rows.append((k, s, n, crc, total, _sequence(round_no, group, w), at, left))
                        at += n

                got.sort(key=lambda x: (-x[2], x[3], x[1]))
                bins = OpenWindows(window, max(open_windows, 1) if not last else 1 << 30, emit)
                for k, s, n, crc, total in got:
                    bins.place((k, s, crc, total), n)
                for w, content in bins.close():
                    emit(w, content, not last)

            now, got, schema = None, [], None
            for b in batches:  # sorted by group; one group's leftovers are held, at most MERGE_FAN_IN times the open windows
                schema = schema or arrow(b.column(0).type)
                for *row, group in zip(*[b.column(i).to_pylist() for i in range(5)], b.column(b.num_columns - 1).to_pylist(), strict=True):
                    if group != now and got:
                        solve(now, got)
                        got = []
                        yield _rows(schema, rows)
                        rows.clear()
                    now = group
                    got.append(tuple(row))
            if got:
                solve(now, got)
                yield _rows(schema, rows)

        return merge

    done = []
    now = common.stage(source.mapInArrow(first, out), "pack")
    groups, round_no = 0, 0
    shift = F.shiftright("sequence_id", 28).bitwiseAND((1 << 28) - 1)
    while True:
        round_no += 1
        left = now.filter("left")
        if round_no == 1:
            groups = (left.agg(F.max(shift)).first()[0] or 0) + 1
        groups = max(1, -(-groups // MERGE_FAN_IN))
        done.append(now.filter("NOT left"))
        last = groups == 1
        group = F.floor(shift / MERGE_FAN_IN).cast("int")
        # a task solves its groups one after the other; the number of groups falls each round
        merged = left.select(*names, group.alias("__g")).repartition(groups, "__g").sortWithinPartitions("__g")
        now = common.stage(merged.mapInArrow(again(round_no, last), out), "pack") if not last else merged.mapInArrow(again(round_no, last), out)
        if last:
            done.append(now)
            break
    result = functools.reduce(DataFrame.unionByName, done)
    return result.select(F.col("key").alias(key), *cols[1:])
