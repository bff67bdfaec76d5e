"""Token ids as compressed binary shards: a static range asymmetric numeral system.

File format (one row of the container per block, so Spark's own committer makes writing
safe against lost executors):

    shard, block       place of the block in the ascending order of document keys
    first_token        ids of the shard that come before the block
    n_tokens, lanes, row_step
    payload            32-bit words, little-endian, in decoding order
    states             lanes x 64-bit decoder states at the block's start
    marks              checkpoints: every `row_step` rows the decoder states and the word
                       position, so that a block can be decoded in parallel from each
    keys, lengths      the documents of the block, and their numbers of ids
    part, at           of a document with blocks of its own: true, and its ids before this block
    crc32              of all these

A block holds whole documents, or a part of one that has more than BLOCK_TOKENS ids; so
blocks are decoded independently of each other.  Beside the blocks are stored the
frequency table that all share, counts over the whole corpus scaled to 2**SCALE_BITS, and
the number of blocks, ids and documents of each shard, against which a reader checks that
nothing is lost.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common, tokens

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
#: Ids at which a block is closed, and of each part of a longer document.
BLOCK_TOKENS = 1 << 18
#: Rows of LANES ids between two checkpoints.
ROW_STEP = 64
END_ID = 1


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tokens.PieceEncoder:
    return tokens.PieceEncoder(path, True)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(float) * room // total), 0).astype(np.int64)
    order, short = np.argsort(-freq, kind="stable"), room - int(freq.sum())
    if short >= 0:
        freq[order[0]] += short
    else:
        for k in order:
            take = min(-short, int(freq[k]) - 1)
            freq[k] -= take
            short += take
            if not short:
                break
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks of ids under one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.most = ((LOW >> self.bits) << np.uint64(32)) * self.freq

    def encode(self, ids: np.ndarray, lanes: int, row_step: int) -> dict:
        rows = -(-len(ids) // lanes)
        x, words, marks = np.full(lanes, LOW), [], []
        written = 0
        for r in range(rows - 1, -1, -1):
            s = ids[r * lanes : (r + 1) * lanes]
            n, f = len(s), self.freq[s]
            v = x[:n]
            over = v >= self.most[s]
            out = v[over].astype(np.uint32)
            words.append(out)
            written += len(out)
            v = np.where(over, v >> np.uint64(32), v)
            q = v // f
            x[:n] = (q << self.bits) + (v - q * f) + self.start[s]
            if r and r % row_step == 0:
                marks.append((r, written, x.copy()))
        words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        mark = b"".join(np.array([r, len(words) - w], "<i8").tobytes() + v.astype("<u8").tobytes() for r, w, v in reversed(marks))
        return {"payload": words.astype("<u4").tobytes(), "states": x.astype("<u8").tobytes(), "marks": mark}

    def decode(self, payload: bytes, states: bytes, n: int, lanes: int, first_row: int = 0, at: int = 0, rows: int | None = None) -> np.ndarray:
        words, x = np.frombuffer(payload, "<u4").astype(np.uint64), np.frombuffer(states, "<u8").astype(np.uint64)
        last = -(-n // lanes) if rows is None else min(-(-n // lanes), first_row + rows)
        out, mask = [], np.uint64((1 << int(self.bits)) - 1)
        for r in range(first_row, last):
            m = min(lanes, n - r * lanes)
            v = x[:m]
            low = v & mask
            s = self.slot[low]
            v = self.freq[s] * (v >> self.bits) + low - self.start[s]
            under = v < LOW
            k = int(under.sum())
            v[under] = (v[under] << np.uint64(32)) | words[at : at + k]
            at += k
            x[:m] = v
            out.append(s)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode_from_marks(self, payload: bytes, states: bytes, marks: bytes, n: int, lanes: int, row_step: int) -> np.ndarray:
        """The block's ids, all its checkpoints decoded side by side."""
        size, parts = 16 + 8 * lanes, [(0, 0, states)]
        for i in range(0, len(marks), size):
            r, at = np.frombuffer(marks[i : i + 16], "<i8")
            parts.append((int(r), int(at), marks[i + 16 : i + size]))
        # the last part may end early and is decoded by itself
        r, at, last = parts.pop()
        tail = self.decode(payload, last, n, lanes, r, at, row_step)
        if not parts:
            return tail
        words, mask = np.frombuffer(payload, "<u4").astype(np.uint64), np.uint64((1 << int(self.bits)) - 1)
        x = np.stack([np.frombuffer(p[2], "<u8") for p in parts]).astype(np.uint64)
        place = np.array([p[1] for p in parts])
        out = np.empty((len(parts), row_step, lanes), np.uint32)
        for k in range(row_step):
            low = x & mask
            s = self.slot[low]
            x = self.freq[s] * (x >> self.bits) + low - self.start[s]
            under = x < LOW
            order = np.cumsum(under, axis=1)
            x[under] = (x[under] << np.uint64(32)) | words[(place[:, None] + order - 1)[under]]
            place += order[:, -1]
            out[:, k] = s
        return np.concatenate([out.ravel(), tail])


def _checksum(row: dict) -> int:
    crc = zlib.crc32(json.dumps([row[c] for c in ("shard", "block", "first_token", "n_tokens", "lanes", "row_step", "part", "at", "lengths")]).encode())
    crc = zlib.crc32(repr(row["keys"]).encode(), crc)
    for c in ("payload", "states", "marks"):
        crc = zlib.crc32(row[c], crc)
    return crc


def _binary(flat: np.ndarray, sizes: np.ndarray, kind: str) -> pa.Array:
    """Slices of one array of ids as binary values."""
    data = flat.astype(kind)
    ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column as one array."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if len(column) and ends[-1] > ends[0] else np.zeros(0, kind)


def _ids(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, n (ids with the end id), ids (little-endian 16 or 32 bit)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = _encoder(path)
        for b in batches:
            texts = b.column(1)
            for i, j in tokens.chunks(texts):
                ids, n = tokens.with_end(*enc.encode(texts.slice(i, j - i)), END_ID)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), _binary(ids, n, "<u2")], ["key", "n", "ids"])
        enc.rest()

    return docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, f"key {kind}, n long, ids binary")


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, shards: int | None = None) -> None:
    """Write the ids of all documents, in ascending order of key (nulls first), to path.

    Null texts count as empty: the end id alone.  Rows with equal keys follow each other,
    ordered by their ids.  An empty table writes an empty dataset.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    common.ship(spark)
    tok = tokenizer or _default_path()
    vocab = tokens.load(tok).get_vocab_size(with_added_tokens=True)
    if vocab > 1 << 16:
        raise ValueError("ids are staged in 16 bits")
    with common.Scratch(spark) as scratch:
        ids = common.stage(_ids(docs, key, text, tok), "ids")
    kind = ids.schema["key"].dataType.simpleString()

    def tally(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0), "<u2"), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    # at most one row for each vocabulary entry reaches the driver
    counts = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    freq = scaled(counts)
    spark.createDataFrame([(SCALE_BITS, freq.astype("<u4").tobytes())], "scale_bits int, freq binary").write.mode("overwrite").parquet(f"{path}/table")

    text_schema = f"shard int, block long, first_token long, n_tokens long, lanes int, row_step int, payload binary, states binary, marks binary, lengths array<long>, keys array<{kind}>, part boolean, at long, crc32 long"

    def write(batches):
        coder, shard = Coder(freq), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        keys: list = []
        place = {"block": 0, "first": 0}
        key_type = None

        def flush(ids: np.ndarray, keys: list, lengths: list[int], part: bool, at: int):
            # rows of few lanes suffice for a short block
            lanes = LANES if len(ids) >= LANES * 16 else max(1, min(LANES, len(ids) // 16))
            row = {"shard": shard, "block": place["block"], "first_token": place["first"], "n_tokens": len(ids), "lanes": lanes, "row_step": ROW_STEP}
            row |= coder.encode(ids, lanes, ROW_STEP) | {"lengths": lengths, "keys": keys, "part": part, "at": at}
            row["crc32"] = _checksum(row)
            place["block"] += 1
            place["first"] += len(ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(key_type), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        def close():
            ids, lengths, names = np.concatenate(held), [len(x) for x in held], keys.copy()
            held.clear()
            keys.clear()
            return flush(ids, names, lengths, False, 0)

        waiting = 0
        for b in batches:
            key_type = b.column(0).type
            for k, buf in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(buf.as_buffer(), "<u2")
                if held and (len(x) > BLOCK_TOKENS or waiting >= BLOCK_TOKENS):
                    yield close()
                    waiting = 0
                if len(x) > BLOCK_TOKENS:
                    for i in range(0, len(x), BLOCK_TOKENS):
                        yield flush(x[i : i + BLOCK_TOKENS], [k], [len(x)], True, i)
                else:
                    held.append(x.copy())  # the batch may go
                    keys.append(k)
                    waiting += len(x)
        if held:
            yield close()

    n = shards or common.partitions(ids)
    ordered = ids.select("key", "ids").repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
    ordered.mapInArrow(write, text_schema).write.mode("overwrite").parquet(f"{path}/blocks")
    _totals(spark.read.parquet(f"{path}/blocks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
    scratch.release()


def _totals(blocks: DataFrame) -> DataFrame:
    """One row for each shard: its blocks, ids and documents, and whether they follow each other."""
    docs = F.when(F.col("part"), F.when(F.col("at") == 0, F.lit(1)).otherwise(0)).otherwise(F.size("lengths"))
    return blocks.groupBy("shard").agg(F.count("*").alias("blocks"), F.max("block").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.sum(docs).cast("long").alias("docs"))


def read_tokens(spark, path: str) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian 32 bit).

    Blocks are dealt out one by one, checked against their checksums and decoded from their
    checkpoints, whatever shard they are of.  Lost, doubled or damaged blocks raise an error.  Only
    documents with blocks of their own are gathered again, one row each.
    """
    common.ship(spark)
    bits, freq = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(freq, "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # one row for each shard
    there = {r["shard"]: r for r in _totals(blocks).collect()}
    written = {r["shard"]: r for r in spark.read.parquet(f"{path}/shards").collect()}
    before, total = [], 0
    for shard, r in sorted(written.items()):
        if there.get(shard) != r or r["last"] + 1 != r["blocks"] or r["end"] != r["n"]:
            raise ValueError(f"shard {shard} of {path} isn't complete")
        before.append((shard, total))
        total += r["n"]
    if len(there) != len(written):
        raise ValueError(f"{path} holds shards that weren't written with it")

    def run(batches):
        coder = Coder(freq, bits)
        for b in batches:
            for row in b.to_pylist():
                if _checksum(row) != row["crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: checksum differs")
                ids = coder.decode_from_marks(row["payload"], row["states"], row["marks"], row["n_tokens"], row["lanes"], row["row_step"]).astype("<u4")
                sizes = np.array([len(ids)] if row["part"] else row["lengths"], np.int64)
                starts = np.cumsum(sizes) - sizes
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                keys = pa.array(row["keys"], b.schema.field("keys").type.value_type)
                cols = [keys, pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(starts + row["first_token"] - row["at"]), pa.array([row["at"]] * len(sizes), pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64()), _binary(ids, sizes, "<u4")]
                yield pa.RecordBatch.from_arrays(cols, ["key", "shard", "first", "at", "n_tokens", "ids_crc32", "ids"])

    def decoded(some: DataFrame) -> DataFrame:
        # a block to a row: dealt out evenly, and a task holds one at a time
        dealt = some.repartition(common.partitions(blocks), "shard", "block")
        return dealt.mapInArrow(run, f"key {kind}, shard int, first long, at long, n_tokens long, ids_crc32 long, ids binary")

    whole = decoded(blocks.filter("NOT part")).select("key", "shard", "first", "n_tokens", "ids_crc32", "ids")
    parts = decoded(blocks.filter("part")).groupBy("shard", "first").agg(F.first("key").alias("key"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    long = parts.withColumn("ids", ids).select("key", "shard", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    offsets = F.broadcast(spark.createDataFrame(before, "shard int, base long"))  # one row for each shard
    return whole.unionByName(long).join(offsets, "shard").select("key", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")
