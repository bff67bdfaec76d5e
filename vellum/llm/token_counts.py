"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as exactly one
token are proven.  A pre-token equal to a proven string counts one without any merge;
only the remaining pre-tokens go through the library's merges.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common, tokens

END_OF_WORD = "</w>"


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet, by its public rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tok) -> frozenset[str]:
    """Strings that the library encodes, alone, as exactly one token."""
    back, names = _byte_alphabet(), []
    for name in tok.get_vocab(with_added_tokens=False):
        body = name.removesuffix(END_OF_WORD)
        try:
            names.append(bytes(back[c] for c in body).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    return frozenset(s for s, e in zip(names, tok.encode_batch(names, add_special_tokens=False), strict=True) if s and len(e.ids) == 1)


class Counter(tokens.PieceEncoder):
    """Counts tokens: proven pre-tokens directly, only the rest by the library's merges."""

    def __init__(self, path: str, limit: int = tokens.CACHE_PIECES):
        super().__init__(path, True, limit)
        self.whole = prove_whole_tokens(self.tok)

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        proven = np.fromiter((p in self.whole for p in parts), bool, len(parts))
        n = np.ones(len(parts), np.int64)
        if rest := [p for p in parts if p not in self.whole]:
            n[~proven] = super()._joined(rest)[1]
        return np.zeros(0, np.uint32), n

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.int64)
        k, pieces, counts = self.cut(texts)
        each = np.zeros(len(pieces), np.int64)
        for mask, store, idx, parts in self._classes(pieces):
            total = np.concatenate([[0], np.cumsum(store.length[idx])])
            each[mask] = np.diff(total[np.cumsum(parts)], prepend=0)
        total = np.concatenate([[0], np.cumsum(each[k])])
        return np.diff(total[np.cumsum(counts)], prepend=0)


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Null texts count as empty (0 bytes, 0 tokens); rows, repeats and other columns stay as
    they are; input columns named like an output column are replaced by it.
    No shuffle: one pass over the scan.
    """
    common.ship(docs.sparkSession)
    path, added = tokenizer or _default_path(), ("n_bytes", "n_tokens", "over_limit")
    base = docs.drop(*[c for c in added if c != text])
    carried = [c for c in base.columns if c != text]
    source = base.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches):
        counter = _counter(path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = np.concatenate([counter.count(texts.slice(i, j - i)) for i, j in tokens.chunks(texts)] or [np.zeros(0, np.int64)])
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, pa.array(n), pa.array(n > limit)], [*carried, *added])
        counter.rest()

    schema = base.select(*[F.col(f"`{c}`") for c in carried], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    return source.mapInArrow(run, schema)
