"""Exact tokenizer front ends that encode each distinct piece of text once per worker.

Both public vocabularies pre-split at white space, so a text's ids are the ids of its
pieces in order.  Arrow cuts a batch of texts at white space and numbers its distinct
pieces; only these are looked up.  New pieces go through the library; their ids stay in a
bounded cache.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache of pre-tokens, and of its cache of odd pieces; emptied when full.
CACHE_PIECES = 400_000
#: Characters of its entries, so that very long ones don't pile up.
CACHE_CHARS = 16_000_000
#: Entries that a worker may keep between tasks.
KEPT_PIECES = 50_000
#: Bytes of the texts that are cut together.
CHUNK_BYTES = 8_000_000
#: Pre-tokens that the library encodes in one string.
JOINED = 1000

#: White space that the byte-level vocabulary's splitter may join with its neighbours.
_LOOSE = "<\\||  | \n|\n |\n\n\n|\n\n\\z|[\\t\\r\\v\\f\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Printable Latin, all in composed form, whose lower case is one character: no doubt how the library cuts it.
_PLAIN = "^[ \n]?[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*\\z"
_LETTERS = r"^ ?\p{L}+\z"
#: The pre-token patterns of the two vocabularies (fixed by the tokenizer files), for plain
#: pieces, which hold white space at their start only.
WORD_PATTERN = r"('s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+)"
BYTE_PATTERN = r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+)"
_MARK = "\x01"


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already share the cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the white-space pieces, the distinct pieces, and the pieces of each text."""
    cut = pc.ascii_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, cut.value_lengths().to_numpy()


def cut_bytes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The same for the byte-level vocabulary, whose pieces keep one space before a word; a
    line feed begins a piece of its own."""
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = cut.flatten().dictionary_encode()
    k, names, counts = coded.indices.to_numpy().copy(), coded.dictionary, cut.value_lengths().to_numpy()
    first = np.cumsum(counts) - counts
    bare, place = np.unique(k[first], return_inverse=True)
    k[first] = len(names) + place
    spaced = pc.if_else(pc.starts_with(names, "\n"), names, pc.binary_join_element_wise(" ", names, ""))
    return k, pa.concat_arrays([spaced, names.take(pa.array(bare))]), counts


def pretokens(pieces: pa.Array, words: bool) -> pa.Array:
    """Lists of the pre-tokens of plain pieces; empty strings among them count for nothing."""
    marked = pc.replace_substring_regex(pc.utf8_lower(pieces) if words else pieces, WORD_PATTERN if words else BYTE_PATTERN, "\\1" + _MARK)
    return pc.split_pattern(marked, _MARK)


class _Store:
    """Ids of numbered strings, in one flat array that grows by doubling."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, names: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        n, m = len(self.index), len(names)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(length) - length
        self.length[n : n + m] = length
        self.used += len(ids)
        self.index.update(zip(names, range(n, n + m), strict=True))
        self.chars += sum(map(len, names))


def gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray, idx: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the strings idx in order, and the ids of each run of `counts` strings."""
    n = length[idx]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    out = ids[np.repeat(start[idx] - (ends - n), n) + np.arange(total)]
    return out, np.diff(np.concatenate([[0], ends])[np.cumsum(counts)], prepend=0)


class PieceEncoder:
    """encode(texts) -> the ids of all texts in one array, as the library gives them, and
    the number of each text's ids.

    words: the vocabulary with word ends, which drops white space; else the byte-level one.
    Distinct pieces of a chunk are cut into pre-tokens, or go to the library whole where only
    it knows how.  Both are remembered.
    """

    def __init__(self, path: str, words: bool, limit: int = CACHE_PIECES, limit_chars: int = CACHE_CHARS):
        self.tok, self.by_word = load(path), words
        self.cut = cut_words if words else cut_bytes
        self.limit, self.limit_chars = limit, limit_chars
        vocab = self.tok.get_vocab(with_added_tokens=True)
        # ids at which a joined pre-token ends (word ends) or begins (a space, written so)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for s, i in vocab.items() if (s.endswith("</w>") if words else s.startswith("\u0120"))]] = True
        self.parts, self.odd = _Store(), _Store()

    def _library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(length.sum())), length

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pre-tokens in one string; the vocabulary marks where each ends or begins."""
        ids, _ = self._library([(" " if self.by_word else "").join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)])
        at = np.flatnonzero(self.edge[ids])
        length = np.diff(at, prepend=-1) if self.by_word else np.diff(at, append=len(ids))
        return (ids, length) if len(length) == len(parts) else self._library(parts)

    def _found(self, store: _Store, names: list[str], joined: bool) -> np.ndarray:
        known = store.index
        new = [x for x in names if x not in known]
        if joined:  # a joined pre-token stands alone: after a space, without one inside
            apart = [] if self.by_word else [x for x in new if x[:1] != " " or len(x) < 2]
            together = new if self.by_word else [x for x in new if x[:1] == " " and len(x) > 1]
        else:
            apart, together = new, []
        for some, how in ((together, self._joined), (apart, self._library)):
            if some := [x for x in some if x]:
                store.add(some, *how(some))
        if "" not in known and "" in names:
            store.add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        return np.array(list(map(known.__getitem__, names)), np.int64)

    def _store(self, name: str) -> _Store:
        store = getattr(self, name)
        if len(store.index) > self.limit or store.chars > self.limit_chars:
            store = _Store()
            setattr(self, name, store)
        return store

    def _classes(self, pieces: pa.Array):
        """Distinct pieces by kind: where they are, their store, and their pre-tokens' numbers in it."""
        plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.invert(pc.match_substring(pieces, "<|")))
        letters = pc.and_(plain, pc.match_substring_regex(pieces, _LETTERS))
        for mask, kind in ((letters, "letters"), (pc.and_not(plain, letters), "mixed"), (pc.invert(plain), "odd")):
            some = pieces.filter(mask)
            if not len(some):
                continue
            counts = np.ones(len(some), np.int64)
            if kind == "letters" and self.by_word:
                some = pc.utf8_lower(some)
            elif kind == "mixed":
                cut = pretokens(some, self.by_word)
                some, counts = cut.flatten(), cut.value_lengths().to_numpy()
            coded = some.dictionary_encode()
            store = self._store("odd" if kind == "odd" else "parts")
            numbers = self._found(store, coded.dictionary.to_pylist(), kind != "odd")
            yield mask.to_numpy(zero_copy_only=False), store, numbers[coded.indices.to_numpy()], counts

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one array, and the place and number of each one's."""
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        out, at = [np.zeros(0, np.uint32)], 0
        for mask, store, idx, counts in self._classes(pieces):
            ids, n = gather(store.ids, store.start, store.length, idx, counts)
            start[mask], length[mask] = at + np.cumsum(n) - n, n
            out.append(ids)
            at += len(ids)
        return np.concatenate(out), start, length

    def rest(self) -> None:
        """At a task's end: a worker that waits keeps no large cache."""
        self.parts, self.odd = (s if len(s.index) <= KEPT_PIECES else _Store() for s in (self.parts, self.odd))

    def _known(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        k, pieces, counts = self.cut(texts)
        return gather(*self.distinct(pieces), k, counts)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.by_word:
            return self._known(texts)
        loose = pc.match_substring_regex(texts, _LOOSE)
        if not pc.any(loose).as_py():
            return self._known(texts)
        # texts with loose white space go to the library whole
        whole = loose.to_numpy(zero_copy_only=False)
        sizes, at = np.zeros(len(texts), np.int64), []
        for mask, how in ((~whole, self._known), (whole, lambda t: self._library(t.to_pylist()))):
            ids, n = how(texts.filter(pa.array(mask))) if mask.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            sizes[mask] = n
            at.append(ids)
        out = np.zeros(int(sizes.sum()), np.uint32)
        of_whole = np.repeat(whole, sizes)
        out[~of_whole], out[of_whole] = at
        return out, sizes


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    sizes = sizes + 1
    out, own = np.full(len(ids) + len(sizes), end, np.uint32), np.ones(len(ids) + len(sizes), bool)
    own[np.cumsum(sizes) - 1] = False
    out[own] = ids
    return out, sizes


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """Slices (i, j) of a batch holding about so many bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j
