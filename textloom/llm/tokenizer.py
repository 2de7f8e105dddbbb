"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern; each distinct word is encoded once per worker, by batched merge
rounds: the symbols of many words stand in one array, the rank of every adjacent pair is found by binary search over the
sorted pair keys, and each round merges the lowest-rank, leftmost pair of every word at once. Ids then are gathered by
word number, so no id passes through a Python object.

Defined cases: null and empty text have the empty list of ids; special tokens' strings are ordinary text; lone
surrogates are encoded as the replacement character; texts of any length are whole (a word of more than `WIDEST`
bytes is merged alone, with a heap); repeated rows are each encoded; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the public tokenizer
NONE = np.int32(2**31 - 1)
WIDEST = 64
KEPT_WORDS = 1 << 20  # distinct words kept between batches; beyond that the cache starts anew


class BytePairEncoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.merged = np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int32)[order]
        self.find = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, NONE if it doesn't."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64) & 0xFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)

    def _rounds(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most `width` bytes."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((len(words), width + 1), -1, dtype=np.int32)
        symbols[:, :width][inside] = self.base[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = self._rank(symbols[:, :-1], symbols[:, 1:])
        done: list[np.ndarray | None] = [None] * len(words)
        left = np.arange(len(words))
        columns = np.arange(width + 1)
        while len(left):
            at = rank.argmin(axis=1)
            row = np.arange(len(left))
            best = rank[row, at]
            if (best == NONE).any():
                for i in np.flatnonzero(best == NONE):
                    done[left[i]] = symbols[i][symbols[i] >= 0]
                go = best != NONE
                left, symbols, rank, at, best = left[go], symbols[go], rank[go], at[go], best[go]
                row = np.arange(len(left))
                if not len(left):
                    break
            symbols[row, at] = best
            moved = np.empty_like(symbols)
            moved[:, :-1], moved[:, -1] = symbols[:, 1:], -1
            symbols = np.where(columns <= at[:, None], symbols, moved)
            shifted = np.empty_like(rank)
            shifted[:, :-1], shifted[:, -1] = rank[:, 1:], NONE
            rank = np.where(columns[:-1] < at[:, None], rank, shifted)
            rank[row, at] = self._rank(symbols[row, at], symbols[row, at + 1])
            inner = at > 0
            rank[row[inner], at[inner] - 1] = self._rank(symbols[row[inner], at[inner] - 1], symbols[row[inner], at[inner]])
        return done

    def _alone(self, word: bytes) -> np.ndarray:
        """Ids of one long word, in time n log n."""
        symbols = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := int(self._rank(np.array([symbols[i]]), np.array([symbols[j]]))[0])) != NONE:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in symbols if s >= 0], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)
        sizes = [len(w) for w in words]
        low = 0
        for width in (4, 8, 12, 16, 24, 32, WIDEST):
            group = [i for i, n in enumerate(sizes) if low < n <= width]
            for k in range(0, len(group), 1 << 15):
                part = group[k : k + (1 << 15)]
                for i, ids in zip(part, self._rounds([words[i] for i in part], width)):
                    out[i] = ids
            low = width
        for i, n in enumerate(sizes):
            if n > WIDEST:
                out[i] = self._alone(words[i])
        return out

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        ids = self.encode_words([w.encode("utf-8", "replace") for w in new])
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        self.ids = np.concatenate([self.ids, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))])

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, words in each text)"""
        if len(self.number) > KEPT_WORDS:
            self._reset()
        cut = [self.find(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.number)
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        get = self.number.__getitem__
        parts = [np.fromiter(map(get, words), dtype=np.int64, count=len(words)) for words in cut]
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        words, per_text = self._numbered(texts)
        sizes = np.concatenate([[0], np.cumsum((self.starts[1:] - self.starts[:-1])[words])])
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return sizes[edges[1:]] - sizes[edges[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, offsets of each text's ids)"""
        words, per_text = self._numbered(texts)
        start, size = self.starts[words], (self.starts[1:] - self.starts[:-1])[words]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(start - (ends - size), size) + np.arange(total)
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return self.ids[place], np.concatenate([[0], ends])[edges]


_LOADED: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder, read once. Where the path is not there, the installed vocabulary of the same name is taken."""
    if path not in _LOADED:
        found = path
        if not os.path.exists(path):
            import public_tokenizers

            found = public_tokenizers.path(os.path.basename(path))
        _LOADED[path] = BytePairEncoder(found)
    return _LOADED[path]


def _slices(batch: pa.RecordBatch, characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes of text, but of one row at least."""
    sizes = np.array(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    block = np.cumsum(sizes) // characters
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids): one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                ids, offsets = enc.encode(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, tokens): as `token_ids`, without the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in _slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.counts(batch.column(1).to_pylist()), type=pa.int64())], names=["key", "tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"key {kind}, tokens bigint").withColumnRenamed("key", key)
