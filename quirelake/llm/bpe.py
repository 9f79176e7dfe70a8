"""Encoding a corpus with a published byte-level BPE vocabulary.

Method: pair occurrence index. All words of a batch that are not in the task's
word cache are laid out in one array of symbols. An index maps each mergeable
pair to the positions where it stands, and the ranks that occur anywhere are
kept in a heap. They are applied in ascending order: a merge rewrites its
positions, unlinks the swallowed symbols and enters the pairs that arise into
the index. A merge's symbol can only take part in merges of a higher rank, so
one ascending sweep gives every word the result it has when encoded alone.

The vocabulary is a file of bounded size (50,257 entries); it is read on the
driver and broadcast. Documents are read in place: there is no shuffle.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept by a task from batch to batch; beyond it the cache starts anew.
CACHED_WORDS = 400_000

# The published pattern that splits text before the merges.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in that the vocabulary file has for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    ascending order, take the code points from 256 on.
    """
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


def load_vocabulary(path: str = VOCABULARY) -> dict:
    """Byte ids and merges of a tokenizer file: {'bytes': [256 ids], 'merges': [(left, right, id)]} by rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    symbols = byte_symbols()
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[left], ids[right], ids[left + right]))
    return {"bytes": [ids[symbols[b]] for b in range(256)], "merges": merges}


class PairIndexEncoder:
    """Encodes words with one vocabulary; keeps what it has encoded."""

    def __init__(self, vocabulary: dict, cached_words: int = CACHED_WORDS):
        self.byte_ids = vocabulary["bytes"]
        self.rank_of = {(a, b): rank for rank, (a, b, _) in enumerate(vocabulary["merges"])}
        self.merges = vocabulary["merges"]
        self.cached_words = cached_words
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.pieces: list[list[int]] = []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each of the words, all words at once."""
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            first = len(symbol)
            starts.append(first)
            symbol.extend(self.byte_ids[b] for b in raw)
            before.append(-1)
            before.extend(range(first, first + len(raw) - 1))
            after.extend(range(first + 1, first + len(raw)))
            after.append(-1)
        rank_of, merges = self.rank_of, self.merges
        where: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0:
                rank = rank_of.get((symbol[i], symbol[j]))
                if rank is not None:
                    where.setdefault(rank, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, made = merges[rank]
            for i in sorted(where.pop(rank)):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i] = made
                symbol[j] = -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    self._enter(rank_of.get((made, symbol[k])), i, where, active)
                h = before[i]
                if h >= 0:
                    self._enter(rank_of.get((symbol[h], made)), h, where, active)
        encoded = []
        for start in starts:
            ids = []
            i = start
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            encoded.append(ids)
        return encoded

    @staticmethod
    def _enter(rank: int | None, at: int, where: dict[int, list[int]], active: list[int]) -> None:
        if rank is None:
            return
        places = where.get(rank)
        if places is None:
            where[rank] = [at]
            heapq.heappush(active, rank)
        else:
            places.append(at)

    def _learn(self, split: list[list[str]]) -> None:
        new = list({word for words in split for word in words if word not in self.slot})
        if len(self.slot) + len(new) > self.cached_words:
            self._reset()
            new = list({word for words in split for word in words})
        for word, ids in zip(new, self.encode_words(new), strict=True):
            self.slot[word] = len(self.pieces)
            self.pieces.append(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the n + 1 offsets of the texts in it."""
        split = [SPLIT.findall(text) if text else [] for text in texts]
        self._learn(split)
        slot, pieces = self.slot, self.pieces
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int64)
        for n, words in enumerate(split, 1):
            for word in words:
                flat += pieces[slot[word]]
            offsets[n] = len(flat)
        return np.asarray(flat, np.int32), offsets


@lru_cache(maxsize=2)
def _encoder(shared) -> PairIndexEncoder:
    """One encoder for each Python worker, so that later tasks find its words."""
    return PairIndexEncoder(shared.value)


#: Characters encoded at once; bounds the working memory of a task.
CHARS_AT_ONCE = 4_000_000


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    texts: list[str | None] = []
    size = 0
    for text in column.to_pylist():
        texts.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_corpus(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """The columns `keep` of `docs` with the ids of `text` in `out`, one row for each row.

    No special tokens are added, and strings that look like them are ordinary
    text. Null and empty texts give an empty list (count 0 with `counts_only`,
    where `out` holds the number of ids as bigint instead). Blank and very long
    texts are encoded whole. An empty table gives an empty table; repeated rows
    are repeated; other columns of `docs` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    taken = docs.select(*keep, docs[text].cast("string").alias("__text"))
    kind = "bigint" if counts_only else "array<int>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields), f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(len(keep))):
                flat, offsets = encoder.encode(texts)
                if counts_only:
                    ids = pa.array(np.diff(offsets))
                else:
                    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                columns = [batch.column(i).slice(done, len(texts)) for i in range(len(keep))]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*columns, ids], names=[*keep, out])

    return taken.mapInArrow(run, schema)
