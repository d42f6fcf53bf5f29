"""Encoding of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is read once on the driver (its place is a parameter) and its ranks are broadcast; their
size is that of the file, below 1 MB. A text is split by the vocabulary's pattern; each piece is merged with a
priority queue of merge ranks over a doubly linked list of symbols, where entries that a merge has made stale
are skipped as they come up. A piece of n bytes takes O(n log n), so a text without any blank is no hazard.
"""

from __future__ import annotations

import base64
import os
import sys
import types
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("FRAMEWRIGHT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PIECES = 1 << 17  #: distinct pieces a worker remembers
CACHED_LENGTH = 64  #: characters of the longest piece it remembers
BATCH_CHARS = 1 << 22  #: characters encoded before a batch of ids is handed on


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, a line of base64 token and rank each."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by merging, always the pair of the lowest rank and of equal ranks the leftmost."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after = list(range(1, n + 1))  # symbol i covers piece[i:after[i]]; 0 marks a symbol that was merged away
    before = list(range(-1, n - 1))
    queue = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, left, right, end = heappop(queue)
        if after[left] != right or after[right] != end:
            continue  # stale: one of the two has been merged since
        after[left], after[right] = end, 0
        if end < n:
            before[end] = left
            if (rank := ranks.get(piece[left : after[end]])) is not None:
                heappush(queue, (rank, left, end, after[end]))
        if (prior := before[left]) >= 0 and (rank := ranks.get(piece[prior:end])) is not None:
            heappush(queue, (rank, prior, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes and decodes texts; remembers the ids of frequent short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.tokens: list[bytes] | None = None

    def piece(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
            if len(piece) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for null and for the empty text."""
        return list(chain.from_iterable(map(self.piece, self.split(text)))) if text else []

    def decode(self, ids) -> str:
        if self.tokens is None:
            self.tokens = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                self.tokens[rank] = token
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


def worker_encoder(data: bytes) -> Encoder:
    """The encoder of this Python process for a vocabulary; it outlives the tasks that use it."""
    store = sys.modules.setdefault("_framewright_worker", types.ModuleType("_framewright_worker"))
    kept = getattr(store, "encoder", None)
    if kept is None or kept[0] != data:
        store.encoder = kept = (data, Encoder(parse_ranks(data)))
    return kept[1]


def _portions(texts: list) -> list[tuple[int, int]]:
    """Index ranges of at most BATCH_CHARS characters or one text."""
    cuts, start, size = [], 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > BATCH_CHARS:
            cuts.append((start, i))
            start, size = i, 0
        size += n
    return [*cuts, (start, len(texts))] if texts else []


def encode_documents(documents: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, without special tokens.

    Strings that look like special tokens are ordinary text. A null or empty text has an empty list; every row
    of the input, repeated or with a null id, gives one row; other columns are ignored.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def encode(batches):
        encoder = worker_encoder(ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _portions(texts):
                lists = [encoder.encode(x) for x in texts[a:b]]
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens): as ``encode_documents``, only the number of tokens."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def count(batches):
        encoder = worker_encoder(ranks.value)
        for batch in batches:
            counts = [sum(map(len, map(encoder.piece, encoder.split(x)))) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def round_trips(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, same): whether decoding the ids, by concatenating the vocabulary's strings, gives the text again."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def check(batches):
        encoder = worker_encoder(ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = map(encoder.encode, texts)
            found = [(len(i), encoder.decode(i) == (x or "")) for x, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([ok for _, ok in found], pa.bool_())], names=["doc_id", "n_tokens", "same"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(check, "doc_id long, n_tokens long, same boolean")
