"""Byte-level BPE by a tree of halves.

Token sequences form a monoid: the encoding of ``a + b`` follows from the encodings of ``a`` and
``b``. A piece (one match of the splitting pattern) is cut in halves down to short leaves, which
are merged by rank. Two neighbours are joined by encoding a window of bytes around their boundary
anew; the window grows until the tokens outside it are stable. That is provable: a token sequence
is the encoding of its bytes if and only if each pair of neighbours encodes to itself. So it is
enough that the pair at either edge of the window does. To the right the window takes in one token at a
time, and only what that token changes is encoded again, so a long run in which every boundary moves
costs a small window for each token. Decoding concatenates up the same tree.

A null text is taken as empty; an empty text has no tokens. Lone surrogates cannot be in a Spark
string. An unknown id makes decoding fail.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leaves of the tree, in bytes.
LEAF = 16
#: Pieces a worker remembers, and a quarter as many runs of bytes and of pairs; others are worked out
#: each time.
REMEMBERED = 200_000
#: Longer pieces, and runs of bytes, are not remembered.
LONGEST_REMEMBERED = 64
LONGEST_RUN = 256
#: From so many bytes on the lowest rank is found by a heap.
HEAP_BYTES = 48
#: Rows turned into Python objects at a time.
ROWS_AT_ONCE = 128
#: Ids joined at a leaf of the decoding tree.
DECODE_LEAF = 4096

Token = bytes
_SINGLE = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class TreeCodec:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.none = len(ranks) + 1 + max(ranks.values(), default=0)
        # Ranks of all pairs of bytes.
        self.first = [ranks.get(bytes((a, b)), self.none) for a in range(256) for b in range(256)]
        self.runs: dict[bytes, list[Token]] = {}
        self.pairs: dict[tuple[Token, Token], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[Token]:
        """Tokens of a short run of bytes: the pair of lowest rank merges first, left before right."""
        known = self.runs.get(data)
        if known is not None:
            return known
        parts = self._merge_long(data) if len(data) >= HEAP_BYTES else self._merge_short(data)
        if len(self.runs) < REMEMBERED // 4 and len(data) <= LONGEST_RUN:
            self.runs[data] = parts
        return parts

    def _merge_short(self, data: bytes) -> list[Token]:
        single, first, none = _SINGLE, self.first, self.none
        parts = [single[b] for b in data]
        costs = [first[a << 8 | b] for a, b in pairwise(data)]
        rank = self.ranks.get
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            merged = parts[i] + parts.pop(i + 1)
            parts[i] = merged
            del costs[i]
            if i < len(costs):
                costs[i] = rank(merged + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + merged, none)
        return parts

    def _merge_long(self, data: bytes) -> list[Token]:
        """The same by a heap of pairs; a pair that has changed since is passed over."""
        count = len(data)
        parts: list[Token | None] = [data[i : i + 1] for i in range(count)]
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        rank = self.ranks.get
        waiting = [
            (cost, i, 2) for i in range(count - 1) if (cost := rank(data[i : i + 2])) is not None
        ]
        heapq.heapify(waiting)
        while waiting:
            _, i, size = heapq.heappop(waiting)
            left, j = parts[i], after[i]
            if left is None or j >= count or len(left) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = left + parts[j], None
            after[i] = nxt = after[j]
            if nxt < count:
                before[nxt] = i
                cost = rank(parts[i] + parts[nxt])
                if cost is not None:
                    heapq.heappush(waiting, (cost, i, size + len(parts[nxt])))
            if (previous := before[i]) >= 0:
                cost = rank(parts[previous] + parts[i])
                if cost is not None:
                    heapq.heappush(waiting, (cost, previous, len(parts[previous]) + size))
        return [part for part in parts if part is not None]

    def stable(self, left: Token, right: Token) -> bool:
        """Two neighbouring tokens encode to themselves."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(left + right) == [left, right]
            if len(self.pairs) < REMEMBERED // 4:
                self.pairs[left, right] = known
        return known

    def join(self, left: list[Token], right: list[Token]) -> list[Token]:
        """The encoding of two encoded neighbours' bytes together; ``left`` becomes it."""
        for i, token in enumerate(right):
            if self.stable(left[-1], token):
                left.extend(right[i:])
                break
            self._take_in(left, token)
        return left

    def _take_in(self, left: list[Token], token: Token) -> None:
        """Encode one more token, in a window that grows to the left until the rest is stable."""
        width = 1
        while True:
            window = self.merge(b"".join(left[-width:]) + token)
            if width >= len(left) or self.stable(left[-width - 1], window[0]):
                left[-width:] = window
                return
            width = min(2 * width, len(left))

    def encode(self, data: bytes) -> list[Token]:
        """Tokens of one piece, by halves."""
        if data in self.ranks:
            return [data]
        if len(data) <= LEAF:
            return list(self.merge(data))
        middle = len(data) // 2
        return self.join(self.encode(data[:middle]), self.encode(data[middle:]))

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as packed 32-bit numbers."""
        known = self.pieces.get(piece)
        if known is None:
            data = piece.encode("utf-8", "surrogatepass")
            # A piece of one leaf is remembered as a piece only.
            one_leaf = len(data) <= LEAF and data not in self.ranks
            tokens = self._merge_short(data) if one_leaf else self.encode(data)
            known = array("i", map(self.ranks.__getitem__, tokens)).tobytes()
            if len(self.pieces) < REMEMBERED and len(piece) <= LONGEST_REMEMBERED:
                self.pieces[piece] = known
        return known

    def encode_text(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; no token spans two pieces, so their encodings are concatenated."""
        return np.frombuffer(b"".join(map(self.piece_ids, self.split(text or ""))), np.int32)

    def decode_ids(self, ids) -> bytes:
        """The bytes of an id sequence, concatenated up the tree of halves."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode_ids(ids[:middle]) + self.decode_ids(ids[middle:])


#: The codecs of a worker, which live as long as it does.
_codecs: dict[tuple[str, str], TreeCodec] = {}


def worker_codec(path: str, pattern: str, ranks: Broadcast) -> TreeCodec:
    """The codec of a vocabulary, made once in a worker: what it remembers serves later tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeCodec(ranks.value, pattern)
    return _codecs[path, pattern]


class BpeTree:
    """Column functions for one vocabulary.

    The driver reads the rank file and broadcasts it (a vocabulary of at most ``max_ranks``
    entries), so executors need no copy of the file.
    """

    def __init__(
        self, spark: SparkSession, path: str, pattern: str, max_ranks: int = 500_000
    ) -> None:
        ranks = read_ranks(path)
        if len(ranks) > max_ranks:
            raise ValueError(f"{len(ranks)} ranks; at most {max_ranks} are broadcast")
        shared = spark.sparkContext.broadcast(ranks)
        ids_type = T.ArrayType(T.IntegerType())

        @F.pandas_udf(ids_type)
        def encode(texts: pd.Series) -> pd.Series:
            own = worker_codec(path, pattern, shared)
            return pd.Series([own.encode_text(t) for t in texts], dtype=object)

        @F.pandas_udf(T.BinaryType())
        def decode(ids: pd.Series) -> pd.Series:
            own = worker_codec(path, pattern, shared)
            return pd.Series(
                [None if x is None else own.decode_ids(x.tolist()) for x in ids], dtype=object
            )

        def both(own: TreeCodec, batch: pa.RecordBatch, text: int) -> pa.RecordBatch:
            ids = [own.encode_text(t) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(ids))
            decoded = pa.array([own.decode_ids(x.tolist()) for x in ids], pa.binary())
            names = [*batch.schema.names, "ids", "decoded"]
            return pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names)

        def round_trips(text: int) -> Callable:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = worker_codec(path, pattern, shared)
                for batch in batches:
                    # Small results: a batch of long texts would have very many ids.
                    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                        yield both(own, batch.slice(at, ROWS_AT_ONCE), text)

            return work

        self._encode, self._decode, self._round_trips = encode, decode, round_trips

    def round_trip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``ids`` and ``decoded`` (what the ids stand for) of every whole text.

        Columns of these names that the documents have already are replaced. Decoding a column of
        ids just encoded would make Spark encode each text twice.
        """
        kept = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")])
        schema = (
            T.StructType(list(kept.schema.fields))
            .add("ids", T.ArrayType(T.IntegerType()))
            .add("decoded", T.BinaryType())
        )
        return kept.mapInArrow(self._round_trips(kept.columns.index(text)), schema)

    def encode(self, text: Column) -> Column:
        """The token ids of a text."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for; null for null."""
        return self._decode(ids)
