"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

A text is cut by the tokenizer's pattern and each piece is encoded alone. Pieces that a worker has not met
are encoded together: by length, the pieces of a bucket are the rows of a padded matrix of token ids. In
each round every row merges its leftmost pair of lowest rank, so that each row loses one column and the
matrix is compacted by one mask; a rank is looked up by the two ids in a hashed table, and only for the two
pairs that a merge made. Rows without a pair that merges leave the matrix. A piece longer than
``LONGEST_ROW`` bytes (a run of a million spaces or letters) would take as many rounds as it has bytes, each
over all of them; it merges in the same order from a heap instead.

Defined results: a null text is an empty one, which has no ids; repeated rows are encoded each, rows of null
key too; other columns are ignored. Texts of any length are encoded whole. No rows give no rows.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


RANKS = "byte_bpe_multi_50k.tiktoken"
LONGEST_ROW = 256
#: Characters of the texts whose new pieces are encoded together.
GROUP_CHARACTERS = 2_000_000
#: Pieces that a process remembers before it starts anew, and their longest in characters.
CACHE_PIECES = 300_000
LONGEST_KEPT = 48
NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ranks_file(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _stand_ins() -> dict[int, str]:
    """Characters whose class (letter, number, white space, other) differs between the two installed libraries.

    The pattern speaks of classes, and each library has those of its own edition of Unicode. Each character
    is mapped to one that both put in tiktoken's class.
    """
    import tiktoken

    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k <= 0xDFFF)
    ranks = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    for kind, like in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\u00a0")):
        # What a pattern does not match is left out of the ids.
        matched = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        theirs, ours = set(bytes(matched).decode()), set(regex.findall(kind, every))
        out |= {ord(c): out.get(ord(c), "\u00a7") for c in ours - theirs} | {ord(c): like for c in theirs - ours}
    return out


class PairTable:
    """(left id, right id) -> id of the token that both make, or NONE: open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(2 * len(made)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.made = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = self._key(left, right)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.made[at[todo]] == NONE
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            win = todo[free & first]
            self.keys[at[win]], self.made[at[win]] = keys[win], made[win]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = self._key(left.ravel(), right.ravel())
        at = self._slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            found, made = self.keys[at[todo]] == keys[todo], self.made[at[todo]]
            out[todo[found]] = made[found]
            todo = todo[~found & (made != NONE)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Codec:
    """Encodes and decodes by a file of ranks (base64 token, rank) and a pattern."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.pattern = regex.compile(pattern)
        self.stand_ins = _stand_ins()
        self.odd = frozenset(map(chr, self.stand_ins))
        self.from_odd = re.compile(f"[{min(self.odd)}-\U0010ffff]").search if self.odd else None
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (a, b, made)
            for token, made in self.ranks.items()
            for k in range(1, len(token))
            if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None
        ]
        left, right, made = np.array(pairs, dtype=np.int64).T
        self.pairs = PairTable(left, right, made.astype(np.int32))
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), dtype=np.uint8)
        self.known: dict[str, bytes] = {}

    def _rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of at least one byte, all from one matrix."""
        width = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full((len(pieces), width), NONE, dtype=np.int32)  # of the pair that begins at a column
        real = ids[:, 1:] >= 0
        rank[:, :-1][real] = self.pairs(ids[:, :-1][real], ids[:, 1:][real])
        row = np.arange(len(pieces))
        out: list[np.ndarray | None] = [None] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1)  # the first of equal ones
            lowest = rank[np.arange(len(row)), at]
            if (done := lowest == NONE).any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : sizes[k]]
                open_ = ~done
                ids, rank, row, sizes, at, lowest = ids[open_], rank[open_], row[open_], sizes[open_], at[open_], lowest[open_]
                if not len(row):
                    break
            n, every = len(row), np.arange(len(row))
            ids[every, at] = lowest
            gone = np.ones(ids.shape, dtype=bool)
            gone[every, at + 1] = False
            ids = ids[gone].reshape(n, -1)
            rank = rank[gone].reshape(n, -1)
            sizes -= 1
            for first in (at - 1, at):
                on = (first >= 0) & (first < sizes)
                where, which = every[on], first[on]
                follows = which + 1 < sizes[on]
                rank[where[~follows], which[~follows]] = NONE
                where, which = where[follows], which[follows]
                rank[where, which] = self.pairs(ids[where, which], ids[where, which + 1])
        return out  # type: ignore[return-value]

    def _long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: the same merges in the same order, from a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        made = self.pairs(ids[:-1], ids[1:])
        heap = [(int(made[k]), int(k)) for k in np.flatnonzero(made != NONE)]
        heapq.heapify(heap)
        tokens, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pending = made.tolist() + [int(NONE)]
        known: dict[tuple[int, int], int] = {}

        def look(a: int, b: int) -> int:
            pair = (tokens[a], tokens[b])
            if (found := known.get(pair)) is None:
                found = known[pair] = int(self.pairs(np.array([pair[0]]), np.array([pair[1]]))[0])
            return found

        while heap:
            rank, k = heapq.heappop(heap)
            if pending[k] != rank:
                continue
            gone = after[k]
            tokens[k], after[k] = rank, after[gone]
            pending[gone] = -1
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a < 0:
                    continue
                pending[a] = look(a, after[a]) if after[a] < n else int(NONE)
                if pending[a] != NONE:
                    heapq.heappush(heap, (pending[a], a))
        out, k = [], 0
        while k < n:
            out.append(tokens[k])
            k = after[k]
        return np.array(out, dtype=np.int32)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; where the two libraries class a character differently, tiktoken's class counts."""
        if self.from_odd is None or text.isascii() or not self.from_odd(text) or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def encoded_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(raw) > LONGEST_ROW:
                out[k] = self._long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((k, raw))
        for held in buckets.values():
            for k, ids in zip([k for k, _ in held], self._rows([raw for _, raw in held]), strict=True):
                out[k] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        cut = [self.cut(text) for text in texts]
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        fresh = list(set().union(*cut).difference(self.known))
        self.known.update(zip(fresh, self.encoded_pieces(fresh), strict=True))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in fresh:
            if len(piece) > LONGEST_KEPT:
                del self.known[piece]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; an id that is not in the vocabulary raises."""
        if len(ids) and int(ids.max()) >= len(self.lengths):
            raise ValueError(f"no token has the id {int(ids.max())}")
        sizes = self.lengths[ids]
        if not (sizes > 0).all():
            raise ValueError("an id that no token has")
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


@functools.cache
def codec(path: str, pattern: str | None = None) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(path, pattern)


def _grouped(texts: pa.Array) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARACTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ids of each row: the token ids of its text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path or ranks_file())
        for batch in batches:
            at = 0
            for group in _grouped(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(model.encode(group), pa.binary())], names=[key, "ids"])
                at += len(group)

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("ids", BinaryType())]))


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key``, ids and bytes of each row of ``encode``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path or ranks_file())
        for batch in batches:
            raw = (model.decode(np.frombuffer(ids.as_buffer() or b"", dtype="<u4")) for ids in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(raw), pa.binary())], names=[key, "ids", "bytes"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("bytes", BinaryType())]))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return rows.select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
