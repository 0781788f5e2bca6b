"""Byte-level BPE: segment trees over byte positions hold the leftmost minimum pair rank; each merge updates live neighbours."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

_SHIFT = 20  # token ids stay below 2**20
_NONE = np.int64(1) << 40  # leaf without a mergeable pair
_LONG = 256  # bytes from which a piece gets a tree of its own
_KEPT = 64  # characters of a piece that is remembered


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file (base64 token, rank); ranks are the token ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Bpe:
    """Encoder and decoder for one rank table; ``cache_size`` bounds the remembered pieces, of which none is longer than ``_KEPT`` characters.

    A piece that is a token is that token, whatever the merges lead to; a byte that no token stands for is an error.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 100_000):
        if ranks and max(ranks.values()) >= 1 << _SHIFT:
            raise ValueError(f"token ids must be below {1 << _SHIFT}")
        self.ranks, self.cache_size = ranks, cache_size
        self.absent = bytes(b for b in range(256) if bytes([b]) not in ranks)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {
            ranks[token[:i]] << _SHIFT | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece with a tree of its own; used for long pieces."""
        n = len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        none, bits = 1 << 60, size.bit_length() - 1
        get = self.pairs.get
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            rank = get(ids[i] << _SHIFT | ids[j]) if j < n else None
            return none if rank is None else rank << bits | i

        def put(i: int, value: int) -> None:
            at = i + size
            tree[at] = value
            while at > 1:
                at >>= 1
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low

        for i in range(n):
            tree[size + i] = leaf(i)
        for at in range(size - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        while n > 1 and tree[1] < none:
            i, rank = tree[1] & (size - 1), tree[1] >> bits
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian uint32 bytes. Pieces of like length share one array of trees."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
                continue
            if self.absent and len(p.translate(None, self.absent)) < len(p):
                raise ValueError(f"the vocabulary has no token for a byte of {p[:40]!r}")
            if len(p) > _LONG:
                out[i] = np.array(self.encode_piece(p), "<u4").tobytes()
            elif p:
                by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, where in by_size.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(where), step):
                some = where[k : k + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        count, bits = len(pieces), width.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.byte_ids[raw]
        place = np.tile(np.arange(width, dtype=np.int64), count)
        ends = np.repeat(lengths, width)
        none = _NONE << bits
        after, before = place + 1, place - 1
        rank = np.full(count * width, _NONE)
        has = np.flatnonzero(place + 1 < ends)
        rank[has] = self._pair_ranks(ids[has], ids[has + 1])
        # one tree per row, root at 1; a leaf is rank << bits | position, so the minimum is the leftmost of the lowest rank
        tree = np.full((count, 2 * width), none)
        tree[:, width:] = np.where(rank == _NONE, none, rank << bits | place).reshape(count, width)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        flat = tree.reshape(-1)
        live = np.ones(count * width, bool)
        rows = np.arange(count)

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            base, node = row * (2 * width), at + width
            flat[base + node] = value
            for _ in range(bits):
                node = node >> 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])

        while True:
            root = flat[rows * (2 * width) + 1]
            keep = root < none
            rows, root = rows[keep], root[keep]
            if not len(rows):
                break
            at, new = root & (width - 1), root >> bits
            base = rows * width
            cell = base + at
            gone = after[cell]
            live[base + gone] = False
            nxt = after[base + gone]
            ids[cell], after[cell] = new, nxt
            inner = np.flatnonzero(nxt < lengths[rows])
            before[base[inner] + nxt[inner]] = at[inner]
            value = np.full(len(rows), none)
            right = self._pair_ranks(new[inner], ids[base[inner] + nxt[inner]])
            value[inner] = np.where(right == _NONE, none, right << bits | at[inner])
            prev = before[cell]
            has = np.flatnonzero(prev >= 0)
            left = self._pair_ranks(ids[base[has] + prev[has]], new[has])
            put(rows, gone, none)
            put(rows[has], prev[has], np.where(left == _NONE, none, left << bits | prev[has]))
            put(rows, at, value)
        live &= place < ends
        sizes = live.reshape(count, width).sum(1) * 4
        data, cuts = ids[live].astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; the pieces not seen before are merged together."""
        split = [self.find(t) for t in texts]
        cache = self.cache
        new = list(set().union(*split).difference(cache)) if split else []
        if len(cache) + len(new) > self.cache_size:
            cache.clear()
            new = list(set().union(*split))
        cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > _KEPT:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Bpe] = {}


def tokenizer(path: str, pattern: str) -> Bpe:
    """The encoder of this process for a rank file; loaded once, as the file lies on every machine."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def bpe_encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_tokens, ids`` and with ``decode`` also ``decoded``.

    ``ids`` is binary, little-endian unsigned 32-bit integers, the layout of token files; ``decoded`` holds the bytes that
    those ids stand for. Null text counts as empty and gives no tokens; ids may be null or repeat, each row is
    encoded by itself; an empty table gives an empty result. A text of any length is cut by ``pattern`` first, so merges never
    cross pieces; a piece longer than 256 bytes gets a tree of its own (n log n). No rows move between machines.
    """
    schema = f"`{id_col}` bigint, n_tokens bigint, ids binary" + ", decoded binary" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            ids = bpe.encode_batch(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids", "decoded"][: len(columns)])

    return df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the ids of ``ids_col`` stand for; null stays null."""

    @F.pandas_udf("binary")
    def decoded(ids):
        bpe = tokenizer(rank_path, pattern)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn(out_col, decoded(F.col(ids_col)))
