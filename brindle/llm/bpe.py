"""Byte-level BPE as matrix rounds: encode texts to token ids, and decode ids to bytes.

A text is cut by a pre-token pattern. Pieces not yet known to the worker are encoded
together: grouped by byte length, padded to numpy matrices of ids, and in every round
each row merges its leftmost pair of least rank, closes the gap, and leaves when no pair
is left. Ranks of pairs come from an open-addressing hash table over (left id, right id).
Pieces longer than LONG bytes, for which rounds over a matrix would cost the square of
the length, take the same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .util import ship

LONG = 256
#: Pieces that a task keeps; beyond, it starts anew.
KEPT_PIECES = 200_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Hash table from (left id, right id) to the id of their concatenation, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.probes = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            at = left[free]
            self.keys[slot[at]] = keys[at]  # of several that want a slot the last one has it
            won = at[self.keys[slot[at]] == keys[at]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * tk.MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs, NONE where a pair doesn't merge or has an id below 0."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = (self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys >= 0)
        at = np.flatnonzero(open_.ravel())
        flat, where, want = out.ravel(), slot.ravel(), keys.ravel()
        for _ in range(self.probes):
            if not len(at):
                break
            where[at] = (where[at] + 1) & self.mask
            found = self.keys[where[at]]
            hit = found == want[at]
            flat[at[hit]] = self.values[where[at[hit]]]
            at = at[~hit & (found != -1)]
        return flat.reshape(out.shape)


class ByteBPE:
    """Encoder and decoder of a rank file: one token in base 64 and its rank a line; id and rank are the same."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"{path} has no token for byte {missing[0]}")
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32))
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token_length = np.array([len(t) for t in self.tokens], np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_length)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) after all merges of a matrix of byte ids padded with -1."""
        n, width = ids.shape
        out, lengths = ids.copy(), (ids >= 0).sum(1)
        rows, ids = np.arange(n), ids.copy()
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while ranks.shape[1]:
            best = ranks.argmin(1)  # the first of the least: leftmost
            value = ranks[np.arange(len(rows)), best]
            go = value < NONE
            if not go.all():
                out[rows[~go], :] = -1
                out[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, ranks, best, value = rows[go], ids[go], ranks[go], best[go], value[go]
                if not len(rows):
                    return out, lengths
            lengths[rows] -= 1
            line = np.arange(len(rows))
            ids[line, best] = value
            take = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take + (take > best[:, None]), 1)
            take = take[:-1]
            ranks = np.take_along_axis(ranks, take + (take >= best[:, None]), 1)
            if ranks.shape[1]:
                for at in (best - 1, best):
                    ok = (at >= 0) & (at < ranks.shape[1])
                    ranks[line[ok], at[ok]] = self.pairs.get(ids[line[ok], at[ok]], ids[line[ok], at[ok] + 1])
            width = int(lengths[rows].max())
            if width < ids.shape[1]:
                ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
        out[rows, :] = -1
        out[rows, : ids.shape[1]] = ids
        return out, lengths

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges, one at a time, from a heap of (rank, place)."""
        n = len(piece)
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:])
        heap = [(int(first[i]), i) for i in np.flatnonzero(first < NONE).tolist()]
        heapq.heapify(heap)
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or ranks.get(parts[i] + parts[after[i]]) != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([ranks[p] for p in parts if p is not None], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each)."""
        own: list[np.ndarray] = [None] * len(pieces)
        counts = np.zeros(len(pieces), np.int64)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                own[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                own[i] = self.merge_long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4), []).append(i)
        for quarter, members in buckets.items():
            step = max(1, (1 << 20) // (4 * quarter))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                width = 4 * quarter
                size = np.array([len(pieces[i]) for i in part])
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width) < size[:, None], self.of_byte[raw], np.int32(-1))
                ids, size = self.merge_rows(ids)
                for row, i in enumerate(part):
                    own[i] = ids[row, : size[row]]
        for i, x in enumerate(own):
            counts[i] = len(x)
        return (np.concatenate(own) if own else np.zeros(0, np.int32)), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.known) > KEPT_PIECES:
            self._forget()
        pieces, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            sizes[i] = len(found)
            pieces += found
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            for p in new:
                known[p] = len(known)
            ids, counts = self.encode_pieces([p.encode() for p in new])
            begin = np.cumsum(counts) - counts + len(self.store)
            self.start, self.count, self.store = np.concatenate((self.start, begin)), np.concatenate((self.count, counts)), np.concatenate((self.store, ids))
        which = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        counts = self.count[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.start[which] - (ends - counts), counts) + np.arange(total)]
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, np.diff(at)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes of each)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id lies outside the vocabulary")
        sizes = self.token_length[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.token_bytes[np.repeat(self.token_start[ids] - (ends - sizes), sizes) + np.arange(total)], sizes


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each vocabulary and worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ids(bpe: ByteBPE, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    return bpe.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """(key, the columns in keep, n_tokens long, ids binary) for each row: token ids as little-endian unsigned 32-bit numbers.

    With check there is a column decoded (binary) as well: the ids decoded again, in the
    same pass.

    A null text counts as empty and has no ids; bytes that aren't UTF-8 become U+FFFD.
    Other columns are ignored, repeated rows are each encoded, an empty df gives no rows.
    The vocabulary file must lie at path on every executor.
    """
    ship(df.sparkSession)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}
    names = [*kinds, "n_tokens", "ids", *["decoded"] * check]

    def run(batches):
        bpe = coder(path, pattern)
        for piece, data, offsets in tk.text_chunks(batches, "_text"):
            ids, counts = _ids(bpe, data, offsets)
            columns = [*(piece.column(i) for i in range(len(kinds))), pa.array(counts), _binary(ids.astype("<u4").view(np.uint8), 4 * counts)]
            if check:
                out, sizes = bpe.decode(ids)
                columns.append(_binary(out, np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))])))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe._forget()

    return df.select(*kinds, F.col(text).cast("string").alias("_text")).mapInArrow(tk.tidy(run), ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_tokens long, ids binary" + ", decoded binary" * check)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, decoded binary, and the columns in keep) for each row of ids in encode's form; null ids decode to nothing."""
    ship(df.sparkSession)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}

    def run(batches):
        bpe = coder(path, pattern)
        for piece, data, offsets in tk.text_chunks(batches, "_ids"):
            if (np.diff(offsets) % 4).any():
                raise ValueError("ids must hold 4 bytes a token")
            out, sizes = bpe.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
            total = np.concatenate(([0], np.cumsum(sizes)))[offsets // 4]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(kinds))), _binary(out, np.diff(total))], names=[*kinds, "decoded"])

    return df.select(*kinds, F.col(ids).alias("_ids")).mapInArrow(tk.tidy(run), ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", decoded binary")
