"""Byte-level BPE encoding and decoding, merges driven by segment trees.

A pretoken is a row of byte positions. A segment tree over these positions stores at each inner node the
least ``(rank of the pair that starts here, position)`` below it, so the root names the leftmost pair of
minimum rank. A merge takes that pair, links the live neighbours anew, and makes three point updates (the
merged place, the place that died, the live place on the left), each logarithmic in the pretoken's length.
Many pretokens of one padded width go through these steps together as rows of numpy arrays; a long one goes by
itself, and all places of its least rank merge together where that is the same.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map

_INF = np.int64(1) << np.int64(62)
_SHIFT = np.int64(32)
_LOW = (np.int64(1) << _SHIFT) - 1
#: Pretokens that a Python worker remembers at most; then it starts afresh.
CACHE_ROWS = 150_000
CACHE_CHARS = 200
#: Bytes from which on a pretoken is merged by itself, many places at a time.
LONG = 2048


class PairTable:
    """Open-addressing map from a pair of token ids to the rank of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.zeros(size, np.int64)
        keys = (left.astype(np.int64) << np.int64(31)) | right.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            _, where = np.unique(slot[free], return_index=True)
            first[np.flatnonzero(free)[where]] = True
            self.keys[slot[first]] = keys[todo[first]]
            self.ranks[slot[first]] = rank[todo[first]]
            todo, slot = todo[~first], (slot[~first] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, ``-1`` where the pair makes no token."""
        keys = (left.astype(np.int64) << np.int64(31)) | right.astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        live, slot = np.arange(len(keys)), self._home(keys)
        while len(live):
            found = self.keys[slot]
            hit = found == keys[live]
            out[live[hit]] = self.ranks[slot[hit]]
            on = (found >= 0) & ~hit
            live, slot = live[on], (slot[on] + 1) & self.mask
        return out


class Codec:
    """Encoder and decoder for a rank file (``base64-token rank`` lines) and a pretoken pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        left, right, rank = [], [], []
        get = self.ranks.get
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, rank)))
        self.cache: dict[str, bytes] = {}

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(left, right)
        return np.where(rank >= 0, (rank << _SHIFT) | place, _INF)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of each non-empty word."""
        out: list[bytes] = [b""] * len(words)
        widths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                widths.setdefault(1 << max(2, (len(w) - 1).bit_length()), []).append(i)
        for width, rows in widths.items():
            if width >= LONG:
                for i in rows:
                    out[i] = self._merge_long(words[i])
                continue
            step = max(1, (1 << 18) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        lens = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width, dtype=np.int64)
        inside = place < lens[:, None]
        # One more column: a dead place behind the last one, so that a missing neighbour needs no branch.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(inside, self.byte_ids[raw], -1)
        after = np.where(place + 1 < lens[:, None], place + 1, width)
        after = np.concatenate([after, np.full((n, 1), width)], axis=1).astype(np.int64)
        before = np.concatenate([np.tile(np.arange(-1, width - 1), (n, 1)), np.full((n, 1), -1)], axis=1).astype(np.int64)
        before[:, 0] = width
        tree = np.full((n, 2 * width), _INF, np.int64)
        paired = place + 1 < lens[:, None]
        r, c = np.nonzero(paired)
        tree[r, width + c] = self._pair_keys(ids[r, c], ids[r, c + 1], c)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat, row_len = tree.ravel(), 2 * width
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows = rows[root < _INF]
            if not len(rows):
                break
            root = tree[rows, 1]
            at, rank = root & _LOW, root >> _SHIFT
            gone = after[rows, at]
            right = after[rows, gone]
            left = before[rows, at]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            after[rows, at] = right
            before[rows, right] = at
            has_right, has_left = right < width, left < width
            key_at = np.full(len(rows), _INF, np.int64)
            key_at[has_right] = self._pair_keys(rank[has_right], ids[rows[has_right], right[has_right]], at[has_right])
            key_left = self._pair_keys(ids[rows[has_left], left[has_left]], rank[has_left], left[has_left])
            base = rows * row_len
            node = np.concatenate([base + width + at, base + width + gone, (base + width + left)[has_left]])
            flat[node] = np.concatenate([key_at, np.full(len(rows), _INF, np.int64), key_left])
            base = np.concatenate([base, base, base[has_left]])
            local = node - base
            while local[0] > 1:
                local >>= 1
                kid = base + 2 * local
                flat[base + local] = np.minimum(flat[kid], flat[kid + 1])
        live = ids[:, :width] >= 0
        flat_ids = ids[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat_ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one long word. All places of the least rank merge in one round where that equals merging them in turn.

        It does if no pair that comes up on the way has a rank below: then none of them can come before the next of
        these places. Else only the leftmost merges. A place that shares a token with the one before it waits.
        """
        n = len(word)
        width = 1 << max(2, (n - 1).bit_length())
        ids = np.append(self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int32), np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # n: no neighbour
        after[n], before[0] = n, n
        tree = np.full(2 * width, _INF, np.int64)
        tree[width : width + n - 1] = self._pair_keys(ids[: n - 1], ids[1:n], np.arange(n - 1))
        level = width
        while level > 1:
            np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
            level //= 2
        none = np.int64(_INF >> _SHIFT)

        def rank_of(left, right):
            out = np.full(len(left), none)
            live = (left >= 0) & (right >= 0)
            found = self.pairs.get(left[live], right[live])
            out[live] = np.where(found >= 0, found, none)
            return out

        while tree[1] < _INF:
            rank = int(tree[1] >> _SHIFT)
            node = np.array([1])
            while node[0] < width:
                node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                node = node[(tree[node] >> _SHIFT) == rank]
            at = (node - width).astype(np.int64)
            fresh = np.ones(len(at), bool)
            fresh[1:] = after[at[:-1]] != at[1:]
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            right = after[after[at]]
            met = np.full(len(at), rank)
            left = ids[before[at]]
            left[1:][right[:-1] == at[1:]] = rank  # the neighbour will have merged
            if len(at) > 1 and min(rank_of(met, ids[right]).min(), rank_of(left, met).min()) <= rank:
                at, right = at[:1], right[:1]
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = right
            before[right[right < n]] = at[right < n]
            lefts = before[at]
            place = np.unique(np.concatenate([at, lefts[lefts < n]])).astype(np.int64)
            keys = rank_of(ids[place], ids[after[place]])
            leaf = np.concatenate([place, gone])
            tree[width + leaf] = np.concatenate([np.where(keys < none, (keys << _SHIFT) | place, _INF), np.full(len(gone), _INF)])
            node = np.unique((width + leaf) >> 1)
            while node[0] >= 1:
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
                if node[0] == 1:
                    break
                node = np.unique(node >> 1)
        return ids[:n][ids[:n] >= 0].astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > CACHE_ROWS:
            self.cache.clear()
        fresh = list(set().union(*split).difference(self.cache))
        if fresh:
            self.cache.update(zip(fresh, self.merge_words([w.encode() for w in fresh]), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids that :meth:`encode` made."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[bytes, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of these ranks; one for each Python worker."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; it is the size of a vocabulary, whatever the corpus is."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode a text column and decode it again.

    Returns one row per input row: the id column, ``n_tokens``, ``ids`` (array of ids, if ``keep_ids``),
    ``ids_sha256`` and ``decoded_sha256``. A null or empty text has no tokens (the digests are those of no
    bytes); a null id stays null; repeated rows stay repeated; an empty table gives an empty result. Other
    columns of ``df``, of whatever name, are not read. No shuffle: each row is on its own.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint" + ", ids array<int>" * keep_ids + ", ids_sha256 string, decoded_sha256 string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
        cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
        cols.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids]))
        names = [id_col, "n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(df.select(df[id_col], df[text_col]), run, schema, text_col)
