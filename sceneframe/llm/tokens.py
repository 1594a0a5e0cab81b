"""Byte-level BPE encoding and decoding with a rank file.

A text is split by the tokenizer's pattern; the bytes of each match are merged by
rank.  The merges of one match are kept in a segment tree over its byte
positions: leaf ``i`` holds the rank of the pair that starts at the live part ``i``,
an inner node the leftmost minimum below it.  The root names the next merge; a
merge changes at most three leaves (itself, the live neighbour before it, the part it
swallowed), each with a logarithmic update.  Short matches of about equal length are merged side by
side, one tree per row of an array; long ones one at a time.

A null text counts as empty: no ids, and the hash of no bytes.  Repeated rows are
encoded alike; a match of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from public_tokenizers import PATTERN
from sceneframe.llm.common import MEMORIES, by_batch, release, thin

#: above every rank
_NONE = np.int64(1) << 40
#: bytes of encoded chunks remembered by a worker; a bound on memory, results don't depend on it
CACHE_BYTES = 48 << 20
#: what a chunk takes beside its characters and ids
_ENTRY = 160
#: matches up to so many bytes are merged side by side
_SHORT = 256


class Bpe:
    """One rank file and pattern."""

    def __init__(self, lines: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.ranked = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(len(self.pieces))
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = rank
        # an open-addressed table of id pairs
        size = 1 << max(4, (len(pairs) * 3).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        left, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = left[put], merged[put]
            left, merged, slot = left[~put], merged[~put], (slot[~put] + 1) & self.mask
        self.split = regex.compile(pattern).findall
        self.parts = pattern == PATTERN
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; _NONE where a side is missing (-1) or they don't merge."""
        pair = left * self.width + right
        pair[(left < 0) | (right < 0)] = -2
        slot = self._slot(pair)
        at = self.keys[slot]
        todo = np.flatnonzero((at != pair) & (at != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at[todo] = self.keys[slot[todo]]
            todo = todo[(at[todo] != pair[todo]) & (at[todo] != -1)]
        return np.where(at == pair, self.values[slot], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > _SHORT:
                out[i] = self._merge_long(piece)
            else:
                classes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, members in classes.items():
            at_once = (1 << 15) >> bits
            for start in range(0, len(members), at_once):
                some = members[start:start + at_once]
                for i, ids in zip(some, self._merge_rows([pieces[i] for i in some], 1 << bits)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((n, leaves), -1, np.int64)
        ids[np.arange(leaves) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        place = np.arange(leaves)
        after = np.tile(place + 1, (n, 1))           # next live position, `leaves` at the end
        before = np.tile(place - 1, (n, 1))          # previous live position, -1 at the start
        # node 1 is the root, leaf i is node leaves + i; a key is rank * leaves + position
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        right = np.full((n, leaves), -1, np.int64)
        right[:, :-1] = ids[:, 1:]
        rank = self.rank_of(ids.ravel(), right.ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank < _NONE, rank * leaves + place, _NONE)
        node = leaves
        while node > 1:
            tree[:, node // 2:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)

        def put(r, position, key):
            at = position + leaves
            tree[r, at] = key
            while at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        def key_of(r, position):
            follow = after[r, position]
            other = np.where(follow < leaves, ids[r, np.minimum(follow, leaves - 1)], -1)
            rank = self.rank_of(ids[r, position], other)
            return np.where(rank < _NONE, rank * leaves + position, _NONE)

        while len(rows):
            root = tree[rows, 1]
            position = root % leaves
            ids[rows, position] = root // leaves
            gone = after[rows, position]
            follow = after[rows, gone]
            after[rows, position] = follow
            inner = follow < leaves
            before[rows[inner], follow[inner]] = position[inner]
            ids[rows, gone] = -1
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, position, key_of(rows, position))
            ahead = before[rows, position]
            some = ahead >= 0
            if some.any():
                put(rows[some], ahead[some], key_of(rows[some], ahead[some]))
            rows = rows[tree[rows, 1] < _NONE]
        return [row[row >= 0].astype("<u4").tobytes() for row in ids]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same tree on plain lists, for one piece."""
        size = len(piece)
        leaves = 1 << (size - 1).bit_length()
        none, found = int(_NONE), self.ranked
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.rank_of(ids, np.append(ids[1:], -1))
        tree = [none] * (2 * leaves)
        tree[leaves:leaves + size] = np.where(ranks < _NONE, ranks * leaves + np.arange(size), _NONE).tolist()
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        ids = ids.tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def put(position, key):
            node = position + leaves
            tree[node] = key
            while node > 1:
                key = min(key, tree[node ^ 1])
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key

        def renew(position):
            follow = after[position]
            rank = found.get(self.pieces[ids[position]] + self.pieces[ids[follow]]) if follow < size else None
            put(position, none if rank is None else rank * leaves + position)

        while tree[1] < none:
            rank, position = divmod(tree[1], leaves)
            gone = after[position]
            after[position] = follow = after[gone]
            if follow < size:
                before[follow] = position
            ids[position], ids[gone] = rank, -1
            put(gone, none)
            renew(position)
            if before[position] >= 0:
                renew(before[position])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _chunks(self, text: str) -> list[str]:
        """Pieces of a text between which no match can reach.

        Where white space is lone spaces and line feeds, a match of the packaged pattern always begins before a space and
        before and after a line feed.  Other texts, and texts under other patterns, are split by the pattern as a whole.
        """
        if not self.parts or "\0" in text or " ".join(text.split()) != text.replace("\n", " "):
            return self.split(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        chunked = [self._chunks(t) for t in texts]
        if self.held > CACHE_BYTES:      # the first half holds the frequent chunks
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2))
            self.held = sum(len(k) + len(v) + _ENTRY for k, v in self.cache.items())
        cache = self.cache
        new = list(set().union(*chunked).difference(cache))
        matches = [self.split(chunk) for chunk in new]
        flat = list(set().union(*matches))
        ids = dict(zip(flat, self.merge([m.encode() for m in flat])))
        cache.update(zip(new, [b"".join([ids[m] for m in found]) for found in matches]))
        self.held += sum(len(chunk) + len(cache[chunk]) + _ENTRY for chunk in new)
        known = cache.__getitem__
        return [b"".join(map(known, chunks)) for chunks in chunked]

    def decode(self, packed: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(2)
def _loaded(name: str, pattern: str) -> Bpe:
    with open(SparkFiles.get(name), "rb") as file:
        return Bpe(file.read(), pattern)


MEMORIES["bpe"] = _loaded.cache_clear


def _shipped(docs: DataFrame, ranks: str) -> str:
    """Give every executor the rank file (under a megabyte); its name there."""
    docs.sparkSession.sparkContext.addFile(ranks)
    return ranks.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row's ``text``."""
    name = _shipped(docs, ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def step(rows):
        packed = _loaded(name, pattern).encode([t or "" for t in rows["text"]])
        return {"doc_id": rows["doc_id"], "ids": [np.frombuffer(p, "<i4") for p in packed]}
    return docs.select("doc_id", "text").mapInArrow(by_batch(step, schema, 500), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` of every row's ``ids``."""
    name = _shipped(encoded, ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def step(rows):
        bpe = _loaded(name, pattern)
        return {"doc_id": rows["doc_id"], "bytes": [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in rows["ids"]]}
    return encoded.select("doc_id", "ids").mapInArrow(by_batch(step, schema, 500), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """op4: encode, then decode the ids, in one pass.

    ``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    """
    name = _shipped(docs, ranks)
    kept = docs.select(*keep).schema

    def step(batches):
        for batch in thin(batches, keep="bpe"):
            bpe = _loaded(name, pattern)
            texts = batch.column(0).to_pylist()
            n, ids, back = [], [], []
            for start in range(0, len(texts), 500):
                for packed in bpe.encode([t or "" for t in texts[start:start + 500]]):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"])
            batch = texts = n = ids = back = packed = None
            release("bpe")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (docs.select(F.col("text").alias("_text"), *keep)
            .mapInArrow(step, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
