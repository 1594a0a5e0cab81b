"""Token ids in files: one frame per document, one zstandard dictionary for all.

A document's ids, with an end id, are serialized as little-endian integers (16 bits if
all ids fit, else 32) and compressed by themselves with a dictionary that was trained on the serialized ids of
other documents, so that one short document can be read without its neighbours.

A folder holds three Parquet tables, written by Spark's committed writer on any store:

* ``shards``: ``part``, ``shard``, ``first_id``, ``last_id``, ``start`` (ids before the shard within its part),
  ``n_tokens``, ``doc_ids``, ``sizes`` (ids per document), ``offsets`` (of the frames in ``data``, one more than
  documents), ``data`` and ``dictionary_sha256``.  Parts, shards and documents ascend by id.
* ``parts``: ``part`` and ``start``, the ids of all parts before it: one row per written partition.
* ``dictionary``: ``sha256``, ``data`` and ``width`` (bytes per id).

Rows: a null text has only the end id, like an empty one; null ids come first; rows with one id
are ordered by a hash of their texts, equal rows are all written; an empty table gives empty
shards and a dictionary without content.  A text of any length is one frame.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.llm.common import MEMORIES, thin
from sceneframe.llm.ordering import by_ranges, numbered_input

#: documents that the dictionary is trained on (about as many: a share of the table by a hash, of which the short ones count), and
#: their largest length: short documents are what it is for
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
_HASHES = 1 << 40
#: a shard ends at so many documents or bytes of frames
SHARD_DOCS, SHARD_BYTES = 512, 1 << 20
#: bytes of chunks and their ids that a worker remembers; results don't depend on it
CACHE_BYTES = 192 << 20
#: ASCII punctuation, and words of Latin letters after at most one space: whole matches of the byte-level pattern
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)")
_LONGEST = 100
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary()), ("dictionary_sha256", pa.string())])
_SHARDS_DDL = ("part int, shard int, first_id long, last_id long, start long, n_tokens long, doc_ids array<long>, sizes array<int>, "
               "offsets array<long>, data binary, dictionary_sha256 string")


class Encoder:
    """A tokenizer file of the tokenizers library; strings of special tokens in a text are ordinary text.

    A pre-tokenizer of the byte-level kind never crosses the place before a lone space or around a lone line feed,
    so in texts whose white space is of that kind the pieces between are encoded once and remembered.  Other
    texts, and all texts of other tokenizers, are encoded whole.  A piece that is a plain word (and punctuation after
    it) needs no pre-tokenizer: the library's model gets its byte-level letters at once.
    """

    def __init__(self, file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        largest = max(end_id, self.tokenizer.get_vocab_size() - 1, *self.tokenizer.get_vocab().values())
        self.kind = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        before = self.tokenizer.pre_tokenizer
        self.parts = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.line = self._ids(["\n"])[0]
        self.parts &= len(self.line) == self.kind.itemsize
        self.model = self.tokenizer.model
        # tokens that are cut out of a text before its words
        self.words = self.parts and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.letters = dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.cache: dict[str, bytes] = {"\n": self.line}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The same for pieces without line feeds, many in one call: as lines, parted again at the line feed's id."""
        out: list[bytes] = []
        for found in self.tokenizer.encode_batch_fast(["\n".join(pieces[k:k + 256]) for k in range(0, len(pieces), 256)], add_special_tokens=False):
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(ids == np.frombuffer(self.line, self.kind)[0]) * self.kind.itemsize
            packed, first = ids.tobytes(), 0
            for cut in [*cuts.tolist(), len(packed)]:
                out.append(packed[first:cut])
                first = cut + self.kind.itemsize
        return out

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """The same for single matches of the pattern, from the library's model."""
        tokenize, space, ids, ends = self.model.tokenize, chr(self.letters[32]), [], []
        for word in words:
            seen = word.replace(" ", space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in tokenize(seen)]
            ends.append(len(ids))
        packed, size, first, out = np.array(ids, self.kind).tobytes(), self.kind.itemsize, 0, []
        for end in ends:
            out.append(packed[first:end * size])
            first = end * size
        return out

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(pieces, ids, strict=True))
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + 150 * len(pieces)

    def _learn(self, pieces: list[str]) -> None:
        """Encode some pieces and remember their ids."""
        other, words, parted = [], set(), []
        for piece in pieces:
            word = piece.rstrip(_MARKS)
            plain = word.removeprefix(" ")
            if self.words and len(piece) <= _LONGEST and (plain.isalpha() if plain.isascii() else _WORD.fullmatch(word)):
                words.add(word)
                if len(word) < len(piece):
                    parted.append((piece, word, piece[len(word):]))
            else:
                other.append(piece)
        words.update([tail for _, _, tail in parted])
        new = [w for w in words if w not in self.cache]
        self._remember(new, self._ids_of_words(new))
        self._remember([p for p, _, _ in parted], [self.cache[word] + self.cache[tail] for _, word, tail in parted])
        self._remember(other, self._ids_of_pieces(other))

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text whose white space is lone spaces and line feeds; else the text, or pieces of which one is empty or a space."""
        if not self.parts:
            return [text]
        if not text.replace("\n", " ").isprintable() and ("\0" in text or " ".join(text.split()) != text.replace("\n", " ")):
            return [text]                        # all other white space counts as not printable
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of whole texts, each with the end id."""
        collects = gc.isenabled()
        gc.disable()                 # nothing here is cyclic, and the collector would walk the lists of pieces again and again
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 3))    # the first third holds the frequent pieces
            self.held = sum(len(k) + len(v) + 150 for k, v in self.cache.items())
        known, end = self.cache, self.end
        out: list[bytes | None] = [None] * len(texts)
        whole, partly, missing = [], [], set()
        for k, text in enumerate(texts):
            pieces = self._pieces(text)
            if len(pieces) == 1:
                whole.append(k)
                continue
            ids = list(map(known.get, pieces))
            try:
                out[k] = b"".join(ids) + end
            except TypeError:                    # a piece is not known yet
                new = {p for p, x in zip(pieces, ids) if x is None}
                if "" in new or " " in new:      # white space beside white space, or at an end: these two are never remembered
                    whole.append(k)
                else:
                    missing |= new
                    partly.append((k, pieces, ids))
        found = list(missing)
        for start in range(0, len(found), 4096):
            self._learn(found[start:start + 4096])
        for k, pieces, ids in partly:
            out[k] = b"".join([known[p] if x is None else x for p, x in zip(pieces, ids)]) + end
        for k, ids in zip(whole, self._ids([texts[k] for k in whole])):
            out[k] = ids + end
        return out


@lru_cache(2)
def _encoder(name: str, end_id: int) -> Encoder:
    return Encoder(SparkFiles.get(name), end_id)


MEMORIES["id encoder"] = _encoder.cache_clear


def _runs(texts: list, size: int = 1 << 20):
    """Slices of some texts with a bounded number of characters each (or one longer text)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    yield slice(start, len(texts))


def train(docs: DataFrame, name: str, end_id: int) -> tuple[bytes, int]:
    """The dictionary, from a bounded sample of short documents, and the width of an id; one task trains it.

    A table with too little to train on gives a dictionary without content.
    """
    short = (numbered_input(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).where(F.length("text").between(1, SAMPLE_CHARS))
             .select("text", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(_HASHES)).alias("_hash")))
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = short.where(F.col("_hash") < int(share * _HASHES)).select("text")

    def step(batches):
        encoder = _encoder(name, end_id)
        samples = [ids for batch in batches for ids in encoder.encode(batch.column(0).to_pylist())]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary()), pa.array([encoder.kind.itemsize], pa.int32())], names=["data", "width"])

    found = sample.repartition(1).mapInArrow(step, "data binary, width int").first()
    return (bytes(found.data), found.width) if found else (b"", 4)     # an empty table may have no task at all


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode every row's whole text and write the folder's three tables, ascending by ``doc_id``."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    data, width = train(docs, name, end_id)
    digest = hashlib.sha256(data).hexdigest()

    def step(batches):
        encoder = _encoder(name, end_id)
        compressor = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(data))
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, held = [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "first_id": ids[0], "last_id": ids[-1], "start": start, "n_tokens": sum(sizes), "doc_ids": ids,
                "sizes": sizes, "offsets": offsets.tolist(), "data": b"".join(frames), "dictionary_sha256": digest}], _SHARDS)

        for batch in thin(batches, 500, keep="id encoder"):
            found, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for run in _runs(texts):
                for doc_id, packed in zip(found[run], encoder.encode(texts[run])):
                    frame = compressor.compress(packed)
                    ids.append(doc_id)
                    sizes.append(len(packed) // width)
                    frames.append(frame)
                    held += len(frame)
                    if len(ids) == SHARD_DOCS or held >= SHARD_BYTES:
                        yield row()
                        shard, start = shard + 1, start + sum(sizes)
                        ids, sizes, frames, held = [], [], [], 0
        if ids:
            yield row()

    text = F.coalesce("text", F.lit(""))
    rows = numbered_input(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))).withColumn("_key", F.xxhash64("text"))
    (by_ranges(rows, "doc_id", "_key", "_tie").select("doc_id", "text").mapInArrow(step, _SHARDS_DDL)
     .write.option("compression", "none").parquet(f"{folder}/shards"))
    totals = sorted(tuple(r) for r in spark.read.schema(_SHARDS_DDL).parquet(f"{folder}/shards").groupBy("part").agg(F.sum("n_tokens")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()       # one row per written partition
    (spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part int, start long").coalesce(1)
     .write.parquet(f"{folder}/parts"))
    spark.createDataFrame([(digest, data, width)], "sha256 string, data binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")


def _opened(spark: SparkSession, folder: str) -> tuple[str, bytes, int]:
    digest, data, width = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary in {folder} is not the one that was written")
    return digest, bytes(data), width


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) from a written folder.

    With ``doc_ids`` only shards whose range holds one of them are opened and only their own frames are decompressed.
    """
    digest, data, width = _opened(spark, folder)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    shards = spark.read.schema(_SHARDS_DDL).parquet(f"{folder}/shards")
    if wanted is not None:
        held = F.lit(False)
        for i in sorted(wanted):
            held = held | F.lit(i).between(F.coalesce("first_id", F.lit(-1 << 63)), F.col("last_id"))    # null ids come first
        shards = shards.where(held)
    # one row per written partition
    parts = F.broadcast(spark.read.schema("part int, start long").parquet(f"{folder}/parts").select("part", F.col("start").alias("before")))
    rows = shards.join(parts, "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "sizes", "offsets", "data", "dictionary_sha256")

    def step(batches):
        opener = zstandard.ZstdDecompressor(**_dictionary(data))
        for batch in thin(batches, 1):
            start, ids, sizes, offsets, frames, named = (c[0].as_py() for c in batch.columns)
            if named != digest:
                raise ValueError(f"a shard was written with dictionary {named}, the folder has {digest}")
            starts = start + np.cumsum([0, *sizes[:-1]])
            for low in range(0, len(ids), 64):
                some = [k for k in range(low, min(low + 64, len(ids))) if wanted is None or ids[k] in wanted]
                packed = [np.frombuffer(opener.decompress(frames[offsets[k]:offsets[k + 1]]), f"<u{width}").astype("<u4").tobytes() for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in some], pa.int64()), pa.array(starts[some], pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()),
                     pa.array(packed, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(step, "doc_id long, start long, n_tokens long, ids binary")
