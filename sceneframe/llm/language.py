"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed character n-grams (one to three
characters inside words).  Every language is described by a few centroids, found
by spherical k-means among its training vectors; a text takes the language of the
centroid with the highest cosine.  A text whose cosine lies far below what texts of
its length reach in training is *rejected*: its language is none of those learned.
What is usual for a length, and how common an n-gram is, is counted over all training texts.

Nulls and texts without a letter get ``und``, score 0 and are rejected.  Repeated rows get equal
answers, ties go to the alphabetically first language.  With no training rows every
text is ``und``.  Extra columns are ignored by :func:`predict` unless asked for.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.common import remainder, settle, thin
from sceneframe.operators.scale import broadcast_if_small

#: hashed n-gram dimensions
DIMENSIONS = 4096
#: centroids per language
CENTROIDS = 3
#: expected number of training texts per language; the centroids are fitted on a sample of this size
TRAINING_ROWS = 400
#: training texts a length class needs for a floor of its own
CLASS_ROWS = 20
#: standard deviations below the usual cosine at which a text is rejected
REJECT_SIGMAS = 6.0
#: characters vectorised at once
_BLOCK = 1 << 19


class Model(NamedTuple):
    langs: list[str]              # language of each centroid
    centroids: np.ndarray         # unit rows
    idf: np.ndarray
    floors: np.ndarray            # least accepted cosine by length class


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[_codes(text)].any())


def count_vectors(texts: list[str]) -> np.ndarray:
    """Hashed counts of the n-grams of lower-cased letters; other characters part words."""
    codes = _codes("\0\0" + "\0\0".join(t.lower() for t in texts) + "\0\0")
    owner = np.zeros(len(codes), np.int64)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    owner[2:] = np.repeat(np.arange(len(texts)), sizes)
    known = np.where(_letters()[codes], codes, np.uint32(32))
    slots = []
    for n, seed in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        m = len(known) - n + 1
        gram = np.zeros(m, np.uint32)
        letters = np.zeros(m, bool)
        for k in range(n):
            part = known[k:k + m]
            gram = (gram ^ part) * np.uint32(seed)
            gram ^= gram >> np.uint32(15)
            letters |= part != 32
        keep = letters & (known[n - 1:n - 1 + m] != 32) if n == 1 else letters
        slots.append(owner[:m][keep] * DIMENSIONS + (gram[keep] % np.uint32(DIMENSIONS)))
    flat = np.bincount(np.concatenate(slots), minlength=len(texts) * DIMENSIONS)
    return flat.reshape(len(texts), DIMENSIONS).astype(np.float32)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(counts) * idf
    norms = np.linalg.norm(weighed, axis=1, keepdims=True)
    return weighed / np.where(norms == 0, 1, norms)


def length_class(counts: np.ndarray) -> np.ndarray:
    """log2 of the number of n-grams, 0 to 24."""
    return np.minimum(24, np.log2(1 + counts.sum(axis=1)).astype(int))


def blocks(texts: list[str]):
    """Slices of the list with a bounded number of characters (or one text)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > _BLOCK or i - start >= 256):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def _sparse_rows(batches):
    schema = pa.schema([("lang", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
    for batch in thin(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in blocks(texts):
            dense = count_vectors(texts[part])
            where = [np.flatnonzero(row) for row in dense]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[part]), pa.array(where, pa.list_(pa.int32())),
                 pa.array([row[w] for row, w in zip(dense, where)], pa.list_(pa.float32()))], schema=schema)


def _clusterer(idf: np.ndarray, k: int):
    def fit(key, table):
        """Spherical k-means of one language's sample, from spread-out first centroids."""
        dense = np.zeros((table.num_rows, DIMENSIONS), np.float32)
        for row, (s, c) in enumerate(zip(table["slots"].to_pylist(), table["counts"].to_pylist())):
            dense[row, s] = c
        units = unit_vectors(dense, idf)
        units = units[np.lexsort(units.T[:8])]                       # the same order on any cluster
        centres = [units.mean(axis=0)]
        while len(centres) < min(k, len(units)):
            centres.append(units[np.argmin((units @ np.array(centres).T).max(axis=1))])
        centres = np.array(centres)
        for _ in range(12):
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
            near = (units @ centres.T).argmax(axis=1)
            centres = np.array([units[near == j].mean(axis=0) if (near == j).any() else centres[j]
                                for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        return pa.table({"lang": [key[0].as_py()] * len(centres), "centroid": list(centres.astype(np.float32))},
                        schema=pa.schema([("lang", pa.string()), ("centroid", pa.list_(pa.float32()))]))
    return fit


def fit(docs: DataFrame, training_rows: int = TRAINING_ROWS, k: int = CENTROIDS) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang`` of the given rows.

    The centroids come from at most about ``training_rows`` texts per language, chosen by a hash
    of the id and the text; n-gram weights and floors from all rows.  Statistics and k-means run in Spark, only the
    centroids (a few rows per language), the n-gram weights and a row per length class reach the driver.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    # a row per language: with the sizes at hand the texts are sampled where they are read
    by_lang = settle(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    total = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = broadcast_if_small(by_lang, text_columns=("lang",))
    # rows that share an id differ in their texts; equal texts count once
    spot = (F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(9)).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    sample = known.join(sizes, "lang").where(spot < F.lit(float(training_rows)) / F.col("n")).select("lang", "text").dropDuplicates()
    rows = settle(sample.mapInArrow(_sparse_rows, "lang string, slots array<int>, counts array<float>"))
    idf = np.full(DIMENSIONS, np.log(1.0 + total) + 1, np.float32)
    for r in known.select("text").mapInArrow(_slot_rows, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        idf[r["s"]] = np.log((1.0 + total) / (1.0 + r["n"])) + 1
    found = rows.groupBy("lang").applyInArrow(_clusterer(idf, k), "lang string, centroid array<float>").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMENSIONS)
    model = Model([r["lang"] for r in found], centroids, idf, np.zeros(25, np.float32))
    return model._replace(floors=_floors(known.select("text"), model))


def _slot_rows(batches):
    """For each dimension the number of a task's texts that have it."""
    held = np.zeros(DIMENSIONS, np.int64)
    for batch in thin(batches):
        texts = batch.column(0).to_pylist()
        for part in blocks(texts):
            held += np.count_nonzero(count_vectors(texts[part]), axis=0)
    slots = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(held[slots])], names=["s", "n"])


def _floors(texts: DataFrame, model: Model) -> np.ndarray:
    """Mean less REJECT_SIGMAS deviations of all training cosines, by length class.

    A class with too few texts has the floor of the nearest class with enough (of two, the lower one).
    Texts without a letter have no cosine and don't count.
    """
    def measure(batches):
        for batch in thin(batches):
            texts = batch.column(0).to_pylist()
            for part in blocks(texts):
                counts = count_vectors(texts[part])
                some = counts.any(axis=1)
                best = (unit_vectors(counts, model.idf) @ model.centroids.T).max(axis=1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(length_class(counts)[some], pa.int32()), pa.array(best[some])],
                                                 names=["length", "cosine"])
    floors = np.zeros(25, np.float32)
    if model.langs:
        stats = (texts.mapInArrow(measure, "length int, cosine double").groupBy("length")
                 .agg(F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("m"), F.stddev_pop("cosine").alias("d")))
        own = {r["length"]: max(0.0, r["m"] - REJECT_SIGMAS * max(r["d"], 0.02)) for r in stats.collect() if r["n"] >= CLASS_ROWS}
        for c in range(len(floors) if own else 0):
            least = min(abs(c - x) for x in own)
            floors[c] = min(f for x, f in own.items() if abs(c - x) == least)
    return floors


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    kept = docs.select(*keep).schema

    def label(batches):
        for batch in thin(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            langs, scores, out = [], [], []
            for part in blocks(texts):
                counts = count_vectors(texts[part])
                some = [has_letter(t) for t in texts[part]]
                if model.langs:
                    cosines = unit_vectors(counts, model.idf) @ model.centroids.T
                    best = cosines.argmax(axis=1)
                    top = np.clip(cosines[np.arange(len(best)), best], 0, 1)
                    far = top < model.floors[length_class(counts)]
                for i, letters in enumerate(some):
                    known = letters and bool(model.langs)
                    langs.append(model.langs[best[i]] if known else "und")
                    scores.append(float(top[i]) if known else 0.0)
                    out.append(not known or bool(far[i]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())],
                names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (docs.select(F.col("text").alias("_text"), *keep)
            .mapInArrow(label, f"{fields}, lang_pred string, score double, rejected boolean"))


def identify(docs: DataFrame) -> DataFrame:
    """op9: fit on three quarters of the ids, predict all documents."""
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    return (predict(docs, model)
            .select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is known, unchanged."""
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return predict(whole, model, ("_row",)).where(~F.col("rejected")).select("_row.*")
