"""Line de-duplication with a log-template tree.

A line is parsed down a tree of fixed depth: its number of words, then its leading words; words that
hold a digit are variable fields and count as one symbol.  The lines that reach a leaf share a template:
word positions at which one word holds a majority are constant, all others are variable fields.  A line
belongs to its leaf's template if enough of its words are constants; otherwise its own words are its
template.  Templates found in at least ``min_docs`` different documents recur: their lines are dropped, save
the first one (by document id, then line), so that no text vanishes from the corpus altogether.

The unit is the whole line: passages repeated inside longer lines are not found.

Blank lines are kept and never counted.  A null text stays null and has no lines; an empty one stays
empty.  Repeated rows count as documents of their own and get equal results, equal lines
of one document count once.  Null ids come after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.common import scramble, settle, thin
from sceneframe.llm.hashing import chunks_of, word_hashes
from sceneframe.operators.scale import broadcast_if_small

#: documents in which a recurring template is found
MIN_DOCS = 10
#: leading words on the path to a leaf
DEPTH = 3
#: least share of a line's words that are constants of its leaf's template
ALIKE = 0.7
#: documents, and words of them, whose equal lines a task counts together before they are shuffled
_HELD, _HELD_WORDS = 4000, 1 << 20
_FIELD = np.uint64(0x5851F42D4C957F2D)
_NO_ID = np.iinfo(np.int64).max


def parse_lines(texts: list[bytes]):
    """All lines with words: ``(owner, line, leaf, template, first word, words, word hashes)``.

    ``owner`` is a text's number, ``line`` counts its lines from 0; leaf and template are hashes.
    """
    data, owner, start, end, words = word_hashes(texts, apart=10)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    words = np.where(digits[end] > digits[start], _FIELD, words)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[start]                                  # number of the line among all texts
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(line)])
    place = np.arange(len(line)) - np.repeat(first, size)
    mixed = scramble(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    lead = sums[first + np.minimum(size, DEPTH)] - sums[first]
    template = scramble(sums[first + size] - sums[first] + size.astype(np.uint64))
    leaf = scramble(lead + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] + 1 if texts else np.zeros(0, int)
    of = owner[first] if len(first) else np.zeros(0, int)
    number = line[first] - breaks[text_starts][of] if len(first) else np.zeros(0, int)
    return of, number, leaf, template, first, size, words


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(1).to_pylist()]


def _tally(worded: bool):
    """Rows (leaf, template, docs, doc_id, line): equal lines of a run of documents counted together.

    ``worded`` rows are (leaf, template, docs, words) instead, with the 64-bit hashes of the words.
    """
    def run(batches):
        held: list[tuple] = []
        docs = 0

        def flush():
            leaf, template, doc, line, n, words = (np.concatenate([h[k] for h in held]) for k in range(6))
            base = np.cumsum(np.r_[0, n])[:-1]
            order = np.lexsort((line, doc, template))
            key = template[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            seen = np.diff(np.r_[new, len(key)])
            at = order[new]
            columns = {"leaf": pa.array(leaf[at].view(np.int64)), "template": pa.array(template[at].view(np.int64)), "docs": pa.array(seen, pa.int64())}
            if not worded:
                yield pa.RecordBatch.from_pydict(columns | {"doc_id": pa.array(doc[at]), "line": pa.array(line[at], pa.int32())})
                return
            sizes = n[at]
            for part in chunks_of([range(k) for k in sizes.tolist()], 1 << 20):
                size = sizes[part]
                starts = np.cumsum(np.r_[0, size])
                place = np.arange(starts[-1]) + np.repeat(base[at[part]] - starts[:-1], size)
                listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words[place].view(np.int64)))
                yield pa.RecordBatch.from_pydict({k: c[part.start:part.stop] for k, c in columns.items()} | {"words": listed})
        for batch in thin(batches):
            ids, texts = _ids(batch), _texts(batch)
            for part in chunks_of(texts):
                of, line, leaf, template, _, size, words = parse_lines(texts[part])
                if not len(of):
                    continue
                once = _once(of, template)
                keep = np.zeros(len(of), bool)
                keep[once] = True
                kept = words[np.repeat(keep, size)] if worded else words[:0]
                held.append((leaf[once], template[once], ids[part][of[once]], line[once], size[once], kept))
                docs += part.stop - part.start
                if docs >= _HELD or sum(len(h[5]) for h in held) > _HELD_WORDS:
                    yield from flush()
                    held, docs = [], 0
        if held:
            yield from flush()
    return run


def _once(of: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Places of the first of each document's equal lines."""
    order = np.lexsort((template, of))
    new = np.r_[True, (of[order][1:] != of[order][:-1]) | (template[order][1:] != template[order][:-1])]
    return np.sort(order[new])


def _constants(lines: DataFrame) -> DataFrame:
    """``(leaf, constants)``: per word position the word that holds a majority, or null, from ``(leaf, total, docs, words)``."""
    votes = (lines.select("leaf", "total", "docs", F.posexplode("words").alias("place", "word"))
             .groupBy("leaf", "total", "place", "word").agg(F.sum("docs").alias("votes"))
             .groupBy("leaf", "total", "place").agg(F.max("votes").alias("votes"), F.max_by("word", "votes").alias("word")))
    majority = F.when(2 * F.col("votes") > F.col("total"), F.col("word"))
    return (votes.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", majority.alias("word")))).alias("x"))
            .select("leaf", F.col("x.word").alias("constants")))


def _alike(docs: DataFrame, kinds: DataFrame, min_docs: int) -> DataFrame:
    """``(leaf, template)`` of the lines that have enough of their leaf's constants.

    Only leaves of several templates and of lines enough take part.  No leaf is gathered: words are
    counted by leaf and position, and each line meets the row of its leaf's constants.
    """
    leaves = settle(kinds.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("own"))
                    .where((F.col("total") >= min_docs) & (F.col("own") > 1)).select("leaf", "total"))
    lines = settle(docs.select("doc_id", "text").mapInArrow(_tally(True), "leaf long, template long, docs long, words array<long>")
                   .join(broadcast_if_small(leaves), "leaf"))
    constants = broadcast_if_small(settle(_constants(lines)), edge_columns=("constants",))
    width = F.size("words")
    same = F.size(F.filter(F.zip_with("words", "constants", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return (lines.join(constants, "leaf").where((same >= F.lit(ALIKE) * width) & (same > F.least(F.lit(DEPTH), width)))
            .select("leaf", "template").distinct())


def _held_lines(batches):
    """The distinct lines of each row."""
    for batch in thin(batches):
        rows, texts = batch.column(0).to_numpy(), _texts(batch)
        for part in chunks_of(texts):
            of, _, _, template, *_ = parse_lines(texts[part])
            if len(of):
                once = _once(of, template)
                yield pa.RecordBatch.from_arrays([pa.array(rows[part][of[once]]), pa.array(template[once].view(np.int64))], names=["row", "template"])


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(leaf, template, first_doc, first_line)`` of the lines to drop.

    Lines of a leaf that only recur together get one row each, all with the first line of them.
    """
    kinds = settle(docs.select("doc_id", "text").mapInArrow(_tally(False), "leaf long, template long, docs long, doc_id long, line int")
                   .groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.min(F.struct("doc_id", "line")).alias("head")))
    alike = settle(_alike(docs, kinds, min_docs))
    own = broadcast_if_small(alike)
    single = kinds.where(F.col("docs") >= min_docs).join(own, ["leaf", "template"], "left_anti").select("leaf", "template", "head")
    members = settle(kinds.join(own, ["leaf", "template"]))
    # the sum of the lines' documents is a bound: a document may hold several lines of a group
    groups = members.groupBy("leaf").agg(F.sum("docs").alias("n"), F.min("head").alias("head")).where(F.col("n") >= min_docs).select("leaf", "head")
    groups = broadcast_if_small(settle(groups))
    asked = broadcast_if_small(settle(members.select("leaf", "template").join(groups, "leaf").select("leaf", "template")))
    holders = (docs.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_held_lines, "row long, template long")
               .join(asked, "template").select("leaf", "row").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))
    groups = groups.join(holders.where(F.col("n") >= min_docs).select("leaf"), "leaf")
    several = members.select("leaf", "template").join(broadcast_if_small(settle(groups)), "leaf").select("leaf", "template", "head")
    return single.unionByName(several).select("leaf", "template", F.col("head.doc_id").alias("first_doc"), F.col("head.line").alias("first_line"))


def _lines(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("template", pa.int64())])
    for batch in thin(batches):
        ids, texts, hashes = _ids(batch), _texts(batch), batch.column(2).to_numpy()
        for part in chunks_of(texts):
            of, line, _, template, *_ = parse_lines(texts[part])
            yield pa.RecordBatch.from_arrays([pa.array(ids[part][of]), pa.array(hashes[part][of]), pa.array(line, pa.int32()),
                                              pa.array(template.view(np.int64))], schema=schema)


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` shortened, and ``_n_lines``, ``_n_dropped``.

    A line that is not dropped keeps its bytes; the kept lines are joined by line feeds again.
    """
    found = broadcast_if_small(settle(recurring(docs, min_docs)))
    kid, th = F.coalesce("doc_id", F.lit(int(_NO_ID))), F.xxhash64(F.coalesce("text", F.lit("")))
    gone = (docs.select("doc_id", "text", th.alias("th")).mapInArrow(_lines, "_kid long, _th long, line int, template long")
            .join(found, "template")
            .where((F.col("_kid") != F.col("first_doc")) | (F.col("line") != F.col("first_line")))
            .groupBy("_kid", "_th").agg(F.collect_set("line").alias("_gone")))
    # documents that lose nothing need not meet the others
    gone = settle(gone)
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", kid.alias("_kid"), th.alias("_th"))
    joined = rows.join(broadcast_if_small(gone, edge_columns=("_gone",)), ["_kid", "_th"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t-\r]"))))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns],
                         n_lines.cast("long").alias("_n_lines"),
                         F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("_n_dropped"))
