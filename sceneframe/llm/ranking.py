"""Ranked lexical search by pipelined term owners.

Items are the queries, documents the collection.  Terms are dealt to ``OWNERS`` term owners by how rare they
are, the rarest first.  Items travel in bundles; a bundle carries, for one block of documents at a time, sparse
accumulators (item, document, integer score).  It passes the owners one after the other: each is a cogroup of the
bundles with the owner's postings on (bundle, block) that adds the owner's contributions.  Then every item's
best documents are selected.

Exact pruning: what the owners still to come can add to an item has a bound.  A document whose score with that bound stays
below the score that ``top`` documents already have can't be among the best and is dropped from the bundle;
equal scores stay.  After each owner these scores are taken over all blocks.

A block is up to ``BLOCK_DOCS`` documents that one task read, a bundle up to ``BUNDLE_ITEMS`` items, so a cogroup is bounded whatever
the tables hold; a hot source or a frequent term only makes more blocks.  The dictionary of the items' terms is broadcast; items with
more than ``ROUND_PAIRS`` distinct (item, term) pairs between them are searched in rounds, each with its own bounded dictionary.

Rows: null or empty texts have no terms; such documents count nowhere and such items have no answers.  Documents with
one id are ranked apart, also equal ones; equal scores go by id, null first.  Equal rows of an item are one
item, other texts under its id are items of their own.  An empty table gives no rows; a text of any length is read whole.
Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.llm.common import settle, thin
from sceneframe.llm.ordering import numbered_input
from sceneframe.operators.scale import checkpoint_folder

TOP = 20
OWNERS = 4
BUNDLE_ITEMS = 256
_BLOCK_BITS = 13
BLOCK_DOCS = 1 << _BLOCK_BITS
#: distinct (item, term) pairs of a round
ROUND_PAIRS = 250_000
#: `[0-9A-Za-z]` and all bytes above ASCII are term bytes, A-Z in lower case; the others are blanks
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUNDLES = "bundle int, block long, items binary, slots binary, scores binary"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def _as_bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


@dataclass(frozen=True)
class Asked:
    """The items of a round: their distinct terms, and (item, term, times) by term."""

    terms: list[bytes]
    starts: np.ndarray       # of a term's pairs, one more than terms
    items: np.ndarray
    times: np.ndarray
    n_items: int

    def of(self, term: int, bundle: int) -> slice:
        """A term's pairs with items of a bundle."""
        a, b = self.starts[term], self.starts[term + 1]
        low, high = np.searchsorted(self.items[a:b], [bundle * BUNDLE_ITEMS, (bundle + 1) * BUNDLE_ITEMS])
        return slice(a + low, a + high)


@dataclass(frozen=True)
class Weighted:
    """What the collection says about a round's terms; ``rest[s]`` bounds what the owners after s can add to an item."""

    documents: int
    words: int
    weight: np.ndarray
    owner: np.ndarray
    rest: np.ndarray


def _item_terms(batches):
    for batch in batches:
        rows = [np.unique(np.array(terms_of(t), object), return_counts=True) for t in _as_bytes(batch.column(1))]
        sizes = [len(r[0]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array([t for r in rows for t in r[0]], pa.binary()),
             pa.array([int(c) for r in rows for c in r[1]], pa.int64())], names=["row", "term", "times"])


def _asked(pairs: DataFrame) -> tuple[Asked, np.ndarray]:
    """The round's items, numbered by their rows; and these rows."""
    table = pairs.toArrow()
    rows, items = np.unique(table.column("row").to_numpy(), return_inverse=True)
    names = table.column("term").to_pylist()
    terms = sorted(set(names))
    number = {t: k for k, t in enumerate(terms)}
    ids = np.array([number[t] for t in names], np.int64)
    order = np.lexsort((items, ids))
    starts = np.searchsorted(ids[order], np.arange(len(terms) + 1))
    return Asked(terms, starts, items[order].astype(np.int32), table.column("times").to_numpy()[order], len(rows)), rows


def _count(shared: Broadcast):
    """Documents with a term: row, id, number of terms, and the round's terms in it with their occurrences."""
    def step(batches):
        number = {t: k for k, t in enumerate(shared.value.terms)}
        for batch in thin(batches):
            keep, n, ids, times = [], [], [], []
            for k, text in enumerate(_as_bytes(batch.column(2))):
                words = terms_of(text)
                if words:
                    found: dict[int, int] = {}
                    for w in filter(number.__contains__, words):
                        found[number[w]] = found.get(number[w], 0) + 1
                    keep.append(k)
                    n.append(len(words))
                    ids.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                    times.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            rest = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())],
                                             names=["row", "doc_id", "n", "ids", "times"])
    return step


def _tally(size: int):
    """Of each term the documents and the most occurrences in one, over a task."""
    def step(batches):
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            df += np.bincount(ids, minlength=size)
            np.maximum.at(most, ids, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen]), pa.array(most[seen])], names=["term", "df", "most"])
    return step


def weigh(asked: Asked, df: np.ndarray, most: np.ndarray, documents: int, words: int) -> Weighted:
    """Weights, owners of about equal shares of the postings (rarest terms first) and bounds."""
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    order = np.argsort(df, kind="stable")
    load = np.cumsum(df[order])
    owner = np.empty(len(df), np.int64)
    owner[order] = np.minimum(OWNERS - 1, OWNERS * (load - df[order]) // max(1, load[-1]))
    # a document's length factor is 75 at least
    largest = np.where(most > 0, weight * (1_000_000_000 * most // (1000 * np.maximum(most, 1) + 12 * 75)), 0)
    by_pair = np.repeat(np.arange(len(df)), np.diff(asked.starts))
    rest = np.zeros((OWNERS, asked.n_items), np.int64)
    for s in range(OWNERS):
        later = owner[by_pair] > s
        np.add.at(rest[s], asked.items[later], (asked.times * largest[by_pair])[later])
    return Weighted(documents, words, weight, owner, rest)


def _deal(asked_shared: Broadcast, weighted_shared: Broadcast):
    """Postings by owner, bundle and block: sorted by term, with the document's slot in its block and the term's factor there."""
    def step(batches):
        asked, weighted = asked_shared.value, weighted_shared.value
        bundles = -(-asked.n_items // BUNDLE_ITEMS)
        by_pair = np.repeat(np.arange(len(asked.terms)), np.diff(asked.starts))
        inside = [None] if bundles == 1 else [np.unique(by_pair[asked.items // BUNDLE_ITEMS == b]) for b in range(bundles)]

        block, held = None, []

        def dealt():
            row, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids, times = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.int64)
            sizes = np.concatenate([h[4] for h in held])
            doc_ids = [None] * BLOCK_DOCS
            for r, d in zip((row & (BLOCK_DOCS - 1)).tolist(), [d for h in held for d in h[5]]):
                doc_ids[r] = d
            slots = np.repeat(row & (BLOCK_DOCS - 1), sizes)
            m = np.repeat(75 + 25 * n * weighted.documents // weighted.words, sizes)
            factors = 1_000_000_000 * times // (1000 * times + 12 * m)
            order = np.argsort(ids, kind="stable")
            ids, slots, factors = ids[order], slots[order], factors[order]
            owner = weighted.owner[ids]
            found = []
            for b, own in enumerate(inside):
                mine = np.ones(len(ids), bool) if own is None else np.isin(ids, own)
                if mine.any():
                    for s in range(OWNERS):
                        at = mine & (owner == s)
                        if at.any() or s == OWNERS - 1:
                            found.append({"owner": s, "bundle": b, "block": block, "terms": ids[at].astype("<i4").tobytes(), "slots": slots[at].astype("<u2").tobytes(),
                                          "factors": factors[at].astype("<i4").tobytes(), "doc_ids": doc_ids[:int(row[-1] & (BLOCK_DOCS - 1)) + 1] if s == OWNERS - 1 else None})
            return pa.RecordBatch.from_pylist(found, _POSTINGS)

        for batch in batches:
            row = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(row >> _BLOCK_BITS)) + 1).tolist(), len(row)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and row[a] >> _BLOCK_BITS != block:
                    yield dealt()
                    held = []
                block = int(row[a] >> _BLOCK_BITS)
                part = batch.slice(a, b - a)
                packed = part.column(3).to_pylist()
                held.append((row[a:b], part.column(2).to_numpy(), np.frombuffer(b"".join(packed), "<i4"), np.frombuffer(b"".join(part.column(4).to_pylist()), "<i4"),
                             np.array([len(p) // 4 for p in packed], np.int64), part.column(1).to_pylist()))
        if held:
            yield dealt()
    return step


_POSTINGS = pa.schema([("owner", pa.int32()), ("bundle", pa.int32()), ("block", pa.int64()), ("terms", pa.binary()), ("slots", pa.binary()), ("factors", pa.binary()),
                       ("doc_ids", pa.list_(pa.int64()))])
_POSTINGS_DDL = "owner int, bundle int, block long, terms binary, slots binary, factors binary, doc_ids array<long>"


class Owner:
    """One term owner: adds its postings' contributions to the accumulators of a bundle in a block."""

    def __init__(self, asked: Asked, weighted: Weighted, stage: int, best: np.ndarray, top: int):
        self.asked, self.weighted, self.stage, self.best, self.top = asked, weighted, stage, best, top

    def add(self, bundle: int, carried: list, postings: list) -> np.ndarray:
        """Scores by item of the bundle and slot, from carried (items, slots, scores) and (terms, slots, factors)."""
        first = bundle * BUNDLE_ITEMS
        width = 1 + max((int(x[1].max()) for x in [*carried, *postings] if len(x[1])), default=-1)
        scores = np.zeros((min(BUNDLE_ITEMS, self.asked.n_items - first), width), np.int64)
        for items, slots, held in carried:
            scores[items - first, slots] = held
        for terms, slots, factors in postings:
            cuts = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:]):
                term = int(terms[a])
                pairs = self.asked.of(term, bundle)
                scores[np.ix_(self.asked.items[pairs] - first, slots[a:b])] += np.outer(self.asked.times[pairs], self.weighted.weight[term] * factors[a:b].astype(np.int64))
        return scores

    def kept(self, bundle: int, scores: np.ndarray) -> np.ndarray:
        """What can still be among an item's best."""
        low = bundle * BUNDLE_ITEMS
        least = self.best[low:low + len(scores)]
        if scores.shape[1] >= self.top:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.top, axis=1)[:, -self.top])
        return (scores > 0) & (scores + self.weighted.rest[self.stage][low:low + len(scores), None] >= least[:, None])

    def passed_on(self, bundle: int, block: int, carried: list, postings: list) -> pa.Table:
        scores = self.add(bundle, carried, postings)
        items, slots = np.nonzero(self.kept(bundle, scores))
        return pa.table({"bundle": pa.array([bundle], pa.int32()), "block": pa.array([block], pa.int64()),
                         "items": pa.array([(items + bundle * BUNDLE_ITEMS).astype("<i4").tobytes()], pa.binary()),
                         "slots": pa.array([slots.astype("<u2").tobytes()], pa.binary()), "scores": pa.array([scores[items, slots].astype("<i8").tobytes()], pa.binary())})

    def selected(self, bundle: int, carried: list, postings: list, doc_ids: list) -> pa.Table:
        """The best documents of each item in this block, ties by id (null first)."""
        scores = self.add(bundle, carried, postings)
        items, slots = np.nonzero(self.kept(bundle, scores))
        low = np.iinfo(np.int64).min
        ids = np.array([low if d is None else d for d in doc_ids] or [0], np.int64)[slots]
        score = scores[items, slots]
        order = np.lexsort((ids, -score, items))
        items, slots, score = items[order], slots[order], score[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        take = place < self.top
        return pa.table({"item": pa.array(items[take] + bundle * BUNDLE_ITEMS, pa.int32()), "doc_id": pa.array([doc_ids[s] for s in slots[take]], pa.int64()), "score": pa.array(score[take], pa.int64())})


def _unpacked(table: pa.Table, kinds: dict[str, str]) -> list:
    return [tuple(np.frombuffer(v, k) for v, k in zip(row, kinds.values())) for row in zip(*(table.column(c).to_pylist() for c in kinds))]


_CARRIED, _POSTED = {"items": "<i4", "slots": "<u2", "scores": "<i8"}, {"terms": "<i4", "slots": "<u2", "factors": "<i4"}


def _first_owner(asked: Broadcast, weighted: Broadcast, top: int):
    """Bundles start at the first owner, without accumulators."""
    def step(batches):
        owner = Owner(asked.value, weighted.value, 0, np.zeros(asked.value.n_items, np.int64), top)
        for batch in thin(batches, 1):
            row = pa.Table.from_batches([batch])
            yield from owner.passed_on(row.column("bundle")[0].as_py(), row.column("block")[0].as_py(), [], _unpacked(row, _POSTED)).to_batches()
    return step


def _next_owner(asked: Broadcast, weighted: Broadcast, best: Broadcast, stage: int, top: int):
    def step(key, left: pa.Table, right: pa.Table) -> pa.Table:
        owner = Owner(asked.value, weighted.value, stage, best.value, top)
        bundle, block = (k.as_py() for k in key)
        carried, postings = _unpacked(left, _CARRIED), _unpacked(right, _POSTED)
        if stage < OWNERS - 1:
            return owner.passed_on(bundle, block, carried, postings)
        return owner.selected(bundle, carried, postings, next(iter(right.column("doc_ids").to_pylist()), []))
    return step


def _leaders(top: int):
    """The highest scores of each item over a task's bundles."""
    def step(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            rows = _unpacked(pa.Table.from_batches([batch]), _CARRIED)
            items, scores = np.concatenate([held[0], *(r[0] for r in rows)]), np.concatenate([held[1], *(r[2] for r in rows)])
            order = np.lexsort((-scores, items))
            items, scores = items[order], scores[order]
            take = np.arange(len(items)) - np.searchsorted(items, items) < top
            held = items[take], scores[take]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1], pa.int64())], names=["item", "score"])
    return step


def _reached(bundles: DataFrame, n_items: int, top: int) -> np.ndarray:
    """The score that ``top`` documents of the whole table have reached, by item (0 if there are fewer)."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    last = (bundles.mapInArrow(_leaders(top), "item int, score long")
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
            .groupBy("item").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == top).toArrow())
    best = np.zeros(n_items, np.int64)
    best[last.column("item").to_numpy()] = last.column("score").to_numpy()
    return best


def _still_open(weighted: Broadcast, best: Broadcast, stage: int):
    """Accumulators that can still reach an item's best, before they travel to the next owner."""
    def step(batches):
        for batch in thin(batches, 16):
            out = []
            for items, slots, scores in _unpacked(pa.Table.from_batches([batch]), _CARRIED):
                at = scores + weighted.value.rest[stage][items] >= best.value[items]
                out.append((items[at].tobytes(), slots[at].tobytes(), scores[at].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out))], names=batch.schema.names)
    return step


def _round(docs: DataFrame, pairs: DataFrame, folder: str, top: int) -> DataFrame:
    """One round of items: ``row`` of the item, ``doc_id``, ``score``; at most ``top`` documents of each block."""
    spark = docs.sparkSession
    asked, rows = _asked(pairs)
    empty = spark.createDataFrame([], "row long, doc_id long, score long")
    share = spark.sparkContext.broadcast
    asked_shared = share(asked)
    seen = settle(numbered_input(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
                  .mapInArrow(_count(asked_shared), "row long, doc_id long, n long, ids binary, times binary"))
    documents, words = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not asked.terms:
        return empty
    sums = (seen.select("ids", "times").mapInArrow(_tally(len(asked.terms)), "term long, df long, most long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).toArrow())
    df, most = np.zeros(len(asked.terms), np.int64), np.zeros(len(asked.terms), np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    most[sums.column("term").to_numpy()] = sums.column("most").to_numpy()
    if not df.any():
        return empty
    weighted_shared = share(weigh(asked, df, most, documents, words))
    seen.mapInArrow(_deal(asked_shared, weighted_shared), _POSTINGS_DDL).write.partitionBy("owner").parquet(folder)
    postings = spark.read.schema(_POSTINGS_DDL).parquet(folder)
    bundles = (postings.where("owner = 0").select("bundle", "block", *_POSTED)
               .mapInArrow(_first_owner(asked_shared, weighted_shared, top), _BUNDLES))
    for stage in range(1, OWNERS):
        bundles = settle(bundles)
        best_shared = share(_reached(bundles, asked.n_items, top))
        travelling = bundles.mapInArrow(_still_open(weighted_shared, best_shared, stage - 1), _BUNDLES)
        owned = postings.where(F.col("owner") == stage).select("bundle", "block", *_POSTED, "doc_ids")
        last = stage == OWNERS - 1
        bundles = (travelling.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block"))
                   .applyInArrow(_next_owner(asked_shared, weighted_shared, best_shared, stage, top), _FOUND if last else _BUNDLES))
    numbers = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(rows)), pa.int32()), "row": pa.array(rows, pa.int64())}))
    return bundles.join(numbers, "item").select("row", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """op11: the ``top`` documents of each item by score: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    asked = settle(numbered_input(items.select("item_id", "text").dropDuplicates(), "row"))
    pairs = settle(asked.select("row", "text").mapInArrow(_item_terms, "row long, term binary, times long"))
    rounds = max(1, -(-pairs.count() // ROUND_PAIRS))
    folder = f"{checkpoint_folder(spark)}/ranking-{uuid.uuid4().hex}"
    found = None
    for r in range(rounds):
        part = _round(docs, pairs.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r), f"{folder}/{r}", top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
