"""Log-likelihood of texts under a gated recurrent language model.

Tokens are the words of a text in lower case (A-Z only) and one end.  Words are handled by 64-bit
hashes.  Their counts in the training documents are exact and cover all of them.  The model's vocabulary
holds the most frequent tokens, in classes of equal size by rank; all other tokens are one class
of their own, inside which a token's probability comes from its count:

    P(token | past) = P(class | state) * P(token | class, state),

with a gated recurrent unit for the state.  Training is truncated backpropagation in numpy, one pass over all training documents: the
rounds part them by a hash of the id; in a round tasks train side by side, from the same parameters, and the
mean of their results begins the next round.  Scoring carries the state from window to window, so a document is scored
as a whole, whatever its length.

A null text is only an end.  Repeated rows get equal scores.  Without training documents all counts are 0
and the model is the untrained one.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.common import remainder, settle, text_or_empty
from sceneframe.llm.hashing import chunks_of, word_hashes

#: tokens with weights of their own, in so many classes; one more class holds the rest
WORDS, CLASSES = 2024, 44
SIZE = WORDS // CLASSES
#: width of the state
WIDTH = 16
#: tokens whose counts every task holds (16 bytes each); others are looked up by a join
HELD = 1 << 20
#: training rounds; each has its own part of the training documents, together they have all
ROUNDS = 2
#: lanes and steps of a training window, and of a scoring window
LANES, STEPS = 64, 24
SCORE_LANES, SCORE_STEPS = 256, 64
#: tokens a task counts at once, and characters of the documents it trains on or scores side by side
_BLOCK, _TEXT = 1 << 21, 1 << 23
#: hashes compared one after the other before a binary search
_STEPS = 6
RATE = 0.15
END = np.uint64(0x0123456789ABCDEF)
_NO_ID = -(1 << 63)


class Weights(NamedTuple):
    """Input rows (one per token id, ids from 1, 0 is the rest), recurrence, class and word outputs."""
    inputs: np.ndarray      # (WORDS + 1, 3 * WIDTH)
    state: np.ndarray       # (WIDTH, 3 * WIDTH)
    classes: np.ndarray     # (CLASSES + 1, WIDTH + 1), class CLASSES is the rest
    words: np.ndarray       # (CLASSES, SIZE, WIDTH + 1)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self]).astype(np.float32)


def unflatten(flat: np.ndarray) -> Weights:
    out, at = [], 0
    for shape in ((WORDS + 1, 3 * WIDTH), (WIDTH, 3 * WIDTH), (CLASSES + 1, WIDTH + 1), (CLASSES, SIZE, WIDTH + 1)):
        n = math.prod(shape)
        out.append(np.array(flat[at:at + n], np.float32).reshape(shape))
        at += n
    return Weights(*out)


def first_weights(counts: np.ndarray, rest: float) -> Weights:
    """Small random weights; output offsets are the log shares of the tokens (WORDS counts by rank, and all others')."""
    random = np.random.default_rng(7)
    draw = lambda *shape: random.normal(0, 0.15, shape).astype(np.float32)
    padded = np.zeros(WORDS)
    padded[:len(counts)] = counts
    by_class = padded.reshape(CLASSES, SIZE)
    w = Weights(draw(WORDS + 1, 3 * WIDTH), draw(WIDTH, 3 * WIDTH), draw(CLASSES + 1, WIDTH + 1), draw(CLASSES, SIZE, WIDTH + 1))
    w.classes[:, -1] = np.log(np.r_[by_class.sum(axis=1), rest] + 0.5)
    w.classes[:, -1] -= w.classes[:, -1].max()
    w.words[:, :, -1] = np.log(by_class + 0.5)
    w.words[:, :, -1] -= w.words[:, :, -1].max(axis=1, keepdims=True)
    return w


def gru_step(given: np.ndarray, h: np.ndarray, back_state: np.ndarray):
    """New state from input columns and old state; also the gates for backpropagation.

    One column per lane: a gate's rows are contiguous, so that each operation is one sweep over memory.
    """
    u = back_state @ h
    gates = given[:2 * WIDTH] + u[:2 * WIDTH]
    gates *= 0.5
    np.tanh(gates, out=gates)                   # the logistic function by way of tanh
    gates *= 0.5
    gates += 0.5
    z, r = gates[:WIDTH], gates[WIDTH:]
    n = r * u[2 * WIDTH:]
    n += given[2 * WIDTH:]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, u[2 * WIDTH:]


def _tame(weights: np.ndarray) -> bool:
    """Whether no state (its values are within 1) can take the outputs where exp leaves the range of its type."""
    return float((np.abs(weights) @ np.ones(weights.shape[-1], weights.dtype)).max()) <= 80


def _small(numbers: np.ndarray) -> np.ndarray:
    """Token ids or classes, if they fit, in a type that a stable sort takes by its digits."""
    return numbers.astype(np.uint16) if WORDS < 1 << 16 else numbers


def _softmax(x: np.ndarray, pick: np.ndarray, tame: bool):
    """Log softmax of one column of each row, and its loss gradient, which overwrites x."""
    at = np.arange(0, x.size, x.shape[1]) + pick
    flat = x.reshape(-1)
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    own = flat[at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x /= total[:, None]
    flat[at] -= 1
    return own - np.log(total), x


def _picked(x: np.ndarray, pick: np.ndarray, tame: bool) -> np.ndarray:
    """Log softmax of one column of each row; overwrites x."""
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    own = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + pick]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def output_loss(w: Weights, h: np.ndarray, target: np.ndarray, grads: Weights | None = None):
    """Natural log probability of each target id given its state; with ``grads``, adds gradients and gives those of h."""
    kind = np.where(target > 0, (target - 1) // SIZE, CLASSES)
    wide = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)
    back = None
    if grads is None:
        total = _picked(wide @ w.classes.T, kind, _tame(w.classes)).astype(np.float64)
    else:
        own, d = _softmax(wide @ w.classes.T, kind, _tame(w.classes))
        total = own.astype(np.float64)
        grads.classes[...] += d.T @ wide
        back = d @ w.classes[:, :-1]
    order = np.argsort(_small(kind), kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES + 1)[:CLASSES])].tolist()
    runs = [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]
    order = order[:bounds[-1]]
    pick = (target[order] - 1) % SIZE
    own = wide.take(order, axis=0)
    x = np.empty((len(order), SIZE), np.result_type(wide, w.words))
    for c, run in runs:
        np.matmul(own[run], w.words[c].T, out=x[run])
    if not len(order):
        pass
    elif grads is None:
        total[order] += _picked(x, pick, _tame(w.words))
    else:
        logs, d = _softmax(x, pick, _tame(w.words))
        total[order] += logs
        lower = np.empty((len(order), WIDTH), back.dtype)
        for c, run in runs:
            grads.words[c] += d[run].T @ own[run]
            np.matmul(d[run], w.words[c][:, :-1], out=lower[run])
        back[order] += lower
    return total, back


def lanes_of(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Deal documents (by number of tokens) to lanes of about equal length, longest first.

    No more lanes than it takes for all to be as long as the longest document: others would wait for it.
    """
    useful = -(-5 * int(sizes.sum()) // (4 * int(sizes.max()))) if len(sizes) else 1
    heap = [(0, k) for k in range(min(lanes, max(1, min(useful, len(sizes)))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        held, k = heap[0]
        out[k].append(d)
        heapq.heapreplace(heap, (held + int(sizes[d]), k))
    return out


def lane_arrays(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: int):
    """``(target, given, fresh, doc)`` arrays of shape (steps, lanes): -1 where a lane has ended."""
    dealt = lanes_of(sizes, lanes)
    steps = max((int(sizes[d].sum()) for d in dealt if d), default=0)
    target = np.full((steps, len(dealt)), -1, np.int32)
    doc = np.zeros((steps, len(dealt)), np.int32)
    fresh = np.zeros((steps, len(dealt)), bool)
    for k, docs in enumerate(dealt):
        if docs:
            n = sizes[docs]
            line = np.concatenate([ids[starts[d]:starts[d] + sizes[d]] for d in docs])
            target[:len(line), k] = line
            doc[:len(line), k] = np.repeat(docs, n)
            fresh[np.r_[0, np.cumsum(n)[:-1]], k] = True
    given = np.zeros_like(target)
    given[1:] = np.maximum(target[:-1], 0)
    return target, given, fresh, doc


def score_documents(w: Weights, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's ids; at a document's start the state is zero and nothing is given."""
    out = np.zeros(len(sizes))
    target, given, fresh, doc = lane_arrays(ids, starts, sizes, SCORE_LANES)
    ending = (target >= 0).sum(axis=0)
    order = np.argsort(-ending, kind="stable")             # so that the lanes still running come first
    target, given, fresh, doc, ending = target[:, order], given[:, order], fresh[:, order], doc[:, order], ending[order]
    h = np.zeros((WIDTH, target.shape[1]), np.float32)
    back_state = np.ascontiguousarray(w.state.T)
    for begin in range(0, len(target), SCORE_STEPS):
        states, wanted, owners = [], [], []
        for t in range(begin, min(len(target), begin + SCORE_STEPS)):
            live = int(np.searchsorted(-ending, -t, side="left"))
            h = h[:, :live]
            new = fresh[t, :live]
            x = w.inputs.take(given[t, :live], axis=0)
            if new.any():
                h = np.where(new, np.float32(0), h)
                x[new] = 0
            h = gru_step(np.ascontiguousarray(x.T), h, back_state)[0]
            states.append(h.T)
            wanted.append(target[t, :live])
            owners.append(doc[t, :live])
        logs, _ = output_loss(w, np.concatenate(states), np.concatenate(wanted))
        out += np.bincount(np.concatenate(owners), weights=logs, minlength=len(out))
    return out


def train(w: Weights, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Weights:
    """One pass of truncated backpropagation with Adagrad; the state is carried from window to window."""
    w = Weights(*(p.copy() for p in w))
    squares = Weights(*(np.full(p.shape, 0.1, np.float32) for p in w))
    target, given, fresh, _ = lane_arrays(ids, starts, sizes, LANES)
    begins = fresh.any(axis=1).tolist()
    lanes = target.shape[1]
    h = np.zeros((WIDTH, lanes), np.float32)

    def adapt(p, g, s):
        """Adagrad: the new squares and the step of a scaled gradient."""
        g *= scale
        np.clip(g, -1, 1, out=g)
        s = s + g * g
        g *= np.float32(RATE)
        g /= np.sqrt(s)
        return p - g, s

    for begin in range(0, len(target), STEPS):
        some = slice(begin, min(len(target), begin + STEPS))
        n_steps = some.stop - begin
        x = w.inputs.take(given[some], axis=0)
        x[fresh[some]] = 0
        x = np.ascontiguousarray(x.transpose(0, 2, 1))
        back_state = np.ascontiguousarray(w.state.T)
        before, z, r, n, u, after = (np.empty((n_steps, WIDTH, lanes), np.float32) for _ in range(6))
        for k in range(n_steps):
            if begins[begin + k]:
                h = np.where(fresh[begin + k], np.float32(0), h)
            before[k] = h
            h, z[k], r[k], n[k], u[k] = gru_step(x[k], h, back_state)
            after[k] = h
        live = target[some].ravel() >= 0
        flat = after.transpose(0, 2, 1).reshape(-1, WIDTH)
        grads = Weights(w.inputs, w.state, np.zeros_like(w.classes), np.zeros_like(w.words))       # of the outputs only
        _, back = output_loss(w, flat[live], target[some].ravel()[live], grads)
        upper = np.zeros_like(flat)
        upper[live] = back
        upper = np.ascontiguousarray(upper.reshape(n_steps, lanes, WIDTH).transpose(0, 2, 1))
        # what a gradient of the state is multiplied with on its way to the gates, for all steps at once
        by_n = (1 - z) * (1 - n * n)
        factors = np.stack([(before - n) * z * (1 - z), by_n * u * r * (1 - r), by_n * r], axis=1)
        throughs = np.empty((n_steps, 3 * WIDTH, lanes), np.float32)
        carry = np.zeros_like(h)
        for k in range(n_steps - 1, -1, -1):
            d = upper[k]
            d += carry
            np.multiply(d, factors[k], out=throughs[k].reshape(3, WIDTH, lanes))
            carry = w.state @ throughs[k]
            carry += d * z[k]
            if begins[begin + k]:
                carry[:, fresh[begin + k]] = 0
        gates = throughs.transpose(0, 2, 1).reshape(-1, 3 * WIDTH)
        scale = np.float32(32 / max(1, int(live.sum())))
        of_state = before.transpose(1, 0, 2).reshape(WIDTH, -1) @ gates
        gates[:, 2 * WIDTH:] = (upper * by_n).transpose(0, 2, 1).reshape(-1, WIDTH)
        w.state[...], squares.state[...] = adapt(w.state, of_state, squares.state)
        old = np.flatnonzero(~fresh[some].ravel())
        used = given[some].ravel()[old]
        order = np.argsort(_small(used), kind="stable")
        if len(order):
            # tokens that weren't given have no gradient: their rows stay
            used = used[order]
            starts_of = np.flatnonzero(np.r_[True, used[1:] != used[:-1]])
            token = used[starts_of]
            sums = np.add.reduceat(gates.take(old[order], axis=0), starts_of, axis=0)
            w.inputs[token], squares.inputs[token] = adapt(w.inputs[token], sums, squares.inputs[token])
        for p, g, s in ((w.classes, grads.classes, squares.classes), (w.words, grads.words, squares.words)):
            p[...], s[...] = adapt(p, g, s)
    return w


class Vocabulary(NamedTuple):
    """Held hashes in order, with rank (0: most frequent) and count; totals of the training tokens."""
    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    tokens: int             # N
    distinct: int           # V
    known: int              # tokens within the model's vocabulary

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place among the held hashes, -1 if not there.

        Many tokens go by a table of where the hashes with the same leading bits begin, which mostly leaves one to
        compare with; what a few steps from there don't settle, and few tokens, are found by binary search.
        """
        if not len(self.hashes):
            return np.full(len(tokens), -1)
        last = len(self.hashes) - 1
        if len(tokens) < len(self.hashes) // 8:
            at = np.minimum(np.searchsorted(self.hashes, tokens), last)
            return np.where(self.hashes[at] == tokens, at, -1)
        shift = np.uint64(64 - max(8, last.bit_length()))
        begins = np.zeros((1 << (64 - int(shift))) + 1, np.int64)
        np.cumsum(np.bincount((self.hashes >> shift).view(np.int64), minlength=len(begins) - 1), out=begins[1:])
        at = np.minimum(begins.take((tokens >> shift).view(np.int64)), last)
        met = self.hashes.take(at)
        out = np.where(met == tokens, at, -1)
        # a hash that is larger ends the search, as does the last one
        left = np.flatnonzero((met < tokens) & (at < last))
        for _ in range(_STEPS):
            if not len(left):
                return out
            wanted, at_left = tokens[left], at[left] + 1
            met = self.hashes.take(at_left)
            found = met == wanted
            out[left[found]] = at_left[found]
            at[left] = at_left
            left = left[(met < wanted) & (at_left < last)]
        at = np.minimum(np.searchsorted(self.hashes, tokens[left]), last)
        out[left] = np.where(self.hashes[at] == tokens[left], at, -1)
        return out

    def ids(self, place: np.ndarray) -> np.ndarray:
        """Model ids: 1 + rank for the most frequent tokens, 0 for the rest."""
        if not len(self.hashes):
            return np.zeros(len(place), np.int64)
        return np.where((place >= 0) & (self.ranks[place] < WORDS), self.ranks[place] + 1, 0)

    def model_part(self) -> Vocabulary:
        """Only the tokens with weights of their own."""
        own = self.ranks < WORDS
        return self._replace(hashes=self.hashes[own], ranks=self.ranks[own], counts=self.counts[own])


def token_runs(texts: list[str | None]):
    """``(hashes, starts, sizes)`` of the tokens of texts, each ended by END."""
    runs, sizes = [], []
    for part in chunks_of([t or "" for t in texts], 1 << 19):        # hashing takes some ten words of memory per byte
        some = texts[part]
        _, owner, _, _, words = word_hashes([(t or "").encode() for t in some], lower=True)
        size = np.bincount(owner, minlength=len(some)) + 1
        out = np.full(int(size.sum()), END, np.uint64)
        out[np.arange(len(words)) + owner] = words
        runs.append(out)
        sizes.append(size)
    sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
    return np.concatenate([*runs, np.zeros(0, np.uint64)]), np.cumsum(sizes) - sizes, sizes


def _blocks(batches, column: int):
    """(batch parts, token runs) with a bounded number of characters."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for part in chunks_of([t or "" for t in texts], _TEXT):
            yield batch.slice(part.start, part.stop - part.start), token_runs(texts[part])


def _count(batches):
    held, size = [], 0

    def flush():
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])
    for _, (tokens, _, _) in _blocks(batches, 0):
        held.append(tokens)
        size += len(tokens)
        if size > _BLOCK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(token, n)`` over all texts; partial counts are made in each task."""
    return docs.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, held: int = HELD) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the most frequent tokens, by a threshold on counts so that no sort of all is needed
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("k")).collect()
    floor, k = 1 << 30, 0
    for r in sorted(steps, key=lambda r: -r["g"]):
        if k + r["k"] > held:
            break
        floor, k = r["g"], k + r["k"]
    rows = counts.where(F.floor(F.log2("n") * 8) >= floor).toArrow()
    hashes = rows.column("token").to_numpy().view(np.uint64)
    n = rows.column("n").to_numpy()
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((hashes, -n))] = np.arange(len(n))
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], ranks[order], n[order].astype(np.int64), int(total["n"]), int(total["v"]), int(n[ranks < WORDS].sum()))


def _trainer(vocabulary, flat):
    def run(batches):
        v, w = vocabulary.value, unflatten(flat.value)
        seen = 0
        for _, (tokens, starts, sizes) in _blocks(batches, 0):
            w = train(w, v.ids(v.find(tokens)), starts, sizes)
            seen += len(tokens)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([w.flat()], pa.list_(pa.float32()))], names=["weight", "flat"])
    return run


def _mean(key, table):
    weight = table.column("weight").to_numpy()
    total = sum(x * np.asarray(row.values) for x, row in zip(weight, table.column("flat")))
    return pa.table({"weight": pa.array([float(weight.sum())]), "flat": pa.array([(total / weight.sum()).astype(np.float32)], pa.list_(pa.float32()))})


def fit(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Train on the given documents, on each in one of the rounds.  Each task's weights (half a megabyte) are averaged in groups, then on the driver."""
    sc = docs.sparkSession.sparkContext
    top = np.zeros(WORDS)
    own = v.ranks < WORDS
    top[v.ranks[own]] = v.counts[own]
    w = first_weights(top, v.tokens - v.known)
    shared = sc.broadcast(v.model_part())
    slot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds))
    for k in range(rounds):
        part = docs.where(slot == k).select("text")
        groups = max(1, math.isqrt(part.rdd.getNumPartitions()))
        results = (part.mapInArrow(_trainer(shared, sc.broadcast(w.flat())), "weight double, flat array<float>")
                   .withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
                   .groupBy("g").applyInArrow(_mean, "weight double, flat array<float>").collect())
        if results:
            weight = np.array([r["weight"] for r in results])
            w = unflatten(sum(x * np.array(r["flat"], np.float64) for x, r in zip(weight, results)) / weight.sum())
    return w


def _scorer(vocabulary, flat):
    """Rows (doc_id, kid, th, n_tokens, n_known, base, model, rare): rare are (token, count) pairs whose counts aren't held."""
    rare_type = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64())]))

    def run(batches):
        v, w = vocabulary.value, unflatten(flat.value)
        base = np.log10((v.counts + 0.1) / (v.tokens + 0.1 * (v.distinct + 1)))
        rest = v.tokens - v.known
        inside = np.log10((v.counts + 0.1) / (rest + 0.1 * (max(0, v.distinct - WORDS) + 1)))
        for batch, (tokens, starts, sizes) in _blocks(batches, 3):
            place = v.find(tokens)
            ids = v.ids(place)
            held = place >= 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = lambda which, values: np.bincount(owner[which], weights=values, minlength=len(sizes))
            model = score_documents(w, ids, starts, sizes) / math.log(10)
            if len(v.hashes):
                other = held & (ids == 0)
                model += sums(other, inside[place[other]])
                known = sums(held, base[place[held]])
            else:
                known = np.zeros(len(sizes))
            lost = np.flatnonzero(~held)
            order = lost[np.lexsort((tokens[lost], owner[lost]))]
            new = np.flatnonzero(np.r_[True, (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(order) else order
            times = np.diff(np.r_[new, len(order)])
            first = order[new]
            pairs = pa.StructArray.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(times, pa.int64())], ["token", "times"])
            offsets = np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(sizes)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(np.bincount(owner[held], minlength=len(sizes)), pa.int64()),
                 pa.array(known), pa.array(model), pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(rare_type)],
                names=["doc_id", "kid", "th", "n_tokens", "n_known", "base", "model", "rare"])
    return run


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, w: Weights) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` of every row (log10)."""
    sc = docs.sparkSession.sparkContext
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(text_or_empty()).alias("th"), "text")
    rows = settle(keyed.mapInArrow(_scorer(sc.broadcast(v), sc.broadcast(w.flat())),
                                   "doc_id long, kid long, th long, n_tokens long, n_known long, base double, model double, "
                                   "rare array<struct<token:bigint,times:bigint>>"))
    rare = rows.select("kid", "th", F.explode("rare").alias("x")).select("kid", "th", "x.token", "x.times").distinct()
    n = F.coalesce("n", F.lit(0))
    rest = float(v.tokens - v.known + 0.1 * (max(0, v.distinct - WORDS) + 1))
    sums = (rare.join(counts, "token", "left").groupBy("kid", "th").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(float(v.tokens + 0.1 * (v.distinct + 1))))).alias("more_base"),
        F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(rest))).alias("more_model")))
    zero = F.lit(0.0)
    return (rows.drop("rare").join(sums, ["kid", "th"], "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
                    (F.col("model") + F.coalesce("more_model", zero)).alias("score")))


def likelihood(docs: DataFrame) -> DataFrame:
    """op2: learn from the documents whose remainder by 10 isn't 0, score all."""
    training = docs.where(remainder("doc_id", 10) != 0).select("doc_id", "text")
    counts = settle(count_tokens(training))
    v = vocabulary(counts)
    w = fit(training, v)
    return (score(docs, counts, v, w)
            .select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                    F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
