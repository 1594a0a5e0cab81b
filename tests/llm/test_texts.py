"""The text operators against plain versions on a fixture with odd rows."""

import base64
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

import plain
from sceneframe.llm import extraction, language, leakage, likelihood, overlap, privacy, quality, secrets, templates, tokens
from sceneframe.llm.queries import PATTERN, RANKS

ROWS = plain.documents()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, plain.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def by_row(found, docs_rows, key=0):
    """Result rows grouped by id."""
    out = {}
    for r in found:
        out.setdefault(r[key], []).append(tuple(r)[1:])
    return {k: sorted(v, key=str) for k, v in out.items()}


def expected(per_pair):
    out = {}
    for pair in PAIRS:
        out.setdefault(pair[0], []).append(tuple(per_pair(pair)))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 7 and 1, 0) for i in range(90)] + [(3006, 0, 0), (None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality.judge(docs, labels).collect()
    assert by_row([tuple(r)[:7] for r in found], ROWS) == expected(lambda p: plain.quality_counts(p[1]))
    assert all(not r.kept for r in found if r.base_failed)
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("rule > 0").count() == 0


def test_quality_rules_are_found(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = plain.prose(rng, "en", 4, 16)
        bad = i % 4 == 0
        rows.append((i, " | ".join(text.split()) if bad else text))
        labels.append((i, 0 if bad else 1))
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"),
                          spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    wrong = [r.doc_id for r in found if r.kept != (r.doc_id % 4 != 0)]
    assert len(wrong) <= 6


def test_likelihood(docs, empty):
    found = likelihood.likelihood(docs).collect()
    scores = plain.base_scores(PAIRS)
    assert len(found) == len(ROWS)
    by_id = {}
    for i, t in PAIRS:
        by_id.setdefault(i, []).append(scores[i, t])
    for r in found:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == s[:3] and abs(r.base_score - s[3]) < 1e-6 * max(1, abs(s[3])) for s in by_id[r.doc_id])
        assert r.held_out == (plain.remainder(r.doc_id, 10) == 0) and r.score < 0
    assert likelihood.likelihood(empty).count() == 0


def test_likelihood_sums_to_one_and_learns():
    """Gradients lower the loss, all probabilities of a state sum to one, and windows don't matter."""
    import numpy as np
    rng = np.random.default_rng(3)
    ids = np.tile(np.array([1, 2, 3, 4, 5, 6, 7, 8]), 400)
    starts, sizes = np.arange(0, 3200, 40), np.full(80, 40)
    w = likelihood.first_weights(np.full(likelihood.WORDS, 5.0), 50.0)
    before = likelihood.score_documents(w, ids, starts, sizes).sum()
    trained = likelihood.train(w, ids, starts, sizes)
    after = likelihood.score_documents(trained, ids, starts, sizes).sum()
    assert after > 0.8 * before and after > before
    h = rng.normal(size=(1, likelihood.WIDTH)).astype(np.float32)
    every = np.arange(likelihood.WORDS + 1)
    logs, _ = likelihood.output_loss(trained, np.repeat(h, len(every), axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-3
    # one document alone, or after others in the lanes, has one score
    alone = likelihood.score_documents(trained, ids, starts[3:4], sizes[3:4])[0]
    assert abs(alone - likelihood.score_documents(trained, ids, starts, sizes)[3]) < 1e-2


def test_a_score_does_not_depend_on_the_documents_beside():
    import numpy as np
    random = np.random.default_rng(1)
    sizes = random.integers(1, 80, 600)             # more documents than lanes, so that lanes hold several
    ids = random.integers(0, likelihood.WORDS + 1, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    w = likelihood.train(likelihood.first_weights(random.integers(1, 1000, likelihood.WORDS), 50.0), ids, starts, sizes)
    together = likelihood.score_documents(w, ids, starts, sizes)
    for d in range(0, 600, 7):
        alone = likelihood.score_documents(w, ids[starts[d]:starts[d] + sizes[d]], np.zeros(1, int), sizes[d:d + 1])[0]
        assert abs(alone - together[d]) < 1e-4


def test_find_looks_few_tokens_up_by_binary_search(monkeypatch):
    """Places are those of a search of each token, whether hashes are spread evenly or share their leading bits."""
    import numpy as np
    random = np.random.default_rng(5)
    even = np.unique(random.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    close = np.unique(np.r_[np.arange(1 << 40, (1 << 40) + 500, dtype=np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)])
    for hashes, share in ((even, 100), (close, 1), (even[:1], 1)):
        tokens = random.permutation(np.r_[random.choice(hashes, 30_000), hashes, hashes + np.uint64(1), random.integers(0, 1 << 64, 5_000, dtype=np.uint64)])
        place = {h: i for i, h in enumerate(hashes.tolist())}
        v = likelihood.Vocabulary(hashes, np.arange(len(hashes)), np.ones(len(hashes), np.int64), 1, 1, 1)
        searched, plainly = [], np.searchsorted
        monkeypatch.setattr(np, "searchsorted", lambda a, wanted, *more, **named: searched.append(np.size(wanted)) or plainly(a, wanted, *more, **named))
        found = v.find(tokens)
        monkeypatch.undo()
        assert found.tolist() == [place.get(t, -1) for t in tokens.tolist()]
        assert sum(searched) <= len(tokens) // share
        assert v.find(tokens[:3]).tolist() == found[:3].tolist() and not len(v.find(tokens[:0]))


def test_gradients_match_differences():
    import numpy as np
    ids = np.array([1, 5, 0, 50, 2, 1, 5, 0])
    w = likelihood.first_weights(np.full(likelihood.WORDS, 5.0), 50.0)
    w = likelihood.Weights(*(p.astype(np.float64) for p in w))
    h = np.random.default_rng(1).normal(size=(8, likelihood.WIDTH))
    grads = likelihood.Weights(*(np.zeros_like(p) for p in w))
    logs, back = likelihood.output_loss(w, h, ids, grads)
    e = 1e-5
    for place in ((0, 3), (4, 7)):
        moved = h.copy()
        moved[place] += e
        assert abs((likelihood.output_loss(w, moved, ids)[0].sum() - logs.sum()) / e + back[place]) < 1e-3


def test_jaccard_groups(docs, empty):
    expect = plain.components(PAIRS)
    assert by_row(overlap.jaccard_groups(docs).collect(), ROWS) == expected(lambda p: expect[p])
    assert overlap.jaccard_groups(empty).count() == 0


def test_trie_walk_equals_sets():
    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(30):
        probe = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        sets = [np.unique(np.r_[rng.choice(probe, int(rng.integers(1, len(probe) + 1)), replace=False), rng.integers(0, 60, 3)]).astype(np.uint64) for _ in range(25)]
        expect = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))]
        assert sorted(overlap.trie_links(probe, sets, 60)) == expect


def test_crowded_grams_and_chains(spark, monkeypatch):
    """Blocks of two rows, tries of two candidates, and a chain of copies that only link to their neighbours."""
    monkeypatch.setattr(overlap, "BLOCK", 2)
    monkeypatch.setattr(overlap, "TRIE", 2)
    monkeypatch.setattr(overlap, "CROWD", 3)
    rng = random.Random(2)
    base = plain.sentence(rng, "en", 60).split()
    rows = []
    for k in range(12):
        rows.append((50 - k, " ".join(base)))
        base = [*base[:-1]] if k % 2 else [*base, f"new{k}"]
        base[5 * (k % 10)] = f"edit{k}"
    rows += [(100 + k, plain.sentence(rng, "en", 30)) for k in range(10)]
    expect = plain.components(rows)
    found = {r[0]: tuple(r)[1:] for r in overlap.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: expect[i, t] for i, t in rows}


def test_near_copies_in_rounds(spark, monkeypatch):
    """What a round may shuffle is bounded by the bytes of the sets: the rest goes in further rounds, with the same groups."""
    import os
    rng = random.Random(5)
    rows = [(k, plain.sentence(rng, "en", 40)) for k in range(15)]
    rows += [(100 + k, t.replace(" ", " more ", 1)) for k, t in rows] + [(200 + k, t) for k, t in rows[:3]]
    docs, expect = spark.createDataFrame(rows, "doc_id long, text string"), plain.components(rows)
    rounds, count = [], overlap.rounds_of
    monkeypatch.setattr(overlap, "rounds_of", lambda *a: rounds.append(count(*a)) or rounds[-1])
    monkeypatch.setattr(overlap, "ROUND_BYTES", 1000)
    found = {r[0]: tuple(r)[1:] for r in overlap.jaccard_groups(docs).collect()}
    assert found == {i: expect[i, t] for i, t in rows}
    assert max(rounds) > 1
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("near-")]


def test_ranges_of_grams_part_all_hashes(spark):
    from pyspark.sql import functions as F
    ends = [-(1 << 63), -(1 << 62) - 1, -1, 0, 1, 1 << 62, (1 << 63) - 1]
    grams = spark.createDataFrame([(g,) for g in ends], "gram long")
    for cuts in ([], [0], [5, -(1 << 62), 5], ends):
        hits = grams.select("gram", sum([F.when(r, 1).otherwise(0) for r in overlap.gram_ranges(cuts)], F.lit(0)).alias("n")).collect()
        assert [r["n"] for r in hits] == [1] * len(ends)
    assert overlap.rounds_of(0, 0) == 1 and overlap.rounds_of(10 * overlap.ROUND_BYTES, 0) == 10
    assert overlap.rounds_of(10 * overlap.ROUND_BYTES, 5 * overlap.ROUND_BYTES) == 2


def test_rows_under_a_gram_are_counted_where_they_are_chosen():
    """Groups parted by batches; only rows that stay count."""
    import pyarrow as pa
    rows = [(1, b"a", 10, 0), (1, b"b", 10, 1), (1, b"c", 90, 2), (2, b"a", 10, 1), (3, b"a", 10, 2), (3, b"b", 11, 0), (3, b"c", 12, 0)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["gram", "key", "size", "at"])
    found = [r for b in overlap._near_sizes(80)(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert [(r["gram"], r["key"], r["n"]) for r in found] == [(1, b"a", 2), (1, b"b", 2), (3, b"a", 3), (3, b"b", 3), (3, b"c", 3)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, tiktoken_encoding):
    def expect(pair):
        ids = tiktoken_encoding.encode_ordinary(pair[1] or "")
        return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), plain.sha(pair[1] or ""))
    assert by_row(tokens.round_trip(docs, RANKS, PATTERN).collect(), ROWS) == expected(expect)
    assert tokens.round_trip(empty, RANKS, PATTERN).count() == 0
    coded = tokens.encode(docs.where("doc_id < 5"), RANKS, PATTERN)
    texts = dict(PAIRS)
    assert {r[0]: bytes(r[1]).decode() for r in tokens.decode(coded, RANKS, PATTERN).collect()} == {i: texts[i] for i in range(5)}


def test_bpe_texts(tiktoken_encoding):
    bpe = tokens.Bpe(open(RANKS, "rb").read(), PATTERN)
    odd = ["", " ", "  a", "a  b", "a \n b", "a\n", "\n\na", "don't  we'll\tx", "a b", "x\0y z", "a" * 3000, " " * 700 + "b", "ab" * 700 + "1",
           "é" * 400, "  x", "1234567 89", "<|endoftext|>", "\U0001f600‍\U0001f468 ok"]
    rng = random.Random(4)
    odd += ["".join(rng.choice("ab .,'\n\t1é中") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for text, packed in zip(odd, bpe.encode(odd)):
        ids = tiktoken_encoding.encode_ordinary(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids), text
        assert bpe.decode(packed) == text.encode()


def test_line_templates(docs, empty):
    expect = plain.line_templates(PAIRS)
    found = templates.drop_recurring(docs.withColumn("line", F.lit(1)).withColumn("template", F.lit(2)))
    assert found.columns == [*docs.columns, "line", "template", "_n_lines", "_n_dropped"]
    assert by_row(found.select("doc_id", "_n_lines", "_n_dropped", "text").collect(), ROWS) == expected(lambda p: expect[p])
    assert sum(x[1] for x in expect.values()) > 30                   # the variable lines and the fixed ones
    assert templates.drop_recurring(empty).count() == 0


def test_language(docs, empty):
    found = language.identify(docs).collect()
    assert len(found) == len(ROWS)
    langs = {i: lang for i, _, lang, *_ in ROWS if i is not None and i < 90}
    right = [r.lang_pred == langs[r.doc_id] for r in found if r.doc_id in langs]
    assert sum(right) > 0.95 * len(right)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (plain.remainder(r.doc_id, 4) == 2)
        if r.doc_id in (3000, 3001, 3002, 3003):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred != "und"
    assert language.identify(empty).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(90))


def test_decontamination(spark, docs, empty):
    texts = dict(PAIRS)
    some = texts[4].replace("\n", " - ").split()
    items = [(1, " ".join(some[5:25]).upper()), (2, "never seen words of some length that occur in no text at all"), (3, None), (4, ""),
             (5, "one two"), (6, " ".join(texts[9].split()[2:12])), (None, " ".join(texts[10].split()[:11])), (7, "one two"), (8, "a b c d e f g h"), (5, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expect = plain.contamination(PAIRS, items)
    found = leakage.contamination(docs, bench).collect()
    assert by_row(found, ROWS) == expected(lambda p: expect[p])
    assert sum(x[4] for x in expect.values()) >= 5
    assert leakage.contamination(empty, bench).count() == 0
    assert leakage.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = leakage.drop_contaminated(docs.withColumn("th", F.lit(1)), bench)
    assert clean.columns == [*docs.columns, "th"]
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(i) for i, t in PAIRS if not expect[i, t][4])
