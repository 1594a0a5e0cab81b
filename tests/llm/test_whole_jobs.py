"""Operators that must take in all of their rows: small cases that a partial job gets wrong."""

import random

import corpus_pipeline
import plain
from sceneframe.llm import language, leakage, likelihood, templates
from sceneframe.llm.hashing import word_hashes


def test_near_copies_of_the_pipeline(spark):
    """Two texts of 50 words, one word apart: 41/51 of the runs of five words, but only 43/51 (less than 0.85) of those of four."""
    base = [f"word{k}" for k in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:20], "other", *base[21:]])), (3, plain.sentence(random.Random(1), "en", 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_copies(spark, docs, "").collect()) == [1, 3]


def test_stages_send_batches_of_bounded_bytes(spark):
    """30 MB of texts under 10,000 rows reach Python in parts once a stage has been planned; a bound of the session's own stays."""
    import pyarrow as pa
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 10000) as text", "'en' as lang", "'s' as source")
    try:
        corpus_pipeline.encoded(spark, docs, "")
        found = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 5 << 20
        spark.conf.set(bound, "9m")
        corpus_pipeline.encoded(spark, docs, "")
        assert spark.conf.get(bound) == "9m"
    finally:
        spark.conf.unset(bound)


def test_all_training_documents_reach_the_model(spark):
    """Every document has a word of its own; input weights move only for words that were trained on."""
    import numpy as np
    docs = spark.createDataFrame([(i, f"own{i} own{i} own{i} end") for i in range(60)], "doc_id long, text string").repartition(3)
    v = likelihood.vocabulary(likelihood.count_tokens(docs).cache())
    top = np.zeros(likelihood.WORDS)
    top[v.ranks] = v.counts
    moved = np.abs(likelihood.fit(docs, v).inputs - likelihood.first_weights(top, v.tokens - v.known).inputs).max(axis=1) > 0
    own, _, _ = likelihood.token_runs([f"own{i}" for i in range(60)])
    assert moved[v.ids(v.find(own[::2]))].all()


def test_lengths_that_the_sample_lacks_are_rejected_too(spark):
    """All training texts are of one length; a shorter and a longer one in another script are none of the languages."""
    rng = random.Random(4)
    rows = [(i, plain.sentence(rng, lang := ["en", "de"][i % 2], 30), lang) for i in range(120)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "слова на другом языке"), (2, "слова другого языка всегда стоят здесь " * 400), (3, rows[0][1])]
    found = {r.doc_id: r.rejected for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert found == {1: True, 2: True, 3: False}


def test_floors_come_from_all_training_texts(spark):
    """A sample of a few texts per language has no length class with enough rows, all texts together have."""
    rng = random.Random(6)
    rows = [(i, plain.sentence(rng, lang := ["en", "de"][i % 2], 30), lang) for i in range(120)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), training_rows=8)
    assert (model.floors > 0).all()


def dropped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r._n_dropped for r in templates.drop_recurring(docs).collect()}


def test_constants_are_compared_by_whole_hashes(spark):
    """A word that shares the first 16 bits of a constant's hash is another word: its line has six constants of ten."""
    tries = [b"line", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}".encode() for k in range(26 ** 4))]
    hashes = word_hashes([b" ".join(tries)])[4]
    twin = tries[1 + int((hashes[1:] >> 48 == hashes[0] >> 48).argmax())].decode()
    assert hashes[1 + tries[1:].index(twin.encode())] >> 48 == hashes[0] >> 48
    letters = "abcdefghijklmnop"
    rows = [(k, f"all the words of this log line {c}x {c}y {c}z") for k, c in enumerate(letters)]
    found = dropped(spark, [*rows, (99, f"all the words of this log {twin} q r s")])
    assert found == {0: 0, **{k: 1 for k in range(1, len(letters))}, 99: 0}


def test_templates_count_documents_not_lines(spark):
    """Ten alike lines of one document are no template; with the line of nine more documents they are."""
    towns = ["Rome", "Paris", "Oslo", "Bern", "Cairo", "Lima", "Quito", "Riga", "Minsk", "Sofia"]
    line = "The capital city of {} is a very nice town".format
    alone = [(1, "\n".join(map(line, towns))), (2, line("Accra"))]
    assert dropped(spark, alone) == {1: 0, 2: 0}
    assert dropped(spark, [*alone, *((3 + k, line(f"Town{'abcdefgh'[k]}")) for k in range(8))]) == {1: 9, **{k: 1 for k in range(2, 11)}}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """Five texts under one id, one of them twice (with other columns), and columns named like working columns."""
    rng = random.Random(9)
    texts = [plain.sentence(rng, "en", 40) for _ in range(6)]
    rows = [(7, t, k, "a") for k, t in enumerate(texts[:5])] + [(7, texts[0], -1, "b"), (3, texts[5], 0, "c"), (9, texts[5], 0, "d"), (None, texts[5], 0, "e"), (None, texts[5], 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, key string").repartition(4)
    docs = docs.selectExpr("*", "1 AS _kid", "2 AS _th", "3 AS id", "4 AS row", "5 AS kid", "6 AS th", "7 AS n")
    found = sorted((r.doc_id or -1, r.text, r._id) for r in corpus_pipeline.without_copies(spark, docs, "").collect())
    assert [f[:2] for f in found] == sorted([(7, t) for t in texts[:5]] + [(3, texts[5]), (-1, texts[5]), (-1, texts[5])])
    assert docs.columns == corpus_pipeline.without_copies(spark, docs, "").columns
    item = spark.createDataFrame([(1, " ".join(texts[1].split()[:12]))], "item_id long, text string")
    clean = leakage.drop_contaminated(docs, item)
    assert clean.columns == docs.columns and sorted(r.text for r in clean.collect()) == sorted(r[1] for r in rows if r[1] != texts[1])


def test_languages_of_rows_that_share_an_id(spark):
    """A language whose texts all have one id is learnt like any other; equal texts enter the sample once."""
    rng = random.Random(10)
    rows = [(5 if lang == "de" else k, plain.sentence(rng, lang, 30), lang) for k in range(300) for lang in ("en", "de")]
    rows += [(5, rows[1][1], "de")] * 300
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), training_rows=100)
    assert set(model.langs) == {"en", "de"}


def test_other_patterns_split_whole_texts():
    """Patterns whose matches reach over spaces, and white space that only looks lone by its count."""
    import base64

    import tiktoken
    from sceneframe.llm import tokens
    from sceneframe.llm.queries import PATTERN, RANKS
    lines = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    odd = ["the end of it", "a b\nc", "", "a\xa0b\xa0c   d", "x  y\x0bz w", "\x1c a  b"]
    for pattern in (r"(?s)..?", r"(?s).+", PATTERN):
        known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        ours = tokens.Bpe(lines, pattern)
        assert [list(int.from_bytes(p[k:k + 4], "little") for k in range(0, len(p), 4)) for p in ours.encode(odd)] == [known.encode_ordinary(t) for t in odd]
