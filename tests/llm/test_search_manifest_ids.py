"""Ranked search, Merkle manifest and id files against plain versions."""

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import plain
from sceneframe.llm import idfiles, manifest, ranking
from sceneframe.llm.queries import END_ID, TOKENIZER

ROWS = plain.documents()


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that are named like working columns."""
    frame = spark.createDataFrame(ROWS, plain.SCHEMA)
    return frame.withColumns({c: F.lit(1) for c in ("row", "tree", "pos", "n", "block", "item", "_tie", "_key", "_part", "term")}).repartition(5).cache()


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", plain.lower(text))


def ranked(rows, items, top):
    """Every item against every document."""
    counted = [(i, Counter(t), len(t)) for i, text in rows if (t := terms(text))]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item_id, text in set(items):
        asked = Counter(terms(text))
        scores = [(sum(k * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // n_words))) for t, k in asked.items() if t in c), i)
                  for i, c, n in counted]
        best = sorted((-s, i is not None, i or 0, i) for s, i in scores if s > 0)[:top]
        out += [(item_id, k + 1, row[3], -row[0]) for k, row in enumerate(best)]
    return sorted(out, key=str)


def search(spark, docs, items, top=20):
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit(0), "rank": F.lit("x")})
    found = ranking.search(docs, asked, top)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=str)


def test_search(spark, docs):
    pairs = [(r[0], r[1]) for r in ROWS]
    items = [(i, " ".join((ROWS[i][1] or "").split()[2:30])) for i in range(0, 60, 3)]
    items += [(900, None), (901, ""), (902, "!!"), (903, "a b c d e f g h a"), items[0], (0, "one two"), (904, "é 中文 no"), (905, ROWS[3][1] * 40)]
    assert search(spark, docs, items) == ranked(pairs, items, 20)
    assert search(spark, docs, items, 3) == ranked(pairs, items, 3)
    assert search(spark, docs.limit(0), items) == [] and search(spark, docs, []) == [] and search(spark, docs, [(1, "nowhere-to-be-found")]) == []


def test_search_in_bundles_and_rounds(spark, monkeypatch):
    """More items than a bundle holds, terms of all frequencies, many ties; with and without rounds."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    rows = [(k % 250, some(rng.randint(1, 30))) for k in range(500)]
    items = [(k, some(rng.randint(1, 12))) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    expected = ranked(rows, items, 20)
    assert search(spark, frame, items) == expected
    monkeypatch.setattr(ranking, "ROUND_PAIRS", 500)
    assert search(spark, frame, items) == expected


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars, _ = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and each leaf's (siblings left, siblings right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            paths[k].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        nodes, at = [sha(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def manifested(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), leaf_of(row, None if row[1] is None else plain.lower(row[1])), row[0]))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(langs[lang])]) for lang in order}
    root, above = tree([trees[lang][0] for lang in order])
    out = []
    for lang, rest in zip(order, above):
        for (_, _, leaf, low, doc_id), path in zip(sorted(langs[lang]), trees[lang][1]):
            digest = low if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 0 else leaf
            for a, b in [*path, *rest]:
                digest = sha(a, digest, b)
            out.append((doc_id, leaf, trees[lang][0], root, sha(*(a + b for a, b in [*path, *rest])), digest, digest == root))
    return sorted(out, key=str)


def verified(frame):
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    return sorted(map(tuple, manifest.verify(manifest.witnesses(frame), tampered).collect()), key=str)


def test_manifest(spark, docs):
    assert verified(docs) == manifested(ROWS)
    assert verified(docs.limit(0)) == []
    one = spark.createDataFrame(ROWS[:1], plain.SCHEMA)
    assert verified(one) == manifested(ROWS[:1])


def test_manifest_of_several_rounds(spark):
    """A language over the edge of a block, one of a whole block, one of several, and more languages than a run; a third of all rows are one row."""
    rng = random.Random(8)
    sizes = {"a": 513, "b": 512, "c": 1300, None: 9, **{f"x{k}": 1 + k for k in range(9)}}
    rows = [(rng.randint(0, 3000), f"Text {rng.random()}", lang, "s", 5, 0.0) for lang, n in sizes.items() for _ in range(n)]
    rows += [(7, "Again", "c", "s", 5, 0.0)] * 1000
    assert verified(spark.createDataFrame(rows, plain.SCHEMA).repartition(11)) == manifested(rows)


def test_partial_witnesses_grow():
    """A waiting leaf's witness holds the siblings so far; later ones extend it."""
    block = manifest.Frontier(2)
    for k in range(10):
        block.append(str(k))
    assert block.paths[8] == [([], ["9"])] and block.paths[0][0] == ([], list("1234567")) and block.paths[0][1] == ([], [])
    block.append("A")
    assert block.paths[8] == [([], ["9", "A"])] and block.root is None
    assert block.close() == sha(sha(*"01234567"), sha("8", "9", "A")) and block.paths[0][1] == ([], [sha("8", "9", "A")])


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_id_files(spark, docs, encode, tmp_path):
    folder = f"{tmp_path}/ids"
    idfiles.write(docs, folder, TOKENIZER, END_ID)
    found = idfiles.read(spark, folder).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == sorted((str(r[0]), packed(encode(r[1]))) for r in ROWS)
    at = 0
    for r in sorted(found, key=lambda r: r.start):                 # ascending ids, null first, without a gap
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    some = {r.doc_id: bytes(r.ids) for r in idfiles.read(spark, folder, [3, 40, 3008, 77777]).collect()}
    assert some == {i: packed(encode(next(r[1] for r in ROWS if r[0] == i))) for i in (3, 40, 3008)}
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    assert len(dictionary.data) and {r[0] for r in spark.read.parquet(f"{folder}/shards").select("dictionary_sha256").distinct().collect()} == {dictionary.sha256}
    spark.createDataFrame([(dictionary.sha256, bytes(dictionary.data)[:-1] + b"?", 2)], "sha256 string, data binary, width int").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        idfiles.read(spark, folder)


@pytest.mark.parametrize("rows", [[], [(1, "one document")], [(5, "same text here")] * 40])
def test_id_files_of_little(spark, encode, tmp_path, rows):
    folder = f"{tmp_path}/ids"
    idfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, TOKENIZER, END_ID)
    found = idfiles.read(spark, folder).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == sorted((i, packed(encode(t))) for i, t in rows)
    assert sorted(r.start for r in found) == [k * len(encode(rows[0][1])) for k in range(len(rows))]


def test_pieces_are_exact(encode):
    """Texts whose white space is not of lone spaces and line feeds are encoded whole."""
    encoder = idfiles.Encoder(TOKENIZER, END_ID)
    odd = ["a  b", "a\n\nb c", " lead", "trail ", "a\xa0b\xa0c   d", "a \n b", "tab\tx y", "it's we'll don't  's", "<|endoftext|> x <|endoftext|>", "", "\n", " ", "a\x1cb  c",
           "a b   c d", "x\0y z", "don't 123 ab12 ... 中文 é́ \U0001f600 end", "one\ntwo three\nfour's 'll"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(["a", "B", "'s", " ", " ", "\n", "\t", "1", "é", "\xa0", "　", "!", "中"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    assert [encoder.encode([t])[0] for t in odd] == [b"".join(i.to_bytes(2, "little") for i in encode(t)) for t in odd]
    assert encoder.encode(odd) == [encoder.encode([t])[0] for t in odd]


def test_encoding_is_not_slowed_by_the_collector(encode):
    """No garbage collection walks the lists of pieces; afterwards the collector is as it was."""
    encoder = idfiles.Encoder(TOKENIZER, END_ID)
    texts = [f"w{k} some words, a\nline {k}" for k in range(5000)] + ["two  spaces", ""]
    before = gc.get_stats()
    found = encoder.encode(texts)
    assert [s["collections"] for s in gc.get_stats()] == [s["collections"] for s in before]
    assert gc.isenabled() and not {"", " "} & set(encoder.cache)
    assert found == [b"".join(i.to_bytes(2, "little") for i in encode(t)) for t in texts]


def test_plain_words_need_no_pre_tokenizer(encode, monkeypatch):
    """Words of Latin letters, with punctuation after them, go to the library's model; the ids are those of the whole text."""
    encoder = idfiles.Encoder(TOKENIZER, END_ID)
    sent = []
    monkeypatch.setattr(encoder, "_ids_of_pieces", lambda pieces, own=encoder._ids_of_pieces: sent.extend(pieces) or own(pieces))
    text = "Whole words, überall, Ünïcode: dogs' end.\nnext (line) don't x's 12 a1 µm ﬁn a×b ... " + "a" * 200 + ", ½ 中文. z"
    assert encoder.encode([text])[0] == b"".join(i.to_bytes(2, "little") for i in encode(text))
    assert not {"Whole", " words,", " überall,", " Ünïcode:", " dogs'", " end.", "next", " z"} & set(sent)
    assert {" (line)", " don't", " x's", " a1", " µm", " ﬁn", " a×b"} <= set(sent)
