"""Spans of personal data and secrets, page extraction, and the pipeline."""

import random
import re

import pytest

import corpus_pipeline
import plain
from sceneframe.llm import extraction, privacy, secrets

#: the contract's patterns, as plain regular expressions
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) \
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL_TEXTS = [
    "write a.b+c@mail.example.com.x and d@e.f@g.h.i or @x.y a@b", "é 10.0.0.1 999.1.1.1.1 1.2.3.4.5.6.7.8.9 0001.02.3.004", "4111 1111 1111 1111 4111-1111-1111-1112 1234567890123",
    "call +1 (017) 555-7713 now +44 20 7946 0958. +1 2 +123456789012345678", "x" * 3000 + "@y.z " + "1" * 2000 + ".1.1.1", "a@b.c" + ".d" * 3000, None, "",
    "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "+4 . 5 6 7 8 9 0 1 2 3 4 \n+49 89 1234567", "\U0001f600 me@x.org"]


def test_personal_base_spans(spark):
    rng = random.Random(0)
    texts = PERSONAL_TEXTS + ["".join(rng.choice("0123456789.@+- ()ab") for _ in range(rng.randint(5, 90))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in privacy.digest(privacy.spans(docs)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        expect = personal(text)
        base = [x for x in found[i].spans.split(",") if x and not x.startswith("term")]
        assert base == expect, text
        assert found[i].base_sha256 == plain.sha(",".join(expect))
        assert [found[i][f"n_{k}"] for k in PERSONAL] == [sum(x.startswith(k) for x in expect) for k in PERSONAL]


def test_disclosing_terms(spark):
    rng = random.Random(3)
    rows = [(i, plain.prose(rng, "en", 3)) for i in range(60)]
    for k in range(5):      # the name is only found with the address; "the" is found everywhere
        rows.append((100 + k, f"{plain.sentence(rng, 'en', 6)}\nthe office of Zebulonius {k} the: zeb@mail.example.com\nthe end"))
    rows.append((200, "Nobody here. Ask ZEBULONIUS, the man."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in privacy.digest(privacy.spans(docs)).collect()}
    texts = dict(rows)
    shown = {i: [texts[i][int(a):int(b)].lower() for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "term"] for i, s in found.items()}
    assert all("zebulonius" in shown[100 + k] for k in range(5)) and shown[200] == ["zebulonius"]
    assert not any("the" in x for x in shown.values()) and not any(shown[i] for i in range(60))
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[200] == "Nobody here. Ask , the man." and clean[100].endswith("the  of  0 the: [email]\nthe end")
    assert privacy.spans(docs.limit(0)).count() == 0


def test_secrets(spark):
    rng = random.Random(9)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [f'my token = "{key}" and Password: hunter2hunter2', "AKIAABCDEFGHIJKLMN AKIASHORT", "0123456789abcdef0 deadbeef", f"see {key} here",
             "a1" * 15 + " user_name_field_for_login_form_3", None, "", "api_key:" + "x" * 5000, "é secret='abcdefghijkl'"] + ["plain words only"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for i, text in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(text or "") if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        listed = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert found[i].base_sha256 == plain.sha(",".join(listed))
        assert [x for x in found[i].spans.split(",") if x and not x.startswith("random")] == listed
    assert found[3].spans == "random:4:44"
    assert "random" not in found[4].spans
    assert secrets.digest(secrets.scan(docs.limit(0))).count() == 0


def test_randomness_battery():
    rng = random.Random(1)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    assert sum(secrets.randomness(k) < 0.01 for k in keys) <= 8
    assert secrets.randomness("abababababababababababababababab12") < 1e-4
    assert secrets.infer_encoding("00ff")[0] == "hex" and secrets.infer_encoding("!!") is None


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies</div>
<nav><a href="/a">menu</a></nav><div id="wrap7"><header>Site</header><div class="post content3"><h1>T &amp; x</h1><p>Hello   <b>wo</b>rld&nbsp;x<br>y
<ul><li>one<li>two</ul><div class=comments><p>a long reader comment that must not be there at all</p></div><form><p>name</p></form>if a < b then{extra}</div><aside>s</aside></div>
<footer>&copy; z</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE.replace("{extra}", f" c{k}").replace("content3", f"content{k}")) for k in range(5)]
    # this page's advert is longer than its article, but its host's other pages agree on the article
    rows.append((9, "http://host.example/9", '<body><div class="box">' + "<p>long long filler text</p>" * 9 + '</div><div id="w"><div class="post content"><p>short</p></div></div>'))
    rows += [(10, None, "<p>loose <i>text</i></p><p>two"), (11, "x", None), (12, "y", ""), (13, "http://z/1", "<body><article><p>cut &amp; here<p>next <a href='x"),
             (14, "http://z/1", "<body><article><p>same</article>"), (14, "http://z/1", "<body><article><p>same</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in extraction.main_text(pages).collect()}
    for k in range(5):
        assert found[k].text == f"T & x\n\nHello world x y\n\none\n\ntwo\n\nif a < b then c{k}"
    assert found[9].text == "short"
    assert found[11].text == found[12].text == ""
    assert found[13].text == "cut & here\n\nnext"
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert extraction.main_text(pages).count() == len(rows) and extraction.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rows = plain.documents()
    bench = [(1, " ".join(dict((r[0], r[1]) for r in rows)[4].split()[3:20]))]
    spark.createDataFrame(rows, plain.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()]
    # the later stages by their plain versions
    lines = plain.line_templates(kept)
    kept = [(i, lines[i, t][2]) for i, t in kept if not (lines[i, t][1] and not (lines[i, t][2] or "").strip())]
    groups = plain.components(kept, 80, 5)
    kept = list({i: (i, t) for i, t in kept if i is not None and groups[i, t][1] == i}.values()) + [(i, t) for i, t in kept if i is None]
    leaks = plain.contamination(kept, bench)
    kept = [(i, t) for i, t in kept if not leaks[i, t][4]]
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in found.collect()) == sorted((str(i), plain.sha(t)) for i, t in kept)
    assert 50 < len(kept) < len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
