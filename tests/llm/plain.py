"""Plain versions of the text operators, and a small fixture with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

SYLLABLES = {"en": ["the", "ing", "on", "er", "st", "wh", "ea", "ti"], "de": ["sch", "ung", "ein", "ber", "tz", "keit", "pf", "ü"],
             "fr": ["eau", "tre", "oi", "ment", "que", "lle", "é", "ai"]}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def prose(rng: random.Random, lang: str, lines: int = 4, words: int = 14) -> str:
    return "\n".join(sentence(rng, lang, words + rng.randint(0, 6)).capitalize() + "." for _ in range(lines))


def documents(seed: int = 5, n: int = 90) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, score): prose, copies, near copies, recurring lines, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ["en", "en", "de", "fr"][i % 4]
        text = prose(rng, lang, rng.randint(2, 6))
        if i % 3 == 0:
            text = f"Posted on day {rng.randint(1, 99)} by {rng.choice(['anna', 'bert', 'carl', 'dora', 'emil'])} in the daily news\n" + text
        if i % 5 == 0:
            text += "\nAll rights are reserved by the owner."
        rows.append([i, text, lang])
    base = rows[7][1].split()
    for k in range(6):                               # near copies, one word changed
        copy = list(base)
        copy[3 + 5 * k] = f"changed{k}"
        rows.append([1000 + k, " ".join(copy), "fr"])
    rows += [[2000, rows[2][1], "de"], [2001, rows[2][1], None]]                       # exact copies
    rows += [[3000, None, "en"], [3001, "", "en"], [3002, " \t\n\n ", None], [3003, "12 34 !!", "en"], [3004, "one two", "en"],
             [3005, "é ñ 中文 \U0001f600   x y", "en"], [3006, "a b c d e f g h " * 400, "en"], [3007, "x" * 5000 + " " + "1" * 3000, "en"],
             [None, "a text without an id of its own", "en"], [3008, sentence(rng, "en", 9000), "en"]]
    rows.append(list(rows[5]))                       # a repeated row
    return [(i, t, lang, "src", len(t) if t is not None else None, 0.5) for i, t, lang in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality_counts(text: str | None) -> tuple:
    w = words(text)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def base_scores(rows) -> dict:
    tokens = [[*words(lower(t)), None] for _, t in rows]
    counts = Counter(x for (i, _), ts in zip(rows, tokens) if remainder(i, 10) for x in ts)
    total, kinds = sum(counts.values()), len(counts)
    return {(i, t): (len(ts), sum(counts[x] > 0 for x in ts), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in ts))
            for (i, t), ts in zip(rows, tokens)}


def shingle_set(text: str | None, n: int = 4) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, percent: int = 85, n: int = 4) -> dict:
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return {(i, t): (len(sets[k]), min(ids[find(k)], default=None)) for k, (i, t) in enumerate(rows)}


def line_templates(rows, min_docs: int = 10, depth: int = 3, alike: float = 0.7) -> dict:
    """(doc_id, text) -> (lines, dropped, text that stays)."""
    def parse(line):
        return tuple("\0" if re.search("[0-9]", w) else w for w in words(line))
    leaves = defaultdict(lambda: defaultdict(dict))
    for k, (i, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if w := parse(line):
                leaves[len(w), w[:depth]][w].setdefault((math.inf if i is None else i, k), n)
    first = {}
    for (size, _), own in leaves.items():
        total = sum(map(len, own.values()))
        constant = []
        for p in range(size):
            votes = Counter()
            for w, docs in own.items():
                votes[w[p]] += len(docs)
            word, count = votes.most_common(1)[0]
            constant.append(word if 2 * count > total else None)
        groups = defaultdict(list)
        for w in own:
            same = sum(a == b for a, b in zip(w, constant))
            groups[None if len(own) > 1 and same >= alike * size and same > min(depth, size) else w].append(w)
        for members in groups.values():
            if len({doc for w in members for doc in own[w]}) >= min_docs:
                head = min((i, n) for w in members for (i, _), n in own[w].items())
                first |= {w: head for w in members}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [x for n, x in enumerate(lines) if parse(x) not in first or first[parse(x)] == (math.inf if i is None else i, n)]
        out[i, t] = (sum(bool(words(x)) for x in lines), len(lines) - len(stays), None if t is None else "\n".join(stays))
    return out


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items) -> dict:
    windows = defaultdict(set)
    for item, t in items:
        w = item_words(t)
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            windows[tuple(w[k:k + 10])].add(item)
    out = {}
    for i, t in rows:
        w, hit, found = item_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= {x for x in windows[key] if x is not None}
        listed = sorted(map(str, found))
        out[i, t] = (len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit))
    return out
