"""Secret scans, toxicity and language identification against plain loops, for whole results of their operators."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from netloom.llm import language, secret_scans, toxicity

MASK = (1 << 64) - 1


def mixed(x):
    """The finaliser of the word hashes, on whole numbers."""
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def word_hash(word):
    return mixed(sum((b + 33 if 65 <= b <= 90 else b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) & MASK)


def terms_of(text):
    found, word = set(), bytearray()
    for b in (text or "").encode() + b" ":
        if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128:
            word.append(b)
        elif word:
            found.add(word_hash(word))
            if len(word) > toxicity.STEM:
                stem = sum((x + 33 if 65 <= x <= 90 else x + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, x in enumerate(word[: toxicity.STEM])) & MASK
                found.add(mixed(stem ^ 0xA0761D6478BD642F))
            word = bytearray()
    return found


def test_toxicity_scores(spark):
    r = random.Random(2)
    plain = [f"{a}{b}lorem" for a in "abcdefgh" for b in "aeiou"]
    rows = []
    for i in range(900):
        kind = i % 20
        extra = ["zork", "blib"] if kind < 2 else ["zork"] if kind < 7 else ["blib"] if kind < 12 else ["Vrumpfling"] if kind < 15 else []
        rows.append((i, " ".join(r.sample(plain, 8) + extra), int(kind < 2 or 12 <= kind < 15)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "ZORK, blib! vrumpflings")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    place = {int(t): i for i, t in enumerate(machine.terms)}
    assert word_hash(b"zork") in place and word_hash(b"blib") in place
    for x in toxicity.score(docs, machine).collect():
        own = sorted(place[t] for t in terms_of(x.text) if t in place)
        z = machine.bias + sum(machine.weights[i] for i in own)
        z += sum(float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(own) for j in own[k + 1 :])
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # what is learned from: labelled rows that are not held out
    import zlib

    known = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert math.log(sum(y for _, y in known) / len(known)) < 0 and len(machine.terms) < 30


def walk(tree, x):
    feature, border, left, right, share = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if x[feature[at]] <= border[at] else right[at]
    return share[at]


def test_secret_scans(spark):
    r = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = lambda n: "".join(r.choice(chars) for _ in range(n))
    texts = [f"we set token {run(r.randint(10, 40))} and commit {hashlib.sha1(str(i).encode()).hexdigest()} of the file /usr/lib/python/something/module" for i in range(60)]
    texts += [f'key = "{run(24)}"\npath http://www.example.org/{"x" * 20}', "Donaudampfschifffahrtsgesellschaft " * 3, "é" + run(16) + "é" + run(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trees, want = secret_scans.forest(), Counter()
    for i, text in enumerate(texts):
        a = 0
        while a < len(text):
            b = a
            while b < len(text) and (text[b] in chars or text[b] in "_+/=-"):
                b += 1
            if b - a >= 16:
                x = secret_scans.features(text[a:b], text[max(0, a - 48) : a], text[b : b + 48])
                p = sum(walk(t, x) for t in trees) / len(trees)
                if p >= 0.5:
                    want[i, a, b - a, hashlib.sha256(text[a:b].encode()).hexdigest(), round(float(p), 6)] += 1
            a = max(b, a + 1)
    got = Counter((x.doc_id, x.start, x.length, x.secret_sha256, x.score) for x in secret_scans.scan_secrets(docs).collect())
    assert got == want and len(want) > 20


def buckets(text):
    low = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    return [((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF) >> 16 for a, b, c in zip(low, low[1:], low[2:], strict=False)]


def test_language_evidence(spark):
    r = random.Random(7)
    words = {"de": ["der", "und", "nicht", "ein", "haus"], "en": ["the", "and", "not", "one", "house"], "fr": ["le", "et", "pas", "un", "maison"]}
    say = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    learned = [(i, say(x, r.randint(1, 9)), x) for i, x in enumerate(["de", "en", "fr"] * 20)]
    docs = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    model = language.fit_text(docs)
    counts = {x: Counter() for x in words}
    for _, text, x in learned:
        counts[x].update(buckets(text))
    names = sorted(words)
    total = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in names}
    chance = lambda b, x: math.log((counts[x][b] + 0.5) / total[x])
    assert model.languages == tuple(names)
    rows = []
    for i in range(90):
        x = r.choice(names)
        rows.append((i, None if i % 11 == 0 else say(x, r.randint(0, 12)), x if i % 3 == 0 else None, r.choice(["de", "com", None]), f"h{i % 5}" if i % 7 else None))
    lls = []
    for _, text, *_ in rows:
        own = buckets(text)
        ll = [sum(chance(b, x) for b in own) * min(len(own), language.EVIDENCE) / max(len(own), 1) for x in names]
        lls.append([v - max(ll) for v in ll])
    soft = [[math.exp(v) / sum(map(math.exp, ll)) for v in ll] for ll in lls]
    added = lambda by: {k: [sum(p[i] for p, row in zip(soft, rows, strict=True) if by(row) == k) for i in range(3)] for k in {by(row) for row in rows}}
    every = [sum(p[i] for p in soft) for i in range(3)]
    prior = [(v + 1) / (sum(every) + 3) for v in every]
    lean = lambda own, base: [(a + language.LEAN * b) / (sum(own) + language.LEAN) for a, b in zip(own, base, strict=True)]
    suffix = {k: lean(v, prior) for k, v in added(lambda row: row[3] or "").items()}
    host = {k: lean(v, suffix[k[0]]) for k, v in added(lambda row: (row[3] or "", row[4] or "")).items()}
    declared = {k: [1.0] * 3 if k == "" else [(v[i] + 0.01) / (every[i] + 1) for i in range(3)] for k, v in added(lambda row: row[2] or "").items()}
    want = defaultdict(list)
    for row, ll in zip(rows, lls, strict=True):
        log = [ll[i] + math.log(host[row[3] or "", row[4] or ""][i]) + math.log(declared[row[2] or ""][i]) for i in range(3)]
        best = log.index(max(log))
        want[row[0]].append((names[best], pytest.approx(1 / sum(math.exp(v - log[best]) for v in log), abs=1e-9)))
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string").repartition(3)
    got = {x.id: [(x.lang, x.probability)] for x in language.identify(df, model).collect()}
    assert got == dict(want)
