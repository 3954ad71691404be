"""Secret scans: pattern candidates, and a random forest that removes false positives.

Candidates are runs of at least ``LEAST`` key characters, and runs of any length
that follow a secret word and an assignment sign, or hold both.  Their features are
length, character classes and transitions, entropy, the share covered by
dictionary words and common letter pairs, path signs, and the words and signs
around them.  The forest is trained on findings labelled by construction:
``labelled_findings`` writes keys of public formats into assignments
(secret) and identifiers, digests, paths, words, numbers, settings and
placeholders into their usual surroundings (not secret).

Defined cases: null and empty texts have no findings; equal rows have equal
findings, each their own; positions count code points from 0; a finding is a run
as long as it is, however long the text; ids are cast to long, so one that isn't a
number is an error (or null, without ANSI mode), and null ids have findings too; an empty table gives
an empty result.  ``scan_secrets`` ignores other columns, ``redact_secrets`` hands on
all of them, whatever their names, and sets ``n_chars`` if there is one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_arrow

LEAST = 16
MARK = "[SECRET]"
THRESHOLD = 0.5
CONTEXT = 48
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=\-]{%d,}" % LEAST)
#: An assignment sign and the run after it (a longer one is a candidate anyway), which a quote may open; the sign may be a run's own character.
_ASSIGNED = re.compile(r"""(?:=>|:=|=|:)[ \t]*["'`]?([A-Za-z0-9_+/=\-]{1,%d})""" % LEAST)

#: Words that come before secrets, and before harmless identifiers.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "accesskey", "auth", "bearer", "credential", "private", "key")
HARMLESS_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "revision", "hash", "etag", "version", "build", "order", "phone", "card", "example", "isbn", "invoice", "path", "file", "http", "https")
#: A secret word at the end of what stands before an assignment sign.
_NAMED = re.compile(r"""(?:%s)[a-z0-9_\-]*["'`\])]?\s*$""" % "|".join(SECRET_WORDS), re.IGNORECASE)
#: Frequent English words of four letters and more, for dictionary coverage.
DICTIONARY = (
    "that with this from have they which their would there about when make like time just know take people into year your good some could them other than then look only come over think also back after work first well even want because these give most "
    "data file name user test example value string number index model config server client service system project module class function return public private static import export default license source target update create delete insert select"
).split()
#: The most frequent letter pairs of English, French, German and Spanish text.
PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie ge ei sc un ue qu ai el la os ad da ci do au il lo".split())


def _is_hex(s: str) -> bool:
    return all(c in "0123456789abcdefABCDEF" for c in s)


def features(value: str, before: str, after: str) -> list[float]:
    """Numbers that describe a candidate and its surroundings."""
    n, low = len(value), value.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    share = Counter(kinds)
    entropy = -sum(x / n * math.log2(x / n) for x in Counter(value).values())
    letters = sum(share[k] for k in "ul")
    pairs = sum(low[i : i + 2] in PAIRS for i in range(n - 1))
    covered, at = 0, 0
    while at < n:
        word = next((w for w in DICTIONARY if low.startswith(w, at)), None)
        covered, at = (covered + len(word), at + len(word)) if word else (covered, at + 1)
    head, tail = before.lower(), after.lower()
    near = re.findall(r"[a-z0-9_\-]+", head)[-3:]
    glued = head.rstrip(" \"'`")[-1:]
    own_key = low.split("=")[0] if "=" in low.rstrip("=") else ""
    return [
        min(n, 400), entropy, share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        len(set(value)) / min(n, 64), pairs / max(1, n - 1), pairs / max(1, letters), covered / n,
        float(_is_hex(value)), float(value.isdigit()),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        low.count("/"), float(head[-1:] in ("/", ".", "@", "#")), float(tail[:1] in ("/", ".", "@")), low.count("-") + low.count("_"),
        float(any(k in w for w in near[-2:] for k in SECRET_WORDS) or any(k in own_key for k in SECRET_WORDS)),
        float(any(w == k for w in near for k in HARMLESS_WORDS)),
        float(glued in ("=", ":") or "=" in own_key + value.rstrip("=")), float(head[-1:] in ('"', "'", "`")),
        float(any(x in low for x in ("example", "xxxx", "your", "placeholder", "changeme", "dummy", "0123456789", "abcdef0123"))),
    ]


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(value, before, after, 1 if a secret), by construction."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    run = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, lower, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = lower + lower.upper() + digits
    base64 = alnum + "+/"
    syllables = sorted(PAIRS) + ["ing", "tion", "ent", "heit", "ung", "ment", "the", "and", "lich", "cion"]
    word = lambda k: "".join(pick(syllables) for _ in range(k))
    text = lambda: " ".join(word(int(r.integers(1, 4))) for _ in range(4))
    out = []
    settings = ["none", "null", "true", "false", "undefined", "required", "optional", "string", "str", "int", "value", "name", "default", "empty", "hidden", "env", "self", "request", "text", "yes", "no"]
    leet = str.maketrans("aeio", "4310")
    for i in range(n):
        short = i % 2 and r.random() < 0.2
        value = pick([
            lambda: run(hexa, int(pick([32, 40, 40, 40, 48, 64]))), lambda: run(alnum, int(r.integers(20, 65))), lambda: run(base64, int(r.integers(24, 88))) + pick(["", "=", "=="]),
            lambda: pick(["AKIA", "ASIA"]) + run(lower.upper() + digits, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + run(alnum, 36), lambda: pick(["sk_live_", "sk-", "rk_live_"]) + run(alnum, 32),
            lambda: "xoxb-" + run(digits, 12) + "-" + run(alnum, 24), lambda: "AIza" + run(alnum, 35), lambda: run(pick([lower, lower + lower.upper()]), int(r.integers(16, 33))),
        ])() if i % 2 else ""
        if short:
            value = pick([lambda: run(alnum, int(r.integers(6, 16))), lambda: run(lower, int(r.integers(8, 16))), lambda: run(hexa, int(r.integers(8, 16))), lambda: pick([str, str.capitalize])(word(int(r.integers(2, 5))).translate(leet))[:10] + run(digits, int(r.integers(1, 5)))])()
        if value:
            if r.random() < 0.15:
                value = value.upper() if _is_hex(value) else value
            name = pick(["token", "api_key", "apikey", "secret", "password", "auth_token", "access_key", "client_secret", "TOKEN", "API_KEY", "key", "Bearer"])
            if short and name == "Bearer":
                name = "password"
            link = pick([' = "', '="', ": ", '": "', " = ", "=", ": " if short else " ", " = '"]) if name != "Bearer" else " "
            out.append((value, text() + " " + name + link, pick(['"', '"', '" ', " ", "'", '"!!', "\n"]) + text(), 1))
            if value[:4] in ("AKIA", "ghp_", "xoxb", "AIza") and r.random() < 0.5:
                out[-1] = (value, text() + " ", " " + text(), 1)
            continue
        kind = int(r.integers(15))
        before, after = text() + " ", " " + text()
        if kind <= 2:
            value = word(int(r.integers(7, 16)))[: int(r.integers(16, 40))].ljust(16, "e")
            value = pick([str, str.capitalize, str.upper])(value)
        elif kind == 3:
            value = "/".join(word(2) for _ in range(5))
            before += pick(["/", "./", "https://", ""])
        elif kind == 4:
            value = "-".join(run(hexa, k) for k in (8, 4, 4, 4, 12))
            before += pick(["uuid ", "id: ", "request ", "", 'guid = "'])
        elif kind <= 6:
            value = run(hexa, int(pick([32, 40, 64])))
            before += pick(["commit ", "sha256:", "md5 ", "checksum: ", "digest = ", "revision ", "etag: ", "sha1 = ", "hash "])
        elif kind == 7:
            value = run(digits, int(r.integers(16, 25)))
            before += pick(["", "card ", "order ", "phone ", "no. "])
        elif kind == 8:
            value = pick(["x" * 24, "X" * 32, "your_token_goes_here", "YOUR-API-KEY-GOES-HERE", "changeme-changeme", "0123456789abcdef0123456789abcdef", "placeholder_value_1", "EXAMPLE_KEY_EXAMPLE", "0" * 40, "a" * 32, "dummy_secret_value"])
            before += pick(["token = \"", "api_key: ", "password=", "secret = "])
        elif kind == 9:
            value = pick(["-", "_"]).join(word(2) for _ in range(int(r.integers(4, 8))))
        elif kind == 10:
            value = pick(["=", "-", "_"]) * int(r.integers(16, 60))
        elif kind == 11:
            value = word(5) + pick(["_", "="]) + word(3) + run(digits, 2)
        elif kind == 12:
            value = "".join(pick([pick(DICTIONARY), word(2)]).capitalize() for _ in range(int(r.integers(4, 7)))).ljust(LEAST, "e")
            value = pick([str, lambda v: v[0].lower() + v[1:]])(value)
        else:
            value = pick([lambda: pick(settings), lambda: pick(["get", "load", "read", "to"]) + pick([word(2), "password", "token", "key"]).capitalize(), lambda: pick(DICTIONARY), lambda: word(int(r.integers(1, 4))), lambda: run(digits, int(r.integers(1, 4)))])()
            value = pick([str, str, str.capitalize])(value)
            before += pick(["token", "api_key", "secret", "password", "auth", "author", "key", "keyword", "private", "max_tokens"]) + pick([" = ", ": ", ' = "', '": "', ": str = ", " = '"])
            after = pick(["", "(", '"', ",", ";"]) + after
        if kind <= 12:
            value = value if len(value) >= LEAST else value + "e" * (LEAST - len(value))
        out.append((value, before, after, 0))
    return out


# --- random forest -------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int, nodes: list) -> int:
    at, p = len(nodes), float(y.mean())
    nodes.append((-1, 0.0, -1, -1, p))
    if depth == 0 or p in (0.0, 1.0) or len(y) < 8:
        return at
    best = (2.0, -1, 0.0)
    for f in r.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        left, right = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(y) - cut)
        gini = (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
        k = int(np.argmin(gini))
        if gini[k] < best[0]:
            best = (float(gini[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best[1] < 0:
        return at
    low = x[:, best[1]] <= best[2]
    a, b = _grow(x[low], y[low], r, depth - 1, nodes), _grow(x[~low], y[~low], r, depth - 1, nodes)
    nodes[at] = (best[1], best[2], a, b, p)
    return at


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 5) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays: feature (-1 in a leaf), border, left, right, share of secrets."""
    r, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        rows, nodes = r.integers(len(y), size=len(y)), []
        _grow(x[rows], y[rows], r, depth, nodes)
        forest.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return forest


def predict(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, border, left, right, share in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= border[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += share[at]
    return total / len(forest)


@lru_cache(maxsize=1)
def forest() -> list[tuple[np.ndarray, ...]]:
    """The trained forest; the same on every driver."""
    rows = labelled_findings()
    return train_forest(np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], dtype=float))


# --- scan ----------------------------------------------------------------------------------------------------


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs that the forest decides on, in order."""
    out = {m.span() for m in _CANDIDATE.finditer(text)}
    at = 0
    while m := _ASSIGNED.search(text, at):
        (a, b), sign = m.span(1), m.start()
        at = m.start(1)  # a run may hold a sign of its own
        if a > 0 and _is_key(text[a - 1]):  # the sign is a character of the run
            while a > 0 and b - a < LEAST and _is_key(text[a - 1]):
                a -= 1
        if b - a < LEAST and any(c.isalnum() for c in text[m.start(1) : b]) and _NAMED.search(text[max(0, sign - CONTEXT) : sign]):
            out.add((a, b))
    return sorted(out)


def _is_key(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "_+/=-")


def find(texts: list[str | None], trees: list[tuple[np.ndarray, ...]], threshold: float = THRESHOLD) -> list[list[tuple[int, int, float]]]:
    """For each text, (start, length, score) of its secrets."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    at, rows = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text or ""):
            at.append((i, a, b - a))
            rows.append(features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
    if rows:
        for (i, a, n), p in zip(at, predict(trees, np.array(rows)), strict=True):
            if p >= threshold:
                out[i].append((a, n, float(p)))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per finding: id, start, length, secret_sha256, score."""
    trees = forest()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[i], a, n, hashlib.sha256(texts[i][a : a + n].encode()).hexdigest(), round(p, 6)) for i, found in enumerate(find(texts, trees, threshold)) for a, n, p in found]
            names, kinds = ["id", "start", "length", "secret_sha256", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return map_arrow(rows, scanned, "id long, start long, length long, secret_sha256 string, score double").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret replaced by MARK; n_chars, if there, follows the changed texts."""
    trees, names, at = forest(), docs.columns, docs.columns.index(text_col)

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = [False] * len(texts)
            for i, found in enumerate(find(texts, trees, threshold)):
                for a, n, _ in reversed(found):
                    texts[i] = texts[i][:a] + MARK + texts[i][a + n :]
                    changed[i] = True
            columns = [*batch.columns]
            columns[at] = pa.array(texts, batch.column(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if c else old for t, c, old in zip(texts, changed, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, redacted, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
