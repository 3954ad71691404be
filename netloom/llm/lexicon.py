"""BPE encoding and decoding through a minimal acyclic transducer.

``compile_lexicon`` turns frequent words into the minimal automaton of their
bytes (states with equal futures are shared).  Every arc carries the number of
accepted words before it, so the sum along a word's path is the word's place
in the lexicon, and that place gives its token ids.  The automaton is a file of
plain arrays, sent to the executors with the job and memory-mapped there; a
batch's distinct words walk it together, one byte position at a time.  Words
that it doesn't hold are merged exactly, pair by pair in rank order, so the
ids don't depend on which words the lexicon has.

The words come from all documents: each partition hands on partial counts of
all its words, and the ``LEXICON`` most frequent by their sums are compiled.

Defined cases: null and empty texts have no ids and decode to ""; equal rows
have equal results; a text may be of any length; ids are cast to long, so one
that isn't a number is an error (or null, without ANSI mode); an empty table
gives an empty result; other columns are ignored.  Texts with characters on which Unicode
versions differ are split into words by the library's own pre-tokenizer, and
their words go through the transducer like all others; only a text that holds a
special token's string is encoded by the library.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import own_folder
from . import tokens
from .session import map_arrow

LEXICON = 1 << 16
MEMO = 1 << 19
#: Bytes of the longest words that the lexicon takes; longer ones are merged.
LONGEST = 128
#: Words that are looked up together.
CHUNK = 1 << 17
#: The public split pattern for texts in which every number character is a decimal digit.
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER_NUMBERS = re.compile("[²³¹¼½¾]")


def split_words(text: str, json_path: str) -> list[str]:
    """The tokenizer's words of a text without special tokens, in order; joined they are the text."""
    if not tokens.is_plain(text):
        return tokens.library_words(text, json_path)
    if _OTHER_NUMBERS.search(text):
        import regex

        return regex.findall(tokens.FULL_PATTERN, text)
    return _SPLIT.findall(text)


# --- exact merging -------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merge_word(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged until none has a rank."""
    if word in rank:
        return [rank[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [rank[p] for p in parts]


def merger(path: str):
    """word (text or bytes in UTF-8) -> ids by the same merging, compiled."""
    encode = tokens.ranked(path, r"[\s\S]+").encode_ordinary
    return lambda word: encode(word.decode() if isinstance(word, bytes) else word)


# --- the automaton -------------------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], ids_of) -> bytes:
    """The file of the minimal transducer of distinct words; ids_of(word) gives a word's ids."""
    words = sorted(set(words) - {b""})
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((label, target), ...)) of the shared states

    def share(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states from the root to the end of the last word

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1][-1][1] = share(final, [tuple(a) for a in arcs])

    last = b""
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        close(common)
        for label in word[common:]:
            path[-1][1].append([label, -1])
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = share(path[0][0], [tuple(a) for a in path[0][1]])
    count = [0] * len(states)
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):  # a state's targets are always before it
        n = int(final)
        for label, target in arcs:
            keys.append(s * 256 + label)
            targets.append(target)
            adds.append(n)
            n += count[target]
        count[s] = n
    ids = [ids_of(w) for w in words]
    arrays = [
        np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(adds, "<i4"), np.array([f for f, _ in states], "<u1"),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8"), np.array([i for x in ids for i in x], "<u4"),
    ]
    return np.array([root, *[len(a) for a in arrays]], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A memory-mapped transducer file."""

    def __init__(self, path: str):
        head = np.fromfile(path, "<i8", 7)
        at, self.root, arrays = 56, int(head[0]), []
        for n, kind in zip(head[1:], ("<i8", "<i4", "<i4", "<u1", "<i8", "<u4"), strict=True):
            arrays.append(np.memmap(path, kind, "r", at, (int(n),)) if n else np.empty(0, kind))
            at += int(n) * np.dtype(kind).itemsize
        self.keys, self.targets, self.adds, self.final, self.ends, self.ids = arrays
        self.starts, self.flat = self.ends.tolist(), memoryview(self.ids).cast("B") if len(self.ids) else memoryview(b"")

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, or -1."""
        place, state = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64)
        length = np.array([len(w) for w in words], np.int64)
        data, start = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        live, step = np.flatnonzero(length > 0), 0
        place[length == 0] = -1
        while len(live):
            key = state[live] * 256 + data[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            known = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
            place[live[~known]] = -1
            live, at = live[known], at[known]
            place[live] += self.adds[at]
            state[live] = self.targets[at]
            step += 1
            ended = length[live] == step
            done = live[ended]
            place[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        return place

    def ids_at(self, place: int) -> bytes:
        return self.flat[4 * self.starts[place] : 4 * self.starts[place + 1]]


# --- encoding and decoding -----------------------------------------------------------------------------------


class Coder:
    """Encodes and decodes whole texts; words met before are remembered, MEMO at most."""

    def __init__(self, lexicon: Lexicon, json_path: str, ranks_path: str):
        self.lexicon, self.json_path, self.merge = lexicon, json_path, merger(ranks_path)
        self.memo: dict[str, bytes] = {}
        #: Words that the transducer held, and words that were merged.
        self.held = self.merged = 0
        self.symbol = {i: b for b, i in ranks(ranks_path).items()}
        for i, x in tokens.library(json_path).get_added_tokens_decoder().items():
            self.symbol[i] = x.content.encode()

    def learn(self, words: set[str]) -> None:
        new = list(words)
        raw = [w.encode() for w in new]
        places = self.lexicon.places(raw)
        self.held += int((places >= 0).sum())
        self.merged += int((places < 0).sum())
        for word, place in zip(new, places.tolist(), strict=True):
            self.memo[word] = bytes(self.lexicon.ids_at(place)) if place >= 0 else array("I", self.merge(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit values."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the new words of some texts are looked up together."""
        held: list[list[str] | bytes] = []
        new: set[str] = set()
        size = 0
        for text in texts:
            if not tokens.is_special(text, self.json_path):
                words = split_words(text, self.json_path)
                new.update(words)
                size += len(words)
                held.append(words)
            else:
                held.append(np.array(tokens.library(self.json_path).encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            if size > CHUNK:
                yield from self._joined(held, new)
                held, new, size = [], set(), 0
        yield from self._joined(held, new)

    def _joined(self, held: list[list[str] | bytes], words: set[str]) -> Iterator[bytes]:
        new = words.difference(self.memo)
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = words
            self.learn(new)
        for x in held:
            yield x if isinstance(x, bytes) else b"".join(map(self.memo.__getitem__, x))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.symbol.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _coder(name: str, json_path: str, ranks_path: str) -> Coder:
    return Coder(Lexicon(SparkFiles.get(name)), json_path, ranks_path)


def _count(batches: Iterator[pa.RecordBatch], json_path: str, most: int = MEMO) -> Iterator[pa.RecordBatch]:
    """Partial counts of all words; they are handed on whenever there are more than ``most``."""
    counts: Counter[str] = Counter()

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and not tokens.is_special(text, json_path):
                counts.update(split_words(text, json_path))
                if len(counts) > most:
                    yield sums()
                    counts.clear()
    yield sums()


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON, json_path: str | None = None) -> list[bytes]:
    """At most ``most`` words, by their counts over all documents."""
    json_path = json_path or tokens.default_path("byte_bpe_50k.json")
    counts = map_arrow(docs.select(text_col), lambda it: _count(it, json_path), "word string, n long")
    counts = counts.filter(F.octet_length("word") <= LONGEST)
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [x.word.encode() for x in top.select("word").collect()]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked for)."""
    json_path, ranks_path = json_path or tokens.default_path("byte_bpe_50k.json"), ranks_path or tokens.default_path("byte_bpe_50k.tiktoken")
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{own_folder()}/{name}"
    with open(path, "wb") as f:
        f.write(compile_lexicon(frequent_words(docs, text_col, json_path=json_path), merger(ranks_path)))
    docs.sparkSession.sparkContext.addFile(path)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, json_path, ranks_path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids in coder.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                text = coder.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_text:
                    all_ids.append(ids)
                    all_text.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(all_ids, pa.binary()), pa.array(all_text, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_text else "")
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), coded, schema).withColumnRenamed("id", id_col)
