"""Quality, licenses, lexicon, language and archives against brute force and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from netloom.llm import archives, language, lexicon, licenses, quality, tokens

SCHEMA = "doc_id long, text string, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\t-\r]", x)]
    seen = {}
    for p in range(len(words) - 4):
        seen.setdefault(tuple(words[p : p + 5]), []).append(p)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [None, "", " \n ", "one", "a b c d e a b c d e", "x " * 300, "é ü | # x\nx\nx\n\nx y"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(60)] + ["long " * 20_000]
    got = {x.doc_id: x for x in quality.judge(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], brute_quality(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.judge(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_quality_lines(spark):
    prose = "This is a plain sentence with ten words in it. "
    rows = [(1, prose * 1 + "And here is another that says more things.\nHome | About | Contact | Help"), (2, "one### two*** three$$$ four%%% five### six seven eight nine ten eleven"), (3, "Home | About | Blog | News | Help | Terms | Jobs | Mail | Maps | Shop | More")]
    got = {x.doc_id: x for x in quality.judge(frame(spark, rows)).collect()}
    assert got[1].n_lines_removed == 1 and not got[2].kept and not got[3].kept
    cleaned = {x.doc_id: x.text for x in quality.clean_lines(frame(spark, rows)).collect()}
    assert cleaned[1] == rows[0][1].split("\n")[0] and cleaned[3] == ""


def test_licenses(spark):
    mit = licenses.TEXTS["mit"]
    rows = [(1, "x " * 50 + "Licensed under the APACHE License, 2"), (2, mit), (3, mit.replace("free of charge", "entirely free of any charge")), (4, None), (5, "cc by cc-by MIT\nLicense"), (6, "apache licenses of the mit licensed"), (7, "GNU general public license"), (8, "Kit cc by"), (8, "Kit cc by")]
    out = [x for x in licenses.scan_licenses(frame(spark, rows)).collect()]
    got = {x.doc_id: x for x in out}
    assert len(out) == len(rows) and got[1].base_labels == "apache" and (got[1].n_base, got[1].first_word) == (1, 53)
    assert got[2].labels == "mit" and got[2].score == pytest.approx(1.0) and got[3].labels == "mit" and 0.4 < got[3].score < 1
    assert (got[4].n_words, got[4].labels, got[4].score) == (0, "", 0.0)
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (3, 0, 4, "cc-by,mit")
    assert got[6].n_base == 0 and got[7].base_labels == "gpl" and (got[8].n_base, got[8].n_words, got[8].first_word) == (1, 3, 1)


def test_lexicon_is_exact_and_minimal(tmp_path):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 7))).encode() for _ in range(800)} | {"é".encode(), b"runs", b"ones"})
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.compile_lexicon(words, lambda w: [len(w), w[0]]))
    automaton = lexicon.Lexicon(str(path))
    ask = words + [b"zzz", b"", b"abcdabcdabcd", words[0] + b"x"]
    place = automaton.places(ask)
    assert place[: len(words)].tolist() == list(range(len(words))) and (place[len(words) :] == -1).all()
    assert all(np.frombuffer(automaton.ids_at(int(p)), "<u4").tolist() == [len(w), w[0]] for p, w in zip(place, words, strict=False))
    futures = {}
    for w in words:
        for i in range(len(w) + 1):
            futures.setdefault(w[:i], set()).add(w[i:])
    assert len(automaton.final) == len({frozenset(x) for x in futures.values()})
    empty = tmp_path / "empty.bin"
    empty.write_bytes(lexicon.compile_lexicon([], lambda w: []))
    assert lexicon.Lexicon(str(empty)).places([b"a", b""]).tolist() == [-1, -1]


def test_round_trip_equals_the_library(spark):
    texts = ["", None, "Hello, world! It's 2024... naïve café", "a  b\n\n c \t d   ", "<|endoftext|> inside", "½ ² ³ x²", "日本語 テスト", "🙂 emoji‍", "\x1c\x1d odd", "x" * 9000, "Donaudampfschiff " * 50, " lead", "ünïcödé" * 20]
    out = {r.doc_id: r for r in lexicon.round_trip(frame(spark, list(enumerate(texts))), with_text=True).collect()}
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(out[i].ids), "<u4").tolist() == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False) == (t or "")
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_merge_word_equals_ranked_merging():
    rank = lexicon.ranks(tokens.default_path("byte_bpe_50k.tiktoken"))
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    for w in ("hello", "Donaudampfschiff", "zzzzzz", "éèê", "a"):
        assert lexicon.merge_word(w.encode(), rank) == library.encode(w, add_special_tokens=False).ids


def test_language_evidence(spark):
    r = random.Random(5)
    alphabet = {"en": ["the", "and", "this", "with", "thing"], "fr": ["que", "les", "nous", "avec", "chose"]}
    docs = spark.createDataFrame([(i, " ".join(r.choice(alphabet[x]) for _ in range(20)), x) for i, x in enumerate(["en", "fr"] * 50)], "doc_id long, text string, lang string")
    model = language.fit_text(docs)
    rows = [(1, "the thing with this", None, None, "h"), (2, "", "fr", None, "new"), (3, None, None, "fr", "a.fr"), *[(10 + i, "nous avec les chose que", "fr", "fr", "a.fr") for i in range(20)], (4, "", None, "fr", "b.fr")]
    df = spark.createDataFrame(rows, "id int, text string, declared string, suffix string, host string")
    got = {x.id: x for x in language.identify(df, model).collect()}
    assert got[1].lang == "en" and got[2].lang == "fr" and got[3].lang == "fr" and got[4].lang == "fr" and got[3].probability > got[4].probability > 0.5
    assert language.identify(df, language.fit_text(docs.limit(0))).filter("probability = 0 AND lang = ''").count() == len(rows)


# --- archives ------------------------------------------------------------------------------------------------


def test_arc_versions():
    payload = b"<html>\n\nline\r\n\r\nWARC/1.1</html>"
    for version in (1, 2):
        data = archives.arc_version_block(version, "a.arc") + b"".join(archives.arc_record(version, f"http://x/{i}#page-{i}", payload * i, 0, "a.arc") for i in range(3))
        got = list(archives.parse_arc(data))
        assert [p for _, _, p in got] == [payload * i for i in range(3)] and got[1][0]["URL"] == "http://x/1#page-1"
        with pytest.raises(ValueError):
            list(archives.parse_arc(data[:-1]))
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"no archive"))


def test_record_ids():
    for n in (0, 1, 12345, -7, (1 << 63) - 1, -(1 << 63), None):
        assert archives.number_of(archives.record_id(n, "0" * 40)) == n
    assert archives.record_id(5, "a" * 40) != archives.record_id(5, "a" * 40, True)


def test_archive_round_trip(spark):
    big, odd = "<p>" + "ü" * 700 + "</p>", "WARC/1.1\r\n\r\n" + "x\r\n\r\n" * 300
    rows = [(1, "http://a/", big), (2, "http://b b/", big), (3, None, big), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "e", None), (7, "f", ""), (8, "g", odd), (None, "h", odd), (9, "i", "z" * 1000), (10, "j", "z" * 1000), (11, "k", "y" * 999), (12, "l", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in archives.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha1(raw).hexdigest()
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 3, 2: 3, None: 8, 9: 10}
    assert archives.archive_round_trip(pages.limit(0)).count() == 0
