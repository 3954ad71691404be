"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest

from netloom.llm import archives, exact_dedup, language, lexicon, licenses, near_dup, packing, quality, secret_scans, tokens, toxicity

#: Names that the operators use inside, for columns that they must hand on or ignore.
CLASHING = ["score", "kept", "keep_id", "group_size", "text_sha256", "_rank", "row", "sid", "n", "id", "component_id", "_near_id", "host", "ll", "length", "piece"]
KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
PROSE = "This is a plain sentence with more than ten words in it, as prose has them. "


def rows():
    r = random.Random(3)
    long = " ".join(f"word{r.randrange(5000)}" for _ in range(400_000))  # some megabytes
    near = " ".join(f"v{i}" for i in range(80))
    texts = [(1, PROSE * 3), (2, None), (3, ""), (None, "a text without an id"), (None, None), (4, long), (5, near), (6, near + " tail"), (7, PROSE * 3), (7, PROSE * 3), (8, f'my token = "{KEY}" is here'), (9, " \n\t "), (10, "x" * 300_000), (5, "other text of a repeated id")]
    return texts


def frame(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", None, None, *[f"{c}{i}" if (i or 0) % 2 else None for c in CLASHING]) for i, t in texts], schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows()).cache()


def sha(text):
    return hashlib.sha256(re.sub("[\\x20\\t-\\r]+", " ", text or "").encode()).hexdigest()


def test_packing(spark, docs):
    out = packing.pack(docs).groupBy("doc_id").sum("length").collect()
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows():
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert {r[0]: r[1] for r in out} == want and packing.pack(docs.limit(0)).count() == 0


def test_packing_ranks_a_common_length_in_parts(spark):
    docs = frame(spark, [(i, "same text") for i in range(300)])
    placed = packing.place(packing.pieces(docs), ranked=20).collect()
    assert len({(r.sequence_id, r.offset) for r in placed}) == 300 and {r.doc_id for r in placed} == set(range(300))


def test_quality(spark, docs):
    out = Counter((r.doc_id, r.n_words) for r in quality.judge(docs).collect())
    assert out == Counter((i, len((t or "").split())) for i, t in rows()) and quality.judge(docs.limit(0)).count() == 0
    assert quality.clean_lines(docs).columns == docs.columns


def test_secrets(spark, docs):
    assert [(r.doc_id, r.length) for r in secret_scans.scan_secrets(docs).collect()] == [(8, 40)]
    out = secret_scans.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(rows()) and out.filter("text LIKE '%[SECRET]%'").count() == 1
    twice = frame(spark, [(8, f'token = "{KEY}"')] * 2)
    assert secret_scans.scan_secrets(twice).count() == 2
    assert secret_scans.scan_secrets(docs.limit(0)).count() == secret_scans.redact_secrets(docs.limit(0)).count() == 0


def test_exact_dedup(spark, docs):
    groups = {}
    for i, t in rows():
        groups.setdefault(sha(t), []).append(i)
    least = {d: min((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    want = Counter((i, least[sha(t)], len(groups[sha(t)]), i == least[sha(t)], sha(t)) for i, t in rows())
    for made in (exact_dedup.copies(docs), exact_dedup.mark_copies(docs)):
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in made.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    for counters in (1, 1024):
        left = exact_dedup.drop_copies(docs, counters=counters)
        assert left.columns == docs.columns
        found = left.collect()
        assert Counter((r.doc_id, sha(r.text)) for r in found) == Counter((least[d], d) for d in groups)
        assert all(r.kept == (f"kept{r.doc_id}" if (r.doc_id or 0) % 2 else None) and r.row == (f"row{r.doc_id}" if (r.doc_id or 0) % 2 else None) for r in found)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == exact_dedup.copies(docs.limit(0)).count() == 0


def test_exact_dedup_joins_what_is_too_much_to_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FEW", 0)
    assert exact_dedup.drop_copies(docs, counters=1).count() == len({sha(t) for _, t in rows()})


def test_licenses(spark, docs):
    out = licenses.scan_licenses(docs)
    words = lambda t: len([w for w in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", t or "") if w])
    assert Counter((r.doc_id, r.n_words, r.labels) for r in out.collect()) == Counter((i, words(t), "") for i, t in rows())
    tail = frame(spark, [(1, "word " * 300_000 + "mit license"), (1, "word " * 300_000 + "mit license")])
    assert [(r.n_base, r.first_word) for r in licenses.scan_licenses(tail).collect()] == [(1, 300_000)] * 2
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def labelled(spark):
    texts = [(100 + i, PROSE + f"word{i % 7} " + ("you utter moron" if i % 4 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts] + [(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_toxicity(spark, tmp_path):
    texts, labels = labelled(spark)
    docs = frame(spark, rows() + texts + texts[:5] + [(101, "another text of a labelled id"), (500, "You utter moron! " * 100_000)])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = toxicity.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    got = Counter((r.doc_id, r.score) for r in left.select("doc_id", "score").collect())
    clean = Counter((i, f"score{i}" if (i or 0) % 2 else None) for i, t in rows() + texts + texts[:5] + [(101, "")] if "moron" not in (t or ""))
    assert got == clean
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.columns.count("score") == 1 and scored.count() == docs.count()
    assert toxicity.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_lexicon(spark, docs):
    out = lexicon.round_trip(docs).collect()
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out) == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows())
    assert lexicon.round_trip(docs.limit(0)).count() == 0


def test_language(spark, docs):
    model = language.fit_text(docs)
    evidence = docs.selectExpr("*", "cast(null AS string) AS declared", "source AS suffix")
    out = language.identify(evidence.repartition(2), model)
    assert out.count() == len(rows()) and out.columns == [c for c in evidence.columns if c not in ("text", "lang", "probability")] + ["lang", "probability"]
    assert {r.lang for r in out.collect()} == {"en"} and language.identify(evidence.limit(0), model).count() == 0
    tie = language.TextModel(("aa", "bb"), language.np.zeros((language.BUCKETS, 2)))
    assert {r.lang for r in language.identify(evidence, tie).collect()} == {"aa"}


def test_language_joins_many_hosts(spark, docs, monkeypatch):
    evidence = docs.selectExpr("doc_id", "text", "host", "cast(null AS string) AS declared", "lang AS suffix")
    model = language.fit_text(docs)
    want = sorted((r.doc_id or 0, r.lang, round(r.probability, 9)) for r in language.identify(evidence, model).collect())
    monkeypatch.setattr(language, "FEW", 0)
    assert sorted((r.doc_id or 0, r.lang, round(r.probability, 9)) for r in language.identify(evidence, model).collect()) == want


def test_near_dup(spark, docs):
    out = near_dup.jaccard_components(docs, k=3, percent=90).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (None, None): 2, (4, 4): 1, (5, 5): 2, (6, 5): 1, (7, 1): 2, (8, 8): 1, (9, 9): 1, (10, 10): 1})
    left = near_dup.keep_one(docs, k=5, percent=80)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.select("doc_id").collect()) == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 2, 8: 1, 9: 1, 10: 1})
    assert near_dup.jaccard_links(docs.limit(0)).count() == near_dup.keep_one(docs.limit(0)).count() == 0


def test_archives(spark):
    texts = [(i, t) for i, t in rows() if i != 4]
    big = "z" * 3_000_000
    pages = spark.createDataFrame([(i, None, t, "x") for i, t in texts] + [(50, "u", big, "x"), (51, "u", big, "x"), (51, "u", big, "x")], "page_id long, url string, html string, digest string").repartition(2)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.archive_round_trip(pages).collect())
    want = Counter((i, len((t or "").encode()), "response", None) for i, t in texts)
    assert got == want + Counter({(50, 3_000_000, "revisit", 51): 1, (51, 3_000_000, "response", None): 2})


def test_arc_files_are_converted(spark, tmp_path):
    import gzip

    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        data = archives.arc_version_block(version, "a.arc") + b"".join(archives.arc_record(version, f"http://x/{i}#page-{10 * version + i}", f"<p>{i}</p>".encode() * 400, 0, "a.arc") for i in range(5))
        (tmp_path / "arc" / f"{version}.arc").write_bytes(gzip.compress(data) if version == 2 else data)
    archives.convert_arc_files(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in archives.read_archives(spark, str(tmp_path / "warc")).collect()}
    assert got == {10 * v + i: (3200, hashlib.sha1(f"<p>{i}</p>".encode() * 400).hexdigest()) for v in (1, 2) for i in range(5)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    texts, labels = labelled(spark)
    frame(spark, rows() + texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {None, 1, 2, 4, 5, 8, 10} <= out and not out & {3, 6, 7, 100}
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
