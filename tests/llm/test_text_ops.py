"""Packing, deduplication, toxicity, secrets and the pipeline against brute force."""

import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import components
from netloom.llm import near_dup as nd
from netloom.llm import packing, secret_scans, tokens, toxicity
from netloom.llm.exact_dedup import drop_copies, mark_copies, misra_gries
from netloom.llm.hashing import BLOCK, word_hashes
from netloom.llm.session import durable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for x in sets[i]:
            common.update(seen[x])
            seen[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed=3, group=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(group):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
            words[r.randrange(120)] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 9, 12, 30, 400])))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "Same Words Here"), (2004, "same  words\nhere"), (2005, rows[0][1])]
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.jaccard_components(frame(spark, rows), k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, k, percent):
    rows = near_copies()
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = {i: sum(j != i and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    want = {i: (n, links[i], c) for i, (n, c) in brute_components(rows, k, percent).items()}
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in nd.jaccard_links(frame(spark, rows), k=k, percent=percent).collect()}
    assert got == want and sum(links.values()) > 2 * len(rows)


def test_large_keys_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = near_copies(5, 50)
    got = {r.doc_id: r.component_id for r in nd.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 90).items()}


def test_components_of_graphs_of_any_size(spark, monkeypatch):
    """In one task and in rounds: chains, hubs, loops, repeated edges and negative names; a forest that is begun anew loses nothing."""
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(-7, r.randrange(100, 130)) for _ in range(60)] + [(200, 200), (300, 301), (301, 300)]
    r.shuffle(edges)
    want = {i: 0 for i in range(41)} | {x: -7 for e in edges if e[0] == -7 for x in e} | {300: 300, 301: 300}
    frame_of = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for few in (1000, 10):
        monkeypatch.setattr(components, "FEW", few)
        assert {x.node: x.component for x in components.connected(frame_of).collect()} == want
    assert components.connected(frame_of.limit(0)).count() == 0
    batches = [pa.RecordBatch.from_pydict({"u": [x], "v": [y]}) for x, y in [(2, 1), (3, 2), (3, 1), (5, 4), (5, 3)]]
    assert sum(x.num_rows for x in components._thinned(iter(batches), 1)) == 5 and sum(x.num_rows for x in components._thinned(iter(batches), 9)) == 4


def test_stored_frames_leave_no_shuffle_files(spark):
    """What was shuffled for a frame goes when the frame is stored, not when the driver collects its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for d in blocks.localDirs() for _, _, names in os.walk(str(d)) for n in names if n.startswith("shuffle_")}
    before = files()
    durable(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_near_dup_keeps_one_and_survives_empty_tables(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    kept = nd.keep_one(docs.unionByName(docs.limit(0)), k=5, percent=80)
    want = {c for i, (_, c) in brute_components(rows, 5, 80).items()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert nd.jaccard_components(docs.limit(0)).count() == 0


def test_routing_is_complete():
    """Two sets at the threshold share a key, whatever differs."""
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(3, 400))
        u = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64))
        d = nd.most_different(2 * n, 90) // 2
        v = np.sort(np.concatenate([r.permutation(u)[: n - d], r.integers(0, 1 << 63, d, dtype=np.uint64)]))
        same = len(np.intersect1d(u, v))
        if 100 * same >= 90 * (len(np.union1d(u, v))):
            assert len(np.intersect1d(nd.group_keys(np.unique(u), 90), nd.group_keys(np.unique(v), 90)))


def test_tree_finds_all_points_within_the_bound():
    r = np.random.default_rng(1)
    points = r.poisson(3, (500, 256)).astype(np.uint8)
    points[250:] = np.clip(points[:250].astype(int) + (r.random((250, 256)) < 0.05), 0, 255)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = nd.CountTree(points, sizes)
    for q in range(0, 500, 37):
        low = np.minimum(points, points[q]).sum(axis=1, dtype=np.int64)
        assert sorted(tree.search(points[q], int(sizes[q]), 90)) == np.flatnonzero(low * 190 >= 90 * (sizes + sizes[q])).tolist()


def test_count_vectors_fold():
    items = np.random.default_rng(2).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    points = nd.Points([nd.count_vector(items), nd.count_vector(items[:600]), nd.count_vector(items[:20])])
    fine, coarse = points.rows(np.array([0]), 17)[0], points.folded(np.array([0, 1]), 256)
    assert fine.sum() == coarse[0].sum() == 100_000 and coarse[1].sum() == 600 and coarse.shape == (2, 256)
    assert (coarse[0] == fine.reshape(-1, 256).sum(axis=0)).all() and (coarse[0] == np.bincount((items & np.uint64(255)).astype(int))).all()
    both = points.overlap(np.array([0, 0, 1, 2]), np.array([0, 1, 2, 2]))
    assert both[0] == 100_000 and both[1] == np.minimum(*points.folded(np.array([0, 1]), 1024)).sum() >= 600 and both[2] >= 20 == both[3]
    same = np.arange(100, dtype=np.uint64) << np.uint64(5)  # 15 is the most that half a byte holds
    assert nd.Points([nd.count_vector(same)]).folded(np.array([0]), 64).sum() == 100


@pytest.mark.parametrize("percent", [80, 90])
def test_routing_is_complete_for_long_sets_too(percent):
    r = np.random.default_rng(percent)
    for n in (5, 17, 40, 300, 700, 2000, 5000):
        for _ in range(12):
            u = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(r.integers(0, len(u) - len(u) * percent // 100 + 1))
            most = (100 * (len(u) - gone)) // percent - len(u)  # so many more keep the Jaccard at the threshold
            v = np.sort(np.concatenate([r.permutation(u)[gone:], r.integers(0, 1 << 63, max(most, 0), dtype=np.uint64)]))
            same = len(np.intersect1d(u, v))
            if 100 * same >= percent * len(np.union1d(u, v)):
                assert len(np.intersect1d(nd.group_keys(u, percent), nd.group_keys(np.unique(v), percent)))


@pytest.mark.parametrize("percent", [80, 90])
def test_unlike_sets_share_no_keys(percent):
    """Empty groups give no keys, so sets without a common shingle don't meet."""
    r = np.random.default_rng(percent)
    keys = [nd.group_keys(np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), percent) for n in [*range(1, 60), 100, 300, 300, 301, 1000, 5000, 5001] for _ in range(5)]
    flat = np.concatenate([np.unique(x) for x in keys])
    assert len(np.unique(flat)) == len(flat)


def test_packed_keys_meet_across_batches():
    import pyarrow as pa

    r = np.random.default_rng(4)
    own = [np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(6)]
    words = [" ".join(f"w{x % 9973}" for x in o[:200].tolist()) for o in own]
    words = words + [words[0] + " tail", words[1] + " tail", words[2]]
    want: dict[int, set[int]] = defaultdict(set)
    made = [pa.RecordBatch.from_arrays([pa.array([w])], names=["text"]) for w in words]
    for w in words:
        items = nd.shingles(next(word_hashes(pa.array([w])))[1], 3)
        for x in nd._labels(nd.group_keys(items, 90), 4)[1].view(np.int64).tolist():
            want[x].add(nd.set_id(items))
    want = {(x, s) for x, sids in want.items() if len(sids) > 1 for s in sids}
    for parts in (made, [pa.Table.from_batches(made).combine_chunks().to_batches()[0]]):
        packed = list(nd._keys(iter(parts), 3, 90, 4))
        assert set(packed[0].column(0).to_pylist()) <= {0, 1, 2, 3}
        assert {x for b in nd._meeting(iter(packed)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)} == want != set()


def test_keys_with_more_pairs_than_the_forest_are_searched_again():
    import pyarrow as pa

    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i:], r.integers(0, 1 << 63, i, dtype=np.uint64)])) for i in range(4)]
    rows = pa.table({"key": [7] * 4 + [9] * 2, "low": [0] * 6, "high": [0] * 6, "side": [2] * 6, "sid": [0, 1, 2, 3, 0, 3], "comp": [0, 1, 2, 3, 0, 3], "n": [100] * 6, "counts": [nd.count_vector(sets[i]) for i in (0, 1, 2, 3, 0, 3)]})
    for parts in (rows.to_batches(), rows.to_batches(max_chunksize=3)):
        out = [x for b in nd._search(iter(parts), 80, True) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sum(not again for *_, again in out) == 3 and 7 in {a for a, _, again in out if again}
        assert {(a, b) for b_ in nd._search(iter(parts), 80, False) for a, b, again in zip(*(c.to_pylist() for c in b_.columns), strict=True)} == {(i, j) for i in range(4) for j in range(i + 1, 4)}


def test_keep_one_of_rows_that_share_an_id(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text), (1, text + " end"), (1, text), (2, text), (None, text + " z"), (None, "other words that nobody else has at all"), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in rows], "doc_id long, text string, _near_id string, id long, _near_row long").repartition(3)
    kept = nd.keep_one(docs, k=5, percent=80)
    out = kept.collect()
    assert kept.columns == docs.columns and Counter(r.doc_id for r in out) == {1: 1, None: 2, 7: 2}


def test_word_hashes_do_not_depend_on_blocks():
    import pyarrow as pa

    text = "Word " * (BLOCK // 4) + "tail"
    got = {i: h for i, h in word_hashes(pa.array([text, None, "word tail", "WORD"]))}
    assert len(got[0]) == BLOCK // 4 + 1 and len(got[1]) == 0
    assert got[0][0] == got[2][0] == got[3][0] and got[0][-1] == got[2][1]


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, None), (8, ""), (1, " a b"), (2, "x"), (None, "x"), (None, "only")]
    got = {(r.doc_id, r.text): r for r in mark_copies(frame(spark, rows)).collect()}
    assert got[5, "a  b"].keep_id == 3 and got[5, "a  b"].group_size == 3 and not got[5, "a  b"].kept and got[3, "a\tb"].kept
    assert got[7, None].group_size == 2 and got[1, " a b"].group_size == 1
    assert got[2, "x"].kept and not got[None, "x"].kept and got[None, "only"].kept
    left = drop_copies(frame(spark, rows + [(3, "a\tb")] * 40))
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 7] and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert mark_copies(frame(spark, rows).limit(0)).count() == 0


def test_heavy_hitters_do_not_change_results(spark):
    rows = [(i, f"t{i % 7}" if i % 3 else f"u{i}") for i in range(300)]
    few = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in mark_copies(frame(spark, rows), counters=2).collect()}
    many = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in mark_copies(frame(spark, rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert few == many == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}


def test_misra_gries_bound():
    import pyarrow as pa

    r = random.Random(2)
    stream = [r.choice("abc") if r.random() < 0.6 else str(r.random()) for _ in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(stream[a : a + 700])], names=["d"]) for a in range(0, 5000, 700)]
    out = next(misra_gries(iter(batches), 20)).to_pydict()
    true = Counter(stream)
    assert len(out["d"]) <= 20 and all(true[d] - 5000 / 21 <= n <= true[d] for d, n in zip(out["d"], out["n"], strict=True)) and set("abc") <= set(out["d"])


# --- packing -------------------------------------------------------------------------------------------------


def test_plan_equals_piecewise_best_fit():
    r = random.Random(4)
    for capacity in (10, 64, 2048):
        lengths = [r.randint(1, capacity) for _ in range(400)] + [capacity] * 5
        plan, bins = packing.best_fit_plan(Counter(lengths), capacity)
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, x in enumerate(free) if x >= n]
            if fits:
                free[min(fits, key=lambda i: (free[i], i))] -= n
            else:
                free.append(capacity - n)
        assert bins == len(free)
        used = defaultdict(list)
        for length, first, end, bin_, each, offset in plan:
            for k in range(first, end):
                used[bin_ + (k - first) // each].append((offset + (k - first) % each * length, length))
        for parts in used.values():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at <= capacity
        assert sum(map(len, used.values())) == len(lengths)


def test_pack_round_trip(spark):
    texts = ["", None, "Hello world. " * 700, "a  b\n\nc", "x" * 5000, "naïve <|endoftext|> text", "½ ² ok"] + [f"short text {i}" for i in range(40)]
    docs = frame(spark, list(enumerate(texts)))
    placed = packing.place(packing.pieces(docs, with_ids=True)).toPandas()
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        own = placed[placed.doc_id == i].sort_values("piece")
        ids = np.frombuffer(b"".join(own.ids), "<u4")
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids + [0]
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and (own.length.tolist()[1:] == [2048] * (len(own) - 1))
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, g in placed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() <= 2048
    built = packing.sequences(packing.place(packing.pieces(docs, with_ids=True)))
    assert built.agg(F.sum(F.length("ids"))).first()[0] == 4 * placed.length.sum()
    assert packing.pack(docs.limit(0)).count() == 0


# --- toxicity and secrets ------------------------------------------------------------------------------------


def test_machine_learns_interactions():
    """Two terms that are harmless alone and toxic together: additive weights can't tell, pairs can."""
    r = np.random.default_rng(0)
    terms = np.sort(r.integers(0, 1 << 63, 40, dtype=np.uint64))
    rows = [np.unique(r.integers(2, 40, 6)) for _ in range(900)]
    for i, x in enumerate(rows):
        rows[i] = np.unique(np.concatenate([x, [[0], [1], [0, 1]][i % 3]]))
    labels = np.array([1.0 if i % 3 == 2 else 0.0 for i in range(900)])
    machine = toxicity.fit_machine(rows, labels, terms, steps=400)
    score = lambda x: machine.score(terms[np.array(x)])
    assert score([0, 1]) > 0.7 > 0.5 > max(score([0]), score([1]))


def test_toxicity_held_out(spark):
    r = random.Random(6)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, " ".join(r.choice(clean) for _ in range(40)) + (" You IDIOT, you moron." if toxic else "")))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "Idiot! You moron, you.")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, known)
    got = {x.doc_id: x.score for x in toxicity.score(docs, machine).collect()}
    assert all((got[i] >= 0.7) == (i % 6 == 0) for i in range(600)) and got[1000] == got[1001] < 0.5 <= got[None]
    assert toxicity.score(docs, toxicity.train(docs, known.limit(0))).filter("score > 0.5").count() == 0
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_training_finds_pairs_that_are_neutral_alone(spark):
    """Toxic is only who says both of two words, and each alone is as toxic as any text."""
    r = random.Random(12)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        kind = i % 20  # of 20, 2 have both and are toxic, 12 have one, 3 are toxic for a word of their own: 5 toxic, and 2 of 8 with either
        extra = ["zork", "blib"] if kind < 2 else ["zork"] if kind < 8 else ["blib"] if kind < 14 else ["vrumpf"] if kind < 17 else []
        rows.append((i, " ".join(r.sample(plain, 12) + extra)))
        labels.append((i, 1, int(kind < 2 or 14 <= kind < 17)))
    docs = frame(spark, rows)
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    probe = {x.doc_id: x.score for x in toxicity.score(frame(spark, [(1, "waa zork wba blib"), (2, "waa zork wba"), (3, "waa blib wba"), (4, "waa vrumpf")]), machine).collect()}
    assert min(probe[1], probe[4]) >= 0.7 > 0.5 > max(probe[2], probe[3])


def test_pairs_equal_brute_force():
    r = np.random.default_rng(3)
    labels = (r.random(900) < 0.1).astype(float)
    rows = [np.unique(np.concatenate([r.integers(0, 30, 6), [30, 31] if y and r.random() < 0.5 else [30 + int(r.integers(2))]])) for y in labels]
    share, least, want = labels.mean(), toxicity.pair_gain(32), []

    def gain(at):
        n, t = len(at), labels[at].sum()
        return sum(a * np.log(a / b) for a, b in ((t, n * share), (n - t, n * (1 - share))) if a), n and t > n * share

    has = [np.array([i for i, x in enumerate(rows) if k in x]) for k in range(32)]
    for i in range(32):
        for j in range(i + 1, 32):
            joint, up = gain(np.intersect1d(has[i], has[j]))
            if up and joint - max(gain(has[i])[0], gain(has[j])[0]) >= least:
                want.append((i, j))
    assert want and sorted(toxicity.telling_pairs(rows, labels, 32, block=8)) == want


def test_forest_on_held_out_findings():
    rows = secret_scans.labelled_findings(1500, seed=99)
    x, y = np.array([secret_scans.features(*r[:3]) for r in rows]), np.array([r[3] for r in rows])
    p = secret_scans.predict(secret_scans.forest(), x) >= 0.5
    assert (p == y).mean() > 0.97


def test_secrets_are_found_and_replaced(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'see token = "{key}" here'), (2, f"commit {key} fixes it"), (3, "4465758382889437 4465758382889437"), (4, "Donaudampfschifffahrtsgesellschaft"), (5, None), (6, f'ß token = "{key}" and token = "{key[::-1]}"')]
    docs = frame(spark, rows)
    found = {(r.doc_id, r.start, r.length) for r in secret_scans.scan_secrets(docs).collect()}
    assert found == {(1, 13, 40), (6, 11, 40), (6, 66, 40)}
    cleaned = {r.doc_id: r for r in secret_scans.redact_secrets(docs).collect()}
    assert cleaned[1].text == 'see token = "[SECRET]" here' and cleaned[1].n_chars == len(cleaned[1].text)
    assert cleaned[2].text == rows[1][1] and cleaned[5].text is None and cleaned[6].text.count("[SECRET]") == 2


def test_letter_runs_and_short_assigned_values_reach_the_forest(spark):
    r = random.Random(3)
    letters = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20)) for _ in range(50)]
    texts = [f'the token = "{x}" is' for x in letters] + ['password = "s3cr3tPw9"', "x pwd=abc1x9 y", "token = None", "author: Smith", "words and wordy words", "getElementByIdentifier", "Donaudampfschifffahrtsgesellschaft"]
    found = defaultdict(set)
    for x in secret_scans.scan_secrets(frame(spark, list(enumerate(texts)))).collect():
        found[x.doc_id].add(texts[x.doc_id][x.start : x.start + x.length])
    assert sum(found[i] == {x} for i, x in enumerate(letters)) >= 48
    assert [found[i] for i in range(50, 57)] == [{"s3cr3tPw9"}, {"pwd=abc1x9"}, set(), set(), set(), set(), set()]


def test_candidates_take_linear_time():
    for text in ("=" * 400_000, "key=" * 100_000, "key: " * 100_000):
        assert len(secret_scans.candidates(text)) <= 100_000


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(8)
    rows = near_copies()
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows += [(3000 + i, " ".join(f"z{r.randrange(500)}" for _ in range(30)) + (" you idiot moron" if i % 5 == 0 else "")) for i in range(150)] + [(4000, f'all of this is my token = "{key}" ok'), (4001, f'all of this is my token = "{key}" ok')]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 3000 and i % 5 == 0)) for i, _ in rows if i < 4000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).toPandas()
    machine = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = {x.doc_id for x in toxicity.score(docs, machine).filter("score < 0.7").collect()}
    first = {}
    for i, t in sorted(rows):
        if i in clean:
            first.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), i)
    text = dict(rows)
    left = [(i, text[i]) for i in first.values()]
    left = [(i, text[i]) for i in sorted({c for _, c in brute_components(left, 5, 80).values()})]
    library = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    want = {}
    for i, t in left:
        t = (t or "").replace(key, "[SECRET]")
        want[i] = len(library.encode(t, add_special_tokens=False).ids) + 1
    assert out.groupby("doc_id").length.sum().to_dict() == want
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
