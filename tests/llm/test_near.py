"""SimHash, components and suffix dedup against brute force."""

import hashlib
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from rulespan.llm import sais, shingle_join, simhash, suffix_dedup
from rulespan.llm.components import components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(values):
    label = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def expected(rows):
    fps = [fingerprint(r[1]) for r in rows]
    label = groups(fps)
    low = {}
    for r, g in zip(rows, label):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return Counter((r[0], f"{f:016x}", low.get(g)) for r, f, g in zip(rows, fps, label)), label


def test_near_duplicates(odd, odd_rows, cluttered, empty, ws):
    want, _ = expected(odd_rows)
    for docs in (odd, cluttered):
        assert Counter(map(tuple, simhash.near_duplicates(docs, ws).collect())) == want
    assert simhash.near_duplicates(empty, ws).count() == 0


def test_keep_one(cluttered, odd_rows, empty, ws):
    _, label = expected(odd_rows)
    kept = simhash.keep_one(cluttered, ws).collect()
    assert len(kept) == len(set(label)) and simhash.keep_one(cluttered, ws).columns == cluttered.columns
    best = {}
    for r, g in zip(odd_rows, label):
        if r[0] is not None:
            best[g] = min(best.get(g, r[0]), r[0])
    assert Counter(r.doc_id for r in kept) == Counter(best.get(g) for g in set(label))
    assert simhash.keep_one(empty, ws).count() == 0


@pytest.mark.parametrize("tile", [2048, 4])
def test_links_give_the_components_of_all_pairs(spark, ws, tile):
    rng = random.Random(tile)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:10]:  # dense clusters and chains
        for _ in range(12):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), ws, tile)
    roots = {r.node: r.root for r in components(ws.write(edges, "e"), ws).collect()}
    want = groups(fps)
    got = [roots.get(f, f) for f in signed]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_components(spark, ws):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(60)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()} == label
    assert components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.lists(st.sampled_from([0, 1, 2]), min_size=1, max_size=80).map(bytes))
def test_suffix_array_and_prefixes(data):
    raw = np.frombuffer(data, np.uint8)
    sa = sais.suffix_array(np.concatenate([raw.astype(np.int64) + 1, [0]]), 257)[1:].tolist()
    assert sa == sorted(range(len(data)), key=lambda i: data[i:])
    shared = sais.common_prefixes(raw, np.array(sa))
    for a, b in zip(sa, sa[1:]):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert shared[b] == n


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        spans = suffix_dedup.removed_spans([(i, i) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1], window)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        out.append((doc, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [128, 1])
def test_suffix_dedup(odd, odd_rows, ws, hot):
    assert Counter(map(tuple, suffix_dedup.dedup(odd, ws, hot=hot).collect())) == brute(odd_rows, 400)


@pytest.mark.parametrize("hot", [128, 1])
def test_passages_in_many_contexts(spark, ws, hot):
    """A passage a little longer than the window, and one with few differing surroundings, in many texts."""
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    one, two = text(90)[:430], text(200)[:900]
    rows = [(i, f"{text(rng.randrange(40))} {one} {text(rng.randrange(40))}" + (f"{'ab'[i % 2] * 3}{two}{'cd'[i // 2 % 2] * 5}" if i % 3 else "")) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.dedup(docs, ws, hot=hot).collect())) == brute(rows, 400)


def test_suffix_dedup_shapes(cluttered, odd_rows, empty, ws):
    assert Counter(map(tuple, suffix_dedup.dedup(cluttered, ws).collect())) == brute(odd_rows, 400)
    assert suffix_dedup.dedup(empty, ws).count() == 0


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(3)
    data = "".join(rng.choice("abcdefgh ") for _ in range(3000)).encode()
    data = data + data[500:1400]
    found, _ = suffix_dedup.survey(data)
    covered = sorted(s for f in found.values() for s in range(f[1], f[2] + 1))
    assert len(covered) <= len(data) - 399 and covered[0] == 0 and covered[-1] == len(data) - 400 or len(found) < len(covered)


def five_words(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def alike_groups(texts):
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and 9 * len(a & b) >= 4 * (len(a) + len(b)) and bool(a) == bool(b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("common", [False, True])
def test_shingle_join_finds_every_near_copy(spark, ws, odd_rows, monkeypatch, common):
    if common:  # a boilerplate passage of most texts goes last in the order
        monkeypatch.setattr(shingle_join, "SAMPLE", 1)
        monkeypatch.setattr(shingle_join, "COMMON", 5)
    rng = random.Random(21)
    plate = [f"plate{i}" for i in range(60)]
    docs = [(r[0], r[1]) for r in odd_rows]
    for n in (8, 40, 200, 600, 1000):
        for _ in range(4):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)] + plate
            for k in (0, 1, 2, 4, n // 60, n // 50, n // 40, n // 20):  # similarities on both sides of 0.8
                docs.append((1000 + len(docs), " ".join(edited(rng, words, k))))
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    label = alike_groups([t for _, t in docs])
    best = {}
    for (i, _), g in zip(docs, label):
        if i is not None:
            best[g] = min(best.get(g, i), i)
    kept = shingle_join.keep_one(df, ws).collect()
    assert 5 < len(set(label)) < len(docs) - 50
    assert Counter(r.doc_id for r in kept) == Counter(best.get(g) for g in set(label))
    assert shingle_join.keep_one(df.limit(0), ws).count() == 0


def test_components_on_the_driver(spark, ws):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(60)] + [(7, 7), (None, 3), (-5, 9000)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {r.node: r.root for r in components(df, ws).collect()}
    for small in (1000, 10):  # the latter is too few, so Spark settles it
        assert {r.node: r.root for r in components(df, ws, small=small).collect()} == want
    assert components(df.limit(0), ws, small=10).count() == 0


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_near_copies_leave_no_disk_in_use(spark, ws):
    tidy, before = ws.tidy(), shuffle_files(spark)
    counts = tidy.write(spark.range(5000).selectExpr("id % 50 as k").groupBy("k").count(), "counts")
    for _ in range(50):  # the files go a moment later
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and counts.count() == 50
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(5)]
    docs = spark.createDataFrame([(10 * i + k, " ".join(edited(rng, t, k))) for i, t in enumerate(texts) for k in range(4)], "doc_id long, text string")
    kept = shingle_join.keep_one(docs, ws)
    assert not {"marked", "shared", "sets", "texts", "placed0"} & set(os.listdir(ws.root.removeprefix("file://")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40]


def test_near_copies_go_through_the_pivot_table(spark, ws, monkeypatch):
    """Every text's SimHash fingerprint; what they link is compared first."""
    rng, seen, links = random.Random(9), set(), simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *a: seen.update(r.fp for r in distinct.collect()) or links(distinct, *a))
    base = [[f"w{rng.randrange(5000)}" for _ in range(800)] for _ in range(6)]
    texts = [" ".join(edited(rng, b, k)) for b in base for k in (0, 0, 1, 1, 1, 2)] + [None, "", "one"]
    kept = shingle_join.keep_one(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ws)
    assert {x % 2**64 for x in seen} == {fingerprint(t) for t in texts}
    fps = [fingerprint(t) for t in texts[:36]]
    assert any((fps[i] ^ fps[j]).bit_count() <= 3 and texts[i] != texts[j] for i in range(36) for j in range(i)) and ws.read("near0").count()
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6, 12, 18, 24, 30, 36, 38]


def tile_rows(sets, key=(7, 0)):
    """Rows of one tile, each of a component of its own."""
    n = len(sets)
    sets = [np.sort(np.array(s, np.uint64)) for s in sets]
    columns = {"key": pa.array([key[0]] * n, pa.int64()), "tile": pa.array([key[1]] * n, pa.int32()), "chunk": pa.array([0] * n, pa.int32()), "own": pa.array(np.ones(n, bool))}
    columns |= {"fp": pa.array(range(n), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "root": pa.array(range(n), pa.int64())}
    columns |= {"bits": pa.array([shingle_join.sketch(s) for s in sets], pa.binary()), "s": shingle_join._lists(sets)}
    return pa.RecordBatch.from_pydict(columns)


def made(step, *batches):
    return [p for b in step(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]


def test_a_tile_makes_no_more_rows_than_it_reads():
    """Many texts just under the limit of one another: a forest, not all 1,770 pairs."""
    rng = random.Random(8)
    core = [rng.getrandbits(64) for _ in range(140)]
    below = [core[:133] + [rng.getrandbits(64) for _ in range(17)] for _ in range(60)]
    assert 50 <= len(made(shingle_join._in_tiles, tile_rows(below))) <= 59
    assert made(shingle_join._at_limit, tile_rows(below)) == []
    above = [core + [rng.getrandbits(64) for _ in range(10)] for _ in range(60)]
    found = made(shingle_join._at_limit, tile_rows(above))
    assert len(found) == 59 and {x for p in found for x in p} == set(range(60))
    halves = tile_rows(below[:30]), tile_rows(above[:30], (7, 1))  # two tiles of the same rows' numbers
    assert len(made(shingle_join._at_limit, *halves)) == 29


def test_sketches_grow_with_the_text():
    """Long texts of five common shingles are ruled out by sketches; like ones of two sketch lengths are not."""
    rng = random.Random(6)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    plate = draw(5)
    assert made(shingle_join._in_tiles, tile_rows([plate + draw(3000) for _ in range(12)])) == []
    for n in (500, 1000, 2000, 4000, 16000):
        base = draw(n)
        pair = tile_rows([base, base[: n - n // 25] + draw(n // 10), draw(n)])
        assert [sorted(p) for p in made(shingle_join._in_tiles, pair)] == [[0, 1]]
        assert made(shingle_join._at_limit, pair) == [(0, 1)]


def test_one_key_for_each_set_of_texts(spark):
    rows = [(1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 11, 5), (3, 10, 5), (3, 11, 5), (3, 12, 5), (4, 11, 5), (4, 12, 5), (-9, 11, 5), (-9, 12, 5)]
    found = shingle_join.one_key_a_set(spark.createDataFrame(rows, "key long, fp long, n int")).collect()
    assert sorted((r.key, r.fp) for r in found) == [(-9, 11), (-9, 12), (1, 10), (1, 11), (3, 10), (3, 11), (3, 12)]


def test_classes_in_many_tiles_lose_no_near_copy(spark, ws, monkeypatch):
    """Groups around the limit, settled by the tiles alone, with chunks by rows and by shingles."""
    monkeypatch.setattr(shingle_join, "ROUNDS", 0)
    monkeypatch.setattr(shingle_join, "WEIGHT", 4000)
    rng, texts = random.Random(12), []
    for n in (120, 150, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(edited(rng, base, max(1, round(n * rng.choice((0.01, 0.013, 0.018, 0.025)))))) for _ in range(16)]
    label = alike_groups(texts)
    assert 5 < len(set(label)) < 40
    kept = shingle_join.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws, tile=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
