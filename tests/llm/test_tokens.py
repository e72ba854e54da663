"""Token files, counts, order and packing: exact round trips and the library's own encoding."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rulespan.llm import packing, token_counts, training_order
from rulespan.llm.common import Workspace
from rulespan.llm.flat import Writer, read_range
from rulespan.llm.tokens import TOKENIZER, chunks

PLAIN = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("form", ["%s", "x%s", "%sx", "a%s, b", "a %s. b", "a%s.", "A%s,", "a,%s b", "a%s'S b", "\u00e9%s, B", "a%s%s. b"])
def test_ids_of_every_low_character(form):
    for i in range(0x250):
        text = form.replace("%s", chr(i))
        assert array("I", chunks().ids([text])[0]).tolist() == plain(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aBé'.,_-1 \n\t<|>%ßİΣẞ́ ", max_size=60) | st.sampled_from(["<|endoftext|> Hello<|startoftext|>.", "a.b, c.\nd%%%. e_. f,, g", "don't I'LL 'S"]))
def test_ids_equal_the_library(text):
    assert array("I", chunks().ids([text])[0]).tolist() == plain(text)


def test_ids_after_the_cache_is_trimmed(monkeypatch):
    c = chunks()
    monkeypatch.setattr(c, "limit", 900)
    for text in ("One two, three. FOUR five", "six seven. eight", "one TWO nine"):
        assert array("I", c.ids([text, None, ""])[0]).tolist() == plain(text)


def test_packing(odd, odd_rows, cluttered, empty, ws):
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = plain(t or "") + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[i, k, a, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    for docs in (odd, cluttered):
        got = packing.pack(docs, ws).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        fits(got)
    assert packing.pack(empty, ws).count() == 0


def fits(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30), st.integers(1, 12))
def test_plan_places_every_piece_once(histogram, groups):
    plan = packing.plan(histogram, 64, groups)
    used, numbers = defaultdict(list), defaultdict(list)
    for length, lo, n, sequence, offset in plan.tolist():
        numbers[length] += range(lo, lo + n)
        for i in range(n):
            used[sequence + i].append((offset, length))
    assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    histogram = Counter(min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(50_000))
    plan = packing.plan(histogram)
    used = {int(s) + i for _, _, n, s, _ in plan for i in range(int(n))}
    bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert len(used) <= bound * 1.003 + 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    every = np.arange(n)
    slots = training_order.permute(every, n, key=9)
    assert sorted(slots.tolist()) == every.tolist()
    assert training_order.permute(slots, n, key=9, inverse=True).tolist() == every.tolist()
    assert n < 1000 or (slots != training_order.permute(every, n, key=10)).mean() > 0.9


def test_shards_round_trip(spark, odd, odd_rows, cluttered, empty, ws):
    for k, docs in enumerate((odd, cluttered)):
        own = Workspace(spark, "order")
        folder = f"{own.root}/shards"
        got = training_order.materialise(docs, own, length=64, per_shard=16, partitions=(3, 50_000)[k]).collect()
        n = len(got)
        assert sorted(r.slot for r in got) == list(range(n))
        stream = defaultdict(dict)
        for r in got:
            data = read_range(f"{folder}/{r.shard}", r.byte_offset, 128)
            assert zlib.crc32(data) == r.ids_crc32 and r.byte_offset % 128 == 0 and r.byte_offset < 16 * 128
            stream[r.task][r.nth] = data
        files = sorted((r.shard, r.byte_offset, r.slot) for r in got)
        assert [x[2] for x in files] == list(range(n))  # files in name order hold the slots in order
        numbered = sorted(got, key=lambda r: (r.task, r.nth))  # as the scan made them
        slots = np.array([r.slot for r in numbered])
        assert slots.tolist() == training_order.permute(np.arange(n), n).tolist()
        assert training_order.permute(slots, n, inverse=True).tolist() == list(range(n))
        assert all(r.shard == f"shard-{r.slot // 16:09d}.bin" and r.byte_offset == r.slot % 16 * 128 for r in got)
        ids = np.frombuffer(b"".join(s[i] for _, s in sorted(stream.items()) for i in range(len(s))), "<u2")
        want = Counter(tuple(training_order.encode(t).tolist()) for _, t, *_ in odd_rows)
        cuts = np.split(ids, np.flatnonzero(ids == training_order.END) + 1)
        found = Counter(tuple(c.tolist()) for c in cuts if len(c))
        found[training_order.END,] = want[training_order.END,]  # fillers look like empty documents
        assert found == want
    assert training_order.materialise(empty, ws).count() == 0


@pytest.mark.parametrize("block", [2, 64, 4 << 20])
def test_counts(spark, odd, odd_rows, empty, ws, block):
    folder = f"{ws.root}/flat"
    listed = ws.write(token_counts.write(odd, folder), "listed")
    files = listed.where("ordinal = -1").select("file", "size")
    if block == 2:  # a block an id: only the short documents' files
        w = Writer(f"{folder}/tiny.bin")
        ids = np.array([5, 6, 9, 9, 7, 9], "<u2")
        w.write(ids.tobytes())
        w.commit()
        files = spark.createDataFrame([("tiny.bin", 12)], "file string, size long")
        got = {(r.ordinal, r.n_tokens) for r in token_counts.counts(files, folder, ws, end=9, block=2).collect()}
        assert got == {(0, 2), (1, 0), (2, 1)}
        assert token_counts.tails(files, folder, ws, end=7, block=2).collect()[0].n_tokens == 1
        return
    found = token_counts.counts(files, folder, ws, block=block)
    got = Counter((r.doc_id, r.n_tokens) for r in listed.where("ordinal >= 0").select("doc_id", "file", "ordinal").join(found, ["file", "ordinal"]).collect())
    assert got == Counter((i, len(training_order.encode(t)) - 1) for i, t, *_ in odd_rows)


def test_report_shapes(spark, cluttered, odd_rows, empty, ws):
    assert token_counts.report(spark, cluttered, ws).count() == len(odd_rows)
    assert token_counts.report(spark, empty, Workspace(spark, "none")).count() == 0
