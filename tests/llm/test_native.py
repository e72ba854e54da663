"""Quality rules and decontamination against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from rulespan.llm import decon, quality


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_quality(odd, odd_rows, cluttered, empty):
    want = Counter()
    for i, t, *_ in odd_rows:
        m = measures(t)
        want[(i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    for docs in (odd, cluttered):
        got = quality.report(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert all(not r.kept for r in got if r.base_failed) and all(r.kept == (r.failed_bits == 0) for r in got)
    assert quality.report(empty).count() == 0


def test_policies_and_ablation(odd):
    led = quality.ledger(odd).cache()
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(led, "v1").collect()}
    bits = [r.failed for r in led.collect()]
    for i, rule in enumerate(quality.RULES):
        if rule in got:
            assert got[rule] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert led.where(quality.verdict("base")).count() >= led.where(quality.verdict("v1")).count()


def test_keep_agrees_with_the_ledger(odd, cluttered, empty):
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in quality.report(odd).where("kept").collect())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in quality.keep(odd).collect()) == want
    assert quality.keep(cluttered).columns == cluttered.columns and quality.keep(cluttered).count() == len(want)
    assert quality.keep(empty).count() == 0


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        wins = {tuple(iw[i : i + 10]) for i in range(max(len(iw) - 9, 1))} if iw else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    base = odd_rows[5][1].split()
    rows = [(9, " ".join(base[50:75])), (10, " ".join(base[60:70]).upper()), (2, "one"), (30, "x, Y"), (31, "éA SS"), (4, None), (5, ""), (6, "w1 w2 w3 not there"), (9, " ".join(base[50:75])), (None, "one")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(odd, odd_rows, cluttered, empty, items):
    rows, df = items
    named = [(i, t) for i, t in rows if i is not None]
    want = Counter((i, *hits(t, named)) for i, t, *_ in odd_rows)
    for docs in (odd, cluttered):
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decon.report(docs, df).collect())
        assert got == want
    clean = decon.clean(cluttered, df)
    assert clean.columns == cluttered.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decon.report(empty, df).count() == 0 and decon.report(odd, df.limit(0)).where("contaminated").count() == 0


def test_decontamination_beyond_the_broadcast_bound(odd, odd_rows, items, monkeypatch):
    monkeypatch.setattr(decon, "BROADCAST_ROWS", 0)
    rows, df = items
    want = Counter((i, hits(t, [(i, t) for i, t in rows if i is not None])[1]) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.n_hit) for r in decon.report(odd, df).collect()) == want
