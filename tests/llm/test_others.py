"""Secrets, urls, the classifier and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from rulespan.llm import cotrain, queries, secret_scan, url_filter
from rulespan.llm.common import Workspace


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, der(2, b"\0") + der(2, bytes(range(1, 100))) + der(0x30, der(2, b"\1" * 20)))


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), ('password = "hunter22"', "assign:0:20"), ("Token:abc", ""), ("token: ab secret: abcdef", "assign:10:24"), ("API_KEY=abcdef apikey='xyzxyz'", "assign:0:14,assign:15:29"),
    ("AKIA" + "A" * 16, "access:0:20"), ("AKIA" + "A" * 15, ""), ("é " + "0af" * 8, "hex:2:26"), ("0af" * 7, ""), ("ſecret=abcdef", ""),
])
def test_base_kinds(text, want):
    assert secret_scan.listed(secret_scan.spans(text)) == want


def test_structure_decides(token):
    kinds = lambda text: [secret_scan.KINDS[k] for _, k, _ in secret_scan.spans(text)]
    assert kinds(f"x {token} y") == ["signed"] and kinds("x eyJub3BlIjoxfQ.eyJhIjoxfQ.abc y") == []
    key = base64.b64encode(KEY).decode()
    assert kinds(key) == ["der64"] and kinds(KEY.hex()) == ["hex", "derhex"]
    assert kinds(base64.b64encode(KEY[:-1]).decode()) == [] and kinds((KEY[:-1]).hex()) == ["hex"]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key[:60]}\n{key[60:]}\n-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds(pem) and kinds(pem.replace(key[:60], "AAAA")) == []


def test_report_and_redact(cluttered, odd, odd_rows, empty, spark, token):
    got = secret_scan.report(cluttered).collect()
    assert len(got) == len(odd_rows) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if not r.spans)
    text = f"a password=abcdefgh {token} b secret: '{token}' end"
    assert secret_scan.redacted(text).startswith("a <secret> <secret> b <secret>") and token[:20] not in secret_scan.redacted(text)
    one = secret_scan.redact(spark.createDataFrame([(1, text, "en", "s", len(text), "z")], "doc_id long, text string, lang string, source string, n_chars long, extra string")).collect()[0]
    assert one.extra == "z" and one.n_chars == len(one.text) and "abcdefgh" not in one.text
    assert secret_scan.redact(cluttered).columns == cluttered.columns
    runs = "a" * 1500  # a hex run, so it goes
    assert Counter(r.text for r in secret_scan.redact(odd).collect()) == Counter("<secret>" if r[1] == runs else r[1] for r in odd_rows)
    assert secret_scan.report(empty).count() == secret_scan.redact(empty).count() == 0


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host = (rest[: cut.start()] if cut else rest).translate({c: c + 32 for c in range(65, 91)})
    path = re.split(r"[?#]", rest[cut.start() :])[0] if cut else ""
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def test_urls(spark, ws):
    page = '<html><head><link rel="canonical" href="{}"></head></html>'
    move = "<META http-equiv='Refresh' content='0; url={}'>"
    rows = [
        (1, "http://A.com/en/1", None), (2, "http://b.zz/x", page.format("http://a.com/en/1#top")), (3, "http://c.zz/y", move.format("http://b.zz/x")), (4, "http://d.zz/", page.format("http://x.example.com/en/7")),
        (5, "http://e.zz/", page.format("http://q.com/en/") + move.format("http://example.com/en/7")), (6, "http://f.net/de/8", page.format("http://q.com/en/5")), (7, None, "x"), (8, "no scheme", page.format("http://q.com/en/")), (9, "http://g.zz?u=http://q.com/en/", ""),
        (None, "http://b.zz/x", None), (1, "http://A.com/en/1", None), (10, "http://example.net/de/8", None), (11, "http://c.zz/y#frag", None), (12, "http://c.zz/y?q", None), (13, "http://h.org/es/", page.format("/relative")), (14, "://", None),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = url_filter.judge(docs, ws).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *rule_of(u)[:3]) for i, u, _ in rows)
    verdicts = {(r.page_id, r.host): r.verdict for r in got}
    own = {(i, rule_of(u)[0]): rule_of(u)[3] for i, u, _ in rows}
    assert all(verdicts[k] == v for k, v in own.items() if v)
    assert [verdicts[k] for k in ((2, "b.zz"), (None, "b.zz"), (3, "c.zz"), (11, "c.zz"))] == ["block"] * 4  # aliases of a blocked page
    assert [verdicts[k] for k in ((4, "d.zz"), (5, "e.zz"), (6, "f.net"), (7, ""), (8, ""), (9, "g.zz"), (12, "c.zz"), (14, ""))] == ["allow"] * 8
    assert url_filter.judge(docs.limit(0), ws).count() == 0


def test_classifier_on_held_out_documents(spark, ws):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        kind = i % 4  # 0 junk, 1 toxic, 2 and 3 good
        words = [f"word{rng.randrange(300)}" for _ in range(60)]
        if kind == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if kind == 1:
            words[5], words[30] = rng.choice(["idiot", "scum", "moron"]), rng.choice(["idiot", "scum", "moron"])
        docs.append((i, " ".join(words), "en", f"s{i % 5}", 400))
        if i < 500:
            labels.append((i, int(kind > 0), int(kind == 1)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in cotrain.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ws).collect()}
    new = [i for i in range(500, 900)]
    assert sum(got[i] == (i % 4 > 1) for i in new) / len(new) > 0.95


def test_classifier_shapes(spark, cluttered, odd, odd_rows, empty, ws):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.score(cluttered, none, ws).where("kept").count() == len(odd_rows)
    some = spark.createDataFrame([(3, 1, None), (3, 1, 0), (10, 0, 0), (11, 0, 1), (None, 1, 0), (9, None, 0), (5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.score(cluttered, some, ws).count() == len(odd_rows) and cotrain.score(empty, some, ws).count() == 0


def test_pipeline(spark, odd, empty, tmp_path):
    rng = random.Random(8)
    text = lambda n=120: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bench, keep = text(30), text()
    docs = [(1, keep), (2, keep), (3, keep.upper()), (4, f"{text()} {bench} {text()}"), (5, f"{text()} password=abcdefgh1 {text()}"), (6, "too short"), (7, text()), (8, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 5, 7}
    docs_now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == list(corpus_pipeline.COLUMNS), name
    left = {r.doc_id: r.text for r in docs_now.collect()}
    assert "abcdefgh1" not in left[5] and left[1] == keep
    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.count() >= 0


def test_every_operator_has_its_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(i) for i in range(1, 11)}


def test_workspace_reads_the_session_setting(spark):
    assert Workspace(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pipeline_drops_edited_copies(spark, tmp_path):
    rng = random.Random(31)
    docs = []
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range((200, 600, 1000)[group % 3])]
        docs.append((10 * group, " ".join(words)))
        for copy in range(1, 4):  # each replaced word takes five shingles out of either side
            other = list(words)
            for at in rng.sample(range(len(words)), copy * len(words) // 200):
                other[at] = f"new{rng.randrange(10**6)}"
            docs.append((10 * group + copy, " ".join(other)))
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, table, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {10 * g for g in range(12)}


def found(text, kind):
    return [text[a:b] for a, k, b in secret_scan.spans(text) if secret_scan.KINDS[k] == kind]


def lines(key, width, gap):
    return gap.join(key[i : i + width] for i in range(0, len(key), width))


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n    ", "\\n", "\\r\\n", " "])
@pytest.mark.parametrize("width", [64, 76])
def test_keys_over_line_breaks(gap, width):
    key = lines(base64.b64encode(KEY).decode(), width, gap)
    for text in (f"key: |\n    {key}\nnext: value", f'{{"key": "{key}"}}', f"x/{key}\nand more words"):
        assert found(text, "der64") == [key] and key[:30] not in secret_scan.redacted(text) and key[-30:] not in secret_scan.redacted(text)
    run = lines(KEY.hex().upper(), width, gap)
    assert found(f"k = {run}\nrest", "derhex") == [run]


def openssh(*parts):
    text = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + b"".join(text(p) for p in parts[:3]) + (1).to_bytes(4, "big") + text(parts[3]) + text(parts[4])


def test_keys_inside_a_run():
    key = base64.b64encode(KEY).decode()
    for before in ("key/", "priv-", "k", "AM", "MII", "0MIIE"):
        assert found(f"see {before}{key} end", "der64") == [key]
    assert found(f"{key.rstrip('=')}-tail", "der64") == [key.rstrip("=")] and found(f"{key[:-8]}-", "der64") == []
    for text in (KEY.hex(), KEY.hex().upper(), KEY.hex().title(), "3" + KEY.hex(), "0a1" + KEY.hex() + "ff"):
        assert len(found(text, "derhex")) == 1
    assert found(KEY.hex().upper()[:-2], "derhex") == []
    ssh = base64.b64encode(openssh(b"none", b"none", b"", b"\1" * 51, b"\2" * 136)).decode()
    for wrapped in (ssh, lines(ssh, 70, "\n")):
        assert found(f"id/{wrapped}\nwords after it", "der64") == [wrapped]


def test_encrypted_keys():
    scheme = lambda oid: der(0x30, der(6, bytes.fromhex(oid)) + der(0x30, der(4, b"saltsalt") + der(2, b"\x08\0")))
    locked = der(0x30, scheme("2a864886f70d01050d") + der(4, b"\7" * 96))
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + der(5, b"")) + der(4, b"\7" * 32))  # a signature's, no key
    body = base64.b64encode(locked).decode()
    pem = lambda kind, body: f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----"
    assert found(body, "der64") == [body] and found(base64.b64encode(digest).decode(), "der64") == []
    for text in (pem("ENCRYPTED PRIVATE KEY", lines(body, 64, "\n")), pem("ENCRYPTED PRIVATE KEY", lines(body, 64, "\n")).replace("\n", "\\n")):
        assert found(text, "pem") == [text]
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    cipher = lines(base64.b64encode(bytes(range(96))).decode(), 64, "\n")
    for text in (pem("RSA PRIVATE KEY", head + cipher), pem("RSA PRIVATE KEY", head + cipher).replace("\n", "\r\n"), pem("RSA PRIVATE KEY", head + cipher).replace("\n", "\\n")):
        assert found(text, "pem") == [text]
    assert found(pem("RSA PRIVATE KEY", cipher), "pem") == found(pem("RSA PRIVATE KEY", head + cipher[:-3]), "pem") == []


def test_token_after_a_failed_one(token):
    for before in ("eyJub3BlIjoxfQ.", "eyJub3BlIjoxfQ.eyJhIjoxfQ.", "eyJ.", "eyJx"):
        assert found(f"{before}{token} end", "signed") == [token]


def test_relative_and_escaped_links(spark, ws):
    page = '<link rel="canonical" href="{}">'
    move = "<meta http-equiv=refresh content='0; url={}'>"
    blocked, rows = "http://a.com/en/1?page=2&ref=x", []
    for i, (url, html) in enumerate([
        ("http://a.com/alias", page.format("/en/1?page=2&amp;ref=x")), ("https://b.zz/alias", move.format("//a.com/en/1?page=2&#38;ref=x")), ("http://a.com/de/y", page.format("../en/1?page=2&#x26;ref=x#top")),
        ("http://c.zz/y", page.format("http://a.com/en/1?page=2&amp;ref=x")), ("http://a.com/alias?q", page.format("?")), ("http://d.zz/dir/z", page.format("mailto:x@a.com")), ("http://d.zz/dir/w", page.format("z")),
        ("http://e.zz/x", page.format("http://[/en/")), ("http://e.zz/y", page.format("//[/en/")), ("http://f.zz/s/t", move.format("u?v=http://a.com/en/1")),
    ]):
        rows.append((i, url, html))
    docs = spark.createDataFrame([*rows, (99, blocked, None)], "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(docs, ws).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {0, 1, 2, 3, 99}
