"""Benchmark decontamination: prefix-filtered set join of item windows against documents.

Every item yields its windows of 10 consecutive words (shorter items: one window). A window
is a set of word shingles; containment must be whole, so the necessary prefix is its single
rarest shingle, rarity counted over all documents. Documents explode their shingles, join
those prefixes, and each hit is cut by position (the window would start before the text) and
length (it would end after it) and then verified word by word. DataFrame functions only.

Exploding, probing, bounding and verifying run in one code-generated stage over the scan:
document words are never shuffled, only verified hits are.

Defined results: null or empty texts and items have no words (no windows, nothing hit).
Rows are keyed by (doc_id, text), null ids included, so repeated rows repeat their result and
differing texts under one id stay apart. Item ids compare as strings; repeated items count
once. An empty benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SHINGLE = 10, 3
#: Rows of benchmark windows up to which the prefix index is broadcast (about 300 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 300_000


def words(text: str | Column) -> Column:
    """Lower-cased ASCII letters; words are runs of ASCII letters, digits and non-ASCII characters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), upper, lower)
    return F.array_remove(F.split(F.regexp_replace(flat, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), "")


def _shingles(k: int) -> str:
    """Hashes of the k-word shingles of w, in order."""
    return f"if(size(w) < {k}, cast(array() as array<bigint>), transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k}))))"


def windows(items: DataFrame) -> DataFrame:
    """(win: words, k, places: [(o, h)]) for every distinct window; k the shingle size it is indexed with."""
    w = items.select(words("text").alias("w")).where("size(w) > 0")
    win = w.select(F.explode_outer(F.expr(f"if(size(w) < {WINDOW}, array(w), transform(sequence(1, size(w) - {WINDOW - 1}), i -> slice(w, i, {WINDOW})))")).alias("w")).distinct()
    k = F.least(F.lit(SHINGLE), F.size("w"))
    places = F.expr(f"transform(case size(w) when 1 then {_shingles(1)} when 2 then {_shingles(2)} else {_shingles(3)} end, (h, o) -> struct(h as h, o as o))")
    return win.select(F.col("w").alias("win"), k.alias("k"), places.alias("places"))


def _exploded(docs: DataFrame, k: int) -> DataFrame:
    """One row a k-word shingle: key columns, the words w, place p, hash h (null if there is none).

    The outer form keeps Catalyst from inferring a filter on the array's size, which it would
    push below and inline the tokenizing into the lambda, once a word.
    """
    return docs.select("doc_id", "dig", "w", F.expr(_shingles(k)).alias("_h")).select("doc_id", "dig", "w", F.posexplode_outer("_h").alias("p", "h"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified occurrences (doc_id, dig, start, len, win), repeated ones removed."""
    base = docs.select("doc_id", F.xxhash64(F.col("text")).alias("dig"), words("text").alias("w"))
    win = windows(items).cache()
    try:
        counted = {r.k: r.n for r in win.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
        parts = [_hits(base, win.where(F.col("k") == k), k, sum(counted.values()) <= BROADCAST_ROWS) for k in sorted(counted)]
    finally:
        win.unpersist()
    if not parts:
        return base.select("doc_id", "dig", F.lit(0).alias("start"), F.lit(0).alias("len"), F.col("w").alias("win")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _hits(base: DataFrame, win: DataFrame, k: int, few: bool) -> DataFrame:
    """Occurrences of windows that are indexed by k-word shingles. few: their index may be broadcast."""
    near = F.broadcast if few else (lambda x: x)
    # Rarity: occurrences over all documents of every shingle that some window has.
    each = win.select("win", F.explode("places").alias("s")).select("win", "s.h", "s.o")
    seen = _exploded(base, k).select("h").join(near(each.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.join(near(seen), "h").groupBy("win").agg(F.min(F.struct("n", "h", "o")).alias("s"), F.count_distinct("o").alias("found"))
    # A window with a shingle that no document has occurs nowhere.
    prefix = ranked.where(F.col("found") == F.size("win") - (k - 1)).select(F.col("s.h").alias("h"), F.col("s.o").alias("o"), "win", F.size("win").alias("len"))
    start = F.col("p") - F.col("o")
    inside = (start >= 0) & (start + F.col("len") <= F.size("w"))  # position, length
    exact = F.expr("slice(w, greatest(p - o, 0) + 1, len)") == F.col("win")
    shown = ["doc_id", "dig", start.alias("start"), "len", "win"]
    if few:
        return _exploded(base, k).join(near(prefix), "h").where(inside & exact).select(*shown)
    # A large index is shuffled, and with it places alone; the candidates then meet each text once.
    found = _exploded(base, k).select("doc_id", "dig", "p", "h").join(prefix, "h").where(start >= 0)
    by_text = found.groupBy(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig")).agg(F.collect_set(F.struct("p", "o", "len", "win")).alias("c"))
    texts = base.dropDuplicates(["doc_id", "dig"])
    both = texts.join(by_text, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("dig") == F.col("_dig")))
    open_ = F.filter("c", lambda x: (x["p"] - x["o"] + x["len"] <= F.size("w")) & (F.slice("w", x["p"] - x["o"] + 1, x["len"]) == x["win"]))
    return both.select("doc_id", "dig", F.explode(open_).alias("x")).select("doc_id", "dig", (F.col("x.p") - F.col("x.o")).alias("start"), "x.len", "x.win")


def covered(spans: str) -> str:
    """SQL: how many places the sorted array of (start, len) covers."""
    return f"aggregate({spans}, struct(0L as n, 0L as e), (a, x) -> struct(a.n + greatest(0L, x.start + x.len - greatest(a.e, x.start)) as n, greatest(a.e, cast(x.start + x.len as bigint)) as e), a -> a.n)"


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, dig, n_hit, item_ids: sorted strings) of the documents with hits; dig is xxhash64(text)."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found = hits(docs.select("doc_id", "text"), items)
    w = items.select("item_id", words("text").alias("w")).where("item_id is not null and size(w) > 0")
    owner = w.select("item_id", F.explode_outer(F.expr(f"if(size(w) < {WINDOW}, array(w), transform(sequence(1, size(w) - {WINDOW - 1}), i -> slice(w, i, {WINDOW})))")).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("ids"))
    by_span = found.join(owner, "win", "left")
    # A document's spans and items are bounded by its own length, so one row holds them.
    return by_span.groupBy("doc_id", "dig").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").cast("bigint").alias("start"), F.col("len").cast("bigint").alias("len")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"),
    ).select("doc_id", "dig", F.expr(covered("spans")).alias("n_hit"), "item_ids")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of query op9_decontamination: one row a document."""
    base = docs.select("doc_id", "text")
    found = decontaminate(base, items).select(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig"), "n_hit", "item_ids")
    all_ = base.select("doc_id", F.xxhash64("text").alias("dig"), F.size(words("text")).cast("bigint").alias("n_words"))
    joined = all_.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("dig") == F.col("_dig")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated rows, same columns."""
    found = decontaminate(docs.select("doc_id", "text"), items).where("n_hit > 0").select(F.col("doc_id").alias("__rs_id"), F.col("dig").alias("__rs_dig"))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__rs_id")) & (F.xxhash64(docs["text"]) == F.col("__rs_dig")), "left_anti")


_W = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_W.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k.n, array_to_string(w[i:i+k.n-1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM win) k WHERE i + k.n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, range(0, 10) r(o) WHERE o < n GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
