"""Quality rules as a bitmask ledger: measure once, judge many times.

ledger() reads each text once and stores measurements and one failure bit a rule. A policy
is a named, versioned set of rules; verdicts, policy changes and ablations are bit
operations over the ledger and never read text again. DataFrame functions only.

Defined results: a null or empty text has no words, so it fails too_few_words. Rows are
judged one by one: repeated rows repeat their result, a null doc_id stays null, other
columns are ignored, an empty table gives an empty ledger. Text length is bounded by what
one row may hold; the work on a text of n words grows as n, or n log n if windows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule -> failing condition over the measurements, in bit order. Append only: old ledgers stay valid.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
# Policy version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols", "duplicate_lines", "word_length"),
}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in rules)


def _measures(text: str) -> str:
    """SQL for the struct of measurements. One-element arrays bind a value once inside a lambda."""
    blank = r"'\t\n\u000B\u000C\r'"
    # h: window hashes; only where some repeat are they sorted with their places.
    repeated = f"""element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))),
        s -> element_at(transform(array(array_sort(transform(filter(s, (e, j) ->
                (j > 0 and s[j - 1].x = e.x) or (j < size(s) - 1 and s[j + 1].x = e.x)), e -> e.i))),
            p -> aggregate(transform(p, (x, j) -> if(j = size(p) - 1, {WINDOW}, least({WINDOW}, p[j + 1] - x))), 0L, (a, x) -> a + x)), 1)), 1)"""
    words = f"""struct(
        cast(size(w) as bigint) as n_words,
        if(size(w) <= {WINDOW}, 0L, element_at(transform(
            array(transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW})))),
            h -> if(size(array_distinct(h)) = size(h), 0L, {repeated})), 1)) as n_repeat_words)"""
    return f"""struct(
        element_at(transform(array(array_remove(split(translate({text}, {blank}, '     '), ' '), '')), w -> {words}), 1) as w,
        element_at(transform(array(filter(split({text}, '\\n'), l -> translate(l, ' \\t\\u000B\\u000C\\r', '') <> '')),
            l -> struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines)), 1) as l,
        cast(length(translate({text}, concat(' ', {blank}), '')) as bigint) as word_chars,
        cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as bigint) as n_symbols)"""


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed: bigint bitmask over RULES)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select("doc_id", F.expr(_measures("_t")).alias("_m"))
    flat = base.select("doc_id", "_m.w.*", "_m.l.*", "_m.word_chars", "_m.n_symbols")
    return flat.select("doc_id", *MEASURES, _bits().alias("failed"))


def _bits() -> Column:
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return bits


def verdict(policy: str = "v1", failed: str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """docs, same columns, without rows that the policy rejects; no shuffle."""
    m = "__rulespan_quality"
    measured = docs.withColumn(m, F.expr(_measures(f"coalesce(`{text_col}`, '')")))
    flat = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "word_chars": "word_chars", "n_symbols": "n_symbols"}
    good = F.lit(True)
    for rule in POLICIES[policy]:
        condition = " ".join(f"{m}.{flat[x]}" if x in flat else x for x in RULES[rule].split())
        good = good & ~F.expr(condition)
    return measured.where(good).drop(m)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows failing it, and rows that only it rejects. One small aggregate."""
    m = mask(POLICIES[policy])
    rules = [(i, r) for i, r in enumerate(RULES) if m >> i & 1]
    by_bits = led.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in rules])).alias("r")
    return (
        by_bits.select("bits", "n", one).select("r.rule", "bits", "n", "r.bit")
        .groupBy("rule").agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def report(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The digest of query op5_quality_rules."""
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("bigint")) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict(policy)).alias("kept"), F.col("failed").alias("failed_bits"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM pos),
hot AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hot, range(0, 8) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
       CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
       + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits FROM b
"""
