"""A quality classifier by co-training two views of a document.

The content view sees which words (and word beginnings) a text has; the page view sees its
metadata and layout: language, source, length, lines, shares of symbols, digits, capitals,
repeated lines and words. Each is a logistic regression. After a first fit on labelled rows,
each round scores every unlabelled document with both views; each view's most confident
documents of either class, if calibrated odds make them sure enough, become pseudo-labelled
examples of the other view, which is fitted again. Odds of labelled rows from fits without their fold calibrate each view (Platt) and
weigh the two; then every document is scored.

A good document has quality 1 and is not toxic. The fit uses a bounded sample: at most SAMPLE
labelled rows by hash of their id and GROWTH pseudo-labels a class, view and round, chosen among all unlabelled documents. Everything else covers all
rows: features are made once for each and scored in every round. Features stay distributed;
only the sample's reach the driver.

Defined results: a null or empty text has no words; null language, source and length are
values of their own. Rows are scored one by one (repeated rows repeat their score, null ids
are kept and count as unlabelled); labels of one id are joined by their minimum quality and
maximum toxicity, null labels are ignored. With no or one-sided labels every score is 0.5 or
1 or 0 by the share of good labels and rows are kept if that is at least 0.5. Other columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_rows

SAMPLE = 8000  # labelled rows
GROWTH = 400  # pseudo-labels a class, view and round
ROUNDS = 2
CONTENT, PAGE = 1 << 18, 1 << 12  # feature spaces
SURE = 0.95  # calibrated probability that a pseudo-label needs
FOLDS = 3  # of labelled rows, for calibration
SEEN = 4  # training rows a feature must be in
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")


def content(text: str) -> list[int]:
    """Hashed distinct words and five-letter word beginnings."""
    words = set(WORD.findall(text.lower()))
    words |= {"^" + w[:5] for w in words if len(w) > 5}
    return list({zlib.crc32(w.encode()) % CONTENT for w in words})


def page(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hashed metadata and layout, numbers in steps."""
    lines = [x for x in text.split("\n") if x.strip()]
    words = text.split()
    size = max(len(text), 1)
    share = lambda x: int(20 * min(max(x, 0), 1))
    steps = {
        "lang": lang,
        "source": source,
        "size": None if n_chars is None else int(2 * np.log2(1 + max(n_chars, 0))),
        "lines": int(2 * np.log2(1 + len(lines))),
        "line": int(2 * np.log2(1 + size / max(len(lines), 1))),
        "word": int(2 * size / max(len(words), 1)),
        "symbols": share(5 * len(SYMBOLS.findall(text)) / size),
        "digits": share(5 * sum(map(text.count, "0123456789")) / size),
        "twice": share(1 - len(set(lines)) / max(len(lines), 1)),
        "distinct": share(len(set(words)) / max(len(words), 1)),
    }
    return list({zlib.crc32(f"{k}={v}".encode()) % PAGE for k, v in steps.items()})


def features(docs: DataFrame) -> DataFrame:
    """(u, doc_id, content, page: arrays of feature numbers); one pass over the texts."""

    def rows(u, ids, texts, langs, sources, sizes):
        for x in zip(u, ids, texts, langs, sources, sizes):
            yield x[0], x[1], content(x[2] or ""), page(x[2] or "", *x[3:])

    placed = docs.select(F.monotonically_increasing_id().alias("u"), "doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    return map_rows(placed, rows, {"u": "long", "doc_id": "long", "content": "array<int>", "page": "array<int>"}, pass_rows=512)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows joined, and the row of each."""
    sizes = [len(x) for x in lists]
    return (np.concatenate(lists) if sum(sizes) else np.empty(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)


def fit(lists: list[np.ndarray], y: np.ndarray, space: int, steps: int = 80, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a class-balanced logistic regression (last: intercept), by Adam on the whole sample."""
    at, row = _flat(lists)
    common = np.bincount(at, minlength=space) >= min(SEEN, max(1, len(y) // 10))
    keep = common[at]
    at, row = at[keep], row[keep]
    mass = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, m, v = np.zeros(space + 1), np.zeros(space + 1), np.zeros(space + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], minlength=len(y)) + w[-1]
        g = mass * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.concatenate([np.bincount(at, g[row], minlength=space), [g.sum()]]) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (v > 0)
    return w


def odds(lists: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    at, row = _flat(lists)
    return np.bincount(row, w[at], minlength=len(lists)) + w[-1]


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Logistic regression of y on the columns of z and an intercept (last), by damped Newton steps."""
    x = np.column_stack([z, np.ones(len(y))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (y - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def _scored(made: DataFrame, views: list[np.ndarray], columns: list[str]) -> DataFrame:
    """columns of made, and content_odds, page_odds of every row."""
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(c) for c in columns]
            for name, w in zip(("content", "page"), views):
                lists = b.column(name)
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                out.append(pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[at], minlength=len(sizes)) + w[-1]))
            yield pa.RecordBatch.from_arrays(out, [*columns, "content_odds", "page_odds"])

    return made.select(*columns, "content", "page").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", content_odds double, page_odds double")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _refit(lists: list[np.ndarray], y: np.ndarray, extra: dict[int, tuple[np.ndarray, int]], space: int, use: np.ndarray) -> np.ndarray:
    """A fit on the used labelled rows and the pseudo-labelled ones."""
    more = list(extra.values())
    return fit([lists[k] for k in np.flatnonzero(use)] + [x for x, _ in more], np.concatenate([y[use], [float(k) for _, k in more]]), space)


def score(docs: DataFrame, labels: DataFrame, ws: Workspace, rounds: int = ROUNDS, growth: int = GROWTH, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, content_score, page_score, score, kept), one row a document (query op8_quality_classifier)."""
    made = ws.write(features(docs), "features")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(((F.min("quality") > 0) & (F.max(F.coalesce("toxic", F.lit(0))) < 1)).cast("int").alias("good"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    rows = made.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("good", "content", "page", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")).toArrow()
    y = rows["good"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = F.lit(float(y.mean()) if len(y) else 0.5)
        return made.select("doc_id", share.alias("content_score"), share.alias("page_score"), share.alias("score"), (share >= threshold).alias("kept"))
    fold = rows["fold"].to_numpy()
    views, spaces = (_arrays(rows["content"]), _arrays(rows["page"])), (CONTENT, PAGE)
    extra: list[dict[int, tuple[np.ndarray, int]]] = [{}, {}]  # of each view: u -> (features, pseudo-label)
    def calibrated() -> np.ndarray:
        """Odds of labelled rows, each from fits without its fold."""
        z = np.zeros((len(y), 2))
        for f in range(FOLDS):
            held = fold == f
            if held.any() and len(set(y[~held])) == 2:
                for i in (0, 1):
                    z[held, i] = odds([views[i][k] for k in np.flatnonzero(held)], _refit(views[i], y, extra[i], spaces[i], ~held))
        return z

    everything = np.ones(len(y), bool)
    weights = [fit(views[i], y, spaces[i]) for i in (0, 1)]
    z = calibrated()
    for _ in range(rounds):
        # Scores alone meet the labels: features stay where they were written.
        scored = ws.write(_scored(made, weights, ["u", "doc_id"]).join(known.select("doc_id"), "doc_id", "left_anti"), "scored")
        for mine, other, column in ((0, 1, "content_odds"), (1, 0, "page_odds")):
            slope, level = platt(z[:, mine : mine + 1], y)
            if slope <= 0:
                continue  # a view that tells nothing teaches nothing
            for label, order, sure in ((1, F.desc(column), 1), (0, F.asc(column), -1)):
                confident = sure * (float(slope) * F.col(column) + float(level)) >= float(np.log(SURE / (1 - SURE)))
                best = scored.where(confident).orderBy(order, "u").limit(growth).select("u")  # distributed top rows
                found = made.join(F.broadcast(best), "u").select("u", ("content", "page")[other]).toArrow()
                for u, x in zip(found["u"].to_pylist(), _arrays(found.column(1))):
                    extra[other].setdefault(u, (x, label))
        weights = [_refit(views[i], y, extra[i], spaces[i], everything) for i in (0, 1)]
        z = calibrated()
    (a, a0), (b, b0), (c, d, e) = platt(z[:, :1], y), platt(z[:, 1:], y), platt(z, y)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    out = _scored(made, weights, ["doc_id"])
    s = logistic(float(c) * F.col("content_odds") + float(d) * F.col("page_odds") + float(e))
    return out.select("doc_id", logistic(float(a) * F.col("content_odds") + float(a0)).alias("content_score"), logistic(float(b) * F.col("page_odds") + float(b0)).alias("page_score"), s.alias("score"), (s >= threshold).alias("kept"))
