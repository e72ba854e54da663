"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of documents. run() writes every stage's result to the shared
folder and reads it back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulespan.llm import decon, packing, quality, secret_scan, shingle_join
from rulespan.llm.common import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger rejects go."""
    return quality.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by five-word shingles at similarity 0.8 or more one stays.

    Links come from SimHash fingerprints through the pivot distance table, checked on whole texts;
    a join by shingles adds those that three bits of a fingerprint miss.
    """
    return shingle_join.keep_one(docs.select(*COLUMNS), Workspace(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decon.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by <secret>; every document stays."""
    return secret_scan.redact(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where it lies in which sequence."""
    return packing.pack(docs, Workspace(spark, "pipeline-packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle sets, token ids and packing are not SQL. tests/llm/test_others.py checks run()'s kept ids, a redaction and
#: that edited copies go; no test holds its sequences, offsets and lengths against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return ws.write(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
