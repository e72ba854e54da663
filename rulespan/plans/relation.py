"""A relation: a DataFrame whose columns have a position, a kind, and maybe a promise of no nulls."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RuleError
from ..functions.registry import SPARK, kind_of


@dataclass(frozen=True)
class Relation:
    df: DataFrame  # columns c0, c1, ...
    names: tuple[str, ...]  # as shown to users
    kinds: tuple[str, ...]
    non_null: tuple[bool, ...]
    is_set: bool  # rows are known to be distinct
    declared: bool = False  # names come from a schema declaration

    @property
    def width(self) -> int:
        return len(self.kinds)

    def distinct(self) -> Relation:
        return self if self.is_set else replace(self, df=self.df.distinct(), is_set=True)

    def named(self) -> DataFrame:
        return self.df.toDF(*self.names)


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def from_frame(df: DataFrame, non_null: bool = False, is_set: bool = False) -> Relation:
    """Any DataFrame: integers widen to long, floats and decimals to double, times become epoch milliseconds.

    non_null and is_set are promises about all columns and rows; they save null-safe join keys and a distinct.
    """
    out, kinds = [], []
    for i, f in enumerate(df.schema.fields):
        kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
        name = f.dataType.typeName()
        if name == "timestamp":
            c = F.unix_millis(c)
        elif name == "timestamp_ntz":
            c = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)  # no session time zone
        elif name == "date":
            c = F.unix_millis(c.cast("timestamp"))
        out.append(c.cast(SPARK[kind]).alias(f"c{i}"))
        kinds.append(kind)
    return Relation(df.select(*out), tuple(df.columns), tuple(kinds), (non_null,) * len(kinds), is_set)


def empty(spark: SparkSession, width: int, kinds: tuple[str, ...] | None = None) -> Relation:
    kinds = kinds or ("null",) * width
    df = spark.range(0).select(*[F.lit(None).cast(SPARK[k]).alias(f"c{i}") for i, k in enumerate(kinds)])
    return Relation(df, tuple(columns(width)), tuple(kinds), (False,) * width, True)


def unify(kinds: list[tuple[str, ...]], what: str) -> tuple[str, ...]:
    """One kind a column: null gives way, long and double make double, anything else must agree."""
    out = []
    for i, column in enumerate(zip(*kinds, strict=True)):
        found = set(column) - {"null"}
        if found == {"long", "double"}:
            found = {"double"}
        if len(found) > 1:
            raise RuleError(f"column {i + 1} of {what} mixes {', '.join(sorted(found))}")
        out.append(found.pop() if found else "null")
    return tuple(out)


def as_kinds(r: Relation, kinds: tuple[str, ...]) -> Relation:
    if r.kinds == kinds:
        return r
    df = r.df.select(*[F.col(f"c{i}").cast(SPARK[k]).alias(f"c{i}") for i, k in enumerate(kinds)])
    return replace(r, df=df, kinds=kinds)


def union(parts: list[Relation], what: str) -> Relation:
    """Set union of relations of one width."""
    if len({p.width for p in parts}) > 1:
        raise RuleError(f"{what} has parts of different arity")
    kinds = unify([p.kinds for p in parts], what)
    parts = [as_kinds(p, kinds) for p in parts]
    if len(parts) == 1:
        return parts[0].distinct()
    df = parts[0].df
    for p in parts[1:]:
        df = df.union(p.df)
    return Relation(df.distinct(), parts[0].names, kinds, tuple(all(p.non_null[i] for p in parts) for i in range(len(kinds))), True, parts[0].declared)
