"""Name -> arity and builder of a scalar function.

A builder gets typed columns and gives one. Kinds are long, double, string, boolean, vec
(array<float>), vec8 (array<tinyint>) and null. Wrong kinds give a null column, as the data
model has it; wrong arity is an error. Unless said otherwise everything is built-in Spark
expressions, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError
from ..plans import parser


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    @property
    def numeric(self) -> bool:
        return self.kind in ("long", "double")


SPARK = {"long": "bigint", "double": "double", "string": "string", "boolean": "boolean", "vec": "array<float>", "vec8": "array<tinyint>", "null": "void"}


def kind_of(t: T.DataType) -> str:
    """The kind of a Spark type; integers, timestamps and dates are long, decimals double."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.TimestampType | T.TimestampNTZType | T.DateType):
        return "long"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "double"
    if isinstance(t, T.StringType | T.VarcharType | T.CharType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "vec8" if isinstance(t.elementType, T.ByteType) else "vec"
    if isinstance(t, T.NullType):
        return "null"
    raise RuleError(f"no kind for {t.simpleString()}")


def null(kind: str) -> Typed:
    return Typed(F.lit(None).cast(SPARK[kind]), kind)


Builder = Callable[..., Typed]
REGISTRY: dict[str, tuple[int, int | None, Builder]] = {}


def register_function(name: str, builder: Builder, least: int, most: int | None = -1) -> None:
    """Adds a function of least to most arguments (most: the same if -1, open if None)."""
    REGISTRY[name] = (least, least if most == -1 else most, builder)
    parser.FUNCTION_NAMES.add(name)


def function(least: int, most: int | None = -1, name: str = "") -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        register_function(name or f.__name__.rstrip("_"), f, least, most)
        return f

    return add


def takes(kinds: str, result: str, name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Registers f(columns) with fixed kinds (blank-separated; `num` is long or double as double, `ts` a long); others give null."""
    wanted = kinds.split()

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        def build(*args: Typed) -> Typed:
            columns = []
            for a, k in zip(args, wanted):
                if k == "num":
                    if not a.numeric:
                        return null(result)
                    columns.append(a.column.cast("double"))
                elif a.kind != {"ts": "long"}.get(k, k):
                    return null(result)
                else:
                    columns.append(a.column)
            return Typed(f(*columns), result)

        register_function(name, build, len(wanted))
        return f

    return add


def call(name: str, args: list[Typed]) -> Typed:
    if name not in REGISTRY:
        raise RuleError(f"no function {name}")
    least, most, build = REGISTRY[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise RuleError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} argument(s), not {len(args)}")
    return build(*args)
