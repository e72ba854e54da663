"""Statements as values. Terms are frozen, so rules compare and hash by structure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Wild:
    """`_`: a fresh variable each time."""

    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class Const:
    """An int, float, str, bool or a tuple of floats (a vector)."""

    value: object

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(self.value, bool):
            return str(self.value).lower()
        return str(list(self.value)) if isinstance(self.value, tuple) else str(self.value)


@dataclass(frozen=True)
class Arith:
    op: str
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Agg:
    """Simple: one variable. Ranking: params are k, threshold or radius; order names the ordering variable."""

    name: str
    vars: tuple[Var, ...]
    params: tuple[float, ...] = ()
    order: str | None = None
    descending: bool = True

    def __str__(self) -> str:
        shown = [str(p) for p in self.params]
        shown += [f"{v}:{'desc' if self.descending else 'asc'}" if self.params and v.name == self.order else str(v) for v in self.vars]
        return f"{self.name}<{', '.join(shown)}>"


Term = Var | Wild | Const | Arith | Call | Agg
RANKING = ("top_k", "top_k_threshold", "within_radius")
SIMPLE = ("count", "count_distinct", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Atom:
    rel: str
    args: tuple[Term, ...]
    negated: bool = False

    def __str__(self) -> str:
        return f"{'!' if self.negated else ''}{self.rel}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare:
    """left op right; `=` with an unbound variable on one side assigns it."""

    op: str
    left: Term
    right: Term

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


Literal = Atom | Compare


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...]

    def __str__(self) -> str:
        return f"{self.head} <- {', '.join(map(str, self.body))}"

    @property
    def aggregates(self) -> list[Agg]:
        return [a for a in self.head.args if isinstance(a, Agg)]

    @property
    def atoms(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]


def variables(x: Term | Literal) -> Iterator[str]:
    """Names of the variables in a term or literal, with repeats, left to right."""
    if isinstance(x, Var):
        yield x.name
    elif isinstance(x, Arith | Compare):
        yield from variables(x.left)
        yield from variables(x.right)
    elif isinstance(x, Call | Atom):
        for a in x.args:
            yield from variables(a)
    elif isinstance(x, Agg):
        for v in x.vars:
            yield v.name


@dataclass(frozen=True)
class Insert:
    rel: str
    rows: tuple[tuple[object, ...], ...]
    session: bool = False


@dataclass(frozen=True)
class Delete:
    rel: str
    rows: tuple[tuple[object, ...], ...]


@dataclass(frozen=True)
class ConditionalDelete:
    target: Atom
    body: tuple[Literal, ...]


@dataclass(frozen=True)
class Update:
    deletes: tuple[Atom, ...]
    inserts: tuple[Atom, ...]
    body: tuple[Literal, ...]


@dataclass(frozen=True)
class DropName:
    name: str


@dataclass(frozen=True)
class AddRule:
    rule: Rule
    session: bool


@dataclass(frozen=True)
class Schema:
    rel: str
    columns: tuple[tuple[str, str], ...]
    session: bool = False


@dataclass(frozen=True)
class TypeAlias:
    name: str
    type: str


@dataclass(frozen=True)
class Query:
    goal: Atom
    body: tuple[Literal, ...] = ()
    order: tuple[tuple[int, bool], ...] = ()  # (goal argument, descending)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Meta:
    command: str
    args: tuple[str, ...] = ()
    query: Query | None = None
    text: str = field(default="", compare=False)


Statement = Insert | Delete | ConditionalDelete | Update | DropName | AddRule | Schema | TypeAlias | Query | Meta
