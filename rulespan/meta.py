"""Dot commands: graphs, relations, rules, sessions, indexes, explanations."""

from __future__ import annotations

import time

from .catalog import Graph, Index
from .errors import RuleError
from .plans.analysis import components, needed
from .plans.ast import Meta
from .plans.parser import parse_program, split_statements

METRICS = ("cosine", "euclidean", "dot_product", "manhattan")


def run_meta(session, s: Meta) -> object:
    g, engine, args = session.graph, session.engine, list(s.args)
    first = args[0] if args else ""

    def need(n: int) -> None:
        if len(args) < n:
            raise RuleError(f".{s.command} needs more arguments: {s.text}")

    if s.command == "kg":
        if first == "list":
            return sorted(engine.graphs)
        if first in ("create", "use", "drop"):
            need(2)
            name = args[1]
            if first == "create":
                if name in engine.graphs:
                    raise RuleError(f"graph {name} exists")
                engine.graphs[name] = Graph(engine.spark, name)
                session.graph_name = name
            elif name not in engine.graphs:
                raise RuleError(f"no graph {name}")
            elif first == "use":
                session.graph_name = name
                session.clear()
            else:
                if name == session.graph_name:
                    raise RuleError("the current graph cannot be dropped")
                del engine.graphs[name]
            engine.notify("graph", name, first)
            return f"{first} {name}"
        return session.graph_name
    if s.command == "rel":
        if first == "drop":
            need(2)
            if not g.drop(args[1]):
                raise RuleError(f"no relation {args[1]}")
            engine.notify("rows", g.name, args[1])
            return f"dropped {args[1]}"
        if first:
            r = g.relation(first)
            if r is None:
                raise RuleError(f"no relation {first}")
            return list(zip(r.names, r.kinds))
        return sorted(set(g.stored) | set(g.schemas))
    if s.command == "rule":
        if not first or first == "list":
            return sorted(g.heads())
        if first == "def":
            need(2)
            return [str(r) for r in g.rules if r.head.rel == args[1]]
        if first == "drop" and len(args) > 2 and args[1] == "prefix":
            return _remove_rules(engine, g, lambda i, r: r.head.rel.startswith(args[2]))
        if first in ("drop", "clear"):
            need(2)
            return _remove_rules(engine, g, lambda i, r: r.head.rel == args[1])
        if first in ("remove", "edit"):
            need(3)
            mine = [r for r in g.rules if r.head.rel == args[1]]
            n = int(args[2])
            if not 1 <= n <= len(mine):
                raise RuleError(f"{args[1]} has {len(mine)} clauses")
            old = mine[n - 1]
            if first == "remove":
                return _remove_rules(engine, g, lambda i, r: r is old)
            new = parse_program(s.text.split(None, 4)[4].lstrip("+"))[0].rule
            kept = list(g.rules)
            g.rules = [r for r in g.rules if r is not old]
            try:
                g.add_rule(new)
            except RuleError:
                g.rules = kept
                raise
            return f"edited {args[1]}"
        return session.query(f"?{first}({', '.join('_' for _ in range(session.evaluation().relation(first).width))})")
    if s.command == "session":
        if first == "clear":
            session.clear()
            return "cleared"
        if first == "drop":
            need(2)
            if args[1].isdigit():
                n = int(args[1])
                if not 1 <= n <= len(session.rules):
                    raise RuleError(f"the session has {len(session.rules)} rules")
                session.rules.pop(n - 1)
            else:
                session.rules = [r for r in session.rules if r.head.rel != args[1]]
                session.own.drop(args[1])
            return f"dropped {args[1]}"
        return [str(r) for r in session.rules]
    if s.command == "index":
        return _index(g, args)
    if s.command == "clear":
        if first == "prefix":
            need(2)
            names = g.matching(args[1])
            for x in names:
                g.drop(x)
            return names
        raise RuleError("use .clear prefix NAME")
    if s.command == "compact":
        for rel in list(g.stored):
            if g.relation(rel) is not None:
                g.replace_rows(rel, g.relation(rel))
        return "compacted"
    if s.command == "status":
        return {"graph": g.name, "graphs": len(engine.graphs), "relations": len(g.stored), "rules": len(g.rules), "indexes": len(g.indexes), "uptime_s": round(time.time() - engine.started, 1), "spark": engine.spark.version}
    if s.command == "load":
        need(1)
        text = "\n".join(r.value for r in engine.spark.read.text(args[0]).collect())
        return [session.execute(x) for x in split_statements(text)]
    if s.command == "debug":
        rules = needed([a.rel for a in (s.query.goal, *s.query.body) if hasattr(a, "rel")], g.rules + session.rules)
        return {"strata": components(rules), "rules": [str(r) for r in rules], "plan": session.query(s.query)._jdf.queryExecution().toString()}
    if s.command in ("why", "why full", "why_not"):
        from .provenance import why, why_not

        return why_not(session, s.query) if s.command == "why_not" else why(session, s.query, full=s.command == "why full")
    raise RuleError(f"no command .{s.command}")


def _remove_rules(engine, g: Graph, gone) -> str:
    before = len(g.rules)
    g.rules = [r for i, r in enumerate(g.rules) if not gone(i, r)]
    engine.notify("rule", g.name, "*")
    return f"removed {before - len(g.rules)} clause(s)"


def _index(g: Graph, args: list[str]) -> object:
    """Indexes are declarations: searches are exact, so the tuning options are kept and change nothing."""
    what = args[0] if args else "list"
    if what == "list":
        return sorted(g.indexes)
    name = args[1] if len(args) > 1 else ""
    if what == "create":
        if len(args) < 4 or args[2] != "on" or "(" not in args[3]:
            raise RuleError("use .index create NAME on RELATION(COLUMN) [options]")
        rel, column = args[3].rstrip(")").split("(")
        options = dict(zip(args[4::2], args[5::2]))
        metric = options.pop("metric", "cosine")
        if metric not in METRICS:
            raise RuleError(f"no metric {metric}")
        if name in g.indexes:
            raise RuleError(f"index {name} exists")
        g.indexes[name] = Index(name, rel, column, metric, options)
        return f"index {name}"
    if name not in g.indexes:
        raise RuleError(f"no index {name}")
    if what == "drop":
        del g.indexes[name]
        return f"dropped {name}"
    if what in ("stats", "rebuild"):
        i = g.indexes[name]
        return {"relation": i.relation, "column": i.column, "metric": i.metric, "options": i.options, "kind": "exact"}
    raise RuleError(f"no command .index {what}")
