"""A rule as one DataFrame expression: Catalyst sees the whole of it."""

from __future__ import annotations

from collections.abc import Callable

from ..ast import Const, Literal, OneOf, Rule, Var
from ..operators import relational as R


def join_order(literals: list[tuple[int, Literal]], first: int | None) -> list[tuple[int, Literal]]:
    """Literals so that each shares variables with those before it where that is possible.

    Starts with ``first`` (a loop's delta), else with the literal that has most constants."""
    rest = list(literals)

    def constants(x: Literal) -> int:
        return sum(isinstance(a, (Const, OneOf)) for a in x.args)

    start = next((p for p in rest if p[0] == first), None) or max(rest, key=lambda p: (constants(p[1]), -p[0]))
    out, bound = [start], set(start[1].variables)
    rest.remove(start)
    while rest:
        best = max(rest, key=lambda p: (len(bound & set(p[1].variables)), constants(p[1]), -p[0]))
        rest.remove(best)
        out.append(best)
        bound |= set(best[1].variables)
    return out


def rule_rows(rule: Rule, source: Callable[[int, Literal], R.Relation], first: int | None = None) -> R.Relation:
    """Rows of the head.  ``source`` gives the relation that a body literal (by its place) reads."""
    ordered = join_order([(i, x) for i, x in enumerate(rule.body) if not x.negated], first)
    head_variables = set(rule.head.variables)
    negated = {v for x in rule.negative for v in x.variables}
    current, unique, all_kept = None, True, True
    bound: set[Var] = set()
    for place, (i, literal) in enumerate(ordered):
        own = R.read(source(i, literal), literal)
        variables = set(literal.variables)
        later = head_variables | negated | {v for _, x in ordered[place + 1 :] for v in x.variables}
        if current is None:
            current, unique, bound = own.df, own.unique, variables
            continue
        new = variables - bound
        keep = bool(new & later)
        current = R.join(current, own.df, keep)
        if keep:
            unique = unique and own.unique
            bound |= variables
    for i, literal in enumerate(rule.body):
        if literal.negated:
            other = R.read(source(i, literal), literal).df
            shared = [R.column(v) for v in literal.variables if v in bound]
            current = R.anti_join(current, other.select(*shared) if shared else R.witness(other))
    all_kept = bound <= head_variables
    return R.Relation(R.project(current, rule.head), unique and all_kept)
