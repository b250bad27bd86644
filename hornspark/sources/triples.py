"""A triple store as relations: one rule for each relation that a program reads and nothing
defines."""

from __future__ import annotations

from ..ast import Const, Key, Literal, Program, Rule, Var

TYPE = "rdf:type"


def input_rules(program: Program, known: set[Key], store: str = "facts", type_name: str = TYPE, defined_too: bool = False) -> Program:
    """``C(X) :- facts(X, "rdf:type", "C").`` and ``p(X, Y) :- facts(X, "p", Y).``

    With ``defined_too`` also for relations that have rules: an ontology's classes and
    properties hold what the data say besides what follows."""
    defined = {*known, (store, 3)} | (set() if defined_too else set(program.heads()))
    read = [x.key for r in program if isinstance(r, Rule) for x in ((r.head, *r.body) if defined_too else r.body)]
    wanted = dict.fromkeys(k for k in read if k not in defined)
    x, y = Var("X"), Var("Y")
    rules = []
    for name, arity in wanted:
        if arity == 1:
            rules.append(Rule(Literal(name, (x,)), (Literal(store, (x, Const(type_name), Const(name))),)))
        elif arity == 2:
            rules.append(Rule(Literal(name, (x, y)), (Literal(store, (x, Const(name), y)),)))
    return Program(rules)
