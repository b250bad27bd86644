"""Abstract syntax of rule programs: frozen values, compared by content."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    """A text or a non-negative whole number; numbers equal their text."""

    value: str | int

    def __str__(self) -> str:
        if isinstance(self.value, int):
            return str(self.value)
        return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'


@dataclass(frozen=True)
class OneOf:
    """Any of several constants; made by the planner, not written in programs."""

    values: tuple[Const, ...]

    def __str__(self) -> str:
        return "{" + ", ".join(map(str, self.values)) + "}"


Term = Var | Const | OneOf
#: A relation: its name and arity.
Key = tuple[str, int]


def key_text(key: Key) -> str:
    return f"{key[0]}/{key[1]}"


@dataclass(frozen=True)
class Literal:
    name: str
    args: tuple[Term, ...]
    negated: bool = False

    @property
    def key(self) -> Key:
        return self.name, len(self.args)

    @property
    def variables(self) -> list[Var]:
        """Distinct variables in the order of their first occurrence."""
        return list(dict.fromkeys(a for a in self.args if isinstance(a, Var)))

    def substituted(self, mapping: dict[Var, Term]) -> Literal:
        return Literal(self.name, tuple(mapping.get(a, a) if isinstance(a, Var) else a for a in self.args), self.negated)

    def __str__(self) -> str:
        return ("not " if self.negated else "") + f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...] = ()

    @property
    def positive(self) -> list[Literal]:
        return [x for x in self.body if not x.negated]

    @property
    def negative(self) -> list[Literal]:
        return [x for x in self.body if x.negated]

    @property
    def is_fact(self) -> bool:
        return not self.body

    def substituted(self, mapping: dict[Var, Term]) -> Rule:
        return Rule(self.head.substituted(mapping), tuple(x.substituted(mapping) for x in self.body))

    def __str__(self) -> str:
        return f"{self.head}." if self.is_fact else f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class ShellRule:
    """``head(X, ...) :~ command``: rows are the command's lines, split at tabs."""

    head: Literal
    command: str

    def __str__(self) -> str:
        return f"{self.head} :~ {self.command}"


@dataclass
class Program:
    rules: list[Rule | ShellRule] = field(default_factory=list)

    def __iter__(self) -> Iterator[Rule | ShellRule]:
        return iter(self.rules)

    def __add__(self, other: Program) -> Program:
        return Program([*self.rules, *other.rules])

    def heads(self) -> list[Key]:
        return list(dict.fromkeys(r.head.key for r in self.rules))

    def of(self, key: Key) -> list[Rule | ShellRule]:
        return [r for r in self.rules if r.head.key == key]

    def resolve(self, name: str | None = None, known: Iterable[Key] = ()) -> Key:
        """The relation meant by ``name`` or ``name/arity``; without one, the last rule's head.

        Among several arities the lowest is meant."""
        if name is None:
            if not self.rules:
                raise LookupError("the program has no rules, so there is no relation to query")
            return self.rules[-1].head.key
        found = sorted({*self.heads(), *known, *(x.key for r in self.rules if isinstance(r, Rule) for x in r.body)}, key=lambda k: (k[1], k[0]))
        base, slash, arity = name.rpartition("/")
        if slash and arity.isdigit():
            wanted = [k for k in found if k == (base, int(arity))]
        else:
            wanted = [k for k in found if k[0] == name]
        if not wanted:
            near = [key_text(k) for k in found if k[0].lower() == name.lower()]
            raise LookupError(f"no relation {name}" + (f"; did you mean {' or '.join(near)}?" if near else ""))
        return wanted[0]

    def __str__(self) -> str:
        return "\n".join(map(str, self.rules)) + "\n" * bool(self.rules)
