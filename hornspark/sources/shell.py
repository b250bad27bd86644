"""Rules whose rows come from a command.

Commands that only read files are recognised and read by Spark, so they need no shell:
``cat file ...`` (with globs), ``zcat file ...``, ``read_ntriples file ...`` and
``cat !other``, which stands for another relation.  Any other command runs on the driver,
and only where the caller allows it."""

from __future__ import annotations

import re
import shlex
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..ast import Key, Program, ShellRule
from ..operators.relational import names
from .files import read_ntriples, read_tsv, sorted_lines

SPLICE = re.compile(r"(?<!\S)!([A-Za-z_][A-Za-z0-9_]*)(?:/(\d+))?")
SPECIAL = set("|;&<>`(){}")


class ShellNotAllowed(RuntimeError):
    pass


@dataclass(frozen=True)
class Reads:
    """What a recognised command does."""

    kind: str  # tsv, ntriples or relation
    what: tuple[str, ...]


def with_params(command: str, params: list[str]) -> str:
    """``$1``, ``$2``, ... replaced by the program's arguments."""

    def value(m: re.Match) -> str:
        i = int(m[1] or m[2])
        if i > len(params):
            raise LookupError(f"the program needs argument ${i}")
        return params[i - 1]

    return re.sub(r"\$(?:\{(\d+)\}|(\d+))", value, command)


def recognise(command: str) -> Reads | None:
    if SPECIAL & set(command):
        return None
    try:
        first, *rest = shlex.split(command)
    except ValueError:
        return None
    if first == "cat" and len(rest) == 1 and SPLICE.fullmatch(rest[0]):
        return Reads("relation", (rest[0][1:],))
    if first in ("cat", "zcat", "read_ntriples") and rest and not any(x.startswith(("-", "!")) for x in rest):
        return Reads("ntriples" if first == "read_ntriples" else "tsv", tuple(rest))
    return None


def spliced(command: str, program: Program, known: list[Key]) -> list[tuple[str, Key]]:
    """The relations that a command names, as written and as meant."""
    return [(m[0], program.resolve(m[0][1:], known)) for m in SPLICE.finditer(command)]


def rows_of(spark: SparkSession, rule: ShellRule, params: list[str], allow_shell: bool, relation: Callable[[Key], DataFrame], program: Program, known: list[Key]) -> DataFrame:
    arity = rule.head.key[1]
    command = with_params(rule.command, params)
    found = recognise(command)
    if found and found.kind == "relation":
        key = program.resolve(found.what[0], known)
        df = relation(key)
        if key[1] != arity:
            raise ValueError(f"{rule}: the relations have different arities")
        return df
    if found and found.kind == "tsv":
        return read_tsv(spark, list(found.what), arity)
    if found and arity == 3:
        return read_ntriples(spark, list(found.what))
    if not allow_shell:
        raise ShellNotAllowed(f"{rule}: commands run only with allow_shell=True (--allow-shell)")
    return run(spark, command, arity, [(text, relation(key)) for text, key in spliced(command, program, known)])


def run(spark: SparkSession, command: str, arity: int, inputs: list[tuple[str, DataFrame]]) -> DataFrame:
    """The command's output lines, split at tabs.  Inputs go to files; all of it is on the driver."""
    with tempfile.TemporaryDirectory() as folder:
        for i, (text, df) in enumerate(inputs):
            path = f"{folder}/{i}"
            with open(path, "w", encoding="utf-8") as f:
                f.writelines(f"{line}\n" for line in sorted_lines(df))
            command = re.sub(rf"(?<!\S){re.escape(text)}(?!\S)", shlex.quote(path), command)
        done = subprocess.run(["sh", "-c", command], capture_output=True, text=True, env={"LC_ALL": "C", "PATH": "/usr/local/bin:/usr/bin:/bin"}, check=True)
    rows = [tuple((line.split("\t") + [""] * arity)[:arity]) for line in done.stdout.splitlines()]
    schema = ", ".join(f"{n} string" for n in names(arity))
    return spark.createDataFrame(rows, schema) if arity else spark.range(min(1, len(rows))).select()
