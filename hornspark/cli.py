"""Command line: ``python -m hornspark`` evaluates a program, or a SPARQL query over triples,
and prints the sorted rows as tab-separated lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .ast import Program
from .engine import Engine
from .parser import load
from .sources.files import sorted_lines


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m hornspark", description=__doc__)
    p.add_argument("--query-file", help="a rule program")
    p.add_argument("--query-pred", help="relation to print, as name or name/arity (default: head of the last rule)")
    p.add_argument("--sparql", help="file with a SPARQL query instead of a program's relation")
    p.add_argument("--owl", help="ontology (Turtle, N-Triples or RDF/XML) whose axioms become rules")
    p.add_argument("--ntriples", action="append", default=[], help="N-Triples data; may be given several times")
    p.add_argument("--plan", action="store_true", help="print the strata and Spark's plan instead of rows")
    p.add_argument("--sql", action="store_true", help="print SQL instead of rows")
    p.add_argument("--debug-algebra", action="store_true", help="print the SPARQL algebra first")
    p.add_argument("--debug-datalog", action="store_true", help="print the rules first")
    p.add_argument("--allow-shell", action="store_true", help="run commands of rules")
    p.add_argument("params", nargs="*", help="values of $1, $2, ... in commands")
    args = p.parse_args(argv)
    if not args.query_file and not args.sparql:
        p.error("give --query-file or --sparql")
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("hornspark").getOrCreate()
    engine = Engine(spark, args.params, args.allow_shell)
    query = args.query_pred
    if args.query_file:
        engine.add(load(args.query_file))
    prefixes: dict[str, str] = {}
    if args.owl:
        from .owl import ontology_rules, triple_view
        from .rdf import load_triples
        from .sources.triples import input_rules

        triples, prefixes = load_triples(args.owl)
        ontology = ontology_rules(triples, prefixes).program
        engine.add(ontology).add(input_rules(ontology, set(), "triples", defined_too=True)).add(triple_view(ontology))
    if args.sparql:
        from .sparql import parse_query, translate

        with open(args.sparql, encoding="utf-8") as f:
            parsed = parse_query(f.read(), prefixes)
        if args.debug_algebra:
            print(parsed.pattern, file=sys.stderr)
        rules, name = translate(parsed)
        engine.add(rules)
        query = query or name
    if args.ntriples:
        from .rdf import shortened
        from .sources.files import read_ntriples

        engine.register("triples", shortened(read_ntriples(spark, args.ntriples), prefixes))
        engine.add("facts(S, P, O) :- triples(S, P, O).")
        engine.add_triple_rules()
    if args.debug_datalog:
        print(engine.program, file=sys.stderr)
    if query is None and args.query_file:
        query = None if args.owl is None and not args.ntriples else last_head(load(args.query_file))
    if args.plan:
        print(engine.explain(query, spark_plan=True))
    elif args.sql:
        print(engine.to_sql(query))
    else:
        for line in sorted_lines(engine.query(query)):
            print(line)
    return 0


def last_head(program: Program) -> str:
    name, arity = program.resolve()
    return f"{name}/{arity}"
