"""Walks by expression: against walks listed one by one, cycles, odd rows, patterns with a star."""

import random
import re

import pytest

from quillstone.operators import graph
from quillstone.operators.paths import Automaton, walks

from .test_vault import rows

EDGES = "src string, edge string, dst string"


def listed(expression, edges, seeds, most):
    """(start, node) -> fewest edges of all walks of up to `most` edges whose names, a letter each, match the expression as a regular one."""
    letters = {"a": "A", "b": "B", "^a": "C", "^b": "D"}
    pattern = re.sub(r"\^?[ab.]", lambda m: {".": "[AB]", "^.": "[CD]"}.get(m[0]) or letters[m[0]], expression).replace("/", "")
    steps = [(s, letters[e], d) for s, e, d in edges] + [(d, letters["^" + e], s) for s, e, d in edges]
    found, at = {}, {(s, s, "") for s in seeds}
    for n in range(most + 1):
        for s, node, word in at:
            if re.fullmatch(pattern, word):
                found.setdefault((s, node), n)
        at = {(s, d, word + e) for s, node, word in at for x, e, d in steps if x == node}
    return found


@pytest.mark.parametrize("expression", ["a", "a+", "a*", "(a|b)+/a?", "a{1,3}/^b", "(a/b)*", "a{2,}", "(a?/b){0,2}", "./^.", "((a|^b){1,2}/a)+", "b{0,0}", "(a?)+/b{2}", "(a*/b*){2}"])
def test_walks_are_those_listed_one_by_one(spark, expression):
    rng = random.Random(expression)
    edges = [(f"n{rng.randrange(4)}", rng.choice("ab"), f"n{rng.randrange(4)}") for _ in range(4)]
    seeds = ["n0", "n1", "gone"]
    got = walks(expression, spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in seeds], "id string"))
    got = {(r["start"], r["node"]): r["hops"] for r in got.collect()}
    most = 7
    assert {k: n for k, n in got.items() if n <= most} == listed(expression, edges, seeds, most)


def test_a_count_is_an_exact_number_of_edges_even_round_a_cycle(spark):
    edges = spark.createDataFrame([("x", "k", "y"), ("y", "k", "z"), ("z", "k", "x")], EDGES)
    seeds = spark.createDataFrame([("x",)], "id string")
    assert rows(walks("k{4}", edges, seeds), "start", "node", "hops") == [("x", "y", 4)]
    assert rows(walks("k+", edges, seeds), "start", "node", "hops") == [("x", "x", 3), ("x", "y", 1), ("x", "z", 2)]


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    edges = spark.createDataFrame([("x", "k", "y", 1, 2), ("x", "k", "y", 3, 4), (None, "k", "y", 1, 1), ("x", None, "q", 1, 1), ("x", "k", None, 1, 1)], EDGES + ", state int, hops int")
    seeds = spark.createDataFrame([("x",), ("x",), (None,)], "id string")
    assert rows(walks("k*", edges, seeds), "start", "node", "hops") == [("x", "x", 0), ("x", "y", 1)]
    assert walks("k", edges.where("false"), seeds).count() == 0
    assert walks("k*", edges, seeds.where("false")).count() == 0
    numbers = spark.createDataFrame([(1, "k", 2)], "src long, edge string, dst long")
    assert [tuple(r) for r in walks("^k", numbers, spark.createDataFrame([(2,)], "id long")).collect()] == [(2, 1, 1)]


def test_a_long_chain_and_a_hub(spark):
    chain = spark.createDataFrame([(f"c{i}", "k", f"c{i + 1}") for i in range(25)] + [("c25", "k", f"leaf{i}") for i in range(3000)], EDGES)
    got = walks("k+", chain, spark.createDataFrame([("c0",)], "id string"))
    assert got.count() == 25 + 3000 and got.agg({"hops": "max"}).first()[0] == 26


@pytest.mark.parametrize("expression", ["", "a|", "(a", "a)", "a b", "a{3,1}", "*", "a//b", "a{2000}"])
def test_what_cannot_be_read_is_refused(expression):
    with pytest.raises(ValueError):
        Automaton(expression)


def test_patterns_with_a_star(spark):
    nodes = spark.createDataFrame([("ann", "person"), ("bob", "person"), ("org", "org"), ("top", "org")], "id string, type string")
    edges = spark.createDataFrame([("ann", "knows", "bob"), ("bob", "works_at", "org"), ("org", "part_of", "top"), ("top", "part_of", "org")], EDGES)
    found = lambda p, *c: rows(graph.match(p, nodes, edges), *c)
    assert found("(:ann)-[*]->(org)", "n0", "e1", "n1") == [("ann", 2, "org"), ("ann", 3, "top")]
    assert found("(person)-[works_at|part_of*..2]->(:top)", "n0", "e1", "n1") == [("bob", 2, "top")]
    assert found("(:top)<-[works_at|part_of*1..2]-(person)", "n0", "e1", "n1") == [("top", 2, "bob")]
    assert found("(person)-[knows]->(person)-[works_at|part_of * 2]->(org)", "n0", "n1", "e2", "n2") == [("ann", "bob", 2, "top")]
    assert found("(:ann)-[knows*2..]-(person)", "n0", "e1", "n1") == [("ann", 2, "ann"), ("ann", 3, "bob")]
