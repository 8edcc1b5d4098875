"""The index of a history against walks of it."""

import random

import pytest

from adjudica.operators import graph
from adjudica.operators.history import CommitIndex

SCHEMA = "oid string, parent string, nth int, time long"


def history(seed, n):
    """Commits by number, with parents: a line that branches and merges, some roots, and two lines that merge each other by turns."""
    rnd = random.Random(seed)
    parents = {}
    for i in range(n):
        a = i - 1 - rnd.choice([0, 0, 0, 0, 1, 2, rnd.randrange(40)])
        more = [p for p in (i - 1 - rnd.randrange(25),) if p >= 0 and rnd.random() < 0.25 and p != a]
        parents[i] = [a, *more] if a >= 0 else []
    for k in range(20):  # ladder
        parents[n + 2 * k] = [n + 2 * k - 2, n + 2 * k - 1] if k else [5]
        parents[n + 2 * k + 1] = [n + 2 * k - 1, n + 2 * k - 2] if k else [6]
    return parents


def reached(parents, start):
    seen, left = set(), [start]
    while left:
        i = left.pop()
        if i not in seen:
            seen.add(i)
            left += parents[i]
    return seen


@pytest.fixture(scope="module")
def made(spark):
    parents = history(3, 300)
    rows = [(f"c{i}", f"c{p}" if p is not None else None, k + 1, i) for i, ps in parents.items() for k, p in enumerate(ps or [None])]
    rows += rows[:40] + [("c0", "elsewhere", 2, 0)]  # repeated rows, and a parent that isn't there
    return parents, CommitIndex(spark.createDataFrame(rows, SCHEMA))


def test_chains_are_paths_of_first_parents(made):
    parents, index = made
    at = {r.oid: (r.chain, r.pos, r.depth) for r in index.nodes.collect()}
    assert len(at) == len(parents) and len({x[:2] for x in at.values()}) == len(at)
    by = {v[:2]: k for k, v in at.items()}
    for (chain, pos), oid in by.items():
        first = parents[int(oid[1:])][:1]
        assert (pos == 0 and by[chain, 0] == chain) or by[chain, pos - 1] == f"c{first[0]}"
        assert at[oid][2] == (at[f"c{first[0]}"][2] + 1 if first else 0)

    def chains(i):  # crossed on the way to the root
        line = []
        while True:
            line.append(at[f"c{i}"][0])
            if not parents[i]:
                return len(set(line))
            i = parents[i][0]

    assert max(map(chains, parents)) <= 9  # log2 of the number of commits


def test_ancestors_and_log(spark, made):
    parents, index = made
    starts = [0, 77, 299, 339, 338]
    df = spark.createDataFrame([(str(s), f"c{s}") for s in starts], "ref string, oid string")
    got = {(r.ref, r.oid) for r in index.ancestors(df).collect()}
    assert got == {(str(s), f"c{i}") for s in starts for i in reached(parents, s)}
    for s, depth in ((299, 7), (299, 60), (339, 1000)):
        assert [r.oid for r in index.log(f"c{s}", depth).collect()] == [f"c{i}" for i in sorted(reached(parents, s), reverse=True)[:depth]]


def test_all_best_merge_bases(spark, made):
    parents, index = made
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(40)] + [(338, 339), (338, 299), (5, 5), (0, 299)]
    df = spark.createDataFrame([(k, f"c{a}", f"c{b}") for k, (a, b) in enumerate(pairs)], "id int, a string, b string")
    want = set()
    for k, (a, b) in enumerate(pairs):
        common = reached(parents, a) & reached(parents, b)
        want |= {(k, f"c{x}") for x in common if not any(x in parents[y] for y in common)}
    assert {(r.id, r.oid) for r in index.merge_bases(df).collect()} == want
    assert sum(k == 40 for k, _ in want) == 2  # a criss-cross merge has two


def test_steps_back(spark, made):
    parents, index = made
    rows = [(f"{i}~{n}", f"c{i}", n) for i in (10, 150, 299, 339) for n in (0, 1, 2, 5, 40, 100, 400)]
    want = {}
    for ref, oid, n in rows:
        i = int(oid[1:])
        for _ in range(n):
            i = parents[i][0] if i is not None and parents[i] else None
        if i is not None:
            want[ref] = f"c{i}"
    df = spark.createDataFrame(rows, "ref string, oid string, n int")
    assert {r.ref: r.oid for r in index.back(df).collect()} == want
    second = spark.createDataFrame([("a", "c339", 2), ("b", "c339", 0), ("c", "c0", 1)], "ref string, oid string, n int")
    assert {r.ref: r.oid for r in index.parent(second).collect()} == {"a": f"c{parents[339][1]}", "b": "c339"}


def test_shortest_cycle_through_each_edge(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(55)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(105, 103), (40, 40), (41, 42)]
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)

    def shortest(a, b):  # the least shortest way from b to a
        ways, seen = {b: (b,)}, {b}
        while ways:
            if a in ways:
                return ways[a]
            step = {}
            for node, way in ways.items():
                for to in nexts.get(node, ()):
                    if to not in seen:
                        step[to] = min(step.get(to, (10**9,)), (*way, to))
            seen |= set(step)
            ways = step
        return None

    want = set()
    for a, b in set(edges):
        if way := shortest(a, b):
            k = way.index(min(way))
            want.add((a, b, way[k:] + way[:k]))
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.src, r.dst, tuple(r.cycle)) for r in graph.edge_cycles(df).collect()} == want
    got = graph.cycles(df).collect()
    assert len(got) == len({w[2] for w in want}) and all(len(r.cycle) == r.length for r in got)


def test_cycles_of_modules(spark):
    names = spark.createDataFrame([("src/a.ts", "src/b.ts"), ("src/b.ts", "src/c.ts"), ("src/c.ts", "src/a.ts"), ("src/d.ts", "src/a.ts")], "src string, dst string")
    assert [r.cycle for r in graph.cycles(names).collect()] == [["src/a.ts", "src/b.ts", "src/c.ts"]]
    assert graph.cycles(names.where("src <> 'src/c.ts'")).count() == 0


def test_rounds_of_a_long_ring(spark, monkeypatch):
    """A ring's rounds go by the logarithm of its length: 64 nodes took 64 rounds of colours, of ways back and of steps."""
    calls, plain = [], graph.store
    monkeypatch.setattr(graph, "store", lambda df, what: calls.append(what) or plain(df, what))
    edges = spark.createDataFrame([(i, (i + 1) % 64) for i in range(64)] + [(5, 200), (200, 201)], "src long, dst long")
    got = graph.edge_cycles(edges).collect()
    assert {(r.src, r.dst) for r in got} == {(i, (i + 1) % 64) for i in range(64)}
    assert {tuple(r.cycle) for r in got} == {tuple(range(64))} and len(calls) < 100
