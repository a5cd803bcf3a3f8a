"""Capped walks in rounds give what one start after another gives."""

import random

import pytest

from mnemolake.operators.walks import capped_walks


def plain(edges, order, most):
    links = {}
    for a, b, rank in edges:
        if a != b:
            links.setdefault(a, {}).setdefault(b, rank)
            links[a][b] = min(links[a][b], rank)
    seen, out = set(), {}
    for start in sorted(links, key=lambda x: (order.get(x) is None, order.get(x) or 0, x)):
        if start in seen:
            continue
        own, at = [start], 0
        seen.add(start)
        while at < len(own) and len(own) < most:
            for x in sorted(links.get(own[at], {}), key=lambda x: (links[own[at]][x], x)):
                if x not in seen and len(own) < most:
                    seen.add(x)
                    own.append(x)
            at += 1
        out[start] = own
    return out


def run(spark, edges, order, most=7, **more):
    e = spark.createDataFrame(edges, "id string, other string, rank int")
    o = spark.createDataFrame(list(order.items()), "id string, order long")
    rows = capped_walks(e, o, most, **more).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.own for r in rows}


def graph(seed, n, degree):
    r = random.Random(seed)
    names = [f"n{i:05d}" for i in range(n)]
    edges = [(a, b, k) for a in names for k, b in enumerate(r.sample(names, r.randint(0, degree)))]
    return edges, {x: r.choice([None, *range(n // 2)]) for x in names}  # ties, nulls, loops


@pytest.mark.parametrize(("seed", "n", "degree", "most"), [(1, 60, 3, 7), (3, 300, 10, 4)])
def test_random_graphs(spark, seed, n, degree, most):
    edges, order = graph(seed, n, degree)
    assert run(spark, edges, order, most) == plain(edges, order, most)


@pytest.mark.parametrize("rounds", [1, 3])
def test_the_fold_of_what_has_not_settled_gives_the_same(spark, rounds):
    names = [f"n{i:03d}" for i in range(36)]
    chain = [(a, b, 1) for a, b in zip(names, names[1:])] + [("x", "y", 1), ("y", "x", 1)]
    order = {x: i for i, x in enumerate([*names, "x"])}  # y has none: it starts last
    want = plain(chain, order, 7)
    assert run(spark, chain, order, rounds=rounds) == want == run(spark, chain, order, rounds=60)
    assert want["n000"] == names[:7] and want["x"] == ["x", "y"]


def test_a_hub_that_all_link_to_and_repeated_links(spark):
    edges = [(f"n{i:03d}", "hub", 1) for i in range(300)] + [("hub", f"n{i:03d}", i) for i in range(10)]
    edges += edges[:50] + [("n000", "n000", 0)]
    order = {f"n{i:03d}": -i for i in range(300)}
    assert run(spark, edges, order) == plain(edges, order, 7)


def test_no_links(spark):
    assert run(spark, [], {"a": 1}) == {}
