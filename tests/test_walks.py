"""Matches on walks of any length against plain search: cycles, branches, reversed nodes, repeated links, labels of one character."""

import random

import pytest

from gramweave.operators import walks

FLIP = str.maketrans("ACGT", "TGCA")


def brute(nodes, links, queries, k, strict):
    label = lambda v: nodes[v[0]][::-1].translate(FLIP) if v[1] else nodes[v[0]]
    places = {(n, False) for n in nodes} | {(a, ar) for a, ar, _, _ in links} | {(b, br) for _, _, b, br in links}
    places = {v for v in places if nodes.get(v[0])}
    after, before = {v: set() for v in places}, {v: set() for v in places}
    for a, ar, b, br in links:
        if (a, ar) in places and (b, br) in places:
            after[a, ar].add((b, br))
            before[b, br].add((a, ar))
    out = set()
    for q, text in queries:
        for v in places:
            for off in range(len(label(v))):
                left = {label(v)[off - 1]} if off else {label(u)[-1] for u in before[v]}
                for i in range(len(text or "")):
                    if (i and text[i - 1] in left) or (strict and not (i and left)):
                        continue
                    front = {(v, off)}
                    for d in range(len(text) - i + 1):  # d characters match up to each place of the frontier
                        then = set()
                        for cur, at in front:
                            end = at == len(label(cur))
                            right = {(u, 0) for u in after[cur]} if end else {(cur, at)}
                            on = {(u, x + 1) for u, x in right if i + d < len(text) and label(u)[x] == text[i + d]}
                            then |= on
                            if not on and d >= k and not (strict and not (right and i + d < len(text))):
                                out.add((*v, off, q, i, d, *cur, at))
                        front = then
    return out


def frames(spark, nodes, links, queries):
    return (
        spark.createDataFrame(list(nodes.items()), "node_id long, label string"),
        spark.createDataFrame(links, "src long, src_rev boolean, dst long, dst_rev boolean"),
        spark.createDataFrame(queries, "query_id long, text string"),
    )


@pytest.mark.parametrize(("seed", "boundary", "k", "w"), [(0, "strict", 3, 16), (1, "open", 4, 2), (2, "strict", 5, 16)])
def test_random_graphs(spark, seed, boundary, k, w):
    r = random.Random(seed)
    letters = "AC" if seed else "ACGT"
    nodes = {n: "".join(r.choice(letters) for _ in range(r.choice([1, 1, 2, 3, 6]))) for n in range(7)} | {90: "", 91: None}
    links = [(r.randrange(7), r.random() < 0.2, r.randrange(7), r.random() < 0.2) for _ in range(9)] + [(0, False, 0, False), (1, False, 90, False), (90, False, 2, False)]
    queries = [(q, "".join(r.choice(letters) for _ in range(14))) for q in range(3)] + [(7, ""), (8, None), (9, letters[0] * 9)]
    found = walks.walk_mems(*frames(spark, nodes, links + links[:2], queries), k, boundary, w)
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(nodes, links, queries, k, boundary == "strict")


def test_a_cycle_goes_on_as_long_as_the_query(spark):
    nodes, links = {1: "ab", 2: "c"}, [(1, False, 2, False), (2, False, 1, False)]
    found = walks.walk_mems(*frames(spark, nodes, links, [(0, "x" + "abc" * 12 + "y")]), 20).collect()
    assert [tuple(x) for x in found] == [(1, False, 0, 0, 1, 36, 2, False, 1)]


def test_bubbles_are_one_row(spark):
    """Two ways through each of six bubbles: one match, as what it starts and ends with is the same."""
    nodes, links = {0: "begin"}, []
    for b in range(6):
        nodes |= {3 * b + 1: "same", 3 * b + 2: "same", 3 * b + 3: "join"}
        links += [(3 * b, False, 3 * b + 1, False), (3 * b, False, 3 * b + 2, False), (3 * b + 1, False, 3 * b + 3, False), (3 * b + 2, False, 3 * b + 3, False)]
    found = walks.walk_mems(*frames(spark, nodes, links, [(0, "begin" + "samejoin" * 6)]), 40, "open").collect()
    assert [(x.off, x.d, x.end_node) for x in found if x.node == 0 and x.i == 0] == [(0, 53, 18)]


def test_no_match_and_empty_tables(spark):
    nodes, links, queries = frames(spark, {1: "abc"}, [], [(0, "xyz")])
    columns = ["node", "rev", "off", "query_id", "i", "d", "end_node", "end_rev", "end_off"]
    for q in (queries, queries.limit(0)):
        found = walks.walk_mems(nodes, links, q, 2)
        assert found.columns == columns and found.count() == 0
