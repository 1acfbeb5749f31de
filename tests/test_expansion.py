"""Packets from hits over hops to links, against a plain loop."""

import json
import random

import pytest
from test_answers import plain_packet

from lattica.operators import expansion, packets

HITS, EDGES = "packet int, seed int, project int, id string", "project int, source string, target string, relation string"
NODES = "project int, id string, type string, file_path string, test boolean, described boolean, start_line int, end_line int, cost int, chunk_cost int"
KINDS = ("contains", "imports", "calls", "extends", "uses")


def tier_of(relation, direction, node):
    if relation == "contains":
        return "container" if direction == "in" else "defines"
    if node["test"] or node["file_path"].startswith("tests/"):
        return "test"
    return "caller" if direction == "in" else "import" if relation in packets.IMPORTS else "callee"


def plain_around(hits, edges, nodes, hops):
    """One packet's surroundings, row after row."""
    by_key = {(n["project"], n["id"]): n for n in nodes}
    taken, reached = {(p, i) for _, p, i in hits}, {}
    order = {(p, i): s for s, p, i in hits}
    spent, found, links, frontier = {}, [], [], [(p, i) for _, p, i in hits]
    for hop in (1, 2):
        rows = []
        for p, of in frontier:
            near = {(t, r, "out") for q, s, t, r in edges if q == p and s == of} | {(s, r, "in") for q, s, t, r in edges if q == p and t == of}
            near = [x for x in near if (p, x[0]) in by_key and not by_key[p, x[0]]["type"].startswith("external_")]
            near.sort(key=lambda x: (not by_key[p, x[0]]["described"], x[1], x[0], x[2] == "in"))
            rows += [(p, of, rank, *x) for rank, x in enumerate(near[: expansion.NEIGHBOURS], 1)]
        following = []
        for p, of, rank, node, relation, direction in sorted(rows):
            n = by_key[p, node]
            tier = tier_of(relation, direction, n)
            if (tier == "container" and n["type"] == "directory") or (hop > 1 and reached[p, of] != tier) or hop > hops.get(tier, 1):
                continue
            importer = tier == "caller" and relation in packets.IMPORTS
            group, seed = (p, of, tier, importer), order[p, of]
            most = 3 - seed if importer or tier == "import" else 8 - 2 * seed if tier == "defines" else packets.CAPS[tier]
            place = spent.get(group, 0)
            if place >= max(most, 0):
                continue
            links.append((hop, p, of, rank, relation, node, direction))
            if (p, node) in taken:
                continue
            taken.add((p, node))
            reached[p, node], order[p, node], spent[group] = tier, seed, place + 1
            found.append((hop, seed, tier, place, p, node))
            if hop < hops.get(tier, 1):
                following.append((p, node))
        frontier = following
    return found, links


@pytest.fixture(scope="module")
def world():
    rng = random.Random(3)
    nodes = [
        {"project": p, "id": f"n{i}", "type": rng.choice(["a", "a", "a", "directory", "external_x"]), "file_path": rng.choice(["src/", "src/", "tests/"]) + f"{i % 7}.py", "test": rng.random() < 0.1, "described": rng.random() < 0.5,
         "start_line": (line := rng.randrange(200)), "end_line": line + rng.randrange(4), "cost": rng.randrange(5, 30), "chunk_cost": rng.choice([None, 20, 60])}
        for p in (0, 1) for i in range(60)
    ]
    edges = [(rng.randrange(2), f"n{rng.randrange(62)}", f"n{rng.randrange(62)}", rng.choice(KINDS)) for _ in range(900)]
    edges += [(0, "n0", f"n{i}", "calls") for i in range(60)] + edges[:50]  # a hub, and repeated edges
    hits = [(k, s, rng.randrange(2), f"n{i}") for k in range(6) for s, i in enumerate(rng.sample(range(60), 4))] + [(9, 0, 0, "n0")]
    return hits, edges, nodes


def frames(spark, hits, edges, nodes):
    return spark.createDataFrame(hits, HITS), spark.createDataFrame(edges, EDGES), spark.createDataFrame([tuple(n.values()) for n in nodes], NODES)


@pytest.mark.parametrize("extra", [{}, {"caller": 2, "callee": 2, "defines": 2}])
def test_surroundings_are_those_of_the_plain_loop(spark, world, extra):
    hits, edges, nodes = world
    hops = expansion.ONE_HOP | extra
    found, links = expansion.around(*frames(spark, hits, edges, nodes), hops)
    got_found, got_links = {tuple(r) for r in found.collect()}, {tuple(r) for r in links.collect()}
    want_found, want_links = set(), set()
    for k in {h[0] for h in hits}:
        f, li = plain_around([h[1:] for h in hits if h[0] == k], edges, nodes, hops)
        want_found |= {(k, *x) for x in f}
        want_links |= {(k, *x) for x in li}
    assert got_found == want_found and got_links == want_links
    assert {x[1] for x in got_found} == ({1, 2} if extra else {1})


def test_packets_within_their_budget(spark, world):
    hits, edges, nodes = world
    hops, by_key, budget = expansion.ONE_HOP | {"caller": 2}, {(n["project"], n["id"]): n for n in world[2]}, 700
    entries, links = expansion.packet(*frames(spark, hits, edges, nodes), budget, hops)
    got = {}
    for r in entries.orderBy("packet", "turn").collect():
        got.setdefault(r.packet, []).append((r.project, r.id, r.tier, r.chunk))
    found_links = {tuple(r) for r in links.collect()}
    for k in {h[0] for h in hits}:
        own = [h[1:] for h in hits if h[0] == k]
        found, near = plain_around(own, edges, nodes, hops)
        rows = [{**by_key[p, i], "packet": k, "id": (p, i), "tier": "seed", "place": s, "seed": 0} for s, p, i in own]
        rows += [{**by_key[p, i], "packet": k, "id": (p, i), "tier": t, "place": place, "seed": s} for _, s, t, place, p, i in found]
        want = plain_packet(rows, budget - budget // expansion.RESERVE)
        assert [(*x[2], x[3], x[4]) for x in want] == got[k]
        used = sum(by_key[p, i]["cost"] + (by_key[p, i]["chunk_cost"] if chunk else 0) for p, i, _, chunk in got[k])
        kept, inside = {(p, i) for p, i, _, _ in got[k]}, set()
        for _, p, of, _, relation, node, direction in sorted(near, key=lambda x: (x[4] == "contains", *x)):
            if (p, of) in kept and (p, node) in kept:
                text = json.dumps({"project": p, "from": of, "relation": relation, "to": node, "direction": direction}, separators=(",", ":"))
                used += -(-len(text) // 4)
                if used > budget:
                    break
                inside.add((k, p, of, relation, node, direction))
        assert inside == {x for x in found_links if x[0] == k}


def test_odd_tables(spark, world):
    hits, edges, nodes = world
    none = lambda *t: [x.count() for x in expansion.packet(*frames(spark, *t), 100)]
    assert none([], edges, nodes) == [0, 0] and none(hits, [], []) == [0, 0]
    assert none([(1, 0, 0, None), (None, 0, 0, "n0"), (2, 0, None, "n0"), (3, 0, 0, "gone")], [*edges, (0, None, "n0", "calls"), (None, "n0", "n1", "calls")], nodes) == [0, 0]
    once, twice = (expansion.around(*frames(spark, h, edges, nodes))[0].collect() for h in (hits, hits + [(k, s + 3, p, i) for k, s, p, i in hits]))
    assert sorted(once) == sorted(twice)
