"""Ranked search, prefix trie and exact top-k on odd tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import inner, ranked, trie

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
DOCS = "doc_id long, text string, score long, rank string, item_id string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_ranking(docs, items, k=10):
    counted = [(i, Counter(TERMS(lower(t)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERMS(lower(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m, score = 25 + (75 * c.total() * n_docs) // max(n_terms, 1), 0
            for t in terms.keys() & c.keys():
                score += terms[t] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda e: (e[0], e[1], e[2] or 0))[:k]
        out += [(item, r, e[2], -e[0]) for r, e in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pairs", [500_000, 5])
def test_ranked_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(ranked, "PAIRS", pairs)  # several blocks of items
    rng = random.Random(4)
    words = ["an", "AN", "Ça", "ça", "x1", "Été", "rare", "zwölf", "the", "thé"]
    texts = [rng.choice([" ", "\n", "-", "\x00"]).join(rng.choices(words, [9, 5, 4, 3, 3, 2, 1, 1, 9, 2], k=rng.randint(1, 60))) for _ in range(80)]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (4, " -- "), (5, "an " * 4000), (None, texts[3]), (7, texts[5]), (7, texts[5]), (8, "x" * 30_000)]
    items = [(0, "an the an"), (1, None), (2, ""), (3, "unknown"), (4, "RARE ça"), (4, "x1"), (None, "zwölf"), (9, texts[7]), (9, texts[7])]
    frame = spark.createDataFrame([(i, t, 0, "r", "i") for i, t in docs], DOCS).repartition(5)
    asks = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked.ranked_search(frame, asks).collect()]
    assert sorted(got, key=repr) == plain_ranking(docs, items)
    assert len(got) == 40


def test_ranked_search_of_nothing(spark):
    docs, asks = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "an ox")], "item_id long, text string")
    blank = spark.createDataFrame([(1, None, 0, "", "")], DOCS)
    for d, a in ((docs, asks), (docs, some), (blank, some), (blank, asks)):
        assert ranked.ranked_search(d, a).collect() == []


def test_term_counts_by_pieces(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 7)
    text = "An ox, Été  " * 40 + "y" * 100 + " -- " + "ox" * 9
    assert ranked.term_counts(text.encode()) == Counter(t.encode() for t in TERMS(lower(text)))
    assert not ranked.term_counts(b"") and not ranked.term_counts(b" -- ")


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 2**50, 5000, dtype=np.uint64)
    keys[::7] = keys[0]
    assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked.radix_order(keys[:0])) == 0


def plain_trie(rows, spliced=True):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 if spliced else 0 for c in own}
    built = {c: [*own.get(c - c % 5, [])[: h[c]], *own[c][h[c] :]] for c in own}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1].encode()) if key else 0
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(c for c in m if len(built[c]) == len(k))) for k, m in nodes.items()
    )


def conversations():
    rng = random.Random(8)
    texts = ["Hé", "go on", None, "", "so it is", "no"]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # many of one text
    rows += [(200, t, "user", f"{t}") for t in range(120)] + [(201, t, "user", f"{t}") for t in range(12)]  # a long one
    rows += [(50, None, "user", "first"), (50, 0, "bot", "tie"), (50, 0, "bot", "tie"), (50, 0, "bot", "also"), (None, 1, "user", "nobody"), (51, 3, "", "x" * 9000)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, n string"


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 4)
    rows = conversations()
    table = spark.createDataFrame([(*r, 0, "") for r in rows], CONVERSATIONS).repartition(4)
    turns, convs = trie.numbered(table)
    conv = F.col("conv")
    built = trie.respliced(turns, convs, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    for got, want in ((trie.prefix_trie(*built), plain_trie(rows)), (trie.prefix_trie(turns, convs), plain_trie(rows, False))):
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])


def test_prefix_trie_of_turnless_and_no_conversations(spark):
    table = spark.createDataFrame([], CONVERSATIONS)
    assert trie.prefix_trie(*trie.numbered(table)).collect() == []
    turns, convs = trie.numbered(table)
    convs = spark.createDataFrame([(7, 0), (3, 0)], "conv long, n long")
    (root,) = trie.prefix_trie(turns, convs).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 0, 2, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(b"3,7").hexdigest()


def plain_top(rows, k=5):
    good = [(i, r, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, r, q in good:
        if i is not None and i % 50 == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(map(lambda a, b: a * b, q, v)))), j is None, j or 0, j) for j, s, v in good if s != r and len(v) == len(q)]
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(scores, key=lambda e: e[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_top_inner(spark, monkeypatch):
    monkeypatch.setattr(inner, "COMPONENTS", 400)  # many blocks
    monkeypatch.setattr(inner, "FIRST_QUERIES", 3)
    monkeypatch.setattr(inner, "QUERIES", 2)
    rng = np.random.default_rng(2)
    scale = rng.choice([0.1, 1, 1, 5], 400)
    rows = [(int(i), (rng.normal(size=12) * scale[i]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(1050, rows[7][1]), (1050, rows[8][1])]  # ties, a repeated id
    rows += [(2000, None), (2050, []), (2051, []), (2100, [0.0] * 12), (2101, [None] * 12), (2102, [float("nan")] * 12), (2103, [float("inf")] * 12), (None, rows[3][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3050, [1e17, 3e16]), (3051, [1e17, -1e17]), (3052, [7e15, 1e16])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, score int, query_id int").coalesce(1)
    got = sorted((tuple(r) for r in inner.top_inner(table).collect()), key=repr)
    assert got == plain_top(rows)
    assert inner.top_inner(table.limit(0)).collect() == []


def test_bounds_prune(spark):
    """With few directions that matter, nearly no pair needs its exact product."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(3000, 64)) * np.exp(-np.arange(64) / 4) * rng.lognormal(size=(3000, 1)))
    rotation = np.linalg.svd(x.T @ x)[0]
    exact = []
    seen = inner.exact_products
    targets = inner.Targets(list(range(3000)), np.arange(3000), x, rotation)
    inner.exact_products = lambda q, v, b: exact.append(len(q)) or seen(q, v, b)
    try:
        best = targets.search(x[:50], np.arange(50), np.full(50, inner.NONE), 5)
    finally:
        inner.exact_products = seen
    assert len(best.query) == 250 and sum(exact) < 0.5 * 50 * 3000
