"""The methods against plain versions of themselves: all label sequences, all token sets, double loops, one document after another."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, embeddings, exact_dedup, jaccard, line_dedup, mixing, pii, quality, substring_dedup, urls
from lattica.operators import graph
from lattica.operators.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 9_000_000_000_000_000_000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], SCHEMA)


def plain_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t, d: 14 <= len(d) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 10 <= len(d) <= 15),
    }
    out = []
    for k, (pattern, fits) in enumerate(kinds.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if fits(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y+z@mail.example.org", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "@", ".", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+49 30 1234567", "é", " ", "\n", "7", "12", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_viterbi_finds_the_best_of_all_label_sequences():
    field = pii.trained()
    decoder = pii.Decoder(field)
    lines = ["reach joe (at) example (dot)".split(), "call (555) 010-4477".split(), ["10[.]2[.]3[.]4"], "the 4111.1111.1111.1111 x".split(), ["a"], []]
    n = len(pii.LABELS)
    for line, got in zip(lines, decoder.labels(lines), strict=True):
        if not line:
            assert len(got) == 0
            continue
        own = field.emissions(line)

        def score(labels, own=own):
            total = sum(own[t, 0, y] for t, y in enumerate(labels)) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:], strict=False))
            return total + sum(own[t - 1, 1, labels[t]] for t in range(1, len(labels))) + sum(own[t + 1, 2, labels[t]] for t in range(len(labels) - 1))

        best = max(score(y) for y in itertools.product(range(n), repeat=len(line)))
        assert score(got.tolist()) == pytest.approx(best, abs=1e-3)


def test_pii_of_odd_texts(spark):
    long_ = "word " * 40_000 + "a@b.example"
    rows = [(1, long_, "s"), (2, "x" * 300_000, "s"), (3, "a@b.c", "s"), (3, "a@b.c", "s"), (None, "1.2.3.4", None)]
    got = [(r.doc_id, [(s["start"], s["end"]) for s in r.base]) for r in pii.find_pii(frame(spark, rows), pii.trained()).collect()]
    assert sorted(got, key=str) == sorted([(1, [(200_000, 200_011)]), (2, []), (3, [(0, 5)]), (3, [(0, 5)]), (None, [(0, 7)])], key=str)


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b'])}.org/{rng.choice(['spam', 'fine', 'x'])}/{i}" + rng.choice(["", "?ref=1"])
        rows.append((url, "spam" in url or ("ref" in url and "b.org" in url) or rng.random() < 0.05))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    u = F.col("url")
    sets = [(frozenset(r.t), r.bad) for r in labelled.select(urls.tokens(u, urls.host_of(u), urls.path_of(u)).alias("t"), "bad").collect()]
    support, confidence = 0.05, 0.8
    hits, bad = Counter(), Counter()
    for items, is_bad in sets:
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), n):
                hits[part] += 1
                bad[part] += is_bad
    good = {p: bad[p] / hits[p] for p in hits if bad[p] / len(sets) >= support and bad[p] / hits[p] >= confidence}
    want = {p for p, c in good.items() if not any(good.get(tuple(x for x in p if x != drop), 0) >= c for drop in p)}
    rules = urls.mine(labelled, "url", "bad", support, confidence, min_urls=1, margin=-1)
    assert {tuple(r["items"]) for r in rules.collect()} == want and want
    blocked = {r.url for r in urls.matched(labelled, rules).collect()}
    assert blocked == {url for (url, _), (items, _) in zip(rows, sets, strict=True) if any(set(p) <= items for p in want)}


def test_random_labels_give_no_rules_and_planted_ones_do(spark):
    rng = random.Random(5)
    urls_ = [f"https://{rng.choice('abcdefgh')}.{rng.choice(['org', 'com'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(['x', 'y', 'z'])}{i % 40}/p?{rng.choice('uvw')}=1" for i in range(600)]
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(u, rng.random() < 0.25) for u in urls_]
        assert urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), "url", "bad").count() == 0
    planted = spark.createDataFrame([(u, ("/fr/" in u and "://b." in u) or bad) for u, bad in rows], "url string, bad boolean")
    rules = urls.mine(planted, "url", "bad")
    blocked = {r.url for r in urls.matched(planted, rules).collect()}
    assert blocked == {u for u in urls_ if "/fr/" in u and "://b." in u}
    few = spark.createDataFrame([(f"http://few.org/{i}", True) for i in range(9)] + [(u, False) for u in urls_], "url string, bad boolean")
    assert urls.mine(few, "url", "bad").count() == 0  # nine urls are too few


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://z.org/spam/1", "x", "y"), (1, "http://z.org/spam/1", "x", "y"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    labelled = spark.createDataFrame([("http://z.org/spam/2", True)] * 20 + [("http://z.org/" + "long/" * 20_000, False)] * 20, "url string, bad boolean")
    got = sorted((tuple(r) for r in urls.judge(pages, labelled, ()).collect()), key=str)
    assert got == [(1, "z.org", "/spam/1", None, "block")] * 2 + [(None, "", "", None, "allow")]


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(3)
    n = quality.FEATURES
    machine = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 4)))
    texts = ["One two two three. x9!", "", "a b c d e f\na b c d e f"]
    row, column, value = quality.Features()(texts)
    for i, got in enumerate(machine.scores(row, column, value, len(texts))):
        mine = [(c, v) for r, c, v in zip(row, column, value, strict=True) if r == i]
        total = machine.bias + sum(machine.weights[c] * v for c, v in mine)
        total += sum(machine.factors[a] @ machine.factors[b] * x * y for (a, x), (b, y) in itertools.combinations(mine, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-9)


def test_quality_of_odd_labels(spark):
    docs = frame(spark, [(i, f"some text {i}", "s") for i in range(20)] + [(3, "another", "s"), (None, None, None)])
    for labels in ([], [(i, 1) for i in range(20)], [(3, 1), (3, 0), (4, None), (99, 1)]):
        machine = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r.score for r in quality.score(docs, machine).select("score").collect()]
        assert len(scores) == 22 and all(0 <= x <= 1 for x in scores)


def test_ids_of_any_type(spark):
    big = spark.createDataFrame([(BIG, BIG + 5), (BIG + 5, BIG + 1), (7, 7)], "a long, b long")
    assert sorted(map(tuple, connected_components(big).collect())) == [(7, 7), (BIG, BIG), (BIG + 1, BIG), (BIG + 5, BIG)]
    text = spark.createDataFrame([("x", "y"), ("y", "b"), ("q", None)], "source string, target string")
    assert sorted(map(tuple, connected_components(text, "source", "target").collect())) == [("b", "b"), ("x", "b"), ("y", "b")]
    found = graph.communities(text.dropna(), 3)
    assert {r.id for r in found.collect()} == {"b", "x", "y"} and graph.hubs(text.dropna(), found).count() >= 1
    words = "a b c d e f g h"
    named = spark.createDataFrame([("n2", words), ("n1", words), ("n3", "z")], "doc_id string, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(named).collect())) == [("n1", 4, "n1"), ("n2", 4, "n1"), ("n3", 1, "n3")]
    vectors = spark.createDataFrame([(BIG + 1, [1.0, 0.0], 1), (BIG, [1.0, 0.01], 1), (5, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_dedup(vectors).collect())
    assert got == [(5, 0, 5), (BIG, 1, BIG), (BIG + 1, 1, BIG)]


def test_the_sketch_grows_and_is_never_cut(spark):
    assert [jaccard.sketch_bits(n) for n in (0, 4095, 4096, 10**5, 10**12)] == [16, 16, 17, 18, 18]
    docs = frame(spark, [(i, " ".join(random.Random(i % 7).choices(["an", "to", "re", "lo", "é"], k=40)) + f" own {i}", "s") for i in range(60)])
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    counts = np.random.default_rng(1).integers(1, 30_000, 1 << 16)
    lists = lambda sketch: sorted((r.id, tuple(r.lists)) for r in jaccard._short_lists(docs, sketch).collect())
    assert lists(counts) == lists(counts * 10**12)  # lengths far beyond any that 15 bits hold
    at = lambda n: {r.id: set(r.lists) for r in jaccard._short_lists(docs, n).collect()}
    hot = np.where(np.arange(1 << 16) % 3 == 0, 10**15, counts)
    assert at(hot) != at(counts)


def test_search_is_divide_skip():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 200).astype(np.uint64)
    sets = []
    for i in range(80):
        own = base.copy()
        own[rng.permutation(200)[: rng.integers(0, 60)]] = rng.integers(0, 2**62, 1)
        sets.append(np.unique(own if i % 3 else own[: rng.integers(1, 200)]))
    sets.append(np.empty(0, dtype=np.uint64))
    got = {(q, t) for q, hits in jaccard.search(sets, sets) for t in hits.tolist()}
    share = lambda a, b: len(np.intersect1d(a, b))
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a) and len(b) and 100 * share(a, b) >= 80 * (len(a) + len(b) - share(a, b))}


def test_search_merges_no_lists_of_targets_that_signatures_rule_out(monkeypatch):
    rng = np.random.default_rng(9)
    passage = rng.integers(0, 2**62, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**62, 60 + i).astype(np.uint64)])) for i in range(50)]
    sets.append(np.unique(np.concatenate([sets[0][3:], sets[1][:2]])))
    merged, met = jaccard._merged, []
    monkeypatch.setattr(jaccard, "_merged", lambda lists, least: met.extend(lists) or merged(lists, least))
    got = {(q, t) for q, hits in jaccard.search(sets, sets) for t in hits.tolist()}
    assert got == {(i, i) for i in range(51)} | {(0, 50), (50, 0)}
    assert sum(map(len, met)) < 10_000  # of 100,000 and more in the passage's lists alone


def test_vectors_of_every_length_in_doubles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "COARSE", 3)  # finer cells below few coarse ones
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(size=8) * rng.choice([0.01, 0.15])).tolist(), i % 2) for i in range(200)]
    rows += [(300, [1.0, 0.0], 1), (301, [1.0, 1e-9], 1), (302, [1.0] * 5, 1), (303, [1.0] * 5, 1), (304, [], 1), (305, [1e-200, 0.0], 1)]
    near = 0.93
    edge = [1.0, float(np.sqrt(1 / near**2 - 1)) * (1 - 1e-12)]  # a cosine that single precision would put on either side
    rows += [(306, edge, 7), (307, [1.0, 0.0], 7)]
    got = {r.vec_id: r.n_links for r in embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    one = lambda v: v / np.abs(v).max()
    cos = lambda a, b: np.dot(one(a), one(b)) / (np.linalg.norm(one(a)) * np.linalg.norm(one(b)))
    want = Counter()
    for a, b in itertools.permutations([r for r in rows if any(r[1])], 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(np.array(a[1]), np.array(b[1])) >= near:
            want[a[0]] += 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * sum(want.values())
    assert (got[302], got[303], got[304], got[306], got[307]) == (1, 1, 0, 1, 1) and got[300] == got[301] == got[305] == 2
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_dedup(empty).count() == 0


def test_substring_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 200)
    monkeypatch.setattr(substring_dedup, "PART", 3)
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(90)]
    rows = [(i, " ".join([f"r{rng.randrange(99)}" for _ in range(rng.randrange(30))] + passage[rng.randrange(25) :] + [f"e{i}"] * rng.randrange(3)), "s") for i in range(40)]
    rows += [(3, " ".join(passage), "s"), (None, " ".join(passage), "s"), (50, None, None), (51, " ".join(["ab"] * 300), "s"), (52, " ".join(["ab"] * 200), "s")]
    first = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        w = WORDS(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)

    def kept(i, t):
        w = WORDS(t or "")
        gone = set() if i is None else {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        return i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)

    got = sorted(map(tuple, substring_dedup.substring_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted((kept(i, t) for i, t, _ in rows), key=str)


def test_native_operators_on_odd_ids(spark):
    rows = [(None, "a line of text", "s"), (None, "a line of text", "s"), (4, "a line of text", "s"), (4, "other words", None), (9, "a line of text\nother words", None)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows), block_chars=4).collect()), key=str)
    assert got == sorted([(4, 4, 3, True), (None, 4, 3, False), (None, 4, 3, False), (4, 4, 1, True), (9, 9, 1, True)], key=str)
    clash = frame(spark, rows).withColumns({"n_lines": F.lit("x"), "_key": F.lit("y")})
    out = line_dedup.line_dedup(clash)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "_key", "n_lines", "n_dropped"]
    texts = sorted(((r.doc_id, r.text, r.n_dropped) for r in out.collect()), key=str)
    assert texts == sorted([(4, "a line of text", 0), (4, "other words", 0), (9, "", 2), (None, "", 1), (None, "", 1)], key=str)


def test_an_empty_id_is_not_a_null_one(spark):
    rows = [("", "a line of text"), (None, "a line of text"), ("x", "a line of text")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {(r.doc_id, r.text) for r in out.collect()} == {("", "a line of text"), (None, ""), ("x", "")}


def test_long_texts_have_as_many_blocks_as_they_need(spark):
    rows = [(1, "x" * 300_000, "s"), (2, "x" * 300_000, "s"), (3, "x" * 299_999 + "y", "s")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(frame(spark, rows), block_chars=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """rows: (id, size, source) -> taken, by resharing the excess until none is above."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    size = {n: sum(z for _, z, s in rows if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(size.values()) - sum(most * size[n] for n in full)
        open_ = sum(weight[n] for n in names if n not in full)
        target = {n: most * size[n] if n in full else left * weight[n] / open_ for n in names}
        above = {n for n in names if n not in full and target[n] >= most * size[n]}
        if not above:
            break
        full |= above
        if len(full) == len(names):
            target = {n: most * size[n] for n in names}
            break
    out = {}
    for n in names:
        own = sorted(((hashlib.md5(f"0:{i}".encode()).hexdigest(), i, z) for i, z, s in rows if s == n))
        epochs = int(target[n] // size[n]) if size[n] else 0
        left = int(target[n] + 1e-9) - epochs * size[n]
        for _, i, z in own:
            part = max(0, min(z, left))
            out[i] = epochs * z + part
            left -= part
    return out


def test_mixing_by_hand(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(200)]
    got = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows), ranges=1, per_range=20).collect()}
    assert got == plain_mix([(i, len(WORDS(t)), s) for i, t, s in rows])
    one = mixing.mix(frame(spark, [(1, "a b", "s"), (2, None, "s"), (None, "c d e", "s"), (None, "f", "s")]), carry=("size", "lang"))
    assert one.columns == ["doc_id", "source", "lang", "size", "source_size", "target", "taken"] and sum(r.taken for r in one.collect()) == 9
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect()] == [0, 0]


def test_long_pieces(spark):
    import public_tokenizers
    import tiktoken

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["y" * 6001, "ab" * 2000, "".join(rng.choice("abcdefghij") for _ in range(5000)), "字" * 900, "!" * 3000, None, ""]
    rows = bpe.encode_decode(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), vocabulary, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert r.ids == known.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def shingles(text):
    w = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_pipeline(spark, docs, labels, machine):
    import public_tokenizers
    import tiktoken

    features = quality.Features()
    rows = [r for r in docs if machine.scores(*features([r.text or ""]), 1)[0] >= 0.5]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            holders.setdefault(key(line), set()).add(r.doc_id)
    left, raw = [], {r.doc_id: r.text or "" for r in rows}
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r.doc_id]
        left.append((r.doc_id, "\n".join(kept), r.source))
    gone = set()
    for texts in ({i: t for i, t, _ in left}, raw):
        sets = {i: shingles(t) for i, t in texts.items()}
        root = {i: i for i in sets}
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
        gone |= {i for i, x in root.items() if x != i}
    left = [x for x in left if x[0] not in gone]
    taken = plain_mix([(i, len(WORDS(t)), s) for i, t, s in left])
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    out = []
    for i, t, _ in left:
        words = WORDS(t)
        if words:
            whole, rest = divmod(taken[i], len(words))
            out += [(i, x) for x in [t] * whole + ([" ".join(words[:rest])] if rest else [])]
    return Counter((i, tuple(known.encode_ordinary(t))) for i, t in out)


def test_pipeline_is_the_plain_one(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.train(docs.select("doc_id", "text"), labels)
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, where).collect())
    assert got == plain_pipeline(spark, docs.collect(), labels, machine) and got


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "some plain words of text here", "s"), (1, "some plain words of text here", "s"), (None, None, None), (None, "other words that stand alone", None), (2, "", "t"), (3, "long " * 20_000, "t")]
    for docs in (frame(spark, rows), frame(spark, [])):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        docs = docs.withColumns({"score": F.lit("x"), "n_lines": F.lit(1), "_range": F.lit(2)})
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 3 * len(rows) and (docs.limit(1).count() or not out.count())
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
