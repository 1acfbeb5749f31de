"""The training-data operators on small tables with nulls, empty texts, repeats and clashing columns, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, embeddings, exact_dedup, jaccard, line_dedup, mixing, pii, quality, substring_dedup, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, list string"


def texts(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    """Invented texts: near copies, shared passages and lines, empty, null and very long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "Ti", "é", "lo", "re", "x1"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(3, 160))) for _ in range(12)]
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        t = base[rng.randrange(len(base))].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            t[rng.randrange(len(t))] = word()
        text = rng.choice([" ", "\t", "\n"]).join(t) + rng.choice(["", "\nthe same line again\n", f" {passage} tail"])
        out.append((i * 3 + 1, text))
    return [*out, (2, None), (5, ""), (8, " \n\t"), (11, "one"), (14, "One"), (17, "y" * 9000), (20, " ".join(["ab"] * 400)), (23, " ".join(["ab"] * 400))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 4}", 0, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def components(ids, links):
    root = {i: i for i in ids}
    for a, b in sorted(links):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_exact_dedup(docs, empty):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts()]
    got = collected(exact_dedup.exact_dedup(docs, block_chars=16))
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = sorted(((i, (t or "").split("\n")) for i, t in texts()), key=lambda x: x[0])
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, {}
    for i, lines in rows:
        for k in map(key, lines):
            first.setdefault(k, i)
            holders.setdefault(k, set()).add(i)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()}
    for i, lines in rows:
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and first[key(x)] != i)]
        assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.line_dedup(empty).count() == 0


def test_jaccard(spark, docs, empty):
    lower = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in texts():
        w = WORDS(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert collected(jaccard.near_duplicates(docs)) == {i: (len(s), want[i]) for i, s in sets.items()}
    assert jaccard.near_duplicates(empty).count() == 0
    none = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "x")])
    assert sorted((tuple(r) for r in jaccard.near_duplicates(none).collect()), key=str) == [(3, 1, 3), (3, 2, 3), (None, 2, None), (None, 2, None)]


def test_jaccard_blocks(spark, monkeypatch):
    """Long lists go through blocks: a hub, its near copies, and many that only share a passage with it."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    monkeypatch.setattr(jaccard, "TARGETS", 5)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(i % 7):
            t[rng.randrange(len(t))] = f"n{rng.random()}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: c for i, (_, c) in collected(jaccard.near_duplicates(frame(spark, rows))).items()} == want


def test_substring(docs, empty):
    rows = sorted(((i, WORDS(t or "")) for i, t in texts()), key=lambda x: x[0])
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = collected(substring_dedup.substring_dedup(docs))
    for i, w in rows:
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        assert got[i] == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    assert any(g[1] for g in got.values()) and substring_dedup.substring_dedup(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {i: len(WORDS(t or "")) for i, t in texts()}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1
    assert collected(mixing.mix(docs)) == collected(mixing.mix(docs.repartition(5))) and mixing.mix(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 16))
    rows = []
    for i in range(300):
        v = centres[i % 9] + rng.normal(size=16) * rng.choice([0.02, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, "x"))
    rows += [(400, rows[5][1], 2, "x"), (401, rows[5][1], 2, "x"), (402, None, 2, "x"), (403, [0.0] * 16, 2, "x"), (404, rows[5][1], None, "x"), (405, [float("nan")] * 16, 2, "x"), (406, [1.0, None] * 8, 2, "x"), (407, [], 1, "x")]
    got = collected(embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")))
    fine = {i: (np.array(v), label) for i, v, label, _ in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and cos(fine[a][0], fine[b][0]) >= 0.93]
    want, n = components([r[0] for r in rows], links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    found = sum(g[0] for g in got.values())
    assert found >= 0.9 * 2 * len(links) and all(got[i][0] <= n.get(i, 0) for i in got)
    if found == 2 * len(links):
        assert got == {i: (n.get(i, 0), c, i == c) for i, c in want.items()}


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for i, (n, ids, decoded) in collected(bpe.encode_decode(docs, vocabulary, public_tokenizers.PATTERN)).items():
        text = dict(texts())[i] or ""
        assert ids == known.encode_ordinary(text) and n == len(ids) and bytes(decoded).decode() == text
    assert bpe.encode_decode(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_pii(spark, empty):
    rows = [
        (1, "mail a.b+c@x.example.org, then 10.2.3.4 and 300.1.1.1; 4111 1111-1111 1111; +1 (555) 010-9999 end"),
        (2, None), (3, ""), (4, "reach joe (at) example (dot) com or 555-010-4477"), (5, "1.2.3.4.5 @ a@b 12"),
    ]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows), pii.trained()).collect()}
    text = rows[0][1]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in got[1]["base"]] == [
        ("email", "a.b+c@x.example.org"), ("ip", "10.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 010-9999"),
    ]
    assert not got[2]["spans"] and not got[3]["spans"] and len(got[4]["spans"]) > len(got[4]["base"]) == 0
    for r in got.values():
        assert all(s in r["spans"] for s in r["base"])
    assert pii.find_pii(empty, pii.trained()).count() == 0


def test_urls(spark):
    rules = (urls.Rule("block", "com", "/en/"), urls.Rule("allow", "example.com", "/en/7"))
    rows = [(1, "http://A.Example.com/en/70?x"), (2, "http://b.com/en/1"), (3, None), (4, "no scheme"), (5, "http://com"), (6, "https://q.org/spam/1"), (7, "https://q.org/fine/1"), (8, "http://xcom/en/")]
    labelled = [(f"https://z.org/spam/{i}", True) for i in range(20)] + [(f"https://z.org/fine/{i}", False) for i in range(20)] + [(None, True), ("http://a/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = collected(urls.judge(pages, spark.createDataFrame(labelled, "url string, bad boolean"), rules))
    assert got == {
        1: ("a.example.com", "/en/70", "example.com/en/7", "allow"), 2: ("b.com", "/en/1", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("com", "", None, "allow"), 6: ("q.org", "/spam/1", None, "block"), 7: ("q.org", "/fine/1", None, "allow"), 8: ("xcom", "/en/", None, "allow"),
    }
    none = urls.judge(pages.limit(0), spark.createDataFrame([], "url string, bad boolean"), rules)
    assert none.count() == 0


def test_quality_held_out(spark, empty):
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").alias("q"))
    machine = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.score(labelled, machine).filter(quality.held_out("doc_id")).select("q", "score").toPandas()
    assert ((got.score >= 0.5) == (got.q == 1)).mean() > 0.85
    odd = quality.score(frame(spark, [(1, None), (2, ""), (3, "z " * 50000)]), machine).select("score").toPandas()
    assert odd.score.between(0, 1).all() and quality.score(empty, machine).count() == 0


def test_pipeline_keeps_what_the_stages_say(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, where)
        assert now.columns == docs.columns, name
        assert now.join(before, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            texts = before, docs.join(before, "doc_id", "left_semi")
            gone = {r.doc_id for t in texts for r in jaccard.near_duplicates(t).filter("doc_id != component_id").collect()}
            assert sorted(r[0] for r in now.select("doc_id").collect()) == sorted(r[0] for r in before.select("doc_id").collect() if r[0] not in gone)
    assert now.count() == corpus_pipeline.run(spark, where).count()


def test_pipeline_leaves_no_near_copy_and_loses_nothing_else(spark):
    """At sf0.01, without the quality stage: near copies by their whole texts go, and only they or near copies by what the lines left."""
    import corpus_pipeline

    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    lines = corpus_pipeline.without_repeated_lines(spark, docs, where)
    kept = {r[0] for r in corpus_pipeline.one_of_near_copies(spark, lines, where).select("doc_id").collect()}
    whole = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    left = {r.doc_id: r.component_id for r in jaccard.near_duplicates(lines).collect()}
    assert len(kept) == len({whole[i] for i in kept}) == len({left[i] for i in kept})
    assert all(whole[i] != i or left[i] != i for i in set(whole) - kept)
