"""Names in files that build and deploy."""

import random

from pyspark.sql import functions as F

from lattica.functions import folds
from lattica.functions import text as tx
from lattica.sources import builds

HEAD = "project string, path string, text string"


def names(spark, *files):
    rows = spark.createDataFrame([("p", path, text) for path, text in files], HEAD)
    return sorted((r.path, r.kind, r.name, r.provided, r.holder) for r in builds.build_names(rows).collect())


def test_images_of_make_files(spark):
    text = "export R ?= reg.io/team\nA=$(B)\nB=${C}\nC=$(R)/deep\nLOOP=$(LOOP)x\nD=docker\nX = a\nX := b\n"
    got = names(spark, ("m/Makefile", text + "i:\n\t$(D) buildx build --tag=$(A)/one:$(V) --build-arg x=y --push ../ctx/\n\tdocker build -t '$(X)/two' .\n\tdocker build -t $(LOOP)/three ../../out\n\tdocker build -t plain .\n"))
    assert got == [("m/Makefile", "image", "b/two", True, "m/"), ("m/Makefile", "image", "reg.io/team/deep/one", True, "ctx/")]


def test_levels_of_references(spark):
    chain = "".join(f"V{i}=$(V{i + 1})\n" for i in range(8)) + "V8=r/x\n"
    got = names(spark, ("a.mk", chain + "\tdocker push $(V4)\n\tdocker push $(V3)\n"), ("b.mk", "A=" + "$(A)" * 900 + "\n\tdocker push $(A)/x\n\tdocker push ok/x\n"))
    assert [(p, n) for p, _, n, _, _ in got] == [("a.mk", "r/x"), ("b.mk", "ok/x")]  # five levels are written out, a sixth is not


def test_images_of_shell_files(spark):
    text = "#!/usr/bin/env bash\nD=\"/usr/bin/docker\"\nlocal N='q/name'\nM=${Z:-r/$N}\n$D build -f F -t local/tmp \\\n  --no-cache sub\n${D} tag local/tmp $M:${T%.*} ; true\ndocker image push \"$M:1\" && docker push `x`/y\ndocker push $(x)/y\n"
    want = [("image", "r/q/name", True, "s/sub/")]
    assert [r[1:] for r in names(spark, ("s/build", text))] == want and [r[1:] for r in names(spark, ("s/b.sh", text))] == want
    assert names(spark, ("s/build", text[3:]), ("s/x.py", text)) == []


def test_machines_and_records(spark):
    text = '\n'.join(['resource "hcloud_server" "a" {', '  name = "One.example.com" // {', '  labels = { name = "no.example.com" }', '  hostname = "two.example.com"', '  network {', '    name = "three.example.com"', '  }', '}',
        'name = "four.example.com"', 'resource "aws_instance" "b" { name = "five.example.com" }', 'resource "azurerm_dns_a_record" "c" {', '  records = [', '    "six.example.com.", "a\\"}.example.com", "${v}.example.com",', '    "bare" ]', '  ttl = 3', '}',
        'resource "other" "d" {', '  name = "seven.example.com"', '}'])
    got = [(n, provided) for _, _, n, provided, _ in names(spark, ("x/a.tf", text))]
    assert got == [("one.example.com", True), ("six.example.com", False), ("two.example.com", True)]


def test_inventories_composes_and_circuits(spark):
    inventory = "# note\n---\nall:\n  hosts:\n    a[1:2].example.com:\n    'b.example.com': {x: 1}\n    short:\n  vars:\n    hosts:\n      no.example.com:\n  children:\n    web:\n      hosts: {c.example.com: , d.example.com: {hosts: 1}}\n    list:\n      - hosts:\n          no.example.com:\n---\nhosts:\n  no.example.com:\n"
    assert [r[2] for r in names(spark, ("i/hosts.yml", inventory), ("i/else.yml", inventory))] == ["a1.example.com", "a2.example.com", "b.example.com", "c.example.com", "d.example.com"]
    compose = "data:\n  f: |-\n    services:\n      x:\n        image: 'q/x:1' # one\n        build:\n          image: no\n  services:\n    y:\n      image: no\n"
    assert names(spark, ("v.yaml", compose)) == [("v.yaml", "image", "q/x", False, "v.yaml")]
    circuit = "instances:\n  a:\n    buckets:\n      no: 1\n  b: {}\nbuckets:\n  C:\nother:\n  d:\n"
    assert [r[1:4] for r in names(spark, ("c/config.yml", circuit), ("c/x.tf", ""))] == [("bucket", "c", True), ("host", "a", True), ("host", "b", True)]
    assert names(spark, ("c/config.yml", circuit), ("d/x.tf", "")) == []


def test_odd_tables(spark):
    assert names(spark) == [] and names(spark, ("Makefile", None), (None, "x"), ("Makefile", ""), ("a.tf", ""), ("hosts.yml", ""), ("config.yml", "")) == []
    twice = ("Makefile", "X_BUCKET = B$(N)\nY_BUCKET=B\n\tdocker push a/b\n")
    assert names(spark, twice, twice) == [("Makefile", "bucket", "b", False, "Makefile"), ("Makefile", "image", "a/b", True, "./")]


def test_data_files_are_outlined_once(spark):
    """Three readers use the outlines, which are written before."""
    files = spark.createDataFrame([("p", "hosts.yml", "hosts:\n  a.example.com:\n")], HEAD)
    found = builds.build_names(files)
    assert "^---" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.name for r in found.collect()] == ["a.example.com"]


def test_walked_and_outline_against_plain_ones(spark):
    """Sums that start again, over many blocks; paths by a stack."""
    rng = random.Random(7)
    texts = ["", "5"] + ["\n".join(str(rng.randrange(9)) for _ in range(n)) for n in (255, 256, 257, 3000)]
    step = lambda s, x: F.struct(F.when(x == "0", 0).otherwise(s["sum"] + F.coalesce(x.try_cast("int"), F.lit(0))).alias("sum"), F.when(x == "0", F.array(s["sum"])).otherwise(F.array().cast("array<int>")).alias("said"))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("x", folds.walked(F.split("t", "\n"), {"sum": F.lit(0)}, step, "int"))
    for r in rows.collect():
        want, total = [], 0
        for x in r.t.split("\n"):
            if x == "0":
                want.append(total)
            total = 0 if x == "0" else total + int(x or 0)
        assert r.x == want

    lines, want, stack = [], [], []
    for i in range(2000):
        indent = 2 * rng.randrange(min(len(stack) + 2, 7))
        stack = [(a, k) for a, k in stack if a < indent] + [(indent, f"k{i}")]
        lines += [" " * indent + f"k{i}: v{i}"] + ["", "  # x: y"][: rng.randrange(3)]
        want.append(([k for _, k in stack], f"v{i}"))
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(folds.outline(F.col("t"))).first()[0]
    assert [(x["keys"], x["value"]) for x in got] == want
    assert spark.createDataFrame([(None,)], "t string").select(folds.outline(F.col("t"))).first()[0] is None


def test_spelling_of_every_kind(spark):
    cases = [
        ("image", "reg:5000/a/b:1", "reg:5000/a/b"), ("image", "library/x", "x"), ("image", "a/b@sha256:0", "a/b"), ("pypi", "A..b_c[x]>=1", "a-b-c"), ("pypi", "-x", ""), ("role", "a/b/web/", "web"),
        ("host", "A.b..", "a.b"), ("bucket", " Data ", "data"), ("package", "%{name}-x", ""), ("package", "Lib", "lib"), ("tfmodule", "git::ssh://git@Host.com/a/b.git//m?ref=1", "host.com/a/b//m"),
        ("tfmodule", "git@host.com:a/b.git", "host.com/a/b"), ("tfmodule", "host.com:8443/a", "host.com:8443/a"), ("npm", "a$b", ""), ("npm", "x" * 300, "x" * 255), ("npm", None, None), ("npm", "", ""),
    ]
    rows = spark.createDataFrame([(i, k, n) for i, (k, n, _) in enumerate(cases)], "i int, k string, n string")
    got = {r.i: r.x for r in rows.select("i", tx.normalize_name(F.col("k"), F.col("n")).alias("x")).collect()}
    for i, (kind, raw, want) in enumerate(cases):
        assert got[i] == want, (kind, raw, got[i])
