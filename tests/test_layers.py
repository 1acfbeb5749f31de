"""Layered data: patterns with repeated variables, the first layer of a file, what keys lead to."""

import re

from lattica.operators import layers

PATTERNS = [
    (1, "data/", 0, "nodes/{node}.yaml"), (1, "data/", 1, "{env}/{site}-{env}.yaml"), (1, "data/", 2, "{env}/{any}.yaml"), (1, "data/", 3, "common.yaml"),
    (2, "", 0, "a.b\\E(x)/{x}-{x}+{y}.yaml"),
]
FILES = [
    "data/nodes/n1.yaml", "data/prod/s1-prod.yaml", "data/prod/s1-test.yaml", "data/prod/a/b.yaml", "data/common.yaml", "data/x/-x.yaml", "other/nodes/n9.yaml", "data/prod/s1-prod.yaml", None,
    "modules/web/README.md", "modules/web/code/main.py", "modules/db/x.txt", "modules/db/data/requires.yaml", "modules/top.py",
]


def tables(spark, entries):
    patterns = spark.createDataFrame(PATTERNS, "space int, data_dir string, place int, pattern string")
    rows = [(1, f) for f in FILES] + [(2, "a.b\\E(x)/p-q-p-q+r.yaml"), (2, "aXb(x)/p-p+r.yaml"), (2, "a.b\\E(x)/p-q+r.yaml")]
    return patterns, spark.createDataFrame(rows, "space int, path string"), spark.createDataFrame(entries, "space int, path string, key string, value string, listed boolean")


def plain(pattern):
    """The pattern as python writes it."""
    seen, out = set(), ""
    for i, x in enumerate(re.split(r"\{(\w+)\}", pattern)):
        out += re.escape(x) if i % 2 == 0 else f"(?P={x})" if x in seen else f"(?P<{x}>[^/]+)"
        seen |= {x} if i % 2 else set()
    return re.compile(out)


def test_values_that_files_stand_for(spark):
    patterns, files, _ = tables(spark, [])
    got = {(r.space, r.variable, r.value, r.path) for r in layers.filled(patterns, files).collect()}
    want = {}
    for space, path in sorted({(r.space, r.path) for r in files.collect() if r.path}):
        for s, where, _, pattern in PATTERNS:
            inside = path[len(where) :] if s == space and path.startswith(where) and "{" in pattern else ""
            if match := plain(pattern).fullmatch(inside):
                for variable, value in match.groupdict().items():
                    want.setdefault((space, variable, value), path)
                break
    assert got == {(*k, v) for k, v in want.items()} and (1, "site", "s1", "data/prod/s1-prod.yaml") in got and (1, "any", "s1-test", "data/prod/s1-test.yaml") in got
    assert (2, "x", "p-q", "a.b\\E(x)/p-q-p-q+r.yaml") in got and len([x for x in got if x[0] == 2]) == 2


def test_what_keys_lead_to(spark):
    at = "data/nodes/n1.yaml"
    entries = [
        (1, at, "env", "prod", False), (1, at, "node", "n1", False), (1, at, "env", "none", False), (1, at, "env", None, False), (1, at, "env", "prod", True), (1, at, "web", None, False),
        (1, at, "db", "x", False), (1, at, "modules", "web", True), (1, at, "modules", "gone", True), (1, at, "modules", "web", False), (1, at, "modules", None, True),
        (1, "modules/db/data/requires.yaml", "web", None, False), (2, at, "web", None, False), (1, at, "env", "prod", False), (1, at, None, None, False),
    ]
    patterns, files, said = tables(spark, entries)
    assert {tuple(r) for r in layers.modules(files).collect()} == {(1, "web", "modules/web/code/main.py"), (1, "db", "modules/db/")}
    got = sorted(tuple(r) for r in layers.followed(patterns, files, said).collect())
    assert got == sorted(
        [(1, at, "data/prod/s1-prod.yaml", "selects"), (1, at, "modules/web/code/main.py", "configures"), (1, at, "modules/db/", "configures"), (1, at, "modules/web/code/main.py", "includes_module")]
    )
    named = {tuple(r)[1:] for r in layers.names(patterns, files, said).collect()}
    assert ("taken", "deploy-module", "gone", at) in named and ("provided", "deploy-role", "prod", "data/prod/s1-prod.yaml") in named
    assert ("provided", "deploy-module", "web", "modules/web/") in named and not any(n[2] == "s1" for n in named)
    assert layers.followed(patterns, files, said.limit(0)).count() == 0 and layers.followed(patterns.limit(0), files, said).count() == 3
