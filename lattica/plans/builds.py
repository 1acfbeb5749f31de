"""Queries on files that build and deploy: a nation is a project, each of its customers a file of one of six forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..session import stage
from ..sources import builds
from .registry import query

#: (path, text) by the customer's number; {k} is the number, {n} its rest by 7, {s} the market segment.
FILES = [
    ("a{k}/Makefile", "REG := reg.example.com\nNS = $(REG)/{s}\nTAG ?= $(shell git describe)\nDATA_BUCKET := Data-{n}\nall:\n\tdocker build --platform linux/amd64 -t $(NS)/app{n}:$(TAG) -f x/Dockerfile ./src\n\tdocker push $(NS)/app{n}:$(TAG)\n"),
    ("b{k}/run.sh", "#!/bin/sh\nT=/usr/bin/podman\nexport HOST=\"${{OTHER:-reg{n}.example.com}}\"\n$T build -t tool \\\n  .\n$T tag tool $HOST/ops/tool-{k}:1 && echo done\n$T push $HOST/ops/tool-{k}:1\n"),
    ("c{k}/main.tf", 'resource "aws_instance" "a" {{ # {{\n  tags = {{\n    Name = "VM{k}.example.com"\n  }}\n  disk {{\n    name = "no.example.com"\n  }}\n}}\nresource "aws_route53_record" "b" {{\n  name    = "www{n}.example.com"\n  records = [\n    "vm{k}.example.com.",\n    "${{x}}.example.com",\n  ]\n}}\n'),
    ("d{k}/hosts.yml", "all:\n  vars:\n    hosts:\n      v.example.com:\n  children:\n    {s}:\n      hosts:\n        web[08:1{n}].example.com: {{port: 1}}\n        db{k}.example.com:\n          ip: 10.0.0.1\n"),
    ("e{k}/values.yaml", "name: x\nstack: |\n  version: '3'\n  services:\n    web:\n      image: docker.io/{s}/web{n}:2\n    db:\n      image: postgres\nservices:\n  web:\n    image: no/no\n"),
    ("f{k}/config.yaml", "instances:\n  i{k}:\n    size: 2\nbuckets:\n  Logs-{n}: {{}}\n"),
]


@query(
    """WITH c AS (SELECT c_nationkey AS project, c_custkey AS k, c_custkey % 7 AS n, c_custkey % 6 AS f, lower(c_mktsegment) AS s FROM customer)
    SELECT project, 'a' || k || '/Makefile' AS path, 'image' AS kind, 'reg.example.com/' || s || '/app' || n AS name, true AS provided, 'a' || k || '/src/' AS holder FROM c WHERE f = 0
    UNION ALL SELECT project, 'a' || k || '/Makefile', 'bucket', 'data-' || n, false, 'a' || k || '/Makefile' FROM c WHERE f = 0
    UNION ALL SELECT project, 'b' || k || '/run.sh', 'image', 'reg' || n || '.example.com/ops/tool-' || k, true, 'b' || k || '/' FROM c WHERE f = 1
    UNION ALL SELECT project, 'c' || k || '/main.tf', 'host', 'vm' || k || '.example.com', unnest([true, false]), 'c' || k || '/main.tf' FROM c WHERE f = 2
    UNION ALL SELECT project, 'c' || k || '/main.tf', 'host', 'www' || n || '.example.com', false, 'c' || k || '/main.tf' FROM c WHERE f = 2
    UNION ALL SELECT project, 'd' || k || '/hosts.yml', 'host', 'web' || lpad(CAST(x AS VARCHAR), 2, '0') || '.example.com', false, 'd' || k || '/hosts.yml' FROM c, (SELECT unnest(range(8, 17)) AS x) WHERE f = 3 AND x <= 10 + n
    UNION ALL SELECT project, 'd' || k || '/hosts.yml', 'host', 'db' || k || '.example.com', false, 'd' || k || '/hosts.yml' FROM c WHERE f = 3
    UNION ALL SELECT project, 'e' || k || '/values.yaml', 'image', unnest([s || '/web' || n, 'postgres']), false, 'e' || k || '/values.yaml' FROM c WHERE f = 4
    UNION ALL SELECT project, 'f' || k || '/config.yaml', 'bucket', 'logs-' || n, true, 'f' || k || '/config.yaml' FROM c WHERE f = 5 AND k % 4 = 1
    UNION ALL SELECT project, 'f' || k || '/config.yaml', 'host', 'i' || k, true, 'f' || k || '/config.yaml' FROM c WHERE f = 5 AND k % 4 = 1"""
)
def built_names(s, d):
    """Every other circuit file lies beside infrastructure code, which alone makes it one."""
    k = F.col("c_custkey")
    filled = lambda text: F.format_string(_java(text), k.cast("string"), (k % 7).cast("string"), F.lower("c_mktsegment"))
    form = lambda texts: F.coalesce(*(F.when(k % len(FILES) == i, filled(text)) for i, text in enumerate(texts)))
    customer = catalog.spread(catalog.table(s, d, "customer"))
    files = customer.select(F.col("c_nationkey").alias("project"), form([p for p, _ in FILES]).alias("path"), form([t for _, t in FILES]).alias("text"))
    beside = customer.filter("c_custkey % 4 = 1").select(F.col("c_nationkey").alias("project"), filled("f{k}/net.hcl").alias("path"), F.lit("x = 1").alias("text"))
    return builds.build_names(catalog.spread(stage(files.union(beside), "build-files")))  # each reader has its own files dealt


def _java(text: str) -> str:
    return text.replace("%", "%%").format(k="%1$s", n="%2$s", s="%3$s")
