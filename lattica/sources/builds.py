"""Names in files that build and deploy: images of make and shell files, machines and records of
infrastructure code, inventories, compose documents inside data files, circuit files.

Each reader is a column expression over one text: variables are written out level by level,
blocks and indents are followed by machines that read line after line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import bound, outline, walked
from ..functions.paths import is_fqdn
from ..functions.text import directory, normalize_name
from ..operators.imports import folder, normal
from ..session import stage
from .manifests import expanded_hosts

# Fixed values.
UNKNOWN = "\0"
LEVELS = 5
MAKE_FILES, MAKE_ENDING, SHELL_ENDINGS, CODE_ENDING = ("makefile", "gnumakefile"), ".mk", (".sh", ".bash"), ".tf"
SEPARATORS = ("&&", "||", ";", "|")
VALUE_OPTIONS = (
    "-t", "--tag", "-f", "--file", "--build-arg", "--target", "--platform", "--label", "--secret", "--ssh", "--cache-from", "--cache-to", "--network", "--progress", "-o",
    "--output", "--iidfile", "--build-context", "--add-host", "--allow", "--annotation", "--attest", "--builder", "--call", "--cgroup-parent", "--cpu-period", "--cpu-quota",
    "--cpu-shares", "-c", "--cpuset-cpus", "--cpuset-mems", "--isolation", "--memory", "-m", "--memory-swap", "--metadata-file", "--no-cache-filter", "--security-opt",
    "--shm-size", "--ulimit",
)
MACHINES = (
    "aws_instance", "azurerm_linux_virtual_machine", "azurerm_virtual_machine", "azurerm_windows_virtual_machine", "digitalocean_droplet", "exoscale_compute_instance",
    "google_compute_instance", "hcloud_server", "libvirt_domain", "linode_instance", "openstack_compute_instance_v2", "ovirt_vm", "proxmox_virtual_environment_vm",
    "proxmox_vm_qemu", "scaleway_instance_server", "vsphere_virtual_machine", "vultr_instance", "yandex_compute_instance",
)
MACHINE_NAMES = ("name", "hostname", "computer_name")
RECORDS = (
    "aws_route53_record", "cloudflare_dns_record", "cloudflare_record", "digitalocean_record", "dns_cname_record", "dnsimple_zone_record", "google_dns_record_set",
    "hetznerdns_record", "ovh_domain_zone_record", "powerdns_record",
)
RECORD_NAMES = ("name", "records", "record", "value", "content", "rrdatas", "cname")
DATA_INVENTORIES = ("hosts.yml", "hosts.yaml", "inventory.yml", "inventory.yaml")
CIRCUITS, CIRCUIT_KINDS = ("config.yaml", "config.yml"), {"instances": "host", "buckets": "bucket"}

#: A value longer than this is not a name and counts as not known.
LONGEST = 4096
TOOL = r"\b(?:docker|podman)[ \t]+"
STRING = r'"((?:[^"\\]|\\.)*+)"'
MAKE = {
    "set": r"(?m)^[ \t]*(?:(?:export|override)[ \t]+)?([A-Za-z_][\w.]*)[ \t]*(?:::|[:?+])?=[ \t]*(.*?)[ \t]*$",
    "use": r"\$\([^()]*\)|\$\{[^{}]*\}",
    "name": r"^\$[({][ \t]*([^(){}]*?)[ \t]*[)}]$",
    "default": None,
    "tool": ("\\$(?:\\(", "\\)|\\{", "\\})"),
}
SHELL = {
    "set": r"""(?m)^[ \t]*(?:(?:export|local|readonly|declare(?:[ \t]+-\w+)*)[ \t]+)?([A-Za-z_]\w*)=("[^"\n]*"|'[^'\n]*'|[^\s;&|]*)""",
    "use": r"""\$\{[A-Za-z_]\w*(?::?[-=][^}]*)?\}|\$[A-Za-z_]\w*|\$\([^)]*\)|`[^`]*`""",
    "name": r"^\$\{?([A-Za-z_]\w*)",
    "default": r"^\$\{[A-Za-z_]\w*:?[-=]([^}]*)\}$",
    "tool": ("\\$(?:", "\\b|\\{", "\\})"),
}
LEFT_OVER = r"""\$[(`{]?[^/:@\s'"]*|`[^`]*`"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unquoted(word: Column) -> Column:
    return F.regexp_replace(word, "^[\"']+|[\"']+$", "")


def expanded(value: Column, names: Column, values: Column, rules: dict) -> Column:
    """A value with its references written out, ``LEVELS`` of them; what is not known, or deeper, becomes ``UNKNOWN``.

    The last of several values of a name counts.
    """
    names, values = F.reverse(names), F.reverse(values)

    def meaning(use: Column) -> Column:
        place = F.array_position(names, F.regexp_extract(use, rules["name"], 1))
        known = F.get(values, (place - 1).cast("int"))
        if rules["default"]:
            known = F.coalesce(known, F.when(use.rlike(rules["default"]), F.regexp_extract(use, rules["default"], 1)))
        return F.when(F.length(known) <= LONGEST, known)

    def level(done: Column, i: Column) -> Column:
        uses = F.transform(_all(done, rules["use"], 0), lambda u: F.coalesce(F.when(i <= LEVELS, meaning(u)), F.lit(UNKNOWN)))
        pairs = F.zip_with(F.split(done, rules["use"]), uses, lambda text, use: F.concat(text, F.coalesce(use, F.lit(""))))
        return F.when(F.length(done) > LONGEST, UNKNOWN).when(~done.rlike(rules["use"]), done).otherwise(F.array_join(pairs, ""))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS + 1)), value, level)
    return F.regexp_replace(out, LEFT_OVER, UNKNOWN) if rules["default"] else out


def build_context(line: Column) -> Column:
    """The first argument of a build command that is neither an option nor an option's value; null without one."""
    tokens = F.split(F.trim(line), r"\s+")
    at = F.array_position(tokens, "build").cast("int")
    rest = F.slice(tokens, at + 1, F.size(tokens))
    none = F.lit(None).cast("string")
    state = lambda skip, found: F.struct(skip.alias("skip"), found.alias("found"))

    def step(s: Column, token: Column) -> Column:
        passed = token.startswith("-") | token.isin("&&", ";", "|")
        return F.when(s["found"].isNotNull(), s).when(s["skip"], state(F.lit(False), none)).when(token.isin(*VALUE_OPTIONS), state(F.lit(True), none)).when(passed, state(F.lit(False), none)).otherwise(state(F.lit(False), token))

    return F.when(at > 0, F.aggregate(rest, state(F.lit(False), none), step, lambda s: s["found"]))


def positionals(line: Column, verb: str) -> Column:
    """Arguments behind a verb up to the end of the command, without options."""
    tokens = F.split(F.trim(line), r"\s+")
    rest = F.slice(tokens, F.array_position(tokens, verb).cast("int") + 1, F.size(tokens))
    ends = F.array_position(F.transform(rest, lambda x: x.isin(*SEPARATORS)), F.lit(True)).cast("int")
    rest = F.when(ends > 0, F.slice(rest, F.lit(1), ends - 1)).otherwise(rest)
    found = F.transform(F.filter(rest, lambda x: ~x.startswith("-")), _unquoted)
    return F.when(F.array_contains(tokens, verb), found).otherwise(F.array().cast("array<string>"))


def _images(files: DataFrame, rules: dict) -> DataFrame:
    """``files`` with ``found``: images that a script builds, tags anew or pushes, each with the folder it is built from."""
    rows = files.withColumn("joined", F.replace("text", F.lit("\\\n"), F.lit(" ")))
    rows = rows.withColumns({"names": _all(F.col("joined"), rules["set"]), "raws": _all(F.col("joined"), rules["set"], 2)})
    unquoted = lambda x: F.regexp_replace(x, """^(["'])(.*)\\1$""", "$2")
    rows = rows.withColumn("values", F.transform("raws", unquoted) if rules["default"] else F.col("raws"))
    tools = F.filter(F.zip_with("names", "values", lambda n, v: F.when(F.regexp_extract(v, """([^/"' ]*)["' ]*$""", 1).isin("docker", "podman"), n)), lambda n: n.isNotNull())
    a, b, c = rules["tool"]
    escaped = lambda n: F.replace(n, F.lit("."), F.lit("[.]"))
    named = F.aggregate(F.array_distinct(tools), F.col("joined"), lambda t, n: F.regexp_replace(t, F.concat(F.lit(a), escaped(n), F.lit(b), escaped(n), F.lit(c)), F.lit("docker")))
    rows = rows.withColumn("commands", named)
    known = lambda x: expanded(x, F.col("names"), F.col("values"), rules)
    builds = _all(F.col("commands"), TOOL + r"(?:buildx[ \t]+)?build\b[^\n]*", 0)
    rows = rows.withColumn("builds", F.transform(builds, lambda x: F.struct(x.alias("line"), known(_unquoted(build_context(x))).alias("context"))))
    rows = rows.withColumn("builds", F.transform("builds", lambda x: F.struct(x["line"].alias("line"), x["context"].alias("context"), _joined(F.col("path"), x["context"]).alias("folder"))))
    holder = lambda x: F.when(x["context"].isNull() | F.contains(x["context"], F.lit(UNKNOWN)) | F.contains(x["context"], F.lit("$")) | x["folder"].startswith(".."), directory(F.col("path"))).when(x["folder"] == "", "./").otherwise(F.concat(x["folder"], F.lit("/")))
    rows = rows.withColumn("builds", F.transform("builds", lambda x: F.struct(x["line"].alias("line"), holder(x).alias("holder"))))
    holders = F.array_distinct(F.transform("builds", lambda x: x["holder"]))
    rows = rows.withColumn("holder", F.when(F.size(holders) == 1, F.get(holders, 0)).otherwise(directory(F.col("path"))))
    rows = rows.withColumn("tagged", F.filter(F.transform(_all(F.col("commands"), TOOL + r"(?:image[ \t]+)?tag\b[^\n]*", 0), lambda x: positionals(x, "tag")), lambda x: F.size(x) > 1))
    pushed = F.flatten(F.transform(_all(F.col("commands"), TOOL + r"(?:image[ \t]+)?push\b[^\n]*", 0), lambda x: F.slice(positionals(x, "push"), 1, 1)))
    pair = lambda raw, at: F.struct(raw.alias("raw"), at.alias("holder"))
    built = F.flatten(F.transform("builds", lambda b: F.transform(_all(b["line"], r"""\s(?:-t|--tag)[\s=]+["']?([^\s'"]+)"""), lambda raw: pair(raw, b["holder"]))))
    later = F.transform(F.concat(F.transform("tagged", lambda x: x[1]), pushed), lambda raw: pair(raw, F.col("holder")))
    name = lambda raw: bound(known(raw), lambda x: normalize_name(F.lit("image"), x))
    rows = rows.withColumns({"found": F.transform(F.concat(built, later), lambda x: F.struct(name(x["raw"]).alias("name"), x["holder"].alias("holder"))), "starts": F.transform("tagged", lambda x: name(x[0])), "ends": F.transform("tagged", lambda x: name(x[1]))})
    local = F.array_except("starts", "ends")
    return rows.withColumn("found", F.filter("found", lambda x: F.contains(x["name"], F.lit("/")) & ~F.contains(x["name"], F.lit(UNKNOWN)) & ~F.array_contains(local, x["name"])))


def _joined(path: Column, context: Column) -> Column:
    return F.when(context.startswith("/"), F.concat(F.lit("/"), normal(context))).otherwise(normal(F.concat_ws("/", folder(path), context)))


def resource_hosts(text: Column) -> Column:
    """Machines that infrastructure code creates and hosts that its records name: array of (raw, provided).

    Blocks are followed by their brackets, outside strings and comments; a name is a literal of an
    attribute of the block itself, a machine's first one a attribute and its ``Name`` tags. A block
    without an end counts as far as it goes.
    """
    none = F.array().cast("array<struct<raw:string,provided:boolean>>")
    start = {"kind": F.lit(""), "depth": F.lit(0), "key": F.lit(""), "done": F.lit(False)}
    head = r'^[ \t]*resource[ \t]+"([\w-]+)"[ \t]+"[^"]*"[ \t]*\{'
    state = lambda kind, depth, key, done, said: F.struct(kind.alias("kind"), depth.alias("depth"), key.alias("key"), done.alias("done"), said.alias("said"))

    def step(s: Column, line: Column) -> Column:
        opens = (s["kind"] == "") & line.rlike(head)
        kind = F.when(opens, F.regexp_extract(line, head, 1)).otherwise(s["kind"])
        body = F.when(opens, F.regexp_replace(line, head, "")).otherwise(line)
        code = F.regexp_replace(F.regexp_replace(body, STRING, '""'), "(?:#|//).*$", "")
        count = lambda chars: F.length(F.regexp_replace(code, f"[^{chars}]", ""))
        before = F.when(opens, 1).otherwise(s["depth"])
        depth = before + count(r"\[({") - count(r"\])}")
        own = F.regexp_extract(body, r"^[ \t]*([A-Za-z_][\w-]*)[ \t]*=", 1)
        key = F.when(before == 1, own).otherwise(s["key"])
        done = (before != 1) & s["done"]
        literals = F.filter(_all(body, STRING), lambda x: ~F.contains(x, F.lit("${")))
        machine, record = kind.isin(*MACHINES), kind.isin(*RECORDS) | kind.rlike("^azurerm_dns_.*_record$")
        raws = (
            F.when(machine & key.isin(*MACHINE_NAMES), F.slice(literals, F.lit(1), F.when(done, 0).otherwise(1)))
            .when(machine & (key == "tags"), _all(body, r'\bName[ \t]*=[ \t]*"([^"$]+)"'))
            .when(record & key.isin(*RECORD_NAMES), literals)
            .otherwise(F.array().cast("array<string>"))
        )
        said = F.transform(raws, lambda x: F.struct(x.alias("raw"), machine.alias("provided")))
        inside = state(kind, depth, key, done | (F.size(literals) > 0), said)
        outside = state(start["kind"], start["depth"], start["key"], start["done"], none)
        return F.when((kind == "") | (depth <= 0), outside).otherwise(inside)

    return walked(F.split(text, "\r?\n"), start, step, "struct<raw:string,provided:boolean>")


def _keys_of(flow: Column) -> Column:
    """Keys of a mapping in braces."""
    inner = F.regexp_replace(F.regexp_extract(flow, r"^\{(.*)\}$", 1), r"\{[^{}]*\}|\[[^\[\]]*\]", "")
    return _all(inner, r"""(?:^|,)[ \t]*["']?([^,:\s"']+)""")


def inventory_hosts(keys: Column) -> Column:
    """Hosts of an outlined inventory's first document: keys below ``hosts``, not below ``vars`` or a list."""
    n = lambda x: F.size(x["keys"])
    clean = lambda ks: ~F.arrays_overlap(ks, F.array(*map(F.lit, ("hosts", "vars", "-", "|"))))
    first = F.filter(keys, lambda x: x["doc"] == 0)
    own = F.filter(first, lambda x: (n(x) > 1) & (F.get(x["keys"], n(x) - 2) == "hosts") & clean(F.slice(x["keys"], F.lit(1), F.greatest(n(x) - 2, F.lit(0)))))
    flows = F.filter(first, lambda x: (F.get(x["keys"], n(x) - 1) == "hosts") & clean(F.slice(x["keys"], F.lit(1), n(x) - 1)) & x["value"].startswith("{"))
    return expanded_hosts(F.concat(F.transform(own, lambda x: F.element_at(x["keys"], -1)), F.flatten(F.transform(flows, lambda x: _keys_of(x["value"])))))


def compose_images(keys: Column) -> Column:
    """Images of the services of compose documents that an outlined text holds as block strings."""
    at = lambda x, i: F.get(x["keys"], F.size(x["keys"]) - i)
    return F.transform(F.filter(keys, lambda x: (at(x, 1) == "image") & (at(x, 3) == "services") & (at(x, 4) == "|") & (x["value"] != "")), lambda x: x["value"])


def build_names(files: DataFrame) -> DataFrame:
    """(project, path, kind, name, provided, holder) of ``files`` (project, path, text), one row a name.

    ``holder`` is the folder an image is built from, else the file. Names are spelled as
    ``normalize_name`` says; hosts must be whole domain names. Null texts give no rows. Circuit
    files count only beside infrastructure code of the same project.
    """
    base = F.lower(F.substring_index("path", "/", -1))
    make = base.isin(*MAKE_FILES) | base.endswith(MAKE_ENDING)
    named = F.col("path").endswith(SHELL_ENDINGS[0]) | F.col("path").endswith(SHELL_ENDINGS[1])
    shell = ~make & (named | (~F.contains(base, F.lit(".")) & F.col("text").rlike(r"^#!\s*\S*?(?:/env\s+)?\b(?:ba|z|k|da)?sh\b")))
    here = files.select("project", "path", "text").filter("text is not null and path is not null")
    out = ("project", "path", "kind", "name", "provided", "holder")
    lit = lambda kind, provided: (F.lit(kind).alias("kind"), F.lit(provided).alias("provided"))

    images = _images(here.filter(make), MAKE).union(_images(here.filter(shell), SHELL))
    found = images.select("project", "path", *lit("image", True), F.inline("found")).select(*out)
    buckets = _all(F.col("text"), r"(?mi)^[ \t]*(?:export[ \t]+)?\w*BUCKET[ \t]*[?:+]?=[ \t]*(\S+)[ \t]*$")
    found = found.union(here.filter(make).select("project", "path", *lit("bucket", False), F.explode(buckets).alias("raw")).select("project", "path", "kind", normalize_name(F.col("kind"), F.col("raw")).alias("name"), "provided", F.col("path").alias("holder")))

    code = here.filter(F.col("path").endswith(CODE_ENDING))
    hosts = code.select("project", "path", F.lit("host").alias("kind"), F.inline(resource_hosts(F.col("text"))))
    data = here.filter(F.col("path").rlike("[.]ya?ml$")).select("project", "path", F.substring_index("path", "/", -1).alias("file"), outline(F.col("text")).alias("keys"))
    data = stage(data, "build-outlines")  # three readers use them
    listed = data.filter(F.col("file").isin(*DATA_INVENTORIES)).select("project", "path", F.lit("host").alias("kind"), F.explode(inventory_hosts(F.col("keys"))).alias("raw"), F.lit(False).alias("provided"))
    composed = data.select("project", "path", F.lit("image").alias("kind"), F.explode(compose_images(F.col("keys"))).alias("raw"), F.lit(False).alias("provided"))
    beside = here.filter(F.col("path").rlike("[.](tf|hcl|tfvars)$")).select("project", folder(F.col("path")).alias("at")).distinct()
    circuits = data.filter(F.col("file").isin(*CIRCUITS)).withColumn("at", folder(F.col("path"))).join(beside, ["project", "at"], "left_semi")
    created = F.filter("keys", lambda x: (x["doc"] == 0) & (F.size(x["keys"]) == 2) & F.get(x["keys"], 0).isin(*CIRCUIT_KINDS))
    kinds = F.create_map(*(F.lit(x) for pair in CIRCUIT_KINDS.items() for x in pair))
    created = circuits.select("project", "path", F.explode(created).alias("x")).select("project", "path", F.element_at(kinds, F.col("x.keys")[0]).alias("kind"), F.col("x.keys")[1].alias("raw"), F.lit(True).alias("provided"))
    rest = hosts.select("project", "path", "kind", "raw", "provided").union(listed).union(composed)
    rest = rest.withColumn("name", normalize_name(F.col("kind"), F.col("raw"))).filter((F.col("kind") != "host") | is_fqdn(F.col("name")))
    created = created.withColumn("name", normalize_name(F.col("kind"), F.col("raw")))
    rest = rest.unionByName(created).withColumn("holder", F.col("path")).select(*out)
    return found.union(rest).filter("name != ''").distinct()
