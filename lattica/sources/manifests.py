"""Names that package manifests provide and take, cut from their texts by column expressions.

Readers give arrays of raw names; ``manifest_names`` spells them and makes rows. Formats with
nested tables (TOML) are read by line: a section heading, then ``key =`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name

#: Files by their last path part (fixed values) and the kind of name they hold.
KINDS = {
    "requirements.txt": "pypi", "pyproject.toml": "pypi", "setup.cfg": "pypi", "package.json": "npm", "composer.json": "composer", "vcpkg.json": "vcpkg", "go.mod": "go",
    "Cargo.toml": "cargo", "CMakeLists.txt": "cmake", "hosts": "host", "hosts.ini": "host", "inventory": "host", "inventory.ini": "host",
}
SPEC, INVENTORIES = ".spec", ("hosts", "hosts.ini", "inventory", "inventory.ini")
#: Steps of a host range at most.
MAX_RANGE = 256
CARGO_TAKES = ("dependencies", "dev-dependencies", "build-dependencies", "workspace.dependencies")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _section(text: Column, name: str) -> Column:
    """The lines of a TOML section, without its heading."""
    return F.regexp_extract(text, rf"(?ms)^\[{name.replace('.', '[.]')}\][ \t]*$(.*?)(?=^\[|\z)", 1)


def _one(*names: Column) -> Column:
    """The first of some names that is there, as an array."""
    return F.slice(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")), 1, 1)


def _quoted_name(text: Column, section: str) -> Column:
    return F.get(_all(_section(text, section), r'(?m)^name[ \t]*=[ \t]*"([^"]+)"'), 0)


def _keys(section: Column) -> Column:
    """Keys of a table's lines; one whose value names a package stands for it."""
    lines = _all(section, r"(?m)^[ \t]*([A-Za-z0-9_.-]+[ \t]*=.*)$")
    renamed = lambda x: F.regexp_extract(x, r'[{,][ \t]*package[ \t]*=[ \t]*"([^"]+)"', 1)
    return F.transform(lines, lambda x: F.coalesce(F.nullif(renamed(x), F.lit("")), F.regexp_extract(x, "^[A-Za-z0-9_.-]+", 0)))


def _requirement(line: Column) -> Column:
    """The name at the start of a requirement."""
    return F.regexp_extract(line, r"^[A-Za-z0-9._-]+", 0)


def _provided(file: Column, text: Column) -> Column:
    main = F.get(_all(text, r"(?mi)^Name:[ \t]*(\S+)"), 0)
    parts = F.transform(_all(text, r"(?m)^%package[ \t]+(.+)$"), lambda x: F.when(x.startswith("-n"), F.trim(F.substring(x, 3, 999))).otherwise(F.concat_ws("-", main, F.trim(x))))
    return (
        F.when(file.isin("package.json", "composer.json", "vcpkg.json"), _one(F.get_json_object(text, "$.name")))
        .when(file == "go.mod", F.slice(_all(text, r"(?m)^module[ \t]+(\S+)"), 1, 1))
        .when(file == "Cargo.toml", _one(_quoted_name(text, "package")))
        .when(file == "CMakeLists.txt", _all(text, r"(?i)\bproject[ \t]*\([ \t]*(\w[\w.+-]*)"))
        .when(file == "pyproject.toml", _one(_quoted_name(text, "project"), _quoted_name(text, "tool.poetry")))
        .when(file == "setup.cfg", _one(F.trim(F.regexp_extract(_section(text, "metadata"), r"(?m)^name[ \t]*=[ \t]*(.*)$", 1))))
        .when(file.endswith(SPEC), F.concat(_one(main), parts))
    )


def _spec_requires(text: Column) -> Column:
    """Names of Requires lines; what follows an operator is a version."""
    words = lambda line: F.filter(F.split(F.replace(line, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    operators = ("<", "<=", "=", ">=", ">")
    own = lambda ws: F.filter(ws, lambda w, i: ~w.isin(*operators) & ~F.coalesce(F.get(ws, i - 1).isin(*operators), F.lit(False)) & ~w.startswith("/") & ~F.contains(w, F.lit("(")))
    return F.flatten(F.transform(_all(text, r"(?mi)^Requires(?:\([^)]*\))?:[ \t]*(.*)$"), lambda line: own(words(line))))


def expanded_hosts(hosts: Column) -> Column:
    """Hosts with two ranges at most, [01:20] or [a:f], written out."""
    def one(host: Column) -> Column:
        a, b = (F.regexp_extract(host, r"\[([0-9]+|[a-z]):([0-9]+|[a-z])\]", i) for i in (1, 2))
        head, tail = F.split_part(host, F.lit("["), F.lit(1)), F.regexp_replace(host, r"^[^\[]*\[[^\]]*\]", "")
        digits = a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
        low = F.when(digits, F.try_to_number(a, F.lit("999999999"))).otherwise(F.ascii(a)).cast("int")
        high = F.when(digits, F.try_to_number(b, F.lit("999999999"))).otherwise(F.ascii(b)).cast("int")
        steps = F.slice(F.sequence(low, F.greatest(low, high)), 1, MAX_RANGE)
        width = F.when(a.startswith("0"), F.length(a)).otherwise(1)
        shown = lambda n: F.when(digits, F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))).otherwise(F.char(n))
        return F.when(a == "", F.array(host)).otherwise(F.transform(steps, lambda n: F.concat(head, shown(n), tail)))

    return F.flatten(F.transform(F.flatten(F.transform(hosts, one)), one))


def _inventory(text: Column) -> Column:
    """Hosts of an inventory's groups; sections of variables and children list none."""
    listed = F.regexp_replace(text, r"(?ms)^\[[^\]]*:(?:vars|children)\].*?(?=^\[|\z)", "")
    words = F.transform(F.split(listed, r"\r?\n"), lambda x: F.regexp_extract(F.trim(F.split_part(x, F.lit("#"), F.lit(1))), r"^\S+", 0))
    return expanded_hosts(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^[;\[]") & ~F.contains(w, F.lit("="))))


def _taken(file: Column, text: Column) -> Column:
    listed = F.from_json(F.get_json_object(text, "$.dependencies"), "array<string>")
    entries = F.transform(listed, lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.split_part(x, F.lit("#"), F.lit(1))))
    lines = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("-")) & ~F.contains(x, F.lit("://")))
    crates = F.concat(*(_keys(_section(text, s)) for s in CARGO_TAKES), _all(text, r"(?m)^\[(?:workspace[.])?(?:dev-|build-)?dependencies[.]([A-Za-z0-9_-]+)\]"))
    wanted = F.regexp_extract(_section(text, "project"), r"(?ms)^dependencies[ \t]*=[ \t]*\[(.*?)^?\][ \t]*$", 1)
    poetry = F.filter(_keys(_section(text, "tool.poetry.dependencies")), lambda x: x != "python")
    python = F.concat(_all(wanted, '"([^"]+)"'), _all(_section(text, "project.optional-dependencies"), '"([^"]+)"'), poetry)
    options = F.split(F.regexp_extract(_section(text, "options"), r"(?ms)^install_requires[ \t]*=(.*?)(?=^\S|\z)", 1), r"\r?\n")
    return (
        F.when(file == "requirements.txt", F.transform(lines, _requirement))
        .when(file == "vcpkg.json", entries)
        .when(file == "go.mod", _all(F.regexp_replace(text, r"(?m)^.*// indirect.*$", ""), r"(?m)^[ \t]*(?:require[ \t]+)?([\w.-]+\.[\w.-]+/\S+)[ \t]+v\d"))
        .when(file == "Cargo.toml", crates)
        .when(file == "CMakeLists.txt", _all(text, r"(?i)\bfind_package[ \t]*\([ \t]*(\w[\w.+-]*)"))
        .when(file == "pyproject.toml", F.transform(python, _requirement))
        .when(file == "setup.cfg", F.transform(options, lambda x: _requirement(F.trim(x))))
        .when(file.endswith(SPEC), _spec_requires(text))
        .when(file.isin(*INVENTORIES), _inventory(text))
    )


def manifest_names(files: DataFrame) -> DataFrame:
    """(project, path, kind, name, provided) of ``files`` (project, path, text); one row a name, empty ones gone.

    Files of other names, null texts and texts that do not parse give no rows.
    """
    file = F.substring_index("path", "/", -1)
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    rows = files.withColumns({"file": file, "kind": F.coalesce(F.try_element_at(kinds, file), F.when(file.endswith(SPEC), "package"))}).filter("kind is not null and text is not null")
    both = F.concat(
        F.transform(F.coalesce(_provided(F.col("file"), F.col("text")), F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), F.lit(True).alias("provided"))),
        F.transform(F.coalesce(_taken(F.col("file"), F.col("text")), F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), F.lit(False).alias("provided"))),
    )
    rows = rows.select("project", "path", "kind", F.inline(both))
    rows = rows.select("project", "path", "kind", normalize_name(F.col("kind"), F.col("raw")).alias("name"), "provided")
    return rows.filter("name != ''").distinct()


def shallowest(names: DataFrame) -> DataFrame:
    """(project, kind, name, path) of provided names; the file nearest to the top has a name that several give."""
    depth = F.size(F.split("path", "/"))
    best = names.filter("provided").groupBy("project", "kind", "name").agg(F.min(F.struct(depth, F.col("path"))).alias("best"))
    return best.select("project", "kind", "name", "best.path")
