"""Predicates and spellings of paths, ids and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and file names that mark tests, examples and other people's code.
VENDOR_DIRS = ("node_modules", "vendor", "3rdparty", "third_party", "site-packages", ".venv")
FIXTURE_DIRS = (
    "test", "tests", "testdata", "test-data", "test_data", "testing", "fixtures", "__fixtures__", "__tests__", "__mocks__", "mocks", "spec", "specs", "e2e",
    "examples", "example", "samples", "corpus",
)
TEST_FILE = r"^test_|_test\.|\.(test|spec)\.[A-Za-z0-9]+$|^tests?\.rs$"
TEST_PATH = r"(?i)(^|/)(tests?|spec|specs)/|(^|/)test_[^/]*$|[._-](test|spec)\.[^/]+$|_test\.[^/]+$|(^|/)tests?\.rs$"
FQDN = r"(?i)^([a-z0-9_]([a-z0-9_-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]$"


def is_test_file(path: Column) -> Column:
    """A test by its folder or by the name of its file."""
    segments = F.split(path, "/")
    folders = F.slice(segments, 1, F.size(segments) - 1)
    return F.exists(folders, lambda s: s.isin("test", "tests")) | F.element_at(segments, -1).rlike(TEST_FILE)


def is_test_path(path: Column, marked: Column | None = None) -> Column:
    """A test by the wider pattern, or as its extractor marked it; null paths are none."""
    found = F.coalesce(path.rlike(TEST_PATH), F.lit(False))
    return found if marked is None else found | F.coalesce(marked, F.lit(False))


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS)))


def is_fixture(path: Column) -> Column:
    """Whether a folder of the path, not its file, is one of tests or examples."""
    segments = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(segments, 1, F.size(segments) - 1), F.array(*map(F.lit, FIXTURE_DIRS)))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def is_fqdn(name: Column) -> Column:
    """A full host name, not an address."""
    plain = F.regexp_replace(name, r"\.+$", "")
    return F.length(plain).between(4, 253) & plain.rlike(FQDN)


def entity_id(path: Column, name: Column, most: int = 512) -> Column:
    return F.substring(F.concat(path, F.lit("::"), name), 1, most)


def owner_path(id_: Column) -> Column:
    """The file of an entity's id."""
    return F.split_part(id_, F.lit("::"), F.lit(1))


def entity_name(id_: Column) -> Column:
    """The entity of an id; null for a file's."""
    return F.when(F.contains(id_, F.lit("::")), F.regexp_replace(id_, "^.*?::", ""))


def project_name(given: Column, root: Column, most: int = 64) -> Column:
    """A project's name from what was given or its root's last segment; null where it is reserved (a leading _) or nothing is left."""
    wanted = F.when(F.trim(given) != "", F.trim(given)).otherwise(F.substring_index(F.regexp_replace(root, "/+$", ""), "/", -1))
    clean = F.regexp_replace(F.regexp_replace(F.lower(wanted), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(~wanted.startswith("_") & ~clean.isin("", ".", ".."), F.substring(clean, 1, most))


def snake_file(constant: Column) -> Column:
    """The file that a constant's name stands for: HTTPServer::FooBar -> http_server/foo_bar."""
    apart = F.regexp_replace(F.regexp_replace(constant, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.replace(F.lower(apart), F.lit("::"), F.lit("/"))


def asset_path(link: Column) -> Column:
    """A link in a page as a path: no query, no fragment, no leading slashes."""
    return F.regexp_replace(F.regexp_replace(link, "[?#].*$", ""), "^/+", "")


def shared_folders(a: Column, b: Column) -> Column:
    """How many leading folders two paths share; their files do not count, nor do empty segments."""
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    same = F.zip_with(folders(a), folders(b), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def suffixes(path: Column) -> Column:
    """All ends of a path that begin at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


# Characters before the letters, in the order of their weight (fixed values), then digits and letters.
PUNCTUATION = "\t\n\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
ALPHABET = PUNCTUATION + "0123456789abcdefghijklmnopqrstuvwxyz"


def collation_key(text: Column) -> Column:
    """A struct whose order is that of ``ALPHABET`` without regard to capitals, which decide between equals; characters outside it follow by code point."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    weight = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.lower(c)), F.lit(0)), 1000 + F.ascii(c))
    return F.struct(F.transform(letters, weight).alias("weights"), F.transform(letters, lambda c: c != F.lower(c)).alias("capitals"))
