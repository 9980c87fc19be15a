"""Stable keys and the names that the code graph is joined on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122, and the version of point keys.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
KEY_VERSION = 2


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace, as its canonical string."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(slug: str, tier: Column, path: Column, kind: Column, identity: Column, sub: Column) -> Column:
    """The key of a chunk: a change of any component gives another."""
    return uuid5(F.concat_ws(":", F.lit(slug), tier, path, kind, identity, sub.cast("string"), F.lit(str(KEY_VERSION))))


def refs_stamp(refs: Column) -> Column:
    """key@version of each reference, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.transform(refs, lambda r: F.concat(r["chunk_key"], F.lit("@"), r["key_version"].cast("string")))), ",")


def parsed_stamp(stamp: Column) -> Column:
    """The references of a stamp; the version is what follows the last @."""
    parts = F.filter(F.split(stamp, ","), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.regexp_replace(s, "@[^@]*$", "").alias("chunk_key"), F.regexp_extract(s, "@([^@]*)$", 1).cast("int").alias("key_version")))


def memory_id(text: Column, stamp: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("memory"), text, stamp))


def bare(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def dotted_prefixes(name: Column) -> Column:
    """a, a.b, a.b.c of a.b.c."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def module_of(path: Column) -> Column:
    """The dotted name of a Python file; a package's __init__ is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def is_test_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.array_contains(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), "tests") | name.rlike(r"^test_.*\.py$|_test\.py$")


def is_dunder(name: Column) -> Column:
    return bare(name).rlike("^__.*__$")


def is_entry_module(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin("__main__.py", "__init__.py")


def common_tail(a: Column, b: Column) -> Column:
    """Whether the shorter of two dotted paths is the end of the longer."""
    x, y = F.split(a, "[.]"), F.split(b, "[.]")
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, -n, n) == F.slice(y, -n, n)
