"""Column expressions on ``/``-separated paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweave.functions import registry


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it (lambdas do not share subexpressions)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column, up: int | Column = 1) -> Column:
    """The path without its last ``up`` segments; empty when none are left."""
    parts = F.split(p, "/")
    keep = F.greatest(F.size(parts) - up, F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), keep), "/")


def extension(p: Column) -> Column:
    """The last suffix of the name, dot included; leading dots of a name are not the start of one."""
    return F.regexp_extract(basename(p), r"^\.*[^.].*?(\.[^.]*)$", 1)


def ancestors(p: Column) -> Column:
    """All folders above a file, nearest to the root first; empty segments are left out."""
    folders = F.filter(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), lambda x: x != "")
    none = F.array().cast("array<string>")
    return let(folders, lambda d: F.when(F.size(d) == 0, none).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1))), lambda i: F.array_join(F.slice(d, F.lit(1), i), "/"))))


def suffixes(p: Column) -> Column:
    """All suffixes of whole segments, the longest first."""
    return let(F.split(p, "/"), lambda d: F.transform(F.sequence(F.lit(1), F.size(d)), lambda i: F.array_join(F.slice(d, i, F.size(d)), "/")))


def domain(p: Column) -> Column:
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("root"))


def depth(p: Column) -> Column:
    return F.size(F.split(p, "/")).cast("int")


def normalised(p: Column) -> Column:
    """POSIX normalisation of a relative or absolute path: ``.`` and inner ``..`` vanish; nothing left is ``.``."""
    rooted = F.startswith(p, F.lit("/"))
    start = F.array().cast("array<string>")
    fold = F.aggregate(
        F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), start,
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & rooted, acc).otherwise(F.concat(acc, F.array(x))))
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(fold, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def joined(folder: Column, rest: Column) -> Column:
    return F.when(F.startswith(rest, F.lit("/")) | (folder == ""), rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language(p: Column) -> Column:
    """Language by exact file name, else by lower-case extension; null if neither is known."""
    return F.coalesce(F.try_element_at(_map(registry.FILENAME_LANGUAGES), basename(p)), F.try_element_at(_map(registry.EXTENSION_LANGUAGES), F.lower(extension(p))))


def glob(c: Column, pattern: str) -> Column:
    """Shell pattern on the whole string; ``*`` crosses ``/``."""
    body = re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern))
    return c.rlike(f"^{body}$")


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def blocked_folder(p: Column) -> Column:
    """A folder on the way is listed or begins with a dot."""
    folders = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    return F.exists(folders, lambda d: d.isin(sorted(registry.BLOCKED_FOLDERS)) | F.startswith(d, F.lit(".")))


def lock_file(p: Column) -> Column:
    return basename(p).isin(registry.LOCK_FILES)


def generated_file(p: Column) -> Column:
    return any_of(*(glob(F.lower(basename(p)), g.lower()) for g in registry.GENERATED))


def hidden_file(p: Column) -> Column:
    return F.startswith(basename(p), F.lit(".")) & ~basename(p).isin(registry.ALLOWED_HIDDEN)


def blocked_extension(p: Column) -> Column:
    return F.lower(extension(p)).isin(sorted(registry.BLOCKED_EXTENSIONS))


def database_name(name: Column) -> Column:
    safe = F.left(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_"), F.lit(64))
    return F.when(safe == "", F.lit("default")).otherwise(safe)


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)
