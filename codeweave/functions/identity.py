"""Element identity: anchors, signature hashes, and the text forms they are built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anchor_key(kind: str | Column, file: Column, name: Column, class_name: Column | None = None) -> Column:
    """``kind:file:name``; methods ``method:file:class.name``. No line, so not unique."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    own = name if class_name is None else F.concat(F.coalesce(class_name, F.lit("")), F.lit("."), name)
    return F.concat(kind, F.lit(":"), file, F.lit(":"), own)


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("True")).otherwise(F.lit("False"))


def _hash(basis: Column) -> Column:
    return F.concat(F.lit("sig1:"), F.left(F.sha1(basis.cast("binary")), F.lit(16)))


def function_signature(name: Column, params: Column, return_type: Column, is_async: Column, is_exported: Column) -> Column:
    return _hash(F.concat(F.lit("function|"), _said(name), F.lit("|p="), _said(params), F.lit("|rt="), _said(return_type), F.lit("|async="), _flag(is_async), F.lit("|exp="), _flag(is_exported)))


def method_signature(class_name: Column, name: Column, params: Column, return_type: Column, is_async: Column) -> Column:
    return _hash(F.concat(F.lit("method|"), _said(class_name), F.lit("."), _said(name), F.lit("|p="), _said(params), F.lit("|rt="), _said(return_type), F.lit("|async="), _flag(is_async)))


def class_signature(name: Column, parents: Column, implements: Column) -> Column:
    """``parents``: names as resolved (unresolved ones as written); both lists in order of their text."""
    listed = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return _hash(F.concat(F.lit("class|"), _said(name), F.lit("|ext="), listed(F.filter(parents, lambda x: x.isNotNull() & (x != ""))), F.lit("|impl="), listed(implements)))


def plain_signature(kind: str, name: Column) -> Column:
    return _hash(F.concat(F.lit(kind + "|"), _said(name)))


def anchor_part(anchor: Column, part: str) -> Column:
    """``kind``, ``file`` or ``name`` of an anchor: split at the first and the last colon."""
    return F.regexp_extract(anchor, r"(?s)^([^:]*):(.*):([^:]*)$", {"kind": 1, "file": 2, "name": 3}[part])


def params_text(p: Column) -> Column:
    return F.nullif(F.left(F.trim(F.regexp_replace(p, r"\s+", " ")), F.lit(300)), F.lit(""))


def return_text(r: Column) -> Column:
    return F.regexp_replace(r, r"^[:\-> ]+", "")


def without_generics(t: Column) -> Column:
    return F.substring_index(t, "<", 1)


def without_pointer(t: Column) -> Column:
    return F.regexp_replace(t, r"^\*+", "")
