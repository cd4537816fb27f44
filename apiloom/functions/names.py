"""Names, paths and their predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of schema names, names that tell authentication, and public endpoints.
SCHEMA_SUFFIXES = ("Create", "Update", "Patch", "Public", "Private", "Read", "Out", "In", "InDB", "DB", "Base", "Response", "Request", "Schema", "Detail", "Summary", "List", "Item")
AUTH_NAMES = "auth|current_user|current_active|token|jwt|oauth|admin|permission|scope|api_?key|bearer|credential|login|verify|require_|security|principal|access_code|signature"
AUTH_HEADERS = "authorization|api_?key|token|signature|secret"
PUBLIC_NAMES = "auth|login|logout|register|signup|sign_up|subscribe|webhook|callback|token|health|password_reset|forgot|verify"
WRITE_METHODS = ("POST", "PUT", "PATCH", "DELETE")


def short_name(name: Column) -> Column:
    """Last dotted segment."""
    return F.regexp_extract(name, r"([^.]*)$", 1)


def join_path(*parts: Column) -> Column:
    """Parts joined by single slashes, with a leading one; a slash at the end stays if the last part ends with one."""
    inner = F.array_join(F.filter(F.array(*[F.regexp_replace(p, r"^/+|/+$", "") for p in parts]), lambda p: p != ""), "/")
    return F.concat(F.lit("/"), inner, F.when(parts[-1].endswith("/") & (inner != ""), F.lit("/")).otherwise(F.lit("")))


def schema_stem(name: Column) -> Column:
    """A schema's name without its suffixes, as many as there are, never emptied."""
    return F.regexp_extract(name, f"^(InDB|.+?)(?:{'|'.join(SCHEMA_SUFFIXES)})*$", 1)


def module_name(path: Column, root: Column | None = None) -> Column:
    """Dotted name of a file's module; a package's ``__init__`` is the package, at the root it is ``root``."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    return F.when(dotted == "", root).otherwise(dotted) if root is not None else dotted


def is_test_file(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)(test_[^/]*|conftest\.py)$"), F.lit(False))


def is_auth_name(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """The last segment tells of authentication, or is one of ``extra``."""
    short = short_name(name)
    return reduce(Column.__or__, [short == x for x in extra], short.rlike(f"(?i){AUTH_NAMES}"))


def is_auth_header(name: Column) -> Column:
    return name.rlike(f"(?i){AUTH_HEADERS}")


def is_likely_public(name: Column) -> Column:
    return name.rlike(f"(?i){PUBLIC_NAMES}")


def parent_id(module: Column, qualname: Column) -> Column:
    """Node that defines a symbol: its class, or its module."""
    return F.when(qualname.contains("."), F.concat(module, F.lit(":"), F.regexp_replace(qualname, r"\.[^.]*$", ""))).otherwise(F.concat(F.lit("module:"), module))


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def confidence(shared: Column, total: Column) -> Column:
    """Shared part of the whole, rounded half-even to two places."""
    return F.bround(shared.cast("double") / total, 2)


def split_route_query(query: Column) -> tuple[Column, Column]:
    """(method, path) of ``METHOD /path`` or ``/path``; a method only where the first word is in upper case."""
    method = F.regexp_extract(query, r"^([A-Z]+) ", 1)
    return method, F.when(method != "", F.regexp_replace(query, r"^[A-Z]+ ", "")).otherwise(query)


def html_safe(text: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(text, F.lit("</"), F.lit("<\\/"))
