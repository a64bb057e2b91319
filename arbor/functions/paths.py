"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path) -> Column:
    """The order of a walk: a directory before its children, names by bytes."""
    return F.split(path, "/")


def depth(path) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def below(path, top: str) -> Column:
    """path is top or lies below it."""
    return F.lit(True) if top == "/" else (path == top) | path.startswith(top + "/")


def parents(path) -> Column:
    """The directories above a path, root first."""
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 2, F.lit(0)))
    named = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("/")), named))


def valid_name(name) -> Column:
    """A file's name: 1 to 255 bytes without NUL, slash or backslash, not . or .."""
    return (F.octet_length(name).between(1, 255)) & ~name.rlike(r"[\x00/\\]") & ~name.isin(".", "..")


def valid_history_name(name) -> Column:
    """A branch's or project's name."""
    return (F.length(name) <= 63) & name.rlike(r"^[a-z0-9]([a-z0-9._-]*[a-z0-9])?\z")


def valid_mode(kind, mode) -> Column:
    """Files to 0777, directories to 01777, links 0777 alone."""
    return F.when(kind == 2, mode.between(0, 0o1777)).when(kind == 3, mode == 0o777).otherwise(mode.between(0, 0o777))
