"""Changes of a tree: each takes a tree with texts and gives the next one.

A tree here is (path, kind, text, mode, serial). What is refused raises, as the
caller asked for one change; checks read one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.functions import paths


class Refused(ValueError):
    """A change that can't be made; its code is the first argument."""


def _at(tree: DataFrame, path: str):
    return tree.where(F.col("path") == path).select("kind", "mode", "serial").first()


def _parent(path: str) -> str:
    return path.rpartition("/")[0] or "/"


def _need_parent(tree: DataFrame, path: str) -> None:
    up = _at(tree, _parent(path))
    if up is None:
        raise Refused("NotFound", _parent(path))
    if up["kind"] != 2:
        raise Refused("NotDirectory", _parent(path))


def _next_serial(tree: DataFrame) -> int:
    return (tree.agg(F.max("serial")).first()[0] or 0) + 1


def write(tree: DataFrame, path: str, text: str, mode: int | None = None) -> DataFrame:
    """Write a file: an existing one keeps its serial and, if none is given, its mode."""
    _need_parent(tree, path)
    was = _at(tree, path)
    if was is not None and was["kind"] != 1:
        raise Refused("IsDirectory" if was["kind"] == 2 else "NotFile", path)
    if was is None:
        row = tree.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(1).alias("kind"), F.lit(text).alias("text"), F.lit(mode or 0o644).alias("mode"), F.lit(_next_serial(tree)).cast("long").alias("serial"))
        return tree.select("path", "kind", "text", "mode", "serial").unionAll(row)
    here = F.col("path") == path
    return tree.withColumn("text", F.when(here, F.lit(text)).otherwise(F.col("text"))).withColumn("mode", F.when(here, F.lit(mode if mode is not None else was["mode"])).otherwise(F.col("mode")))


def occurrences(text, old: str):
    """How often a literal stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")


def edit(tree: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """Replace the one occurrence of old in a file."""
    found = tree.where((F.col("path") == path) & (F.col("kind") == 1)).select(occurrences(F.col("text"), old).alias("n")).first()
    if found is None:
        raise Refused("NotFound", path)
    if found["n"] != 1:
        raise Refused("NoMatch" if found["n"] == 0 else "AmbiguousMatch", path)
    return tree.withColumn("text", F.when(F.col("path") == path, F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")))


def mkdir(tree: DataFrame, path: str, mode: int = 0o755) -> DataFrame:
    """A directory and those above it that are missing; existing ones stay."""
    parts = path.strip("/").split("/")
    wanted = ["/" + "/".join(parts[: i + 1]) for i in range(len(parts))]
    found = {r["path"]: r["kind"] for r in tree.where(F.col("path").isin(wanted)).select("path", "kind").collect()}  # a path's components
    if any(k != 2 for k in found.values()):
        raise Refused("NotDirectory", path)
    new = [p for p in wanted if p not in found]
    if not new:
        return tree
    first = _next_serial(tree)
    rows = tree.sparkSession.createDataFrame([(p, 2, None, mode, first + i) for i, p in enumerate(new)], "path string, kind int, text string, mode int, serial long")
    return tree.select("path", "kind", "text", "mode", "serial").unionAll(rows)


def remove(tree: DataFrame, path: str) -> DataFrame:
    """An entry and all below it."""
    if path == "/" or _at(tree, path) is None:
        raise Refused("NotFound" if path != "/" else "InvalidInput", path)
    return tree.where(~paths.below(F.col("path"), path))


def _moved(path: str, to: str):
    return F.concat(F.lit(to), F.substring("path", len(path) + 1, 4096))


def _need_apart(tree: DataFrame, path: str, to: str) -> None:
    if to == path or to.startswith(path + "/") or path.startswith(to + "/"):
        raise Refused("InvalidInput", to)
    if _at(tree, path) is None:
        raise Refused("NotFound", path)
    if _at(tree, to) is not None:
        raise Refused("AlreadyExists", to)
    _need_parent(tree, to)


def move(tree: DataFrame, path: str, to: str) -> DataFrame:
    """An entry and all below it under another path; serials stay."""
    _need_apart(tree, path, to)
    return tree.withColumn("path", F.when(paths.below(F.col("path"), path), _moved(path, to)).otherwise(F.col("path")))


def copy(tree: DataFrame, path: str, to: str) -> DataFrame:
    """An entry and all below it once more, with serials of their own; what was
    one inode in the original is one in the copy."""
    _need_apart(tree, path, to)
    part = tree.where(paths.below(F.col("path"), path))
    first = _next_serial(tree)
    # offsets keep order and distinctness of the serials, without a global sort
    low = part.agg(F.min("serial")).first()[0]
    return tree.unionByName(part.withColumn("path", _moved(path, to)).withColumn("serial", F.col("serial") - low + first))


def chmod(tree: DataFrame, path: str, mode: int) -> DataFrame:
    """A mode; a link's is fixed, and a file has no set-id or sticky bit."""
    was = _at(tree, path)
    if was is None:
        raise Refused("NotFound", path)
    if was["kind"] == 3 or mode & ~(0o1777 if was["kind"] == 2 else 0o777):
        raise Refused("InvalidInput", path)
    return tree.withColumn("mode", F.when(F.col("path") == path, mode).otherwise(F.col("mode")))


# operations of a workspace, by path


def symlink(tree: DataFrame, path: str, target: str) -> DataFrame:
    """A symbolic link; its text is the target, its mode fixed."""
    _need_parent(tree, path)
    if _at(tree, path) is not None:
        raise Refused("AlreadyExists", path)
    row = tree.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(3).alias("kind"), F.lit(target).alias("text"), F.lit(0o777).alias("mode"), F.lit(_next_serial(tree)).cast("long").alias("serial"))
    return tree.select("path", "kind", "text", "mode", "serial").unionAll(row)


def link(tree: DataFrame, path: str, to: str) -> DataFrame:
    """One more name of a file or link, with its serial; directories have one name."""
    was = _at(tree, path)
    if was is None:
        raise Refused("NotFound", path)
    if was["kind"] == 2:
        raise Refused("IsDirectory", path)
    _need_parent(tree, to)
    if _at(tree, to) is not None:
        raise Refused("AlreadyExists", to)
    return tree.unionByName(tree.where(F.col("path") == path).withColumn("path", F.lit(to)))


def unlink(tree: DataFrame, path: str) -> DataFrame:
    """One name less of what is no directory."""
    was = _at(tree, path)
    if was is None:
        raise Refused("NotFound", path)
    if was["kind"] == 2:
        raise Refused("IsDirectory", path)
    return tree.where(F.col("path") != path)


def _empty(tree: DataFrame, path: str) -> bool:
    return tree.where(F.col("path").startswith(path.rstrip("/") + "/") & (F.col("path") != path)).isEmpty()


def rmdir(tree: DataFrame, path: str) -> DataFrame:
    """An empty directory."""
    was = _at(tree, path)
    if was is None or path == "/":
        raise Refused("NotFound" if was is None else "InvalidInput", path)
    if was["kind"] != 2:
        raise Refused("NotDirectory", path)
    if not _empty(tree, path):
        raise Refused("NotEmpty", path)
    return tree.where(F.col("path") != path)


def rename(tree: DataFrame, path: str, to: str, replace: bool = True) -> DataFrame:
    """Another path for an entry and all below it. With replace, a file takes
    the place of a file, a directory that of an empty one; else what is there
    refuses it. A directory can't go below itself; two names of one inode stay."""
    was, there = _at(tree, path), _at(tree, to)
    if was is None or path == "/":
        raise Refused("NotFound" if was is None else "InvalidInput", path)
    if to.startswith(path + "/"):
        raise Refused("InvalidInput", to)
    _need_parent(tree, to)
    if there is not None:
        if not replace:
            raise Refused("AlreadyExists", to)
        if there["serial"] == was["serial"]:
            return tree
        if was["kind"] == 2 and there["kind"] != 2:
            raise Refused("NotDirectory", to)
        if was["kind"] != 2 and there["kind"] == 2:
            raise Refused("IsDirectory", to)
        if there["kind"] == 2 and not _empty(tree, to):
            raise Refused("NotEmpty", to)
        tree = tree.where(F.col("path") != to)
    return tree.withColumn("path", F.when(paths.below(F.col("path"), path), _moved(path, to)).otherwise(F.col("path")))


def set_attributes(tree: DataFrame, path: str, mode: int | None = None, size: int | None = None) -> DataFrame:
    """chmod and truncation of one inode, under all its names; a longer size
    fills with NUL characters."""
    was = _at(tree, path)
    if was is None:
        raise Refused("NotFound", path)
    if size is not None and (was["kind"] != 1 or size < 0):
        raise Refused("IsDirectory" if was["kind"] == 2 else "InvalidInput", path)
    here = F.col("serial") == was["serial"]
    if mode is not None:
        chmod(tree, path, mode)  # refuses what is no mode of this kind
        tree = tree.withColumn("mode", F.when(here, mode).otherwise(F.col("mode")))
    if size is not None:
        tree = tree.withColumn("text", F.when(here, F.rpad("text", size, "\0")).otherwise(F.col("text")))
    return tree


def there(tree: DataFrame, path: str, *changes: tuple) -> DataFrame:
    """Changes that are asked for only where path has an entry; else the tree stays."""
    return tree if _at(tree, path) is None else apply(tree, list(changes))


OPS = {"there": there, "write": write, "edit": edit, "mkdir": mkdir, "rm": remove, "mv": move, "cp": copy, "chmod": chmod, "symlink": symlink, "link": link, "unlink": unlink, "rmdir": rmdir, "rename": rename, "setattr": set_attributes}


def apply(tree: DataFrame, changes: list[tuple]) -> DataFrame:
    """Changes (op, arguments...) in order; the first that is refused refuses
    all, and its index is told."""
    for i, (op, *args) in enumerate(changes):
        try:
            tree = OPS[op](tree, *args)
        except Refused as e:
            raise Refused(*e.args, i) from e
    return tree


def apply_result(tree: DataFrame, changes: list[tuple], branch: str = "") -> tuple[str, DataFrame]:
    """apply(), and whether it changed anything: Committed or UpToDate. The main
    line is read only: it changes by publishing."""
    if branch == "main":
        raise Refused("ReadOnly", branch)
    after = apply(tree, changes)
    columns = ["path", "kind", "text", "mode", "serial"]
    digest = lambda t: t.select(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"))
    same = digest(tree).first() == digest(after).first()
    return ("UpToDate" if same else "Committed"), after
