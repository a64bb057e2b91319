"""Three-way merges of trees.

base, ours and theirs are trees; entries are followed by serial, so that an
edit lands where the other side moved the file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.functions import globs, paths
from arbor.functions import lines as L
from arbor.session import ship, written

FIELDS = ("path", "kind", "content_id", "mode", "mtime_s", "mtime_ns")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, on: str = "serial") -> DataFrame:
    """A row for each serial (or path) of any side, b_, o_ and t_ columns."""
    out = None
    for letter, side in zip("bot", (base, ours, theirs)):
        own = side.select(on, *(F.col(c).alias(f"{letter}_{c}") for c in (*FIELDS, "serial") if c != on), F.lit(True).alias(f"{letter}_here"))
        out = own if out is None else out.join(own, on, "full_outer")
    return out


def _same(a: str, b: str):
    """Nothing that a merge looks at differs: kind, bytes, metadata; links not."""
    fields = ("here", "kind", "content_id", "mode", "mtime_s", "mtime_ns")
    same = F.lit(True)
    for f in fields:
        same &= F.col(f"{a}_{f}").eqNullSafe(F.col(f"{b}_{f}"))
    return same


def _same_content(a: str, b: str):
    same = F.lit(True)
    for f in ("here", "kind", "content_id"):
        same &= F.col(f"{a}_{f}").eqNullSafe(F.col(f"{b}_{f}"))
    return same


def deletion_times(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """path and the time of the nearest directory above it that tree still has."""
    up = wanted.select("path", F.explode(paths.parents(F.col("path"))).alias("above"))
    found = up.join(tree.select(F.col("path").alias("above"), "mtime_s", "mtime_ns"), "above")
    return found.groupBy("path").agg(F.max_by(F.struct("mtime_s", "mtime_ns"), F.length("above")).alias("time"))


def decide(sides: DataFrame, rules: list[globs.Rule] = ()) -> DataFrame:
    """three_way() by path with `pick` (keep theirs, ours, lww, text or a
    conflict) in the order that binds: equal or changed on one side alone;
    a rule, by the later time, ours on a tie; two files, as texts; deleted on
    one side; anything else.

    kept_ours and rule tell what a rule decided. A side that deleted the entry
    has its time in o_gone or t_gone, if the caller knows it, else the oldest."""
    name = F.substring("path", 2, 4096)
    rule = F.lit(None).cast("string")
    for r in rules:
        rule = F.when(name.rlike(r.regex(False)), F.lit(None if r.negated else r.pattern)).otherwise(rule)
    here = {x: F.coalesce(F.col(f"{x}_here"), F.lit(False)) for x in "bot"}
    oldest = F.struct(F.lit(-(2**63)).cast("long").alias("mtime_s"), F.lit(0).alias("mtime_ns"))
    times = {}
    for x in "ot":
        gone = F.coalesce(F.col(f"{x}_gone"), oldest) if f"{x}_gone" in sides.columns else oldest
        times[x] = F.when(here[x], F.struct(F.col(f"{x}_mtime_s").cast("long").alias("mtime_s"), F.col(f"{x}_mtime_ns").cast("int").alias("mtime_ns"))).otherwise(gone)
    file = lambda x: here[x] & (F.col(f"{x}_kind") == 1)
    pick = (
        F.when(_same("o", "t") | _same("b", "o"), "theirs")
        .when(_same("b", "t"), "ours")
        .when(F.col("rule").isNotNull(), "lww")
        .when(file("o") & file("t"), "text")
        .when(here["o"] & ~here["t"] & (F.col("o_kind") != 2), "modify/delete")
        .when(~here["o"] & here["t"] & (F.col("t_kind") != 2), "delete/modify")
        .otherwise("type")
    )
    out = sides.withColumn("rule", rule).withColumn("pick", pick)
    return out.withColumn("kept_ours", F.when(F.col("pick") == "lww", times["o"] >= times["t"])).withColumn("rule", F.when(F.col("pick") == "lww", F.col("rule")))


def _time(x: str):
    return F.struct(F.col(f"{x}_mtime_s").alias("s"), F.col(f"{x}_mtime_ns").alias("ns"))


def _mode(x: str):
    return F.col(f"{x}_mode")


def _field(of, side):
    """One side's change, else the decided side's value."""
    b, o, t = map(of, "bot")
    return F.when(t.eqNullSafe(b), o).when(o.eqNullSafe(b), t).otherwise(F.when(side == "t", t).otherwise(o))


def _mode_clash():
    c = F.col
    return (c("t_mode") != c("b_mode")) & (c("o_mode") != c("b_mode")) & (c("t_mode") != c("o_mode")) & (c("o_kind") != 2)


def merge_metadata(sides: DataFrame) -> DataFrame:
    """The merged mode and time of entries on all sides, seconds and nanoseconds
    together: one side's change, else the side that the entry was decided for
    (`side`, o or t; ours if there is no such column); conflict where both
    changed the mode of what is no directory."""
    side = F.col("side") if "side" in sides.columns else F.lit("o")
    both = sides.where("b_here and o_here and t_here").withColumn("time", _field(_time, side))
    return both.withColumn("mode", _field(_mode, side)).withColumn("mtime_s", F.col("time.s")).withColumn("mtime_ns", F.col("time.ns")).withColumn("mode_conflict", _mode_clash()).drop("time")


def unit_of(units: list[tuple[str, list[str]]]):
    """The first unit that a path matches."""
    name = F.substring("path", 2, 4096)
    owner = F.lit(None).cast("string")
    for unit, patterns in reversed(units):
        hit = F.lit(False)
        for r in map(globs.rule, patterns):
            hit = F.when(name.rlike(r.regex(False)), not r.negated).otherwise(hit)
        owner = F.when(hit, unit).otherwise(owner)
    return owner


def unit_decisions(base: DataFrame, ours: DataFrame, theirs: DataFrame, units: list[tuple[str, list[str]]]) -> DataFrame:
    """For each unit, in order, of (name, patterns): how many of its paths each
    side changed, its latest time on each, and who keeps it if both did: the
    later, ours on a tie. A path belongs to the first unit that it matches."""
    sides = three_way(base, ours, theirs, "path").withColumn("unit", unit_of(units)).where("unit is not null")
    time = lambda x: F.when(~_same("b", x), F.struct(F.col(f"{x}_mtime_s"), F.col(f"{x}_mtime_ns")))
    told = sides.groupBy("unit").agg(F.count(F.when(~_same("b", "o"), 1)).alias("ours_changed"), F.count(F.when(~_same("b", "t"), 1)).alias("theirs_changed"), F.max(time("o")).alias("o"), F.max(time("t")).alias("t"))
    later = F.coalesce(F.col("o.o_mtime_s"), F.lit(-1)) > F.coalesce(F.col("t.t_mtime_s"), F.lit(-1))
    even = F.col("o.o_mtime_s").eqNullSafe(F.col("t.t_mtime_s")) & (F.coalesce(F.col("o.o_mtime_ns"), F.lit(0)) >= F.coalesce(F.col("t.t_mtime_ns"), F.lit(0)))
    return told.select("unit", "ours_changed", "theirs_changed", F.when((F.col("ours_changed") > 0) & (F.col("theirs_changed") > 0), F.when(later | even, "ours").otherwise("theirs")).alias("kept"))


MERGED = "struct<text:string,hunks:array<struct<line:int,ours:array<string>,theirs:array<string>>>>"


def merge_texts(texts: DataFrame) -> DataFrame:
    """texts(path, b_text, o_text, t_text) with the merged text, its conflicts
    and the kind of conflict: content, add/add (no base) or binary."""
    ship(texts.sparkSession)

    @F.pandas_udf(MERGED)
    def merged(b: pd.Series, o: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = [L.merge3(x or "", y, z) for x, y, z in zip(b, o, t)]
        return pd.DataFrame({"text": [x for x, _ in found], "hunks": [[dict(zip(("line", "ours", "theirs"), h)) for h in hs] for _, hs in found]})

    readable = F.lit(True)
    for c in ("b_text", "o_text", "t_text"):
        readable &= ~F.coalesce(F.contains(c, F.lit("\0")), F.lit(False)) & (F.coalesce(F.octet_length(c), F.lit(0)) <= L.TEXT_BYTES)
    text = texts.where(readable).withColumn("m", merged("b_text", "o_text", "t_text"))
    kind = F.when(F.size("m.hunks") > 0, F.when(F.col("b_text").isNull(), "add/add").otherwise("content"))
    done = text.select("path", "m.text", "m.hunks", kind.alias("conflict"))
    binary = texts.where(~readable).select("path", F.col("o_text").alias("text"), F.lit(None).cast("array<struct<line:int,ours:array<string>,theirs:array<string>>>").alias("hunks"), F.lit("binary").alias("conflict"))
    return done.unionAll(binary)


def merged_tree(base: DataFrame, ours: DataFrame, theirs: DataFrame, texts: DataFrame, rules: list[globs.Rule] = (), units: list[tuple[str, list[str]]] = ()) -> tuple[DataFrame, DataFrame]:
    """The merged tree (path, serial, kind, text, mode, mtime_s, mtime_ns) and
    its conflicts (path, conflict, marked), marked being the text with the marker
    lines of a conflict of texts or of a deletion. texts: content_id -> text of
    every side.

    Entries are decided by serial. A path is the side's that moved the entry,
    ours if both did; a file below a directory that one side moved follows the
    move; a directory that nobody keeps is revived if something kept lies in
    it, and dropped if a file took its place and nothing else did. Paths that
    two kept entries want, and what lies below a file, end as conflicts `type`.
    A unit that both sides changed is taken whole from the side that
    unit_decisions() names, before any rule or text merge."""
    three = written(three_way(base, ours, theirs), "merge")  # read by every step below
    sides = three
    # where each side has put the entry; a moved directory carries what the other side has below it
    moved = sides.where("b_kind = 2 and b_here")
    for x in "ot":
        moves = moved.where(f"{x}_here and {x}_path <> b_path").select(F.col("b_path").alias("was"), F.col(f"{x}_path").alias("now"))
        y = "t" if x == "o" else "o"
        up = sides.where(f"{y}_here").select("serial", F.explode(F.concat(paths.parents(F.col(f"{y}_path")), F.array())).alias("was"))
        carried = up.join(moves, "was").groupBy("serial").agg(F.max_by(F.struct("was", "now"), F.length("was")).alias(f"{y}_move"))
        sides = sides.join(carried, "serial", "left").withColumn(f"{y}_to", F.when(F.col(f"{y}_move").isNull(), F.col(f"{y}_path")).otherwise(F.concat(F.col(f"{y}_move.now"), F.expr(f"substring({y}_path, length({y}_move.was) + 1)"))))
    path = F.when(F.col("o_path").isNull(), F.col("t_to")).when(F.col("t_path").isNull(), F.col("o_to")).when(F.col("o_path").eqNullSafe(F.col("b_path")), F.col("t_path")).otherwise(F.col("o_path"))
    decided = decide(sides.withColumn("path", F.coalesce(path, "b_path")), list(rules))
    if units:
        told = unit_decisions(base, ours, theirs, list(units)).select("unit", "kept")
        decided = decided.withColumn("unit", unit_of(list(units))).join(F.broadcast(told), "unit", "left")  # a row a unit
        decided = decided.withColumn("pick", F.coalesce("kept", "pick")).withColumn("whole", F.col("kept").isNotNull()).drop("unit", "kept")
    decided = written(decided, "decided")
    side = F.when(F.col("pick") == "theirs", "t").when(F.col("pick") == "ours", "o").when(F.col("pick") == "lww", F.when(F.col("kept_ours"), "o").otherwise("t")).when(F.col("pick").isin("text", "modify/delete"), "o").when(F.col("pick") == "delete/modify", "t").otherwise(F.when(F.col("o_here"), "o").otherwise("t"))
    decided = decided.withColumn("side", side)
    take = lambda c: F.when(F.col("side") == "o", F.col(f"o_{c}")).otherwise(F.col(f"t_{c}"))
    kept = decided.withColumn("kind", take("kind")).withColumn("content_id", take("content_id")).withColumn("here", F.coalesce(take("here"), F.lit(False)))
    # metadata is merged field by field where all sides have the entry, but for a unit, which is one side's whole
    every = F.col("b_here") & F.col("o_here") & F.col("t_here")
    if units:
        every &= ~F.coalesce(F.col("whole"), F.lit(False))
    own = F.struct(take("mtime_s").alias("s"), take("mtime_ns").alias("ns"))
    kept = kept.withColumn("time", F.when(every, _field(_time, F.col("side"))).otherwise(own)).withColumn("mode", F.when(every, _field(_mode, F.col("side"))).otherwise(take("mode")))
    kept = kept.withColumn("mode_conflict", F.coalesce(every & _mode_clash() & (F.col("pick") == "text"), F.lit(False)))
    name = {x: texts.select(F.col("content_id").alias(f"{x}_content_id"), F.col("text").alias(f"{x}_text")) for x in "bot"}
    need = kept.where("pick = 'text'").select("serial", "path", "b_content_id", "o_content_id", "t_content_id")
    for x in "bot":
        need = need.join(name[x], f"{x}_content_id", "left")
    done = merge_texts(need.select(F.col("serial").cast("string").alias("path"), "b_text", "o_text", "t_text"))
    done = done.select(F.col("path").cast("long").alias("serial"), F.col("text").alias("m_text"), "conflict")
    out = kept.where("here").join(texts.select("content_id", "text"), "content_id", "left").join(done, "serial", "left")
    entries = written(out.select("path", "serial", "kind", F.coalesce("m_text", "text").alias("text"), "mode", F.col("time.s").alias("mtime_s"), F.col("time.ns").alias("mtime_ns"), "pick", "conflict", "mode_conflict", F.coalesce("o_here", F.lit(False)).alias("ours")), "entries")
    # two new directories of one name are one; two new files of one name merge as texts without a base
    dirs = entries.where("kind = 2").groupBy("path").agg(F.min("serial").alias("serial"), F.min_by("mode", "serial").alias("mode"), F.max(F.struct("mtime_s", "mtime_ns")).alias("time")).select("path", "serial", "mode", "time.mtime_s", "time.mtime_ns")
    files = entries.where("kind <> 2")
    clash = files.groupBy("path").agg(F.min_by("text", F.struct(~F.col("ours"), "serial")).alias("o_text"), F.max_by("text", F.struct(~F.col("ours"), "serial")).alias("t_text"), F.count("*").alias("times"), F.min_by("serial", F.struct(~F.col("ours"), "serial")).alias("keep"), F.bool_and(F.col("kind") == 1).alias("plain"))
    clash = written(clash.where("times > 1"), "clash")
    added = written(merge_texts(clash.where("plain and o_text <> t_text").select("path", F.lit(None).cast("string").alias("b_text"), "o_text", "t_text")), "added")
    files = files.join(clash.select("path", "keep"), "path", "left").where("keep is null or serial = keep").drop("keep")
    files = files.join(added.select("path", F.col("text").alias("both"), F.col("conflict").alias("clashed")), "path", "left")
    files = files.withColumn("text", F.coalesce("both", "text")).withColumn("conflict", F.coalesce("conflict", "clashed")).drop("both", "clashed")
    unlike = clash.where("not plain").select("path", F.lit("type").alias("conflict"))
    # a directory that a kept file needs comes back; a file stands where a directory was
    above = files.select(F.explode(paths.parents(F.col("path"))).alias("path")).distinct()
    lost = three.where("b_kind = 2").select(F.col("b_path").alias("path"), F.col("serial"), F.col("b_mode").alias("mode"), F.col("b_mtime_s").alias("mtime_s"), F.col("b_mtime_ns").alias("mtime_ns"))
    revived = above.join(dirs, "path", "left_anti").join(files.select("path"), "path", "left_anti").join(lost, "path")
    # below a path that one side made a file, nothing stays
    hidden = files.select("path", F.explode(paths.parents(F.col("path"))).alias("above")).join(files.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    files = files.join(hidden, "path", "left_anti")
    tree = files.select("path", "serial", "kind", "text", "mode", "mtime_s", "mtime_ns").unionByName(dirs.unionByName(revived.select(*dirs.columns)).join(files.select("path"), "path", "left_anti").withColumn("kind", F.lit(2)).withColumn("text", F.lit(None).cast("string")))
    conflicts = files.where("conflict is not null").select("path", "conflict").unionAll(entries.where("pick in ('modify/delete', 'delete/modify', 'type') and kind <> 2").select("path", F.col("pick").alias("conflict")).join(hidden, "path", "left_anti")).unionAll(unlike)
    conflicts = conflicts.unionAll(files.where("mode_conflict").select("path", F.lit("mode").alias("conflict")))
    # a file that both sides moved, to different places
    conflicts = conflicts.unionAll(decided.where("b_here and o_here and t_here and o_path <> b_path and t_path <> b_path and o_path <> t_path and b_kind = 2").select("path", F.lit("type").alias("conflict")))
    text = files.where("kind = 1").select("path", "text")
    marked = F.when(F.col("conflict").isin("content", "add/add"), F.col("text")).when(F.col("conflict") == "modify/delete", deletion_markers(F.col("text"), True)).when(F.col("conflict") == "delete/modify", deletion_markers(F.col("text"), False))
    return tree, conflicts.distinct().join(text, "path", "left").select("path", "conflict", marked.alias("marked"))


def deletion_markers(text, kept_ours: bool, labels: tuple[str, str] = ("ours", "theirs")):
    """A text that one side deleted, marked: a column."""
    ours, theirs = L.OPEN + labels[0], L.CLOSE + labels[1]
    parts = (ours, text, L.SEPARATOR, theirs + " (deleted)") if kept_ours else (ours + " (deleted)", L.SEPARATOR, text, theirs)
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in parts))


def rules_of(tree: DataFrame, texts: DataFrame, path: str = "/.lww") -> list[globs.Rule]:
    """The rules that a tree has in its rule file; none if it has no such file.
    A rule file is one short text."""
    found = tree.where((F.col("path") == path) & (F.col("kind") == 1)).join(texts, "content_id").select("text").first()
    lines = (found["text"] if found else "").split("\n")
    return [globs.rule(x.strip()) for x in lines if x.strip() and not x.lstrip().startswith(("#", "%"))]


def commit_merge(base: DataFrame, head: DataFrame, mine: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A commit whose branch has moved meanwhile: what was written since base is
    merged onto the head, by the rules of the tree that is committed."""
    return merged_tree(base, head, mine, texts, rules_of(mine, texts))


def merge_outcomes(pairs: DataFrame, held: DataFrame, bases: DataFrame) -> DataFrame:
    """What merging each of pairs(a, b, l, r), branches and their heads, comes
    to: InvalidInput for a branch with itself; FastForward to the newer head if
    one holds the other already; else Merge from base, or Unrelated. held(l, r)
    are the pairs, either way round, of which l's ancestry holds r."""
    up = held.select("l", "r", F.lit(True).alias("held"))
    down = held.select(F.col("r").alias("l"), F.col("l").alias("r"), F.lit(True).alias("behind"))
    j = pairs.join(up, ["l", "r"], "left").join(down, ["l", "r"], "left").join(bases, ["l", "r"], "left")
    result = F.when(F.col("a") == F.col("b"), "InvalidInput").when(F.col("held") | F.col("behind"), "FastForward").when(F.col("base").isNotNull(), "Merge").otherwise("Unrelated")
    head = F.when(F.col("a") == F.col("b"), None).when(F.col("held"), F.col("l")).when(F.col("behind"), F.col("r"))
    return j.select("a", "b", result.alias("result"), head.alias("head"), F.when(result == "Merge", F.col("base")).alias("base"))


def merge_commits(outcomes: DataFrame, heads: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The commit rows that clean merges append: parents are both heads; a pair
    with conflicts(a, b) appends none."""
    clean = outcomes.where("result = 'Merge'").join(conflicts.select("a", "b").distinct(), ["a", "b"], "left_anti")
    l, r = heads.select(F.col("branch").alias("a"), F.col("id").alias("parent")), heads.select(F.col("branch").alias("b"), F.col("id").alias("second_parent"))  # noqa: E741
    return clean.join(l, "a").join(r, "b").select(F.sha2(F.concat_ws(":", "parent", "second_parent"), 256).alias("id"), F.col("a").alias("branch"), "parent", "second_parent", "base")
