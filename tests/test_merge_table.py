"""The verdicts of a table of merges, and changes that are refused."""

import pytest
from pyspark.sql import functions as F

from arbor.operators import diff, merge, writes

SEED = {"/": None, "/d1": None, "/d2": None, "/d1/a.txt": "a\n", "/d1/b.txt": "b\n", "/d2/c.txt": "c\n", "/top.txt": "1\n2\n3\n4\n5\n"}


def seed(spark):
    return spark.createDataFrame([(p, 2 if t is None else 1, t, 0o755 if t is None else 0o644, i + 1) for i, (p, t) in enumerate(SEED.items())], "path string, kind int, text string, mode int, serial long")


def as_tree(t, when):
    return t.select("path", "serial", "kind", F.when(F.col("kind") == 1, F.sha2("text", 256)).alias("content_id"), "mode", F.lit(when).cast("long").alias("mtime_s"), F.lit(0).alias("mtime_ns"))


def merged(spark, ours, theirs, units=(), when=(1, 1)):
    base = seed(spark)
    o = writes.apply(base, ours)
    # the sides make new entries of their own: keep their serials apart
    t = writes.apply(base, theirs)
    t = t.withColumn("serial", F.when(F.col("serial") > len(SEED), F.col("serial") + 1000).otherwise(F.col("serial")))
    texts = base.unionAll(o).unionAll(t).where("kind = 1").select(F.sha2("text", 256).alias("content_id"), "text").distinct()
    tree, conflicts = merge.merged_tree(as_tree(base, 1), as_tree(o, when[0]), as_tree(t, when[1]), texts, (), units)
    return {r["path"]: r["text"] for r in tree.collect()}, {(r["path"], r["conflict"]) for r in conflicts.collect()}


TOP = "1\n2\n3\n4\n5\n"
CASES = [
    ("disjoint", [("write", "/d1/a.txt", "a2\n")], [("write", "/d2/c.txt", "c2\n")], {"/d1/a.txt": "a2\n", "/d2/c.txt": "c2\n"}, set()),
    ("text-merge", [("write", "/top.txt", TOP.replace("1", "one"))], [("write", "/top.txt", TOP.replace("5", "five"))], {"/top.txt": "one\n2\n3\n4\nfive\n"}, set()),
    ("text-conflict", [("write", "/top.txt", TOP.replace("3", "left"))], [("write", "/top.txt", TOP.replace("3", "right"))], {}, {("/top.txt", "content")}),
    ("modify-delete", [("write", "/d1/b.txt", "b2\n")], [("rm", "/d1/b.txt")], {}, {("/d1/b.txt", "modify/delete")}),
    ("move-directory", [("mv", "/d1", "/moved")], [("write", "/d2/c.txt", "c2\n")], {"/moved/a.txt": "a\n", "/moved/b.txt": "b\n", "/d2/c.txt": "c2\n", "/d1": "absent"}, set()),
    ("move-and-edit-inside", [("mv", "/d1", "/moved")], [("write", "/d1/a.txt", "edited\n")], {"/moved/a.txt": "edited\n", "/d1/a.txt": "absent"}, set()),
    ("revive-deleted-parent", [("rm", "/d2")], [("write", "/d2/new.txt", "new\n")], {"/d2/new.txt": "new\n", "/d2": None, "/d2/c.txt": "absent"}, set()),
    ("directory-becomes-file", [("rm", "/d1"), ("write", "/d1", "file\n")], [("write", "/d1/z.txt", "z\n")], {"/d1": "file\n", "/d1/z.txt": "absent"}, set()),
    ("add-add-same", [("write", "/same.txt", "x\n")], [("write", "/same.txt", "x\n")], {"/same.txt": "x\n"}, set()),
    ("add-add-different", [("write", "/new.txt", "left\n")], [("write", "/new.txt", "right\n")], {"/new.txt": "<<<<<<< ours\nleft\n=======\nright\n>>>>>>> theirs\n"}, {("/new.txt", "add/add")}),
    ("nested-creation-and-sort-edges", [("mkdir", "/n1/n2"), ("write", "/n1/n2/deep.txt", "deep\n"), ("write", "/n1.y", "dot\n"), ("write", "/n1-z", "dash\n")], [("write", "/n1x.txt", "x\n"), ("write", "/d1/a.b", "ab\n")], {"/n1": None, "/n1/n2": None, "/n1/n2/deep.txt": "deep\n", "/n1.y": "dot\n", "/n1-z": "dash\n", "/n1x.txt": "x\n", "/d1/a.b": "ab\n"}, set()),
    ("both-move-elsewhere", [("mv", "/d2/c.txt", "/c-left.txt")], [("mv", "/d2/c.txt", "/c-right.txt")], {"/c-left.txt": "c\n", "/c-right.txt": "absent", "/d2/c.txt": "absent"}, set()),
    ("delete-directory", [("rm", "/d1")], [("rm", "/d1/a.txt")], {"/d1": "absent", "/d1/b.txt": "absent"}, set()),
]


@pytest.mark.parametrize(("name", "ours", "theirs", "wanted", "conflicts"), CASES, ids=[c[0] for c in CASES])
def test_merge_table(spark, name, ours, theirs, wanted, conflicts):
    tree, found = merged(spark, ours, theirs)
    assert found == conflicts
    for path, text in wanted.items():
        assert tree.get(path, "absent") == text


@pytest.mark.parametrize(("when", "text"), [((3, 2), "left\n"), ((2, 3), "right\n"), ((2, 2), "left\n")])
def test_a_unit_is_taken_whole_from_the_later_side(spark, when, text):
    ours, theirs = [("write", "/d1/a.txt", "left\n")], [("write", "/d1/a.txt", "right\n"), ("rm", "/d1/b.txt")]
    tree, conflicts = merged(spark, ours, theirs, [("d1", ["/d1/"])], when)
    assert not conflicts and tree["/d1/a.txt"] == text and ("/d1/b.txt" in tree) == (text == "left\n")


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (("write", "/none/x", "t"), "NotFound"),
        (("write", "/d1", "t"), "IsDirectory"),
        (("write", "/top.txt/x", "t"), "NotDirectory"),
        (("edit", "/top.txt", "9", "t"), "NoMatch"),
        (("edit", "/top.txt", "\n", "t"), "AmbiguousMatch"),
        (("mv", "/d1", "/d1/x"), "InvalidInput"),
        (("cp", "/absent", "/y"), "NotFound"),
        (("chmod", "/top.txt", 0o4755), "InvalidInput"),
        (("rm", "/absent"), "NotFound"),
        (("mkdir", "/top.txt/x"), "NotDirectory"),
    ],
)
def test_refusals_tell_their_code_and_index(spark, change, code):
    with pytest.raises(writes.Refused) as e:
        writes.apply(seed(spark), [("mkdir", "/ok"), change])
    assert e.value.args[0] == code and e.value.args[-1] == 1


def test_metadata_is_merged_by_field_and_time_as_one(spark):
    """Each path's (seconds, nanoseconds, mode) on base, ours, theirs and merged; the texts differ on both sides where decided."""
    rows = {  # text changes, then base, ours, theirs, merged
        "/one": ((0, 1), (100, 5, 0o644), (100, 5, 0o644), (50, 9, 0o644), (50, 9, 0o644)),
        "/two": ((1, 1), (100, 5, 0o644), (200, 7, 0o600), (300, 1, 0o644), (200, 7, 0o600)),
        "/three": ((1, 0), (100, 5, 0o644), (200, 7, 0o600), (300, 1, 0o640), (200, 7, 0o600)),
        "/four": ((0, 0), (100, 5, 0o644), (100, 5, 0o600), (100, 6, 0o644), (100, 6, 0o600)),
    }
    schema = "path string, serial long, kind int, content_id string, mode int, mtime_s long, mtime_ns int"
    side = lambda k: spark.createDataFrame([(p, i, 1, f"{p}{k if k and r[0][k - 1] else 0}", r[1 + k][2], r[1 + k][0], r[1 + k][1]) for i, (p, r) in enumerate(rows.items())], schema)
    texts = spark.createDataFrame([(f"{p}{k}", "\n".join("abcdefgh"[: 7 - k] + str(k) * k)) for p in rows for k in range(3)], "content_id string, text string")
    tree, conflicts = merge.merged_tree(side(0), side(1), side(2), texts)
    assert {r["path"]: (r["mtime_s"], r["mtime_ns"], r["mode"]) for r in tree.collect()} == {p: r[4] for p, r in rows.items()}
    assert ("/three", "mode") in {(r["path"], r["conflict"]) for r in conflicts.collect()}
    assert not [r for r in conflicts.collect() if r["conflict"] == "mode" and r["path"] != "/three"]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (("symlink", "/top.txt", "x"), "AlreadyExists"),
        (("link", "/d1", "/d3"), "IsDirectory"),
        (("unlink", "/d1"), "IsDirectory"),
        (("rmdir", "/d1"), "NotEmpty"),
        (("rmdir", "/top.txt"), "NotDirectory"),
        (("rename", "/d1", "/d1/x"), "InvalidInput"),
        (("rename", "/d1", "/d2"), "NotEmpty"),
        (("rename", "/d1", "/top.txt"), "NotDirectory"),
        (("rename", "/top.txt", "/d1"), "IsDirectory"),
        (("rename", "/top.txt", "/d1/a.txt", False), "AlreadyExists"),
        (("setattr", "/d1", None, 3), "IsDirectory"),
    ],
)
def test_workspace_refusals(spark, change, code):
    with pytest.raises(writes.Refused) as e:
        writes.apply(seed(spark), [change])
    assert e.value.args[0] == code


def test_results_of_changes(spark):
    assert writes.apply_result(seed(spark), [("write", "/top.txt", TOP)], "b")[0] == "UpToDate"
    assert writes.apply_result(seed(spark), [("write", "/top.txt", "x")], "b")[0] == "Committed"
    with pytest.raises(writes.Refused):
        writes.apply_result(seed(spark), [], "main")


def test_difference_of_a_tree_with_itself_is_empty(spark):
    t = as_tree(seed(spark), 1).withColumn("parent_path", F.lit("")).withColumn("name", F.lit("")).withColumn("size", F.lit(1))
    assert diff.diff_trees(t, t).count() == 0
