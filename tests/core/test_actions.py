"""Reviewing actions and their inverses, moves of a cluster's files, pages."""

from pyspark.sql import functions as F

from twinspark.operators import actions

FILES = "id long, path string, phash string, file_size long, width int, height int"


def _files(spark, n=4):
    return spark.createDataFrame([(k, f"/a{k % 2}/f{k // 2}.png", f"{k:016x}", 10 * k, 5, 6) for k in range(1, n + 1)], FILES)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_trash_and_back(spark):
    files = _files(spark)
    gone = spark.createDataFrame([("/a1/f0.png",), ("/nowhere.png",)], "path string")
    left, trash = actions.trashed(files, gone, "/trash")
    assert left.count() == 3 and [tuple(r)[:2] for r in trash.collect()] == [("/a1/f0.png", "/trash/1_f0.png")]
    back = {r.path: r for r in actions.restored(left, trash).collect()}
    assert len(back) == 4 and tuple(back["/a1/f0.png"]) == (1, "/a1/f0.png", None, 10, 0, 0)
    taken = left.union(spark.createDataFrame([(9, "/a1/f0.png", "x", 1, 1, 1)], FILES))
    assert _rows(actions.restored(taken, trash)) == _rows(taken)


def test_replace_and_back(spark):
    files = _files(spark)
    pairs = spark.createDataFrame([("/a1/f0.png", "/a0/f1.png"), ("/a0/f2.png", "/nowhere.png")], "path string, by string")
    new, before = actions.replaced(files, pairs)
    assert {r.path: (r.id, r.phash, r.file_size) for r in new.collect()}["/a1/f0.png"] == (1, f"{2:016x}", 20)
    assert _rows(actions.put_back(new, before)) == _rows(files)


def test_ignore_and_back(spark):
    stored = spark.createDataFrame([(1, 2, "duplicate", 3.0), (2, 3, "similar", 1.0)], "id1 long, id2 long, relation_type string, distance double")
    pairs = spark.createDataFrame([(2, 1), (4, 5)], "id1 long, id2 long")
    new, before = actions.ignored(stored, pairs)
    assert _rows(new) == [(1, 2, "ignored", 3.0), (2, 3, "similar", 1.0), (4, 5, "ignored", None)]
    assert _rows(actions.unignored(new, pairs, before)) == _rows(stored)


def test_files_of_a_cluster_get_free_names(spark):
    files = _files(spark, 6)
    members = spark.createDataFrame([(7, "/a1/f0.png"), (7, "/a0/f1.png"), (7, "/a1/f1.png"), (7, "/gone.png"), (8, "/a0/f2.png")], "cluster_id long, file_path string")
    taken = files.union(spark.createDataFrame([(20, "/kept/f0.png", "x", 1, 1, 1)], FILES))
    moved, after = actions.gathered(taken, members, 7, "/kept")
    paths = {r.id: r.path for r in moved.collect()}
    assert paths[20] == "/kept/f0.png" and paths[1] == "/kept/f0_1.png"
    assert {paths[2], paths[3]} == {"/kept/f1.png", "/kept/f1_1.png"} and paths[4] == "/a0/f2.png"
    assert {r.file_path for r in after.where("cluster_id = 7").collect()} == {"/kept/f0_1.png", "/kept/f1.png", "/kept/f1_1.png", "/gone.png"}


def test_idents_pages_and_tuples(spark):
    files = _files(spark)
    idents = spark.createDataFrame([("/a1/f0.png",), (f"{3:016x}",), ("?",)], "ident string")
    assert _rows(actions.resolved(files, idents)) == [("/a1/f0.png", "/a1/f0.png"), (f"{3:016x}", "/a1/f1.png")]
    pages = actions.paged(spark.range(250).withColumnRenamed("id", "n"), "n", 100).groupBy("page").agg(F.count("*"), F.min("n"))
    assert _rows(pages) == [(0, 100, 0), (1, 100, 100), (2, 50, 200)]
    rows = spark.createDataFrame([(["5", "3", "similar"],), (["1", "2", "duplicate", "4.5"],)], "t array<string>")
    assert _rows(actions.from_tuples(rows).select("id1", "id2", "relation_type", "distance")) == [(1, 2, "duplicate", 4.5), (3, 5, "similar", None)]
