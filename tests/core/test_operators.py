"""Pairs, relations, components, clusters, files, snapshots and streaming."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark import engines, schemas
from twinspark.functions import hashes
from twinspark.operators import clusters, files, graph, pairs, relations
from twinspark.operators.store import Store
from twinspark.plans.shared import kept
from twinspark.streaming import index


def table(spark, values, schema):
    return spark.createDataFrame(values, schema)


def hashed(spark, values):
    return hashes.with_chunks(table(spark, values, "id long, phash string"))


def near_hashes(n=120, seed=4):
    rng, out = random.Random(seed), []
    for _ in range(n // 6):
        h = rng.getrandbits(64)
        for k in range(6):
            x = h
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 8, 11])):
                x ^= 1 << b
            out.append(f"{x:016x}")
    return [(k, h) for k, h in enumerate(out)] + [(900, None), (901, ""), (902, "abc"), (903, "abc")]


def close(values, t):
    known = [(i, int(h, 16)) for i, h in values if h and len(h) == 16]
    return {(min(i, j), max(i, j), bin(a ^ b).count("1")) for i, a in known for j, b in known if i < j and bin(a ^ b).count("1") <= t}


@pytest.mark.parametrize("t", [0, 3, 5, 7, 8, 12, 40])
def test_hamming_join_is_complete(spark, t):
    values = near_hashes(60)
    got = {(r.id1, r.id2, r.distance) for r in pairs.hamming_join(hashed(spark, values), t).collect()}
    assert got == close(values, t)


def test_mih_is_a_part_and_complete_up_to_3(spark):
    values = near_hashes()
    f = hashed(spark, values)
    mih = lambda t: [(r.id1, r.id2, r.distance) for r in pairs.hamming_mih(f, t).collect()]
    assert sorted(mih(3)) == sorted(close(values, 3))
    assert len(mih(12)) == len(set(mih(12))) and set(mih(12)) < close(values, 12)
    gap = hashed(spark, [(1, "0000000000000000"), (2, "0001000100010001")])
    assert pairs.hamming_mih(gap, 4).count() == 0 and pairs.hamming_join(gap, 4).count() == 1


def test_exact_pairs(spark):
    f = table(spark, [(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, None), (6, ""), (7, "")], "id long, phash string")
    assert {tuple(r) for r in pairs.exact_pairs(f).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in pairs.exact_stars(f).collect()} == {(1, 2), (1, 3)}
    assert [tuple(r) for r in pairs.exact_groups(f).collect()] == [("x", 3, 1)]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[10] = v[11]
    df = table(spark, [(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<double>")
    got = defaultdict(list)
    for r in pairs.knn(df, df, 5).orderBy("id", "rank").collect():
        got[r.id].append(r.match_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k, d in enumerate(np.round(1 - u @ u.T, 9)):
        want = sorted(range(60), key=lambda j: (d[j], j))[:5]
        assert sorted(np.round(d[got[k]], 9)) == sorted(d[want])
    assert pairs.knn_pairs(pairs.knn(df, df, 5), 1e-9).collect()[0][:2] == (10, 11)
    assert pairs.knn(df.limit(0), df).count() == 0


def brute_components(edges):
    up = {}

    def top(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in up}


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(5, 5)], [(3, 1), (1, 3), (2, 9), (9, 8), (8, 1)], [(random.Random(k).randrange(80), random.Random(-k).randrange(80)) for k in range(70)]])
def test_components(spark, edges):
    df = table(spark, edges, "src long, dst long")
    want = {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    assert {r.id: r.component for r in graph.components(df, kept).collect()} == want
    turned = df.select(F.col("dst").alias("src"), F.col("src").alias("dst")).orderBy(F.desc("src"))
    assert {r.id: r.component for r in graph.components(turned, kept).collect()} == want


def test_negative_edges_are_direct(spark):
    e = table(spark, [(1, 2), (2, 3), (1, 3), (7, 8)], "src long, dst long")
    left = graph.without_negatives(e, table(spark, [(3, 1), (8, 7)], "src long, dst long"))
    assert {r.id: r.component for r in graph.components(left, kept).collect()} == {1: 1, 2: 1, 3: 1}


def test_relation_edges_and_cliques(spark):
    f = table(spark, [(1, "hash1"), (2, "hash2"), (3, "hash1")], "id long, phash string")
    rel = table(spark, [(1, 2, "duplicate", 1.0), (2, 3, "not_duplicate", 2.0), (1, 9, "duplicate", 0.0)], "id1 long, id2 long, relation_type string, distance double")
    positive, negative = graph.relation_edges(f, rel, ("duplicate",), exact_hash=False)
    assert [tuple(r) for r in positive.collect()] == [(1, 2)] and [tuple(r) for r in negative.collect()] == [(2, 3)]
    assert graph.relation_edges(f, rel, ("duplicate", "not_duplicate"))[1].count() == 0
    found = graph.components(graph.relation_edges(f, rel, ("duplicate",))[0], kept)
    assert [tuple(r) for r in graph.groups(found).collect()] == [(1, 3)]
    assert {(r.id1, r.id2, r.distance) for r in graph.cliques(found, rel).collect()} == {(1, 2, 1.0), (1, 3, None), (2, 3, 2.0)}
    assert {r.distance for r in graph.cliques(found).collect()} == {0.0}
    assert {tuple(r) for r in graph.edge_counts(f, rel, ("duplicate",)).collect()} == {("hash", 1), ("db", 1)}


REL = "id1 long, id2 long, relation_type string, distance double"


def test_merges(spark):
    old = table(spark, [(1, 2, "duplicate", 1.0)], REL)
    new = table(spark, [(2, 1, "new_match", 0.0, 1), (3, 4, "new_match", 5.0, 1), (4, 3, "similar", 6.0, 2), (5, 5, "similar", 0.0, 3)], REL + ", seq int")
    key = lambda df: sorted(map(tuple, df.collect()))
    keep = relations.merge(old, new, overwrite=False)
    assert key(keep) == [(1, 2, "duplicate", 1.0), (3, 4, "new_match", 5.0)]
    assert key(relations.merge(keep, new, overwrite=False)) == key(keep)
    assert key(relations.merge(old, new, overwrite=True)) == [(1, 2, "new_match", 0.0), (3, 4, "similar", 6.0)]
    marks = table(spark, [(2, 1, "similar"), (7, 6, "other")], "id1 long, id2 long, relation_type string")
    assert key(relations.annotate(old, marks)) == [(1, 2, "similar", 1.0), (6, 7, "other", None)]
    assert relations.annotate(old, marks, preserve_distance=False).where("id1 = 1").first().distance is None
    assert relations.remove(old, table(spark, [(2, 1)], "id1 long, id2 long")).count() == 0


def test_reading_relations(spark):
    old = table(spark, [(1, 2, "phash_match", None), (1, 3, "duplicate", 9.0), (2, 3, "new_match", 2.0)], REL)
    assert {tuple(r) for r in relations.scan(old, 5.0).collect()} == {(1, 2, "new_match", 0.0), (2, 3, "new_match", 2.0)}
    asked = table(spark, [(2, 1), (3, 1), (9, 8)], "id1 long, id2 long")
    assert {(r.id1, r.id2): r.ignored for r in relations.ignored(asked, old).collect()} == {(1, 2): True, (1, 3): True, (8, 9): False}
    found = table(spark, [(1, 3, "new_match", 0.0), (4, 5, "new_match", 0.0)], REL)
    assert [(r.id1, r.id2) for r in relations.reconcile(found, old).collect()] == [(4, 5)]
    assert tuple(relations.reconcile_counts(found, old).first()) == (1, 1, 2)
    assert relations.reconcile(found, old, True).count() == 2


def test_validation_hydration_and_resolving(spark):
    f = table(spark, [(1, "/a", 10, 4, 5), (2, "/b", 20, 5, 4)], "id long, path string, file_size long, width int, height int")
    asked = table(spark, [(1, 2), (1, 99999), (88888, 99999)], "id1 long, id2 long")
    assert tuple(relations.validation_counts(asked, f).first()) == (1, 2) and relations.valid(asked, f).count() == 1
    full = relations.hydrate(asked, f, "path", "file_size", "width", "height")
    assert full.count() == 1 and full.first().right_path == "/b"
    assert relations.smart_resolve(full, "size").first().delete_id == 1
    assert relations.smart_resolve(full, "resolution").first().delete_id is None
    assert relations.without_file(asked, 1).count() == 1


def test_next_visible_index(spark):
    g = table(spark, [(k, k in (3,)) for k in range(6)], "idx int, ignored boolean")
    assert [relations.next_visible(g, k, 1) for k in (2, 3, 5, 6)] == [2, 4, 5, -1]
    assert relations.next_visible(g, 3, -1) == 2 and relations.next_visible(g, 0, -1) == -1


def test_reconcile_clusters(spark):
    f = table(spark, [(p,) for p in "abcdefgxy"], "path string")
    comp = table(spark, [("a", 1), ("b", 1), ("c", 1), ("e", 5), ("f", 5), ("x", 9), ("gone", 9)], "path string, component long")
    members = table(spark, [(7, "a"), (3, "b"), (7, "d"), (8, "lost"), (4, "c"), (3, "c")], "cluster_id long, file_path string").where("not (cluster_id in (3, 4) and file_path = 'c')")
    shown, delta = clusters.reconcile(comp, members, f)
    assert {tuple(r) for r in shown.collect()} == {(3, "a"), (3, "b"), (3, "c"), (7, "d"), (-1, "e"), (-1, "f")}
    assert {tuple(r) for r in delta.collect()} == {(3, "c")}
    assert {r.cluster_id for r in clusters.inside_roots(shown, F.col("path").isin("a", "b", "c", "d")).collect()} == {3, 7}
    assert {(r.cluster_id, r.n, r.paths) for r in clusters.preview(shown, 2).collect()} >= {(3, 3, "a|b"), (7, 1, "d")}


def test_cluster_changes(spark):
    c, m = table(spark, [], "id long, name string, target_folder string"), table(spark, [], schemas.CLUSTER_MEMBERS)
    c, one = clusters.create(c, "first")
    c, two = clusters.create(c, "second", "/t")
    assert (one, two) == (1, 2) and c.where("id = 1").first().target_folder == ""
    c = clusters.update(c, table(spark, [(1, "renamed", None), (2, None, "/u")], "id long, name string, target_folder string"))
    assert {tuple(r) for r in c.select("id", "name", "target_folder").collect()} == {(1, "renamed", ""), (2, "second", "/u")}
    m = clusters.add_members(m, table(spark, [(1, "/a"), (1, "/a"), (1, "/b")], schemas.CLUSTER_MEMBERS))
    m = clusters.move_member(m, table(spark, [("/b", 1, 2)], "file_path string, from_id long, to_id long"))
    assert {tuple(r) for r in m.collect()} == {(1, "/a"), (2, "/b")}
    left, own = clusters.delete(c, m, table(spark, [(1,)], "id long"))
    assert [r.id for r in left.collect()] == [2] and [tuple(r) for r in own.collect()] == [(2, "/b")]
    shown = table(spark, [(-1, "/x"), (-1, "/y")], "cluster_id long, path string")
    c2, m2, new = clusters.persisted(c, m, shown, -1, "kept")
    assert new == 3 and m2.where("cluster_id = 3").count() == 2 and c2.count() == 3


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    got = {r.k: r.number for r in clusters.numbered(df, "k").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}


FILE = "id long, path string, phash string, file_size long"


def test_upsert_move_delete(spark):
    f = table(spark, [(1, "/a", "hash1", 1), (5, "/b", "hash2", 2)], FILE)
    new = table(spark, [("/b", None, 9, 1), ("/d", "h", 4, 1), ("/c", "h", 3, 1), ("/d", "h2", 5, 2)], "path string, phash string, file_size long, seq int")
    got = {r.path: (r.id, r.phash, r.file_size) for r in files.upsert(f, new).collect()}
    assert got == {"/a": (1, "hash1", 1), "/b": (5, None, 9), "/c": (6, "h", 3), "/d": (7, "h2", 5)}
    assert {r.path: r.phash for r in files.upsert(f, new, keep_hash=True).collect()}["/b"] == "hash2"
    once = files.upsert(f, new)
    assert sorted(map(tuple, files.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    m = table(spark, [(1, "/a"), (2, "/b")], schemas.CLUSTER_MEMBERS)
    moved, members = files.move(f, table(spark, [("/a", "/b"), ("/none", "/a2")], "path string, new_path string"), m)
    assert [(r.id, r.path, r.phash) for r in moved.collect()] == [(1, "/b", "hash1")]
    assert {tuple(r) for r in members.collect()} == {(1, "/b"), (2, "/b")}
    rel = table(spark, [(1, 5)], "id1 long, id2 long")
    left, cascaded = files.delete(f, rel, table(spark, [("/a",)], "path string"))
    assert left.count() == 1 and cascaded.count() == 0
    ids = table(spark, [(1,), (1,), (77,)], "id long")
    assert files.by_ids(f, ids).count() == 1 and [r.id for r in files.missing_ids(f, ids).collect()] == [77]


def test_upsert_recomputes_chunks(spark):
    f = hashes.with_chunks(table(spark, [(1, "/a", "00000000000000ff", 1)], FILE)).select("id", "path", "phash", *hashes.CHUNKS, "file_size")
    new = table(spark, [("/a", "abc123", 2, 1)], "path string, phash string, file_size long, seq int")
    r = files.upsert(f, new).first()
    assert r.phash == "abc123" and r.phash_c4 is None


def test_stale_and_status(spark):
    listing = table(spark, [("/same", 1.0), ("/changed", 2.0), ("/new", 1.0), ("/nohash", 1.0), ("/unreadable", None)], "path string, last_modified double")
    known = table(spark, [("/same", 1.0, "h"), ("/changed", 1.0, "h"), ("/nohash", 1.0, "")], "path string, last_modified double, phash string")
    assert {r.path for r in files.stale(listing, known).collect()} == {"/changed", "/new", "/nohash"}
    v = table(spark, [("/a", "clip", [1.0]), ("/b", "blip", [1.0])], schemas.VECTORS)
    assert {r.path for r in files.unindexed(table(spark, [("/a",), ("/b",)], "path string"), v, "clip").collect()} == {"/b"}
    new = table(spark, [("/a", "clip", [2.0], 1), ("/a", "clip", [3.0], 2)], schemas.VECTORS + ", seq int")
    assert {(r.path, r.embedding[0]) for r in files.upsert_vectors(v, new).collect()} == {("/a", 3.0), ("/b", 1.0)}
    s = spark.sql("select 'p' path, 'clip' engine, timestamp'2024-01-01' indexed_at")
    s2 = spark.sql("select 'p' path, 'clip' engine, timestamp'2025-01-01' indexed_at")
    assert files.mark_indexed(s, s2).first().indexed_at.year == 2025
    assert files.clear_indexed(s, "p").count() == 0 and files.clear_indexed(s).count() == 0
    roots = table(spark, [("/a",), ("/b",)], "path string")
    assert {tuple(r) for r in files.root_changes(roots, table(spark, [("/b",), ("/c",)], "path string")).collect()} == {("/c", "added"), ("/a", "removed")}
    assert files.add_scanned(roots, roots).count() == 2


def test_maintenance_and_integrity(spark):
    f = table(spark, [(1, "/a"), (2, "/b"), (3, "/c")], "id long, path string")
    rel = table(spark, [(1, 2), (1, 3), (1, 77)], "id1 long, id2 long")
    m = table(spark, [(1, "/a"), (2, "/c"), (3, "/none")], schemas.CLUSTER_MEMBERS)
    c = table(spark, [(1, "x"), (2, "y"), (3, "z"), (4, "w")], "id long, name string")
    s = spark.sql("select 'non_existent_path' path, 'mobilenet' engine, timestamp'2024-01-01' indexed_at")
    report = {r.metric: r.value for r in files.integrity(f, rel, m, c).collect()}
    assert report == {"files": 3, "relations": 3, "members": 3, "clusters": 4, "orphan_relations": 1, "orphan_members": 1, "empty_clusters": 1}
    out, gone = files.maintain(f, table(spark, [("/a",), ("/b",)], "path string"), rel, m, c, s)
    assert gone == {"files": 1, "status": 1, "members": 2, "relations": 2, "clusters": 3}
    assert [r.id for r in out["clusters"].collect()] == [1]


def test_store_versions_undo_redo(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("files").count() == 0 and not s.undo()
    one = table(spark, [("/a",)], "path string")
    s.commit(scanned_paths=one)
    assert s.run(lambda st: {"scanned_paths": files.add_scanned(st.read("scanned_paths"), table(spark, [("/b",)], "path string"))})
    assert s.read("scanned_paths").count() == 2
    assert s.undo() and s.read("scanned_paths").count() == 1
    assert s.redo() and s.read("scanned_paths").count() == 2 and not s.redo()
    assert not s.run(lambda st: 1 / 0) and s.read("scanned_paths").count() == 2
    assert s.undo() and s.run(lambda st: {"scanned_paths": one.limit(0)}) and not s.redo()
    s.compact("scanned_paths", 1)
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.version == s.version and again.read("scanned_paths").count() == 0
    assert again.read("scanned_paths", 2).count() == 2


def test_incremental_index(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    listing = table(spark, [("/a", 1, 1.0), ("/b", 2, 1.0)], "path string, file_size long, last_modified double")
    prints = lambda df: df.select("path", F.substring(F.md5("path"), 1, 16).alias("phash"), "file_size", F.lit(1).alias("width"), F.lit(1).alias("height"), "last_modified")
    assert index.index_files(s, listing, prints) == 2 and index.index_files(s, listing, prints) == 0
    ids = {r.path: r.id for r in s.read("files").collect()}
    changed = listing.withColumn("last_modified", F.when(F.col("path") == "/b", 2.0).otherwise(1.0))
    assert index.index_files(s, changed, prints) == 1
    assert {r.path: r.id for r in s.read("files").collect()} == ids and s.read("files").where("phash_c1 is null").count() == 0


def test_stream_is_the_batch(spark, tmp_path):
    at = str(tmp_path / "in")
    log = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 5).alias("k"), F.col("id").alias("seq"), (F.col("id") * 3).alias("v"))
    log(0, 20).coalesce(1).write.mode("append").parquet(at)
    run = lambda: index.upsert_stream(spark.readStream.schema("k long, seq long, v long").parquet(at), f"{tmp_path}/out", f"{tmp_path}/log", ["k"], ["seq"])
    run()
    log(20, 33).coalesce(1).write.mode("append").parquet(at)
    run()
    assert sorted(map(tuple, index.current(spark, f"{tmp_path}/out").select("k", "seq", "v").collect())) == sorted((s % 5, s, 3 * s) for s in range(28, 33))


def test_engines(spark):
    assert engines.engine("nothing").name == "phash" and engines.engine("clip").threshold == 0.1
    assert engines.Session().limit == 5 and engines.Session(engine="blip").limit == 0.1
    rng = np.random.default_rng(0)
    x = rng.random((32, 32)) * 255
    images = table(spark, [(1, x.ravel().tolist()), (2, (x + 0.01).ravel().tolist()), (3, (255 - x).ravel().tolist())], "id long, pixels array<double>")
    e = engines.engine("phash")
    got = e.pairs(e.fingerprint(images), e.threshold).collect()
    assert [(r.id1, r.id2) for r in got] == [(1, 2)]
    v = engines.engine("clip")
    vec = table(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    assert [(r.id1, r.id2) for r in v.pairs(v.fingerprint(vec), v.threshold).collect()] == [(1, 2)]
