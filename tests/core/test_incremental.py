"""Pairs, components and buckets that are kept up to date batch by batch, against doing all at once."""

import random

import pytest
from pyspark.sql import functions as F

from twinspark.functions import hashes
from twinspark.operators import files, graph, pairs
from twinspark.operators.incremental import Components, Pairs
from twinspark.operators.store import Conflict, Store
from twinspark.plans.shared import kept


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def file_rows(rng, ids):
    """Near hashes by flipping some bits of a few; equal ones, and files without one."""
    seeds = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for i in ids:
        h = rng.choice(seeds)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            h ^= 1 << rng.randrange(64)
        out.append((i, rng.choice([f"{h:016x}"] * 12 + [f"{h:016X}", None, "abc"])))
    return out


@pytest.mark.parametrize("t", [3, 5, 12])
def test_three_batches_give_the_pairs_of_the_whole_join(spark, store, t):
    rng, now = random.Random(t), {}
    kept_up = Pairs(store, t, kept, buckets=5)
    for batch, gone in ((range(0, 50), []), (range(40, 90), [1, 2, 3, 7000]), (range(0, 20), [*range(60, 75), 5])):
        new = file_rows(rng, batch)
        now = {i: h for i, h in now.items() if i not in gone} | dict(new)
        kept_up.update(spark.createDataFrame(new, "id long, phash string"), spark.createDataFrame([(i,) for i in gone], "id long"))
    number = {i: int(h, 16) for i, h in now.items() if h and len(h) == 16}
    want = {(a, b, (x ^ y).bit_count()) for a, x in number.items() for b, y in number.items() if a < b and (x ^ y).bit_count() <= t}
    got = [tuple(r) for r in kept_up.pairs().collect()]
    assert len(got) == len(want) > 50 and set(got) == want
    near = lambda i: sum(i in p[:2] for p in want)
    assert {tuple(r) for r in kept_up.links().collect()} == {(i, near(i)) for i in number}
    whole = hashes.with_chunks(spark.createDataFrame(list(now.items()), "id long, phash string"))
    assert {tuple(r) for r in pairs.hamming_join(whole, t).collect()} == want
    assert {tuple(r) for r in kept_up.hashes().collect()} == {tuple(r) for r in pairs.distinct_hash_pairs(whole, t).collect()}


def test_a_batch_reads_and_writes_its_buckets_only(spark, store):
    rng = random.Random(1)
    kept_up = Pairs(store, 3, kept, buckets=64)
    kept_up.update(spark.createDataFrame(file_rows(rng, range(200)), "id long, phash string"))
    before = store.entry("pairs_ids")["at"]
    kept_up.update(spark.createDataFrame([(1000, "00000000ffffffff")], "id long, phash string"))
    after = store.entry("pairs_ids")["at"]
    assert sum(before.get(b) != after.get(b) for b in set(before) | set(after)) == 1
    blocks = [store.entry("pairs_blocks", v)["at"] for v in store.versions()[-2:]]
    assert sum(blocks[0].get(b) != blocks[1].get(b) for b in set(blocks[0]) | set(blocks[1])) <= 4


def union_find(edges):
    up = {}

    def top(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {(a, top(a)) for a in list(up)}


def test_components_with_inserts_deletes_and_rejections(spark, store):
    rng, kept_up = random.Random(4), Components(store, kept, buckets=7)
    there, banned = set(), set()
    edge = lambda n: {tuple(sorted(rng.sample(range(n), 2))) for _ in range(18)}
    for step in range(4):
        new = edge(40)
        gone = set(rng.sample(sorted(there), min(len(there), 5)))
        bad = set(rng.sample(sorted(there | new), 3)) if step else set()
        banned |= bad
        there = ((there - gone - bad) | new) - banned
        df = lambda e: spark.createDataFrame([x if rng.random() < 0.5 else x[::-1] for x in e] + [(3, 3)], "src long, dst long")  # noqa: B023, E731
        kept_up.update(df(new), df(gone), df(bad) if bad else None)
        assert {tuple(r) for r in kept_up.read().collect()} == union_find(there)
    assert kept_up.read().count() == kept_up.read().select("id").distinct().count()
    all_edges = spark.createDataFrame(sorted(there | banned), "src long, dst long")
    negative = spark.createDataFrame(sorted(banned), "src long, dst long")
    whole = graph.components(graph.without_negatives(all_edges, negative), kept)
    assert {tuple(r) for r in whole.collect()} == union_find(there)


def test_untouched_components_stay_where_they_are(spark, store):
    kept_up = Components(store, kept, buckets=50)
    kept_up.update(spark.createDataFrame([(10 * k, 10 * k + 1) for k in range(40)] + [(10 * k + 1, 10 * k + 2) for k in range(40)], "src long, dst long"))
    first = store.version
    kept_up.update(spark.createDataFrame([(0, 11)], "src long, dst long"), spark.createDataFrame([(21, 22)], "src long, dst long"))
    a, b = store.entry("components_edges", first)["at"], store.entry("components_edges")["at"]
    assert sum(a.get(k) != b.get(k) for k in set(a) | set(b)) <= 4  # of 0, 10 and 20
    got = dict(map(tuple, kept_up.read().collect()))
    assert got[12] == 0 and got[21] == 20 and 22 not in got and len(got) == 119


def test_nothing_changes_with_empty_batches(spark, store):
    p, c = Pairs(store, 3, kept), Components(store, kept)
    p.update(spark.createDataFrame([], "id long, phash string"))
    c.update(spark.createDataFrame([], "src long, dst long"))
    c.update()
    assert p.pairs().count() == 0 and p.hashes().count() == 0 and c.read().count() == 0


def test_merge_rewrites_only_the_buckets_of_its_keys(spark, store):
    store.in_buckets("t", spark.createDataFrame([], "path string, v long").schema, ["path"], 32)
    store.publish([store.merged("t", spark.range(500).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.col("id").alias("v")))])
    before = store.entry("t")["at"]
    store.publish([store.merged("t", spark.createDataFrame([("/7", -7), ("/new", -1)], "path string, v long"), spark.createDataFrame([("/8",)], "path string"))])
    after = store.entry("t")["at"]
    assert 0 < sum(before[b] != after.get(b) for b in before) <= 3
    got = dict(map(tuple, store.read("t").collect()))
    assert got["/7"] == -7 and got["/new"] == -1 and "/8" not in got and len(got) == 500
    assert store.read("t", store.version - 1).count() == 500
    store.vacuum()
    assert store.read("t").count() == 500 and len(store.versions()) == 1


def test_files_are_upserted_by_bucket(spark, store):
    schema = "id long, path string, phash string, file_size long"
    store.in_buckets("files", spark.createDataFrame([], schema).schema, ["path"], 16)
    store.publish([store.merged("files", spark.createDataFrame([(7, "/old", "h", 1), (3, "/x", "h", 1)], schema))])
    new = spark.createDataFrame([("/old", None, 9, 2), ("/b", "h", 5, 1), ("/b", "h2", 6, 2), ("/a", "h", 4, 1)], "path string, phash string, file_size long, seq int")
    before = store.entry("files")["at"]
    files.upsert_into(store, new, keep_hash=True)
    got = {r.path: (r.id, r.phash, r.file_size) for r in store.read("files").collect()}
    assert got == {"/old": (7, "h", 9), "/x": (3, "h", 1), "/a": (8, "h", 4), "/b": (9, "h2", 6)}
    assert sum(before.get(b) != at for b, at in store.entry("files")["at"].items()) <= 3
    files.upsert_into(store, new.limit(0))
    files.upsert_into(store, spark.createDataFrame([("/c", None, 1, 1)], new.schema))
    assert {r.path: r.id for r in store.read("files").collect()}["/c"] == 10


def test_two_writers_lose_no_change(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = Store(spark, root)
    schema = spark.createDataFrame([], "path string, v long").schema
    one.in_buckets("t", schema, ["path"], 16)
    one.in_buckets("u", schema, ["path"], 16)
    two = Store(spark, root)
    row = lambda p, v: spark.createDataFrame([(p, v)], schema)
    one.publish([one.merged("t", row("/a", 1))])
    two.publish([two.merged("u", row("/b", 2))])  # another table: put on top
    assert two.read("t").count() == two.read("u").count() == 1
    one.sync()
    mine, theirs = one.merged("t", row("/a", 10)), two.merged("t", row("/a", 20))
    one.publish([mine])
    with pytest.raises(Conflict):
        two.publish([theirs])
    two.sync()
    two.publish([two.merged("t", row("/c", 3))])
    assert dict(map(tuple, two.read("t").collect())) == {"/a": 10, "/c": 3}
    assert two.vacuum(grace=3600) == 0
    assert two.vacuum() > 0  # what the loser wrote goes
    assert Store(spark, root).read("t").count() == 2


def test_a_refused_command_runs_again_on_the_new_version(spark, tmp_path):
    root, seen = f"file://{tmp_path}/store", []
    one, two = Store(spark, root), Store(spark, root)

    def add(path, between=lambda: None):
        def command(s):
            seen.append(path)
            rows = s.read("scanned_paths").unionByName(spark.createDataFrame([(path,)], "path string"))
            if len(seen) == 1:
                between()
            return {"scanned_paths": rows}

        return command

    assert one.run(add("/one", lambda: two.commit(scanned_paths=spark.createDataFrame([("/two",)], "path string"))))
    assert seen == ["/one", "/one"] and {r.path for r in one.read("scanned_paths").collect()} == {"/one", "/two"}


def test_no_table_of_a_batch_goes_through_the_driver(spark, tmp_path):
    """Tables of blocks take few bytes on disk, which is no reason to send their rows through the driver."""
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    index = Pairs(Store(spark, f"file://{tmp_path}/store"), 5, keep)
    index.update(spark.createDataFrame([(i, f"{i * 2654435761 % 2**64:016x}") for i in range(50)], "id long, phash string"))
    index.update(spark.createDataFrame([(i, f"{i * 40503 % 2**64:016x}") for i in range(30, 80)], "id long, phash string"))
    plans.append(index.links()._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
