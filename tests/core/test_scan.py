"""Scans: states, cancellation, progress; versions that go; stream tables that are whole."""

import pytest
from pyspark.sql import functions as F

from twinspark.engines import Engine
from twinspark.functions.hashes import cosine_distance
from twinspark.operators import pairs
from twinspark.operators.store import Store
from twinspark.plans.scan import Events, Scan, Throttle
from twinspark.streaming.index import current

FILES = "id long, path string, phash string, phash_c1 int, phash_c2 int, phash_c3 int, phash_c4 int, last_modified double"
LISTING = [("/a/1", 1.0, "00ff00ff00ff00ff"), ("/a/2", 1.0, "00ff00ff00ff00fe"), ("/b/3", 1.0, "00ff00ff00ff00ff")]


def engine(calls):
    def fingerprint(stale):
        calls.append(sorted(r.path for r in stale.collect()))
        return stale.select("path", F.col("h").alias("phash"), "last_modified")

    return Engine("phash", fingerprint, lambda df, t: pairs.hamming_join(df, int(t)))


def tables(spark, listing=LISTING):
    return spark.createDataFrame(listing, "path string, last_modified double, h string"), spark.createDataFrame([], FILES)


def test_scan_goes_through_its_states(spark):
    events, states, calls, found = Events(), [], [], []
    events.on("state", states.append)
    events.on("found", found.append)
    events.on("found", lambda n: 1 / 0)  # a listener's fault stops nothing
    listing, known = tables(spark)
    s = Scan(engine(calls), ["/a"], 5, events)
    assert [tuple(r) for r in s.run(listing, known).collect()] == [(1, 2, 1)]
    assert states == ["discovery", "indexing", "matching", "idle"] and found == [2] and calls == [["/a/1", "/a/2"]]
    # What is known by now isn't fingerprinted again.
    again = Scan(engine(calls), ["/a", "/b"], 0)
    assert [(r.id1, r.id2) for r in again.run(listing, s.files).collect()] == [(1, 3)] and calls[1:] == [["/b/3"]]


def test_scan_of_nothing_and_cancelled_scans(spark):
    listing, known = tables(spark)
    events, states = Events(), []
    events.on("state", states.append)
    assert Scan(engine([]), ["/c"], 5, events).run(listing, known) is None and states == ["discovery", "idle"]
    del states[:]
    s = Scan(engine([]), ["/a"], 5, events)
    events.on("found", lambda n: s.cancel())
    assert s.run(listing, known) is None and states == ["discovery", "idle"] and s.state == "idle"


def test_a_failing_engine_raises_and_ends_idle(spark):
    listing, known = tables(spark)
    s = Scan(Engine("phash", lambda stale: stale.select("nothing"), lambda df, t: df), ["/a"])
    with pytest.raises(Exception, match="nothing"):
        s.run(listing, known)
    assert s.state == "idle"


def test_throttle_passes_the_last_value_on():
    now, out = [0.0], []
    t = Throttle(out.append, 1.0, lambda: now[0])
    for at, value in ((0.0, 1), (0.4, 2), (0.9, 3), (1.1, 4), (1.2, 5)):
        now[0] = at
        t(value)
    t.flush()
    t.flush()
    assert out == [1, 4, 5]


def test_vacuum_keeps_what_is_in_use(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    for n in range(1, 4):
        s.commit(scanned_paths=spark.createDataFrame([(f"/{k}",) for k in range(n)], "path string"))
    s.commit(clusters=spark.createDataFrame([], "id long, name string, target_folder string, created_at timestamp"))
    assert s.vacuum() == 2 and s.versions() == [4]
    assert s.read("scanned_paths").count() == 3 and not s.undo()
    assert Store(spark, f"file://{tmp_path}/store").read("scanned_paths").count() == 3


def test_the_current_table_is_a_whole_one(spark, tmp_path):
    at = str(tmp_path / "table")
    assert current(spark, at, "k long").count() == 0
    with pytest.raises(FileNotFoundError):
        current(spark, at)
    spark.range(3).write.parquet(f"{at}/0")
    spark.range(1).write.parquet(f"{at}/1")
    (tmp_path / "table" / "1" / "_SUCCESS").unlink()
    assert current(spark, at).count() == 3


def test_cosine_pairs_in_blocks(spark, monkeypatch):
    rows = [(k, [float((k * 7 + k * k) % 5), float(k % 3), 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    other = df.withColumnsRenamed({"id": "j", "embedding": "e"})
    d = F.round(cosine_distance(F.col("embedding"), F.col("e")), 6)
    want = {(r.id, r.j) for r in df.join(other, F.col("id") < F.col("j")).where(d <= 0.1).select("id", "j").collect()}
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 9)
    got = pairs.cosine_within(df, 0.1, 6).collect()
    assert {(r.id1, r.id2) for r in got} == want and len(got) == len(want) > 0
    assert pairs.cosine_within(df.limit(0), 0.1).count() == 0
