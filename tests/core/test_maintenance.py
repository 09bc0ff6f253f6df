import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.functions import hashes
from twinspark.operators.maintenance import Maintenance, statistics
from twinspark.operators.store import Store
from twinspark.plans.scan import JobProgress


def filled(spark, root):
    store = Store(spark, root)
    df = spark.createDataFrame
    store.commit(
        files=df([(k, f"/{k}") for k in range(40)], "id long, path string").repartition(6),
        vector_index_status=df([(f"/{k}", "clip") for k in range(0, 40, 2)], "path string, engine string"),
        cluster_members=df([(k % 7, f"/{k}") for k in range(40)] + [(9, "/none")], "cluster_id long, file_path string"),
        file_relations=df([(k, k + 1) for k in range(45)], "id1 long, id2 long"),
        clusters=df([(k, f"c{k}") for k in range(12)], "id long, name string"),
    )
    return store


def rows_of(store):
    return {t: sorted(map(tuple, store.read(t).collect())) for t in store.tables()}


def test_a_run_that_was_stopped_anywhere_ends_as_one_that_ran_through(spark, tmp_path):
    listing = spark.createDataFrame([(f"/{k}",) for k in range(12)] + [("/0",), ("/new",)], "path string")
    whole, told = filled(spark, f"file://{tmp_path}/whole"), []
    assert Maintenance(whole, listing, lambda percent, step: told.append(percent)).run()
    assert told == sorted(told) and told[0] == 0 and told[-1] == 100
    want = rows_of(whole)
    assert [r[0] for r in want["files"]] == list(range(12)) and len(want["file_relations"]) == 11 and [r[0] for r in want["clusters"]] == list(range(7))
    root = f"file://{tmp_path}/parts"
    filled(spark, root)
    for stop in (1, 2, 4, 3):  # every writer takes some steps, then leaves
        asked = []
        done = Maintenance(Store(spark, root), listing).run(lambda: asked.append(0) or len(asked) > stop)  # noqa: B023
        assert not done
    assert Maintenance(Store(spark, root), listing).run()
    after = Store(spark, root)
    assert rows_of(after) == want and after.note("statistics") == statistics(after)
    assert after.note("statistics")["files"] == {"rows": 12, "files": 1, "bytes": after.files("files")[1]}


def test_the_next_maintenance_begins_anew(spark, tmp_path):
    store = filled(spark, f"file://{tmp_path}/store")
    assert Maintenance(store, store.read("files").where("id < 20")).run()
    assert Maintenance(store, store.read("files").where("id < 10")).run()
    assert store.read("files").count() == 10 and store.note("statistics")["files"]["rows"] == 10
    assert Maintenance(Store(spark, f"file://{tmp_path}/none"), store.read("files")).run()


def test_progress_of_running_jobs(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(0.25)
        return x

    told = []
    with JobProgress(spark, told.append, seconds=0.3, every=0.05):
        spark.range(0, 24, 1, 12).select(slow("id").alias("x")).groupBy((F.col("x") % 3).alias("k")).count().collect()
    assert told == sorted(set(told)) and told[-1] == 100 and any(0 < p < 100 for p in told)
    failed = []
    with pytest.raises(ZeroDivisionError), JobProgress(spark, failed.append):
        raise ZeroDivisionError
    assert 100 not in failed


def test_resampling():
    assert np.allclose(hashes.resampling(5, 5), np.eye(5))
    for n, m in ((3, 7), (9, 4), (1, 5), (6, 1)):
        w = hashes.resampling(n, m)
        assert w.shape == (m, n) and np.allclose(w.sum(1), 1) and np.allclose(w, w[::-1, ::-1])
    assert np.allclose(hashes.resampling(64, 8) @ np.linspace(0, 1, 64), (np.arange(8) + 0.5) / 8, atol=0.02)


def test_images_of_different_size(spark):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 256, (3, 6, 4)), rng.integers(0, 256, (3, 5, 7))
    df = spark.createDataFrame([([x.ravel().tolist() for x in left], [x.ravel().tolist() for x in right])], "l array<array<int>>, r array<array<int>>")
    get = lambda c: [F.get(c, F.lit(k)) for k in range(3)]
    got = df.select(hashes.image_difference(get("l"), get("r"), (6, 4), (5, 7)).alias("x")).first()["x"]
    fitted = np.floor(np.clip(hashes.resampling(5, 6) @ right @ hashes.resampling(7, 4).T, 0, 255) + 0.5)
    apart = np.abs(left - fitted)
    grey = (299 * apart[0] + 587 * apart[1] + 114 * apart[2] + 500) // 1000
    want = (grey - grey.min()) * 255 // (grey.max() - grey.min())
    assert got == want.ravel().astype(int).tolist()
    same = df.select(hashes.image_difference(get("l"), get("l"), (6, 4), (6, 4)).alias("x")).first()["x"]
    assert same == [0] * 24
