"""Steps that the queries on near pairs share: the join by blocks, pairs of copies, scans and what reads them."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from twinspark.engines import Engine
from twinspark.functions import hashes
from twinspark.operators import graph, pairs
from twinspark.plans import kept_up
from twinspark.plans import queries as core
from twinspark.plans.scan import Scan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KNOWN = "id long, path string, phash string, phash_c1 int, phash_c2 int, phash_c3 int, phash_c4 int, last_modified double"


def test_blocks_are_sorted_by_one_number(spark):
    h = spark.createDataFrame([(v,) for v in range(100)], "x long")
    plan = pairs.blocks_meet(pairs.near_rows(h, 5), pairs.block_rows(h, 5), 5)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    assert len(keys) == 1 and "," not in keys[0]


@pytest.mark.parametrize("t", [3, 5, 7, 9])
def test_pairs_of_hashes_in_parts(spark, monkeypatch, t):
    monkeypatch.setattr(pairs, "COPIES", 4, raising=False)
    rng = random.Random(t)
    some = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1, 1 << 63]
    some += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in some for k in (1, 3, 5, 7, 9)]
    values = some + [some[0]] * 20 + [some[7]] * 11
    files = hashes.with_chunks(spark.createDataFrame([(i, f"{v:016x}" if i % 2 else f"{v:016X}") for i, v in enumerate(values)] + [(900, None), (901, "")], "id long, phash string"))
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= t)
    assert sorted(map(tuple, pairs.hamming_join(files, t).collect())) == want


def test_pairs_of_one_key_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "COPIES", 20, raising=False)
    files = hashes.with_chunks(spark.createDataFrame([(i, "00ff00ff00ff00ff") for i in range(200)], "id long, phash string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (pairs.exact_pairs(files), pairs.hamming_join(files, 5)):
            made = found.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r[1] for r in made) == 199 * 100 and max(r[1] for r in made) < 199 * 75
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_related_joins_hashes_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "components", lambda e, keep: seen.append(e._jdf.queryExecution().optimizedPlan().toString()) or e)
    core.components_related(spark, SF)
    assert "bit_count" not in seen[0]  # the near pairs are read, not made for positive and for negative edges


def test_annotated_pairs_are_not_exchanged(spark):
    plan = core.annotate_pair(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.rindex("Generate explode(b")] if "Generate explode(b" in plan else plan
    assert "Exchange" not in above and "Join" not in above


def test_annotate_of_repeated_ids_and_labels(spark, tmp_path):
    """Pairs of one hash and of near ones whose ids or labels come several times, against the SQL."""
    near = " ".join(f"w{i}" for i in range(400))
    texts = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (2, "a b c"), (2, "a b c"), (3, "a b c"), (4, "a b c"), (5, near), (5, near), (6, near + " x"), (7, near + " y"), (8, ""), (9, None), (10, near), (None, "a b c")]
    rows = [(i, t, "en", f"src{k}", k) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 0), (5, 1, 0), (5, 1, 0), (6, 0, 1), (8, 1, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cur = con.execute(core.SQL["annotate_pair"])
    names, want = [c[0] for c in cur.description], sorted(cur.fetchall(), key=repr)
    got = core.annotate_pair(spark, str(tmp_path)).select(*names).collect()
    assert {0, None} < {r[names.index("distance")] for r in want} and sorted(map(tuple, got), key=repr) == want


def test_smart_resolve_of_a_repeated_id(spark, tmp_path):
    rows = [(1, "a b c", "en", "src1", 5), (1, "a b c", "en", "src1", 7), (2, "a b c", "en", "src2", 6), (3, "x y", "de", "src1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(core.SQL["smart_resolve_size"])
    names, want = [c[0] for c in cur.description], sorted(cur.fetchall(), key=repr)
    got = core.smart_resolve_size(spark, str(tmp_path)).select(*names).collect()
    assert len(want) == 4 and sorted(map(tuple, got), key=repr) == want


def test_a_scan_fingerprints_a_file_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(h):
        seen.add(1)
        return h

    engine = Engine("phash", lambda stale: stale.select("path", counted.asNondeterministic()("h").alias("phash"), "last_modified"), lambda df, t: pairs.hamming_join(df, int(t)))
    listing = spark.createDataFrame([(f"/a/{i}", 1.0, "00ff00ff00ff00ff") for i in range(4)], "path string, last_modified double, h string")
    known = spark.createDataFrame([(1, "/a/0", None, None, None, None, None, 0.0), (2, "/a/1", None, None, None, None, None, 0.0)], KNOWN)
    assert Scan(engine, ["/a"], 5).run(listing, known).count() == 6
    assert seen.value == 4


def test_images_are_listed_without_pixels(spark, monkeypatch):
    seen, run = [], Scan.run
    monkeypatch.setattr(Scan, "run", lambda self, listing, known: seen.append(listing.columns) or run(self, listing, known))
    kept_up.scan_images(spark, SF)
    assert seen and "pixels" not in seen[0]
