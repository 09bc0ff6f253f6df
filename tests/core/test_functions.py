"""Hash, vector and path functions against plain versions and golden literals."""

import hashlib
import json
import os
import posixpath

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinspark import schemas
from twinspark.functions import hashes, paths
from twinspark.sources import adapters


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_golden_distances(spark):
    pairs = [("f" * 16, "0" * 16, 64), ("0" * 16, "0" * 15 + "1", 1), ("F" * 16, "f" * 16, 0), ("8" + "0" * 15, "0" * 16, 1), ("abc", "0" * 16, None), (None, "0" * 16, None)]
    got = rows(spark, pairs, "a string, b string, want int").select(hashes.hamming_hex(F.col("a"), F.col("b")).alias("d"), "want").collect()
    assert all(r.d == r.want for r in got)


def test_chunks_are_all_null_or_none(spark):
    got = hashes.with_chunks(rows(spark, [("0001000200ffffff",), ("abc123",), ("zzzzzzzzzzzzzzzz",), ("",), (None,)], "phash string")).collect()
    assert tuple(got[0])[1:] == (1, 2, 255, 65535)
    assert all(tuple(r)[1:] == (None,) * 4 for r in got[1:])


def test_popcount_of_null_is_zero(spark):
    assert [r[0] for r in rows(spark, [(7,), (None,)], "x int").select(hashes.popcount(F.col("x"))).collect()] == [3, 0]


def test_median_hash_is_over_the_lower_median(spark):
    rng = np.random.default_rng(1)
    data = [(k, rng.standard_normal(64).tolist()) for k in range(20)] + [(20, [1.0] * 64), (21, [0.0] * 31 + [1.0] * 33)]
    got = {r.id: r.h for r in rows(spark, data, "id int, v array<double>").select("id", hashes.median_hash(F.col("v")).alias("h")).collect()}
    for k, v in data:
        bits = "".join("1" if x > sorted(v)[31] else "0" for x in v)
        assert got[k] == f"{int(bits, 2):016x}"
    assert bin(int(got[0], 16)).count("1") == 32 and got[20] == "0" * 16


def test_dct_of_images(spark):
    c = hashes.dct_matrix(32)
    assert np.allclose(c @ c.T, np.eye(32))
    x = np.random.default_rng(2).random((32, 32))
    got = np.array(rows(spark, [(x.ravel().tolist(),)], "p array<double>").select(hashes.low_frequencies(F.col("p"))).first()[0])
    assert np.allclose(got.reshape(8, 8), (c @ x @ c.T)[:8, :8])


def test_vectors(spark):
    v = rows(spark, [([3.0, 4.0], [4.0, -3.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    got = v.select(hashes.norm(F.col("a")).alias("n"), hashes.l2_normalised(F.col("a")).alias("u"), hashes.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].n == 5 and np.allclose(got[0].u, [0.6, 0.8]) and abs(got[0].d - 1) < 1e-9 and abs(got[1].d) < 1e-9
    assert hashes.pixel_difference and [r[0] for r in rows(spark, [([1, 5], [4, 2])], "a array<int>, b array<int>").select(hashes.pixel_difference(F.col("a"), F.col("b"))).collect()] == [[3, 3]]


SAMPLES = ["/a/b.txt", "b.txt", "/a/.hidden", "/a/x.tar.gz", "/", "/a/", "", "a/b/..", ".", "..", "/..//x", "a//b/./c", "..a/b", "/a/b/../../..", "../../x", "/a/...", "a/..b.png", "x."]


def test_paths_like_posixpath(spark):
    df = rows(spark, [(s,) for s in SAMPLES], "p string")
    for r in df.select("p", paths.basename(F.col("p")).alias("base"), paths.dirname(F.col("p")).alias("dir"), paths.extension(F.col("p")).alias("ext"), paths.stem(F.col("p")).alias("stem"), paths.normpath(F.col("p")).alias("norm")).collect():
        assert r.base == posixpath.basename(r.p) and r.dir == posixpath.dirname(r.p), r
        assert (r.stem, r.ext) == posixpath.splitext(r.p), r
        assert r.norm == posixpath.normpath(r.p), r


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab./", max_size=12), min_size=5, max_size=30))
def test_normpath_property(spark, samples):
    samples = [s for s in samples if not s.startswith("//")]
    df = rows(spark, [(s,) for s in samples], "p string").select("p", paths.normpath(F.col("p")).alias("n"))
    assert all(r.n == posixpath.normpath(r.p) for r in df.collect())


def test_roots(spark):
    df = rows(spark, [("/src1/a",), ("/src10/a",), ("/SRC1/a",), ("/src1",), ("/src%/a",)], "p string")
    hit = lambda *a, **k: {r.p for r in df.where(paths.in_roots(F.col("p"), *a, **k)).collect()}
    assert hit(["/src1"]) == {"/src1/a", "/src1"}
    assert hit(["/src1/"]) == {"/src1/a"}
    assert hit(["/src1"], case_insensitive=True) == {"/src1/a", "/src1", "/SRC1/a"}
    assert hit(["/src%"]) == {"/src%/a"} and len(hit([])) == 5


def test_segment_diff(spark):
    r = rows(spark, [("/a//b/c", "\\a\\B")], "x string, y string").select(paths.segment_diff(F.col("x"), F.col("y")).alias("d")).first()
    assert [(s["a"], s["b"], s["same"]) for s in r.d] == [("a", "a", True), ("b", "B", False), ("c", None, False)]


def free_one_by_one(wanted, taken):
    """The names as a loop over one name after another would find them."""
    import re

    taken, out, queue = set(taken), [], []
    seen = {}
    for p in sorted(wanted):
        seen[p] = seen.get(p, 0) + 1
        if p not in taken and seen[p] == 1:
            out.append((p, p))
        else:
            base, ext = os.path.splitext(p)
            m = re.search(r"_(\d+)$", base)
            queue.append((base[: m.start()] if m else base, ext, int(m[1]) if m else 0, p, seen[p]))
    used = taken | {n for _, n in out}
    for prefix, ext, n, p, _ in sorted(queue):
        n += 1
        while f"{prefix}_{n}{ext}" in used:
            n += 1
        used.add(f"{prefix}_{n}{ext}")
        out.append((p, f"{prefix}_{n}{ext}"))
    return sorted(out)


def test_free_names(spark):
    wanted = ["/a/x.txt"] * 4 + ["/a/x_3.txt", "/a/x_3.txt", "/a/y.txt", "/a/z_9.png", "/a/noext"]
    taken = ["/a/x.txt", "/a/x_1.txt", "/a/x_4.txt", "/a/x_5.txt", "/a/x_3.txt", "/a/z_9.png", "/a/z_10.png", "/a/noext"]
    got = paths.free_names(rows(spark, [(p,) for p in wanted], "path string"), rows(spark, [(p,) for p in taken], "path string")).collect()
    assert sorted(map(tuple, got)) == free_one_by_one(wanted, taken)
    assert not {n for _, n in map(tuple, got)} & set(taken) and len({n for _, n in map(tuple, got)}) == len(wanted)


def test_display(spark):
    r = rows(spark, [("/a/l.png", "/b/r.png", 640, 480, 1572864, 3.0)], "a string, b string, w int, h int, s long, d double")
    got = r.select(paths.pair_title(F.col("a"), F.col("b")), paths.resolution(F.col("w"), F.col("h")), paths.megabytes(F.col("s")), paths.distance_text(F.col("d")), paths.distance_text(F.lit(None).cast("double")), paths.cluster_title(F.lit("New"), F.lit(3)), paths.thumbnail_key(F.col("a"), 256)).first()
    assert tuple(got) == ("l.png vs r.png", "640 x 480", "1.50 MB", "3.00", "N/A", "New (3 items)", hashlib.md5(b"/a/l.png").hexdigest() + "_256.png")


def test_config(spark):
    text = json.dumps({"device_id": "gpu:1", "batch_sizes": {"clip": 12, "nothing": 3}})
    r = adapters.config(spark, rows(spark, [(text,), ("{}",)], "json string")).collect()
    assert (r[0].device_id, r[0].clip, r[0].phash) == ("gpu:1", 12, 32) and r[1].device_id is None and r[1].clip == 8
    back = rows(spark, [("cpu", {"phash": 123})], "d string, b map<string,int>").select(adapters.config_json(F.col("d"), F.col("b"))).first()[0]
    assert json.loads(back)["batch_sizes"]["phash"] == 123
    assert [x[0] for x in rows(spark, [(0,), (300,), (7,)], "n int").select(adapters.clamped(F.col("n"))).collect()] == [1, 256, 7]
    names = rows(spark, [("MobileNetV3 (Small)",), ("CLIP-DirectML",), ("BLIP",), ("anything",)], "n string").select(adapters.engine_name(F.col("n"))).collect()
    assert [x[0] for x in names] == ["mobilenet", "clip", "blip", "phash"]


def test_unknown_types_are_new_matches(spark):
    got = rows(spark, [("duplicate",), ("phash_match",), (None,)], "t string").select(schemas.relation_type(F.col("t"))).collect()
    assert [r[0] for r in got] == ["duplicate", "new_match", "new_match"]


def test_image_listing(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt", "sub/d.webp", "sub/e.tiff"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    got = adapters.image_listing(spark, [str(tmp_path), str(tmp_path / "sub")], contents=True)
    assert sorted(os.path.relpath(r.path, tmp_path) for r in got.collect()) == ["a.png", "b.JPG", "sub/d.webp"]
    bad = adapters.decoded(got).collect()
    assert len(bad) == 3 and all(r.err for r in bad)
    listing = rows(spark, [(str(p),) for p in tmp_path.rglob("*") if p.is_file()], "path string")
    known = rows(spark, [(str(tmp_path / "a.png"),)], "path string")
    assert tuple(adapters.intake_counts(listing, known).first()) == (3, 1)
    assert adapters.dropped_files(listing, known).count() == 3
