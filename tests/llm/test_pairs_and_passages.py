"""The n-gram join and suffix dedup."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plain import components, repeats, same_as_sql, sha, shingle_set
from twinspark.llm import ngram_join, rolling, suffix_dedup


@pytest.mark.parametrize("docs", ["edge", "plain", "small"])
def test_components_are_those_of_all_pairs(docs, request):
    docs = request.getfixturevalue(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())))
    assert got == sorted(map(repr, components(rows)))


@pytest.mark.parametrize("docs", ["edge", "small", "empty"])
def test_join_is_its_sql(docs, request):
    docs = request.getfixturevalue(docs)
    same_as_sql(ngram_join.join(docs).drop("class"), docs, ngram_join.SQL)


@pytest.mark.parametrize("docs", ["plain", "small", "empty"])
def test_suffix_dedup_is_its_sql(docs, request):
    docs = request.getfixturevalue(docs)
    same_as_sql(suffix_dedup.digest(docs), docs, suffix_dedup.SQL)


def _links(rows):
    """(id, words' shingles, linked other rows) of all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    return [(i, len(a), sum(1 for j, b in enumerate(sets) if j != k and a and 100 * len(a & b) >= 75 * len(a | b))) for k, ((i, _), a) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("docs", ["edge", "small"])
def test_links_are_those_of_all_pairs(docs, request):
    docs = request.getfixturevalue(docs)
    want = _links([(r.doc_id, r.text) for r in docs.collect()])
    got = [(r.doc_id, r.n_shingles, r.n_links) for r in ngram_join.join(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(n for *_, n in want)


def test_links_of_a_large_group_are_all_counted(spark, monkeypatch):
    """A group of several blocks with copies, in which not all sets link with each other."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    rows = [(k, " ".join(f"w{i}" for i in range(k // 2 % 40, k // 2 % 40 + 60))) for k in range(90)]
    want = _links(rows)
    assert len({n for *_, n in want}) > 3
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted(want)
    assert {r.component_id for r in got} == {0}


def test_join_of_an_empty_table(empty):
    assert ngram_join.join(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_one_of_each(edge):
    got = ngram_join.one_of_each(edge)
    assert got.columns == edge.columns
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    # The id 4 has two texts of two components, and is the least id of both.
    groups = {(c, t.startswith("another")) for (i, n, c), (_, t) in zip(components(rows), rows) if n}
    worded = [r for r in got.collect() if ngram_join.signature(ngram_join.shingles(r.text)) is not None]
    assert len(worded) == len(groups) and {(r.doc_id, r.text.startswith("another")) for r in worded} == groups
    assert len(got.collect()) - len(worded) == sum(1 for _, n, _ in components(rows) if not n)


def test_one_of_each_with_repeated_and_null_ids_in_a_component(spark):
    """Near copies of one id, and others without any id, are one component each, of which one row stays."""
    text = lambda k, end: " ".join(f"w{k}_{i}" for i in range(60)) + end
    rows = [(1, text(1, "")), (1, text(1, " more")), (2, text(1, " other")), (None, text(2, "")), (None, text(2, " more")), (None, None), (3, "")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(r.doc_id) for r in got if r.text) == ["1", "None"]
    assert len(got) == 4


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    base = rng.poisson(2, (12, 64)).astype(np.uint32)
    points = np.maximum(base[rng.integers(12, size=200)].astype(int) + rng.integers(-1, 2, (200, 64)), 0).astype(np.uint32)
    sizes = points.sum(1).astype(np.int64)
    tree = ngram_join.RTree(points, sizes)
    got = {(i, j) for i, q in tree.pairs(points, sizes, 75) for j in q}
    want = {(i, j) for i in range(200) for j in range(200) if np.minimum(points[i], points[j]).sum() >= ngram_join.need(sizes[i], sizes[j], 75)}
    assert got == want


def _top(n, pairs):
    up = list(range(n))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        up[top(a)] = top(b)
    return [{j for j in range(n) if top(j) == top(i)} for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 2])
def test_connections_reach_every_linked_pair(blocks):
    """Sets of sizes that have points of different numbers of groups, in one block and in two."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    sets = [np.unique(rng.choice(pool[(k % 5) * 600 : (k % 5) * 600 + 600], 200 + 30 * (k % 8) + 200 * (k % 3))) for k in range(60)]
    sizes = np.array([len(s) for s in sets])
    own = rng.integers(blocks, size=60)
    left = np.flatnonzero(own == 0)
    right = left if blocks == 1 else np.flatnonzero(own == 1)
    got = ngram_join.connections(np.arange(60), left, right, sizes, [ngram_join.counts(s) for s in sets], 50)
    assert len(got) < 60
    reach = _top(60, got)
    linked = 0
    for i in left:
        for j in right:
            o = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * o >= 50 * (sizes[i] + sizes[j] - o):
                linked += 1
                assert j in reach[i]
    assert linked > 10


def test_points_bound_the_overlap_when_folded():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:3000], rng.integers(0, 2**40, 900).astype(np.uint64))))
    pa_, pb = ngram_join.counts(a), ngram_join.counts(b)
    g = min(len(pa_), len(pb))
    assert np.minimum(ngram_join.folded(pa_, g), ngram_join.folded(pb, g)).sum() >= len(np.intersect1d(a, b))
    same = np.arange(1, 2000, dtype=np.uint64) << np.uint64(40)  # all in one group
    assert ngram_join.counts(same[:200]).max() < 256


def test_reached():
    link = np.array([[1, 0, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]], bool)
    assert ngram_join.reached(link).tolist() == [0, 1, 1, 3, 0, 5, 1]


def _morse(n, swap=False):
    return "".join("ba"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 8192])
def test_complementary_words_are_no_copies(spark, n):
    """Words that a polynomial modulo 2**64 can't tell apart."""
    rows = [(1, _morse(n)), (2, _morse(n, True)), (3, _morse(n) + " x"), (4, _morse(n, True) + " x"), (5, _morse(n))]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 1, 1)]


def test_large_groups_beside_each_other(spark, monkeypatch):
    """Buckets and components of many blocks, against all pairs."""
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [[f"w{g}_{i}" for i in range(80)] for g in range(3)]
    rows = []
    for k in range(240):
        words = list(base[k % 3])
        for i in rng.integers(80, size=k % 6):
            words[i] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows))
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted(_links(rows))


CLASHING = ["_sig", "_one", "_id", "_of", "_component", "_class", "row", "hash", "sig", "of", "id", "times", "a.b"]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(k, f"some words that stand here for number {k % 3} of three texts", *range(len(CLASHING))) for k in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *CLASHING])
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(rows[:3])
    docs = docs.union(docs.limit(2))
    assert sorted(map(tuple, ngram_join.one_of_each(docs).collect())) == sorted(rows[:3])


def test_a_very_long_text_is_taken_whole(spark):
    """Two texts of some 10 MB that differ at their ends only, a third with nothing of them, and a word of 4 MB."""
    long = " ".join(f"{k * 7919 % 1000003}" for k in range(1_500_000))
    rows = [(1, long + " end"), (2, long + " other end"), (3, " ".join(f"z{k}" for k in range(300_000))), (4, "y" * (4 << 20))]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
    assert {r.doc_id: r.n_shingles for r in got}[1] == 1_000_004


def test_frequent_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    common = "all of these documents begin with the very same words again and again "
    rows = [(k, common * (k % 3) + " ".join(f"w{k % 7}_{i}" for i in range(20 + k % 2))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(ngram_join.frequent(docs))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()) == sorted(components(rows))


@pytest.mark.parametrize("docs", ["plain", "small"])
def test_suffix_dedup_is_the_plain_one(docs, request):
    docs = request.getfixturevalue(docs)
    rows = docs.orderBy("doc_id").collect()
    want = [(r.doc_id, n, gone, spans, sha(kept)) for r, (n, gone, spans, kept) in zip(rows, repeats([r.text for r in rows]))]
    assert sorted(map(tuple, suffix_dedup.digest(docs).collect())) == sorted(want)


def test_suffix_dedup_of_repeated_and_null_ids(edge, empty):
    rows = sorted({(r.doc_id, r.text or "") for r in edge.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = dict(zip(rows, repeats([t for _, t in rows])))
    got = suffix_dedup.dedup(edge).collect()
    assert len(got) == edge.count()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == sorted(repr((i, *want[i, t])) for i, t in ((r.doc_id, r.text or "") for r in edge.collect()))
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
    assert suffix_dedup.digest(empty).count() == 0


def test_cut_texts(edge, empty):
    got = suffix_dedup.cut_texts(edge)
    assert got.columns == edge.columns and got.count() == edge.count()
    by = {r.doc_id: r for r in got.collect()}
    assert "This very passage of more" in by[1].text and "This very passage of more" not in by[2].text
    assert by[6].text == "" and by[6].n_chars == 0 and by[9].text is None
    assert suffix_dedup.cut_texts(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(8, 20))
def test_blocks_decide_as_all_windows_do(texts, length):
    """Rounds 1 to 3 in one process: first places of named positions, blocks and windows."""
    places = []
    data = [t.encode() for t in texts]
    blocks = list(zip(*suffix_dedup.blocks_of(data, length)))
    for k, d in enumerate(data):
        covered = sorted(i for kk, _, _, at, n in blocks if kk == k for i in range(at, at + n))
        assert covered == list(range(max(0, len(d) - length + 1)))
    first = {}
    for k, a, r, at, n in sorted(blocks, key=lambda x: (x[0], x[3])):
        if (a, r) in first:
            places += [(k, i) for i in range(at, at + n)]
        first.setdefault((a, r), (k, at, n))
    by_anchor = {}
    for (a, r), x in first.items():
        by_anchor.setdefault(a, []).append(x)
    seen = set()
    for k, at, n in sorted(x for xs in by_anchor.values() if len(xs) > 1 for x in xs):
        starts, rank = suffix_dedup.windows_of(data[k], np.array([at]), np.array([n]), length)
        for i, r in zip(starts, rank):
            if r in seen:
                places.append((k, int(i)))
            seen.add(r)
    windows, want = set(), set()
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            if t[i : i + length] in windows:
                want.add((k, i))
            windows.add(t[i : i + length])
    assert {(k, int(i)) for k, i in places} == want


def test_stretches_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 103, n).astype(np.uint8).tobytes().decode() for n in (5000, 300, 99, 0, 800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["key", "text"])
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1024)
    monkeypatch.setattr(suffix_dedup, "_AT", np.uint64(4095))
    windows = []
    for held in suffix_dedup._stretches(iter([batch]), 100):
        part, _, _, at, n = suffix_dedup.blocks_of([x[2] for x in held], 100)
        windows += [(held[p][0], held[p][1] + i) for p, a, c in zip(part, at, n) for i in range(a, a + c)]
    assert sorted(windows) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 99)]


@pytest.mark.parametrize("size", [4, 8, 16, 64])
def test_ranks_name_content(size):
    data = bytes(np.random.default_rng(2).integers(97, 99, 400, dtype=np.uint8)) * 2
    lane = rolling.lanes(data)
    at = np.arange(len(data) - size + 1)
    names = {}
    for i, r in zip(at, rolling.rank_at(lane, at, size).tolist()):
        assert names.setdefault(data[i : i + size], r) == r
    assert len(set(names.values())) == len(names)


def test_suffix_dedup_of_odd_texts(spark):
    """Thue-Morse words, runs of one letter, characters of many bytes, passages that overlap, one common line in varied places."""
    line = "a line that many documents share and that alone has more than sixty-four bytes. "
    rows = [(1, _morse(1024)), (2, _morse(1024, True)), (3, _morse(8192)), (4, "a" * 700), (5, "a" * 99), (6, "b" * 100 + "a" * 100), (7, "日本語のテキスト🙂é" * 30), (8, "x" + "日本語のテキスト🙂é" * 9)]
    rows += [(10 + k, " ".join(f"v{k}_{i}" for i in range(20)) + line + " ".join(f"u{k}_{i}" for i in range(20 + k % 3))) for k in range(40)]
    rows += [(60 + k, f"{k}" * 3 + line * 3 + f"{k}" * 5) for k in range(10)]
    want = [(i, n, gone, spans, sha(kept)) for (i, _), (n, gone, spans, kept) in zip(rows, repeats([t for _, t in rows]))]
    assert sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())) == want


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 12 << 20, dtype=np.uint8).tobytes().decode()
    rows = [(1, long), (2, "short " + long[9 << 20 : (9 << 20) + 5000] + " end")]
    got = {r.doc_id: r for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 5000, 1) and got[1].n_bytes == 12 << 20


@pytest.mark.parametrize("change", [suffix_dedup.cut_texts])
def test_cut_texts_keeps_columns_of_any_name(spark, change):
    names = [*CLASHING, "key", "kept", "runs"]
    rows = [(k, "a passage of words that is repeated " * 4, *range(len(names))) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = change(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in got.collect()) == sorted(r[2:] for r in rows)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_passages_with_ids_of_another_type(plain, kind):
    want = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(plain.where("doc_id < 10")).collect()}
    rows = plain.where("doc_id < 10").withColumn("doc_id", F.col("doc_id").cast(kind))
    assert {int(r.doc_id): tuple(r)[1:] for r in suffix_dedup.digest(rows).collect()} == want
    assert suffix_dedup.cut_texts(rows).schema["doc_id"] == rows.schema["doc_id"]
