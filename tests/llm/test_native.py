"""License scans, quality rules, fingerprints and mixing."""

import base64
import hashlib
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from plain import LOWER, WORD, same_as_sql
from twinspark.llm import fingerprints, licenses, mixing, quality_rules


@pytest.mark.parametrize("docs", ["edge", "empty", "small"])
def test_license_scan_is_its_sql(docs, request):
    docs = request.getfixturevalue(docs)
    same_as_sql(licenses.scan(docs).drop("spans"), docs, licenses.sql())


def test_license_places_and_labels(edge):
    r = licenses.scan(edge).where("doc_id = 10").first()
    assert (r.n_base, r.base_labels) == (3, "apache,cc-by,mit")
    assert r.labels == "apache,apache-2.0,cc-by,cc-by-nc,mit" and r.score == 1.0
    assert (r.first_word, r.last_word) == (3, 13)
    assert [s["label"] for s in r.spans][:2] == ["mit", "apache"]


@pytest.mark.parametrize("docs", ["edge", "empty", "small"])
def test_quality_rules_are_their_sql(docs, request):
    docs = request.getfixturevalue(docs)
    same_as_sql(quality_rules.measure(docs), docs, quality_rules.SQL)


def test_quality_apply_keeps_columns(edge):
    kept = quality_rules.apply(edge)
    assert kept.columns == edge.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 13} & ids == {1, 2} and not ids & {7, 8, 9, 11, 14, 16}


@pytest.mark.parametrize("docs", ["plain", "small"])
def test_edited_texts_and_likeness(docs, request):
    docs = request.getfixturevalue(docs)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
    got = fingerprints.compare(docs).orderBy("doc_id").collect()
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert [r.n_chars for r in got] == [len(t) for t in texts]
    by_text = {}
    for t, r in zip(texts, got):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r, nxt in zip(got, got[1:]):
        assert (r.near_next == 1.0) == (r.fingerprint == nxt.fingerprint)


def spark_hash(*values):
    """Spark's hash of 64 bits: each value's XXH64 is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<i", v), seed=h).intdigest()
    return h


def plain_fingerprint(text, lex):
    terms = sorted(set(WORD.findall((text or "").translate(LOWER))), key=str.encode)
    kept = [t for t in terms if t in lex]
    if not kept:
        return {(255, spark_hash(*terms))}
    subsets = {0: kept}
    for t in kept:
        for r in range(2):
            h = spark_hash(t, r)
            subsets.setdefault(1 + (h - (h >> 63 << 64)) % 64, []).append(t)
    return {(k, spark_hash(*v)) for k, v in subsets.items()}


@pytest.mark.parametrize("docs", ["plain", "small"])
def test_fingerprints_and_likeness_as_a_plain_version_has_them(docs, request):
    docs = request.getfixturevalue(docs)
    lex = fingerprints.lexicon(docs)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])]
    as_bytes = lambda fp: b"".join(bytes([k]) + h.to_bytes(8, "big") for k, h in sorted(fp))
    like = lambda a, b: len(a & b) / len({k for k, _ in a | b})
    mine, theirs = [plain_fingerprint(t, set(lex)) for t in texts], [plain_fingerprint(t, set(lex)) for t in edited]
    for k, r in enumerate(fingerprints.compare(docs, lex).orderBy("doc_id").collect()):
        assert base64.b64decode(r.fingerprint) == as_bytes(mine[k]) and base64.b64decode(r.edited_fingerprint) == as_bytes(theirs[k])
        assert r.near_edited == like(mine[k], theirs[k]) and r.near_next == like(mine[k], mine[(k + 1) % len(texts)])


def test_a_band_of_too_many_terms_ends_at_a_lower_frequency(small, monkeypatch):
    df = Counter(t for r in small.collect() for t in set(WORD.findall((r.text or "").translate(LOWER))))
    whole = fingerprints.lexicon(small, 0.01, 0.5)
    monkeypatch.setattr(fingerprints, "LARGEST", 3 * len(whole) // 4)
    part = fingerprints.lexicon(small, 0.01, 0.5)
    top = max(df[t] for t in part)
    assert 0 < len(part) <= 3 * len(whole) // 4 and set(part) == {t for t in whole if df[t] <= top}
    assert len([t for t in whole if df[t] <= min(df[t] for t in whole if df[t] > top)]) > 3 * len(whole) // 4


def test_fingerprints_of_odd_tables(edge, empty, spark):
    assert fingerprints.compare(edge).count() == edge.count()
    assert fingerprints.compare(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert fingerprints.compare(one).first().near_next == 1.0


def test_ids_in_buckets_have_the_same_next(small, monkeypatch):
    want = {r.doc_id: r.next_text for r in fingerprints.with_next(small).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET", 20)
    got = fingerprints.with_next(small)
    assert got.select("bucket").distinct().count() > 3
    assert {r.doc_id: r.next_text for r in got.collect()} == want


def test_lexicon_is_the_band(small):
    n, lex = small.count(), set(fingerprints.lexicon(small, 0.02, 0.1))
    df = {}
    for r in small.collect():
        for w in set(r.text.lower().split()) if r.text.isascii() else ():
            df[w] = df.get(w, 0) + 1
    assert lex and all(df.get(w, 0) <= 0.1 * n for w in lex)


@pytest.mark.parametrize("docs", ["edge", "plain", "small"])
def test_mix_meets_targets(docs, request):
    docs = request.getfixturevalue(docs)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    target, free, left = {}, set(by), float(total)
    while free:  # shares by weight until none is above its cap
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    for s, own in by.items():
        assert own[0].source_size == size[s] and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_mix_agrees_when_rerun_and_reordered(small):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixing.mix(small)) == key(mixing.mix(small.repartition(7)))


def test_mix_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 9 as int))").alias("text"), F.expr("if(id < 400, 'hot', 'cold')").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.count("*").alias("n")).collect()
    assert sorted(r.n for r in got) == [100, 400]
    assert all(abs(r.t - r.x) <= 4.5 for r in got)


def test_resample(edge, empty):
    want = {}
    for r in mixing.mix(edge).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = mixing.resample(edge)
    assert got.columns == edge.columns
    have = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert have == {k: n for k, n in want.items() if n}
    assert mixing.resample(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_borders_are_searched(spark):
    borders = [3, 5, 5000, 70000, 70001]
    rows = spark.createDataFrame([(k,) for k in (0, 3, 4, 5, 6, 5000, 5001, 70001, 70002, 10**9)], "k long")
    got = [r[0] for r in rows.select(fingerprints.bucket_of(F.col("k"), borders)).collect()]
    assert got == [sum(b < r.k for b in borders) for r in rows.collect()]


@pytest.mark.parametrize("bucket", [1, 3])
def test_next_documents_of_many_buckets(plain, edge, bucket, monkeypatch):
    """The edited texts of all rows against a plain loop, with borders between nearly all rows, and rows without ids."""
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    rows = sorted(((r.doc_id, r.text or "") for r in plain.collect()))
    want = {}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in fingerprints.compare(plain).collect()} == want
    assert fingerprints.compare(edge).count() == edge.count()


def test_repeated_rows_are_spread_over_blocks(spark):
    """Thousands of copies of a row are numbered, so no block has more than some multiples of its size."""
    docs = spark.createDataFrame([(1, "a b c", "x")] * 3000 + [(k, "d e f g", "y") for k in range(50)], "doc_id long, text string, source string").repartition(7)
    rows = mixing.rows_of(docs, "doc_id")
    got = mixing.numbered(rows.select("rid", "key", "source", "size")).collect()
    assert sorted(r.copy for r in got if r.source == "x") == list(range(3000)) and {r.copy for r in got if r.source == "y"} == {0}
    first = mixing.mix(docs)
    sums = {r.source: (r.taken, r.target) for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(taken - target) <= 4 for taken, target in sums.values())
