import duckdb

import corpus_pipeline as P
from conftest import SF
from plain import components, repeats, sha
from twinspark.llm import quality_rules
from twinspark.llm.common import settled


def test_stages_against_plain_versions(spark, small):
    stages = dict(P.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    documents = small.toArrow()  # noqa: F841 - read by DuckDB
    kept = {r[0] for r in duckdb.sql(f"select doc_id from ({quality_rules.SQL}) where kept").fetchall()}
    docs = settled(stages["quality rules"](spark, small, SF))
    assert docs.columns == small.columns and {r.doc_id for r in docs.collect()} == kept

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    one = {i for i, n, c in components(rows) if not n or c == i}
    docs = settled(stages["n-gram Jaccard join"](spark, docs, SF))
    assert docs.columns == small.columns and sorted(r.doc_id for r in docs.collect()) == sorted(one)

    rows = docs.orderBy("doc_id").collect()
    want = {r.doc_id: x[3].decode("utf-8", "ignore") for r, x in zip(rows, repeats([r.text for r in rows]))}
    docs = settled(stages["suffix-array dedup"](spark, docs, SF))
    assert docs.columns == small.columns and {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    before = {r.doc_id: r for r in docs.collect()}
    docs = settled(stages["mixing sources to target weights"](spark, docs, SF))
    assert docs.columns == small.columns
    times = {}
    for r in docs.collect():
        assert r == before[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and not any(before[k].text.strip() == "" for k in times)

    out = stages["BPE encoding and decoding"](spark, docs, SF).collect()
    assert len(out) == sum(times.values())
    assert all(r.decoded_sha256 == sha(before[r.doc_id].text.encode()) and len(r.ids) == r.n_tokens for r in out)


def test_run_is_its_stages(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert P.ORACLE_SQL is None


def test_empty_documents(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_go_through_all_stages(spark, edge):
    """Nulls, empty and blank texts, a long one, ties, repeated rows and ids, and columns with names that the stages use."""
    docs, seen = edge, []
    for name, stage in P.STAGES[:-1]:
        docs = settled(stage(spark, docs, SF))
        assert docs.columns == edge.columns and docs.dtypes == edge.dtypes, name
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    good, one, cut, mixed = seen
    assert {i for i, _ in good} >= {1, 2, 3, 4, 5, 6, None} and not {7, 8, 9, 11, 14, 16} & {i for i, _ in good}
    assert len([x for x in good if x[0] == 3]) == 3 and len([x for x in one if x[0] == 3]) == 1  # a repeated row
    assert sorted(map(str, {i for i, _ in one})) == sorted(map(str, {i for i, n, c in components(good) if c == i or i is None}))
    assert len(cut) == len(one) and sum(len(t) for _, t in cut) < sum(len(t) for _, t in one)
    assert set(mixed) <= set(cut) and mixed
    out = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(map(str, (r.decoded_sha256 for r in out))) == sorted(sha(t.encode()) for _, t in mixed)
