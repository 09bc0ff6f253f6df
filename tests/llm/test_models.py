"""Models that are trained here, and BPE."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from twinspark.llm import bpe, class_lm, language_id, quality_gam, rolling
from twinspark.llm.common import fold
from twinspark.llm.queries import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")
KEEP = lambda c: ~fold(c, 3, 1)


def test_base_score_and_counts(small):
    learn = ~fold(F.col("doc_id"), 7, 2)
    scorer, counts, total, different = class_lm.fit(small, learn)
    got = {r.doc_id: r for r in class_lm.score(small, scorer, counts, total, different).collect()}
    rows = [(r.doc_id, r.text) for r in small.collect()]
    c = Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2 for w in class_lm.tokens(t))
    n, v = sum(c.values()), len(c)
    assert (total, different) == (n, v)
    better = 0
    for k, t in rows:
        own = class_lm.tokens(t)
        assert got[k].n_tokens == len(own) and got[k].n_known == sum(w in c for w in own)
        assert got[k].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        better += got[k].score > got[k].base_score
    assert better > 0.9 * len(rows)


def test_lm_of_odd_tables(edge, empty):
    for docs in (edge, empty):
        got = class_lm.score(docs, *class_lm.fit(docs, F.lit(True))).collect()
        assert len(got) == docs.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    scorer, counts, total, different = class_lm.fit(empty, F.lit(True))
    assert (total, different) == (0, 0)
    assert all(r.n_known == 0 for r in class_lm.score(edge, scorer, counts, total, different).collect())


def test_rare_words_are_joined(small, monkeypatch):
    want = {r.doc_id: (r.n_known, r.base_score) for r in class_lm.score(small, *class_lm.fit(small, F.lit(True))).collect()}
    monkeypatch.setattr(class_lm, "SHARE", 0.001)
    got = {r.doc_id: (r.n_known, r.base_score) for r in class_lm.score(small, *class_lm.fit(small, F.lit(True))).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((12, 12))
    for a in range(12):
        for b in range(12):
            pairs[a, b] = rng.poisson(50 if (a % 3 + 1) % 3 == b % 3 else 1)
    at = class_lm.exchange(pairs, classes=3)
    assert all(len({at[k] for k in range(c, 12, 3)}) == 1 for c in range(3)) and len(set(at)) == 3


def _two_kinds(spark):
    """Words of two kinds that are spelled alike and take turns, beside frequent words that show the turns."""
    rng = np.random.default_rng(4)
    kinds = [[f"{c}word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)] for c in "pq"]
    texts = [" ".join(w for _ in range(25) for w in ("the", kinds[0][rng.integers(40)], "of", kinds[1][rng.integers(40)])) for _ in range(80)]
    return kinds, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_beyond_the_seeds_have_classes_of_their_own(spark, monkeypatch):
    """All 80 words have one spelling form, and only "the", "of" and the end are seeds."""
    monkeypatch.setattr(class_lm, "ITEMS", 3)
    kinds, docs = _two_kinds(spark)
    assert len({class_lm.form(w.encode()) for k in kinds for w in k}) == 1
    scorer, *_ = class_lm.fit(docs, F.lit(True), 5)
    p, q = (Counter(class_lm.classes_of(scorer, k)).most_common(1)[0] for k in kinds)
    assert p[0] != q[0] and min(p[1], q[1]) >= 36


def test_a_step_takes_the_best_of_all_classes(small):
    words = [w for w, _ in Counter(w for r in small.collect() for w in class_lm.tokens(r.text)).most_common(60)]
    pairs = class_lm.bigrams(small, class_lm.keys(words))
    items = {w: k for k, w in enumerate(words)}
    want = np.zeros_like(pairs)
    for r in small.collect():
        own = [items.get(w, len(words) + class_lm.form(w)) for w in class_lm.tokens(r.text)]
        for a, b in zip([items[class_lm.END], *own], own):
            want[a, b] += 1
    assert (pairs == want).all()
    at = class_lm.exchange(pairs, 6, 1)
    member = np.eye(6)[at]
    table, after, before = member.T @ pairs @ member, pairs @ member, pairs.T @ member
    for w in np.flatnonzero(pairs.sum(0) > 0)[:25]:
        own, right, left = pairs[w, w], after[w].copy(), before[w].copy()
        right[at[w]] -= own
        left[at[w]] -= own
        got = class_lm.step(table.copy(), table.sum(0), at[w], right, left, own, pairs[:, w].sum())

        def value(c):
            m = np.eye(6)[np.where(np.arange(len(at)) == w, c, at)]
            return class_lm.likelihood(m.T @ pairs @ m)

        assert value(got) == pytest.approx(max(map(value, range(6))), abs=1e-6)


def test_lookup_of_hashes():
    rng = np.random.default_rng(7)
    keys = np.unique(np.concatenate((rng.integers(0, 2**63, 3000).astype(np.uint64), np.arange(500, dtype=np.uint64) << np.uint64(20))))
    asked = np.concatenate((keys[::-1], keys + np.uint64(1)))
    want = {int(k): i for i, k in enumerate(keys)}
    assert rolling.Lookup(keys).of(asked).tolist() == [want.get(int(k), -1) for k in asked]
    assert rolling.Lookup(keys[:0]).of(asked).max() == -1


def test_class_part_is_a_distribution_of_classes(small):
    scorer, *_ = class_lm.fit(small, F.lit(True))
    assert np.isfinite(scorer.class_part).all() and (scorer.class_part < 0).all()


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    net = language_id.fit(docs, KEEP)
    got = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id"), 3, 1))
    right, n = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert right >= 0.97 * n


def test_gradients_by_differences():
    net = language_id.Network(["a", "b"])
    words, lang = [b" abc ", b" xy "], np.array([0, 1])
    data, size = language_id.pack(words)

    def loss():
        p, _, mask = net.labels(data, size)
        return -np.log(p[..., [0, 1]][np.arange(len(data))[:, None], np.arange(2)[None], lang[None, :]][mask]).mean()

    before = {k: net.ways[1].p[k].copy() for k in ("zr", "c", "x", "b")}
    state = {}
    base = loss()
    net.learn(words, lang, state, 1, 0.0)
    for name in before:
        m, _ = state[name, id(net.ways[1].p)]
        grad = m / 0.1
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        net.ways[1].p[name][at] += 1e-2
        assert (loss() - base) / 1e-2 == pytest.approx(grad[at], rel=0.15, abs=2e-3)
        net.ways[1].p[name][at] -= 1e-2


def test_language_of_odd_tables(edge, empty, spark):
    net = language_id.fit(edge, KEEP)
    got = {r.doc_id: r for r in language_id.predict(edge, net).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (7, 8, 9, 16))
    assert got[13].lang_pred in ("en", "fr") and 0 < got[13].score <= 1
    assert language_id.fit(empty, KEEP) is None
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}
    assert language_id.predict(empty, net).count() == 0


def test_memory_changes_no_label(small, monkeypatch):
    net = language_id.fit(small, KEEP, 100)
    texts = [r.text for r in small.limit(40).collect()]
    want = net.pooled(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 10)
    assert np.allclose(np.concatenate([net.pooled(texts[i : i + 7]) for i in range(0, 40, 7)]), want, atol=1e-5)


def test_quality_of_held_out_texts(spark):
    at = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit(docs, labels, "quality", KEEP)
    got = quality_gam.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), 3, 1))
    right, n = got.agg(F.count_if((F.col("score") >= 0.5).cast("int") == F.col("quality")), F.count("*")).first()
    assert right >= 0.95 * n


def test_quality_of_odd_tables(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (None, 1)], "doc_id long, quality int")
    for lab in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality_gam.score(edge, quality_gam.fit(edge, lab, "quality", lambda c: F.lit(True))).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score(empty, quality_gam.fit(empty, labels, "quality", KEEP)).count() == 0


def test_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(5)
    x = rng.random((800, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.Model(x, y)
    assert (((model.score(x) >= 0.5) == y).mean()) > 0.9 and (1, 0) in model.pairs


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("docs", ["edge", "small"])
def test_bpe_is_the_library(docs, request, library):
    docs = request.getfixturevalue(docs)
    cols = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = sorted(bpe.encode(docs, TOKENIZER, cols).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.ids_sha256))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), ids, library.decode(ids, skip_special_tokens=False), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    want.sort(key=lambda w: (w[0] is None, w[0], w[4]))
    assert [(r.doc_id, r.n_tokens, list(r.ids), r.decoded, r.ids_sha256) for r in got] == want
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)


def test_bpe_of_odd_strings(library, empty):
    with open(TOKENIZER, encoding="utf-8") as f:
        v = bpe.Vocabulary(json.load(f))
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab cdethions'.,\n\t 12é \x1c\x85"), 200)) for _ in range(200)]
    texts += ["".join(f"{chr(c)} {chr(c)}1" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 256)]
    for t in [*texts, "a" * 3000, " " * 500 + "x", "<|endoftext|><|endoftext", "'s 'LL don't"]:
        assert v.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert v.decode(v.encode(t)).decode() == t
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_last_tokens_are_those_of_every_prefix():
    with open(TOKENIZER, encoding="utf-8") as f:
        v = bpe.Vocabulary(json.load(f))
    for piece in (b"unbelievably", b" hippopotamus", b"aaaaaaa", "straße".encode()):
        assert v.last_tokens(piece) == [v.merged(piece[: i + 1])[-1] for i in range(len(piece))]


def test_scores_are_those_of_a_plain_version(small, monkeypatch):
    """The class part token by token, from the classes, the counts and the fitted tables."""
    monkeypatch.setattr(class_lm, "SHARE", 1e-4)
    learn = F.col("doc_id") % 3 != 0
    scorer, _, total, different = class_lm.fit(small, learn, 6)
    rows = [(r.doc_id, class_lm.tokens(r.text)) for r in small.collect()]
    count = Counter(w for k, t in rows if k % 3 for w in t)
    names = sorted({w for _, t in rows for w in t if w != class_lm.END})
    cls = dict(zip(names, class_lm.classes_of(scorer, [w.decode() for w in names])))
    cls[class_lm.END] = int(scorer.classes.of(class_lm.Words([b""]))[0])
    table = np.zeros((6, 6))
    for _, t in (r for r in rows if r[0] % 3):
        for a, b in zip([class_lm.END, *t], t):
            table[cls[a], cls[b]] += 1
    share = (table.sum(0) + 1) / (table.sum() + 6)
    move = (table + class_lm.SMOOTH * share) / (table.sum(1, keepdims=True) + class_lm.SMOOTH)
    n, v = np.zeros(6), np.zeros(6)
    for w, k in count.items():
        n[cls[w]] += k
        v[cls[w]] += 1
    outside = 1 / (total + different + 1)
    part = 10**scorer.class_part
    mix = (part[0, 0] - outside) / (move[0, 0] / (n[0] + v[0] + 1) - outside)
    assert 0.001 <= mix <= 0.999
    want = {i: sum(np.log10(count[b] + 1) + np.log10(mix * move[cls[a], cls[b]] / (n[cls[b]] + v[cls[b]] + 1) + (1 - mix) * outside) for a, b in zip([class_lm.END, *t], t)) for i, t in rows}
    got = {r.doc_id: r.score for r in class_lm.score(small, scorer, *class_lm.fit(small, learn, 6)[1:]).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "BPE", "byte_fallback": True}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}])
def test_other_tokenizer_files_are_refused(change):
    plain = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []}
    assert bpe.checked(plain) is plain
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.checked(plain | change)
