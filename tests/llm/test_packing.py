import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from twinspark.llm import packing
from twinspark.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


def one_by_one(lengths, size):
    """Best-two-fit, one sequence after another over a list of pieces."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        taken, rest, gap = [], [], size
        for x in left:
            (taken if x <= gap else rest).append(x)
            gap -= x if x <= gap else 0
        if len(taken) > 1 and gap:
            smallest, best = taken[-1], None
            for i in range(len(rest)):
                for j in range(i + 1, len(rest)):
                    if smallest < rest[i] + rest[j] <= gap + smallest:
                        best = max(best or (0,), (rest[i] + rest[j], rest[i], i, j))
            if best:
                taken[-1:] = [rest[best[2]], rest[best[3]]]
                rest = sorted([x for k, x in enumerate(rest) if k not in best[2:]] + [smallest], reverse=True)
        out.append(tuple(sorted(taken, reverse=True)))
        left = rest
    return sorted(out)


def from_patterns(lengths, size):
    found = {}
    for length, first, last, each, offset, sequence in packing.patterns(np.bincount(lengths, minlength=size + 1), size):
        for k in range(last - first):
            found.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    return sorted(tuple(sorted((n for _, n in v), reverse=True)) for v in found.values())


def test_counts_give_what_one_sequence_after_another_gives():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.choice([5, 10, 16, 33, 50])
        lengths = [rng.randrange(1, size + 1) if rng.random() < 0.5 else rng.choice([1, 2, size // 2, size // 3 + 1]) for _ in range(rng.randrange(60))]
        assert from_patterns(lengths, size) == one_by_one(lengths, size)


def test_two_fit_tighter_than_one():
    assert from_patterns([6, 3, 2, 2], 10) == [(3,), (6, 2, 2)]


def check(rows, texts, size):
    """Every piece of every text stands once, gapless, with the library's ids; texts: list of (id, text)."""
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(tuple(sorted((n for _, n in v), reverse=True)) for v in places.values()) == one_by_one([w[3] for w in want], size)


@pytest.mark.parametrize("size", [16, 64])
def test_edge_rows(edge, size):
    rows = packing.pack(edge, TOKENIZER, size, columns=("ids_crc32",)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in edge.collect()], size)


def test_query_over_the_whole_table(spark, small):
    check(QUERIES["op11_packing"](spark, SF).collect(), [(r["doc_id"], r["text"]) for r in small.collect()], packing.SIZE)


def test_long_texts(spark):
    texts = [(1, " " * 1_000_000), (2, "a" * 300_000), (3, "word\n" * 200_000)]
    check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), TOKENIZER, 5000, columns=("ids_crc32",)).collect(), texts, 5000)


def test_ids_as_the_library_has_them():
    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(5)
    letters = [chr(c) for c in [*range(600), *range(0x2000, 0x2070), *range(0x1F600, 0x1F610), 0x3042]] + [" ", "\n", "'s", "'ll", "<|endoftext|>"] * 30
    with open(TOKENIZER, encoding="utf-8") as f:
        encode = packing.encoder(f.read())
    for _ in range(1000):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_sequences_hold_their_ids(plain):
    packed = packing.pack(plain, TOKENIZER, 64).cache()
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(len(s["ids"]) for s in whole.values()) == sum(r["length"] for r in packed.collect())


def test_empty_table_and_text_ids(spark, empty):
    assert packing.pack(empty, TOKENIZER).count() == 0
    named = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["length"]) for r in packing.pack(named, TOKENIZER).collect()) == [("", 1), ("x", 3)]
