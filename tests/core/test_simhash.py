import hashlib

from pyspark.sql import functions as F

from twinspark.functions import hashes
from twinspark.sources import adapters


def plain(text):
    words = {w for w in (text or "").lower().split(" ") if w}
    if not words:
        return None
    numbers = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8]) for w in words]
    return f"{sum(1 << b for b in range(64) if 2 * sum(n >> b & 1 for n in numbers) > len(numbers)):016x}"


def test_hash_of_tokens(spark, monkeypatch):
    texts = ["a b c", "A  b\tc ", "", "   ", None, "x", "b a", "Über über \U0001f642", " ".join(f"w{i}" for i in range(70_000)), "a a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = dict(df.select("id", hashes.token_hash(F.col("text")).alias("h")).collect())
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_texts_of_one_id_count_together(spark):
    rows = [(1, "a b c"), (1, "c d"), (1, None), (2, "a b"), (3, ""), (4, "x y z"), (4, "x y z"), (None, "q"), (None, "r")]
    got = sorted(map(tuple, adapters.simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, plain("a b c d")), (2, plain("a b")), (4, plain("x y z")), (None, plain("q r"))], key=str)
