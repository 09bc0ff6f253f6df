"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon has the terms whose document frequency lies in a band of shares of
all documents (a band of inverse document frequencies). As every document of
the mean count of distinct terms, m, adds to m frequencies, at most m / LOW terms
can lie above the lower share at any corpus size. Where more than LARGEST do, the
band ends at a lower frequency: at the highest one up to which there are no more
than that, so that terms of equal frequency are all in or all out. The driver reads
the lexicon and compiles it into the plan.

Subsets of the lexicon are the whole of it and SUBSETS random ones, each term being in
those that PICKS independent draws name: subsets overlap.
Of a text, the distinct terms in the lexicon are sorted, and those of a subset are
hashed together to 64 bits; the fingerprint is the list of the hashes by subset.
Texts without any term of the lexicon get one hash of all their sorted terms.

The likeness of two fingerprints is the number of equal hashes over the number of
subsets that either has, so 1 for equal texts.

Defined results: a null text is empty; documents are ordered by id with null
first, then by the text's hash and the text; of repeated rows (ties) one is the next
of the other; a table of one row has that row as its own next; texts of any length
are taken whole; other columns may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.common import ascii_lower, let, settled, whole, words

LOW, HIGH = 0.005, 0.10
#: Random subsets, and how many of them a term is drawn into.
SUBSETS, PICKS = 64, 2
#: Rows of a bucket of neighbouring ids, about, and buckets at most (their borders stand in the plan).
BUCKET, BUCKETS = 4096, 1 << 16
#: Terms of the lexicon, about at most; the driver reads it and it stands in the plan.
LARGEST = 50_000
#: Numbers of the whole lexicon and of all terms of a text without any of it.
_WHOLE, _ALL = 0, 255


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """Terms with a document frequency in the band; see above for the bound."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words(ascii_lower(whole(F.col("text")))))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = settled(df.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))))
    levels = band.groupBy("df").count().orderBy("df").collect()  # no more than the band has terms
    upto = [r["df"] for r, total in zip(levels, accumulate(r["count"] for r in levels)) if total <= LARGEST or r is levels[0]]
    return sorted(r[0] for r in band.where(F.col("df") <= max(upto, default=0)).select("term").collect())


def fingerprint(text: Column, lex: list[str]) -> Column:
    """Sorted array of (number of the subset, hash of the text's terms in it)."""
    empty = F.array().cast("array<string>")
    code = lambda subset, terms: F.struct(subset.cast("int").alias("subset"), F.xxhash64(terms).alias("hash"))

    def subsets(terms: Column) -> Column:
        kept = F.filter(terms, lambda t: t.isin(lex)) if lex else F.filter(terms, lambda t: F.lit(False))
        everything = F.array(code(F.lit(_ALL), F.sort_array(terms)))
        return let(kept, lambda k: F.when(F.size(k) == 0, everything).otherwise(F.concat(F.array(code(F.lit(_WHOLE), F.sort_array(k))), drawn(k))))

    def drawn(terms: Column) -> Column:
        place = lambda r: lambda t: F.struct((F.pmod(F.xxhash64(t, F.lit(r)), F.lit(SUBSETS)) + 1).cast("int").alias("c"), t.alias("t"))
        pairs = F.sort_array(F.concat(*[F.transform(terms, place(r)) for r in range(PICKS)]))

        def runs(p: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: (k == 0) | (F.get(p, k)["c"] != F.get(p, k - 1)["c"]))
            own = lambda s, x, k: F.transform(F.slice(p, x + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - x), lambda e: e["t"])
            return let(starts, lambda s: F.transform(s, lambda x, k: code(F.get(p, x)["c"], own(s, x, k))))

        return let(pairs, runs)

    return let(F.coalesce(F.array_distinct(words(ascii_lower(whole(text)))), empty), subsets)


def likeness(a: Column, b: Column) -> Column:
    subset = lambda x: x["subset"]
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(F.transform(a, subset), F.transform(b, subset)))


def as_string(fp: Column) -> Column:
    """The bytes of the fingerprint, nine for each subset, in base 64."""
    each = F.transform(fp, lambda x: F.concat(F.lpad(F.hex(x["subset"]), 2, "0"), F.lpad(F.hex(x["hash"]), 16, "0")))
    return F.base64(F.unhex(F.array_join(each, "")))


def bucket_of(id_: Column, borders: list) -> Column:
    """How many of the sorted borders lie below, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(len(borders).bit_length() - 1, -1, -1)])
    sorted_ = F.lit(borders)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_, at + step - 1) < id_, at + step).otherwise(at))


def with_next(docs: DataFrame, lex: list[str] | tuple = ()) -> DataFrame:
    """doc_id, text, fp, next_text and next_fp (fingerprints) in the order of ids; buckets of neighbouring ids are sorted apart.

    The bucket borders are percentiles of the ids, BUCKETS at most; rows without an id are dealt by ranges of the text's
    hash, by which they are sorted. The first rows of the buckets, one for each, close the gaps between them.
    """
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = min(rows.count() // BUCKET, BUCKETS)
    shares = [i / (n + 1) for i in range(1, n + 1)]
    borders = sorted({x for x in (rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), max(10_000, 10 * n))).first()[0] or [] if shares else [])})
    bucket = F.when(F.col("doc_id").isNull(), F.shiftright("hash", 54).cast("int") - 513).otherwise(bucket_of(F.col("doc_id"), borders) if borders else F.lit(0))
    rows = rows.withColumn("bucket", bucket).withColumn("fp", fingerprint(F.col("text"), lex))
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    here = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash", "text")
    first = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("bucket", bucket).groupBy("bucket").agg(F.min(here).alias("first"))
    first = settled(first.select("bucket", F.col("first.text").alias("text")).withColumn("fp", fingerprint(F.col("text"), lex)))
    ring = W.orderBy("bucket")  # of the buckets' numbers alone
    after = first.select("bucket").select("bucket", F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(ring)).alias("after"))
    after = after.join(first.select(F.col("bucket").alias("after"), F.struct("text", "fp").alias("first")), "after").select("bucket", "first")
    rows = rows.withColumn("lead", F.lead(F.struct("text", "fp")).over(order))
    near = F.coalesce("lead", "first")
    return rows.join(after, "bucket", "left").select("doc_id", "bucket", "hash", "text", "fp", near["text"].alias("next_text"), near["fp"].alias("next_fp"))


def compare(docs: DataFrame, lex: list[str] | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to that and to the next text."""
    lex = lexicon(docs) if lex is None else lex
    pairs = with_next(docs, lex)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e, lex).alias("fp"))).alias("e"), "fp", "next_fp")
    return rows.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("e.fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
