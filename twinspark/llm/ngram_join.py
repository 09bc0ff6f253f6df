"""N-gram Jaccard join: near duplicates by word shingles, found with count-vector R-trees.

A text's set are the hashes of its shingles of WORDS words. Equal sets are one from
the start. Two sets with a Jaccard similarity of PERCENT or more share a shingle
among the first of each, in any order that all texts keep: of n shingles the first
n - ceil(n * PERCENT / 100) + 1. Frequent shingles come last in that order. Sets
that share such a shingle stand in a bucket.

1. Sets are points: their shingles are hashed into groups, and the counts are the
   coordinates (about one for SHARE shingles). Summed minima of coordinates bound
   the overlap of two sets from above; for a node of an R-tree, the largest counts
   below it do. In each bucket a tree finds sets whose bound allows a link. Sets
   that are connected in the bucket already aren't compared again, and a bucket
   passes on one connection for each set at most, never its pairs.
2. Whatever is linked lies in one component of these connections. Within such a
   component all different sets are compared whole: its sets are dealt to blocks,
   each two blocks are compared by one task, and each set keeps the number of rows
   that its links lead to, and one connection. No pairs are listed, but comparisons
   grow with the square of a component's different sets.
3. Components of true links are those of the connections of step 2.

Components are found with alternating stars. Hashes of words and shingles are
chained bijective mixings of 64 bits, no polynomials; two different shingles have
equal ones with a chance of about 2**-64.

Joins with all rows are sort-merge joins at every size: what they need has as many
rows as there are documents or near duplicates, so it is never broadcast.

Frequent shingles are counted over all texts in gathered parts; of the list at most
LISTED are sent to the workers. It only orders shingles: it cannot lose a link.

Defined results: a text without words (or null) has an empty set and is its own
component; with fewer words than WORDS, all words are one shingle; a component
without any id that isn't null has a null id; repeated rows get equal results;
ties (equal texts with other ids) are one set; texts of any length are taken
whole; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import SPACES, dropped, settled, small_batches, tidy, whole
from twinspark.llm.rolling import mixed, word_hashes
from twinspark.operators.graph import components

WORDS = 5
PERCENT = 75
#: Shingles for a coordinate of a point.
SHARE = 4
#: Shingles are frequent from one in so many texts on.
FREQUENT = 8192
#: The most frequent shingles that are sent to the workers: 8 bytes each.
LISTED = 1 << 20
#: Sets below a leaf of an R-tree.
LEAF = 16
#: Sets of a bucket that are put into one tree; larger buckets are dealt to blocks.
BUCKET = 2048
GATHER = 16 << 20
#: Texts or points that go to Python at a time.
ROWS = 500
#: Different sets of a component that are compared at once with as many others, and their shingles.
BLOCK, SHINGLES = 512, 1 << 20
#: Shingles that both blocks have, compared at once.
COLUMNS = 1 << 12


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted different shingle hashes of a text."""
    each = word_hashes((text or "").encode().lower())
    if not len(each):
        return np.zeros(0, np.uint64)
    size = min(words, len(each))
    n = len(each) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ each[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray) -> int | None:
    """One number for equal sets; None for the empty one."""
    return int(mixed((mixed(s + np.uint64(1)).sum() + np.uint64(len(s))).reshape(1)).view(np.int64)[0]) if len(s) else None


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def need(a, b, percent: int):
    """The least overlap of sets of these sizes that makes a link: 100 * o >= percent * (a + b - o)."""
    return -(-(a + b) * percent // (100 + percent))


def counts(s: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each group; the number of groups is a power of two."""
    groups = 1 << max(6, (len(s) // share).bit_length() - 1)
    while True:
        out = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if out.max(initial=0) < 256:
            return out.astype(np.uint8)
        groups *= 2


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same set's point with fewer groups."""
    return point.reshape(-1, groups).sum(0, dtype=np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[np.ndarray]]:
    """The different sets of about GATHER bytes at a time."""
    held, size = {}, 0
    for batch in batches:
        for text in batch.column(0):
            s = shingles(text.as_py(), words)
            if len(s) and held.setdefault(signature(s), s) is s:
                size += 8 * len(s) + 64
            if size > 2 * GATHER:
                yield list(held.values())
                held, size = {}, 0
    if held:
        yield list(held.values())


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of shingles that stand in one of FREQUENT texts or more; the LISTED most frequent of them.

    A gathered part reports whatever stands in two texts of it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, words):
            h, n = np.unique(np.concatenate(part), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    least = max(3, docs.count() // FREQUENT)
    got = docs.select("text").mapInArrow(tidy(work), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = got.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    return np.sort(got["h"].to_numpy().view(np.uint64))


def first_shingles(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set: its shingles that aren't frequent come first."""
    late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
    k = prefix_size(len(s), percent)
    rare = s[~late][:k]
    return np.concatenate((rare, s[late][: k - len(rare)]))


def measured(docs: DataFrame, often: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash (of the text), sig and n of every row; first (shingles) and point of a set where a task meets it first."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = sent.value, set()
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            sigs = [signature(s) for s in sets]
            new = []
            for sig in sigs:
                new.append(sig is not None and sig not in seen)
                seen.add(sig)
            if len(seen) > 200_000:
                seen.clear()
            first = [first_shingles(s, often, percent) if one else None for s, one in zip(sets, new)]
            at = np.concatenate(([0], np.cumsum([0 if f is None else len(f) for f in first]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *(f for f in first if f is not None)]).view(np.int64)
            first = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            point = pa.array([counts(s).tobytes() if one else None for s, one in zip(sets, new)], pa.binary())
            cols = [batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), first, point]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "hash", "sig", "n", "first", "point"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(tidy(work), f"doc_id {kind}, hash long, sig long, n long, first array<long>, point binary")


def in_buckets(sets: DataFrame) -> DataFrame:
    """(h, low, high, own, sig, n, point): the different buckets of two or more sets; large ones in blocks, two by two."""
    rows = sets.select("sig", F.explode("first").alias("h"))
    # Many shingles have the same sets; one of them is enough.
    kept = rows.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("sig")).alias("who")).where("members > 1")
    kept = kept.groupBy("members", "who").agg(F.min("h").alias("h"))
    blocks = F.ceil(F.col("members") / BUCKET).cast("int")
    rows = rows.join(kept, "h").select("h", "sig", blocks.alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig")
    return rows.join(sets.select("sig", "n", "point"), "sig").select("h", "low", "high", "own", "sig", "n", "point")


class RTree:
    """Points under boxes; only the upper corner and the least set size of a box are needed."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._node(np.arange(len(sizes)))

    def _node(self, ids: np.ndarray):
        box = self.points[ids].max(0), self.sizes[ids].min()
        if len(ids) <= LEAF:
            return (*box, ids, None)
        below = self.points[ids]
        # Split at the median of the coordinate that spreads most.
        ids = ids[np.argsort(below[:, below.var(0).argmax()], kind="stable")]
        parts = np.array_split(ids, min(8, -(-len(ids) // LEAF)))
        return (*box, None, [self._node(p) for p in parts])

    def pairs(self, points: np.ndarray, sizes: np.ndarray, percent: int, skip=None) -> Iterator[tuple[int, np.ndarray]]:
        """(indexed id, queries that the bound allows with it); skip(id, queries) leaves some out before they are compared."""
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            (top, least, ids, kids), q = stack.pop()
            q = q[np.minimum(points[q], top).sum(1) >= need(sizes[q], least, percent)]
            if not len(q):
                continue
            if kids is not None:
                stack += [(k, q) for k in kids]
                continue
            for i in ids:
                own = q if skip is None else skip(i, q)
                if len(own):
                    yield i, own[np.minimum(points[own], self.points[i]).sum(1) >= need(sizes[own], self.sizes[i], percent)]


def connections(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what the bound allows to link between left and right (indexes), one for a set at most.

    A point is compared with those of as many or more groups, which are folded to its own.
    """
    label, out = np.arange(len(sigs)), []
    groups = np.array([len(p) for p in points])

    def skip(i: int, q: np.ndarray) -> np.ndarray:
        return q[label[asked[q]] != label[indexed[i]]]

    for index, query in ((left, right),) if left is right else ((left, right), (right, left)):
        for g in np.unique(groups[index]):
            indexed = index[groups[index] == g]
            fits = (100 * sizes[query] >= percent * sizes[indexed].min()) & (percent * sizes[query] <= 100 * sizes[indexed].max())
            asked = query[(groups[query] >= g) & fits]
            if not len(asked) or (index is query and len(asked) == 1):
                continue
            tree = RTree(np.stack([points[i] for i in indexed]).astype(np.int32), sizes[indexed])
            for i, q in tree.pairs(np.stack([folded(points[i], g) for i in asked]), sizes[asked], percent, skip):
                for j in asked[q]:
                    a, b = label[indexed[i]], label[j]
                    if a != b:
                        label[label == b] = a
                        out.append((int(sigs[indexed[i]]), int(sigs[j])))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns after the first ``keys`` ones, of rows next to each other that agree in those."""
    now, held = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns)):
                if row[:keys] != now:
                    if held:
                        yield now, list(zip(*held))
                    now, held = row[:keys], []
                held.append(row[keys:])
    if held:
        yield now, list(zip(*held))


def connected(buckets: DataFrame, percent: int) -> DataFrame:
    """Different (a, b) that connect the sets of each bucket as far as the bound allows links; buckets: ``in_buckets``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, low, high), (own, sig, n, point) in _groups(batches, 3):
            if len(sig) > 1:
                own, points = np.array(own), [np.frombuffer(p, np.uint8) for p in point]
                left = np.flatnonzero(own == low)
                right = left if low == high else np.flatnonzero(own == high)
                out += connections(np.array(sig), left, right, np.array(n), points, percent)
            if len(out) > 100_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    rows = buckets.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    found = rows.mapInArrow(tidy(work), "a long, b long")
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right one."""
    a, b = np.concatenate(left), np.concatenate(right)
    if left is right:
        both, n = np.unique(a, return_counts=True)
        both = both[n > 1]
    else:
        both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)))
    sides = []
    for x, each in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(each)), [len(s) for s in each])
        at = np.searchsorted(both, x)
        shared = at < len(both)
        shared[shared] = both[at[shared]] == x[shared]
        order = np.argsort(at[shared], kind="stable")
        sides.append((row[shared][order], at[shared][order]))
    for start in range(0, len(both), COLUMNS):
        size = min(COLUMNS, len(both) - start)
        parts = []
        for (row, at), each in zip(sides, (left, right)):
            i, j = np.searchsorted(at, (start, start + size))
            parts.append(np.zeros((len(each), size), np.float32))
            parts[-1][row[i:j], at[i:j] - start] = 1
        out += parts[0] @ parts[1].T
    if left is right:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def reached(link: np.ndarray) -> np.ndarray:
    """For each row and then each column of a matrix of links, the first of all these that is connected with it."""
    n = link.shape[0]
    out = np.full(n + link.shape[1], -1)
    for start in range(len(out)):
        if out[start] >= 0:
            continue
        out[start] = start
        rows, cols = (np.array([start]), np.zeros(0, int)) if start < n else (np.zeros(0, int), np.array([start - n]))
        while len(rows) or len(cols):
            next_cols = np.flatnonzero(link[rows].any(0) & (out[n:] < 0)) if len(rows) else np.zeros(0, int)
            next_rows = np.flatnonzero(link[:, cols].any(1) & (out[:n] < 0)) if len(cols) else np.zeros(0, int)
            out[n + next_cols], out[next_rows] = start, start
            rows, cols = next_rows, next_cols
    return out


def link_rows(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, links, other): rows with other, linked sets, and a set that is connected with it, for each block it is compared with.

    members: (sig, component, n, rows, hash, of), rows being those of this set, hash and of the text and the doc_id of one of them.
    Texts are joined by both, so copies of a text are spread like other rows.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    blocks = members.groupBy("component").agg(blocks.alias("blocks"))
    wanted = members.join(blocks, "component").select("hash", "of", "sig", "component", "rows", "blocks")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    texts = texts.join(wanted.hint("merge"), (F.col("_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("of")))
    dealt = texts.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig", "rows", "text")
    dealt = dealt.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")

    def compared(low: int, high: int, own: list, sig: list, rows: list, text: list) -> list[tuple[int, int, int]]:
        sig, one = np.unique(np.array(sig), return_index=True)  # rows that repeat id and text come more than once
        own, rows = np.array(own)[one], np.array(rows)[one]
        sets = [shingles(text[i], words) for i in one]
        at = [np.flatnonzero(own == low)]
        at.append(at[0] if low == high else np.flatnonzero(own == high))
        if not len(at[0]) or not len(at[1]):
            return []
        left = [sets[i] for i in at[0]]
        right = left if low == high else [sets[i] for i in at[1]]
        n = np.array([len(s) for s in sets])
        o = overlaps(left, right)
        link = 100 * o >= percent * (n[at[0]][:, None] + n[at[1]] - o)
        top = sig[np.concatenate(at)][reached(link)]
        if low == high:
            np.fill_diagonal(link, False)
            return list(zip(sig[at[0]], link @ rows[at[0]], top))
        return [*zip(sig[at[0]], link @ rows[at[1]], top), *zip(sig[at[1]], rows[at[0]] @ link, top[len(at[0]) :])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), cols in _groups(batches, 3):
            found = np.array(compared(low, high, *cols), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], ["sig", "links", "other"])

    return dealt.mapInArrow(tidy(work), "sig long, links long, other long")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, hash, sig, n), and of each different set (sig) its class, n_links and the least doc_id of the class."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    measure = settled(measured(docs, frequent(docs, words), words, percent), ROWS)
    rows = settled(measure.select("doc_id", "hash", "sig", "n"))
    sets = measure.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"), F.min(F.struct("hash", "doc_id")).alias("at"), F.max("n").alias("n"), F.max("point").alias("point"), F.first(F.when(F.size("first") > 0, F.col("first")), ignorenulls=True).alias("first"))
    points = settled(sets)
    dropped(measure)
    near = settled(connected(in_buckets(points), percent), ROWS)
    sets = settled(points.select("sig", "rows", "least", F.col("at.hash").alias("hash"), F.col("at.doc_id").alias("of"), "n"))
    dropped(points)
    members = settled(sets.join(components(near, settled), sets["sig"] == F.col("id")).drop("id"))
    links = settled(link_rows(docs, members, words, percent), ROWS)
    found = components(links.where("links > 0").select(F.col("sig").alias("src"), F.col("other").alias("dst")), settled)
    several = links.groupBy("sig").agg(F.sum("links").alias("links"))
    found = settled(several.join(found, several["sig"] == F.col("id"), "left").select("sig", "links", F.coalesce("component", "sig").alias("class")))
    named = settled(sets.join(found, "sig", "left").select("sig", "least", F.coalesce("class", "sig").alias("class"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # Only classes of several sets have to look further for their least id.
    least = settled(named.join(found.select("sig"), "sig", "left_semi").groupBy("class").agg(F.min("least").alias("lower")))
    named = named.join(least, "class", "left").select("sig", "class", "n_links", F.least("lower", "least").alias("component_id"))
    return rows, settled(named)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows that it links with) and class (null without words) of every row."""
    rows, named = classes(docs, words, percent)
    id_ = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    links = F.coalesce("n_links", F.lit(0).cast("long"))
    return rows.join(named.hint("merge"), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id"), links.alias("n_links"), "class")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of every component, of those with its least id the first by text; rows without words stay.

    Columns are as they were, whatever their names. Of rows that repeat id and text any one stays.
    """
    rows, named = classes(docs, words, percent)
    worded = rows.join(named.hint("merge"), "sig").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = worded.groupBy("class").agg(F.min(F.struct(F.col("hash"))).alias("at"))
    of = worded.groupBy("class", "doc_id", "hash").agg(F.count(F.lit(1)).alias("times"))
    kept = of.join(first, "class").where(F.col("hash") == F.col("at.hash")).select(F.col("doc_id").alias("id"), F.col("hash").alias("of"), "times")
    kept = settled(kept)
    cols = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    worded = F.length(F.btrim(whole(F.col("row.text")), F.lit(SPACES))) > 0
    # By text and id: copies of a text are spread like other rows, and of each component one meets its row of ``kept``.
    got = every.where(worded).withColumn("hash", F.xxhash64("row.text")).join(kept.hint("merge"), (F.col("hash") == F.col("of")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    once = got.where("times < 2").select("row")
    if not kept.where("times > 1").isEmpty():
        again = got.where("times > 1").groupBy("of", "id").agg(F.first("row").alias("row")).select("row")
        once = once.unionByName(again)
    return once.unionByName(every.where(~worded)).select(*cols)


#: The join by plain counting of common shingles.
SQL = r"""
with recursive t as materialized (select row_number() over (order by doc_id) as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select rid, unnest(ws) as x, unnest(range(len(ws))) as i from t),
g as (select rid, x || ' ' || lead(x, 1) over w || ' ' || lead(x, 2) over w || ' ' || lead(x, 3) over w || ' ' || lead(x, 4) over w as shingle from u window w as (partition by rid order by i)),
s as (select rid, shingle from g where shingle is not null union all select rid, array_to_string(ws, ' ') from t where len(ws) between 1 and 4),
x as materialized (select distinct rid, md5_number(shingle) as shingle from s),
n as materialized (select rid, count(*) as n from x group by rid),
o as (select a.rid as p, b.rid as q, count(*) as c from x a join x b using (shingle) where a.rid < b.rid group by all),
l as (select p, q from o join n a on a.rid = p join n b on b.rid = q where 100 * c >= 75 * (a.n + b.n - c)),
e as (select p, q from l union all select q, p from l),
r as (select rid as p, rid as q from n union select r.p, e.q from r join e on r.q = e.p),
m as (select p as rid, min(doc_id) as least from r join t on t.rid = q group by p),
k as (select p as rid, count(*) as n_links from e group by p)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, doc_id)::bigint as component_id, coalesce(n_links, 0)::bigint as n_links from t left join n using (rid) left join m using (rid) left join k using (rid)
"""
