"""Suffix-array dedup: bytes that stand in a repeated string of ``LENGTH`` bytes go, but for its first place.

Prefix doubling over positions. The rank of a position at length h names its next
h bytes: up to 8 bytes it is these bytes themselves, and at 2h it is the name of
the pair (rank at i, rank at i + h). Names come from the pair's content by mixing,
so equal content has the same rank on every executor, and no rank has to be sent
back before the next offset. Offsets grow from 8 to half of GRAM, the largest power
of two under LENGTH; the last one reaches LENGTH. Offsets under GRAM / 2 need no
exchange, as a text has all bytes that take part. From there on Spark sorts rank
pairs, and positions whose rank is unique drop out:

1. GRAM bytes. A string of LENGTH bytes can repeat only where the ranks at GRAM
   within it repeat. One position for each window is enough: the place of its seed
   (the 8 bytes with the least hash), modulo the number of grams in a window.
   Neighbouring windows mostly name the same position, and equal windows name
   equal ones. Windows whose position has a rank that stands once are unique.
2. Blocks. The windows next to each other that name one position form a block of
   at most LENGTH + LENGTH - GRAM bytes. Pairs (rank at GRAM, rank of the block)
   are sorted: a block that also starts earlier repeats in all its windows. The
   first block of each content goes on if its position's rank also stands in other
   blocks, as part of its windows may repeat.
3. Pairs (rank at i, rank at i + LENGTH - GRAM) of all windows i of these blocks
   are sorted: strings are LENGTH long then, and all but the first place of each
   pair repeat.

Sorting pairs at single bytes for all positions would move some 40 times the input
(a row of 24 bytes for each byte); the README has figures. Places that already
repeat within a batch are marked there and only pass by, and what all blocks of a
frequent position need is aggregated and joined, so no hot passage, line or group
of copies meets in one task. Strings are judged on the input. Two different strings
get one rank with a chance of about 2**-64 a pair.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing;
documents follow each other by id, null first, then by text; rows that repeat
both are one document and get its result; ties (equal passages) are decided by
that order, then by the place in the text; texts of any length are taken whole;
other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.common import dropped, keyed, settled, small_batches, tidy
from twinspark.llm.rolling import lanes, mixed, rank_at, sliding_min

LENGTH = 100
#: Bytes of a seed at most.
SEED = 8
#: Window starts of a very long text that are worked on at once.
STRETCH = 1 << 22
_AT = np.uint64(STRETCH * 4 - 1)


def gram_of(length: int) -> int:
    """The largest power of two under the length."""
    return 1 << ((length - 1).bit_length() - 1)


def blocks_of(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Part, rank of the position, rank of the content, first window and number of windows of all blocks of texts."""
    gram, sizes = gram_of(length), np.array([len(p) for p in parts], np.int64)
    seed, ends = min(SEED, gram), np.cumsum(sizes)
    lane, n = lanes(b"".join(parts)), max(0, int(ends[-1]) - length + 1)
    seeds = mixed(rank_at(lane, slice(n + length - seed), seed))
    least = sliding_min((seeds & ~_AT) | np.arange(len(seeds), dtype=np.uint64), length - seed + 1)[:n] if n else seeds[:0]
    window, part = np.arange(n), np.repeat(np.arange(len(parts)), sizes)[:n]
    named = window + ((least & _AT).astype(np.int64) - window) % (length - gram + 1)
    inside = window + length <= ends[part]
    window, named, part = window[inside], named[inside], part[inside]
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(named) != 0) | (np.diff(part) != 0)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(window)))
    first, named, part = window[start], named[start], part[start]
    content, last = count.astype(np.uint64), first + count - 1 + length - gram
    for k in range(0, 2 * length - gram, gram):
        content = mixed(content ^ rank_at(lane, np.minimum(first + k, last), gram))
    return part, mixed(rank_at(lane, named, gram)), content, first - (ends - sizes)[part], count


def windows_of(data: bytes, first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in the given runs, and the rank of the pair of ranks at each and at the last offset from it."""
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    lane, gram = lanes(data), gram_of(length)
    return at, mixed(mixed(rank_at(lane, at, gram)) ^ rank_at(lane, at + length - gram, gram))


def later_places(rank: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the same rank has an earlier place among these."""
    order = np.lexsort((at, key, rank))
    later = np.zeros(len(rank), bool)
    later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return later


def runs(key: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs next to each other (by key and start) as one."""
    if not len(key):
        return key, at, count
    order = np.lexsort((at, key))
    key, at, count = key[order], at[order], count[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] > at[:-1] + count[:-1])))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(key)])) - 1
    return key[begin], at[begin], at[end] + count[end] - at[begin]


PLACES = "seen boolean, anchor int, rank long, key long, at int, count int"


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """at, count and, where it is there, open of every row's runs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edges, values = column.offsets.to_numpy(), column.values
    fields = [values.field(k).to_numpy(zero_copy_only=False) for k in range(values.type.num_fields)]
    for i, j in zip(edges[:-1], edges[1:]):
        yield tuple(f[i:j].astype(bool if f.dtype == object or f.dtype == bool else np.int64) for f in fields)


def _table(seen: bool, anchor, rank, key, at, count) -> pa.RecordBatch:
    n = len(key)
    cols = [pa.array(np.full(n, seen)), anchor.astype(np.uint32).view(np.int32), rank.view(np.int64), key, at.astype(np.int32), count.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seen", "anchor", "rank", "key", "at", "count"])


def _places(anchor, rank, key, at, count) -> Iterator[pa.RecordBatch]:
    """The first place of each rank in the batch, and runs of places that repeat, spread by key."""
    later = later_places(rank, key, at)
    own = ~later
    yield _table(False, anchor[own], rank[own], key[own], at[own], count[own])
    k, a, c = runs(key[later], at[later], count[later])
    yield _table(True, mixed(k.view(np.uint64)) >> np.uint64(32), np.zeros(len(k), np.uint64), k, a, c)


#: Places of about so many bytes of texts are looked at together, or of so many windows.
GATHER, WINDOWS = 12 << 20, 1 << 19


def _gathered(parts: Iterator[tuple[float, tuple]]) -> Iterator[pa.RecordBatch]:
    """Places of parts whose shares sum up to 1 or more; parts: (share, arrays)."""
    held, size = [], 0.0
    for share, arrays in parts:
        held.append(arrays)
        size += share
        if size >= 1:
            yield from _places(*map(np.concatenate, zip(*held)))
            held, size = [], 0.0
    if held:
        yield from _places(*map(np.concatenate, zip(*held)))


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(key, base, bytes) of whole texts, or of stretches of very long ones, up to about STRETCH bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py().encode()
            for base in range(0, max(0, len(data) - length + 1), STRETCH):
                part = data[base : base + STRETCH + length - 1]
                if held and size + len(part) > STRETCH:
                    yield held
                    held, size = [], 0
                held.append((key, base, part))
                size += len(part)
    if held:
        yield held


def undecided(docs: DataFrame, length: int) -> DataFrame:
    """Rounds 1 and 2: (key, at, count, open) of repeated runs of windows, and of open ones for round 3."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, tuple]]:
        for held in _stretches(batches, length):
            keys, bases = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            part, named, rank, at, count = blocks_of([x[2] for x in held], length)
            yield sum(len(x[2]) for x in held) / GATHER, (named >> np.uint64(32), rank, keys[part], at + bases[part], count)

    places = settled(docs.select("key", "text").mapInArrow(tidy(lambda b: _gathered(parts(b))), PLACES))
    own = places.where(~F.col("seen"))
    often = own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    left = settled(own.join(often, "anchor"))
    others = left.groupBy("anchor").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("anchor", F.lit(True).alias("more"))
    first = F.row_number().over(W.partitionBy("anchor", "rank").orderBy("key", "at")) == 1
    left = left.select("anchor", "key", "at", "count", first.alias("first")).join(others, "anchor", "left")
    left = left.where(~F.col("first") | F.col("more")).select("key", "at", "count", F.col("first").alias("open"))
    found = settled(left.unionByName(places.where("seen").select("key", "at", "count", F.lit(False).alias("open"))))
    dropped(places)
    return found


def repeated_windows(cases: DataFrame, length: int) -> DataFrame:
    """Round 3: (key, at, count) of the repeated windows of open runs."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, tuple]]:
        for batch in batches:
            for key, text, (at, count, open_) in zip(batch.column(0).to_pylist(), batch.column(1), _runs(batch.column(2))):
                if not open_.any():
                    continue
                data, at, count = text.as_py().encode(), at[open_], count[open_]
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) // WINDOWS)) + 1):
                    starts, rank = windows_of(data, at[some], count[some], length)
                    yield len(starts) / WINDOWS, (rank >> np.uint64(32), rank, np.full(len(starts), key, np.int64), starts, np.ones(len(starts), np.int64))

    places = cases.select("key", "text", "runs").mapInArrow(tidy(lambda b: _gathered(parts(b))), PLACES)
    places = places.select("seen", "rank", "key", "at", "count", F.when(F.col("seen"), F.col("key")).otherwise(F.lit(0).cast("long")).alias("salt"))
    first = F.row_number().over(W.partitionBy("rank", "salt", "seen").orderBy("key", "at")) == 1
    return places.withColumn("first", first).where(F.col("seen") | ~F.col("first")).select("key", "at", "count")


def removed(size: int, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which bytes stand in the windows of the runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + count + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cases(docs: DataFrame, length: int, *carry: str) -> tuple[DataFrame, DataFrame]:
    """All rows (key, doc_id, text, row), and (key, text, runs, more) of texts with repeated windows."""
    small_batches(docs.sparkSession)
    one, rows = keyed(docs, *carry)
    found = undecided(one, length)
    grouped = found.groupBy("key").agg(F.collect_list(F.struct("at", "count", "open")).alias("runs"))
    cases = settled(one.join(grouped, "key"))
    dropped(found)
    more = settled(repeated_windows(cases, length)).groupBy("key").agg(F.collect_list(F.struct("at", "count")).alias("more"))
    return rows, cases.join(more, "key", "left")


#: What ``_kept`` can give for a text from what is left of it and the removed [start, end) pairs: name, Arrow type, Spark type.
KEPT = {
    "kept": (lambda rest, spans: rest, pa.binary(), "binary"),
    "kept_text": (lambda rest, spans: rest.decode("utf-8", "ignore"), pa.string(), "string"),
    "kept_sha256": (lambda rest, spans: hashlib.sha256(rest).hexdigest(), pa.string(), "string"),
    "spans": (lambda rest, spans: spans, pa.list_(pa.list_(pa.int64())), "array<array<long>>"),
    "n_removed": (lambda rest, spans: sum(b - a for a, b in spans), pa.int64(), "long"),
    "n_spans": (lambda rest, spans: len(spans), pa.int64(), "long"),
}


def _kept(cases: DataFrame, length: int, *names: str) -> DataFrame:
    """key and what KEPT names, of texts with repeated windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, (at, count, open_), (more_at, more_count) in zip(batch.column(1), _runs(batch.column(2)), _runs(batch.column(3))):
                data = text.as_py().encode()
                gone = removed(len(data), np.concatenate((at[~open_], more_at)), np.concatenate((count[~open_], more_count)), length)
                spans = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2).tolist()
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for col, name in zip(out, names):
                    col.append(KEPT[name][0](rest, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, KEPT[n][1]) for c, n in zip(out, names))], ["key", *names])

    return cases.select("key", "text", "runs", "more").mapInArrow(tidy(work), "key long, " + ", ".join(f"{n} {KEPT[n][2]}" for n in names))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (bytes), spans (removed [start, end) pairs) and counts for every row."""
    rows, cases = _cases(docs, length)
    every = rows.join(_kept(cases, length, "n_removed", "n_spans", "kept", "spans"), "key", "left")
    zero = F.lit(0).cast("long")
    return every.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
    )


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """As ``dedup``, with a hash in place of the kept bytes, so that no whole text is sent to the last join."""
    rows, cases = _cases(docs, length)
    cut = settled(_kept(cases, length, "n_removed", "n_spans", "kept_sha256"))
    base = rows.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    every = base.join(cut, "key", "left")
    return every.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with what is kept as their ``text`` and its size as ``n_chars``, other columns as they were.

    Bytes of characters that are cut in two go as well.
    """
    cols = docs.columns
    rows, cases = _cases(docs, length, *cols)
    cut = _kept(cases, length, "kept_text")
    text = F.coalesce("kept_text", "row.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.join(cut, "key", "left").select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in cols])


#: ``digest`` by grouping all windows of 100 bytes, in hex; texts are cut into overlapping pieces first, as long strings are slow to index.
SQL = """
with d as materialized (select row_number() over (order by doc_id) as rid, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
c as (select rid, start, substr(x, (2 * start + 1)::bigint, 710) as y from d, unnest(range(0, length(x) // 2 - 99, 256)) as u(start)),
w as materialized (select rid * 4294967296 + start + j as place, md5_number(substr(y, (2 * j + 1)::bigint, 200)) as g from c, unnest(range(least(256, length(y) // 2 - 99))) as u(j)),
h as (select g, min(place) as place from w group by g having count(*) > 1),
f as (select w.place // 4294967296 as rid, w.place % 4294967296 as i from w join h using (g) where w.place > h.place),
b as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 100 then 0 else 1 end as fresh from f),
r as (select rid, i, sum(fresh) over (partition by rid order by i) as run from b),
s as (select rid, min(i) as a, max(i) + 100 as z from r group by rid, run),
p as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) as since from s),
k as (select rid, sum(z - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, (2 * since + 1)::bigint, (2 * (a - since))::bigint), '' order by a) || substr(any_value(x), (2 * max(z) + 1)::bigint) as rest from p join d using (rid) group by rid)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, x))) as kept_sha256 from d left join k using (rid)
"""
