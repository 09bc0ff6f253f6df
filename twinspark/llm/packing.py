"""Best-two-fit packing of documents into sequences of a bounded number of tokens.

A sequence is filled greedily, the longest piece that fits first. Then the
smallest of its pieces gives way to two unpacked ones if these fit the gap, with
its room added, more tightly; of such pairs the one of most tokens, then the one
with the longest piece.

Only the lengths decide that, so it is worked out on the number of pieces of each
length: ``size`` numbers, whatever the corpus. A sequence that the counts allow
again is taken as often as every choice in it would be the same (``patterns``),
which gives what packing one sequence after another gives. Spark encodes the
texts, numbers the pieces of each length and looks up each piece's place by its
number; pieces are neither gathered in one task nor sorted, and a hot length is
spread like any other.

Numbers of pieces: each task counts those of a length that it writes; the table of
these counts, by length and task, is summed along the tasks and joined back.

Defined results: a null text is an empty one, whose ids are the end mark alone;
only texts of more than ``size`` tokens are cut, and all their pieces but the
first are full; repeated rows and null ids are documents of their own; a text of
any length is encoded whole; other columns, of whatever name, are not read; an
empty table gives an empty result. Pieces of equal length are numbered as they
are read, so which of them shares a sequence with which may differ between runs;
the number of sequences and their lengths do not.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.bpe import PIECES, byte_alphabet, checked, vocabulary
from twinspark.llm.common import settled, small_batches, tidy

#: Tokens of a sequence, and the id that ends every document.
SIZE, END = 2048, 0
#: Texts whose pieces are sent back at once.
TOGETHER = 200

#: What ``pieces`` can give for a piece.
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32)),
    "ids_crc32": ("long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes())),
}


@cache
def _encoding(spec: str) -> tiktoken.Encoding:
    model = checked(json.loads(spec))
    vocab, to_byte = model["model"]["vocab"], byte_alphabet()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("ids must be in the order of the merges")
    ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items() if all(c in to_byte for c in s)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks={b: i for b, i in ranks.items() if i not in special.values()}, special_tokens=special)


def encoder(spec: str):
    """A function from a text to its ids in the byte-level BPE whose file has the text ``spec``; special tokens in a text are themselves."""
    encoding, key = _encoding(spec), hashlib.sha256(spec.encode()).hexdigest()

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern gives up on some hundred thousand spaces in a row
            return np.array(vocabulary(key, spec).encode(text), np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, piece, start, length, the named columns of COLUMNS; task and number: the piece's number, from 0, among those of its length in its task."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met, task = encoder(sent.value), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            rows, cols = [], [[] for _ in columns]
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                borders = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for piece, (start, stop) in enumerate(zip(borders, borders[1:])):
                    rows.append((k, piece, start, stop - start, met[stop - start]))
                    met[stop - start] += 1
                    for col, name in zip(cols, columns):
                        col.append(COLUMNS[name][2](ids[start:stop]))
            at, piece, start, length, number = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), *(pa.array(c, COLUMNS[n][1]) for c, n in zip(cols, columns)), pa.array(np.full(len(at), task)), pa.array(number)],
                ["doc_id", "piece", "start", "length", *columns, "task", "number"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", {c} {COLUMNS[c][0]}" for c in columns)
    return docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {doc_id}, piece int, start long, length long{kinds}, task long, number long")


def _filled(left: np.ndarray, size: int) -> tuple[dict[int, int], dict[int, int]]:
    """One sequence from the pieces left of each length: how many of each length it takes, and how many were in hand on the way."""
    take: dict[int, int] = {}
    there, gap = np.flatnonzero(left), size
    while (k := int(np.searchsorted(there, gap, "right"))) > 0:
        length = int(there[k - 1])
        take[length] = int(min(left[length], gap // length))
        gap -= take[length] * length
        there = there[: k - 1]
    held = dict(take)
    if gap and sum(take.values()) > 1:
        smallest = min(take)
        unpacked = left.copy()
        for length, n in take.items():
            unpacked[length] -= n
        room = gap + smallest
        upto = np.maximum.accumulate(np.where(unpacked > 0, np.arange(size + 1), 0))  # the longest unpacked length up to each
        one = np.flatnonzero(unpacked[: room + 1])
        other = upto[np.minimum(room - one, one)]
        alone = (other == one) & (unpacked[one] < 2)
        other = np.where(alone, upto[np.minimum(room - one, one - 1)], other)
        sums = np.where(other > 0, one + other, 0)
        if len(sums) and sums.max() > smallest:
            k = len(sums) - 1 - int(np.argmax(sums[::-1]))  # of equal sums the longest first piece
            take[smallest] -= 1
            for length in (int(one[k]), int(other[k])):
                take[length] = take.get(length, 0) + 1
                held[length] = held.get(length, 0) + 1
    return {length: n for length, n in take.items() if n}, held


def patterns(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-two-fit of ``counts[length]`` pieces of each length.

    Rows (length, first, last, each, offset, sequence): the pieces of that length
    with numbers from first to before last stand, ``each`` in a sequence, from
    ``offset`` on, in the sequences that begin with number ``sequence``. Every
    run of like sequences ends as a length runs short of what one of them holds,
    so their number has a bound in ``size`` alone.
    """
    left, used, out, sequence = np.array(counts, np.int64), np.zeros(size + 1, np.int64), [], 0
    while left.any():
        take, held = _filled(left, size)
        again = min((int(left[length]) - held.get(length, n)) // n for length, n in take.items()) + 1
        offset = 0
        for length, n in sorted(take.items(), reverse=True):
            out.append((length, int(used[length]), int(used[length]) + again * n, n, offset, sequence))
            offset += length * n
            used[length] += again * n
            left[length] -= again * n
        sequence += again
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """For every piece: doc_id, piece, start (its document's ids before it), length, the named columns, sequence_id and offset (its place there)."""
    spark = docs.sparkSession
    cut = settled(pieces(docs, tokenizer, size, end, columns))
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # one row a length: at most size
        counts[row["length"]] = row["count"]
    places = spark.createDataFrame(patterns(counts, size), "at long, first long, last long, each long, base long, sequence long")
    numbered = cut.join(before, ["length", "task"]).withColumn("nth", F.col("number") + F.col("before"))
    found = numbered.join(F.broadcast(places), (F.col("length") == F.col("at")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last")))
    nth = F.col("nth") - F.col("first")
    return found.select(
        "doc_id", "piece", "start", "length", *columns,
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and spans (doc_id, piece, offset, length) of what ``pack`` gives with ids; a sequence is bounded by its size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("spans"))
