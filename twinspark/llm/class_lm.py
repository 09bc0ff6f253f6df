"""LM scoring with Brown class-based bigrams.

Tokens are counted over all training texts. Every word that stands LEAST times in
them, and makes RARE of all tokens, is clustered by its own bigrams. There are no
more than 1 / RARE such words in a corpus of any size, so the table of their classes
has a bound:

1. the ITEMS most frequent words and, for all other words, their forms (length,
   ending, script) are put into classes by exchange on the driver: each in turn
   goes to the class that raises the likelihood of the class bigrams most, until
   none moves;
2. how often each word follows and precedes each class is gathered in Spark, and
   every other word of at least LEAST goes, where its counts are, to the class
   that raises the likelihood most. A task sees its own words' moves only, so the
   next round counts anew; a round that doesn't raise the likelihood is not taken.

Only rarer words (and those not met) have the class of their form.

The model gives a token w of class c after one of class d
    (count(w) + 1) * (mix * P(c | d) / (N_c + V_c + 1) + (1 - mix) / (N + V + 1)),
the first part being transition times add-one emission within the class, the
second the add-one unigram; P(c | d) is smoothed towards P(c). mix is fitted by
expectation maximisation to the class bigrams of a KEPT_OUT-th of the training texts
(those whose hash says so, so copies stay together), with transitions from the rest;
transitions of the model are from all. As the count is a common factor, a text's score is
the sum of log10(count + 1), shared with the base score, and of a number that
depends on the two classes only.

Counts of at least a millionth of all tokens (so at most a million words) go to
the workers; the rest of a text's words are joined with the counts, so no table
of words and counts that grows with the vocabulary is broadcast or collected. The
driver gets the bigram counts of seeds and forms, and of every clustered word a
hash and a class: 9 bytes a word, 90 MB at most, in sorted arrays, go to the
workers. Two words have equal hashes with a chance of 2**-64.

Defined results: a null text is empty and has one token, the end; with no
training text counts are 0 and scores are those of unknown words; repeated rows
and equal texts (ties) get equal results, also where ids are null; texts of any length
are scored whole, in pieces of CHUNK bytes in memory; of words with equal counts the
one with the smaller hash is the more frequent; other columns, of whatever name, are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import settled, small_batches, tidy
from twinspark.llm.rolling import Lookup, word_hashes, word_places

CLASSES = 48
#: Words that the driver's exchange begins with; all others of at least LEAST are added in Spark.
ITEMS = 1500
#: Words met so often, and that make this share of all tokens, are clustered by their own bigrams.
LEAST, RARE = 16, 1e-7
#: One in so many training texts is kept out of the counts that the mix is fitted with.
KEPT_OUT = 16
ROUNDS = 1
#: Words of at least this share of all tokens are sent to the workers.
SHARE = 1e-6
SWEEPS = 8
SMOOTH = 20.0

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: No word has white space, so this is the end's alone, and so is its hash, as far as hashes differ.
END = b"\n"
END_KEY = np.uint64(0x9E3779B97F4A7C15)
_ENDINGS = {b: k + 1 for k, b in enumerate(b".,;:!?|")}
FORMS = 7 * 10 * 3
#: Bytes of texts that are split at once, and tokens that are counted at once.
CHUNK, COUNTED = 4 << 20, 4_000_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(_LOW).split(), END]


def form(word: bytes) -> int:
    """Length, ending and script of a word as a number under FORMS."""
    last = word[-1]
    ending = _ENDINGS.get(last, 8 if 48 <= last <= 57 else 0 if last >= 97 and last <= 122 else 9)
    script = 2 if any(48 <= b <= 57 for b in word) else 0 if word.isascii() else 1
    return (min(len(word) - 1, 13) // 2 * 10 + ending) * 3 + script


_ENDING_OF = np.array([form(bytes([b])) // 3 % 10 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


class Words:
    """Tokens of some texts one after another, each text's end included, as hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = END.join(texts) + END
        start, size = word_places(self.data)
        after = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        before = np.searchsorted(start, after)  # words up to the end of each text
        self.hash = np.insert(word_hashes(self.data, (start, size)), before, END_KEY)
        self.start, self.size = np.insert(start, before, 0), np.insert(size, before, 0)
        #: Where each text's end stands.
        self.ends = before + np.arange(len(texts))

    def forms(self, at: np.ndarray) -> np.ndarray:
        """As ``form``, of the tokens at these places, none of them an end."""
        raw = np.frombuffer(self.data, np.uint8)
        start, size = self.start[at], self.size[at]
        digits, high = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (_DIGIT[raw], raw > 127))
        script = np.where(digits[start + size] > digits[start], 2, np.where(high[start + size] > high[start], 1, 0))
        return (np.minimum(size - 1, 13) // 2 * 10 + _ENDING_OF[raw[start + size - 1]]) * 3 + script


def _chunks(column: Iterator[pa.Array]) -> Iterator[Words]:
    """The tokens of about CHUNK bytes of texts at a time."""
    held, size = [], 0
    for texts in column:
        for text in texts:
            held.append((text.as_py() or "").encode().translate(_LOW))
            size += len(held[-1])
            if size >= CHUNK:
                yield Words(held)
                held, size = [], 0
    if held:
        yield Words(held)


def keys(words: list[bytes]) -> np.ndarray:
    """The hashes of words, the end among them or not."""
    out = np.full(len(words), END_KEY)
    out[[k for k, w in enumerate(words) if w != END]] = word_hashes(END.join(w for w in words if w != END))
    return out


class Classes:
    """Numbers of words: those of the clustered ones by hash, and of all others by their form."""

    def __init__(self, hashes: np.ndarray, cls: np.ndarray, of_form: np.ndarray):
        self.hashes, self.cls, self.of_form = hashes, cls, of_form
        self.lookup: Lookup | None = None

    def __getstate__(self):
        return self.__dict__ | {"lookup": None}

    def of(self, words: Words, at: np.ndarray | None = None) -> np.ndarray:
        """The class of every token, or of those at these places."""
        self.lookup = self.lookup or Lookup(self.hashes)
        place = self.lookup.of(words.hash if at is None else words.hash[at])
        out = self.cls[np.maximum(place, 0)].astype(np.int64) if len(self.cls) else np.zeros(len(place), np.int64)
        other = np.flatnonzero(place < 0)
        out[other] = self.of_form[words.forms(other if at is None else at[other])]
        return out

    def with_words(self, hashes: np.ndarray, cls: np.ndarray) -> Classes:
        """These words in their new classes, beside those that aren't among them."""
        every, first = np.unique(np.concatenate((hashes, self.hashes)), return_index=True)
        return Classes(every, np.concatenate((cls, self.cls))[first].astype(np.uint8), self.of_form)


def hashed(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the tokens of a table of counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys(b.column(0).to_pylist()).view(np.int64)), b.column(1)], ["key", "n"])

    rows = counts.select("token", "n").mapInArrow(work, "key long, n long").toArrow()
    return rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(own := tokens(text.as_py()))
                size += len(own)
                if size > 4_000_000:
                    yield out()
                    held, size = Counter(), 0
        yield out()

    return texts.select("text").mapInArrow(tidy(work), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, known: Classes, size: int) -> np.ndarray:
    """Counts of pairs of numbers under ``size`` as a matrix, over all texts; they follow each other from an end to the next."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None

        def out() -> pa.RecordBatch:
            count = np.bincount(np.concatenate(held), minlength=1)
            pair = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count[pair])], ["pair", "n"])

        for words in _chunks(b.column(0) for b in batches):
            own = sent.value.of(words)
            held.append(np.concatenate((own[-1:], own[:-1])) * size + own)  # the last one is an end
            n += len(own)
            if n > COUNTED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    rows = texts.select("text").mapInArrow(tidy(work), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    del rows
    pa.default_memory_pool().release_unused()
    sent.destroy()
    return out.reshape(size, size)


def bigrams(texts: DataFrame, items: np.ndarray) -> np.ndarray:
    """Counts of pairs of items: words with these hashes, then forms."""
    n = len(items)
    return pair_counts(texts, Classes(items, np.arange(n), n + np.arange(FORMS)), n + FORMS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def step(table: np.ndarray, total: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float, n: float) -> int:
    """The class that raises the likelihood most for one item of class ``a``; table and total are changed to that.

    right, left: its counts before and after each class, without the ``own`` ones of itself before itself.
    """
    table[a] -= right
    table[:, a] -= left
    table[a, a] -= own
    total[a] -= n
    r, l = np.flatnonzero(right), np.flatnonzero(left)
    after, before = table[:, r], table[l]
    gain = (_f(after + right[r]) - _f(after)).sum(1) + (_f(before + left[l][:, None]) - _f(before)).sum(0)
    diagonal = table.diagonal()
    gain += _f(diagonal + right + left + own) + _f(diagonal) - _f(diagonal + right) - _f(diagonal + left)
    gain -= 2 * (_f(total + n) - _f(total))
    b = int(gain.argmax())
    if gain[b] <= gain[a] + 1e-9:
        b = a
    table[b] += right
    table[:, b] += left
    table[b, b] += own
    total[b] += n
    return b


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of every item, by exchange clustering."""
    n = len(pairs)
    count = pairs.sum(0)
    order = np.argsort(-count, kind="stable")
    at = np.zeros(n, np.int64)
    at[order] = np.arange(n) % classes
    member = np.eye(classes)
    after, before = pairs @ member[at], pairs.T @ member[at]  # of an item: counts by the class that follows, that precedes
    table = member[at].T @ after
    total = np.bincount(at, count, classes)
    for _ in range(sweeps):
        moved = 0
        for w in order[count[order] > 0]:
            a, own = at[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            b = step(table, total, a, right, left, own, count[w])
            if b != a:
                moved += 1
                at[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return at


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for a part that no class changes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def contexts(texts: DataFrame, known: Classes, classes: int, clustered: np.ndarray) -> DataFrame:
    """(key, cls, code, n) of the clustered words: class so far, and how often one stands before a class (code), after one (classes + code) and after itself.

    Codes and counts are arrays of a byte and of four; a word has a row for each part of a task.
    """
    sent = texts.sparkSession.sparkContext.broadcast((known, clustered))
    codes = 2 * classes + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, clustered = sent.value
        lookup, now = Lookup(clustered), np.zeros(len(clustered), np.int32)
        held, n = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            word, first = np.unique(pair // codes, return_index=True)
            ends = np.append(first, len(pair)).astype(np.int32)
            packed = lambda x: pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)])
            cols = [pa.array(clustered[word].view(np.int64)), pa.array(now[word]), packed((pair % codes).astype(np.uint8)), packed(n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays(cols, ["key", "cls", "code", "n"])

        for words in _chunks(b.column(0) for b in batches):
            at, cls = lookup.of(words.hash).astype(np.int64), known.of(words)
            mine = np.flatnonzero(at >= 0)  # the first token may be one, the last one is an end
            now[at[mine]] = cls[mine]
            held += [at[mine] * codes + cls[mine + 1], at[mine] * codes + classes + cls[mine - 1]]
            held.append(at[mine[at[mine] == at[mine - 1]]] * codes + codes - 1)
            n += len(mine)
            if n > COUNTED:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return texts.select("text").mapInArrow(tidy(work), "key long, cls int, code binary, n binary")


def placed(found: DataFrame, table: np.ndarray) -> DataFrame:
    """(key, cls): the class that suits each word best; found: what ``contexts`` gives."""
    sent = found.sparkSession.sparkContext.broadcast(table)
    classes = len(table)
    codes = 2 * classes + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.copy()
        total = table.sum(0)
        held: pa.Table | None = None

        def of(t: pa.Table) -> pa.RecordBatch:
            words, first, group = np.unique(t["key"].to_numpy(), return_index=True, return_inverse=True)
            code = [np.frombuffer(x, np.uint8) for x in t["code"].to_pylist()]
            n = np.frombuffer(b"".join(t["n"].to_pylist()), np.uint32)
            row = np.repeat(group, [len(c) for c in code])
            vec = np.bincount(row * codes + np.concatenate(code), n, len(words) * codes).reshape(-1, codes)
            cls = np.empty(len(words), np.int16)
            for w, (a, v) in enumerate(zip(t["cls"].to_numpy()[first], vec)):
                right, left, own = v[:classes].copy(), v[classes:-1].copy(), v[-1]
                n = right.sum()
                right[a] -= own
                left[a] -= own
                cls[w] = step(table, total, a, right, left, own, n)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(cls)], ["key", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            k = t["key"].to_numpy()
            at = int(np.searchsorted(k, k[-1]))  # the last word may go on
            if at:
                yield of(t.slice(0, at))
            held = t.slice(at)
        if held is not None:
            yield of(held)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(work), "key long, cls short")


def grown(texts: DataFrame, known: Classes, table: np.ndarray, clustered: np.ndarray) -> tuple[Classes, np.ndarray]:
    """Classes of the clustered words beside the seeds, which stay, and the class bigrams."""
    clustered, classes = np.setdiff1d(clustered, known.hashes), len(table)
    for _ in range(ROUNDS if len(clustered) else 0):
        rows = placed(contexts(texts, known, classes, clustered), table).toArrow()
        new = known.with_words(rows["key"].to_numpy().view(np.uint64), rows["cls"].to_numpy())
        del rows
        after = pair_counts(texts, new, classes)
        if likelihood(after) <= likelihood(table):
            break
        known, table = new, after
    return known, table


class Scorer:
    """What a worker needs: classes of words, hashes and counts of frequent words, log10 of the class part."""

    def __init__(self, classes: Classes, heads: np.ndarray, counts: np.ndarray, class_part: np.ndarray):
        self.classes, self.heads, self.counts, self.class_part = classes, heads, counts, class_part
        self.lookup: Lookup | None = None

    def __getstate__(self):
        return self.__dict__ | {"lookup": None}

    def texts(self, words: Words) -> tuple:
        """Of every text: tokens, known frequent ones, their log10 counts, the class part, and the other words."""
        if self.lookup is None:
            self.lookup = Lookup(self.heads)
            self.log = np.append(np.log10(self.counts + 1.0), 0.0)  # the last one for those that aren't frequent
        at, cls = self.lookup.of(words.hash), self.classes.of(words)
        part = self.class_part[np.concatenate((cls[-1:], cls[:-1])), cls]  # an end stands before the first word
        first = np.concatenate(([0], words.ends[:-1] + 1))
        rest: list[Counter] = [Counter() for _ in first]
        other = np.flatnonzero(at < 0)
        for k, i, n in zip(np.searchsorted(words.ends, other), words.start[other], words.size[other]):
            rest[k][words.data[i : i + n] if n else END] += 1
        sums = [np.add.reduceat(x, first) for x in ((at >= 0).astype(np.int64), self.log[at], part)]
        return words.ends - first + 1, *sums, rest


def transitions(table: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed towards P(class)."""
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return (table + SMOOTH * share) / (table.sum(1, keepdims=True) + SMOOTH)


def fitted(table: np.ndarray, inside: np.ndarray, outside: float) -> float:
    """The weight of ``inside`` in a mix with ``outside`` that makes class bigrams with these counts likeliest."""
    mix = 0.5
    for _ in range(30 if table.sum() else 0):
        mix = float((table * (mix * inside / (mix * inside + (1 - mix) * outside))).sum() / table.sum())
    return min(0.999, max(0.001, mix))


def fit(docs: DataFrame, learn: Column, classes: int = CLASSES) -> tuple[Scorer, DataFrame, int, int]:
    """The scorer, the counts (token, n), the number of training tokens and of different ones."""
    small_batches(docs.sparkSession)
    texts = docs.where(learn).select("text")
    counts = settled(token_counts(texts))
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    heads, n = hashed(counts.where(F.col("n") >= max(1, total * SHARE)))
    order = np.lexsort((heads, -n))
    heads, n = heads[order], n[order]
    items = heads[:ITEMS]
    if END_KEY not in items:
        items = np.append(items, END_KEY)
    pairs = bigrams(texts, items)
    of_item = exchange(pairs, classes)
    member = np.eye(classes)[of_item]
    table = member.T @ pairs @ member
    del pairs
    seeds = Classes(items, of_item[: len(items)].astype(np.uint8), of_item[len(items) :].astype(np.uint8))
    known, table = grown(texts, seeds, table, hashed(counts.where(F.col("n") >= max(LEAST, total * RARE)))[0])
    # Tokens and different tokens of every class.
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            end = np.array([w == END for w in b.column(0).to_pylist()], bool)
            words = Words([w for w in b.column(0).to_pylist() if w != END])
            cls = np.empty(len(end), np.int64)
            cls[~end] = sent.value.of(words, np.delete(np.arange(len(words.hash)), words.ends))
            cls[end] = sent.value.of(Words([b""])) if end.any() else 0
            count = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(np.bincount(cls, count, classes).astype(np.int64)), pa.array(np.bincount(cls, minlength=classes))], ["c", "n", "v"])

    sums = counts.mapInArrow(tidy(by_class), "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas().set_index("c").reindex(range(classes), fill_value=0)
    size = sums["n"].to_numpy(float) + sums["v"].to_numpy(float) + 1
    outside = 1 / (total + different + 1)
    out = pair_counts(texts.where(F.pmod(F.xxhash64("text"), F.lit(KEPT_OUT)) == 0), known, classes)
    mix = fitted(out, transitions(table - out) / size, outside)
    inside = transitions(table) / size
    return Scorer(known, heads, n, np.log10(mix * inside + (1 - mix) * outside)), counts, int(total), int(different)


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame, total: int, different: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.binary_length(pc.fill_null(b.column(1), "")).to_numpy())
            for some in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(sizes // CHUNK)) + 1):
                if not len(some):
                    continue
                part = b.slice(some[0], len(some))
                *got, rest = sent.value.texts(Words([(t.as_py() or "").encode().translate(_LOW) for t in part.column(1)]))
                cols = [pa.array(g, kind) for g, kind in zip(got, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                rest = pa.array([list(r.items()) for r in rest], pa.map_(pa.binary(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, rest], ["doc_id", "n_tokens", "n_head", "head_log", "class_log", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {kind}, n_tokens long, n_head long, head_log double, class_log double, rest map<binary,long>")
    rows = settled(rows.withColumn("rid", F.monotonically_increasing_id()))
    rest = rows.select("rid", F.explode("rest").alias("token", "times")).join(counts, "token")
    rest = rest.groupBy("rid").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"))
    every = rows.drop("rest").join(rest, "rid", "left")
    log = F.col("head_log") + F.coalesce("log", F.lit(0.0))
    out = every.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("times", F.lit(0))).alias("n_known"),
        (log - F.col("n_tokens") * F.log10(F.lit(float(total + different + 1)))).alias("base_score"), (log + F.col("class_log")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def classes_of(scorer: Scorer, words: list[str]) -> list[int]:
    found = Words([w.encode().translate(_LOW) for w in words])
    return scorer.classes.of(found, np.delete(np.arange(len(found.hash)), found.ends)).tolist()
