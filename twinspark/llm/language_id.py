"""Language identification with a bidirectional gated recurrent network over bytes.

One network reads the bytes forwards, another backwards; both states at a byte
give its language by a softmax layer. It is trained with numpy by backpropagation
through time. A document's probabilities are the mean of those of all its bytes.

Sequences are the words of a text with a space on both sides, cut after ``CUT``
bytes, and the state starts anew with each. A word's labels so depend on the word
alone, and a worker runs each different word once and adds its sums as often as it
stands, which changes no result. Texts are processed whole.

The network is fitted on the driver on at most ``SAMPLE`` different texts of at most
LARGEST bytes each and SAMPLED bytes together (those with the least hash of their id,
a documented bound), all words of which can be drawn; every language's words are drawn
equally often.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows with a null lang or id are not learned from; with no row to learn from every text
is ``und`` with score 0; repeated rows get results that are equal but for the rounding
of float32 products; of languages with equal probabilities the first by name is given;
texts of any length are labelled whole; other columns may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.common import small_batches

SAMPLE = 1200
#: Bytes of the largest text that is learned from, and of all together.
LARGEST, SAMPLED = 1 << 20, 32 << 20
HIDDEN = 16
EMBED = 12
STEPS = 500
BATCH = 256
CUT = 30
SEED = 11

_LETTER = regex.compile(r"\p{L}")
#: Words of a batch that are run at once.
TOGETHER = 8192
#: Words whose sums a worker remembers, about; this changes no result.
REMEMBERED = 400_000


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, word), padded with 0, and lengths."""
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(size.max())), np.uint8)
    mask = np.arange(out.shape[1]) < size[:, None]
    out[mask] = np.frombuffer(b"".join(words), np.uint8)
    return out.T, size


def cut(word: bytes) -> list[bytes]:
    return [b" " + word[i : i + CUT] + b" " for i in range(0, len(word), CUT)]


def sequences(text: str) -> list[bytes]:
    return [x for w in text.encode().split() for x in cut(w)]


class Known(dict):
    """Words by number; ``new`` has those whose sums aren't there yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Gru:
    """One direction. State h; gates z (keep) and r (reset); candidate c."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"x": draw(EMBED, 3 * HIDDEN), "zr": draw(HIDDEN, 2 * HIDDEN), "c": draw(HIDDEN, HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)}

    def run(self, inputs: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step for inputs (time, batch, 3 * HIDDEN); masked steps leave the state as it is."""
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        out = np.empty((*inputs.shape[:2], HIDDEN), np.float32)
        for t in range(len(inputs)):
            zr = _sigmoid(inputs[t, :, : 2 * HIDDEN] + h @ self.p["zr"])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(inputs[t, :, 2 * HIDDEN :] + (r * h) @ self.p["c"])
            new = np.where(mask[t][:, None], z * h + (1 - z) * c, h)
            if keep is not None:
                keep.append((h, z, r, c))
            out[t] = h = new
        return out

    def back(self, kept: list, mask: np.ndarray, dout: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters (but "x" and "b") and of the inputs, backwards through time."""
        grad = {k: np.zeros_like(self.p[k]) for k in ("zr", "c")}
        dinput = np.zeros((len(kept), dout.shape[1], 3 * HIDDEN), np.float32)
        dh = np.zeros(dout.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = dh + dout[t]
            live = dh * mask[t][:, None]
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (h - c) * z * (1 - z)
            drh = dc @ self.p["c"].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate((dz, dr), 1)
            dinput[t] = np.concatenate((dzr, dc), 1)
            grad["zr"] += h.T @ dzr
            grad["c"] += (r * h).T @ dc
            dh = (dh - live) + live * z + drh * r + dzr @ self.p["zr"].T
        return grad, dinput


class Network:
    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(SEED)
        self.langs = langs
        self.embed = (0.3 * rng.standard_normal((256, EMBED))).astype(np.float32)
        self.ways = [Gru(rng), Gru(rng)]
        self.out = (rng.standard_normal((2 * HIDDEN, len(langs))) / HIDDEN).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.tables: list[np.ndarray] | None = None
        self.known: Known | None = None

    def _inputs(self, data: np.ndarray) -> list[np.ndarray]:
        tables = self.tables or [self.embed @ w.p["x"] + w.p["b"] for w in self.ways]
        return [tables[0][data], tables[1][data[::-1]]]

    def labels(self, data: np.ndarray, size: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities (time, word, language), the states and the mask."""
        mask = np.arange(len(data))[:, None] < size[None, :]
        masks, inputs = (mask, mask[::-1]), self._inputs(data)
        kept: list[list] = [[], []]
        h = [w.run(i, m, k if keep is not None else None) for w, i, m, k in zip(self.ways, inputs, masks, kept)]
        if keep is not None:
            keep += kept
        both = np.concatenate((h[0], h[1][::-1]), 2)
        z = both @ self.out + self.bias
        z = np.exp(z - z.max(2, keepdims=True))
        return z / z.sum(2, keepdims=True), both, mask

    def learn(self, words: list[bytes], lang: np.ndarray, state: dict, step: int, rate: float) -> float:
        """One step of Adam on the mean cross entropy of all bytes."""
        data, size = pack(words)
        kept: list = []
        p, both, mask = self.labels(data, size, kept)
        n = mask.sum()
        at = lang[None, :, None]
        loss = -np.log(np.take_along_axis(p, np.broadcast_to(at, (*p.shape[:2], 1)), 2)[..., 0] + 1e-9)[mask].mean()
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(at, (*p.shape[:2], 1)), np.take_along_axis(d, np.broadcast_to(at, (*p.shape[:2], 1)), 2) - 1, 2)
        d *= mask[..., None] / n
        grads = [("out", self, np.einsum("tbh,tbl->hl", both, d)), ("bias", self, d.sum((0, 1)))]
        dboth = d @ self.out.T
        dembed = np.zeros_like(self.embed)
        for k, w in enumerate(self.ways):
            flip = slice(None, None, -1) if k else slice(None)
            own, dinput = w.back(kept[k], mask[flip], dboth[flip][..., k * HIDDEN : (k + 1) * HIDDEN])
            seen, flat = data[flip].ravel(), dinput.reshape(-1, 3 * HIDDEN)
            by_byte = np.zeros((256, 3 * HIDDEN), np.float32)
            np.add.at(by_byte, seen, flat)
            grads += [(name, w.p, g) for name, g in {**own, "x": self.embed.T @ by_byte, "b": by_byte.sum(0)}.items()]
            dembed += by_byte @ w.p["x"].T
        grads.append(("embed", self, dembed))
        for name, owner, g in grads:
            m, v = state.setdefault((name, id(owner)), (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name, id(owner)] = m, v
            change = (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if isinstance(owner, dict):
                owner[name] -= change
            else:
                setattr(owner, name, getattr(owner, name) - change)
        return float(loss)

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Probabilities summed over the bytes of each word."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            p, _, mask = self.labels(*pack([words[j] for j in part]))
            out[part] = (p * mask[..., None]).sum(0)
        return out

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over the bytes of each text."""
        if self.known is None or len(self.known) > REMEMBERED:
            self.known, self.sums, self.size = Known(), np.zeros((0, len(self.langs))), np.zeros(0)
        known = self.known
        ids = [np.fromiter(map(known.__getitem__, t.encode().split()), np.int64) for t in texts]
        if known.new:
            parts = [(k, x) for k, w in enumerate(known.new) for x in cut(w)]
            owner, chunks = np.array([k for k, _ in parts]), [x for _, x in parts]
            sums, size = np.zeros((len(known.new), len(self.langs))), np.zeros(len(known.new))
            np.add.at(sums, owner, self.word_sums(chunks))
            np.add.at(size, owner, [len(x) for x in chunks])
            self.sums, self.size = np.concatenate((self.sums, sums)), np.concatenate((self.size, size))
            known.new.clear()
        return np.stack([self.sums[i].sum(0) / max(1.0, self.size[i].sum()) for i in ids]) if texts else np.zeros((0, len(self.langs)))


def train(rows: list[tuple[str, str]]) -> Network | None:
    """From (text, lang) rows in a fixed order."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    net, rng, state = Network(langs), np.random.default_rng(SEED), {}
    pools = [[w for text, lang in rows if lang == x for w in sequences(text)] for x in langs]
    used = [k for k, p in enumerate(pools) if p]
    if not used:
        return None
    for step in range(1, STEPS + 1):
        lang = np.array([used[i % len(used)] for i in range(BATCH)])
        words = [pools[k][rng.integers(len(pools[k]))] for k in lang]
        net.learn(words, lang, state, step, 0.01 if step < STEPS * 0.7 else 0.002)
    net.tables = [net.embed @ w.p["x"] + w.p["b"] for w in net.ways]
    return net


def fit(docs: DataFrame, learn, sample: int = SAMPLE) -> Network | None:
    """From the rows with a lang for which learn(doc_id) holds; at most ``sample`` different ones of SAMPLED bytes."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("hash")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learn(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit("language")), "doc_id", "hash", "lang"]
    key = ["doc_id", "hash", "lang"]
    # Rows are chosen without their texts, so that no part of the table sends more texts than are taken.
    sized = rows.select(*key, F.octet_length("text").alias("bytes")).where(F.col("bytes") <= LARGEST)
    chosen = sized.distinct().orderBy(*order).limit(sample)
    so_far = F.sum("bytes").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # of ``sample`` rows at most
    chosen = chosen.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLED).select(*key)
    got = rows.join(F.broadcast(chosen), key).groupBy(*key).agg(F.first("text").alias("text")).orderBy(*order).collect()
    return train([(r["text"], r["lang"]) for r in got])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score and the probabilities of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                texts = [t.as_py() or "" for t in part.column(1)]
                known = np.array([net is not None and _LETTER.search(t) is not None for t in texts], bool)
                lang, score, probs = ["und"] * len(texts), np.zeros(len(texts)), [{}] * len(texts)
                if known.any():
                    at = np.flatnonzero(known)
                    p = net.pooled([texts[i] for i in at])
                    for i, row in zip(at, p):
                        lang[i], score[i], probs[i] = net.langs[int(row.argmax())], min(1.0, float(row.max())), dict(zip(net.langs, map(float, row)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array([list(x.items()) for x in probs], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "probabilities"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, probabilities map<string,double>")
