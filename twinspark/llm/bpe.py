"""BPE encoding and decoding by dynamic programming over prefixes.

Of a piece of text (split as the tokenizer file says), every prefix has exactly
one last token in its BPE encoding. It is found among the tokens that end there
- an automaton over the reversed tokens, walked backwards from the end, gives
them, longest first - as the one whose predecessor, the last token of the
prefix before it, is compatible with it: encoding the two tokens' joined bytes
by merges gives back the two. Following the stored last tokens from the end of
the piece emits the ids. Compatibility is decided from the merges alone by
undoing them, and is cached for each pair of tokens.

Pieces repeat, so a worker keeps those it has encoded lately in bounded tables;
this does not change any result. Texts are
processed whole, some hundred at a time; there is no shuffle.

Only files of the byte-level kind can be read, with the usual split into pieces and
without a normalizer, a prefix space or options of the model or of added tokens;
others raise (``checked``).

Defined results: a null text is encoded as empty text, which has no ids;
special tokens that stand in a text become their own id; repeated rows, null and
tied ids get equal results for equal texts; a text of any length is encoded whole, a
piece of n bytes in time that grows with n; other columns, of whatever name, are not
read; an empty table gives an empty result. Ids decode to the same bytes as the library's, with invalid
UTF-8 replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from twinspark.llm.common import small_batches, tidy

#: Pieces of the byte-level kind (a fixed value of the file format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, and pairs of tokens whose compatibility is known, that a worker remembers twice: the last ones and those before them.
REMEMBERED, FITS = 400_000, 1_000_000
#: Texts whose ids are sent back at once.
TOGETHER = 500


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def checked(spec: dict) -> dict:
    """The content of a tokenizer file; raises if it asks for anything that isn't done here."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if spec.get("normalizer"):
        odd.append("normalizer")
    if model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        odd.append("pre_tokenizer or type of the model")
    if odd:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd)}")
    return spec


class Vocabulary:
    """Tokens as bytes, merges, and the automaton of the reversed tokens."""

    def __init__(self, spec: dict):
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id_of = {as_bytes(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left, right) -> (rank, merged); a merged token -> how its first merge made it.
        self.merge, self.made = {}, {}
        for rank, (a, b) in enumerate(pairs):
            left, right = vocab[a], vocab[b]
            merged = vocab[a + b]
            self.merge[left, right] = (rank, merged)
            self.made.setdefault(merged, (rank, left, right))
        # Only tokens that their own bytes encode to can end a prefix.
        self.whole = {b: i for b, i in self.id_of.items() if len(b) == 1 or self.merged(b) == [i]}
        #: node << 8 | byte -> the node that follows.
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for b, i in self.whole.items():
            node = 0
            for c in reversed(b):
                nxt = self.step.setdefault(node << 8 | c, len(self.token_at))
                if nxt == len(self.token_at):
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.length = [len(b) for b in self.bytes_of]
        self.fits: dict[int, bool] = {}
        self.fits_before: dict[int, bool] = {}
        self.split = regex.compile(PIECES).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known = Known(self)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array(self.length, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by merges, lowest rank first; for short pieces only."""
        ids = [self.id_of[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of both never joins across their border.

        The merges that made both tokens are undone, the latest first; a merge
        across the border would come before the one undone last iff its rank is
        lower (or, on the left side of an equal rank, it stands first).
        """
        limit = 1 << 62
        while True:
            across = self.merge.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:  # of equal ranks the leftmost merge went first, so the right one is undone first
                limit, right = b[0] + 1, b[1]

    def last_tokens(self, piece: bytes) -> list[int]:
        """For every prefix of 1, 2, ... bytes, the last token of its encoding."""
        step, token_at, length, fits = self.step.get, self.token_at, self.length, self.fits
        last: list[int] = []
        for end in range(1, len(piece) + 1):
            node, ends = 0, []
            for k in range(end - 1, -1, -1):
                node = step(node << 8 | piece[k])
                if node is None:
                    break
                if token_at[node] >= 0:
                    ends.append(token_at[node])
            for token in reversed(ends):
                start = end - length[token]
                if start == 0:
                    break
                key = last[start - 1] << 32 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= FITS:
                        self.fits_before = dict(fits)
                        fits.clear()
                    ok = self.fits_before.get(key)
                    ok = fits[key] = self.compatible(last[start - 1], token) if ok is None else ok
                if ok:
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes of {piece!r}")
            last.append(token)
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.whole.get(piece)
        if whole is not None:
            return [whole]
        last, out, end = self.last_tokens(piece), [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= self.length[out[-1]]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        parts = self.special_split(text) if self.special_split and any(s in text for s in self.special) else (text,)
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += chain.from_iterable(map(self.known.__getitem__, self.split(part)))
        return out

    def decode(self, ids) -> bytes:
        """The bytes of the ids, one after another."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes()


class Known(dict):
    """The ids of short pieces met lately: of REMEMBERED ones, and of as many before these, so that frequent ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.before: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(key: str, spec: str) -> Vocabulary:
    """A worker builds a vocabulary once."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(checked(json.loads(spec)))
    return _LOADED[key]


#: What ``encode`` can give for a text.
COLUMNS = {
    "n_tokens": ("long", pa.int64(), lambda ids, text: len(ids)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, text: ids.astype(np.int32)),
    "decoded": ("string", pa.string(), lambda ids, text: text),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(text.encode()).hexdigest()),
}


def encode(docs: DataFrame, tokenizer: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the named columns of COLUMNS for every row.

    ``tokenizer`` is a file on the driver; its text (of bounded size) goes to the workers.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(key, sent.value)
        for batch in (b.slice(start, TOGETHER) for b in batches for start in range(0, b.num_rows, TOGETHER)):
            cols: list[list] = [[] for _ in columns]
            for text in batch.column(1):
                ids = np.array(v.encode(text.as_py() or ""), "<u4")
                back = v.decode(ids).decode("utf-8", "replace")
                for col, name in zip(cols, columns):
                    col.append(COLUMNS[name][2](ids, back))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, COLUMNS[n][1]) for c, n in zip(cols, columns))], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {doc_id}, " + ", ".join(f"{n} {COLUMNS[n][0]}" for n in columns))
