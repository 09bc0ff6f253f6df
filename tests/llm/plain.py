"""Plain versions that the operators are held against."""

import hashlib
import re
from collections import Counter

import duckdb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts):
    """Least id of each row's component; texts: list of (id, text)."""
    sets = [shingle_set(t) for _, t in texts]
    where = {}
    for k, s in enumerate(sets):
        for h in s:
            where.setdefault(h, []).append(k)
    up = list(range(len(texts)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, s in enumerate(sets):
        for j, o in Counter(j for h in s for j in where[h] if j < k).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = top(j), top(k)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(texts)]


def repeats(texts, length=100):
    """For texts in order: (n_bytes, n_removed, n_spans, kept bytes)."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def same_as_sql(got, docs, sql):
    documents = docs.select("doc_id", "text").toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    cols = sorted(got.columns)
    want = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    order = [names.index(c) for c in cols]
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(tuple(r[i] for i in order) for r in want)
