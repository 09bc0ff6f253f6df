"""License scans: a positional index of rare licence words.

Templates are word lists. The index has the ANCHORS rarest mandatory words of every
template (highest inverse document frequency over the templates) with their
positions. A text's occurrences of indexed words are looked up; each posting gives
the start that the template would have there. Starts that the postings of all
indexed words of a template share are kept, and then the mandatory phrases are
verified word by word. The other words of the template only add to the score. Spans
are those of the mandatory words. Everything happens within the row: one projection
without a shuffle, so neither frequent words nor long texts gather rows in one task.

Defined results: a null text is empty; a text without a licence has zero places,
null positions, empty labels and score 0; repeated rows get equal results; ties
(places of several templates) are all reported, sorted by place, length and label;
texts of any length are taken whole, as one row's array of words; other columns may
have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import ascii_lower, let, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template that are looked up and must agree before the phrases are verified.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    """Words in brackets are mandatory key phrases."""

    label: str
    text: str
    base: bool = False

    @property
    def parts(self) -> list[tuple[str, bool]]:
        out, inside = [], False
        for w in self.text.replace("[", " [ ").replace("]", " ] ").split():
            if w in "[]":
                inside = w == "["
            else:
                out.append((w, inside))
        return out


#: Licence wordings (fixed values).
TEMPLATES = (
    Template("gpl", "[gnu general public license]", True),
    Template("apache", "[apache license]", True),
    Template("cc-by", "[cc by]", True),
    Template("mit", "[mit license]", True),
    Template("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    Template("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    Template("lgpl", "under the terms of the [gnu lesser general public license]"),
    Template("agpl", "under the terms of the [gnu affero general public license]"),
    Template("gpl", "this program is free software you can [redistribute it and or modify it under the terms of the gnu general public license] as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("apache-2.0", "licensed under the [apache license version 2 0] the license [you may not use this file except in compliance with the license] you may obtain a copy of the license at"),
    Template("mit", "[permission is hereby granted free of charge] to any person [obtaining a copy of this software] and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or [distribute this software for any purpose with or without fee] is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("unlicense", "this is free and [unencumbered software released into the public domain]"),
    Template("cc-by-nc", "licensed under [cc by nc] 4 0"),
    Template("cc-by-sa", "licensed under [cc by sa] 4 0"),
    Template("cc-by", "this work is licensed under a [creative commons attribution] 4 0 international license"),
)


def weights(templates=TEMPLATES) -> dict[str, int]:
    """Inverse document frequency over the templates, in thousandths, 1 at least."""
    df = Counter(w for t in templates for w in {w for w, _ in t.parts})
    return {w: max(1, round(1000 * math.log(len(templates) / n))) for w, n in df.items()}


def anchors(template: Template, idf: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest mandatory words and their positions, rarest first."""
    return sorted(((w, i) for i, (w, must) in enumerate(template.parts) if must), key=lambda x: (-idf[x[0]], x[1]))[:ANCHORS]


def all_words(text: Column) -> Column:
    low = ascii_lower(text)
    return F.filter(F.split(low, NOT_WORD), lambda x: x != "")


def places(ws: Column, templates=TEMPLATES) -> Column:
    """Struct of an array of verified starts for each template (``t0``, ``t1``, ...)."""
    idf = weights(templates)
    index = [(w, k, i) for k, t in enumerate(templates) for w, i in anchors(t, idf)]
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a"), F.lit(i).alias("i")) for a, (w, _, i) in enumerate(index)])
    hits = F.when(F.size(ws) > 0, F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda p: F.get(ws, p).isin(sorted({w for w, _, _ in index})))).otherwise(F.array().cast("array<int>"))
    postings = F.flatten(F.transform(hits, lambda p: F.transform(F.filter(table, lambda e: e["w"] == F.get(ws, p)), lambda e: F.struct(e["a"].alias("a"), (p - e["i"]).alias("s")))))

    def shared(postings: Column, k: int) -> Column:
        """The starts that all indexed words of a template agree on."""
        starts = lambda a: F.transform(F.filter(postings, lambda x: x["a"] == a), lambda x: x["s"])
        return reduce(F.array_intersect, [starts(a) for a, (_, of, _) in enumerate(index) if of == k])

    def verified(postings: Column) -> Column:
        return F.struct(*[F.filter(shared(postings, k), _stands(ws, [(w, i) for i, (w, must) in enumerate(t.parts) if must])).alias(f"t{k}") for k, t in enumerate(templates)])

    none = F.struct(*[F.array().cast("array<int>").alias(f"t{k}") for k in range(len(templates))])
    return let(postings, lambda found: F.when(F.size(found) > 0, verified(found)).otherwise(none))


def _stands(ws: Column, must: list[tuple[str, int]]):
    return lambda s: reduce(lambda a, b: a & b, [F.get(ws, s + i) == w for w, i in must])


def _got(ws: Column, parts: list[tuple[str, bool]], idf: dict[str, int]):
    return lambda s: reduce(lambda a, b: a + b, [F.when(F.get(ws, s + i) == w, F.lit(idf[w])).otherwise(F.lit(0)) for i, (w, _) in enumerate(parts)])


def _span(t: Template):
    must = [i for i, (_, m) in enumerate(t.parts) if m]
    return lambda s: F.struct((s + must[0]).alias("first"), F.lit(must[-1] - must[0] + 1).alias("words"), F.lit(t.label).alias("label"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id with base places, labels and score; ``spans`` has (first word, words, label) of the mandatory words at all places."""
    idf = weights(templates)

    def of(ws: Column) -> Column:
        return let(places(ws, templates), lambda p: result(ws, p))

    def result(ws: Column, p: Column) -> Column:
        base = [p[f"t{k}"] for k, t in enumerate(templates) if t.base]
        labels = lambda only: F.array_join(F.sort_array(F.array_distinct(F.filter(F.array(*[F.when(F.size(p[f"t{k}"]) > 0, F.lit(t.label)) for k, t in enumerate(templates) if t.base or not only]), lambda x: x.isNotNull()))), ",")
        scores = []
        for k, t in enumerate(templates):
            total = sum(idf[w] for w, _ in t.parts)
            scores.append(F.array_max(F.transform(p[f"t{k}"], _got(ws, t.parts, idf))).cast("double") / F.lit(float(total)))
        spans = F.sort_array(F.flatten(F.array(*[F.transform(p[f"t{k}"], _span(t)) for k, t in enumerate(templates)])))
        return let(
            F.flatten(F.array(*base)),
            lambda b: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.size(b).cast("long").alias("n_base"),
                F.array_min(b).cast("long").alias("first_word"),
                F.array_max(b).cast("long").alias("last_word"),
                labels(True).alias("base_labels"),
                labels(False).alias("labels"),
                F.coalesce(F.greatest(*scores), F.lit(0.0)).alias("score"),
                spans.alias("spans"),
            ),
        )

    return docs.select("doc_id", let(all_words(whole(F.col("text"))), of).alias("r")).select("doc_id", "r.*")


def sql(templates=TEMPLATES) -> str:
    idf = weights(templates)
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {idf[w]}, {str(m).lower()})" for k, t in enumerate(templates) for i, (w, m) in enumerate(t.parts))
    return rf"""
with tpl(k, label, base, i, w, idf, must) as (values {rows}),
need as (select k, sum(must::int) as musts, sum(idf) as total from tpl group by k),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
p as (select rid, unnest(ws) as w, unnest(range(len(ws))) as p from d),
a as (select rid, k, any_value(label) as label, bool_or(base) as base, p - i as s, sum(must::int) as musts, sum(idf) as got from p join tpl using (w) group by rid, k, p - i),
v as (select a.*, got::double / total::double as sc from a join need using (k) where a.musts = need.musts),
g as (select rid, count(*) filter (base) as n_base, min(s) filter (base) as f, max(s) filter (base) as l,
  string_agg(distinct label, ',' order by label) filter (base) as bl, string_agg(distinct label, ',' order by label) as al, max(sc) as sc from v group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word,
  coalesce(bl, '') as base_labels, coalesce(al, '') as labels, coalesce(sc, 0.0)::double as score from d left join g using (rid)
"""
