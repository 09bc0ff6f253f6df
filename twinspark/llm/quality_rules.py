"""Quality rules: a threshold table compiled into one projection.

Each rule bounds the ratio of two counts of a text. All counts are integers and
ratios are compared by cross multiplication, so no rounding is involved. The
projection needs no shuffle and no user functions; every row is judged alone.

Defined results: a null text counts as no words; a text of under ten words
fails the base; repeated rows and equal texts (ties) get equal verdicts, also where ids are
null; texts of any length are counted whole; an empty table gives an
empty result; other columns of the input are passed through by ``apply`` and
ignored by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import let, whole, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at this are or an from "
    "de la le les et des en un une du que est pour dans qui sur au par il ne se pas plus "
    "der die und das ist den nicht von zu mit sich auf ein eine dem als auch es an "
    "el los las y del por con para una su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails if ``low`` or ``high`` per mille of ``den`` are passed, for texts of ``at_least`` words."""

    name: str
    num: str
    den: str
    low: int | None
    high: int | None
    at_least: int = 0


#: The table. Bounds are in thousandths of the denominator.
RULES = (
    Rule("short_words", "word_chars", "n_words", 2000, None, 10),
    Rule("long_words", "word_chars", "n_words", None, 15000, 10),
    Rule("symbols", "n_symbols", "n_words", None, 200, 10),
    Rule("shouting", "n_bangs", "n_words", None, 300, 10),
    Rule("stop_words", "n_stop_words", "n_words", 15, None, 60),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 500, 10),
    Rule("letters", "n_letter_words", "n_words", 600, None, 10),
)


def counts(text: Column) -> Column:
    """A struct of the integer counts that the rules and the base use."""
    text = whole(text)

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated(ws).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
                F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
            ),
        )

    return let(words(text), of)


def repeated(ws: Column) -> Column:
    """How many words stand in a window of five that occurs twice or more."""
    zero = F.lit(0).cast("long")

    def marked(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            h = lambda k: F.get(p, k)["h"]
            same = lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), same)
            return F.sort_array(F.transform(at, lambda k: F.get(p, k)["i"]))

        span = lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))).cast("long")), zero, lambda a, x: a + x
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(let(order, starts), span))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) < WINDOW, zero).otherwise(let(windows, marked))


def fails(rule: Rule, m: Column) -> Column:
    num, den = m[rule.num] * 1000, m[rule.den]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (num < den * rule.low)
    if rule.high is not None:
        out = out | (num > den * rule.high)
    return out & (m["n_words"] >= rule.at_least)


def verdict(m: Column, rules=RULES) -> Column:
    """The counts with ``base_failed``, ``failed`` (names of failed rules) and ``kept``."""
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    names = F.concat_ws(",", *[F.when(fails(r, m), F.lit(r.name)) for r in rules])
    return let(
        F.struct(m.alias("m"), base.alias("b"), names.alias("f")),
        lambda x: F.struct(*[x["m"][c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], x["b"].alias("base_failed"), (~x["b"] & (x["f"] == "")).alias("kept"), x["f"].alias("failed")),
    )


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id with all counts and verdicts."""
    judged = docs.select("doc_id", let(counts(F.col("text")), lambda m: verdict(m, rules)).alias("q"))
    return judged.select("doc_id", "q.*")


def apply(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that are kept, with their columns as they were."""
    return docs.where(let(counts(F.col("text")), lambda m: verdict(m, rules))["kept"])


def _sql_rule(r: Rule) -> str:
    parts = [f"{r.num} * 1000 < {r.den} * {r.low}"] * (r.low is not None) + [f"{r.num} * 1000 > {r.den} * {r.high}"] * (r.high is not None)
    return f"case when n_words >= {r.at_least} and ({' or '.join(parts)}) then '{r.name}' end"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
with t as (select row_number() over () rid, doc_id, coalesce(text, '') as body from documents),
w as (select rid, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as ws from t),
u as (select rid, unnest(ws) as x, unnest(range(len(ws))) as i from w),
g as (select rid, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as y from u window o as (partition by rid order by i)),
k as (select rid, i, count(*) over (partition by rid, y) as c from g where y is not null),
r as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from k where c > 1) group by rid),
l as (select rid, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select rid, unnest(string_split(body, chr(10))) as x from t) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
m as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(l.n_lines, 0) as n_lines,
  len(list_filter(ws, lambda x: lower(x) in ({_STOPS}))) as n_stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_letter_words,
  length(body) - length(replace(body, '!', '')) as n_bangs
  from w left join r using (rid) left join l using (rid)),
v as (select *, (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) as base_failed,
  concat_ws(',', {', '.join(map(_sql_rule, RULES))}) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and failed = '') as kept, failed from v
"""
