"""Queries of what is kept up to date batch by batch, and of neighbours by cells, and their SQL; they join those of ``queries``."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.engines import Engine, engine
from twinspark.operators import files, ivf, metric, pairs, review
from twinspark.operators.incremental import Components, Pairs
from twinspark.plans import scan
from twinspark.plans.queries import (
    _CLUSTERS,
    _COSINE,
    _NEGATIVE,
    HASHED,
    MEMBERS,
    STORED,
    VECTOR_T,
    T,
    closure,
    edges,
    hashed_files,
    members_of,
    near,
    query,
    shown_clusters,
    stored_of,
)
from twinspark.plans.shared import folder, kept, new_store
from twinspark.plans.upkeep import _SOURCE, known_clusters
from twinspark.sources import adapters
from twinspark.sources.adapters import read

# --- neighbours by cells --------------------------------------------------------


#: The vectors of the tables here point anywhere, so neighbours are spread over most cells.
CELLS, PROBE, ROUNDS, NEIGHBOURS = 32, 20, 5, 20


def _cells_sql() -> str:
    """g: vectors on the grid; c<r>: centroids after each round; place: the cells of each vector, nearest first."""
    away = "list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w)"
    out = [
        f"g as materialized (select vec_id as id, [floor(x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])) * {ivf.SCALE}) for x in embedding] as v from embeddings)",
        f"s as materialized (select id, v from g order by md5(id::varchar), id limit {ivf.SAMPLE})",
        f"c0 as materialized (select (row_number() over (order by md5(id::varchar), id) - 1)::int as c, v as w from s order by md5(id::varchar), id limit {CELLS})",
    ]
    for r in range(ROUNDS):
        out.append(f"a{r} as materialized (select id, first(c order by {away}, c) as c from s, c{r} group by id)")
        out.append(f"m{r} as materialized (select c, i, sum(x)::hugeint as t, count(*)::hugeint as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from s join a{r} using (id)) group by c, i)")
        out.append(
            f"c{r + 1} as materialized (select c, coalesce(moved, w) as w from c{r} left join "
            f"(select c, list(((t - ((t % n) + n) % n) // n)::double order by i) as moved from m{r} group by c) using (c))"
        )
    out.append(f"place as materialized (select id, c, row_number() over (partition by id order by {away}, c) as place from g, c{ROUNDS})")
    return "with " + ", ".join(out)


_PROBED = (
    _cells_sql()
    + f""", met as (select q.id, o.id as match_id, {_COSINE} as distance from place q join place o on q.c = o.c and q.place <= {PROBE} and o.place = 1
  join embeddings a on a.vec_id = q.id join embeddings b on b.vec_id = o.id),
found as (select id, match_id, distance, row_number() over (partition by id order by distance, match_id)::int as rank from met qualify rank <= {NEIGHBOURS})"""
)


def vector_index(spark: SparkSession, d: str) -> ivf.Index:
    v = adapters.vectors(spark, d)
    return ivf.build(v, ivf.train(v, CELLS, ROUNDS), f"{folder(spark)}/cells-{uuid.uuid4().hex}")


def probed(spark: SparkSession, d: str) -> DataFrame:
    return ivf.search(adapters.vectors(spark, d), vector_index(spark, d), NEIGHBOURS, PROBE, 6)


@query(f"{_PROBED} select id, match_id, distance, rank from found")
def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest of every vector among those of the cells that it looks into."""
    return probed(spark, d)


@query(f"""{_PROBED} select least(id, match_id) as id1, greatest(id, match_id) as id2, min(distance) as distance from found
where id <> match_id and distance <= {VECTOR_T} group by all""")
def knn_cell_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.knn_pairs(probed(spark, d), VECTOR_T)


@query(f"""{_PROBED}, near as (select a.vec_id as id, b.vec_id as match_id, {_COSINE} as distance from embeddings a, embeddings b),
exact as (select id, match_id, row_number() over (partition by id order by distance, match_id) as rank from near qualify rank <= {NEIGHBOURS})
select (select count(*) from exact) as neighbours, (select count(*) from exact join found using (id, match_id)) as found,
  (select count(*) from place q join place o on q.c = o.c and q.place <= {PROBE} and o.place = 1) as compared""")
def knn_cell_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the exact neighbours how many are found, and how many pairs are compared for that."""
    v, index = kept(adapters.vectors(spark, d)), vector_index(spark, d)
    exact = kept(pairs.knn(v, v, NEIGHBOURS, 6).select("id", "match_id"))
    hits = exact.join(ivf.search(v, index, NEIGHBOURS, PROBE, 6).select("id", "match_id"), ["id", "match_id"], "left_semi")
    looked = v.select(F.explode(ivf._cell_of(index.centroids, PROBE)("embedding")).alias("cell")).groupBy("cell").count()
    size = spark.createDataFrame([(c, int(n)) for c, n in enumerate(index.sizes)], "cell int, n long")
    one = lambda df, name, value: df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name))
    out = one(exact, "neighbours", F.lit(1)).crossJoin(one(hits, "found", F.lit(1)))  # one row each
    return out.crossJoin(one(looked.join(F.broadcast(size), "cell"), "compared", F.col("n") * F.col("count")))


# --- batches ----------------------------------------------------------------------


@query(f"""with {HASHED}, last as (select id, case when id % 7 = 0 then (select phash from hashed h where h.id = files.id - 1) else phash end as phash from files
  where not contains(path, '/es/')),
n as (select id, phash, ('0x' || substr(phash, 1, 4))::int as c1, ('0x' || substr(phash, 5, 4))::int as c2, ('0x' || substr(phash, 9, 4))::int as c3,
  ('0x' || substr(phash, 13, 4))::int as c4 from last where phash is not null)
select id1 as id, count(id2) as n_links from (select a.id as id1, b.id as id2, (bit_count(xor(a.c1, b.c1)) + bit_count(xor(a.c2, b.c2)) +
  bit_count(xor(a.c3, b.c3)) + bit_count(xor(a.c4, b.c4)))::int as distance
from n a left join n b on a.id <> b.id and (bit_count(xor(a.c1, b.c1)) + bit_count(xor(a.c2, b.c2)) + bit_count(xor(a.c3, b.c3)) + bit_count(xor(a.c4,
  b.c4))) <= {T}) group by id1""")
def incremental_links(spark: SparkSession, d: str) -> DataFrame:
    """How many others each file is near: two thirds come, then the rest, then Spanish ones go and every seventh has changed to what the one before it has."""
    rows, index = hashed_files(spark, d).select("id", "path", "phash"), Pairs(new_store(spark), T, kept)
    index.update(rows.where("id % 3 < 2").select("id", "phash"))
    index.update(rows.where("id % 3 = 2").select("id", "phash"))
    changed = rows.where("id % 7 = 0").join(rows.select((F.col("id") + 1).alias("id"), F.col("phash").alias("other")), "id", "left")
    spanish = F.contains("path", F.lit("/es/"))
    index.update(changed.where(~spanish).select("id", F.col("other").alias("phash")), rows.where(spanish).select("id"))
    return index.links()


@query(f"with recursive {STORED}, {closure(_NEGATIVE)} select id, component from comp")
def incremental_components(spark: SparkSession, d: str) -> DataFrame:
    """Pairs come in two batches, and all that were marked as different are rejected with the second."""
    found = kept(near(spark, d))
    bad = stored_of(spark, d, found).where("relation_type = 'not_duplicate'")
    groups = Components(new_store(spark), kept)
    groups.update(edges(found.where("(id1 + id2) % 2 = 0")))
    groups.update(edges(found.where("(id1 + id2) % 2 = 1")), rejected=edges(bad))
    return groups.read()


@query("""with ev as (select '/u/' || user_id as path, event_id % 3 as batch, value as file_size, ts, event_id from events),
ids as (select path, row_number() over (order by min(batch), path) as id from ev group by path)
select id, path, file_size from ev join ids using (path) qualify row_number() over (partition by path order by batch desc, ts desc, event_id desc) = 1""")
def upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Users as files, upserted in three batches into a table that is kept in buckets of the path."""
    store = new_store(spark)
    new = read(spark, d, "events").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("value").alias("file_size"), F.struct("ts", "event_id").alias("seq"), "event_id")
    store.in_buckets("files", spark.createDataFrame([], "id long, path string, file_size double").schema, ["path"], 16)
    for k in range(3):
        files.upsert_into(store, new.where(F.col("event_id") % 3 == k).drop("event_id"))
    return store.read("files")


# --- any metric ---------------------------------------------------------------------


#: Pivots, and the radius of each join.
PIVOTS, EDITS = 8, 3
_PAGES = "select distinct url as value from pages where url is not null"
_HASHES = "select distinct (('0x' || phash)::ubigint) as value from files where phash is not null"


def _pivots_sql(values: str, distance: str, text: str = "value") -> str:
    """u: different values with their distances to the pivots."""
    return f"""vals as materialized ({values}), piv as materialized (select value as p, row_number() over (order by md5({text}), value) as k from vals qualify k <= {PIVOTS}),
u as materialized (select value, list({distance} order by k) as d from vals, piv group by value)"""


def _compared_sql(radius: int) -> str:
    """Pairs that are compared: the higher one's cell is visited by the lower one, or is its own, in a ring next to its own, and no pivot keeps them apart."""
    return f"""placed as (select value, d, list_position(d, list_min(d)) as cell from u),
cand as (select a.value as a, b.value as b, a.cell as own, b.cell as other from placed a join placed b on
  (a.cell = b.cell and a.value < b.value or a.cell < b.cell and b.d[a.cell] <= b.d[b.cell] + 2 * {radius})
  and len(list_filter(list_zip(a.d, b.d), lambda z: abs(z[1] - z[2]) > {radius})) = 0)"""


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("url").alias("value"))


@query(f"""with vals as ({_PAGES}) select * from (select a.value as a, b.value as b, levenshtein(a.value, b.value)::int as distance from vals a join vals b on
  a.value < b.value) where distance <= {EDITS}""")
def metric_edit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Addresses within three edits of each other."""
    urls = kept(page_urls(spark, d))
    return metric.range_join(urls, metric.edit_distance, EDITS, metric.pivots(urls, PIVOTS))


@query(f"""with {_pivots_sql(_PAGES, 'levenshtein(value, p)')}, {_compared_sql(EDITS)} select (select count(*) from vals) as different, (select count(*) *
  (count(*) - 1) // 2 from vals)::bigint as pairs, (select count(*) from cand) as compared""")
def metric_edit_pruning(spark: SparkSession, d: str) -> DataFrame:
    urls = kept(page_urls(spark, d))
    return metric.pruning(urls, metric.edit_distance, EDITS, metric.pivots(urls, PIVOTS))


@query(f"""with {HASHED}, vals as ({_HASHES}) select * from (select printf('%016x', a.value) as h1, printf('%016x', b.value) as h2, bit_count(xor(a.value,
  b.value))::int as distance from vals a join vals b on a.value < b.value) where distance <= {T}""")
def metric_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different hashes within five bits, by the operator of any metric."""
    numbers = kept(hashed_files(spark, d).select(pairs.as_number(F.col("phash")).alias("value")))
    found = metric.range_join(numbers, metric.bits_apart, T, metric.pivots(numbers, PIVOTS))
    h1, h2 = pairs.as_hex(F.col("a")), pairs.as_hex(F.col("b"))
    return found.select(F.least(h1, h2).alias("h1"), F.greatest(h1, h2).alias("h2"), "distance")


# --- a reviewer's commands --------------------------------------------------------------


@query(_CLUSTERS + f""", known as (select distinct {_SOURCE} as id, source as name from documents), top as (select max(id) as top from known),
left_ as (select id, case when id = 2 then 'renamed' else name end as name from known where id <> 1 union all select top + 1, 'kept' from top),
m as (select cluster_id, file_path from members where cluster_id <> 1 union select top + 1, path from shown, top where cluster_id = -1)
select (row_number() over (order by id))::bigint as place, id, name, (select count(*) from m where cluster_id = id) as n from left_""")
def cluster_commands(spark: SparkSession, d: str) -> DataFrame:
    """A transient cluster is kept, one is renamed, one made and unmade, one deleted, brought back and deleted again."""
    store = new_store(spark)
    store.commit(clusters=known_clusters(spark, d), cluster_members=members_of(spark, d))
    desk = review.Review(store)
    desk.persist(shown_clusters(spark, d)[0], -1, "kept")
    desk.change(2, name="renamed")
    desk.create("unmade")
    store.undo()
    desk.delete(1)
    store.undo()
    store.redo()
    return review.listed(store).select("place", "id", "name", "n")


@query(f"with {MEMBERS} select cluster_id, file_path from members where cluster_id = 3")
def cluster_members_of(spark: SparkSession, d: str) -> DataFrame:
    store = new_store(spark)
    store.commit(cluster_members=members_of(spark, d))
    return review.members_of(store, 3).select("cluster_id", "file_path")


#: Images are products of halves of random vectors, so the threshold is wide.
IMAGE_T = 14


@query(f"""with c as (select k, i, cos(pi() * (2 * i + 1) * k / 64) * sqrt(case when k = 0 then 1 else 2 end / 32) as c from range(8) a(k), range(32) b(i)),
e as (select vec_id as id, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings),
f as (select id, k, sum(c * x) as f from e join c using (i) where i < 32 group by all),
g as (select id, k, sum(c * x) as g from e join c on e.i - 32 = c.i group by all),
v as (select f.id, 8 * f.k + g.k as place, f * g as v from f join g on f.id = g.id),
m as (select id, list(v order by v)[32] as m from v group by id),
b as (select id, sum(case when v > m and place < 32 then 1::ubigint << (31 - place) else 0 end)::ubigint as hi,
  sum(case when v > m and place >= 32 then 1::ubigint << (63 - place) else 0 end)::ubigint as lo from v join m using (id) group by id)
select id1, id2, distance from (select x.id as id1, y.id as id2, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::int as distance from b x
  join b y on x.id < y.id) where distance <= {IMAGE_T}""")
def scan_images(spark: SparkSession, d: str) -> DataFrame:
    """Images from their listing to pairs by the engine for hashes, as it is shipped; pixels are there for its fingerprints only."""

    @F.pandas_udf("array<double>")
    def pixels(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.outer(*np.asarray(v, float).reshape(2, 32)).ravel() for v in vectors], dtype=object)

    path = F.concat(F.lit("/images/"), F.lpad(F.col("id").cast("string"), 12, "0"))
    images = adapters.vectors(spark, d).select(path.alias("path"), "embedding", F.lit(1.0).alias("last_modified"), F.lit(0).cast("long").alias("file_size"))
    known = spark.createDataFrame([], "id long, path string, phash string, phash_c1 int, phash_c2 int, phash_c3 int, phash_c4 int, file_size long, last_modified double")
    shipped = engine("phash")
    decoded = Engine("phash", lambda stale: shipped.fingerprint(stale.withColumn("pixels", pixels("embedding")).drop("embedding")), shipped.pairs)
    one = scan.Scan(decoded, ["/images"], IMAGE_T)
    found = one.run(images, known)
    name = lambda c, to: one.files.select(F.col("id").alias(c), F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias(to))
    return found.join(name("id1", "a"), "id1").join(name("id2", "b"), "id2").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "distance")
