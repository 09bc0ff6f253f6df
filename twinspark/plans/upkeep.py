"""Queries of scans, changes to clusters, maintenance, images and vectors, and their SQL; they join those of ``queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.engines import Engine
from twinspark.functions import hashes
from twinspark.operators import actions, clusters, files, maintenance, pairs, relations
from twinspark.operators.store import Store
from twinspark.plans import scan
from twinspark.plans.queries import _LOOSE, FILES, MEMBERS, NEAR, T, _under, loose_relations, members_of, plain_files, query
from twinspark.plans.shared import kept, new_store
from twinspark.sources import adapters
from twinspark.sources.adapters import read

_SOURCE = "regexp_extract(source, '([0-9]+)', 1)::bigint + 1"


def source_id():
    return F.regexp_extract("source", "([0-9]+)", 1).cast("bigint") + 1


def known_clusters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(source_id().alias("id"), F.col("source").alias("name"), F.lit("").alias("target_folder")).distinct()


# --- scans ------------------------------------------------------------------------


SCAN_ROOTS = [f"/src{k}" for k in range(14)]


@query(f"with {NEAR} select id1, id2, distance from near join base a on a.id = id1 join base b on b.id = id2 where {_under('a.path', SCAN_ROOTS)} and {_under('b.path', SCAN_ROOTS)}")
def scan_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A scan from its listing to the pairs inside the roots; Spanish files are known, but without a hash."""
    rows = plain_files(spark, d)
    listing = rows.select("path", F.lit(0.0).alias("last_modified"), "file_size")
    known = rows.select("id", "path", F.lit(None).cast("string").alias("phash"), *[F.lit(None).cast("int").alias(c) for c in hashes.CHUNKS], "file_size", F.lit(0.0).alias("last_modified"))
    prints = adapters.simhash(read(spark, d, "documents")).join(rows.select("id", "path"), "id").select("path", "phash")
    engine = Engine("phash", lambda stale: stale.join(prints, "path", "left"), lambda df, t: pairs.hamming_join(df, int(t)))
    return scan.Scan(engine, SCAN_ROOTS, T).run(listing, known).select("id1", "id2", "distance")


@query("select user_id, event_id, ts from events qualify row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts desc, event_id desc) = 1")
def throttled_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event of a user and day."""
    return scan.throttled(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 86400, "event_id")


@query("select event_id, (case when user_id > 0 then 100 * event_id // user_id else 0 end)::int as percent from events")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", scan.progress(F.col("event_id"), F.col("user_id")).alias("percent"))


# --- clusters and maintenance --------------------------------------------------------


@query(f"""with c as (select distinct {_SOURCE} as id, source as name from documents)
select id, case when id = 2 then 'renamed' else name end as name, case when id = 3 then '/kept' else '' end as target_folder from c where id <> 1
union all select (select max(id) + 1 from c), 'new', '/new'""")
def edit_clusters(spark: SparkSession, d: str) -> DataFrame:
    """One is made, one renamed, one gets a folder, one is deleted."""
    made, _ = clusters.create(known_clusters(spark, d), "new", "/new")
    changes = spark.createDataFrame([(2, "renamed", None), (3, None, "/kept")], "id long, name string, target_folder string")
    return clusters.delete(clusters.update(made, changes), members_of(spark, d), spark.createDataFrame([(1,)], "id long"))[0]


@query(f"""with {MEMBERS}, moved as (select case when cluster_id = 2 and file_path like '%/de/%' then 3 else cluster_id end as cluster_id, file_path from members)
select cluster_id, file_path from moved where cluster_id <> 1 and not (cluster_id = 5 and file_path like '%/es/%')
union select {_SOURCE}, '/' || source || '/' || lang || '/' || doc_id || '.txt' from documents join labels using (doc_id) where toxic = 1""")
def edit_members(spark: SparkSession, d: str) -> DataFrame:
    """German files of cluster 2 go to 3, cluster 1 is deleted, Spanish files of 5 are removed, toxic files become members."""
    m = members_of(spark, d)
    moves = m.where((F.col("cluster_id") == 2) & F.col("file_path").contains("/de/")).select("file_path", F.lit(2).cast("long").alias("from_id"), F.lit(3).cast("long").alias("to_id"))
    m = clusters.delete(known_clusters(spark, d), clusters.move_member(m, moves), spark.createDataFrame([(1,)], "id long"))[1]
    m = clusters.remove_members(m, m.where((F.col("cluster_id") == 5) & F.col("file_path").contains("/es/")))
    toxic = read(spark, d, "documents").join(read(spark, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return clusters.add_members(m, toxic.select(source_id().alias("cluster_id"), adapters.doc_path().alias("file_path")))


@query(f"""with {FILES}, {_LOOSE}, {MEMBERS}, here as (select id, path from base where path not like '%/es/%')
select 'files' as name, (select count(*) from base) - (select count(*) from here) as gone
union all select 'status', count(*) from base where id % 2 = 0 and path not in (select path from here)
union all select 'members', count(*) from members where file_path not in (select path from here)
union all select 'relations', count(*) from loose where id1 not in (select id from here) or id2 not in (select id from here)
union all select 'clusters', count(*) from (select distinct {_SOURCE} as id from documents) where id not in (select cluster_id from members where file_path in (select path from here))""")
def maintain(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the Spanish files when they are missing."""
    rows = plain_files(spark, d)
    listing = rows.where(~F.col("path").contains("/es/"))
    status = rows.where("id % 2 = 0").select("path", F.lit("clip").alias("engine"))
    counts = files.maintain(rows, listing, loose_relations(spark, d), members_of(spark, d), known_clusters(spark, d), status)[1]
    return spark.createDataFrame(list(counts.items()), "name string, gone long")


@query("""select doc_id as id, coalesce(min(case when not hidden then doc_id end) over (partition by source order by doc_id rows between current row and
  unbounded following), -1) as next_visible, coalesce(max(case when not hidden then doc_id end) over (partition by source order by doc_id rows between
  unbounded preceding and current row), -1) as previous_visible from (select doc_id, source, lang = 'es' as hidden from documents)""")
def visible_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Spanish documents are hidden; the nearest other document of their source."""
    rows = read(spark, d, "documents").select("source", F.col("doc_id").alias("id"), "lang")
    return relations.visible_neighbours(rows, "source", "id", F.col("lang") == "es").select("id", "next_visible", "previous_visible")


@query("select event_id, ts is not null and event_type <> 'error' as kept, true as stamped from events")
def stamp_times(spark: SparkSession, d: str) -> DataFrame:
    """Errors come without a time and get one."""
    rows = read(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("ts")).alias("created_at"))
    return relations.stamped(rows).select("event_id", F.equal_null("created_at", "ts").alias("kept"), F.col("created_at").isNotNull().alias("stamped"))


@query("select id from (select distinct event_id as id from events) where id not in (select doc_id from documents) order by id limit 10")
def first_missing(spark: SparkSession, d: str) -> DataFrame:
    """The ten first ids without a file, as a report; the limit is its feature."""
    wanted = read(spark, d, "events").select(F.col("event_id").alias("id"))
    return actions.first_of(files.missing_ids(plain_files(spark, d), wanted), 10, "id")


# --- configuration, images and vectors --------------------------------------------------


@query("select event_type as device_id, 32 as phash, floor(value)::int as clip, 8 as blip, 16 as mobilenet from events")
def config_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Configurations written as JSON and read again; an unknown engine goes, missing ones get their size."""
    sizes = F.create_map(F.lit("clip"), F.floor("value").cast("int"), F.lit("unknown"), F.lit(1))
    return adapters.config(spark, read(spark, d, "events").select(adapters.config_json(F.col("event_type"), sizes).alias("json")))


@query("select event_id, case event_id % 5 when 0 then 'mobilenet' when 1 then 'blip' when 2 then 'clip' else 'phash' end as engine from events")
def engine_names(spark: SparkSession, d: str) -> DataFrame:
    """The long names of engines, with the type of an event in them."""
    long = F.element_at(F.array(*[F.lit(n) for n in ("MobileNetV3", "BLIP-large", "CLIP ViT-B/32", "pHash", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", adapters.engine_name(F.concat("event_type", F.lit(" "), long)).alias("engine"))


@query("select event_id, bit_count(user_id)::int as bits from events")
def popcounts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", hashes.popcount(F.col("user_id")).alias("bits"))


@query("""with e as (select vec_id as id, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings),
n as (select id, sqrt(sum(x * x)) as n from e group by id) select id, i, round(x / n, 6) + 0::double as x from e join n using (id)""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.vectors(spark, d).select("id", F.posexplode(hashes.l2_normalised(F.col("embedding"))).alias("i", "x"))
    return rows.select("id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("""with c as (select k, i, cos(pi() * (2 * i + 1) * k / 64) * sqrt(case when k = 0 then 1 else 2 end / 32) as c from range(8) a(k), range(32) b(i)),
e as (select vec_id as id, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings),
f as (select id, k, sum(c * x) as f from e join c using (i) where i < 32 group by all),
g as (select id, k, sum(c * x) as g from e join c on e.i - 32 = c.i group by all)
select f.id, 8 * f.k + g.k as place, round(f * g, 5) + 0::double as value from f join g on f.id = g.id""")
def dct_low(spark: SparkSession, d: str) -> DataFrame:
    """Images that are products of the two halves of a vector; their lowest frequencies."""
    half = lambda start: F.slice("embedding", start, 32)
    pixels = F.flatten(F.transform(half(1), lambda x: F.transform(half(33), lambda y: x.cast("double") * y.cast("double"))))
    images = kept(adapters.vectors(spark, d).select("id", pixels.alias("pixels")))
    rows = images.select("id", hashes.low_frequencies(F.col("pixels")).alias("low"))
    places = rows.select("id", "low", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
    return places.select("id", F.col("place").cast("long").alias("place"), (F.round(F.get("low", "place"), 5) + F.lit(0.0)).alias("value"))


@query("""with e as (select vec_id as id, i, abs(floor(100 * embedding[i + 1])::int - floor(100 * embedding[i + 33])::int) as x from embeddings, range(32) r(i)),
m as (select id, min(x) as low, max(x) as high from e group by id) select id, i, (case when high > low then (x - low) * 255 // (high - low) else 0 end)::int as x from e join m using (id)""")
def pixel_contrast(spark: SparkSession, d: str) -> DataFrame:
    """The difference of the two halves of a vector as grey values, stretched; components are floats and stay so, as in SQL."""
    grey = lambda start: F.transform(F.slice("embedding", start, 32), lambda x: F.floor((x * F.lit(100).cast("float")).cast("float")).cast("int"))
    rows = adapters.vectors(spark, d).select("id", F.posexplode(hashes.autocontrast(hashes.pixel_difference(grey(1), grey(33)))).alias("i", "x"))
    return rows.select("id", F.col("i").cast("long").alias("i"), "x")


def _resized_sql(rows: int, columns: int, to_rows: int, to_columns: int) -> str:
    """wr, wc: weights of the old rows and columns in the new ones."""
    out = []
    for name, n, m in (("wr", rows, to_rows), ("wc", columns, to_columns)):
        wide = max(n / m, 1.0)
        out.append(f"""{name}0 as (select o, i, abs((i + 0.5 - (o + 0.5) * {n / m}) / {wide}) as x from range({m}) a(o), range({n}) b(i)),
{name}1 as (select o, i, case when x < 1 then (1.5 * x - 2.5) * x * x + 1 when x < 2 then (((x - 5) * x + 8) * x - 4) * -0.5 else 0 end as w from {name}0),
{name} as (select o, i, w / sum(w) over (partition by o) as w from {name}1)""")
    return ", ".join(out)


_GREY = "least(greatest(floor(128 + 400 * embedding[{0}]::double), 0), 255)::int"


@query(f"""with {_resized_sql(5, 3, 4, 4)}, ch as (select vec_id as id, embedding, ch from embeddings, range(3) c(ch)),
l as (select id, ch, p, {_GREY.format('16 * ch + p + 1')} as v from ch, range(16) a(p)),
r as (select id, ch, p // 3 as r, p % 3 as c, {_GREY.format('19 + 15 * ch + p + 1')} as v from ch, range(15) a(p)),
s as (select id, ch, 4 * wr.o + wc.o as p, floor(least(greatest(sum(v * wr.w * wc.w), 0), 255) + 0.5)::int as v from r join wr on wr.i = r.r join wc
  on wc.i = r.c group by id, ch, wr.o, wc.o),
f as (select id, p, (sum(abs(l.v - s.v) * case ch when 0 then 299 when 1 then 587 else 114 end) + 500)::bigint // 1000 as x from l join s using (id,
  ch, p) group by id, p),
m as (select id, min(x) as low, max(x) as high from f group by id)
select id, p as i, (case when high > low then (x - low) * 255 // (high - low) else 0 end)::int as x from f join m using (id)""")
def image_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Two images of three channels from a vector, 4 x 4 and 5 x 3, that are brought to one size and compared."""
    value = lambda x: F.least(F.greatest(F.floor(128 + 400 * x.cast("double")), F.lit(0)), F.lit(255)).cast("int")
    part = lambda start, n: F.transform(F.slice("embedding", start + 1, n), value)
    difference = hashes.image_difference([part(16 * c, 16) for c in range(3)], [part(19 + 15 * c, 15) for c in range(3)], (4, 4), (5, 3))
    rows = adapters.vectors(spark, d).select("id", F.posexplode(difference).alias("i", "x"))
    return rows.select("id", F.col("i").cast("long").alias("i"), "x")


@query("select event_id, greatest(1, event_id // (4 * (user_id + 1)))::bigint as chunk from events")
def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", scan.chunk_size(F.col("event_id"), F.col("user_id") + 1).alias("chunk"))


@query(f"""with {FILES}, {_LOOSE}, {MEMBERS}, here as (select id, path from base where path not like '%/es/%'),
m as (select * from members where file_path in (select path from here))
select 'files' as name, path as key, id from here
union all select 'vector_index_status', path, null from here where id % 2 = 0
union all select 'cluster_members', file_path, cluster_id from m
union all select 'file_relations', id1::varchar, id2 from loose where id1 in (select id from here) and id2 in (select id from here)
union all select 'clusters', source, id from (select distinct {_SOURCE} as id, source from documents) where id in (select cluster_id from m)""")
def maintained_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that maintenance leaves when Spanish files are missing: stopped after its third step, then taken up by another writer."""
    store, rows = new_store(spark), plain_files(spark, d)
    store.commit(
        files=rows,
        vector_index_status=rows.where("id % 2 = 0").select("path", F.lit("clip").alias("engine")),
        cluster_members=members_of(spark, d),
        file_relations=loose_relations(spark, d),
        clusters=known_clusters(spark, d),
    )
    listing, asked = rows.where(~F.col("path").contains("/es/")), []
    maintenance.Maintenance(store, listing).run(lambda: asked.append(0) or len(asked) > 3)
    again = Store(spark, store.root)
    maintenance.Maintenance(again, listing).run()
    key = {"files": ("path", "id"), "vector_index_status": ("path", F.lit(None)), "cluster_members": ("file_path", "cluster_id"), "file_relations": (F.col("id1").cast("string"), "id2"), "clusters": ("name", "id")}
    column = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [again.read(t).select(F.lit(t).alias("name"), column(a).alias("key"), column(b).cast("long").alias("id")) for t, (a, b) in key.items()]
    return reduce(DataFrame.unionByName, parts)


@query("select vec_id as id, case when label = 1 then -embedding[1] else embedding[1] end as first from embeddings")
def upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of one label are stored anew, with their signs turned."""
    rows = read(spark, d, "embeddings").withColumn("path", F.col("vec_id").cast("string")).withColumn("engine", F.lit("clip"))
    new = rows.where("label = 1").select("path", "engine", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("seq"))
    out = files.upsert_vectors(rows.select("path", "engine", "embedding"), new)
    return out.select(F.col("path").cast("long").alias("id"), F.get("embedding", F.lit(0)).alias("first"))
