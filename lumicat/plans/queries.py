"""Registered queries of the catalog engine, each beside the SQL that a reference database runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat import config as C
from lumicat.functions import scalars as S
from lumicat.operators import catalog as K
from lumicat.operators import dedup as D
from lumicat.operators import listing as L
from lumicat.operators import naming as N
from lumicat.sources import sidecar
from lumicat.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SCORE_MODEL, EMBEDDING_MODEL = C.DEFAULT.score_model, C.DEFAULT.embedding_model
#: No pair of the supplied vectors is nearer than 1e-4 to this threshold.
THRESHOLD = 0.45

FIXTURES = f"""
WITH RECURSIVE photos AS (
  SELECT sha256(text) AS id, '/shoot/' || source || '/' || doc_id || '/IMG_' || (doc_id % 50) || '.CR3' AS source_path,
    n_chars AS file_size,
    greatest({C.MTIME_MIN}, least({C.MTIME_MAX}, 700000000 + doc_id * 4000000)) AS mtime_unix_seconds,
    CASE WHEN 700000000 + doc_id * 4000000 BETWEEN {C.MTIME_MIN} AND {C.MTIME_MAX} THEN 0 ELSE 1 END AS mtime_anomalous,
    CASE WHEN lang IN ('en', 'de') THEN 'Canon' WHEN lang = 'fr' THEN 'Acme' END AS make,
    CASE lang WHEN 'en' THEN 'EOS R8' WHEN 'de' THEN 'EOS R5' WHEN 'fr' THEN 'X1' END AS model,
    CASE WHEN lang = 'en' THEN 'canon-r8' END AS camera_slug,
    CASE WHEN doc_id % 11 <> 0 THEN 1700000000 + doc_id * 3600 END AS capture_time_unix_seconds,
    CASE WHEN doc_id % 13 <> 0 THEN 4000 + (doc_id % 3) * 1000 END AS width,
    CASE WHEN doc_id % 13 <> 0 THEN 5000 END AS height,
    1 + doc_id % 8 AS exif_orientation,
    CAST(1780000000 + floor(doc_id / 10) AS BIGINT) AS ingested_at_unix_seconds,
    CASE WHEN doc_id % 17 = 0 THEN 1790000000 END AS superseded_at_unix_seconds, doc_id
  FROM documents
), active AS (SELECT * FROM photos WHERE superseded_at_unix_seconds IS NULL),
scores AS (SELECT doc_id, '{SCORE_MODEL}' AS model_slug, 1.0::DOUBLE + ((doc_id * 37) % 901) / 100.0::DOUBLE AS aesthetic_score, 1780001000 + doc_id AS scored_at_unix_seconds FROM labels),
clusters AS (SELECT vec_id AS doc_id, '{EMBEDDING_MODEL}' AS model_slug, vec_id % 7 AS cluster_id, 0.45::DOUBLE AS similarity_threshold FROM embeddings WHERE vec_id % 3 = 0),
vectors AS (SELECT vec_id AS doc_id, '{EMBEDDING_MODEL}' AS model_slug, len(embedding) AS dim, embedding FROM embeddings),
develop AS (
  SELECT a.*, s.aesthetic_score, c.cluster_id FROM active a
  LEFT JOIN scores s ON s.doc_id = a.doc_id AND s.model_slug = '{SCORE_MODEL}'
  LEFT JOIN clusters c ON c.doc_id = a.doc_id AND c.model_slug = '{EMBEDDING_MODEL}'
)"""

TIER_SQL = "CASE WHEN f < 4 THEN 'discard' WHEN f < 5.5 THEN 'poor' WHEN f < 7 THEN 'fair' WHEN f < 8.5 THEN 'good' WHEN f IS NOT NULL THEN 'excellent' END"
RATING_SQL = "CASE WHEN f < 4 THEN 1 WHEN f < 5.5 THEN 2 WHEN f < 7 THEN 3 WHEN f < 8.5 THEN 4 WHEN f IS NOT NULL THEN 5 END"


def query(sql: str | None = None, fixtures: bool = True):
    """Register a query under its function's name, with SQL over the derived tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (FIXTURES + sql) if fixtures else sql
        return f

    return register


def _photos(s, d):
    return T.photos(s, d)


def _develop(s: SparkSession, d: str) -> DataFrame:
    return K.develop_rows(T.photos(s, d), T.scores(s, d), T.clusters(s, d), SCORE_MODEL, EMBEDDING_MODEL, "doc_id", "doc_id")


# --- views and incremental work -----------------------------------------------------------------

_COLS = ", ".join(K.PHOTO_COLUMNS)


@query(f" SELECT {_COLS} FROM active")
def active_photos(s, d):
    return K.photo_rows(K.active(_photos(s, d)))


@query(f" SELECT {_COLS} FROM photos")
def all_rows(s, d):
    return K.photo_rows(_photos(s, d)).orderBy("ingested_at_unix_seconds", "id", "source_path")


@query(f" SELECT doc_id, id, source_path FROM active a WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.doc_id = a.doc_id AND s.model_slug = '{SCORE_MODEL}')")
def work_unscored(s, d):
    return K.unprocessed(_photos(s, d), T.scores(s, d), SCORE_MODEL, "doc_id", "doc_id").select("doc_id", "id", "source_path")


@query(f" SELECT doc_id, id, source_path FROM active a WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.doc_id = a.doc_id AND v.model_slug = '{EMBEDDING_MODEL}')")
def work_unembedded(s, d):
    return K.unprocessed(_photos(s, d), T.embeddings(s, d), EMBEDDING_MODEL, "doc_id", "doc_id").select("doc_id", "id", "source_path")


@query(" SELECT doc_id, id, source_path, ingested_at_unix_seconds, aesthetic_score, cluster_id FROM develop")
def develop_rows(s, d):
    cols = ("doc_id", "id", "source_path", "ingested_at_unix_seconds", "aesthetic_score", "cluster_id")
    return _develop(s, d).select(*cols).orderBy("ingested_at_unix_seconds", "id", "doc_id")


@query(f" SELECT a.doc_id, a.source_path, v.dim FROM active a JOIN vectors v ON v.doc_id = a.doc_id WHERE v.model_slug = '{EMBEDDING_MODEL}'")
def embedding_rows(s, d):
    e = T.embeddings(s, d).select(F.col("doc_id").alias("photo_id"), "model_slug", "dim")
    return K.embedding_rows(_photos(s, d), e, EMBEDDING_MODEL, "doc_id").select("doc_id", "source_path", "dim")


# --- scores --------------------------------------------------------------------------------------


@query(f", n AS (SELECT doc_id, aesthetic_score::FLOAT::DOUBLE AS f FROM develop) SELECT doc_id, {RATING_SQL} AS rating, {TIER_SQL} AS tier FROM n")
def rating_tier(s, d):
    return _develop(s, d).select("doc_id", S.rating(F.col("aesthetic_score")).alias("rating"), S.tier(F.col("aesthetic_score")).alias("tier"))


@query(", n AS (SELECT doc_id, aesthetic_score::FLOAT::DOUBLE AS f FROM develop) SELECT doc_id, CASE WHEN f < 4 THEN 'Red' WHEN f >= 7 THEN 'Green' WHEN f IS NOT NULL THEN '' END AS color_label FROM n")
def color_label(s, d):
    return _develop(s, d).select("doc_id", S.color_label(F.col("aesthetic_score")).alias("color_label"))


@query(" SELECT doc_id, format('{:05.2f}', aesthetic_score::FLOAT::DOUBLE) AS score_label FROM scores")
def score_label(s, d):
    return T.scores(s, d).select("doc_id", S.two_decimals(F.col("aesthetic_score")).alias("score_label"))


@query(" SELECT doc_id, aesthetic_score FROM scores ORDER BY aesthetic_score DESC, doc_id LIMIT 25")
def top_scores(s, d):
    return T.scores(s, d).select("doc_id", "aesthetic_score").orderBy(F.desc("aesthetic_score"), "doc_id").limit(25)


@query(", b AS (SELECT doc_id, [(1 + (doc_id * (i + 3)) % 17) / 10.0::DOUBLE for i in range(10)] AS p FROM labels), q AS (SELECT doc_id, p, list_sum(p) AS t FROM b) SELECT doc_id, round(list_sum([p[i + 1] / t * (i + 1) for i in range(10)]), 9) AS mean_score FROM q")
def weighted_mean(s, d):
    bins = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (1 + (F.col("doc_id") * (i + 3)) % 17) / F.lit(10.0))
    rows = T.read(s, d, "labels").select("doc_id", bins.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.round(S.weighted_mean(F.transform("p", lambda x: x / total)), 9).alias("mean_score"))


# --- listings --------------------------------------------------------------------------------------


@query(" SELECT count(*) AS all_rows, count(*) FILTER (WHERE superseded_at_unix_seconds IS NULL) AS active_rows FROM photos")
def count_photos(s, d):
    return L.counts(_photos(s, d))


_UTC = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


@query(f" SELECT camera_slug, count(*) AS n, {_UTC.format('min(capture_time_unix_seconds)')} AS first_capture, {_UTC.format('max(capture_time_unix_seconds)')} AS last_capture FROM active GROUP BY 1")
def by_camera(s, d):
    return L.by_camera(_photos(s, d))


def _listing_sql(order: str, limit: int) -> str:
    return f""" SELECT p.source_path, p.ingested_at_unix_seconds, p.capture_time_unix_seconds, s.aesthetic_score,
      CASE WHEN p.superseded_at_unix_seconds IS NULL THEN 'active' ELSE 'superseded' END AS state,
      {_UTC.format('p.capture_time_unix_seconds')} AS captured, p.width::VARCHAR || 'x' || p.height::VARCHAR AS size, printf('%.4f', s.aesthetic_score) AS score_text
    FROM photos p LEFT JOIN scores s ON s.doc_id = p.doc_id ORDER BY {order}, p.source_path LIMIT {limit}"""


@query(_listing_sql("s.aesthetic_score DESC NULLS LAST", 50))
def list_topk_score(s, d):
    return L.listing(_photos(s, d), T.scores(s, d), SCORE_MODEL, "score", 50, "doc_id", "doc_id")


@query(_listing_sql("p.capture_time_unix_seconds ASC NULLS FIRST", 50))
def list_by_capture(s, d):
    return L.listing(_photos(s, d), T.scores(s, d), SCORE_MODEL, "capture", 50, "doc_id", "doc_id")


@query(_listing_sql("p.ingested_at_unix_seconds ASC NULLS FIRST", 10))
def list_by_ingest(s, d):
    return L.listing(_photos(s, d), T.scores(s, d), SCORE_MODEL, "ingested", 10, "doc_id", "doc_id")


@query(_listing_sql("p.source_path", 1_000_000_000))
def list_by_path(s, d):
    return L.listing(_photos(s, d), T.scores(s, d), SCORE_MODEL, "path", 0, "doc_id", "doc_id")


@query(" SELECT bool_or(aesthetic_score IS NOT NULL) AS any_score, bool_or(cluster_id IS NOT NULL) AS any_cluster FROM develop")
def existence_flags(s, d):
    return L.has_any(_photos(s, d), T.scores(s, d), T.clusters(s, d), SCORE_MODEL, EMBEDDING_MODEL, "doc_id", "doc_id")


@query(" SELECT count(*) AS total, CASE WHEN count(*) > 50 THEN 'Showing 50 of ' || count(*) ELSE 'Showing ' || count(*) || ' of ' || count(*) END AS line FROM photos")
def listing_total(s, d):
    n = F.count("*")
    text = F.when(n > 50, F.concat(F.lit("Showing 50 of "), n.cast("string"))).otherwise(F.concat(F.lit("Showing "), n.cast("string"), F.lit(" of "), n.cast("string")))
    return _photos(s, d).agg(n.alias("total"), text.alias("line"))


# --- metadata --------------------------------------------------------------------------------------


@query(f" SELECT doc_id, greatest({C.MTIME_MIN}, least({C.MTIME_MAX}, doc_id * 4000000)) AS mtime, doc_id * 4000000 NOT BETWEEN {C.MTIME_MIN} AND {C.MTIME_MAX} AS anomalous FROM documents", fixtures=False)
def mtime_clamp(s, d):
    m = F.col("doc_id") * 4000000
    return T.read(s, d, "documents").select("doc_id", S.clamp_mtime(m).alias("mtime"), S.mtime_anomalous(m).alias("anomalous"))


@query(""" SELECT doc_id, CASE WHEN w > h THEN 'landscape' WHEN w < h THEN 'portrait' WHEN w = h THEN 'square' END AS aspect
 FROM (SELECT doc_id, CASE WHEN exif_orientation >= 5 THEN height ELSE width END AS w, CASE WHEN exif_orientation >= 5 THEN width ELSE height END AS h FROM photos)""")
def aspect(s, d):
    return _photos(s, d).select("doc_id", S.aspect(F.col("width"), F.col("height"), F.col("exif_orientation")).alias("aspect"))


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 1 WHEN 3 THEN 3 WHEN 5 THEN 8 WHEN 6 THEN 6 END AS from_flip, CASE WHEN doc_id % 11 BETWEEN 1 AND 8 THEN doc_id % 11 END AS from_tag FROM documents", fixtures=False)
def orientation_map(s, d):
    return T.read(s, d, "documents").select("doc_id", S.flip_to_orientation(F.col("doc_id") % 8).alias("from_flip"), S.valid_orientation(F.col("doc_id") % 11).alias("from_tag"))


@query(" SELECT doc_id, CASE WHEN make = 'Canon' AND model = 'EOS R8' THEN 'canon-r8' END AS found_slug FROM photos")
def camera_lookup(s, d):
    padded = _photos(s, d).withColumn("make", F.concat(F.lit(" "), "make", F.lit("\x00\x00"))).withColumn("model", F.concat("model", F.lit(" ")))
    return K.camera_lookup(padded, T.cameras(s)).select("doc_id", "found_slug")


@query(" SELECT make, model, min(ingested_at_unix_seconds) AS first_seen, count(*) AS n FROM photos WHERE make IS NOT NULL AND NOT (make = 'Canon' AND model = 'EOS R8') GROUP BY ALL")
def unknown_cameras(s, d):
    return K.unknown_cameras(K.camera_lookup(_photos(s, d), T.cameras(s)))


@query(" SELECT doc_id, make IS NULL AND model IS NULL AND capture_time_unix_seconds IS NULL AND width IS NULL AND height IS NULL AS exif_empty FROM photos")
def exif_empty(s, d):
    cols = ("make", "model", "capture_time_unix_seconds", "width", "height")
    return _photos(s, d).select("doc_id", F.expr(" AND ".join(f"{c} IS NULL" for c in cols)).alias("exif_empty"))


@query(" SELECT doc_id, translate(rtrim(to_base64(unhex(id)), '='), '+/', '-_') AS id_text FROM photos")
def photo_id_text(s, d):
    return _photos(s, d).select("doc_id", S.id_text(F.unhex("id")).alias("id_text"))


def _low_first(x: str) -> str:
    """SQL of a number's 8 bytes, low byte first."""
    return "unhex(" + " || ".join(f"substr(lpad(to_hex(({x})::BIGINT), 16, '0'), {15 - 2 * i}, 2)" for i in range(8)) + ")"


@query(f"""WITH c AS (SELECT doc_id, encode(repeat(text, 8)) AS b, doc_id * 4000000 AS mtime FROM documents), n AS (SELECT *, octet_length(b) AS n FROM c),
 k AS (SELECT *, greatest(n - {C.WINDOW_BYTES}, least(n, {C.WINDOW_BYTES})) AS tail FROM n)
 SELECT doc_id, sha256({_low_first('n')} || {_low_first(f'greatest({C.MTIME_MIN}, least({C.MTIME_MAX}, mtime))')} || array_slice(b, 1, least(n, {C.WINDOW_BYTES})) || CASE WHEN tail < n THEN array_slice(b, tail + 1, n) ELSE ''::BLOB END) AS content_id FROM k""", fixtures=False)
def content_ids(s, d):
    body = F.repeat("text", F.lit(8))  # long enough that some files have a middle that isn't read
    return T.read(s, d, "documents").select("doc_id", S.content_id(F.octet_length(body), F.col("doc_id") * 4000000, body.cast("binary")).alias("content_id"))


@query(" SELECT doc_id, length(id) = 64 AND doc_id % 4 = 0 AS valid FROM photos")
def id_valid(s, d):
    i = F.col("id")
    broken = F.element_at(F.array(i, F.substring(i, 1, 62), F.upper(F.concat(F.substring(i, 1, 63), F.lit("a"))), F.concat(i, F.lit("\n"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _photos(s, d).select("doc_id", K.valid_id(broken).alias("valid"))


@query(" SELECT id, count(*) AS n, min(doc_id) AS first_doc FROM photos GROUP BY id HAVING count(*) > 1")
def exact_dup_ids(s, d):
    return _photos(s, d).groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


# --- writes -----------------------------------------------------------------------------------------

_SPLIT = """, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_path) AS k FROM photos WHERE doc_id % 3 = 0) WHERE k = 1),
batch AS (SELECT *, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN (SELECT max(o.source_path) FROM old o WHERE o.doc_id = photos.doc_id - photos.doc_id % 3) ELSE source_path END AS new_path FROM photos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY new_path, ingested_at_unix_seconds) AS nth FROM batch),
fresh AS (SELECT r.*, r.nth = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.id = r.id) AS is_new FROM ranked r),
judged AS (
  SELECT f.id, f.new_path AS source_path, f.is_new, f.ingested_at_unix_seconds,
    CASE WHEN f.is_new THEN coalesce(lag(f.id) OVER w, o.id) END AS before,
    CASE WHEN f.is_new THEN lead(f.id) OVER w IS NULL END AS last
  FROM fresh f LEFT JOIN old o ON o.source_path = f.new_path AND o.superseded_at_unix_seconds IS NULL
  WINDOW w AS (PARTITION BY f.new_path, f.is_new ORDER BY f.ingested_at_unix_seconds, f.id)
)"""


def _upsert(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _photos(s, d)
    old = K.one_per_id(p.where("doc_id % 3 = 0").select("doc_id", *K.PHOTO_COLUMNS)).where("nth = 1").drop("nth")  # without a path, the least doc_id
    target = old.groupBy(F.col("doc_id").alias("t_doc")).agg(F.max("source_path").alias("t_path"))  # a row for each, as doc_ids may repeat
    batch = p.join(target, F.col("doc_id") - F.col("doc_id") % 3 == F.col("t_doc"), "left")
    moved = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 3 != 0)
    batch = batch.withColumn("source_path", F.when(moved, F.col("t_path")).otherwise(F.col("source_path"))).drop("t_doc", "t_path")
    return K.upsert(old.select(*K.PHOTO_COLUMNS), batch.select(*K.PHOTO_COLUMNS), 1795000000)


@query(_SPLIT + " SELECT id, source_path, CASE WHEN NOT is_new THEN 'already_catalogued' WHEN before IS NULL THEN 'inserted' ELSE 'superseded_previous' END AS outcome, before AS superseded_id FROM judged")
def upsert_outcomes(s, d):
    return _upsert(s, d)[0]


@query(_SPLIT + """ SELECT id, source_path, CASE WHEN superseded_at_unix_seconds IS NULL AND EXISTS (SELECT 1 FROM judged j WHERE j.is_new AND j.source_path = old.source_path) THEN 1795000000 ELSE superseded_at_unix_seconds END AS superseded_at_unix_seconds FROM old
 UNION ALL SELECT id, source_path, CASE WHEN NOT last THEN 1795000000 END FROM judged WHERE is_new""")
def catalog_after_upsert(s, d):
    return _upsert(s, d)[1].select("id", "source_path", "superseded_at_unix_seconds")


@query("""SELECT event_id, user_id, row_number() OVER w AS version, lead(ts) OVER w AS replaced_at, lead(ts) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", fixtures=False)
def supersede_chain(s, d):
    return K.version_history(T.read(s, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "version", "replaced_at", "is_current")


_SCORE_BATCH = """, have AS (SELECT doc_id AS photo_id FROM scores WHERE doc_id % 2 = 0),
batch AS (SELECT doc_id AS photo_id, k, (doc_id % 13)::DOUBLE + k AS score, 1000 + k AS written FROM labels, (VALUES (0), (1)) t(k)),
r AS (SELECT *, (score BETWEEN 1 AND 10) AS ok, row_number() OVER (PARTITION BY (score BETWEEN 1 AND 10), photo_id ORDER BY written, score) AS nth FROM batch)"""


@query(_SCORE_BATCH + " SELECT photo_id, score AS aesthetic_score, CASE WHEN NOT ok THEN 'rejected' WHEN nth > 1 OR EXISTS (SELECT 1 FROM have h WHERE h.photo_id = r.photo_id) THEN 'already_there' ELSE 'inserted' END AS outcome FROM r")
def insert_ignore(s, d):
    have = T.scores(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("photo_id"), "model_slug", "aesthetic_score", "scored_at_unix_seconds")
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    batch = T.read(s, d, "labels").select(F.col("doc_id").alias("photo_id"), k).select(
        "photo_id", F.lit(SCORE_MODEL).alias("model_slug"), ((F.col("photo_id") % 13).cast("double") + F.col("k")).alias("aesthetic_score"), (1000 + F.col("k")).cast("long").alias("scored_at_unix_seconds")
    )
    return K.insert_scores(have, batch)[0].select("photo_id", "aesthetic_score", "outcome")


@query(" SELECT doc_id AS photo_id, CASE WHEN doc_id % 4 = 0 THEN 'rejected' WHEN doc_id % 2 = 0 THEN 'already_there' ELSE 'inserted' END AS outcome FROM vectors")
def insert_embeddings(s, d):
    e = T.embeddings(s, d).withColumnRenamed("doc_id", "photo_id").withColumn("embedded_at_unix_seconds", F.lit(1).cast("long"))
    batch = e.withColumn("dim", F.when(F.col("photo_id") % 4 == 0, F.col("dim") + 1).otherwise(F.col("dim")))
    return K.insert_embeddings(e.where("photo_id % 2 = 0"), batch)[0].select("photo_id", "outcome")


@query(" SELECT doc_id AS photo_id, cluster_id FROM clusters WHERE doc_id % 2 <> 0 UNION ALL SELECT doc_id, 100 + doc_id FROM clusters WHERE doc_id % 2 = 0")
def replace_clusters(s, d):
    old = T.clusters(s, d).withColumnRenamed("doc_id", "photo_id")
    new = old.where("photo_id % 2 = 0").withColumn("cluster_id", 100 + F.col("photo_id"))
    return K.replace_clusters(old, new).select("photo_id", "cluster_id")


@query(" SELECT v.doc_id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.doc_id = v.doc_id)")
def fk_violations(s, d):
    return K.reference_violations(T.embeddings(s, d), "doc_id", K.active(_photos(s, d)), "doc_id").select("doc_id")


@query(" SELECT id, count(*) AS n FROM photos GROUP BY id HAVING count(*) > 1")
def pk_violations(s, d):
    return K.key_violations(_photos(s, d), ["id"])


# --- duplicates -----------------------------------------------------------------------------------------


@query(" SELECT doc_id, dim BETWEEN 1 AND 65536 AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) BETWEEN 0.99 AND 1.01 AS valid FROM vectors")
def embedding_valid(s, d):
    e = T.embeddings(s, d)
    ok = K.valid_embedding(F.col("embedding"), F.col("dim")) & S.norm(F.col("embedding")).between(C.NORM_MIN, C.NORM_MAX)
    return e.select("doc_id", ok.alias("valid"))


_PAIRS = f""", pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD}),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, CASE WHEN p.a = r.other THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON r.other IN (p.a, p.b)),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@query(_PAIRS + " SELECT a, b, round(sim, 6) AS similarity FROM pairs")
def similar_pairs(s, d):
    return D.similar_pairs(T.read(s, d, "embeddings"), THRESHOLD).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    rows = T.read(s, d, "embeddings").withColumn("ingested_at", 1000 - F.floor(F.col("vec_id") / 10)).withColumn("id", F.col("vec_id"))
    return D.threshold_clusters(D.valid_embeddings(rows), THRESHOLD, ["ingested_at", "id"])


_NUMBERED = _PAIRS + """, firsts AS (SELECT component, min((1000 - floor(id / 10)) * 1000000000 + id) AS first, count(*) AS cluster_size FROM comp GROUP BY component),
numbered AS (SELECT component, cluster_size, row_number() OVER (ORDER BY first, component) - 1 AS cluster_id FROM firsts)"""


@query(_PAIRS + " SELECT id, component FROM comp")
def dup_components(s, d):
    return _clusters(s, d).select("id", "component")


@query(_NUMBERED + " SELECT c.id, n.cluster_id FROM comp c JOIN numbered n USING (component) WHERE n.cluster_size > 1")
def dup_clusters(s, d):
    return D.assignments(_clusters(s, d))


@query(_NUMBERED + " SELECT CASE WHEN sum(cluster_size) >= 2 THEN count(*) ELSE 0 END AS cluster_count, count(*) FILTER (WHERE cluster_size = 1) AS singleton_count, max(cluster_size) AS largest FROM numbered")
def cluster_stats(s, d):
    return D.cluster_stats(_clusters(s, d))


_ACTIVE_PAIRS = f""", av AS (SELECT a.doc_id, a.ingested_at_unix_seconds AS ingested, v.embedding::DOUBLE[] AS e FROM active a JOIN vectors v ON v.doc_id = a.doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM av x JOIN av y ON x.doc_id < y.doc_id WHERE list_dot_product(x.e, y.e) >= {THRESHOLD}),
reach AS (SELECT doc_id AS id, doc_id AS other FROM av UNION SELECT r.id, CASE WHEN p.a = r.other THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON r.other IN (p.a, p.b)),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
firsts AS (SELECT component, min(ingested * 1000000000 + id) AS first, count(*) AS cluster_size FROM comp JOIN av ON av.doc_id = comp.id GROUP BY component),
numbered AS (SELECT component, cluster_size, row_number() OVER (ORDER BY first, component) - 1 AS cluster_id FROM firsts)"""


@query(_ACTIVE_PAIRS + " SELECT c.id, c.component, n.cluster_id, n.cluster_size FROM comp c JOIN numbered n USING (component)")
def dedup_active(s, d):
    photos = _photos(s, d).withColumn("id", F.col("doc_id"))
    return D.dedup(photos, T.embeddings(s, d).withColumnRenamed("doc_id", "photo_id"), EMBEDDING_MODEL, THRESHOLD, unembedded=1)


@query("""SELECT a.vec_id, round(greatest(-1, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", fixtures=False)
def neighbour_cosine(s, d):
    e = T.read(s, d, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("other"))
    return e.join(following, F.col("vec_id") == F.col("before")).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


# --- names ------------------------------------------------------------------------------------------------

_EXPORT = """, cand AS (SELECT doc_id, ingested_at_unix_seconds, id,
  CASE WHEN cluster_id IS NOT NULL THEN 'cluster-' || format('{:03d}', cluster_id) || '-' ELSE '' END ||
  CASE WHEN aesthetic_score IS NOT NULL THEN 'cull-' || format('{:05.2f}', aesthetic_score::FLOAT::DOUBLE) || '-' ELSE '' END || 'IMG_' || (doc_id % 50) || '.jpg' AS candidate FROM develop),
num AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY ingested_at_unix_seconds, id, doc_id) - 1 AS n FROM cand)"""


def _export(s: SparkSession, d: str) -> DataFrame:
    rows = _develop(s, d).withColumn("candidate", S.export_name(F.col("source_path"), F.col("aesthetic_score"), F.col("cluster_id")))
    return N.without_collisions(rows, "candidate", ["ingested_at_unix_seconds", "id", "doc_id"])


@query(_EXPORT + " SELECT doc_id, candidate, CASE WHEN n = 0 THEN candidate ELSE left(candidate, length(candidate) - 4) || '_' || n || '.jpg' END AS file_name FROM num")
def export_names(s, d):
    return _export(s, d).select("doc_id", "candidate", "file_name")


@query(""" SELECT doc_id, CASE WHEN cluster_id IS NOT NULL THEN 'Cluster-' || format('{:03d}', cluster_id) ELSE 'Cluster-NONE' END || '_' ||
 CASE WHEN aesthetic_score IS NOT NULL THEN 'Cull-' || format('{:05.2f}', aesthetic_score::FLOAT::DOUBLE) ELSE 'Cull-NONE' END || '-IMG_' || (doc_id % 50) || '.CR3' AS new_name FROM develop""")
def rename_names(s, d):
    return _develop(s, d).select("doc_id", S.rename_name(F.col("source_path"), F.col("aesthetic_score"), F.col("cluster_id")).alias("new_name"))


@query(" SELECT doc_id, regexp_replace(source_path, '\\.[^./]*$', '.xmp') AS sidecar FROM photos")
def sidecar_paths(s, d):
    return _photos(s, d).select("doc_id", S.with_extension(F.col("source_path"), "xmp").alias("sidecar"))


@query(" SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY ingested_at_unix_seconds, doc_id) AS k FROM develop) WHERE k = 1")
def first_sidecar_wins(s, d):
    return N.first_wins(_develop(s, d), F.regexp_extract("source_path", r"([^/]*)$", 1), ["ingested_at_unix_seconds", "doc_id"]).select("doc_id")


@query(" SELECT doc_id, source_path FROM photos WHERE source_path = '/shoot/src1' OR starts_with(source_path, '/shoot/src1/')")
def source_prefix(s, d):
    return _photos(s, d).where(S.under_root(F.col("source_path"), "/shoot/src1")).select("doc_id", "source_path")


@query(" SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'raster' WHEN 1 THEN 'raw' WHEN 2 THEN 'untested_raw' WHEN 3 THEN 'raster' END AS kind, doc_id % 6 = 1 AS ingestible FROM photos")
def source_kind(s, d):
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".Cr3", ".nef", ".png", ".txt", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/a.b/x"), F.col("doc_id").cast("string"), ext)
    return _photos(s, d).select("doc_id", S.source_kind(path).alias("kind"), S.is_ingestible(path).alias("ingestible"))


_STEMS = ("photo", "a\\b", "tab\there", "x\u0085y", "\u65e5\u672c", "h\u00e9llo", "\U0001f600", "a/b", "")
_STEM_LIST = ", ".join("'" + x + "'" for x in _STEMS)


@query(f"""WITH n AS (SELECT doc_id, [{_STEM_LIST}][doc_id % {len(_STEMS)} + 1] AS stem, doc_id % 61 AS most FROM documents), r AS (SELECT *, repeat(stem, (doc_id % 13)::BIGINT) AS long FROM n)
 SELECT doc_id, CASE WHEN NOT regexp_matches(stem, '[/\\\\\\x00-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]') THEN stem END AS safe,
   left(long, len(list_filter(range(1, length(long) + 1), lambda k: strlen(left(long, k)) <= most))) AS capped FROM r""", fixtures=False)
def safe_names(s, d):
    stem = F.element_at(F.array(*map(F.lit, _STEMS)), (F.col("doc_id") % len(_STEMS) + 1).cast("int"))
    long = F.repeat(stem, (F.col("doc_id") % 13).cast("int"))
    return T.read(s, d, "documents").select("doc_id", S.safe_stem(stem).alias("safe"), S.cap_bytes(long, (F.col("doc_id") % 61).cast("int")).alias("capped"))


@query(" SELECT doc_id FROM develop WHERE doc_id % 4 <> 0")
def skip_existing(s, d):
    rows = _develop(s, d).select("doc_id", F.col("source_path").alias("output"))
    return K.without_existing(rows, rows.where("doc_id % 4 = 0").select("output"), "output").select("doc_id")


# --- sidecars ------------------------------------------------------------------------------------------------


@query(f""", x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7) - 1 END AS xmp, aesthetic_score::FLOAT::DOUBLE AS f FROM develop)
 SELECT doc_id, coalesce(xmp, {RATING_SQL}, 0) AS effective FROM x WHERE coalesce(xmp, {RATING_SQL}, 0) >= 3""")
def effective_rating(s, d):
    xmp = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 - 1)
    rows = _develop(s, d).select("doc_id", S.effective_rating(xmp, F.col("aesthetic_score")).alias("effective"))
    return rows.where((F.col("effective") != -1) & (F.col("effective") >= 3))


@query(f""", x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7) - 1 END AS xmp, aesthetic_score IS NOT NULL AND doc_id % 3 = 0 AS odd, aesthetic_score::FLOAT::DOUBLE AS f FROM develop)
 SELECT doc_id, CASE WHEN xmp IS NULL AND odd THEN 'failed' WHEN coalesce(xmp, {RATING_SQL}, 0) >= 3 THEN 'render' ELSE 'skipped_rating' END AS outcome FROM x""")
def export_outcomes(s, d):
    i, a = F.col("doc_id"), F.col("aesthetic_score")
    odd = F.when(i % 2 == 0, float("nan")).otherwise(float("-inf"))
    score = F.when(a.isNotNull() & (i % 3 == 0), odd).otherwise(a)
    return _develop(s, d).select("doc_id", K.export_outcome(S.effective_rating(F.when(i % 5 == 0, i % 7 - 1), score), 3).alias("outcome"))


@query(""" SELECT doc_id, CASE WHEN doc_id % 9 - 2 BETWEEN -1 AND 5 THEN doc_id % 9 - 2 END AS rating, CASE WHEN doc_id % 15 - 7 BETWEEN -5 AND 5 THEN (doc_id % 15 - 7)::DOUBLE END AS exposure,
   CASE WHEN doc_id % 10 <> 0 THEN greatest(2000, least(50000, doc_id * 500)) END AS temperature, 'l' || doc_id AS label, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || ',z' ELSE '' END AS words, doc_id % 13 = 0 AS broken
 FROM documents WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, TRUE FROM documents WHERE doc_id % 13 = 0""", fixtures=False)
def sidecar_fields(s, d):
    i = F.col("doc_id")
    warm = F.when(i % 10 == 0, "warm").otherwise((i * 500).cast("string"))
    bag = F.when(i % 2 == 0, F.concat(F.lit("<dc:subject><rdf:Bag><rdf:li>z</rdf:li><rdf:li> a"), i.cast("string"), F.lit(" </rdf:li><rdf:li>z</rdf:li></rdf:Bag></dc:subject>"))).otherwise("")
    spaces = " ".join(f"xmlns:{k}='{sidecar.NAMESPACES[k]}'" for k in ("rdf", "crs", "xmp", "dc"))
    text = F.concat(
        F.lit(f"<rdf:RDF {spaces}><rdf:Description xmp:Rating=' "), (i % 9 - 2).cast("string"), F.lit("' crs:Exposure2012='"), (i % 15 - 7).cast("string"), F.lit("' crs:Temperature='"), warm,
        F.lit("'><xmp:Label>l"), i.cast("string"), F.lit("</xmp:Label>"), bag, F.lit("</rdf:Description>"), F.when(i % 13 == 0, "").otherwise("</rdf:RDF>"),
    )
    found = sidecar.read_sidecars(T.read(s, d, "documents").select(i.cast("string").alias("sidecar"), text.alias("text")))
    return found.select(F.col("sidecar").cast("long").alias("doc_id"), F.col("rating").cast("long").alias("rating"), "exposure", F.col("temperature").cast("long").alias("temperature"), "label", F.array_join("keywords", ",").alias("words"), F.col("error").isNotNull().alias("broken"))


@query(f""", n AS (SELECT doc_id, cluster_id, aesthetic_score::FLOAT::DOUBLE AS f FROM develop), t AS (SELECT *, {TIER_SQL} AS tier FROM n)
 SELECT doc_id, CASE WHEN tier IS NULL AND cluster_id IS NULL THEN '' ELSE 'lumicat' || coalesce(',nima:' || tier, '') || coalesce(',cluster:' || cluster_id, '') END AS flat,
   CASE WHEN tier IS NULL AND cluster_id IS NULL THEN '' ELSE 'lumicat' || coalesce(',lumicat|nima:' || tier, '') || coalesce(',lumicat|cluster:' || cluster_id, '') END AS tree FROM t""")
def keywords(s, d):
    a, c = F.col("aesthetic_score"), F.col("cluster_id")
    return _develop(s, d).select("doc_id", F.array_join(S.keywords(a, c), ",").alias("flat"), F.array_join(S.hierarchical_keywords(a, c), ",").alias("tree"))


_WORDS = ("lumicat", "LUMICAT|x", "lumicatx", "cluster:12", "cluster:-1", "cluster:+5", "nima:Good", "nima:great", "holiday", "Cluster:x")


@query(f", w AS (SELECT doc_id, [{', '.join(repr(w) for w in _WORDS)}][doc_id % 10 + 1] AS keyword FROM documents) SELECT doc_id, keyword, keyword IN ('lumicat', 'LUMICAT|x', 'cluster:12', 'cluster:+5', 'nima:Good') AS managed FROM w")
def managed_keywords(s, d):
    k = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return T.read(s, d, "documents").select("doc_id", k.alias("keyword"), S.is_managed_keyword(k).alias("managed"))


@query(""" SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nima:good,z' || (doc_id % 4) || ',a' ELSE array_to_string(list_sort(list_distinct(['z' || (doc_id % 4), 'a', 'lumicat', 'a'])), ',') END AS merged,
   array_to_string(list_sort(list_distinct(['b', 'a' || (doc_id % 3), 'c', 'd'])), ',') AS cleaned FROM documents""", fixtures=False)
def keyword_merge(s, d):
    existing = F.array(F.lit("nima:good"), F.concat(F.lit("z"), (F.col("doc_id") % 4).cast("string")), F.lit("a"))
    incoming = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("lumicat"), F.lit("a")))
    messy = F.array(F.lit(" b "), F.lit(""), F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")), F.lit("b"), F.lit("  "), F.lit("\u2003c\t"), F.lit("\u3000d\xa0\n"), F.lit("\u2028"))
    return T.read(s, d, "documents").select("doc_id", F.array_join(S.merge_keywords(existing, incoming), ",").alias("merged"), F.array_join(S.clean_keywords(messy), ",").alias("cleaned"))


_CONFLICT = """, c AS (SELECT doc_id, doc_id % 2 = 0 AS ex, doc_id % 7 = 0 AS forced, (1000 + doc_id % 9)::DOUBLE AS mtime,
  CASE WHEN doc_id % 3 > 0 THEN (1000 + doc_id % 5)::DOUBLE END AS md, CASE WHEN doc_id % 5 > 1 THEN (1000 + doc_id % 4)::DOUBLE END AS lp, doc_id % 11 < 5 AS ours, doc_id % 13 < 6 AS crs FROM documents)
SELECT doc_id, CASE WHEN NOT ex THEN 'created' WHEN forced THEN 'forced_overwrite' WHEN lp IS NOT NULL AND mtime - lp > 2.1 THEN 'conflict_preserved'
  WHEN md IS NOT NULL AND lp IS NOT NULL THEN CASE WHEN md > lp THEN 'conflict_preserved' ELSE 'overwritten' END
  WHEN md IS NOT NULL THEN 'overwritten' WHEN lp IS NOT NULL THEN CASE WHEN ours THEN 'overwritten' ELSE 'conflict_preserved' END
  WHEN crs AND NOT ours THEN 'conflict_preserved' ELSE 'overwritten' END AS outcome FROM c"""


@query(_CONFLICT)
def conflict_decision(s, d):
    i = F.col("doc_id")
    md = F.when(i % 3 > 0, (1000 + i % 5).cast("double"))
    lp = F.when(i % 5 > 1, (1000 + i % 4).cast("double"))
    out = S.conflict_outcome(i % 2 == 0, i % 7 == 0, (1000 + i % 9).cast("double"), md, lp, i % 11 < 5, i % 13 < 6)
    return T.read(s, d, "documents").select("doc_id", out.alias("outcome"))


_RAW = ("5000", " 99999 ", "1e3", "abc", "-7.5", "NaN", "3.49", "", "7d", "7f", "1_000", "0x10", "\u0667")
_NUMBER = "[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?"


@query(f""", r AS (SELECT doc_id, trim([{', '.join(repr(w) for w in _RAW)}][doc_id % {len(_RAW)} + 1]) AS t, CASE WHEN regexp_full_match(t, '{_NUMBER}') THEN try_cast(t AS DOUBLE) END AS v FROM documents),
 i AS (SELECT doc_id, CASE WHEN isfinite(v) THEN (CASE WHEN v < 0 THEN -floor(-v + 0.5) ELSE floor(v + 0.5) END)::INT END AS n, CASE WHEN isfinite(v) THEN v END AS f FROM r)
 SELECT doc_id, CASE WHEN n IS NOT NULL THEN greatest(2000, least(50000, n)) END AS temperature, CASE WHEN n IS NOT NULL THEN greatest(-150, least(150, n)) END AS tint,
   CASE WHEN f BETWEEN -5 AND 5 THEN f END AS exposure, CASE WHEN n BETWEEN -100 AND 100 THEN n END AS contrast FROM i""")
def xmp_field_policy(s, d):
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("doc_id") % len(_RAW) + 1).cast("int"))
    n = S.parse_int32(raw)
    f = S.number_text(raw).try_cast("double")
    exposure = S.or_null(F.when(S.is_finite(f), f), -5.0, 5.0)
    return T.read(s, d, "documents").select("doc_id", S.clamp(n, 2000, 50000).alias("temperature"), S.clamp(n, -150, 150).alias("tint"), exposure.alias("exposure"), S.or_null(n, -100, 100).alias("contrast"))


@query(" SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 5 WHEN 1 THEN NULL ELSE 100 + doc_id % 4 END AS cluster, coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END, doc_id % 6) AS tint FROM documents", fixtures=False)
def field_merge(s, d):
    i = F.col("doc_id")
    op = F.element_at(F.array(F.lit("keep"), F.lit("clear"), F.lit("set")), (i % 3 + 1).cast("int"))
    return T.read(s, d, "documents").select("doc_id", S.resolve_update(op, 100 + i % 4, i % 5).alias("cluster"), F.coalesce(F.when(i % 4 > 0, i % 4), i % 6).alias("tint"))


@query(" SELECT doc_id, (doc_id * 700) BETWEEN 2000 AND 50000 AND doc_id % 400 - 200 BETWEEN -150 AND 150 AND (doc_id % 120) / 10.0 BETWEEN 1 AND 10 AS valid FROM documents", fixtures=False)
def settings_valid(s, d):
    i = F.col("doc_id")
    ok = S.valid_settings(i * 700, i % 400 - 200, (i % 120) / F.lit(10.0))
    return T.read(s, d, "documents").select("doc_id", ok.alias("valid"))


# --- files and outcomes ------------------------------------------------------------------------------------

_GUARD = ", g AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'file_missing' WHEN doc_id % 5 = 0 THEN 'derive_failed' WHEN doc_id % 3 = 0 THEN 'content_changed' ELSE 'ready' END AS guard FROM active)"


def _guarded(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    derived = F.when(i % 5 != 0, F.when(i % 3 == 0, F.lit("other")).otherwise(F.col("id")))
    return K.file_guard(K.active(_photos(s, d)), i % 7 != 0, derived, F.col("id"))


@query(_GUARD + " SELECT doc_id, guard FROM g")
def guard_outcomes(s, d):
    return _guarded(s, d).select("doc_id", "guard")


@query(_GUARD + " SELECT count(*) FILTER (WHERE guard = 'ready') AS ready, count(*) FILTER (WHERE guard = 'file_missing') AS file_missing, count(*) FILTER (WHERE guard = 'derive_failed') AS derive_failed, count(*) FILTER (WHERE guard = 'content_changed') AS content_changed FROM g")
def stage_counters(s, d):
    return K.counters(_guarded(s, d), "guard", ["ready", "file_missing", "derive_failed", "content_changed"])


# --- pixels and geometry -----------------------------------------------------------------------------------


@query("""WITH x AS (SELECT i, i / 65535.0::DOUBLE * 2.0::DOUBLE ** 0.5 AS e FROM range(65536) t(i)),
 y AS (SELECT i, greatest(0.0, least(1.0, (e * (2.51::DOUBLE * e + 0.03::DOUBLE)) / (e * (2.43::DOUBLE * e + 0.59::DOUBLE) + 0.14::DOUBLE))) AS m FROM x)
 SELECT i AS sample, greatest(0, least(255, floor((CASE WHEN m <= 0.0031308 THEN 12.92::DOUBLE * m ELSE 1.055::DOUBLE * m ** (1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5)::INT)) AS value FROM y""", fixtures=False)
def tone_lut(s, d):
    return s.range(65536).select(F.col("id").alias("sample"), S.tone_value(F.col("id"), 0.5).alias("value"))


@query("""WITH h AS (SELECT DISTINCT 1 + doc_id % 97 AS height FROM documents), b AS (SELECT height, floor(height * 0.3 + 0.5)::INT AS band FROM h)
 SELECT height, array_to_string([floor(i / greatest(band - 1, 1)::DOUBLE * 255 + 0.5)::INT for i in range(band)], ',') AS ramp FROM b""", fixtures=False)
def shadow_ramp(s, d):
    h = T.read(s, d, "documents").select((1 + F.col("doc_id") % 97).alias("height")).distinct()
    return h.select("height", F.array_join(F.transform(S.shadow_ramp(F.col("height"), 0.3), lambda x: x.cast("string")), ",").alias("ramp"))


_BOX = """WITH p AS (SELECT doc_id, 100 + doc_id % 900 AS tw, 80 + doc_id % 700 AS th, 30 + doc_id % 200 AS mw, 10 + doc_id % 60 AS mh FROM documents),
 s AS (SELECT *, greatest(1, floor(th * 0.08::DOUBLE + 0.5)::INT) AS h, floor(least(tw, th) * 0.02::DOUBLE + 0.5)::INT AS m FROM p),
 w AS (SELECT *, greatest(1, floor(mw * (h / greatest(mh, 1)::DOUBLE) + 0.5)::INT) AS w FROM s)"""


@query(_BOX + " SELECT doc_id, CASE WHEN tw - m - w >= 0 AND m + h <= th THEN tw - m - w END AS x, CASE WHEN tw - m - w >= 0 AND m + h <= th THEN m END AS y, CASE WHEN tw - m - w >= 0 AND m + h <= th THEN w END AS w, CASE WHEN tw - m - w >= 0 AND m + h <= th THEN h END AS h FROM w", fixtures=False)
def mark_placement(s, d):
    i = F.col("doc_id")
    rows = T.read(s, d, "documents").select("doc_id", (100 + i % 900).alias("tw"), (80 + i % 700).alias("th"), (30 + i % 200).alias("mw"), (10 + i % 60).alias("mh"))
    m = F.floor(F.least("tw", "th") * F.lit(0.02) + 0.5).cast("int")
    box = S.mark_box(F.col("tw"), F.col("th"), F.col("mw"), F.col("mh"), 0.08, m, m, "top_right")
    return rows.withColumn("box", box).select("doc_id", *(F.col(f"box.{k}").alias(k) for k in "xywh"))


@query(_BOX + " SELECT doc_id, CASE WHEN m + w <= tw AND th - m - h >= 0 THEN m END AS x, CASE WHEN m + w <= tw AND th - m - h >= 0 THEN th - m - h END AS y FROM w", fixtures=False)
def mark_placement_bottom(s, d):
    i = F.col("doc_id")
    rows = T.read(s, d, "documents").select("doc_id", (100 + i % 900).alias("tw"), (80 + i % 700).alias("th"), (30 + i % 200).alias("mw"), (10 + i % 60).alias("mh"))
    m = F.floor(F.least("tw", "th") * F.lit(0.02) + 0.5).cast("int")
    box = S.mark_box(F.col("tw"), F.col("th"), F.col("mw"), F.col("mh"), 0.08, m, m, "bottom_left")
    return rows.withColumn("box", box).select("doc_id", "box.x", "box.y")


@query("""WITH p AS (SELECT doc_id, (60 + doc_id % 900)::DOUBLE AS tw, (40 + doc_id * 7 % 700)::DOUBLE AS th, (1 + doc_id % 200)::DOUBLE AS bw, (1 + doc_id * 3 % 90)::DOUBLE AS bh FROM documents),
 k AS (SELECT *, greatest(greatest(tw, th) * 0.3::DOUBLE, 1) / greatest(bw, bh) AS k, greatest(8, floor(greatest(tw, th) * 0.015::DOUBLE + 0.5)) AS pad FROM p),
 b AS (SELECT *, greatest(1, bw * k) AS w, greatest(1, bh * k) AS h FROM k), f AS (SELECT *, tw - pad - w >= 0 AND th - pad - h >= 0 AND pad + w <= tw AND pad + h <= th AS fits FROM b)
 SELECT doc_id, CASE WHEN fits THEN floor(tw - pad - w + 0.5)::INT END AS x, CASE WHEN fits THEN floor(th - pad - h + 0.5)::INT END AS y, CASE WHEN fits THEN floor(w + 0.5)::INT END AS w, CASE WHEN fits THEN floor(h + 0.5)::INT END AS h FROM f""", fixtures=False)
def badge_boxes(s, d):
    i = F.col("doc_id")
    box = S.badge_box(60 + i % 900, 40 + i * 7 % 700, (1 + i % 200).cast("double"), (1 + i * 3 % 90).cast("double"), "bottom_right", 30.0)
    return T.read(s, d, "documents").withColumn("box", box).select("doc_id", *(F.col(f"box.{k}").alias(k) for k in "xywh"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 2492765332 WHEN 1 THEN 370546198 WHEN 2 THEN 1633771873 WHEN 3 THEN 1229539657 ELSE doc_id * 97 END AS f FROM documents),
 c AS (SELECT doc_id, substr('RGBG', (f & 3) + 1, 1) || substr('RGBG', (f >> 2 & 3) + 1, 1) || substr('RGBG', (f >> 4 & 3) + 1, 1) || substr('RGBG', (f >> 6 & 3) + 1, 1) AS cell FROM f)
 SELECT doc_id, CASE WHEN cell IN ('RGGB', 'BGGR', 'GRBG', 'GBRG') THEN cell END AS cfa FROM c""", fixtures=False)
def cfa_patterns(s, d):
    i = F.col("doc_id")
    mask = F.coalesce(*(F.when(i % 6 == k, F.lit(m)) for k, m in enumerate((2492765332, 370546198, 1633771873, 1229539657))), i * 97)
    return T.read(s, d, "documents").select("doc_id", S.cfa_pattern(mask).alias("cfa"))


@query("""WITH p AS (SELECT doc_id, (200 + doc_id % 800)::DOUBLE AS tw, (150 + doc_id % 600)::DOUBLE AS th FROM documents), m AS (SELECT *, greatest(8.0, floor(greatest(tw, th) * 0.015::DOUBLE + 0.5)) AS pad FROM p)
 SELECT doc_id, pad AS tl_x, tw - pad - 40 AS br_x, th - pad - 20 AS br_y, (tw - 40) / 2 AS c_x, (th - 20) / 2 AS c_y FROM m""", fixtures=False)
def watermark_position(s, d):
    i = F.col("doc_id")
    rows = T.read(s, d, "documents").select("doc_id", (200 + i % 800).cast("double").alias("tw"), (150 + i % 600).cast("double").alias("th"))
    pad = F.greatest(F.lit(8.0), F.floor(F.greatest("tw", "th") * F.lit(0.015) + 0.5).cast("double"))
    args = (F.lit(40.0), F.lit(20.0), F.col("tw"), F.col("th"), pad, pad)
    tl, br, c = (S.place(k, *args) for k in ("top_left", "bottom_right", "center"))
    return rows.select("doc_id", tl[0].alias("tl_x"), br[0].alias("br_x"), br[1].alias("br_y"), c[0].alias("c_x"), c[1].alias("c_y"))


@query("""WITH p AS (SELECT doc_id, (1 + doc_id * 7 % 6000)::FLOAT AS w, (1 + doc_id * 13 % 4000)::FLOAT AS h FROM documents), s AS (SELECT *, (2048::FLOAT / greatest(w, h))::FLOAT AS k FROM p), t AS (SELECT *, least(k, 1::FLOAT) AS dk FROM s)
 SELECT doc_id, greatest(1, floor((w * k)::FLOAT + 0.5::DOUBLE)::INT) AS w, greatest(1, floor((h * k)::FLOAT + 0.5::DOUBLE)::INT) AS h, greatest(1, floor((w * dk)::FLOAT + 0.5::DOUBLE)::INT) AS down_w FROM t""", fixtures=False)
def resize_dims(s, d):
    i = F.col("doc_id")
    w, h = 1 + i * 7 % 6000, 1 + i * 13 % 4000
    a, b = S.fitted_size(w, h, 2048)
    c, _ = S.fitted_size(w, h, 2048, downscale_only=True)
    return T.read(s, d, "documents").select("doc_id", a.alias("w"), b.alias("h"), c.alias("down_w"))


@query("SELECT doc_id, CASE WHEN doc_id % 4096 = 0 THEN 0 ELSE length(bin(doc_id % 4096)) END AS depth, greatest(-1, least(5, doc_id % 12 - 4)) AS rating, greatest(0.001, least(100.0, doc_id % 300 / 2.0::DOUBLE)) AS scale FROM documents", fixtures=False)
def value_clamps(s, d):
    i = F.col("doc_id")
    return T.read(s, d, "documents").select("doc_id", S.bit_depth(i % 4096).alias("depth"), S.clamp(i % 12 - 4, -1, 5).alias("rating"), S.clamp((i % 300) / F.lit(2.0), 0.001, 100.0).alias("scale"))


# --- files of this session ---------------------------------------------------------------------------


@query(" SELECT doc_id, text NOT SIMILAR TO '(.|\\n)*[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F](.|\\n)*' AS valid FROM documents", fixtures=False)
def xml_text_valid(s, d):
    return T.read(s, d, "documents").select("doc_id", S.valid_xml_text(F.col("text")).alias("valid"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Active photos with score, cluster and rating: the rows that developing, exporting and renaming start from."""
    rows = _develop(s, d)
    a = F.col("aesthetic_score")
    return rows.select("doc_id", "id", "source_path", "aesthetic_score", "cluster_id", S.rating(a).alias("rating"), S.tier(a).alias("tier"))


@query(f", n AS (SELECT *, aesthetic_score::FLOAT::DOUBLE AS f FROM develop) SELECT doc_id, id, source_path, aesthetic_score, cluster_id, {RATING_SQL} AS rating, {TIER_SQL} AS tier FROM n")
def develop_ratings(s, d):
    return flagship(s, d)
