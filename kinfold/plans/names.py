"""Queries of the name operators over the tables, with the SQL that checks them.

names is a view of invented company names on part: every way of writing that normalization knows, nulls among them. The
registers' own names (other scripts and marks) are normalized too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import grams, normalize, translit
from kinfold.functions.normalize import comparison_form, duckdb_normalize, normalize_name, truncate_bytes
from kinfold.operators import audit, blocking, cluster, companions, features, generate, graph, scoring
from kinfold.plans import jobs
from kinfold.session import cut, folder

_NAMES = """
SELECT p_partkey AS row_id, p_brand AS block,
 CASE p_partkey % 12
  WHEN 0 THEN upper(concat(p_name,' ',p_type,' Inc'))
  WHEN 1 THEN concat(p_name,' ',lower(p_type),', LLC')
  WHEN 2 THEN concat('00 ',p_name,' ',p_type,' Co., Ltd.')
  WHEN 3 THEN concat('The ',p_name,' & ',p_type,' Company')
  WHEN 4 THEN concat(replace(p_name,' ',''),' ',p_type,' Corp')
  WHEN 5 THEN concat(p_name,'-',p_type,' GmbH')
  WHEN 6 THEN concat('# ',p_name,' ',p_type,' Manufacturing S.A.')
  WHEN 7 THEN concat('JSC ',p_name,' ',p_type,' Mfg')
  WHEN 8 THEN concat(p_name,' ',p_type,' Limited Liability Company')
  WHEN 9 THEN concat(substring(p_name,1,3),substring(p_name,5),' ',p_type)
  WHEN 10 THEN CAST(NULL AS STRING)
  ELSE concat(p_name,' (',p_type,') International Group') END AS name,
 concat(p_name,'|',p_type) AS true_entity
FROM {part}
"""
ALIASES = {"Almond Antique": ["AA", "Alm Ant"], "Blue Steel Works": ["BSW Inc", "Blue SW"]}
BANDS, ROWS = 32, 4


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NAMES.format(part="{part}"), part=read(spark, sf, "part"))


def uniques(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.with_norm(names(spark, sf), "name", "norm")
    return cut(features.unique_names(rows, "norm", "name", "row_id", F.lit("")))


def edges(spark: SparkSession, sf: str, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    u = uniques(spark, sf)
    return u, scoring.scored_candidates(u, threshold)


def register_names(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"gleif": ("lei", "legal_name"), "uk_register": ("company_number", "legal_name"), "party_aliases": ("alias_key", "name"), "sam_entities": ("uei", "legal_name"), "name_records": ("record_id", "name")}
    out = [read(spark, sf, t).selectExpr(f"'{t}' as source", f"{k} as key", f"{n} as name") for t, (k, n) in tables.items()]
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def normalize_names(spark, sf):
    return names(spark, sf).select("row_id", normalize_name("name").alias("norm"))


def normalize_registers(spark, sf):
    return register_names(spark, sf).select("source", "key", normalize_name("name").alias("norm"))


def normalize_truncated(spark, sf):
    return names(spark, sf).select("row_id", normalize_name(truncate_bytes("name", 12)).alias("norm"))


def normalize_sql(spark, sf):
    """The SQL function over all registers."""
    normalize.register(spark)
    return register_names(spark, sf).selectExpr("source", "key", "normalize_name(name) as norm")


def transliterate_registers(spark, sf):
    """The form of every register name as it is and in Latin letters."""
    rows = register_names(spark, sf).withColumn("latin", translit.to_latin(spark, "name"))
    return rows.select("source", "key", "latin", normalize_name("latin").alias("norm"))


def comparison_forms(spark, sf):
    return names(spark, sf).select("row_id", comparison_form(normalize_name("name")).alias("form"))


def ngram_bag(spark, sf):
    return uniques(spark, sf).select("id", F.posexplode(grams.ngrams("form")).alias("pos", "gram"))


def ngram_set(spark, sf):
    return uniques(spark, sf).select("id", F.explode(grams.distinct_ngrams("form")).alias("gram"))


def alias_rewrite(spark, sf):
    return features.with_norm(names(spark, sf), "name", "norm", aliases=_aliases()).select("row_id", "norm")


def _aliases() -> dict[str, list[str]]:
    return ALIASES | {"Zeta Holdings": ["almond antique promo", "blush azure promo"], "Alpha Holdings": ["almond antique promo"]}


def unique_names(spark, sf):
    return uniques(spark, sf).select("id", "norm", "first_raw", "n_rows")


def gram_idf(spark, sf):
    return features.gram_idf(uniques(spark, sf)).select("gram", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark, sf):
    return features.tfidf_vectors(uniques(spark, sf)).select("id", F.explode("vec").alias("e")).select("id", "e.gram", F.round("e.w", 6).alias("w"))


def minhash_signature(spark, sf):
    return blocking.signatures(uniques(spark, sf)).select("id", F.posexplode("sig").alias("i", "value"))


def minhash_expression(spark, sf):
    """The twin as a column expression, with the operator's number of permutations."""
    return uniques(spark, sf).select("id", F.posexplode(grams.minhash(grams.distinct_ngrams("form"), BANDS * ROWS)).alias("i", "value"))


def lsh_buckets(spark, sf):
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> array_join(transform(slice(sig, k * {ROWS} + 1, {ROWS}), v -> cast(v as string)), '|'))")
    return blocking.signatures(uniques(spark, sf)).select("id", F.posexplode(band).alias("band", "bucket"))


def lsh_pairs(spark, sf):
    return blocking.lsh_pairs(cut(blocking.lsh_buckets(uniques(spark, sf)))).select("a", "b")


def candidates(spark, sf):
    return cluster.candidates(names(spark, sf), min_score=0.5, order_col="row_id")


def pair_scores_exact(spark, sf):
    return scoring.exact_pairs(uniques(spark, sf), 0.7).select("a", "b", "score")


def threshold_edges(spark, sf):
    return edges(spark, sf)[1].select("a", "b", "score")


def degrees(spark, sf):
    return graph.degrees(edges(spark, sf)[1])


def connected_components(spark, sf):
    return graph.connected_components(edges(spark, sf)[1])


def hub_pick(spark, sf):
    u, e = edges(spark, sf)
    nodes = graph.connected_components(e).join(graph.degrees(e), "id").join(u.select("id", "norm"), "id")
    return nodes.groupBy("component").agg(F.expr("min_by(norm, struct(-degree, norm))").alias("hub"), F.count("*").alias("n"))


def bfs_from_hub(spark, sf):
    u, e = edges(spark, sf)
    nodes = graph.connected_components(e).join(graph.degrees(e), "id").join(u.select("id", "norm"), "id")
    hubs = cut(nodes.groupBy(F.col("component").alias("piece")).agg(graph.hub_of().alias("id")))
    return graph.distances(e, hubs).withColumnRenamed("piece", "component")


def diameter_split(spark, sf):
    u, e = edges(spark, sf)
    nodes = cut(graph.connected_components(e).join(graph.degrees(e), "id").join(u.select("id", "norm"), "id"))
    pieces = cut(graph.split_wide(nodes, e).join(nodes.select("id", "norm", "degree"), "id"))
    hubs = pieces.groupBy("piece").agg(F.expr("min_by(norm, struct(-degree, norm))").alias("hub"))
    return pieces.join(hubs, "piece").select("id", "hub", "flagged")


def diameter_split_deep(spark, sf):
    """Chains of one to twelve nodes, planted on the customers: long ones fall apart in several levels."""
    c = read(spark, sf, "customer").where("c_custkey % 12 <= (c_custkey div 12) % 12").selectExpr("c_custkey as id", "lpad(c_custkey, 12, '0') as norm")
    e = cut(c.selectExpr("id as a", "id + 1 as b").join(c.selectExpr("id as b"), "b").where("a div 12 = b div 12").select("a", "b"))
    nodes = cut(graph.connected_components(e).join(graph.degrees(e), "id").join(c, "id"))
    pieces = graph.split_wide(nodes, e)
    return pieces.join(pieces.groupBy("piece").agg(F.min("id").alias("first")), "piece").select("id", "first", "flagged")


def lsh_band_sizes(spark, sf):
    """Buckets of the keys that clustering uses, by band: how many, and how many pairs they hold."""
    each = blocking.lsh_buckets(uniques(spark, sf)).groupBy("band", "bucket").agg(F.count("*").alias("k"))
    return each.groupBy("band").agg(F.count("*").alias("n_buckets"), F.sum("k").alias("n_names"), F.sum(F.expr("k * (k - 1) div 2")).alias("n_pairs"))


def _cluster(threshold: float, **options):
    def query(spark, sf):
        return cluster.cluster(names(spark, sf), threshold=threshold, order_col="row_id", **options).select("row_id", "cluster_id", "canonical_name")

    return query


def cluster_threshold_sweep(spark, sf):
    out = None
    for t in (0.9, 0.95, 0.99):
        c = cluster.cluster(names(spark, sf), threshold=t, order_col="row_id").agg(F.lit(t).alias("threshold"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(F.col("cluster_id").isNull()).alias("n_null"))
        out = c if out is None else out.unionByName(c)
    return out


def cluster_blocked(spark, sf):
    return cluster.cluster(names(spark, sf), threshold=0.95, order_col="row_id", block_col="block").select("row_id", "cluster_id", "canonical_name")


def cluster_registers(spark, sf):
    """The names of all five registers at the default settings."""
    return cluster.cluster(register_names(spark, sf), "name").select("source", "key", "cluster_id", "canonical_name")


def cluster_register(spark, sf):
    """The legal entities' register at the default settings."""
    g = read(spark, sf, "gleif").select("lei", "legal_name")
    return cluster.cluster(g, "legal_name").select("lei", "cluster_id", "canonical_name")


def cluster_vendors_by_country(spark, sf):
    """The batch job's plan: distinct vendors of each country."""
    return jobs.cluster_by_block(read(spark, sf, "vendor_shipments"), threshold=0.95).select("country_of_origin", "vendor_name", "cluster_id", "canonical_name")


def cluster_sizes_top(spark, sf):
    return companions.cluster_sizes(cluster.cluster(names(spark, sf), threshold=0.95, order_col="row_id"), 20)


def explain_edges(spark, sf):
    """The edges of the largest cluster (of those, the smallest id)."""
    c = cut(cluster.cluster(names(spark, sf), threshold=0.95, order_col="row_id").select("row_id", "name", "cluster_id"))
    largest = companions.cluster_sizes(c.withColumn("canonical_name", F.lit("")), 1).head()
    return companions.explain_edges(c, largest.cluster_id if largest else -1, order_col="row_id")


def _acronym_rows(spark, sf):
    """Names of parts and their first letters, so acronyms meet expansions."""
    a = read(spark, sf, "part").selectExpr("p_partkey as row_id", "concat(p_name, ' ', p_type) as name")
    b = read(spark, sf, "part").selectExpr("p_partkey + 1000000000 as row_id", "concat(upper(substring(p_name, 1, 1)), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(p_type, 1, 1)) as name")
    return a.unionByName(b)


def acronym_map(spark, sf):
    return companions.acronym_map(_acronym_rows(spark, sf), order_col="row_id")


def score_clusters(spark, sf):
    got = companions.score_clusters(cluster.cluster(names(spark, sf), threshold=0.95, order_col="row_id"), "cluster_id", "true_entity")
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns[:4]], *got.columns[4:])


def lsh_calibrate_grid(spark, sf):
    rows = []
    for target, recall in ((0.5, 0.95), (0.7, 0.9), (0.85, 0.95), (0.6, 0.99)):
        got = grams.lsh_calibrate(target, recall)
        rows.append((target, recall, got["bands"], got["rows"], got["num_perm"], round(got["p_at_target"], 6), round(got["p_at_fp"], 6)))
    return spark.createDataFrame(rows, "target double, recall double, bands int, band_rows int, num_perm int, p_at_target double, p_at_fp double")


def _pairs(spark, sf):
    return read(spark, sf, "match_pairs").where("score is not null and not isnan(score)").select("name_a", "name_b", "score")


def score_buckets(spark, sf):
    return audit.score_buckets(_pairs(spark, sf)).select("name_a", "name_b", "score", "bucket")


def bucket_distribution(spark, sf):
    return audit.bucket_distribution(audit.score_buckets(_pairs(spark, sf)))


def bucket_sample(spark, sf):
    return audit.sample_per_bucket(audit.score_buckets(_pairs(spark, sf).where("name_a is not null and name_b is not null")).distinct(), 50).select("name_a", "name_b", "score", "bucket")


def context_join(spark, sf):
    p = _pairs(spark, sf).distinct()
    rows = read(spark, sf, "name_records").selectExpr("name", "block", "channel", "concat(record_id, cast(unix_micros(loaded_at) as string)) as row_key")
    return audit.join_context(p, rows, "name", ["block", "channel"], "row_key")


def evaluation_set(spark, sf):
    """Candidates of the names, a sample of each score bucket, with the block of both sides."""
    c = cluster.candidates(names(spark, sf), min_score=0.3, order_col="row_id")
    return audit.evaluation_set(c, names(spark, sf), "name", ["block"], "row_id")


def audit_stats(spark, sf):
    return audit.stats(names(spark, sf), "name")


def audit_describe(spark, sf):
    return audit.describe(register_names(spark, sf), "name")


def audit_apart(spark, sf):
    return audit.apart(read(spark, sf, "party_aliases"), "entity_id", "name")


def audit_collisions(spark, sf):
    return audit.collisions(names(spark, sf), "name")


def audit_alias_recall(spark, sf):
    return audit.alias_recall(read(spark, sf, "party_aliases"), "entity_id", "name")


def audit_tail_tokens(spark, sf):
    return audit.edge_tokens(read(spark, sf, "gleif"), "legal_name", True)


def audit_head_tokens(spark, sf):
    return audit.edge_tokens(read(spark, sf, "gleif"), "legal_name", False)


def audit_sample(spark, sf):
    """Evenly spaced rows whose normalized form differs."""
    rows = names(spark, sf).withColumn("norm", normalize_name("name")).where("norm <> ''")
    return audit.evenly_spaced(rows.where(audit.changed(F.col("name"), F.col("norm"))).select("row_id", "name", "norm"), "row_id")


def sample_evenly(spark, sf):
    """Twenty evenly spaced documents: wide rows, which adaptive execution would part otherwise at each reading."""
    return audit.evenly_spaced(read(spark, sf, "documents"), "doc_id").select("doc_id", "source", "n_chars", "text")


def seeded_sample(spark, sf):
    return audit.seeded_sample(names(spark, sf).where("name is not null"), ["row_id"], 200).select("row_id", "name")


def partition_values(spark, sf):
    return audit.partition_values(read(spark, sf, "vendor_shipments"), "country_of_origin")


def stream_assign(spark, sf):
    """The typed names as a stream, assigned to the clusters of the register."""
    from kinfold.sources import sinks
    from kinfold.streaming import assign

    base = folder(spark, "stream")
    sinks.parquet(assign.cluster_table(cluster.cluster(read(spark, sf, "gleif"), "legal_name"), "legal_name"), f"{base}/known")
    typed = read(spark, sf, "name_records")
    arrivals = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/name_records.parque[t]")
    assign.start(arrivals, f"{base}/known", f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("record_id", "name", "cluster_id", "canonical_name")


def dba_alias_rows(spark, sf):
    return audit.alias_rows(read(spark, sf, "sam_entities"))


def partition_roundtrip(spark, sf):
    from kinfold.sources import sinks

    path = folder(spark, "partitions")
    sinks.partitioned(names(spark, sf).select("row_id", "block", "name"), path, "block")
    sinks.partitioned(names(spark, sf).select("row_id", "block", "name"), path, "block", skip_existing=True)  # finds all of them
    return spark.read.parquet(path).select("row_id", F.col("block").cast("string").alias("block"), "name")


def generate_examples(spark, sf):
    n = read(spark, sf, "part").count()
    return generate.generate_examples(spark, n_entities=n)


def generate_invariants(spark, sf):
    """(true_entity_id, true_canonical, kept): one to eight different variants for each entity, none of them blank."""
    each = generate_examples(spark, sf).groupBy("true_entity_id", "true_canonical")
    got = each.agg(F.count("*").alias("k"), F.count_distinct("variant_name").alias("d"), F.min(F.length(F.trim("variant_name"))).alias("shortest"))
    return got.select("true_entity_id", "true_canonical", F.expr("k = d and k between 1 and 8 and shortest > 0").alias("kept"))


# ---------------------------------------------------------------- SQL

_NORM = duckdb_normalize("name")
_BASE = f"""
WITH RECURSIVE names AS ({_NAMES.format(part="part").replace("STRING", "VARCHAR")}),
nn AS (SELECT *, {_NORM} AS norm FROM names),
u AS (SELECT min(row_id) AS id, norm, replace(norm, ' ', '') AS form, arg_min(name, row_id) AS first_raw, count(*) AS n_rows FROM nn WHERE norm <> '' GROUP BY norm)
"""
_GRAMS = """,
bag AS (SELECT id, i - 1 AS pos, substr(form, i, 3) AS gram FROM (SELECT id, form, unnest(range(1, length(form) - 1)) AS i FROM u WHERE length(form) >= 3) x),
gset AS (SELECT DISTINCT id, gram FROM bag),
idf AS (SELECT gram, count(*) AS df, ln((SELECT count(*) FROM u) / count(*)) AS idf FROM gset GROUP BY gram),
tf AS (SELECT id, gram, count(*) AS tf FROM bag GROUP BY id, gram),
w AS (SELECT tf.id, tf.gram, tf.tf * idf.idf AS w FROM tf JOIN idf USING (gram)),
vec AS (SELECT id, gram, CASE WHEN l > 0 THEN w / l ELSE 0 END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS l FROM w) x)
"""


def _coefficients(n: int) -> str:
    return "coef(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(grams.coefficients(n))) + ")"


def _signature(n: int) -> str:
    return f""",
{_coefficients(n)},
h AS (SELECT id, gram, CAST('0x' || substr(md5(gram), 1, 15) AS BIGINT) % 2147483647 AS h FROM gset),
sig AS (SELECT u.id, coef.i, coalesce(min((coef.a * h.h + coef.b) % 2147483647), 2147483647) AS value FROM u CROSS JOIN coef LEFT JOIN h ON h.id = u.id GROUP BY u.id, coef.i)
"""


_LSH = (
    _signature(BANDS * ROWS)
    + f""",
buckets AS (SELECT id, CAST(i // {ROWS} AS INTEGER) AS band, string_agg(CAST(value AS VARCHAR), '|' ORDER BY i) AS bucket FROM sig GROUP BY id, i // {ROWS}),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM buckets x JOIN buckets y ON x.band = y.band AND x.bucket = y.bucket AND x.id < y.id
  WHERE x.id IN (SELECT id FROM gset) AND (SELECT count(*) FROM u) >= 3),
scored AS (SELECT p.a, p.b, round(sum(x.w * y.w), 6) AS score FROM pairs p JOIN vec x ON x.id = p.a JOIN vec y ON y.id = p.b AND y.gram = x.gram GROUP BY p.a, p.b)
"""
)
_FULL = _BASE + _GRAMS + _LSH


def _graph(threshold: float) -> str:
    return f""",
e AS (SELECT a, b, score FROM scored WHERE score >= {threshold}),
ways AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT src AS id, src AS seen FROM ways UNION SELECT r.id, ways.dst FROM reach r JOIN ways ON ways.src = r.seen),
comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id),
deg AS (SELECT src AS id, count(*) AS degree FROM ways GROUP BY src),
nodes AS (SELECT comp.id, component, degree, norm FROM comp JOIN deg USING (id) JOIN u USING (id)),
hubs AS (SELECT component, arg_min(id, (-degree, norm)) AS hub_id, arg_min(norm, (-degree, norm)) AS hub, count(*) AS n FROM nodes GROUP BY component)
"""


#: One level of splitting: exact where no far piece is large enough to be split again, as in these tables.
_SPLIT = """,
near AS (SELECT component, hub_id AS id FROM hubs UNION SELECT component, dst FROM hubs JOIN ways ON src = hub_id
  UNION SELECT component, y.dst FROM hubs JOIN ways x ON x.src = hub_id JOIN ways y ON y.src = x.dst),
wide AS (SELECT component FROM hubs WHERE n >= 5 AND n > (SELECT count(*) FROM near WHERE near.component = hubs.component)),
far AS (SELECT id, component FROM nodes WHERE component IN (SELECT component FROM wide) AND (component, id) NOT IN (SELECT component, id FROM near)),
freach AS (SELECT id, id AS seen FROM far UNION SELECT r.id, ways.dst FROM freach r JOIN ways ON ways.src = r.seen JOIN far ON far.id = ways.dst),
fpiece AS (SELECT id, -1 - min(seen) AS piece FROM freach GROUP BY id),
pieces AS (SELECT nodes.id, coalesce(piece, component) AS piece, norm, degree, component IN (SELECT component FROM wide) AS flagged FROM nodes LEFT JOIN fpiece USING (id)),
phubs AS (SELECT piece, arg_min(norm, (-degree, norm)) AS hub FROM pieces GROUP BY piece)
"""


def _clustered(threshold: float) -> str:
    return _FULL + _graph(threshold) + _SPLIT + """,
canon AS (SELECT u.norm, coalesce(hub, u.norm) AS canonical FROM u LEFT JOIN pieces USING (id) LEFT JOIN phubs USING (piece)),
ids AS (SELECT norm, canonical, dense_rank() OVER (ORDER BY canonical) - 1 AS cluster_id FROM canon),
result AS (SELECT nn.row_id, nn.name, nn.true_entity, ids.cluster_id, ids.canonical AS canonical_name FROM nn LEFT JOIN ids ON ids.norm = nn.norm)
"""


_CLUSTER = "SELECT row_id, cluster_id, canonical_name FROM result"
_REGISTERS = " UNION ALL ".join(
    f"SELECT '{t}' AS source, {k} AS key, {n} AS name FROM {t}"
    for t, k, n in (("gleif", "lei", "legal_name"), ("uk_register", "company_number", "legal_name"), ("party_aliases", "alias_key", "name"), ("sam_entities", "uei", "legal_name"), ("name_records", "record_id", "name"))
)
_BUCKET = "round(0.3 + floor((score - 0.3) / ((1.0::DOUBLE - 0.3::DOUBLE) / 7)) * ((1.0::DOUBLE - 0.3::DOUBLE) / 7), 4)"
_MATCHES = f"m AS (SELECT name_a, name_b, score, {_BUCKET} AS bucket FROM match_pairs WHERE score IS NOT NULL AND NOT isnan(score) AND score >= 0.3 AND score < 1.0)"


def _tokens_sql(last: bool) -> str:
    token = "rtrim(words[-1], '.,;:')" if last else "ltrim(words[1], '.,;:')"
    return f"""SELECT token, count(*) AS n FROM (SELECT {token} AS token FROM (
      SELECT list_filter(regexp_split_to_array(lower(legal_name), '\\s+'), lambda w: w <> '') AS words FROM gleif WHERE legal_name IS NOT NULL) x) y
      WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 50"""


_N = duckdb_normalize
_SAMPLED = """, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0' || chr(31) || name_a || chr(31) || name_b), name_a, name_b) AS rn FROM (SELECT DISTINCT * FROM {m} WHERE name_a IS NOT NULL AND name_b IS NOT NULL) x)"""

SQL = {
    "normalize_names": f"{_BASE} SELECT row_id, norm FROM nn",
    "normalize_registers": f"SELECT source, key, {_N('name')} AS norm FROM ({_REGISTERS}) t",
    "normalize_sql": f"SELECT source, key, {_N('name')} AS norm FROM ({_REGISTERS}) t",
    "normalize_truncated": f"{_BASE} SELECT row_id, {_N('substr(name, 1, 12)')} AS norm FROM names",
    "comparison_forms": f"{_BASE} SELECT row_id, replace(norm, ' ', '') AS form FROM nn",
    "ngram_bag": f"{_BASE}{_GRAMS} SELECT id, CAST(pos AS INTEGER) AS pos, gram FROM bag",
    "ngram_set": f"{_BASE}{_GRAMS} SELECT id, gram FROM gset",
    "alias_rewrite": _BASE
    + ", al(canon, alias) AS (VALUES "
    + ", ".join(f"('{c}', '{a}')" for c, many in _aliases().items() for a in many)
    + f"), t AS (SELECT {_N('alias')} AS alias_norm, arg_max({_N('canon')}, canon) AS canon_norm FROM al GROUP BY 1)"
    + " SELECT row_id, coalesce(canon_norm, nullif(norm, '')) AS norm FROM nn LEFT JOIN t ON alias_norm = norm",
    "unique_names": f"{_BASE} SELECT id, norm, first_raw, n_rows FROM u",
    "gram_idf": f"{_BASE}{_GRAMS} SELECT gram, df, round(idf, 6) AS idf FROM idf",
    "tfidf_vectors": f"{_BASE}{_GRAMS} SELECT id, gram, round(w, 6) AS w FROM vec",
    "minhash_signature": f"{_BASE}{_GRAMS}{_signature(BANDS * ROWS)} SELECT id, i, value FROM sig",
    "minhash_expression": f"{_BASE}{_GRAMS}{_signature(BANDS * ROWS)} SELECT id, i, value FROM sig",
    "lsh_buckets": f"{_FULL} SELECT id, band, bucket FROM buckets",
    "lsh_pairs": f"{_FULL} SELECT a, b FROM pairs",
    "candidates": f"{_FULL} SELECT x.first_raw AS name_a, y.first_raw AS name_b, x.norm AS normalized_a, y.norm AS normalized_b, score FROM scored JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE score >= 0.5",
    "pair_scores_exact": f"{_BASE}{_GRAMS} SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS score FROM vec x JOIN vec y ON x.gram = y.gram AND x.id < y.id GROUP BY x.id, y.id HAVING round(sum(x.w * y.w), 6) >= 0.7",
    "threshold_edges": f"{_FULL} SELECT a, b, score FROM scored WHERE score >= 0.85",
    "degrees": f"{_FULL}{_graph(0.85)} SELECT id, degree FROM deg",
    "connected_components": f"{_FULL}{_graph(0.85)} SELECT id, component FROM comp",
    "hub_pick": f"{_FULL}{_graph(0.85)} SELECT component, hub, n FROM hubs",
    "bfs_from_hub": _FULL + _graph(0.85) + """, steps AS (SELECT component, hub_id AS id, 0 AS d FROM hubs UNION SELECT component, dst, d + 1 FROM steps JOIN ways ON src = id WHERE d < 20)
      SELECT component, id, min(d) AS distance FROM steps GROUP BY component, id""",
    "diameter_split": f"{_FULL}{_graph(0.85)}{_SPLIT} SELECT id, hub, flagged FROM pieces JOIN phubs USING (piece)",
    # of a chain the first piece is four nodes, the next ones three, until four or fewer are left
    "diameter_split_deep": """WITH c AS (SELECT c_custkey AS id, c_custkey % 12 AS j, (c_custkey // 12) % 12 + 1 AS n FROM customer WHERE c_custkey % 12 <= (c_custkey // 12) % 12),
      p AS (SELECT *, CASE WHEN j < 4 THEN 0 ELSE 1 + least((j - 4) // 3, greatest(0, (n - 8 + 2) // 3)) END AS k FROM c WHERE n > 1)
      SELECT id, id - j + CASE WHEN n < 5 OR k = 0 THEN 0 ELSE 1 + 3 * k END AS first, n >= 5 AS flagged FROM p""",
    "lsh_band_sizes": f"""{_FULL} SELECT band, count(*) AS n_buckets, CAST(sum(k) AS BIGINT) AS n_names, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n_pairs
      FROM (SELECT band, bucket, count(*) AS k FROM buckets WHERE id IN (SELECT id FROM gset) GROUP BY band, bucket) x GROUP BY band""",
    "cluster": f"{_clustered(0.95)} {_CLUSTER}",
    "cluster_default": f"{_clustered(0.85)} {_CLUSTER}",
    "cluster_sizes_top": f"{_clustered(0.95)} SELECT cluster_id, canonical_name, count(*) AS n FROM result WHERE cluster_id IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, cluster_id LIMIT 20",
    "explain_edges": _clustered(0.95) + """, big AS (SELECT cluster_id FROM result WHERE cluster_id IS NOT NULL GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1),
      mem AS (SELECT u.* FROM u WHERE norm IN (SELECT nn.norm FROM nn JOIN result USING (row_id) WHERE cluster_id = (SELECT cluster_id FROM big))),
      len AS (SELECT id, sqrt(sum(tf * tf)) AS l FROM tf GROUP BY id),
      dots AS (SELECT x.id AS a, y.id AS b, sum(x.tf * y.tf) AS d FROM tf x JOIN tf y ON x.gram = y.gram AND x.id < y.id WHERE x.id IN (SELECT id FROM mem) AND y.id IN (SELECT id FROM mem) GROUP BY 1, 2)
      SELECT x.first_raw AS name_a, y.first_raw AS name_b, round(coalesce(d / (lx.l * ly.l), 0), 6) AS score FROM mem x JOIN mem y ON x.id < y.id LEFT JOIN dots ON a = x.id AND b = y.id
      LEFT JOIN len lx ON lx.id = x.id LEFT JOIN len ly ON ly.id = y.id""",
    "acronym_map": f"""WITH r AS (SELECT p_partkey AS row_id, concat(p_name, ' ', p_type) AS name FROM part UNION ALL
      SELECT p_partkey + 1000000000, concat(upper(substring(p_name, 1, 1)), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(p_type, 1, 1)) FROM part),
      n AS (SELECT row_id, name, {_N('name')} AS norm FROM r), t AS (SELECT *, string_split(norm, ' ') AS w FROM n WHERE norm <> ''),
      s AS (SELECT norm AS acronym, list(name ORDER BY row_id)[1:5] AS acronym_examples FROM t WHERE len(w) = 1 AND length(norm) BETWEEN 2 AND 6 GROUP BY norm),
      l AS (SELECT DISTINCT row_id, name, norm, unnest([array_to_string(list_transform(w, lambda x: x[1]), ''), array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ('and','of','the','for','in','by','to','a')), lambda x: x[1]), '')]) AS acronym FROM t WHERE len(w) >= 2)
      SELECT acronym, count(DISTINCT norm) AS expansion_count, list(name ORDER BY row_id)[1:10] AS expansions, any_value(acronym_examples) AS acronym_examples FROM l JOIN s USING (acronym) GROUP BY acronym""",
    "score_clusters": _clustered(0.95) + """, k AS (SELECT coalesce(CAST(cluster_id AS VARCHAR), '#' || row_id) AS p, true_entity AS t FROM result), c AS (SELECT p, t, count(*) AS n FROM k GROUP BY p, t),
      x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY p) q) AS pp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY t) q) AS tp,
        (SELECT count(DISTINCT p) FROM c) AS np, (SELECT count(DISTINCT t) FROM c) AS nt, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n)
      SELECT round((b - pp * tp / (n * (n - 1) / 2)) / ((pp + tp) / 2 - pp * tp / (n * (n - 1) / 2)), 6) AS adjusted_rand, round(2 * (b / pp) * (b / tp) / (b / pp + b / tp), 6) AS f1_pairs,
        round(b / pp, 6) AS "precision", round(b / tp, 6) AS recall, np AS n_predicted_clusters, nt AS n_true_clusters, n AS n_items FROM x""",
    "lsh_calibrate_grid": """WITH q(target, recall) AS (VALUES (0.5::DOUBLE, 0.95::DOUBLE), (0.7, 0.9), (0.85, 0.95), (0.6, 0.99)), p(k) AS (VALUES (16), (32), (48), (64), (96), (128), (192), (256), (384), (512), (768), (1024)),
      g AS (SELECT q.*, k, r, k // r AS bands FROM q CROSS JOIN p CROSS JOIN (SELECT unnest(range(1, 1025)) AS r) x WHERE k % r = 0),
      f AS (SELECT *, 1 - pow(1 - pow(target, r), bands) AS hit, 1 - pow(1 - pow(target / 2, r), bands) AS fp FROM g),
      ok AS (SELECT *, row_number() OVER (PARTITION BY target, recall ORDER BY k, fp, r) AS rn FROM f WHERE hit >= recall)
      SELECT target, recall, CAST(bands AS INTEGER) AS bands, CAST(r AS INTEGER) AS band_rows, CAST(k AS INTEGER) AS num_perm, round(hit, 6) AS p_at_target, round(fp, 6) AS p_at_fp FROM ok WHERE rn = 1""",
    "score_buckets": f"WITH {_MATCHES} SELECT * FROM m",
    "bucket_distribution": f"WITH {_MATCHES}, b AS (SELECT round(0.3 + i * ((1.0::DOUBLE - 0.3::DOUBLE) / 7), 4) AS bucket FROM (SELECT unnest(range(7)) AS i) x) SELECT b.bucket, count(m.score) AS n FROM b LEFT JOIN m ON m.bucket = b.bucket GROUP BY b.bucket",
    "bucket_sample": f"WITH {_MATCHES}{_SAMPLED.format(m='m')} SELECT name_a, name_b, score, bucket FROM r WHERE rn <= 50",
    "context_join": """WITH p AS (SELECT DISTINCT name_a, name_b, score FROM match_pairs WHERE score IS NOT NULL AND NOT isnan(score)),
      k AS (SELECT name, block, channel, record_id || CAST(epoch_us(loaded_at) AS VARCHAR) AS row_key FROM name_records WHERE name IS NOT NULL),
      c AS (SELECT name, arg_min(block, row_key) FILTER (block IS NOT NULL) AS block, arg_min(channel, row_key) FILTER (channel IS NOT NULL) AS channel FROM k GROUP BY name)
      SELECT name_a, name_b, score, x.block AS block_a, y.block AS block_b, x.channel AS channel_a, y.channel AS channel_b FROM p LEFT JOIN c x ON x.name = name_a LEFT JOIN c y ON y.name = name_b""",
    "evaluation_set": f"""{_FULL}, m AS (SELECT x.first_raw AS name_a, y.first_raw AS name_b, x.norm AS normalized_a, y.norm AS normalized_b, score, {_BUCKET} AS bucket FROM scored JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE score >= 0.3 AND score < 1.0)
      {_SAMPLED.format(m='m')}, c AS (SELECT name, arg_min(block, row_id) AS block FROM names WHERE name IS NOT NULL GROUP BY name)
      SELECT name_a, name_b, score, bucket, x.block AS block_a, y.block AS block_b, normalized_a, normalized_b FROM r JOIN c x ON x.name = name_a JOIN c y ON y.name = name_b WHERE rn <= 50""",
    "audit_stats": _BASE + """, n AS (SELECT name, norm, nullif(norm, '') AS f FROM nn WHERE length(name) > 0) SELECT count(*) AS n_input, count(*) FILTER (norm = '') AS n_empty, count(*) FILTER (length(norm) = 1) AS n_one_char,
      count(*) FILTER (lower(trim(name)) <> norm) AS n_changed, round(avg(length(f)), 6) AS chars_mean, CAST(min(length(f)) AS INTEGER) AS chars_min, CAST(max(length(f)) AS INTEGER) AS chars_max, quantile_cont(length(f), 0.5) AS chars_median,
      round(stddev_samp(length(f)), 6) AS chars_std, round(avg(len(string_split(f, ' '))), 6) AS words_mean, CAST(min(len(string_split(f, ' '))) AS INTEGER) AS words_min, CAST(max(len(string_split(f, ' '))) AS INTEGER) AS words_max,
      quantile_cont(len(string_split(f, ' ')), 0.5) AS words_median FROM n""",
    "audit_describe": f"""WITH f AS (SELECT nullif({_N('name')}, '') AS f FROM ({_REGISTERS}) t WHERE length(name) > 0),
      m AS (SELECT 'chars' AS measure, length(f) AS x FROM f UNION ALL SELECT 'words', len(string_split(f, ' ')) FROM f)
      SELECT measure, count(x) AS n, count(*) - count(x) AS n_null, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, CAST(min(x) AS INTEGER) AS "min",
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, CAST(max(x) AS INTEGER) AS "max" FROM m GROUP BY measure""",
    "audit_apart": f"""WITH c AS (SELECT entity_id, {_N('name')} AS norm, count(*) AS n FROM party_aliases GROUP BY 1, 2),
      e AS (SELECT entity_id FROM c WHERE norm <> '' GROUP BY entity_id HAVING count(*) > 1 ORDER BY entity_id NULLS FIRST LIMIT 10)
      SELECT entity_id, norm, n FROM c JOIN e USING (entity_id) WHERE norm <> ''""",
    "audit_collisions": _BASE + " SELECT norm, count(*) AS n FROM nn WHERE norm <> '' AND length(name) > 0 GROUP BY norm ORDER BY n DESC, norm LIMIT 100",
    "audit_alias_recall": f"""WITH f AS (SELECT entity_id, {_N('name')} AS norm FROM party_aliases), c AS (SELECT entity_id, norm, count(*) AS n FROM f WHERE norm <> '' GROUP BY 1, 2),
      e AS (SELECT entity_id, sum(n) AS k, sum(n * (n - 1) // 2) AS same, count(*) AS forms FROM c GROUP BY entity_id HAVING sum(n) >= 2)
      SELECT count(*) AS n_entities_with_aliases, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS total_pairs, CAST(sum(same) AS BIGINT) AS matching_pairs, count(*) FILTER (forms = 1) AS entities_collapsed_fully FROM e""",
    "audit_tail_tokens": _tokens_sql(True),
    "audit_head_tokens": _tokens_sql(False),
    "audit_sample": _BASE + """, c AS (SELECT row_id, name, norm, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM nn WHERE norm <> '' AND lower(trim(name)) <> norm)
      SELECT row_id, name, norm FROM c WHERE k % greatest(1, n // 20) = 0 AND k < greatest(1, n // 20) * 20""",
    "sample_evenly": """WITH c AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
      SELECT doc_id, source, n_chars, text FROM c WHERE k % greatest(1, n // 20) = 0 AND k < greatest(1, n // 20) * 20""",
    "dba_alias_rows": """SELECT uei AS entity_id, 'Entity' AS entity_type, true AS is_primary, 'PRIMARY' AS alias_type, legal_name AS name FROM sam_entities WHERE length(legal_name) > 0
      UNION ALL SELECT uei, 'Entity', false, 'DBA', dba_name FROM sam_entities WHERE length(dba_name) > 0 AND dba_name <> legal_name""",
    "generate_invariants": """WITH w AS (SELECT string_split('North South Blue Green Silver Golden Summit River Harbor Pioneer Liberty Atlas Orion', ' ') AS a, string_split('Bridge Ridge Field Stone', ' ') AS b,
      string_split('Manufacturing,Trading,Foods,Technologies,Holdings,Services,Import Export,Solutions,Industries,International Group,Development', ',') AS c, string_split('Inc LLC Ltd Limited Corp Corporation Co Company LLP LP PLC', ' ') AS d),
      i AS (SELECT i, i % 52 AS j, i // 52 AS lap FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS i) x)
      SELECT i AS true_entity_id, a[j % 13 + 1] || ' ' || b[j // 13 % 4 + 1] || ' ' || c[j % 11 + 1] || ' ' || d[j % 11 + 1] || CASE WHEN lap > 0 THEN ' ' || lap ELSE '' END AS true_canonical, true AS kept FROM i, w""",
    "partition_roundtrip": f"{_BASE} SELECT row_id, block, name FROM names WHERE block IS NOT NULL",
    "cluster_threshold_sweep": " UNION ALL ".join(f"SELECT * FROM ({_clustered(t)} SELECT {t}::DOUBLE AS threshold, count(DISTINCT cluster_id) AS n_clusters, count(*) FILTER (cluster_id IS NULL) AS n_null FROM result)" for t in (0.9, 0.95, 0.99)),
}
_EXACT = _BASE + _GRAMS + """,
scored AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS score FROM vec x JOIN vec y ON x.gram = y.gram AND x.id < y.id WHERE (SELECT count(*) FROM u) >= 3 GROUP BY x.id, y.id)
"""
SQL["cluster_exact"] = SQL["cluster"].replace(_FULL, _EXACT)
_ALIASED = f"""
al(canon, alias) AS (VALUES {", ".join(f"('{c}', '{a}')" for c, many in _aliases().items() for a in many)}),
alt AS (SELECT {_N('alias')} AS alias_norm, arg_max({_N('canon')}, canon) AS canon_norm FROM al GROUP BY 1),
nn AS (SELECT names.*, coalesce(canon_norm, {_NORM}) AS norm FROM names LEFT JOIN alt ON alias_norm = {_NORM}),
"""
SQL["cluster_alias"] = SQL["cluster"].replace(f"nn AS (SELECT *, {_NORM} AS norm FROM names),", _ALIASED.strip())


def _blocked(rows: str, out: str, threshold: float) -> str:
    """Blocks in every key: document frequencies, pairs and ids. No component is wide enough to be split here."""
    return f"""
WITH RECURSIVE names AS ({rows}),
nn AS (SELECT *, {_NORM} AS norm FROM names WHERE block IS NOT NULL),
u AS (SELECT min(row_id) AS id, block, norm, replace(norm, ' ', '') AS form FROM nn WHERE norm <> '' GROUP BY block, norm),
bag AS (SELECT id, block, substr(form, i, 3) AS gram FROM (SELECT id, block, form, unnest(range(1, length(form) - 1)) AS i FROM u WHERE length(form) >= 3) x),
gset AS (SELECT DISTINCT id, block, gram FROM bag),
docs AS (SELECT block, count(*) AS n FROM u GROUP BY block),
idf AS (SELECT block, gram, ln(any_value(n) / count(*)) AS idf FROM gset JOIN docs USING (block) GROUP BY block, gram),
w AS (SELECT id, block, gram, tf * idf AS w FROM (SELECT id, block, gram, count(*) AS tf FROM bag GROUP BY id, block, gram) t JOIN idf USING (block, gram)),
vec AS (SELECT id, block, gram, CASE WHEN l > 0 THEN w / l ELSE 0 END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS l FROM w) x)
{_signature(BANDS * ROWS)},
buckets AS (SELECT id, block, i // {ROWS} AS band, string_agg(CAST(value AS VARCHAR), '|' ORDER BY i) AS bucket FROM sig JOIN u USING (id) GROUP BY id, block, i // {ROWS}),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM buckets x JOIN buckets y ON x.block = y.block AND x.band = y.band AND x.bucket = y.bucket AND x.id < y.id JOIN docs ON docs.block = x.block
  WHERE n >= 3 AND x.id IN (SELECT id FROM gset)),
scored AS (SELECT p.a, p.b, round(sum(x.w * y.w), 6) AS score FROM pairs p JOIN vec x ON x.id = p.a JOIN vec y ON y.id = p.b AND y.gram = x.gram GROUP BY p.a, p.b)
{_graph(threshold)},
canon AS (SELECT u.block, u.norm, coalesce(hub, u.norm) AS canonical FROM u LEFT JOIN nodes USING (id) LEFT JOIN hubs USING (component)),
ids AS (SELECT block, norm, canonical, dense_rank() OVER (PARTITION BY block ORDER BY canonical) - 1 AS cluster_id FROM canon)
SELECT {out}, ids.cluster_id, ids.canonical AS canonical_name FROM names LEFT JOIN ids ON ids.block = names.block AND ids.norm = {_N('names.name')}
"""


SQL["cluster_blocked"] = _blocked(_NAMES.format(part="part").replace("STRING", "VARCHAR"), "names.row_id", 0.95)
SQL["cluster_vendors_by_country"] = _blocked(
    "SELECT row_number() OVER (ORDER BY country_of_origin, vendor_name) AS row_id, country_of_origin AS block, vendor_name AS name FROM (SELECT DISTINCT country_of_origin, vendor_name FROM vendor_shipments WHERE country_of_origin IS NOT NULL) x",
    "names.block AS country_of_origin, names.name AS vendor_name", 0.95,
)
_R = _BASE.replace(_NAMES.format(part="part").replace("STRING", "VARCHAR"), "SELECT row_number() OVER (ORDER BY lei, legal_name) AS row_id, lei, legal_name AS name, '' AS true_entity FROM gleif")
SQL["cluster_register"] = SQL["cluster_default"].replace(_BASE, _R).replace("SELECT nn.row_id, nn.name", "SELECT nn.lei, nn.row_id, nn.name").replace(_CLUSTER, "SELECT lei, cluster_id, canonical_name FROM result")
_A = _BASE.replace(_NAMES.format(part="part").replace("STRING", "VARCHAR"), f"SELECT row_number() OVER (ORDER BY source, key, name) AS row_id, source, key, name, '' AS true_entity FROM ({_REGISTERS}) t")
SQL["cluster_registers"] = SQL["cluster_default"].replace(_BASE, _A).replace("SELECT nn.row_id, nn.name", "SELECT nn.source, nn.key, nn.row_id, nn.name").replace(_CLUSTER, "SELECT source, key, cluster_id, canonical_name FROM result")
SQL["seeded_sample"] = _BASE + " SELECT row_id, name FROM names WHERE name IS NOT NULL ORDER BY md5('0' || chr(31) || row_id), row_id LIMIT 200"
SQL["partition_values"] = "SELECT DISTINCT country_of_origin FROM vendor_shipments WHERE country_of_origin IS NOT NULL"
SQL["stream_assign"] = SQL["cluster_register"].replace(
    "SELECT lei, cluster_id, canonical_name FROM result",
    f"SELECT record_id, r.name, i.cluster_id, i.canonical AS canonical_name FROM name_records r LEFT JOIN ids i ON i.norm = {_N('r.name')}",
)

QUERIES = {
    "normalize_names": normalize_names, "normalize_registers": normalize_registers, "normalize_sql": normalize_sql, "transliterate_registers": transliterate_registers, "normalize_truncated": normalize_truncated, "comparison_forms": comparison_forms,
    "ngram_bag": ngram_bag, "ngram_set": ngram_set, "alias_rewrite": alias_rewrite, "unique_names": unique_names, "gram_idf": gram_idf, "tfidf_vectors": tfidf_vectors,
    "minhash_signature": minhash_signature, "minhash_expression": minhash_expression, "lsh_buckets": lsh_buckets, "lsh_pairs": lsh_pairs, "candidates": candidates,
    "pair_scores_exact": pair_scores_exact, "threshold_edges": threshold_edges, "degrees": degrees, "connected_components": connected_components, "hub_pick": hub_pick,
    "bfs_from_hub": bfs_from_hub, "diameter_split": diameter_split, "diameter_split_deep": diameter_split_deep, "lsh_band_sizes": lsh_band_sizes, "cluster": _cluster(0.95), "cluster_default": _cluster(0.85), "cluster_alias": _cluster(0.95, aliases=_aliases()),
    "cluster_exact": _cluster(0.95, blocking="exact"), "cluster_blocked": cluster_blocked, "cluster_register": cluster_register, "cluster_registers": cluster_registers, "cluster_vendors_by_country": cluster_vendors_by_country,
    "cluster_threshold_sweep": cluster_threshold_sweep, "cluster_sizes_top": cluster_sizes_top, "explain_edges": explain_edges, "acronym_map": acronym_map, "score_clusters": score_clusters,
    "lsh_calibrate_grid": lsh_calibrate_grid, "score_buckets": score_buckets, "bucket_distribution": bucket_distribution, "bucket_sample": bucket_sample, "context_join": context_join,
    "evaluation_set": evaluation_set, "audit_stats": audit_stats, "audit_describe": audit_describe, "audit_apart": audit_apart, "audit_collisions": audit_collisions, "audit_alias_recall": audit_alias_recall, "audit_tail_tokens": audit_tail_tokens,
    "audit_head_tokens": audit_head_tokens, "audit_sample": audit_sample, "sample_evenly": sample_evenly, "seeded_sample": seeded_sample, "partition_values": partition_values, "stream_assign": stream_assign, "dba_alias_rows": dba_alias_rows, "partition_roundtrip": partition_roundtrip, "generate_examples": generate_examples, "generate_invariants": generate_invariants,
}
