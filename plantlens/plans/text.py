"""Queries over tags, listings, paths and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import tags
from plantlens.operators import joins, ordering
from plantlens.plans.loops import matches_query
from plantlens.registry import Registry, table
from plantlens.sources import listings

REGISTRY = Registry()
query = REGISTRY.query

_TAG_SQL = "concat(['AI','AO','DI','DO'][l_linenumber % 4 + 1], l_quantity::INT, '-', lpad((l_suppkey % 100)::VARCHAR, 2, '0'), '/', l_orderkey)"
_TAG = r"^(AI|AO|DI|DO)(\d+)?(?:-([A-Za-z0-9]+))?(?:/(.+))?$"


def io_tags(lineitem: DataFrame) -> DataFrame:
    """A tag for each lineitem: type, channel, slave and device."""
    kind = F.element_at(F.array(*[F.lit(t) for t in ("AI", "AO", "DI", "DO")]), F.col("l_linenumber") % 4 + 1)
    return lineitem.withColumn("tag", F.concat(kind, F.col("l_quantity").cast("int").cast("string"), F.lit("-"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.lit("/"), F.col("l_orderkey").cast("string")))


@query(f"""
    WITH t AS (SELECT {_TAG_SQL} AS tag FROM lineitem),
    p AS (SELECT upper(regexp_extract(tag, '{_TAG}', 1, 'i')) AS io_type, regexp_extract(tag, '{_TAG}', 2, 'i') AS channel, regexp_extract(tag, '{_TAG}', 3, 'i') AS slave, regexp_extract(tag, '{_TAG}', 4, 'i') AS device
          FROM t WHERE regexp_matches(tag, '^(AI|AO|DI|DO)\\d', 'i'))
    SELECT io_type, slave, count(*) AS n_points, count(DISTINCT device) AS n_devices, max(channel::BIGINT) AS max_channel FROM p GROUP BY ALL""")
def io_tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = io_tags(table(spark, sf_dir, "lineitem")).where(tags.is_physical_io(F.col("tag"))).select(tags.parse_io_tag(F.col("tag")).alias("p")).select("p.*")
    return parsed.groupBy("io_type", "slave").agg(F.count("*").alias("n_points"), F.count_distinct("device_tag").alias("n_devices"), F.max(F.col("channel").cast("long")).alias("max_channel"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    h AS (SELECT *, CASE WHEN length(line) <= 40 THEN line END AS header FROM l),
    c AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section,
                 sum(CASE WHEN header IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM h)
    SELECT doc_id, run::BIGINT AS run, any_value(section) AS section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM c GROUP BY doc_id, run""")
def listing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = listings.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    header = F.when(F.length("line") <= 40, F.col("line"))
    carried = ordering.carry_forward(lines, header, "section", ["doc_id"], ["n"])
    runs = ordering.number_runs(carried, header.isNotNull(), "run", ["doc_id"], ["n"])
    return runs.groupBy("doc_id", "run").agg(F.first("section").alias("section"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""
    WITH r AS (SELECT doc_id, nullif(trim(substr(text, 1, 32)), '') AS description, nullif(trim(substr(text, 33, 16)), '') AS source, length(substr(text, 49))::BIGINT AS rest,
                      rpad(concat(lpad((doc_id % 100)::VARCHAR, 2, '0'), lpad((n_chars % 100)::VARCHAR, 2, '0'), '-', lpad((doc_id % 90)::VARCHAR, 2, '0'), '.', lpad((n_chars % 70)::VARCHAR, 2, '0')), 10, ' ') AS address FROM documents)
    SELECT doc_id, description, source, rest, regexp_extract(address, '^([A-Z0-9 ]{2})([A-Z0-9 ]{2})-(\d{2})\.(\d{2})', 1) AS prefix, regexp_extract(address, '^([A-Z0-9 ]{2})([A-Z0-9 ]{2})-(\d{2})\.(\d{2})', 2) AS sheet,
           regexp_extract(address, '^([A-Z0-9 ]{2})([A-Z0-9 ]{2})-(\d{2})\.(\d{2})', 3) AS zone_row, regexp_extract(address, '^([A-Z0-9 ]{2})([A-Z0-9 ]{2})-(\d{2})\.(\d{2})', 4) AS zone_column FROM r""")
def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    docs = table(spark, sf_dir, "documents")
    address = F.concat(two(F.col("doc_id") % 100), two(F.col("n_chars") % 100), F.lit("-"), two(F.col("doc_id") % 90), F.lit("."), two(F.col("n_chars") % 70))
    ref = tags.parse_reference(address)
    cut = listings.fixed_columns(F.col("text"))
    return docs.select("doc_id", cut["description"].alias("description"), cut["source"].alias("source"), F.length(cut["rest"]).cast("long").alias("rest"), ref["prefix"].alias("prefix"), ref["sheet"].alias("sheet"), ref["row"].alias("zone_row"), ref["column"].alias("zone_column"))


@query(r"""
    WITH p AS (SELECT CASE (page_id % 5) WHEN 0 THEN 'cad' WHEN 1 THEN 'OUT' WHEN 2 THEN 'm1' WHEN 3 THEN 'xyz' END AS ext, length(html) AS size FROM pages)
    SELECT CASE lower(ext) WHEN 'cad' THEN 'CAD' WHEN 'out' THEN 'OUT' WHEN 'm1' THEN 'M1' ELSE 'OTHER' END AS kind, count(*) AS n_files, sum(size)::BIGINT AS n_chars FROM p GROUP BY 1 ORDER BY n_files DESC, kind""")
def inventory_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.concat(F.lit("a/b"), F.when(k == 0, ".cad").when(k == 1, ".OUT").when(k == 2, ".m1").when(k == 3, ".xyz").otherwise(""))
    files = table(spark, sf_dir, "pages").select(tags.file_kind(tags.extension(path)).alias("kind"), F.length("html").alias("size"))
    return files.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_chars")).orderBy(F.desc("n_files"), "kind")


@query(r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, nullif(regexp_extract(url, '/(\w\w)/\d+', 1), '') AS lang, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM pages)
    SELECT host, count(*) AS n, max_by(lang, page_id) FILTER (lang IS NOT NULL) AS last_lang, max_by(page, page_id) FILTER (page IS NOT NULL) AS last_page FROM u GROUP BY host""")
def provenance_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", tags.part(url, r"^https?://([^/]+)/", 1).alias("host"), tags.part(url, r"/(\w\w)/\d+", 1).alias("lang"), tags.part(url, r"page=(\d+)", 1).alias("page"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_id"))).alias(f"last_{c}")
    return pages.groupBy("host").agg(F.count("*").alias("n"), last("lang"), last("page"))


@query("""
    SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k, concat('user ', user_id, ' saw ', json_extract_string(props, '$.k'), '!') AS label,
           CASE WHEN json_extract_string(props, '$.k')::BIGINT >= 50 THEN true ELSE false END AS high FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    values = F.create_map(F.lit("USER"), F.col("user_id").cast("string"), F.lit("K"), k)
    return table(spark, sf_dir, "events").select("event_id", "user_id", k.cast("long").alias("k"), tags.expand_keys(F.lit("user $USER$ saw $K$!"), values).alias("label"), (k.cast("long") >= 50).alias("high"))


@query("""
    WITH e AS (SELECT user_id, event_type, event_id, json_extract_string(props, '$.k') AS k FROM events)
    SELECT user_id, event_type, replace(replace('AREA_$K$.TYPE_$T$', '$K$', max_by(k, event_id)), '$T$', event_type) AS tag, count(*) AS n FROM e GROUP BY user_id, event_type""")
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("expression", F.concat(F.lit('K "'), F.get_json_object("props", "$.k"), F.lit('" T "'), F.col("event_type"), F.lit('"')))
    last = events.groupBy("user_id", "event_type").agg(F.max_by("expression", "event_id").alias("expression"), F.count("*").alias("n"))
    return last.select("user_id", "event_type", tags.expand_keys(F.lit("AREA_$K$.TYPE_$T$"), tags.instance_parameters(F.col("expression"))).alias("tag"), "n")


@query(r"""
    WITH k AS (SELECT lang, CASE WHEN regexp_matches(text, '[0-9]{3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') THEN 'ADDRESS' WHEN regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]') THEN 'CONTACT'
                   WHEN regexp_matches(text, '\|') THEN 'TABLE' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'NOTICE' WHEN length(text) = 0 THEN 'EMPTY' ELSE 'TEXT' END AS kind, length(text) AS size FROM documents)
    SELECT lang, kind, count(*) AS n, sum(size)::BIGINT AS n_chars FROM k GROUP BY ALL""")
def binding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rules = [(text.rlike(r"[0-9]{3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "ADDRESS"), (text.rlike("[A-Za-z0-9]@[A-Za-z0-9]"), "CONTACT"), (text.contains("|"), "TABLE"), (text.rlike("(?i)licen[sc]e"), "NOTICE"), (F.length(text) == 0, "EMPTY")]
    kind = listings.first_match(rules, "TEXT")
    return table(spark, sf_dir, "documents").select("lang", kind.alias("kind"), F.length(text).alias("size")).groupBy("lang", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("n_chars"))


@query("""
    SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size <= 25 AND (lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' OR lower(p_type) LIKE '%red%' OR lower(p_brand) LIKE '%#12%')""")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    found = matches_query(["p_name", "p_brand", "p_type"], "red") | matches_query(["p_brand"], "#12")
    return part.where((F.col("p_size") <= 25) & found).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""
    WITH m AS (SELECT c_mktsegment AS parent, c_custkey AS child, c_name, c_acctbal < 0 AS hit FROM customer), p AS (SELECT parent, bool_or(parent LIKE '%B%') AS parent_hit FROM m GROUP BY parent)
    SELECT parent, count(*) AS n_children, min(child) AS first_child FROM m JOIN p USING (parent) WHERE parent_hit OR hit GROUP BY parent""")
def hierarchical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("parent"), F.col("c_custkey").alias("child"), (F.col("c_acctbal") < 0).alias("hit"))
    return rows.where(F.col("parent").contains("B") | F.col("hit")).groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"))


@query("""
    WITH k AS (SELECT 'seg:' || c_mktsegment AS key, 'customer:' || c_custkey AS target FROM customer UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
               UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION SELECT 'n:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier)
    SELECT key, count(*) AS n_targets, min(target) AS first_target FROM k WHERE length(key) >= 4 GROUP BY key""")
def io_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    links = customer.select(F.explode(F.array(key("seg:", "c_mktsegment"), key("nation:", "c_nationkey"))).alias("key"), key("customer:", "c_custkey").alias("target"))
    links = links.union(supplier.select(F.explode(F.array(key("nation:", "s_nationkey"), key("n:", "s_nationkey"))).alias("key"), key("supplier:", "s_suppkey").alias("target")))
    return links.where(F.length("key") >= 4).distinct().groupBy("key").agg(F.count("*").alias("n_targets"), F.min("target").alias("first_target"))


def _common_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    tokens = lambda df: df.select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return joins.bag_intersection(tokens(left), tokens(right), ["token"])


@query("""
    WITH a AS (SELECT unnest(string_split(lower(text), ' ')) AS token FROM documents), b AS (SELECT unnest(string_split(lower(text), ' ')) AS token FROM benchmark),
    x AS (SELECT token, count(*) AS n FROM a GROUP BY token), y AS (SELECT token, count(*) AS n FROM b GROUP BY token)
    SELECT token, least(x.n, y.n) AS n FROM x JOIN y USING (token)""")
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _common_tokens(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _profile(texts: DataFrame) -> DataFrame:
    """(place, class, n): characters of each class at each place, counted before the shuffle."""
    chars = texts.where(F.length("text") > 0).select(F.posexplode(F.split("text", "")).alias("p", "ch")).where(F.col("ch") != "")
    kind = F.when(F.col("ch").rlike("[A-Za-z]"), "letter").when(F.col("ch").rlike("[0-9]"), "digit").when(F.col("ch").isin(" ", "\t", "\n"), "space").otherwise("other")
    return chars.groupBy((F.col("p") + 1).cast("long").alias("place"), kind.alias("class")).agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT regexp_extract_all(text, '(?s).') AS cs FROM documents), k AS (SELECT unnest(cs) AS ch, unnest(generate_series(1, len(cs))) AS place FROM c)
    SELECT place, CASE WHEN regexp_matches(ch, '[A-Za-z]') THEN 'letter' WHEN regexp_matches(ch, '[0-9]') THEN 'digit' WHEN ch IN (' ', chr(9), chr(10)) THEN 'space' ELSE 'other' END AS class, count(*) AS n FROM k GROUP BY ALL""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "documents"))


@query("""
    WITH t AS (SELECT unnest(string_split(url, '/')) AS piece, page_id FROM pages)
    SELECT piece, count(*) AS n, count(DISTINCT page_id) AS n_pages, min(length(piece))::BIGINT AS least, max(length(piece))::BIGINT AS most FROM t GROUP BY piece""")
def field_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "/")).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"), F.min(F.length("piece")).cast("long").alias("least"), F.max(F.length("piece")).cast("long").alias("most"))


@query("""
    WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS size FROM conversations),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT conv_id, role, min(turn) AS first_at, max(turn) AS last_at, count(*) AS n FROM n GROUP BY conv_id, run, role""")
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.merge_runs(table(spark, sf_dir, "conversations"), "role", "turn", ["conv_id"], ["turn"])


