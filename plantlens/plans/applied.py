"""Queries that shape the tables into the input of a domain operator, call it, and give its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import numbers, tags
from plantlens.operators import joins
from plantlens.plans import details, displays, loops, reports, specs
from plantlens.registry import Registry, table
from plantlens.sources import listings

REGISTRY = Registry()
query = REGISTRY.query


def _text(name: str, array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",").alias(name)


@query("""
    SELECT coalesce(p_size::VARCHAR, '(total)') AS fc, count(*) AS n_blocks, count(DISTINCT p_brand) AS n_sheets FROM part GROUP BY ROLLUP (p_size)""")
def spec_block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.block_summary(table(spark, sf_dir, "part").select(F.col("p_size").alias("fc"), F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("block")))


@query("""
    WITH n AS (SELECT s.c_mktsegment AS class, o_orderpriority AS role, coalesce(t.c_mktsegment, '(missing)') AS t, count(*) AS n
               FROM orders JOIN customer s ON o_custkey = s.c_custkey LEFT JOIN customer t ON t.c_custkey = o_orderkey GROUP BY ALL)
    SELECT class, role, 'orders[]' AS field, sum(n)::BIGINT AS n, string_agg(concat(t, ' ', n), ', ' ORDER BY t) AS targets FROM n GROUP BY class, role""")
def reference_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are objects of a class, orders references that point to the customer of their own number, or to none."""
    objects = table(spark, sf_dir, "customer").select(F.lit("db").alias("path"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class"))
    field = F.concat(F.lit("orders["), F.col("o_orderkey").cast("string"), F.lit("]")).alias("field")
    references = table(spark, sf_dir, "orders").select(F.lit("db").alias("path"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("role"), field, F.col("o_orderkey").alias("target"))
    return displays.role_evidence(objects, references)


@query("""
    SELECT l_suppkey AS tag, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS atoms, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS instances,
           string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS templates FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1""")
def binding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tag"), F.col("l_linenumber").cast("string").alias("atom"), F.col("l_partkey").cast("string").alias("instance"), F.col("l_returnflag").alias("template")
    )
    return displays.tag_index(bindings).select("tag", *[_text(c, c) for c in ("atoms", "instances", "templates")])


@query("""
    WITH k AS (SELECT o_orderpriority AS template, unnest([o_orderstatus, o_orderpriority]) AS key FROM orders)
    SELECT template, (count(*) // 2)::BIGINT AS n_instances, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM k GROUP BY template""")
def instance_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("template"), F.col("o_orderkey").alias("instance"), F.array("o_orderstatus", "o_orderpriority").alias("keys"))
    return displays.template_report(instances).select("template", "n_instances", _text("keys", "keys"))


@query("""
    WITH r AS (SELECT concat('T', l_partkey) AS point, concat(lpad(l_suppkey::VARCHAR, 5, '0'), '0', l_linenumber, 'C') AS sheet, l_quantity::INTEGER % 7 = l_linenumber AS main, concat('to ', l_returnflag) AS other,
                      l_orderkey, l_linenumber, l_suppkey FROM lineitem),
    k AS (SELECT point, count(*) AS n_rows, arg_min(struct_pack(sheet := sheet, o := l_orderkey), struct_pack(m := CASE WHEN main THEN 0 ELSE 1 END, o := l_orderkey, n := l_linenumber, s := l_suppkey)) AS kept,
                 list_distinct(list_concat(list(sheet), list(other))) AS every FROM r GROUP BY point)
    SELECT point, kept.sheet AS sheet, kept.o AS l_orderkey, n_rows, array_to_string(list_sort(list_filter(every, lambda x: x <> kept.sheet)), ',') AS destination_sheets FROM k""")
def io_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sheet = F.concat(F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.lit("0"), F.col("l_linenumber").cast("string"), F.lit("C"))
    records = lines.select(
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("raw"), sheet.alias("sheet"), (F.round("l_quantity").cast("int") % 7).cast("string").alias("slave"),
        F.array(F.struct(F.concat(F.lit("to "), "l_returnflag").alias("sheet"))).alias("destinations"), "l_orderkey", "l_linenumber", "l_suppkey",
    )
    return loops.one_per_point(records, ["l_orderkey", "l_linenumber", "l_suppkey"]).select("point", "sheet", "l_orderkey", "n_rows", _text("destination_sheets", "destination_sheets"))


@query("""
    SELECT l_suppkey AS sheet, l_partkey AS block, l_quantity AS n_specs, l_orderkey AS ord FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_orderkey) = 1""")
def richest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("block"), F.col("l_quantity").alias("n_specs"), F.col("l_orderkey").alias("ord"))
    return specs.keep_richest(entries)


@query("""
    WITH w AS (SELECT l_orderkey AS spec, CASE WHEN l_linenumber < 7 THEN l_suppkey END AS address, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 2 END AS r FROM lineitem),
    s AS (SELECT spec, count(DISTINCT address) AS n, min(address) AS wired, count(*) FILTER (address IS NULL) AS n_null, min(r) AS r FROM w GROUP BY spec)
    SELECT o_orderkey AS spec, o_custkey AS value, CASE WHEN n IS NULL THEN o_custkey WHEN n = 1 AND n_null = 0 THEN wired END AS effective,
           CASE WHEN n IS NULL THEN 'STORED' WHEN NOT (n = 1 AND n_null = 0) THEN 'UNRESOLVED' WHEN wired = o_custkey THEN 'EXPLICIT' ELSE ['UNRESOLVED', 'INFERRED', 'DERIVED', 'EXPLICIT'][r + 1] END AS status
    FROM orders LEFT JOIN s ON o_orderkey = spec""")
def wired_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec"), F.col("o_custkey").alias("value"))
    grade = F.when(F.col("l_returnflag") == "A", "EXPLICIT").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("DERIVED")
    wires = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spec"), F.when(F.col("l_linenumber") < 7, F.col("l_suppkey")).alias("address"), grade.alias("status"))
    return specs.apply_wiring(stored, wires)


@query("""
    WITH m AS (SELECT l_orderkey AS net, l_returnflag, l_partkey AS ref, CASE l_linestatus WHEN 'F' THEN 2 ELSE 3 END AS r FROM lineitem)
    SELECT a.net, a.ref AS driver, b.ref AS sink, 'INFERRED' AS status FROM m a JOIN m b ON a.net = b.net WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def net_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers and sinks of each net; a connection over a net is never better than inferred."""
    role = F.when(F.col("l_returnflag") == "A", "driver").when(F.col("l_returnflag") == "R", "sink").alias("role")
    grade = F.when(F.col("l_linestatus") == "F", "DERIVED").otherwise("EXPLICIT").alias("status")
    return specs.net_connections(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("net"), role, F.col("l_partkey").alias("ref"), grade))


@query("""
    WITH b AS (SELECT p_brand AS sheet, p_partkey AS block, p_size * 8.0 AS bx, p_retailprice * 0.3 AS top FROM part), l AS (SELECT p_brand AS sheet, p_partkey AS label_id, p_size * 8.0 + 5 AS x, p_retailprice * 0.3 + 12 AS y FROM part),
    p AS (SELECT sheet, label_id, block, x - bx AS dx, y - top - 10 AS dy FROM l JOIN b USING (sheet))
    SELECT sheet, label_id, arg_min(block, struct_pack(s := dy + 0.1 * dx, o := block)) AS block FROM p WHERE dx BETWEEN -20 AND 320 AND dy BETWEEN -10 AND 70 GROUP BY ALL""")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    x, y = F.col("p_size") * 8.0, F.col("p_retailprice") * 0.3
    labels = part.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("label_id"), (x + 5).alias("x"), (y + 12).alias("y"))
    blocks = part.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("block"), x.alias("bx"), y.alias("by"), F.lit(10).alias("height"), F.col("p_partkey").alias("ord"))
    return loops.label_blocks(labels, blocks)


@query("""
    SELECT l_orderkey, min(l_quantity) AS x1, min(l_extendedprice) AS y1, max(l_quantity + 1) AS x2, max(l_extendedprice + l_tax) AS y2 FROM lineitem GROUP BY 1""")
def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y1"), (F.col("l_quantity") + 1).alias("x2"), (F.col("l_extendedprice") + F.col("l_tax")).alias("y2"))
    return reports.bounding_boxes(boxes, ["l_orderkey"])


@query("""
    WITH c AS (SELECT l_suppkey AS loop, l_partkey AS label, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS via, l_linenumber AS hops FROM lineitem),
    b AS (SELECT *, rank() OVER (PARTITION BY loop ORDER BY via * 100 + hops) AS r FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY loop) AS n FROM b WHERE r = 1)
    SELECT loop, label, via, hops FROM k WHERE n = 1""")
def best_loop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    via = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("loop"), F.col("l_partkey").alias("label"), via.alias("via"), F.col("l_linenumber").alias("hops"))
    return loops.best_block(candidates).select("loop", "label", "via", "hops")


@query("""
    SELECT 'supplier only' AS side, s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) GROUP BY ALL
    UNION ALL SELECT 'customer only', c_nationkey, count(*) FROM customer WHERE c_acctbal > 9000 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY ALL""")
def nation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    left, right = joins.orphans(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), rich, ["nation"])
    return left.select(F.lit("supplier only").alias("side"), "nation").union(right.select(F.lit("customer only"), "nation")).groupBy("side", "nation").agg(F.count("*").alias("n"))


@query(r"""
    WITH f AS (SELECT url AS path, upper(regexp_extract(url, '([^/]*)$', 1)) AS name FROM pages)
    SELECT name, min(struct_pack(l := length(path), p := path)).p AS path FROM f GROUP BY name""")
def shortest_paths_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    names = files.select(F.upper(F.regexp_extract("path", r"([^/\\]*)\z", 1)).alias("name")).distinct()
    return listings.latest_by_name(files, names).select("name", "path")


@query(r"""
    SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS compact, trim(regexp_replace(upper(p_name), '\s+', ' ', 'g')) AS squeezed, substr(p_brand, 1, 5) AS prefix, substr(p_brand, 6, 2) AS code, substr(p_brand, 8, 1) AS suffix,
           p_size <> p_partkey AS differs, p_partkey + p_size AS address FROM part""")
def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, sheet = F.col("p_name"), tags.sheet_parts(F.col("p_brand"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", tags.compact(name).alias("compact"), tags.squeeze(name).alias("squeezed"), *[sheet[c].alias(c) for c in ("prefix", "code", "suffix")],
        tags.differs_from_default(size, key).alias("differs"), tags.output_address(F.concat_ws("+", key, size)).alias("address"),
    )


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_linenumber * 10.0 AS y, (l_partkey % 4)::INTEGER AS k, l_shipdate FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END AS rx, CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END AS ry,
           2 * x + 5 AS tx, 3 * y - 1 AS ty, CASE WHEN x < 10 THEN sqrt((x - 10) * (x - 10) + y * y) WHEN x > 40 THEN sqrt((x - 40) * (x - 40) + y * y) ELSE y END AS distance, x > 10 AND x < 40 AS interior,
           strftime(l_shipdate, '%I:%M:%S %p %m/%d/%Y') AS plotted, CASE l_linenumber WHEN 1 THEN 'ok' END AS status FROM t""")
def placed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned by quarter turns, moved by a composed transform, and measured against a segment; the time of a plot."""
    x, y = F.col("l_quantity"), F.col("l_linenumber") * F.lit(10.0)
    matrix = lambda *v: F.struct(*[F.lit(float(n)).alias(c) for c, n in zip("abcdef", v)])
    turned, moved = numbers.rotate_right(x, y, F.col("l_partkey")), numbers.transform_point(numbers.compose(matrix(1, 0, 0, 3, 5, -1), matrix(2, 0, 0, 1, 0, 0)), x, y)
    near = numbers.segment_distance(x, y, F.lit(10.0), F.lit(0.0), F.lit(40.0), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", turned["x"].alias("rx"), turned["y"].alias("ry"), moved["x"].alias("tx"), moved["y"].alias("ty"),
        near["distance"].alias("distance"), near["interior"].alias("interior"), numbers.plot_time(F.col("l_shipdate")).alias("plotted"), F.when(F.col("l_linenumber") == 1, "ok").alias("status"),
    )


@query("""
    SELECT l_suppkey AS loop, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') THEN 'control' WHEN bool_or(l_returnflag = 'R') THEN 'output' ELSE 'input' END AS kind FROM lineitem GROUP BY 1""")
def loop_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "input").when(F.col("l_returnflag") == "R", "output").otherwise("other")
    return details.loop_kinds(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("loop"), role.alias("role")))


@query("""
    SELECT p_partkey, p_brand, p_name FROM part WHERE upper(p_brand) = 'BRAND#12.CAD' OR upper(p_name) LIKE '%RED%' OR upper(p_type) LIKE '%RED%'""")
def sheet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(details.on_sheet(F.col("p_brand"), F.array("p_name", "p_type"), F.lit("red.CAD"))).select("p_partkey", "p_brand", "p_name")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_partkey END AS source, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS target FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'F'""")
def routable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = F.when(F.col("l_returnflag") == "A", F.col("l_partkey")), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))
    return details.routable(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"), target.alias("target")))


@query("""
    SELECT c_custkey, c_name AS raw FROM customer WHERE upper(c_name) NOT IN (SELECT upper(concat('customer#', o_custkey)) FROM orders)""")
def reference_only_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer#"), F.col("o_custkey").cast("string")).alias("raw"))
    return details.reference_only(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("raw")), points)


@query("""
    WITH v AS (SELECT l_partkey AS block, l_linenumber AS number, max(l_quantity)::BIGINT AS value FROM lineitem GROUP BY ALL)
    SELECT p_name AS loop, p_partkey AS block, p_size AS fc, concat('EU id ', value) AS unit, 'EXTRACTED' AS status FROM part JOIN v ON p_partkey = block AND p_size = 30 AND number = 2
    UNION ALL SELECT p_name, p_partkey, p_size, NULL, 'UNRESOLVED' FROM part WHERE NOT (p_size = 30 AND p_partkey IN (SELECT block FROM v WHERE number = 2))""")
def loop_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("block"), F.col("l_linenumber").alias("number")).agg(F.max("l_quantity").cast("long").alias("value"))
    return details.unit_of_loop(table(spark, sf_dir, "part").select(F.col("p_name").alias("loop"), F.col("p_partkey").alias("block"), F.col("p_size").alias("fc")), values)


@query("""
    WITH m AS (SELECT o_custkey AS loop, CASE WHEN o_orderkey >= 100 THEN concat(substr(lpad(o_orderkey::VARCHAR, 5, '1'), 1, 1), '-', substr(lpad(o_orderkey::VARCHAR, 5, '1'), 2, 2), '-', substr(lpad(o_orderkey::VARCHAR, 5, '1'), 4, 2)) END AS stem FROM orders)
    SELECT loop, CASE WHEN count(DISTINCT stem) = 1 THEN min(stem) ELSE '' END AS module, CASE WHEN count(DISTINCT stem) = 1 THEN 'DERIVED' ELSE 'UNRESOLVED' END AS status FROM m GROUP BY loop""")
def loop_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.when(F.col("o_orderkey") >= 100, F.substring(F.lpad(F.col("o_orderkey").cast("string"), 5, "1"), 1, 5)).otherwise("none")
    return details.module_stems(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("loop"), sheet.alias("sheet")))


@query("""
    SELECT count(*) FILTER (l_returnflag = 'A') AS fields_known, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'A'), 0)::BIGINT AS bytes_known, count(*) FILTER (l_returnflag = 'N') AS fields_candidate,
           coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N'), 0)::BIGINT AS bytes_candidate, count(*) FILTER (l_returnflag = 'R') AS fields_unresolved, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0)::BIGINT AS bytes_unresolved FROM lineitem""")
def field_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "KNOWN").when(F.col("l_returnflag") == "N", "CANDIDATE").otherwise("UNRESOLVED")
    return details.field_status(table(spark, sf_dir, "lineitem").select(status.alias("status"), F.col("l_linenumber").alias("length")))


@query("""
    SELECT p_partkey, p_brand, p_size AS fc, concat(p_size, '_', row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey)) AS ordinal FROM part""")
def ordinals_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.code_ordinals(table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("fc")), ["p_brand"], ["p_partkey"])


@query("""
    WITH l AS (SELECT p_brand, list(p_name ORDER BY p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1)
    SELECT p_brand, substr(array_to_string(CASE WHEN len(names) > 3 THEN list_append(names[1:3], concat('... ', len(names) - 3, ' more')) ELSE names END, ';'), 1, 40) AS shown FROM l""")
def capped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return names.select("p_brand", details.clipped(F.array_join(details.capped(F.col("names"), 3), ";"), 40).alias("shown"))


@query("""
    WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, p_partkey FROM r WHERE place % greatest(1, n // 5) = 0""")
def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.every_nth(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 5)


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('SIZE=', p_size, ';S7=', p_brand) WHEN 1 THEN concat('SIZE=old;S', p_size % 90, '=', p_brand) WHEN 2 THEN 'SIZE=old;A= ' ELSE '' END AS pairs,
        CASE WHEN p_partkey % 3 = 1 THEN '' WHEN p_size > 25 OR p_size = 3 THEN CASE WHEN p_size = 3 THEN '0,3' ELSE '0,3,' || p_size END ELSE '0,' || p_size END AS offsets, p_size <= 25 AND p_partkey % 7 <> 0 AS dated,
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('ABCDE', lpad(p_size::VARCHAR, 3, '0')) || CASE WHEN p_partkey % 5 = 1 THEN concat(',0000', lpad((p_partkey % 10000)::VARCHAR, 4, '0')) ELSE '' END END AS sheets,
        CASE p_partkey % 4 WHEN 0 THEN concat('DI7-1A/', p_partkey) WHEN 1 THEN concat('D', p_partkey + 10, 'ST-M') END AS tag, CASE WHEN p_partkey % 4 <= 1 THEN concat('BA02-', lpad((p_size)::VARCHAR, 2, '0'), '.07') END AS point,
        CASE WHEN p_partkey % 4 = 0 THEN concat('3', lpad((p_partkey % 10000)::VARCHAR, 4, '0'), 'L6A') END AS target_cad FROM part""")
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sheets have them, whole, in mixed case, without a value, without anything or malformed, and parsed."""
    part, c = table(spark, sf_dir, "part"), F.col
    size, key, n = c("p_size").cast("string"), c("p_partkey").cast("string"), c("p_partkey")
    old, words = F.lit("size = old"), F.lit("no pair")
    texts = F.when(n % 4 == 0, F.array(old, F.concat(F.lit(" Size = "), size, F.lit(" ")), F.concat(F.lit("S7: "), c("p_brand")), words)).when(n % 4 == 1, F.array(old, F.concat(F.lit("s"), (c("p_size") % 90).cast("string"), F.lit(" "), c("p_brand")), F.lit("S123: x"), F.lit("")))
    pairs = details.parameters(texts.when(n % 4 == 2, F.array(F.lit("size = old"), F.lit("A=   "))).otherwise(F.array(words, F.lit(" = 5"), F.lit("9K=1"), F.lit(None).cast("string"))))
    offsets = details.output_offsets(F.when(n % 3 == 1, F.array(F.lit("M+9"), F.lit("n+1"), F.lit("N+"))).otherwise(F.array(F.lit("N"), F.concat(F.lit("N + "), size), F.when(c("p_size") > 25, "N+3").otherwise("N"), F.lit("M+9"))))
    listed = F.concat(F.lit("see abcde"), F.lpad(size, 3, "0"), F.lit(".cad and x.CAD"), F.when(n % 5 == 1, F.concat(F.lit(", 0000"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(".CAD"))).otherwise(""))
    sheets = details.listed_sheets(F.when(n % 5 == 0, "short.CAD").otherwise(listed))
    point = F.concat(F.lit(" BA02-"), F.lpad(size, 2, "0"), F.lit(".07"))
    whole = F.concat(F.lit("OREF DI7-1A/"), key, point, F.lit(" 3"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("L6A"))
    ref = details.output_reference(F.when(n % 4 == 0, whole).when(n % 4 == 1, F.concat(F.lit("oref D"), (n + 10).cast("string"), F.lit("ST-M"), point)).when(n % 4 == 2, F.lit(" OREF ")).otherwise(F.lit(None).cast("string")))
    label = F.when(n % 7 == 0, "3/12/98/1").when(c("p_size") > 25, "30-1234").otherwise(" 3/12/1998 ")
    shown = F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"])), ";")
    return part.select("p_partkey", shown.alias("pairs"), F.array_join(offsets.cast("array<string>"), ",").alias("offsets"), details.is_date_like(label).alias("dated"), F.array_join(sheets, ",").alias("sheets"), *[ref[k].alias(k) for k in ("tag", "point", "target_cad")])


@query("""
    WITH e AS (SELECT event_id, event_type, ts, max(ts) OVER () AS newest FROM events)
    SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN newest - ts > INTERVAL 3 MINUTE THEN 'failed' ELSE 'running' END ELSE event_type END AS state FROM e""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    state = F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return events.select("event_id", details.job_state(state, F.col("ts"), newest.scalar()).alias("state"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25.0 AS x1, l_linenumber - 4.0 AS y1, l_quantity - 25.0 + l_suppkey % 9 AS x2, l_linenumber - 4.0 - l_partkey % 5 AS y2 FROM lineitem),
    t AS (SELECT *, CASE WHEN x2 <> x1 THEN greatest(0, (-5 - x1) / (x2 - x1)) WHEN x1 BETWEEN -5 AND 6 THEN 0 END AS a, CASE WHEN x2 <> x1 THEN least(1, (6 - x1) / (x2 - x1)) WHEN x1 BETWEEN -5 AND 6 THEN 1 END AS b,
           CASE WHEN y2 <> y1 THEN greatest(0, (1 - y1) / (y2 - y1)) WHEN y1 BETWEEN -2 AND 1 THEN 0 END AS c, CASE WHEN y2 <> y1 THEN least(1, (-2 - y1) / (y2 - y1)) WHEN y1 BETWEEN -2 AND 1 THEN 1 END AS d FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a IS NOT NULL AND c IS NOT NULL AND greatest(a, c) <= least(b, d), false) AS hit, x1 < 6 AND -5 < x1 + 1 AND y1 < 1 AND -2 < y1 + 1 AS boxes FROM t""")
def boxes_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity") - 25.0, F.col("l_linenumber") - 4.0
    made = lambda *v: F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), v)])
    segment, box = made(x, y, x + F.col("l_suppkey") % 9, y - F.col("l_partkey") % 5), made(-5, -2, 6, 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", details.segment_hits_box(segment, box).alias("hit"), details.boxes_intersect(made(x, y, x + 1, y + 1), box).alias("boxes"))
