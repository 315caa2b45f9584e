"""Further queries that call domain operators themselves: ranges, evidence, coverage, validation, paths, sums, crossings, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import evidence, numbers, tags
from plantlens.plans import displays, loops, specs, topology
from plantlens.registry import Registry, table
from plantlens.sources import binary, listings

REGISTRY = Registry()
query = REGISTRY.query


@query("""
    WITH b AS (SELECT p_partkey AS block, concat('M', p_partkey % 5) AS module, p_size % 4 AS slave, CASE WHEN p_partkey % 2 = 0 THEN 132 ELSE 149 END AS fc FROM part),
    k AS (SELECT *, row_number() OVER (PARTITION BY module, slave, fc ORDER BY block) - 1 AS rank FROM b),
    p AS (SELECT block AS point, module, slave, fc, rank, CASE fc WHEN 132 THEN 5 ELSE 7 END AS per, block * 7 % 60 + 1 AS channel, block % 3 = 0 AS wired, CASE WHEN fc = 132 AND block % 5 < 4 THEN block % 5 + 1 END AS pin FROM k),
    w AS (SELECT point, module, fc, point AS block, CASE WHEN (channel - 1) // per = rank AND coalesce(pin = channel - rank * per, true) THEN channel - rank * per END AS position, 'EXTRACTED' AS how FROM p WHERE wired),
    u AS (SELECT p.point, p.module, p.fc, k.block, CASE WHEN k.block IS NOT NULL THEN p.channel - k.rank * p.per END AS position, 'DERIVED' AS how FROM p LEFT JOIN k ON k.module = p.module AND k.slave = p.slave AND k.fc = p.fc AND k.rank = (p.channel - 1) // p.per WHERE NOT wired),
    z AS (SELECT *, CASE fc WHEN 132 THEN 2 + 3 * position ELSE 16 + 2 * position END AS zero FROM (SELECT * FROM w UNION ALL SELECT * FROM u)),
    v AS (SELECT *, zero BETWEEN 1 AND 25 AND zero + 1 <= 25 AS known FROM z)
    SELECT point, block, position::INTEGER AS position, CASE WHEN known THEN concat(block + zero, '.5') END AS low, CASE WHEN known THEN how ELSE 'UNRESOLVED' END AS low_status,
        CASE WHEN known THEN concat(2 * block + 2 * zero + 2, '.0') END AS high, CASE WHEN known THEN 'DERIVED' ELSE 'UNRESOLVED' END AS high_status FROM v""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are analog blocks and points, every third one wired to its own block; specs 1 to 25 of a block hold block + n and a half."""
    c, key = F.col, F.col("p_partkey")
    even = key % 2 == 0
    rows = table(spark, sf_dir, "part").select(key.alias("point"), key.alias("block"), F.concat(F.lit("M"), (key % 5).cast("string")).alias("module"), (c("p_size") % 4).cast("string").alias("slave"), F.when(even, 132).otherwise(149).alias("fc"), F.when(even, "AI").otherwise("AO").alias("io_type"), (key * 7 % 60 + 1).cast("string").alias("channel"))
    values = rows.select("module", "block", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("number")).withColumn("value", F.concat((c("block") + c("number")).cast("string"), F.lit(".5")))
    pin = F.when(c("block") % 5 < 4, F.concat(F.lit("R"), (c("block") % 5 + 1).cast("string"))).otherwise("X")
    wires = rows.where("block % 3 = 0").select("point", "module", "block", pin.alias("pin"))
    return loops.analog_ranges(rows.drop("block", "fc"), rows.select("module", "slave", "fc", "block"), values, wires)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, (['UNRESOLVED', 'INFERRED', 'DERIVED', 'EXPLICIT'])[least(l_partkey % 4, l_suppkey % 4, 1 + l_linenumber % 3) + 1] AS grade FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL""")
def weakest_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = lambda n: F.element_at(F.array(*[F.lit(g) for g in evidence.GRADES]), (n + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").where("l_partkey is not null and l_suppkey is not null and l_linenumber is not null")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", evidence.weakest(grade(F.col("l_partkey") % 4), grade(F.col("l_suppkey") % 4), grade(1 + F.col("l_linenumber") % 3)).alias("grade"))


@query("""
    WITH r AS (SELECT l_orderkey AS path, 20 + (l_linenumber - 1) * 40 + l_partkey % 7 AS "offset", 20 + (l_linenumber - 1) * 40 + 2 * round(l_quantity)::BIGINT AS stop FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
    p AS (SELECT path, "offset" AS a, greatest(stop, "offset") AS b, lag(greatest(stop, "offset"), 1, 20) OVER (PARTITION BY path ORDER BY "offset") AS before FROM r)
    SELECT path, count(*) AS n_records, sum(b - a)::BIGINT AS record_bytes, (sum(greatest(a - before, 0)) + greatest(320 - max(b), 0))::BIGINT AS gap_bytes, sum(greatest(before - a, 0))::BIGINT AS overlap_bytes FROM p GROUP BY path""")
def record_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("f")
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("path"), "l_linenumber").agg(first)
    start = 20 + (c("l_linenumber") - 1) * 40
    ranges = lines.select("path", (start + c("f.l_partkey") % 7).alias("offset"), (start + 2 * F.round("f.l_quantity").cast("long")).alias("stop"))
    ranges = ranges.select("path", "offset", F.greatest("stop", "offset").alias("end"))
    return displays.coverage(ranges, lines.select("path").distinct().withColumn("length", F.lit(320)))


@query("""
    WITH b AS (SELECT l_suppkey AS sheet, l_partkey AS block, l_returnflag = 'A' AS bare, l_quantity FROM lineitem), n AS (SELECT o_orderkey AS net, o_custkey AS driver, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderkey END AS sink, CASE o_orderstatus WHEN 'F' THEN 'EXPLICIT' WHEN 'O' THEN 'UNRESOLVED' ELSE 'GUESSED' END AS status FROM orders),
    s AS (SELECT l_suppkey + CASE WHEN l_tax > 0.07 THEN 1000000 ELSE 0 END AS sheet, l_partkey AS block, l_linenumber - CASE WHEN l_discount > 0.09 THEN 9 ELSE 0 END AS number FROM lineitem)
    SELECT 'DUPLICATE_BLOCK' AS rule, concat(sheet, ':', block) AS ref FROM b GROUP BY sheet, block HAVING count(*) > 1 UNION ALL SELECT 'DUPLICATE_SPEC', concat(sheet, ':', block, ':', number) FROM s GROUP BY sheet, block, number HAVING count(*) > 1
    UNION ALL SELECT 'SPEC_WITHOUT_BLOCK', concat(sheet, ':', block, ':', number) FROM s WHERE sheet >= 1000000 UNION ALL SELECT 'BLOCK_WITHOUT_CODE', concat(sheet, ':', block) FROM b WHERE bare UNION ALL SELECT 'NEGATIVE_SPEC_NUMBER', concat(sheet, ':', block, ':', number) FROM s WHERE number < 1
    UNION ALL SELECT 'UNKNOWN_STATUS', net::VARCHAR FROM n WHERE status = 'GUESSED' UNION ALL SELECT 'SELF_CONNECTION', net::VARCHAR FROM n WHERE driver = sink UNION ALL SELECT 'CONNECTION_WITHOUT_END', net::VARCHAR FROM n WHERE sink IS NULL AND status <> 'UNRESOLVED'""")
def spec_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, line = F.col, table(spark, sf_dir, "lineitem")
    blocks = line.select(c("l_suppkey").alias("sheet"), c("l_partkey").alias("block"), F.when(c("l_returnflag") != "A", 1).alias("fc"))
    of_blocks = line.select((c("l_suppkey") + F.when(c("l_tax") > 0.07, 1_000_000).otherwise(0)).alias("sheet"), c("l_partkey").alias("block"), (c("l_linenumber") - F.when(c("l_discount") > 0.09, 9).otherwise(0)).alias("number"))
    sink = F.when(c("o_orderkey") % 7 == 0, c("o_custkey")).when(c("o_orderkey") % 7 != 1, c("o_orderkey"))
    status = F.when(c("o_orderstatus") == "F", "EXPLICIT").when(c("o_orderstatus") == "O", "UNRESOLVED").otherwise("GUESSED")
    nets = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("net"), c("o_custkey").alias("driver"), sink.alias("sink"), status.alias("status"))
    found = specs.validate_specs(of_blocks, blocks, nets)
    return found.select(c(found.columns[0] if "code" not in found.columns else "code").alias("rule"), c("ref").cast("string").alias("ref"))


_PATHS = r"SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'c:\l' WHEN 1 THEN '/x/L' ELSE 'L' END, p_size, CASE p_partkey % 2 WHEN 0 THEN '/' ELSE '\' END, 'p', p_partkey % 9, '/', CASE WHEN p_size % 4 = 0 THEN 'none' ELSE concat('M', p_size) END, '/', p_brand, CASE p_size % 5 WHEN 0 THEN '.cad' WHEN 1 THEN '.CAD' WHEN 2 THEN '.Csv' WHEN 3 THEN '' ELSE '.m1' END) AS path FROM part"


@query(rf"""
    SELECT p_partkey, nullif(regexp_extract(upper(path), '(?:^|[/\\])(L\d+)(?:[/\\]|$)', 1), '') AS loop, nullif(regexp_extract(upper(path), '(?:^|[/\\])(P\d+)(?:[/\\]|$)', 1), '') AS cpu, nullif(regexp_extract(upper(path), '(?:^|[/\\])(M\d+)(?:[/\\]|$)', 1), '') AS module,
        upper(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '(?i)\.CAD$', '')) AS name, lower(nullif(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1), '')) AS extension FROM ({_PATHS})""")
def path_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    n = F.col("p_size") % 5
    path = F.concat(
        F.when(key % 3 == 0, "c:\\l").when(key % 3 == 1, "/x/L").otherwise("L"), size, F.when(key % 2 == 0, "/").otherwise("\\"), F.lit("p"), (key % 9).cast("string"), F.lit("/"), F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.lit("M"), size)), F.lit("/"), F.col("p_brand"),
        F.when(n == 0, ".cad").when(n == 1, ".CAD").when(n == 2, ".Csv").when(n == 3, "").otherwise(".m1"),
    )
    return table(spark, sf_dir, "part").withColumn("path", path).select("p_partkey", tags.provenance(F.col("path")).alias("p"), tags.base_name(F.col("path")).alias("name"), tags.extension(F.col("path")).alias("extension")).select("p_partkey", "p.*", "name", "extension")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'A' THEN (l_extendedprice::DECIMAL(18,2) + l_tax::DECIMAL(18,3))::DECIMAL(18,3)::VARCHAR END AS total FROM lineitem""")
def decimal_text_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c, s: F.col(c).cast(f"decimal(18,{s})").cast("string")
    odd = F.when(F.col("l_returnflag") != "A", text("l_tax", 3)).otherwise("n/a")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.add_decimal_text(text("l_extendedprice", 2), odd).alias("total"))


def _wires(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders are sheets; odd lines run across, even ones up; junctions lie where a line's numbers say."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").withColumns({"x": c("l_partkey") % 50, "y": c("l_suppkey") % 50, "n": F.round("l_quantity").cast("long")})
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.when(c("l_linenumber") % 2 == 1, F.array(point(c("x"), c("y")), point(c("x") + c("n"), c("y")))).otherwise(F.array(point(c("x"), c("y")), point(c("x"), c("y") + c("n"))))
    wires = line.select(c("l_orderkey").alias("sheet"), F.concat_ws(".", *[c(k).cast("string") for k in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("wire"), points.alias("points"))
    return wires, line.where("l_returnflag = 'A'").select(c("l_orderkey").alias("sheet"), (c("x") + 3).alias("x"), (c("y") + 2).alias("y"))


@query("""
    WITH l AS (SELECT l_orderkey AS sheet, concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS wire, l_linenumber % 2 = 1 AS across, l_partkey % 50 AS x, l_suppkey % 50 AS y, round(l_quantity)::BIGINT AS n, l_returnflag FROM lineitem),
    p AS (SELECT DISTINCT a.sheet, a.wire, b.wire AS other, b.x, a.y FROM l a JOIN l b ON a.sheet = b.sheet AND a.across AND NOT b.across AND a.wire <> b.wire AND b.x > a.x AND b.x < a.x + a.n AND a.y > b.y AND a.y < b.y + b.n)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM l j WHERE j.sheet = p.sheet AND j.l_returnflag = 'A' AND abs(p.x - j.x - 3) <= 3 AND abs(p.y - j.y - 2) <= 3)""")
def wire_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.crossing_points(*_wires(spark, sf_dir))


@query("""
    WITH t AS (SELECT l_orderkey AS sheet, concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 500 AS x, l_suppkey % 90 AS y, l_returnflag FROM lineitem)
    SELECT a.sheet, a.id AS text_id, arg_min(b.id, struct_pack(s := b.y - a.y + 0.3::DOUBLE * abs(a.x - b.x), c := b.id)) AS caption FROM t a JOIN t b ON a.sheet = b.sheet AND a.l_returnflag <> 'R' AND b.l_returnflag = 'R' AND abs(a.x - b.x) <= 200 AND b.y >= a.y GROUP BY ALL""")
def captions_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name: Column = F.concat_ws(".", *[c(k).cast("string") for k in ("l_linenumber", "l_partkey", "l_suppkey")])
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("sheet"), name.alias("id"), (c("l_partkey") % 500).alias("x"), (c("l_suppkey") % 90).alias("y"), "l_returnflag")
    texts = rows.where("l_returnflag <> 'R'").select("sheet", c("id").alias("text_id"), "x", "y")
    return topology.caption_fields(texts, rows.where("l_returnflag = 'R'").select("sheet", c("id").alias("caption"), "x", "y"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity > 25 AS more, l_tax > 0.07 AS dash, l_discount > 0.09 AS bare, round(l_quantity)::INTEGER AS q,
        1 + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS k FROM lineitem),
    p AS (SELECT *, 1 + coalesce(sum(k) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN dash THEN 1 ELSE 0 END + 1 AS n FROM l)
    SELECT concat('f', l_orderkey) AS file, n::INTEGER AS n, concat('ABC', l_orderkey % 1000) AS sheet, CASE WHEN l_orderkey % 2 = 0 THEN 'Outputs' ELSE 'Inputs' END AS direction, concat('AI', l_linenumber, '-1A/', l_partkey) AS description,
        CASE WHEN NOT bare THEN concat('SRC', l_suppkey) END AS source, concat('AB', lpad((q % 100)::VARCHAR, 2, '0'), '-01.07>30705L6A', CASE WHEN more THEN concat(',CD34-02.', lpad((l_linenumber)::VARCHAR, 2, '0')) ELSE '' END) AS destinations FROM p""")
def cross_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are listings with a section, an entry for each line, dashes between some, and destinations that go on below."""
    c, text = F.col, lambda v: v.cast("string")
    q = F.lpad(text(F.round("l_quantity").cast("int") % 100), 2, "0")
    entry = F.concat(F.rpad(F.concat(F.lit("AI"), text(c("l_linenumber")), F.lit("-1A/"), text(c("l_partkey"))), 32, " "), F.rpad(F.when(c("l_discount") > 0.09, "").otherwise(F.concat(F.lit("SRC"), text(c("l_suppkey")))), 16, " "), F.lit("AB"), q, F.lit("-01.07 30705L6A"))
    more = F.concat(F.repeat(F.lit(" "), F.lit(48)), F.lit("CD34-02."), F.lpad(text(c("l_linenumber")), 2, "0"))
    lines = F.array_compact(F.array(F.when(c("l_tax") > 0.07, "---- ----"), entry, F.when(c("l_quantity") > 25, more)))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", lines.alias("lines")))), lambda x: x["lines"])), "\r\n")
    head = F.concat(F.lit("abc"), text(c("l_orderkey") % 1000), F.when(c("l_orderkey") % 2 == 0, ".CAD  Outputs").otherwise(".CAD  Inputs"))
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(body.alias("body")).select(F.concat(F.lit("f"), text(c("l_orderkey"))).alias("file"), F.concat(head, F.lit("\n"), "body").alias("text"))
    rows = listings.parse_cross_reference(listings.lines_of(files, "file", "text"))
    return rows.withColumn("destinations", F.array_join(F.transform("destinations", lambda d: F.concat_ws(">", d["reference"], d["sheet"])), ","))


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey AS sheet, l_partkey AS block FROM lineitem WHERE l_returnflag <> 'A'), s AS (SELECT l_orderkey AS sheet, l_partkey AS block, min(l_suppkey) AS name FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2 HAVING count(*) = 1),
    j AS (SELECT coalesce(e.sheet, s.sheet) AS sheet, coalesce(e.block, s.block) AS block, name, s.block IS NULL AS l, e.block IS NULL AS r FROM e FULL JOIN s ON e.sheet = s.sheet AND e.block = s.block),
    k AS (SELECT *, count(*) FILTER (WHERE l) OVER w AS nl, count(*) FILTER (WHERE r) OVER w AS nr FROM j WINDOW w AS (PARTITION BY sheet))
    SELECT sheet, block, name, CASE WHEN NOT l AND NOT r THEN 'BLOCK_NUMBER' WHEN nl = 1 AND nr = 1 THEN 'ONLY_ONES_LEFT' WHEN l THEN 'NO_SYMBOL' ELSE 'NO_ENTRY' END AS pairing FROM k""")
def spec_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are sheets: some of their lines are trailer entries, some drawn symbols, some both."""
    line = table(spark, sf_dir, "lineitem").withColumns({"sheet": F.col("l_orderkey"), "block": F.col("l_partkey")})
    symbols = line.where("l_quantity > 20").select("sheet", "block", F.col("l_suppkey").alias("name"))
    return specs.pair_entries(line.where("l_returnflag <> 'A'").select("sheet", "block").distinct(), symbols).select("sheet", "block", "name", "pairing")


@query("""
    WITH c AS (SELECT o_orderkey AS id, concat('S00', lpad((o_custkey % 100)::VARCHAR, 2, '0'), lpad((o_orderkey % 100)::VARCHAR, 2, '0'), 'C') AS sheet, CASE o_orderstatus WHEN 'F' THEN 'OREF' ELSE 'IREF' END AS kind, concat('T ', o_orderkey % 3) AS tag,
        concat('0', o_orderkey % 2, '.07') AS zone, o_orderkey % 11 = 0 AS blank, o_custkey * 3 % 100 AS pp, lpad((o_orderkey * 7 % 100)::VARCHAR, 2, '0') AS ss, concat('0', o_custkey % 2, '.07') AS z FROM orders),
    k AS (SELECT *, CASE WHEN NOT blank AND pp < 90 THEN concat('S00', lpad(pp::VARCHAR, 2, '0'), ss) END AS target FROM c),
    g AS (SELECT k.id, list_sort(list(DISTINCT o.id) FILTER (WHERE o.kind <> k.kind AND o.tag = k.tag AND o.zone = k.z)) AS ex, list_sort(list(DISTINCT o.id) FILTER (WHERE o.kind <> k.kind AND o.tag = k.tag)) AS tg, list_sort(list(DISTINCT o.id) FILTER (WHERE o.kind <> k.kind AND o.zone = k.z)) AS zn,
        min(o.sheet) AS target_sheet FROM k LEFT JOIN c o ON left(o.sheet, 7) = k.target GROUP BY k.id),
    f AS (SELECT k.*, target_sheet, coalesce(ex, []) AS ex, coalesce(tg, []) AS tg, coalesce(zn, []) AS zn FROM k JOIN g USING (id)),
    t AS (SELECT *, CASE WHEN blank THEN CASE WHEN tag = 'T 1' THEN 'BOUNDARY_SIGNAL' ELSE 'UNRESOLVED' END WHEN pp >= 90 THEN 'RESOLVED_EXTERNAL' WHEN target_sheet IS NULL THEN 'UNRESOLVED'
        WHEN len(ex) > 1 OR (len(ex) = 0 AND (len(tg) > 1 OR (len(tg) = 0 AND len(zn) > 0))) THEN 'AMBIGUOUS' WHEN len(ex) = 1 OR len(tg) = 1 THEN CASE WHEN left(sheet, 7) = target THEN 'RESOLVED_INTERNAL' ELSE 'RESOLVED_CROSS_SHEET' END ELSE 'UNRESOLVED' END AS status FROM f)
    SELECT id, sheet, target_sheet, status, CASE WHEN status = 'BOUNDARY_SIGNAL' THEN 'DERIVED' WHEN status = 'RESOLVED_EXTERNAL' THEN CASE WHEN id % 5 = 0 THEN 'EXPLICIT' ELSE 'DERIVED' END WHEN starts_with(status, 'RESOLVED') THEN CASE WHEN len(ex) = 1 THEN 'EXPLICIT' ELSE 'DERIVED' END ELSE 'UNRESOLVED' END AS relation,
        CASE WHEN status IN ('RESOLVED_INTERNAL', 'RESOLVED_CROSS_SHEET') THEN coalesce(ex[1], tg[1]) END AS partner, CASE WHEN status = 'AMBIGUOUS' THEN array_to_string(CASE WHEN len(ex) > 0 THEN ex WHEN len(tg) > 0 THEN tg ELSE zn END, ',') WHEN status IN ('RESOLVED_INTERNAL', 'RESOLVED_CROSS_SHEET') THEN coalesce(ex[1], tg[1])::VARCHAR ELSE '' END AS candidates FROM t""")
def reference_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are connectors whose addresses name the sheets of others, of other systems or of none."""
    c, key, customer = F.col, F.col("o_orderkey"), F.col("o_custkey")
    two = lambda v: F.lpad((v % 100).cast("string"), 2, "0")
    zone = lambda v: F.concat(F.lit("0"), (v % 2).cast("string"), F.lit(".07"))
    address = F.when(key % 11 != 0, F.concat(two(customer * 3), two(key * 7), F.lit("-"), zone(customer))).otherwise("  ")
    connectors = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("S00"), two(customer), two(key), F.lit("C")).alias("sheet"), F.when(c("o_orderstatus") == "F", "OREF").otherwise("IREF").alias("kind"),
        F.concat(F.when(key % 2 == 0, "t  ").otherwise(" T "), (key % 3).cast("string")).alias("tag"), address.alias("address"), zone(key).alias("zone"),
    )
    prefixes = table(spark, sf_dir, "customer").select((c("c_custkey") % 100).alias("p")).distinct().where("p < 90").select(two(c("p")).alias("prefix"), F.concat(F.lit("S00"), two(c("p"))).alias("sheet_prefix"))
    registry = connectors.where("id % 3 = 1").select(F.lit("t 1").alias("tag")).distinct()
    found = specs.resolve_references(connectors, prefixes, connectors.select("sheet").distinct(), registry, connectors.where("id % 5 = 0").select("id"))
    return found.withColumn("candidates", F.array_join(c("candidates").cast("array<string>"), ","))


@query("""
    WITH l AS (SELECT l_orderkey AS sheet, concat_ws('.', l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 60 AS x, l_suppkey % 60 AS y, round(l_quantity)::BIGINT AS n, l_returnflag AS f, l_tax > 0.04 AS point, l_partkey * 3 % 60 AS bx, l_suppkey * 3 % 60 AS "by" FROM lineitem),
    e AS (SELECT sheet, id AS wire, 'from' AS "end", x, y FROM l UNION ALL SELECT sheet, id, 'to', x + n, y FROM l),
    c AS (SELECT e.sheet, wire, "end", 1 AS tier, sqrt(pow(e.x - l.x - 1, 2) + pow(e.y - l.y, 2)) AS d, 0::DOUBLE AS area, concat('J', id) AS ref, 'junction' AS kind, 'EXPLICIT' AS status FROM e JOIN l ON e.sheet = l.sheet AND f = 'A' WHERE sqrt(pow(e.x - l.x - 1, 2) + pow(e.y - l.y, 2)) <= 3
        UNION ALL SELECT e.sheet, wire, "end", 2, sqrt(pow(e.x - l.x - n, 2) + pow(e.y - l.y - 2, 2)), 0, concat('C', id), 'connector', 'EXPLICIT' FROM e JOIN l ON e.sheet = l.sheet AND f = 'N' AND point WHERE sqrt(pow(e.x - l.x - n, 2) + pow(e.y - l.y - 2, 2)) <= 3
        UNION ALL SELECT e.sheet, wire, "end", 3, 0, 108, concat('B', id), 'pin', 'EXPLICIT' FROM e JOIN l ON e.sheet = l.sheet WHERE e.x BETWEEN bx AND bx + 12 AND e.y BETWEEN "by" AND "by" + 9
        UNION ALL SELECT e.sheet, wire, "end", 4, 0, 0, concat('C', id), 'connector', 'DERIVED' FROM e JOIN l ON e.sheet = l.sheet AND f = 'N' WHERE e.x BETWEEN l.x + n - 5 AND l.x + n + 5 AND e.y BETWEEN l.y - 3 AND l.y + 6
        UNION ALL SELECT e.sheet, wire, "end", 5, sqrt(pow(greatest(l.x - e.x, 0, e.x - l.x - n), 2) + pow(e.y - l.y, 2)), 0, id, 'wire', 'DERIVED' FROM e JOIN l ON e.sheet = l.sheet AND wire <> id WHERE sqrt(pow(greatest(l.x - e.x, 0, e.x - l.x - n), 2) + pow(e.y - l.y, 2)) <= 1
        UNION ALL SELECT e.sheet, wire, "end", 6, sqrt(pow(greatest(bx - e.x, 0, e.x - bx - 12), 2) + pow(greatest("by" - e.y, 0, e.y - "by" - 9), 2)), 0, concat('B', id), 'pin', 'DERIVED' FROM e JOIN l ON e.sheet = l.sheet
            WHERE sqrt(pow(greatest(bx - e.x, 0, e.x - bx - 12), 2) + pow(greatest("by" - e.y, 0, e.y - "by" - 9), 2)) <= 15),
    b AS (SELECT sheet, wire, "end", min(struct_pack(tier := tier, d := d, area := area, ref := ref, kind := kind, status := status)) AS c FROM c GROUP BY ALL)
    SELECT e.sheet, e.wire, e."end", coalesce(c.kind, 'dangling') AS kind, c.ref AS ref, coalesce(c.status, 'UNRESOLVED') AS status FROM e LEFT JOIN b USING (sheet, wire, "end")""")
def wire_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are sheets: each line is a wire and a block, some are junctions or connectors as well. Equal lines of an order are one."""
    c = F.col
    name = F.concat_ws(".", *[c(k).cast("string") for k in ("l_linenumber", "l_partkey", "l_suppkey")])
    line = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("sheet"), name.alias("id"), (c("l_partkey") % 60).alias("x"), (c("l_suppkey") % 60).alias("y"), F.round("l_quantity").cast("long").alias("n"), c("l_returnflag").alias("f"), (c("l_tax") > 0.04).alias("point"),
        (c("l_partkey") * 3 % 60).alias("bx"), (c("l_suppkey") * 3 % 60).alias("by"),
    )
    point = lambda x: F.struct(x.alias("x"), c("y").alias("y"))
    wires = line.select("sheet", c("id").alias("wire"), F.array(point(c("x")), point(c("x") + c("n"))).alias("points"))
    at = c("x") + c("n")
    junctions = line.where("f = 'A'").select("sheet", F.concat(F.lit("J"), "id").alias("ref"), (c("x") + 1).alias("x"), "y")
    connectors = line.where("f = 'N'").select("sheet", F.concat(F.lit("C"), "id").alias("ref"), F.when(c("point"), at).alias("px"), F.when(c("point"), c("y") + 2).alias("py"), (at - 5).alias("x1"), (c("y") - 3).alias("y1"), (at + 5).alias("x2"), (c("y") + 6).alias("y2"))
    blocks = line.select("sheet", F.concat(F.lit("B"), "id").alias("ref"), c("bx").alias("x1"), c("by").alias("y1"), (c("bx") + 12).alias("x2"), (c("by") + 9).alias("y2"))
    return topology.classify_ends(topology.wire_ends(wires), junctions, connectors, blocks, wires).select("sheet", "wire", "end", "kind", "ref", "status")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE WHEN l_tax > 0.07 THEN l_extendedprice * 1e6 WHEN l_tax > 0.05 THEN l_discount * 1e-4 ELSE l_extendedprice END AS real, l_partkey * l_suppkey % 40000 AS low, (l_linenumber % 2)::BIGINT AS high FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN low = 0 AND high = 0 THEN 'zero' WHEN f AND i THEN 'ambiguous' WHEN f THEN 'float' WHEN i THEN 'integer' ELSE 'ambiguous' END AS kind
    FROM (SELECT *, NOT isnan(real) AND abs(real) >= 1e-4 AND abs(real) < 1e9 AS f, high = 0 AND low > 0 AND low <= 30000 AS i FROM s)""")
def slot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    real = F.when(c("l_discount") == 0, F.lit(float("nan"))).when(c("l_tax") > 0.07, c("l_extendedprice") * 1e6).when(c("l_tax") > 0.05, c("l_discount") * 1e-4).otherwise(c("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", binary.slot_kind(real, c("l_partkey") * c("l_suppkey") % 40000, (c("l_linenumber") % 2).cast("long")).alias("kind"))


@query("""
    SELECT concat('f', p_partkey) AS path, CASE p_size % 4 WHEN 0 THEN concat('MFP', p_size) WHEN 1 THEN 'BRC' WHEN 2 THEN 'IMMFP1' END AS controller, CASE WHEN p_partkey % 2 = 0 THEN 'AB' END AS prefix FROM part""")
def module_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are module files with a controller type, or none, and a prefix in some of them, among bytes that aren't text."""
    c = F.col
    kind = F.when(c("p_size") % 4 == 0, F.concat(F.lit("see MFP"), c("p_size").cast("string"), F.lit(" x"))).when(c("p_size") % 4 == 1, "BRC").when(c("p_size") % 4 == 2, "IMMFP1").otherwise("XMFP9")
    hexed = lambda text: F.hex(text.cast("binary"))
    content = F.unhex(F.concat(F.lit("0001"), hexed(F.lit("abc")), F.lit("00FF"), hexed(kind), F.lit("00"), F.when(c("p_partkey") % 2 == 0, hexed(F.lit("AB"))).otherwise(""), F.lit("0002"), hexed(F.lit("MFC7")), F.lit("00")))
    content = F.when(c("p_size") % 4 == 3, F.unhex(F.concat(F.lit("0001"), hexed(kind), F.lit("00"), F.when(c("p_partkey") % 2 == 0, hexed(F.lit("AB"))).otherwise(""), F.lit("00")))).otherwise(content)
    return listings.module_headers(table(spark, sf_dir, "part").select(F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("path"), content.alias("content")))
