"""Queries of terminals and scenes: tables shaped into drawn symbols, the operators applied to all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.operators import graph, ordering
from plantlens.plans import scene, terminals
from plantlens.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

#: Parts are blocks of symbols; lines are their pins, and neighbouring lines of an order are wires.
_SYMBOLS = """
    blocks AS (SELECT p_partkey AS block, concat(p_brand, '-', p_size % 10) AS name, concat(p_brand, '-', p_size % 10, '|', p_size % 20) AS key, p_partkey AS address, -10 AS lft, 110 AS rgt,
        -30 * (1 + p_size % 4) AS low, 20 + 5 * (p_size % 3) AS high, p_partkey % 13 = 0 AS rotated, nullif(p_size % 3, 0) AS multiple, p_size AS z FROM part),
    spots AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, block, CASE WHEN z % 10 = 9 THEN 50 WHEN l_linenumber % 2 = 1 THEN 0 ELSE 100 END AS x,
        CASE WHEN z % 10 = 7 THEN -10 * (l_suppkey % 4) * (l_suppkey % 4) WHEN z % 10 = 8 THEN -20 ELSE (CASE WHEN z % 10 IN (3, 4) THEN 20 ELSE 0 END) - (l_suppkey % 4) * (10 + 5 * (z % 3)) END AS y
        FROM lineitem JOIN blocks ON block = l_partkey),
    pins AS (SELECT block, x, y, CASE WHEN bool_or(l_quantity > 45) THEN concat(CASE x WHEN 0 THEN 'L' ELSE 'R' END, y) END AS pin, bool_or(l_returnflag = 'R') AS wired FROM spots GROUP BY block, x, y),
    labels AS (SELECT block, 'input' AS side, n::INTEGER AS n, concat('S', n + 1) AS label FROM blocks, unnest(range(z % 5)) AS t(n)
        UNION ALL SELECT block, 'output', n::INTEGER, CASE n WHEN 0 THEN 'N' ELSE concat('N+', n) END FROM blocks, unnest(range(z % 4)) AS t(n)),
    links AS (SELECT a.l_orderkey * 10 + a.l_linenumber AS ord, a.block, a.x, a.y, b.block AS driver, b.x AS driver_x, b.y AS driver_y, a.l_suppkey, a.l_quantity
        FROM spots a JOIN spots b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber % 2 = 1),
    specs AS (SELECT DISTINCT block, concat('S', 1 + (l_suppkey + CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) % 4) AS label, driver + round(l_quantity)::BIGINT % 3 AS value FROM links),
    offsets AS (SELECT block, 0 AS off FROM blocks UNION ALL SELECT block, 1 FROM blocks WHERE block % 2 = 0),"""


def drawn_symbols(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """blocks, pins, labels, links, specs and offsets of the tables, as the terminals plan takes them."""
    part, line, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), F.col
    z, text = c("p_size"), lambda v: v.cast("string")
    name = F.concat("p_brand", F.lit("-"), text(z % 10))
    blocks = part.select(
        c("p_partkey").alias("block"), name.alias("name"), F.concat(name, F.lit("|"), text(z % 20)).alias("key"), c("p_partkey").alias("address"), F.lit(-10).alias("left"), F.lit(110).alias("right"),
        (-30 * (1 + z % 4)).alias("low"), (20 + 5 * (z % 3)).alias("high"), (c("p_partkey") % 13 == 0).alias("rotated"), F.nullif(z % 3, F.lit(0)).alias("multiple"), z.alias("z"),
    )
    row = c("l_suppkey") % 4
    x = F.when(c("z") % 10 == 9, 50).when(c("l_linenumber") % 2 == 1, 0).otherwise(100)
    y = F.when(c("z") % 10 == 7, -10 * row * row).when(c("z") % 10 == 8, -20).otherwise(F.when((c("z") % 10).isin(3, 4), 20).otherwise(0) - row * (10 + 5 * (c("z") % 3)))
    spots = line.join(blocks.select("block", "z").hint("merge"), c("l_partkey") == c("block")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "block", x.alias("x"), y.alias("y"))
    pins = spots.groupBy("block", "x", "y").agg(F.bool_or(c("l_quantity") > 45).alias("drawn"), F.bool_or(c("l_returnflag") == "R").alias("wired"))
    pins = pins.withColumn("pin", F.when(c("drawn"), F.concat(F.when(c("x") == 0, "L").otherwise("R"), text(c("y"))))).drop("drawn")
    count = lambda side, many, label: blocks.where(many > 0).select("block", F.lit(side).alias("side"), F.explode(F.sequence(F.lit(0), many - 1)).alias("n")).withColumn("label", label)
    inputs = count("input", (c("z") % 5).cast("int"), F.concat(F.lit("S"), text(c("n") + 1)))
    labels = inputs.union(count("output", (c("z") % 4).cast("int"), F.when(c("n") == 0, "N").otherwise(F.concat(F.lit("N+"), text(c("n"))))))
    driver = spots.select("l_orderkey", (c("l_linenumber") - 1).alias("l_linenumber"), c("block").alias("driver"), c("x").alias("driver_x"), c("y").alias("driver_y"))
    wired = spots.where("l_linenumber % 2 = 1").join(driver.hint("merge"), ["l_orderkey", "l_linenumber"]).withColumn("ord", c("l_orderkey") * 10 + c("l_linenumber"))
    label = F.concat(F.lit("S"), text(1 + (c("l_suppkey") + F.when(c("l_quantity") > 49, 1).otherwise(0)) % 4))
    specs = wired.select("block", label.alias("label"), (c("driver") + F.round("l_quantity").cast("long") % 3).alias("value")).distinct()
    offsets = blocks.select("block", F.explode(F.when(c("block") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("offset"))
    return {"blocks": blocks.drop("z"), "pins": pins, "labels": labels, "links": wired.select("ord", "block", "x", "y", "driver", "driver_x", "driver_y"), "specs": specs, "offsets": offsets}


_TERMINALS = f"""{_SYMBOLS}
    sided AS (SELECT p.*, b.name, b.key, CASE WHEN (x - lft) / (rgt - lft) <= 0.3 THEN 'input' WHEN (x - lft) / (rgt - lft) >= 0.7 THEN 'output' END AS side FROM pins p JOIN blocks b USING (block)),
    sp AS (SELECT * FROM sided WHERE side IS NOT NULL),
    hit AS (SELECT l.*, s.label, s.value - d.address AS off, d.rotated AS turned FROM links l JOIN blocks b ON l.block = b.block AND NOT b.rotated JOIN blocks d ON d.block = l.driver
        JOIN specs s ON s.block = l.block JOIN offsets o ON o.block = l.driver AND o.off = s.value - d.address WHERE (l.block, s.label) IN (SELECT (block, label) FROM labels WHERE side = 'input')),
    one AS (SELECT ord, block, x, y, driver, driver_x AS dx, driver_y AS dy, any_value(label) AS label, any_value(off) AS off, any_value(turned) AS turned
        FROM hit GROUP BY ord, block, x, y, driver, driver_x, driver_y HAVING count(*) = 1),
    claims AS (SELECT block, 'input' AS side, label, x, y, ord FROM one
        UNION ALL SELECT driver, 'output', CASE off WHEN 0 THEN 'N' ELSE concat('N+', off) END, dx, dy, ord FROM one WHERE NOT turned AND (driver, CASE off WHEN 0 THEN 'N' ELSE concat('N+', off) END) IN (SELECT (block, label) FROM labels WHERE side = 'output')),
    proven AS (SELECT key, label, count(DISTINCT (x, y)) AS places, min((x, y)) AS p FROM claims JOIN blocks USING (block) GROUP BY key, label),
    explicit AS (SELECT block, side, label, max((ord, x, y)) AS e FROM claims GROUP BY ALL),
    drawn AS (SELECT block, side, x, y, (row_number() OVER (PARTITION BY block, side ORDER BY y DESC, x) - 1)::INTEGER AS n, count(*) OVER (PARTITION BY block, side) AS drawn FROM sp WHERE pin IS NOT NULL),
    printed AS (SELECT block, side, count(*) AS printed FROM labels GROUP BY ALL),
    exact AS (SELECT block, side, n, x, y FROM drawn JOIN printed USING (block, side) WHERE drawn = printed),
    diffs AS (SELECT key, side, y, lag(y) OVER (PARTITION BY key, side ORDER BY y DESC) - y AS step FROM (SELECT DISTINCT key, side, x, y FROM sp) AS q QUALIFY x = CASE side WHEN 'input' THEN min(x) OVER (PARTITION BY key, side) ELSE max(x) OVER (PARTITION BY key, side) END),
    gaps AS (SELECT key, side, list_reduce(list(abs(step)::BIGINT), lambda a, b: gcd(a, b)) AS g FROM diffs WHERE step IS NOT NULL GROUP BY ALL),
    module AS (SELECT side, g AS m FROM (SELECT side, g, count(*) AS n FROM gaps WHERE g >= 10 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, g) = 1),
    edges AS (SELECT block, side, CASE side WHEN 'input' THEN min(x) ELSE max(x) END AS edge FROM sp GROUP BY block, side),
    own AS (SELECT s.block, s.side, edge, list_reverse_sort(list(DISTINCT y)) AS ys FROM sp s JOIN edges e ON s.block = e.block AND s.side = e.side AND s.x = e.edge GROUP BY ALL),
    sym AS (SELECT name, side, x AS edge, list_reverse_sort(list(DISTINCT y)) AS al FROM sp GROUP BY ALL),
    known AS (SELECT l.block, l.side, min((l.n, p.p[2])) AS k FROM proven p JOIN blocks b ON p.key = b.key JOIN labels l ON l.block = b.block AND l.label = p.label WHERE places = 1 GROUP BY ALL),
    s0 AS (SELECT b.*, v.side, printed AS n, o.ys, o.edge, sym.al, m, k[1] AS kn, k[2] AS ky, CASE v.side WHEN 'input' THEN sym.al ELSE o.ys END AS base
        FROM blocks b CROSS JOIN (VALUES ('input'), ('output')) AS v(side) LEFT JOIN printed p ON p.block = b.block AND p.side = v.side LEFT JOIN own o ON o.block = b.block AND o.side = v.side
        LEFT JOIN sym ON sym.name = b.name AND sym.side = v.side AND sym.edge = o.edge LEFT JOIN known k ON k.block = b.block AND k.side = v.side LEFT JOIN module ON module.side = v.side WHERE NOT rotated),
    s1 AS (SELECT *, CASE WHEN len(base) > 1 THEN list_reduce(list_transform(range(1, len(base)), lambda i: abs(base[i] - base[i + 1])::BIGINT), lambda a, b: gcd(a, b)) ELSE 0 END AS g FROM s0),
    s2 AS (SELECT *, CASE WHEN g >= 10 THEN g ELSE coalesce(m, 0) END AS seen FROM s1),
    s3 AS (SELECT *, coalesce(side = 'input' AND m > 0 AND seen > m AND seen % m = 0, false) AS doubtful, ys[1] - (n - 1) * seen >= low AS wide, ys[1] - (n - 1) * m >= low AS narrow FROM s2),
    s4 AS (SELECT *, CASE WHEN NOT doubtful THEN seen WHEN multiple * m = seen AND wide THEN seen WHEN multiple = 1 AND narrow THEN m WHEN wide AND NOT narrow THEN seen WHEN narrow AND NOT wide THEN m END AS pitch FROM s3),
    s5 AS (SELECT *, side = 'output' AND pitch >= 10 AND len(list_filter(ys, lambda y: (ys[1] - y) % pitch <> 0)) = 0 AND
            greatest(0, ceil((low - 2 - ys[1]) / pitch) + n - 1) = least(n - 1 - round((ys[1] - ys[-1]) / pitch), floor((high + 2 - ys[1]) / pitch)) AS only_one,
            greatest(0, ceil((low - 2 - ys[1]) / pitch) + n - 1) AS fewest FROM s4),
    s6 AS (SELECT *, CASE WHEN pitch > 0 THEN CASE WHEN side = 'input' THEN greatest(al[1], 0) WHEN only_one THEN ys[1] + fewest * pitch ELSE coalesce(ky + kn * pitch, al[1]) END END::DOUBLE AS anchor FROM s5),
    s7 AS (SELECT *, ys IS NULL AND side = 'output' AND m > 0 AS glyph,
            NOT coalesce(only_one, false) AND len(list_filter(al, lambda y: NOT ((anchor - y) / pitch = floor((anchor - y) / pitch) AND anchor - y >= 0 AND (anchor - y) / pitch < n))) > 0 AS off FROM s6),
    plans AS (SELECT *, CASE WHEN n IS NULL THEN 'NO_LABELS' WHEN ys IS NULL AND NOT coalesce(glyph, false) THEN 'NO_PIN' WHEN glyph THEN CASE WHEN high - 25 - (n - 1) * m < low - 2 THEN 'GLYPH_OUTSIDE_BOX' END
            WHEN seen = 0 THEN 'NO_PITCH' WHEN pitch IS NULL THEN CASE WHEN wide AND narrow THEN 'AMBIGUOUS_PITCH' ELSE 'NO_PITCH_FITS' END
            WHEN side = 'input' AND al[1] > 0 AND (al[1] - al[-1]) / pitch + 1 <> n THEN 'FIRST_ROW_ABOVE_INSERTION' WHEN side = 'output' AND NOT only_one AND kn IS NULL AND anchor < 0 THEN 'TOP_ROW_BELOW_INSERTION' WHEN off THEN 'ROW_OFF_GRID' END AS refusal FROM s7),"""


@query(f"""
    WITH {_TERMINALS}
    grid AS (SELECT block, side, refusal, CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN 'GLYPH_PITCH' ELSE 'PITCH_SLOT' END END AS how, CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN rgt ELSE edge END END AS sx,
        CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN high - 25 ELSE anchor END END AS anchor, CASE WHEN glyph THEN m ELSE pitch END AS pitch, CASE WHEN NOT glyph AND side = 'output' AND NOT only_one THEN al END AS span FROM plans),
    ans AS (SELECT l.block, l.side, l.n, l.label, CASE WHEN e IS NOT NULL THEN 1 WHEN places = 1 THEN 2 WHEN places > 1 THEN 3 WHEN x.x IS NOT NULL THEN 4 WHEN g.anchor IS NOT NULL AND (span IS NULL OR g.anchor - l.n * pitch BETWEEN span[-1] AND span[1]) THEN 5 ELSE 6 END AS t,
        e, p.p, x.x AS ex, x.y AS ey, sx, g.anchor - l.n * pitch AS sy, how, refusal FROM labels l JOIN blocks b ON b.block = l.block AND NOT rotated LEFT JOIN explicit c ON c.block = l.block AND c.side = l.side AND c.label = l.label
        LEFT JOIN proven p ON p.key = b.key AND p.label = l.label LEFT JOIN exact x ON x.block = l.block AND x.side = l.side AND x.n = l.n LEFT JOIN grid g ON g.block = l.block AND g.side = l.side),
    placed AS (SELECT block, side, n, label, (CASE t WHEN 1 THEN e[2] WHEN 2 THEN p[1] WHEN 4 THEN ex WHEN 5 THEN sx END)::DOUBLE AS x, (CASE t WHEN 1 THEN e[3] WHEN 2 THEN p[2] WHEN 4 THEN ey WHEN 5 THEN sy END)::DOUBLE AS y,
        CASE t WHEN 1 THEN 'EXPLICIT' WHEN 2 THEN 'DERIVED' WHEN 3 THEN 'CONFLICT' WHEN 4 THEN 'DERIVED' WHEN 5 THEN 'INFERRED' ELSE 'UNRESOLVED' END AS association,
        CASE t WHEN 1 THEN 'WIRE_SPEC_MATCH' WHEN 2 THEN 'TEMPLATE_FROM_EXPLICIT' WHEN 4 THEN 'EXACT_PIN_COUNT' WHEN 5 THEN how ELSE 'NONE' END AS method,
        CASE t WHEN 3 THEN 'SEVERAL_PLACES' WHEN 6 THEN coalesce(refusal, 'BEYOND_WITNESSED_ROWS') END AS reason FROM ans)
    SELECT a.block, a.side, a.n, a.label, s.pin, a.x, a.y, coalesce(s.wired, false) AS wired, a.association, a.method,
        CASE WHEN a.x IS NULL THEN 'UNRESOLVED' WHEN s.block IS NULL THEN 'INFERRED' WHEN s.wired THEN 'EXPLICIT' ELSE 'DERIVED' END AS position_status, a.reason
    FROM placed a LEFT JOIN sp s ON s.block = a.block AND s.side = a.side AND s.x = a.x AND s.y = a.y
    UNION ALL SELECT s.block, s.side, NULL, NULL, s.pin, s.x, s.y, s.wired, 'UNRESOLVED', 'NONE', CASE WHEN s.wired THEN 'EXPLICIT' ELSE 'DERIVED' END, CASE WHEN rotated THEN 'ROTATED' ELSE 'UNCLAIMED' END
    FROM sp s JOIN blocks b USING (block) WHERE s.pin IS NOT NULL AND NOT EXISTS (SELECT 1 FROM placed a WHERE a.block = s.block AND a.side = s.side AND a.x = s.x AND a.y = s.y)""")
def terminal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminals.label_terminals(**drawn_symbols(spark, sf_dir))


@query(f"""
    WITH {_TERMINALS} q AS (SELECT 1) SELECT block, side, CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN 'GLYPH_PITCH' ELSE 'PITCH_SLOT' END END AS method,
        (CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN rgt ELSE edge END END)::DOUBLE AS slot_x, (CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN high - 25 ELSE anchor END END)::DOUBLE AS anchor,
        (CASE WHEN refusal IS NULL THEN CASE WHEN glyph THEN m ELSE pitch END END)::DOUBLE AS pitch, refusal FROM plans""")
def slot_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = drawn_symbols(spark, sf_dir)
    claims = terminals.wired_claims(t["links"], t["specs"], t["offsets"], t["blocks"], t["labels"])
    sided, proven = graph.stored(terminals.sided_pins(t["pins"], t["blocks"])), graph.stored(terminals.proven_places(claims, t["blocks"]))
    plans = terminals.slot_plans(t["blocks"], sided, t["labels"], proven)
    return plans.drop("lowest", "highest")


#: Suppliers are sheets; their lines' parts are the blocks on them. Every relation comes from all rows of its table.
_SCENE = """
    l AS (SELECT concat('S', l_suppkey) AS file, l_partkey AS block, * FROM lineitem),
    blocks AS (SELECT file, block, min(p_brand) AS name, min(p_size) AS fc FROM l JOIN part ON p_partkey = l_partkey GROUP BY file, block),
    records AS (SELECT DISTINCT file, block, 1000 + block % 50 AS fc FROM l WHERE l_returnflag = 'R'),
    terminals AS (SELECT file, block, CASE WHEN l_linenumber % 2 = 1 THEN 'input' ELSE 'output' END AS side, CASE WHEN l_linenumber % 2 = 1 THEN concat('S', l_linenumber) ELSE concat('N+', l_linenumber) END AS label,
        CASE WHEN l_quantity < 5 THEN 'UNRESOLVED' WHEN l_quantity < 7 THEN 'CONFLICT' ELSE 'EXPLICIT' END AS association, l_returnflag AS reason FROM l),
    specs AS (SELECT file, block, concat('S', round(l_quantity)::INTEGER % 8) AS label, l_orderkey AS value, CASE WHEN l_linestatus = 'O' THEN 'EXTRACTED' ELSE 'UNRESOLVED_LAYOUT' END AS status, CASE WHEN l_quantity > 48 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS target_status FROM l),
    outputs AS (SELECT DISTINCT file, block, l_linenumber AS off, concat('N+', l_linenumber) AS label FROM l WHERE l_quantity > 30),
    wires AS (SELECT concat('S', ps) AS file, id FROM (SELECT o_custkey % 100 + 1 AS ps, concat('w', o_orderkey) AS id FROM orders)),
    connections AS (SELECT concat('S', o_custkey % 100 + 1) AS file, concat('c', o_orderkey) AS id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS from_block, o_orderkey AS to_block, o_orderstatus AS status FROM orders),
    refs AS (SELECT concat('S', s_suppkey) AS file, concat('r', s_suppkey) AS id, s_name AS target, CASE s_nationkey % 3 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED_INTERNAL' ELSE 'AMBIGUOUS' END AS status FROM supplier),
    channels AS (SELECT concat('S', c_custkey % 100 + 1) AS file, concat('t', c_custkey) AS id FROM customer),
    unknown AS (SELECT concat('S', n_nationkey + 1) AS file, concat('u', n_nationkey) AS id, n_name AS kind FROM nation),"""


def sheet_relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    line, part, orders, supplier, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "supplier", "customer", "nation"))
    c = F.col
    join = lambda head, v: F.concat(F.lit(head), v.cast("string"))
    lines = line.withColumns({"file": join("S", c("l_suppkey")), "block": c("l_partkey")})
    odd = c("l_linenumber") % 2 == 1
    sheet = join("S", c("o_custkey") % 100 + 1)
    return {
        "blocks": lines.join(part, c("p_partkey") == c("l_partkey")).groupBy("file", "block").agg(F.min("p_brand").alias("name"), F.min("p_size").cast("long").alias("fc"), F.lit(0).alias("x"), F.lit(0).alias("y")),
        "records": lines.where("l_returnflag = 'R'").select("file", "block", (1000 + c("block") % 50).cast("long").alias("fc")).distinct(),
        "terminals": lines.select(
            "file", "block", F.when(odd, "input").otherwise("output").alias("side"), F.when(odd, join("S", c("l_linenumber"))).otherwise(join("N+", c("l_linenumber"))).alias("label"), F.lit(None).cast("string").alias("pin"),
            F.when(c("l_quantity") < 5, "UNRESOLVED").when(c("l_quantity") < 7, "CONFLICT").otherwise("EXPLICIT").alias("association"), c("l_returnflag").alias("reason"), F.lit(0).alias("x"), F.lit(0).alias("y"),
        ),
        "specs": lines.select(
            "file", "block", c("l_linenumber").alias("number"), join("S", F.round("l_quantity").cast("int") % 8).alias("label"), c("l_orderkey").alias("value"),
            F.when(c("l_linestatus") == "O", "EXTRACTED").otherwise("UNRESOLVED_LAYOUT").alias("status"), F.when(c("l_quantity") > 48, "UNRESOLVED").otherwise("RESOLVED").alias("target_status"),
        ),
        "outputs": lines.where("l_quantity > 30").select("file", "block", c("l_linenumber").alias("offset"), join("N+", c("l_linenumber")).alias("label")).distinct(),
        "wires": orders.select(sheet.alias("file"), join("w", c("o_orderkey")).alias("id")),
        "connections": orders.select(sheet.alias("file"), join("c", c("o_orderkey")).alias("id"), join("w", c("o_orderkey")).alias("wire"), F.when(c("o_orderstatus") != "P", c("o_custkey")).alias("from_block"), c("o_orderkey").alias("to_block"), c("o_orderstatus").alias("status")),
        "references": supplier.select(join("S", c("s_suppkey")).alias("file"), join("r", c("s_suppkey")).alias("id"), c("s_name").alias("target"), F.when(c("s_nationkey") % 3 == 0, "UNRESOLVED").when(c("s_nationkey") % 3 == 1, "RESOLVED_INTERNAL").otherwise("AMBIGUOUS").alias("status")),
        "channels": customer.select(join("S", c("c_custkey") % 100 + 1).alias("file"), join("t", c("c_custkey")).alias("id"), c("c_name").alias("text")),
        "unknown": nation.select(join("S", c("n_nationkey") + 1).alias("file"), join("u", c("n_nationkey")).alias("id"), c("n_name").alias("kind")),
    }


def _scene_count(name: str, alias: str) -> str:
    return f"LEFT JOIN (SELECT file, count(*) AS n FROM {name} GROUP BY file) AS {alias} ON {alias}.file = f.file"


@query(f"""
    WITH {_SCENE}
    issues AS (SELECT file, 'terminal' AS kind, concat(file, ':', block, '.', label) AS id, association AS status, reason FROM terminals WHERE association <> 'EXPLICIT'
        UNION ALL SELECT file, 'specification_value', concat(file, ':', block, '.', label), status, '' FROM specs WHERE status <> 'EXTRACTED' UNION ALL SELECT file, 'block_address_target', concat(file, ':', block, '.', label), target_status, value::VARCHAR FROM specs WHERE target_status = 'UNRESOLVED'
        UNION ALL SELECT file, 'unknown_record', concat(file, ':', id), 'RAW_ONLY', kind FROM unknown UNION ALL SELECT file, 'reference', concat(file, ':', id), status, target FROM refs WHERE status IN ('UNRESOLVED', 'AMBIGUOUS')
        UNION ALL SELECT file, 'connection', concat(file, ':', id), status, '' FROM connections WHERE from_block IS NULL),
    i AS (SELECT file, count(*)::INTEGER AS n, sha256(string_agg(concat_ws('|', kind, id, status, reason), chr(10) ORDER BY kind, id, status, reason)) AS h FROM issues GROUP BY file),
    s AS (SELECT file, count(*)::INTEGER AS n FROM specs WHERE (file, block, label) IN (SELECT (file, block, label) FROM terminals WHERE side = 'input') GROUP BY file),
    o AS (SELECT file, count(*)::INTEGER AS n FROM outputs WHERE (file, block, label) IN (SELECT (file, block, label) FROM terminals WHERE side = 'output') GROUP BY file),
    f AS (SELECT file FROM l UNION SELECT file FROM wires UNION SELECT file FROM refs UNION SELECT file FROM channels UNION SELECT file FROM unknown)
    SELECT f.file, 0 AS part, coalesce(k1.n, 0) AS blocks, coalesce(k2.n, 0) AS records, coalesce(k3.n, 0) AS terminals, coalesce(k4.n, 0) AS specs, coalesce(k5.n, 0) AS outputs, coalesce(k6.n, 0) AS wires, coalesce(k7.n, 0) AS connections,
        coalesce(k8.n, 0) AS "references", coalesce(k9.n, 0) AS channels, coalesce(k10.n, 0) AS unknown, coalesce(k2.n, 0)::INTEGER AS function_blocks, coalesce(s.n, 0) AS specs_at_terminals, coalesce(o.n, 0) AS sub_blocks_at_terminals, coalesce(i.n, 0) AS n_unresolved,
        coalesce(i.h, sha256('')) AS unresolved_sha256
    FROM f {" ".join(_scene_count(n, f"k{k}") for k, n in enumerate(("blocks", "records", "terminals", "specs", "outputs", "wires", "connections", "refs", "channels", "unknown"), 1))}
    LEFT JOIN i ON i.file = f.file LEFT JOIN s ON s.file = f.file LEFT JOIN o ON o.file = f.file""")
def scene_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.scene_digest(scene.assemble(sheet_relations(spark, sf_dir), part_rows=1 << 30))


@query("""
    WITH p AS (SELECT l_suppkey AS book, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::BIGINT AS page, (l_quantity / 50)::DOUBLE AS likeness FROM lineitem),
    c AS (SELECT *, likeness > 0.2 AND likeness > coalesce(lead(likeness) OVER w, -1) AS can FROM p WINDOW w AS (PARTITION BY book ORDER BY page)),
    r AS (SELECT *, coalesce(max(CASE WHEN NOT can THEN page END) OVER (PARTITION BY book ORDER BY page), -1) AS free FROM c)
    SELECT book, page, likeness, CASE WHEN can AND (page - free) % 2 = 1 THEN page + 1 END AS pair FROM r""")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), (F.row_number().over(order) - 1).cast("long").alias("page"), (F.col("l_quantity") / 50).cast("double").alias("likeness"))
    return ordering.pair_neighbours(pages, ["book"], "page", "likeness", 0.2, chunk=64)
