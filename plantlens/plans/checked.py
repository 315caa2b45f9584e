"""Queries of symbols, positions, constraints and the engineering model, with tables shaped into their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions import colours, symbols
from plantlens.operators import graph
from plantlens.plans import adapter, constraints, displays, positions
from plantlens.registry import Registry, table
from plantlens.sources import records

REGISTRY = Registry()
query = REGISTRY.query

#: Names that parts have as symbols, in upper or lower case and with blanks around, by their key.
NAMES = tuple(sorted({*symbols.CODES, *(n for names in symbols.ROLE_NAMES.values() for n in names), "F(x)", "RDI1", "RDO2X", "TAI3", "TCSA", "TUIN9", "NTAI1", "AI7FLD", "SEQ9", "R-100", "MFC/P", "UNHEARD", "", "IREFX"}))
_LIST = ", ".join(f"'{n}'" for n in NAMES)
_NAMED = f"n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(' ', lower(x), ' ') WHEN 1 THEN CASE WHEN p_size = 9 THEN NULL ELSE x END ELSE x END AS name FROM (SELECT *, ([{_LIST}])[p_partkey % {len(NAMES)} + 1] AS x FROM part))"


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.lower(raw), F.lit(" "))).when((F.col("p_partkey") % 4 == 1) & (F.col("p_size") == 9), None).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_ROLE = " ".join(f"WHEN upper(trim(name)) IN ({_in(names)}) THEN '{role}'" for role, names in symbols.ROLE_NAMES.items())
_FAMILY = " ".join(f"WHEN regexp_matches(upper(trim(name)), '{form}') THEN '{kind}'" for form, kind in symbols.FAMILIES)
_TYPE = " ".join(f"WHEN regexp_matches(upper(name), '{form}') THEN '{kind}'" for form, kind in symbols.BLOCK_TYPES)


@query(f"""
    WITH {_NAMED}, codes(k, v) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in symbols.CODES.items())})
    SELECT p_partkey, CASE {_ROLE} WHEN regexp_matches(upper(trim(name)), '{symbols.IO_PREFIX}') THEN 'io-module' ELSE 'generic' END AS role, v::INTEGER AS code, CASE {_FAMILY} ELSE 'generic' END AS family, CASE {_TYPE} ELSE 'LogicBlock' END AS type
    FROM n LEFT JOIN codes ON k = upper(trim(name))""")
def symbol_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return named_parts(spark, sf_dir).select("p_partkey", symbols.symbol_role(n).alias("role"), symbols.function_code(n).alias("code"), symbols.symbol_family(n).alias("family"), symbols.block_type(n).alias("type"))


#: Orders are sheets: a line's place on the drawing, and on its plot turned and stretched; some texts are moved, replaced or left out.
_PLOT = """
    l AS (SELECT l_suppkey AS sheet, l_orderkey * 10 + l_linenumber AS id, l_partkey, l_linenumber, l_quantity, l_discount, l_tax, (l_partkey * 7 % 1000)::DOUBLE AS x, (l_orderkey * 13 % 700)::DOUBLE AS y FROM lineitem),
    t AS (SELECT sheet, concat('T', l_partkey) AS text, x, y FROM l), f AS (SELECT sheet, 0.5 * x - 0.25 * y + 10 + sheet AS px, 0.25 * x + 0.5 * y - 5 AS py, * EXCLUDE (sheet) FROM l)"""


def _plotted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = F.col
    line = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("sheet"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        (c("l_partkey") * 7 % 1000).cast("double").alias("x"), (c("l_orderkey") * 13 % 700).cast("double").alias("y"),
    )
    plot = line.withColumns({"px": 0.5 * c("x") - 0.25 * c("y") + 10 + c("sheet"), "py": 0.25 * c("x") + 0.5 * c("y") - 5})
    text = F.concat(F.lit("T"), c("l_partkey").cast("string"))
    off = F.when(c("l_discount") > 0.09, 1.0).otherwise(0.0)
    runs = plot.select("sheet", text.alias("text"), (c("px") + off).alias("x"), c("py").alias("y"))
    label = lambda n: F.concat(F.lit("S"), (n % 9 + 1).cast("string"))
    notes = line.select("sheet", "id", F.lit("s_label").alias("kind"), label(c("l_partkey")).alias("text"), "x", "y")
    shown = label(F.when(c("l_quantity") > 45, c("l_partkey") + 1).otherwise(c("l_partkey")))
    away = F.when(c("l_tax") > 0.07, 40.0).otherwise(0.0)
    tokens = plot.where("l_quantity > 3").select("sheet", shown.alias("text"), (c("px") - 12 + away).alias("x1"), c("py").alias("y1"), (c("px") + away).alias("x2"), c("py").alias("y2"))
    return line.select("sheet", text.alias("text"), "x", "y"), runs, notes, tokens


@query(f"""
    WITH {_PLOT}, s AS (SELECT sheet, text, min(x) AS x, min(y) AS y FROM t GROUP BY ALL HAVING count(*) = 1), r AS (SELECT sheet, text, min(px) AS px, min(py) AS py FROM (SELECT sheet, concat('T', l_partkey) AS text, px + CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS px, py FROM f) GROUP BY ALL HAVING count(*) = 1)
    SELECT sheet, count(*) AS anchors FROM s JOIN r USING (sheet, text) GROUP BY sheet""")
def plot_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, runs, _, _ = _plotted(spark, sf_dir)
    return positions.sheet_fits(texts, runs).select("sheet", "anchors")


@query(f"""
    WITH {_PLOT}, k AS (SELECT sheet, concat('S', CASE WHEN l_quantity > 45 THEN l_partkey + 1 ELSE l_partkey END % 9 + 1) AS text, px + CASE WHEN l_tax > 0.07 THEN 40 ELSE 0 END AS ex, py AS ey FROM f WHERE l_quantity > 3),
    n AS (SELECT sheet, id, concat('S', l_partkey % 9 + 1) AS text, px, py FROM f),
    same AS (SELECT n.sheet, n.id, min(sqrt(pow(px - ex, 2) + pow(py - ey, 2))) AS d FROM n JOIN k ON n.sheet = k.sheet AND n.text = k.text GROUP BY ALL),
    near AS (SELECT n.sheet, n.id, min(k.text) AS any_text FROM n JOIN k ON n.sheet = k.sheet AND abs(px - ex) <= 3 AND abs(py - ey) <= 3 WHERE sqrt(pow(px - ex, 2) + pow(py - ey, 2)) <= 3 GROUP BY ALL)
    SELECT n.sheet, CASE WHEN d <= 3 THEN 'CONFIRMED' WHEN any_text IS NOT NULL THEN 'WRONG_TEXT' WHEN d IS NOT NULL THEN 'MISPLACED' ELSE 'NOT_IN_PLOT' END AS verdict, count(*) AS n
    FROM n LEFT JOIN same USING (sheet, id) LEFT JOIN near USING (sheet, id) GROUP BY ALL""")
def plot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are exact here, so the fit comes from texts without the ones that the other query moves."""
    texts, _, notes, tokens = _plotted(spark, sf_dir)
    runs = texts.withColumns({"px": 0.5 * F.col("x") - 0.25 * F.col("y") + 10 + F.col("sheet"), "py": 0.25 * F.col("x") + 0.5 * F.col("y") - 5}).select("sheet", "text", F.col("px").alias("x"), F.col("py").alias("y"))
    # distances of whole texts at round places are far from the tolerance, so that the fit's last bits don't matter
    return positions.position_verdicts(notes, tokens, positions.sheet_fits(texts, runs), distances=False).groupBy("sheet", "verdict").agg(F.count("*").alias("n"))


_ROWS = """
    s AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number, count(*) OVER (PARTITION BY l_orderkey) AS fc, * FROM lineitem),
    k AS (SELECT *, l_returnflag = 'A' AND number = 1 AS gone FROM s)"""


def _extraction(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders are blocks, their lines specs with values of two bytes; a code has as many specs as lines. Some are spoilt."""
    c = F.col
    whole = Window.partitionBy("l_orderkey")
    line = table(spark, sf_dir, "lineitem").withColumns({"number": F.row_number().over(whole.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "fc": F.count("*").over(whole), "block": c("l_orderkey"), "q": F.round("l_quantity").cast("int")})
    # every rule reads lines or blocks, each with other columns, so without tables of their own they are numbered and folded a dozen times
    line = graph.stored(line.select("block", "number", "fc", "q", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_partkey"))
    two = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    payload = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", two(c("q")).alias("h")))), lambda x: x["h"]), "")
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("block"), "o_orderpriority")
    blocks = line.groupBy("block").agg(F.first("fc").alias("fc"), F.unhex(payload).alias("payload")).join(orders, "block", "left")
    blocks = blocks.select(F.lit("m").alias("sheet"), "block", "fc", "payload", F.when(c("o_orderpriority") == "5-LOW", "MISMATCH").otherwise("DECODED").alias("layout_status"), F.lit(True).alias("drawn"), F.lit(1).alias("sources"))
    manual = line.select("fc", "number").distinct().select("fc", "number", F.concat(F.lit("S"), c("number").cast("string")).alias("label"), F.lit("I").alias("type"), *[F.lit("").alias(k) for k in ("default", "range", "tune", "description")])
    value = c("q") + F.when(c("l_tax") > 0.07, 1).otherwise(0)
    label = F.when(c("l_discount") > 0.09, "X").otherwise(F.concat(F.lit("S"), c("number").cast("string")))
    specs = line.where("not (l_returnflag = 'A' and number = 1)").select(
        F.lit("m").alias("sheet"), "block", "number", label.alias("label"), F.lit("I").alias("type"), *[F.lit("").alias(k) for k in ("default", "range", "tune", "description")], value.cast("string").alias("raw_text"),
        F.lower(two(c("q"))).alias("raw_hex"), value.cast("double").alias("value"), F.lit("EXTRACTED").alias("status"), (2 * (c("number") - 1)).alias("byte_offset"),
        c("l_partkey").alias("target_block"), F.lit(None).cast("long").alias("target_fc"), F.when(c("l_quantity") > 40, "RESOLVED_BLOCK").alias("target_status"),
    )
    return {"blocks": graph.stored(blocks), "specs": specs, "manual": graph.stored(manual)}


@query(f"""
    WITH {_ROWS} SELECT 'no_invented_values' AS rule, concat('m:', block, ':', number) AS ref FROM k WHERE NOT gone AND l_tax > 0.07 UNION ALL SELECT 'manual_match', concat('m:', block, ':', number) FROM k WHERE NOT gone AND l_discount > 0.09
    UNION ALL SELECT 'spec_count', concat('m:', block) FROM k WHERE gone UNION ALL SELECT DISTINCT 'layout_closure', concat('m:', block) FROM k JOIN orders ON o_orderkey = block WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT 'address_targets', concat('m:', block, ':', number) FROM k WHERE NOT gone AND l_quantity > 40 AND l_partkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def constraint_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.failures(_extraction(spark, sf_dir))


_MODEL = """
    conn AS (SELECT l_suppkey AS sheet, CASE WHEN l_linenumber = 1 THEN 'dangling' WHEN l_linenumber = 2 THEN 'connector' ELSE 'pin' END AS fk, l_orderkey % 200 AS fr, CASE WHEN l_returnflag = 'R' THEN 'pin' ELSE 'junction' END AS tk, l_partkey AS tr, l_linestatus AS rel, concat(l_orderkey, '.', l_linenumber, '.', l_partkey) AS id FROM lineitem WHERE l_shipdate IS NOT NULL),
    pins AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey AS id, concat('B', l_partkey % 10) AS block FROM lineitem),
    r AS (SELECT o_custkey % 100 + 1 AS sheet, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED_CROSS_SHEET' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'BOUNDARY_SIGNAL' ELSE 'UNRESOLVED' END ELSE 'SAME_LOOP' END AS status FROM orders)"""


def _drawing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = F.col
    text = lambda *v: F.concat_ws(".", *[x.cast("string") for x in v])
    line = table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    from_kind = F.when(c("l_linenumber") == 1, "dangling").when(c("l_linenumber") == 2, "connector").otherwise("pin")
    wires = line.select(
        c("l_suppkey").alias("sheet"), text(c("l_orderkey"), c("l_linenumber"), c("l_partkey")).alias("id"), F.lit("signal").alias("type"), from_kind.alias("from_kind"), (c("l_orderkey") % 200).alias("from_ref"),
        F.when(c("l_returnflag") == "R", "pin").otherwise("junction").alias("to_kind"), c("l_partkey").alias("to_ref"), F.when(c("l_linestatus") == "O", "INFERRED").otherwise("EXPLICIT").alias("relation"),
    )
    pins = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("sheet"), c("l_partkey").alias("id"), F.concat(F.lit("B"), (c("l_partkey") % 10).cast("string")).alias("block")).distinct()
    status = F.when(c("o_orderstatus") == "F", "RESOLVED_CROSS_SHEET").when(c("o_orderstatus") == "O", F.when(c("o_orderkey") % 2 == 0, "BOUNDARY_SIGNAL").otherwise("UNRESOLVED")).otherwise("SAME_LOOP")
    references = table(spark, sf_dir, "orders").select((c("o_custkey") % 100 + 1).alias("sheet"), c("o_orderkey").alias("id"), c("o_custkey").alias("connector"), F.lit(None).cast("string").alias("reference"), c("o_orderpriority").alias("tag"), status.alias("status"))
    return wires, pins, references


@query(f"""
    WITH {_MODEL} SELECT c.sheet, c.id, CASE WHEN fk = 'pin' AND p.block IS NOT NULL THEN p.block WHEN fk IN ('pin', 'connector') THEN fr::VARCHAR END AS source_block, CASE WHEN fk = 'pin' AND p.block IS NOT NULL THEN fr::VARCHAR END AS source_port,
        CASE WHEN tk = 'pin' THEN coalesce(q.block, tr::VARCHAR) END AS target_block, CASE WHEN tk = 'pin' AND q.block IS NOT NULL THEN tr::VARCHAR END AS target_port, fk <> 'dangling' AS resolved, CASE WHEN rel = 'O' THEN 'INFERRED' ELSE 'EXPLICIT' END AS relation
    FROM conn c LEFT JOIN pins p ON p.sheet = c.sheet AND p.id = fr AND fk = 'pin' LEFT JOIN pins q ON q.sheet = c.sheet AND q.id = tr AND tk = 'pin'""")
def model_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    wires, pins, _ = _drawing(spark, sf_dir)
    return adapter.model_connections(wires, pins)


@query(f"""
    WITH {_MODEL}, b AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey % 10 AS id FROM lineitem), u AS (SELECT sheet, count(*) AS n FROM b GROUP BY 1), x AS (SELECT sheet, count(*) AS n, count(*) FILTER (WHERE fk = 'dangling') AS o FROM conn GROUP BY 1),
        y AS (SELECT sheet, count(*) AS n, count(*) FILTER (WHERE status IN ('UNRESOLVED', 'SAME_LOOP')) AS o FROM r GROUP BY 1), d AS (SELECT DISTINCT n_nationkey + 1 AS sheet FROM nation), k AS (SELECT sheet FROM u UNION SELECT sheet FROM x UNION SELECT sheet FROM y UNION SELECT sheet FROM d)
    SELECT k.sheet, coalesce(u.n, 0) AS blocks, coalesce(x.n, 0) AS connections, coalesce(y.n, 0) AS "references", coalesce(x.o, 0) + coalesce(y.o, 0) AS unresolved,
        CASE WHEN coalesce(x.o, 0) + coalesce(y.o, 0) > 0 OR d.sheet IS NOT NULL THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status FROM k LEFT JOIN u ON u.sheet = k.sheet LEFT JOIN x ON x.sheet = k.sheet LEFT JOIN y ON y.sheet = k.sheet LEFT JOIN d ON d.sheet = k.sheet""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    wires, pins, references = _drawing(spark, sf_dir)
    blocks = pins.select("sheet", (c("id") % 10).alias("id")).distinct().select("sheet", "id", F.lit("PID").alias("name"), F.lit(18).alias("fc"), c("id").alias("number"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(9).alias("x2"), F.lit(9).alias("y2"), F.lit(True).alias("library"))
    ports = pins.select("sheet", (c("id") % 10).alias("block"), c("id").cast("string").alias("pin"), F.when(c("id") % 2 == 0, "input").otherwise("output").alias("direction"))
    joints = references.where("status = 'SAME_LOOP'").select("sheet", "id", F.lit("connected").alias("kind"), F.lit(5).alias("x"), F.lit(5).alias("y"))
    values = pins.select("sheet", (c("id") % 10).alias("block"), F.lit("TO").alias("key"), c("id").cast("string").alias("value"))
    remarks = table(spark, sf_dir, "nation").select((c("n_nationkey") + 1).alias("sheet"))
    return adapter.model_summary(adapter.model_blocks(blocks, ports, values, joints), adapter.model_connections(wires, pins), adapter.model_references(references), remarks)


#: Orders are displays: a point for each line, a constant whose text looks like the beginning of a record, and an unknown record.
_RECORDS = """
    f AS (SELECT l_orderkey AS file, count(*) AS n, sum(length(l_partkey::VARCHAR)) AS digits, count(*) FILTER (WHERE l_returnflag = 'R') AS odd, count(*) FILTER (WHERE l_returnflag = 'A') AS bad FROM lineitem GROUP BY 1)"""


def display_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): displays with four or five records for each line of an order, a few lines each."""
    c = F.col
    word = lambda v: F.concat(*[F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * k) % 256), 2, "0") for k in range(4)])
    text = lambda v: F.concat(F.hex(v.cast("binary")), F.lit("00"))
    record = lambda name, *body: F.concat(F.lit("00000000" + (name + "+").encode().hex().upper() + "00"), *body)
    odd = F.when(c("l_returnflag") == "R", record("Odd_X", F.lit("0102"))).otherwise("")
    bad = F.when(c("l_returnflag") == "A", record("G_IntConst_30", F.lit("07"))).otherwise("")
    body = F.concat(
        record("Point", word(c("l_linenumber") * 65536), word(F.round("l_quantity") * 65536)), odd, record("G_StrConst_30", text(F.concat(c("l_partkey").cast("string"), F.lit(" Ghost+")))),
        record("LinkRef", word(c("l_linenumber")), word(F.lit(0))), bad,
    )
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", body.alias("body")).alias("b"))
    whole = F.concat(F.lit((b"m1gms4u\n" + bytes(12)).hex().upper()), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["body"]), ""))
    return lines.groupBy("file").agg(F.unhex(whole).alias("content")).select(c("file").cast("string").alias("path"), "content")


@query(f"""
    WITH {_RECORDS} SELECT file::VARCHAR AS path, 3 * n + odd + bad AS records, (n * 19 + n * (19 + 8) + digits + n * (13 + 8) + odd * 11 + bad * 19)::BIGINT AS typed_bytes, odd * 2 + bad AS unresolved_bytes, 0::BIGINT AS missing_bytes, bad AS errors FROM f""")
def record_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = display_files(spark, sf_dir)
    return records.field_coverage(records.decode_records(files, ("path", "error", "n", "type", "bytes")), files.select("path", F.octet_length("content").alias("length")))


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, round(l_quantity) AS q, coalesce(sum(3 + CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM lineitem)
    SELECT l_orderkey::VARCHAR AS path, (k + 1)::INTEGER AS id, 'y' AS field, concat(q::INTEGER, '.0') AS value, NULL::BIGINT AS target FROM p
    UNION ALL SELECT l_orderkey::VARCHAR, (k + 3 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER, 'first', l_linenumber::VARCHAR, l_linenumber FROM p
    UNION ALL SELECT l_orderkey::VARCHAR, (k + 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER, 'value', concat(l_partkey, ' Ghost+'), NULL FROM p""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.decode_records(display_files(spark, sf_dir), ("path", "id", "field", "value", "target"), ("y", "first", "value"))


@query("""
    WITH f AS (SELECT *, concat('t', l_orderkey) AS name, l_orderkey % 4 AS form FROM lineitem)
    SELECT name AS template, count(*) AS points, sum(round(l_quantity))::DOUBLE AS total FROM f WHERE form <> 3 GROUP BY name""")
def library_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are submodels with a model and a point for each line: as a graphic, under the newer and the older header, and unreadable.
    Each name comes from two folders, the second of which has none of its points."""
    c = F.col
    word = lambda v, n: F.concat(*[F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * k) % 256), 2, "0") for k in range(n)])
    form = c("l_orderkey") % 4
    start = F.when(form == 1, F.repeat(F.lit("00"), F.lit(2))).otherwise(F.repeat(F.lit("00"), F.lit(4)))
    model = F.concat(start, F.lit((b"Model+\0" + bytes(14) + b"v\0m\0" + bytes(8)).hex()))
    point = F.concat(start, F.lit(b"Point+\0".hex()), word(c("l_linenumber") * 65536, 4), word(F.round("l_quantity") * 65536, 4))
    head = F.when(form == 0, F.lit((b"m1gms4u\n" + bytes(12)).hex())).when(form == 1, F.lit((b"!!<gms>\n" + bytes([8, 0, 0, 0]) + bytes(6)).hex())).when(form == 2, F.lit((b"!!<gms>\n" + bytes([12, 0, 0, 0]) + bytes(40)).hex())).otherwise(F.lit(b"nothing".hex()))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", head.alias("head"), model.alias("model"), F.struct("l_linenumber", "l_partkey", "l_suppkey", point.alias("p")).alias("b"))
    whole = lines.groupBy("l_orderkey", "head", "model").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["p"]), "").alias("points"))
    copies = whole.select("l_orderkey", "head", "model", F.explode(F.array(F.struct(F.lit(0).alias("root"), c("points")), F.struct(F.lit(1).alias("root"), F.lit("").alias("points")))).alias("r"))
    path = F.concat(F.when(c("r.root") == 0, "/first/T").otherwise("/second/t"), c("l_orderkey").cast("string"), F.when(c("r.root") == 0, ".m1").otherwise(".M1"))
    fields = records.template_library(copies.select("r.root", path.alias("path"), F.unhex(F.concat("head", "model", "r.points")).alias("content")), ("path", "class", "field", "value"), ("y",))
    return fields.where("class = 'Point' and field = 'y'").groupBy("template").agg(F.count("*").alias("points"), F.sum(c("value").cast("double")).alias("total"))


@query(f"""
    WITH i AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE p_partkey % 400 END AS n FROM part), h AS (SELECT *, n * {colours.MIX} % 4294967296 AS a FROM i), g AS (SELECT *, (xor(a, a >> 16) * {colours.SECOND_MIX}) % 4294967296 AS b FROM h),
    l AS (SELECT *, {colours.LIGHTNESS}::DOUBLE + (b % 20) / 100 AS light, (a % 360) / 30 AS hue FROM g), r AS (SELECT *, {colours.SATURATION}::DOUBLE * least(light, 1 - light) AS reach, [hue % 12, (8 + hue) % 12, (4 + hue) % 12] AS k FROM l),
    t AS (SELECT *, list_transform(k, lambda x: floor((light - reach * greatest(-1, least(x - 3, 9 - x, 1))) * 255 + 0.5)::BIGINT) AS rgb FROM r)
    SELECT p_partkey, CASE WHEN n = 7 OR n = 300 THEN '#010203' WHEN n < 16 THEN ([{", ".join(f"'#{bytes(c).hex()}'" for c in colours.ANSI)}])[n + 1] WHEN n IS NOT NULL THEN printf('#%02x%02x%02x', rgb[1], rgb[2], rgb[3]) END AS hex,
        CASE WHEN n = 7 OR n = 300 THEN 'CALIBRATED' WHEN n < 16 THEN 'ASSUMED' WHEN n IS NOT NULL THEN 'UNKNOWN' END AS source FROM t""")
def palette_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.when(F.col("p_size") != 50, F.col("p_partkey") % 400).cast("int")
    known = F.create_map(F.lit(7), F.lit("#010203"), F.lit(300), F.lit("#010203"))
    return table(spark, sf_dir, "part").select("p_partkey", colours.resolve_colour(index, known).alias("c")).select("p_partkey", "c.hex", "c.source")


@query("""
    WITH o AS (SELECT l_suppkey AS path, concat(l_orderkey, '.', l_linenumber, '.', l_partkey) AS id, l_discount * 5 AS recall, round(l_quantity)::BIGINT AS pixels FROM lineitem),
    w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY recall, id) AS place FROM o WHERE recall < 0.33)
    SELECT p_partkey AS path, 'TEMPLATE_OUTSIDE' AS kind, p_brand AS subject, p_size::BIGINT AS instances, p_size % 2 = 0 AS resolved, NULL::BIGINT AS percent, NULL::BIGINT AS pixels FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT path, 'LOW_RECALL', id, NULL, false, round(recall * 100)::BIGINT, pixels FROM w WHERE place <= 15""")
def discrepancy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    templates = part.select(c("p_partkey").alias("path"), c("p_brand").alias("name"), F.when(c("p_size") % 3 == 0, "EXTERNAL_UNRESOLVED").otherwise("EMBEDDED").alias("status"), c("p_size").alias("instances"))
    objects = line.select(c("l_suppkey").alias("path"), F.concat_ws(".", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"), (c("l_discount") * 5).alias("recall"), F.round("l_quantity").alias("pixels"))
    return displays.discrepancies(templates, part.where("p_size % 2 = 0").select(c("p_partkey").alias("path"), c("p_brand").alias("name")), objects, recall=0.33)
