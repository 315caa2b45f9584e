"""Readers of vendor text listings: sections, multi-line rows, fixed columns, logs and reports.

Lines become rows with their file and number; headers are carried forward and rows numbered by windows over the lines of
a file. So a listing is never one value in one task, and files are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.tags import part
from plantlens.operators.ordering import carry_forward, number_runs

#: Grammars of the listings.
SECTION = r"([^\\/]*)\.CAD\s+(Outputs|Inputs)"
ADDRESS = r"\S{4}-\d{2}\.\d{2}"
DESTINATION = rf"({ADDRESS})(?:\s+(?!{ADDRESS})(\S+))?"
ERROR = rf"^Unrslvd\s+(Inp|Out):\s*(.*?)\s*({ADDRESS})?\s+In:\s*(.*?)\s*\z"
EXPECTED = r"No\. of CAD Sheets to Process\s*=\s*(\d+)"
READING = r"Reading:\s*(?:.*[\\/])?([^\\/.]+)"
BLANK = r"Blank description in file\s+(?:.*[\\/])?([^\\/.]+)"


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of the files under path, bytes taken as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return lines_of(files.select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text")), "file", "text")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line) with n from 1; line ends are not part of a line."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\r?\n"))).select(key, (F.col("pos") + 1).alias("n"), F.col("col").alias("line"))


def fixed_columns(line: Column) -> Column:
    """Struct of description (columns 1-32), source (33-48) and rest; blank ones are null, the rest isn't trimmed."""
    cut = lambda at, n: F.nullif(F.trim(F.substring(line, at, n)), F.lit(""))
    return F.struct(cut(1, 32).alias("description"), cut(33, 16).alias("source"), F.substring(line, 49, 1_000_000_000).alias("rest"))


def destinations(text: Column) -> Column:
    """Array of (reference, sheet) from `address sheet address sheet ...`; a missing sheet is null."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(DESTINATION), F.lit(1)).alias("reference"), F.regexp_extract_all(text, F.lit(DESTINATION), F.lit(2)).alias("sheet"))
    return F.transform(pairs, lambda p: F.struct(p["reference"].alias("reference"), F.nullif(p["sheet"], F.lit("")).alias("sheet")))


def parse_cross_reference(lines: DataFrame, key: str = "file") -> DataFrame:
    """(file, n, line) to entries: file, n, sheet, direction, description, source, destinations.

    A section header names sheet and direction. A row begins with text in its first columns; lines that begin with 20
    blanks or more continue its destinations. Dashes, column headers and blank lines are no rows.
    """
    line = F.col("line")
    # a pattern that begins with any text is tried from every place, so only lines that can be headers are
    header = line.contains(".CAD") & (F.regexp_extract(line, SECTION, 1) != "")
    noise = header | line.rlike(r"^\s*(-[-\s]*)?\z") | line.rlike(r"(?i)^\s*description\s+source\b")
    continued = line.rlike(r"^\s{20,}\S")
    marked = lines.withColumns({"__sheet": F.when(header, F.upper(F.regexp_extract(line, SECTION, 1))), "__way": F.when(header, F.regexp_extract(line, SECTION, 2))})
    for name, column in (("sheet", "__sheet"), ("direction", "__way")):
        marked = carry_forward(marked, F.col(column), name, [key], ["n"])
    body = marked.where("sheet is not null").withColumns({"__noise": noise, "__more": continued})
    rows = number_runs(body, F.col("__noise") | ~F.col("__more"), "__row", [key], ["n"]).where("not __noise")
    cut = fixed_columns(line)
    first = F.min(F.when(~F.col("__more"), F.struct(F.col("n"), cut["description"].alias("description"), cut["source"].alias("source"))))
    tails = F.array_sort(F.collect_list(F.struct("n", F.when(F.col("__more"), F.trim(line)).otherwise(cut["rest"]).alias("t"))))
    grouped = rows.groupBy(key, "sheet", "direction", "__row").agg(first.alias("f"), F.array_join(F.transform(tails, lambda t: t["t"]), " ").alias("tail"))
    return grouped.where("f is not null").select(key, F.col("f.n").alias("n"), "sheet", "direction", "f.description", "f.source", destinations(F.col("tail")).alias("destinations"))


def parse_errors(lines: DataFrame, key: str = "file") -> DataFrame:
    """Unresolved references: direction, description, reference and sheet of the lines that keep to the grammar."""
    line = F.col("line")
    found = lines.where(line.rlike(ERROR))
    sheet = F.upper(F.regexp_extract(F.regexp_extract(line, ERROR, 4), r"([^\\/]*?)(\.[^.\\/]*)?\z", 1))
    return found.select(key, "n", F.when(F.regexp_extract(line, ERROR, 1) == "Out", "Output").otherwise("Input").alias("direction"), part(line, ERROR, 2).alias("description"), part(line, ERROR, 3).alias("reference"), sheet.alias("sheet"), F.trim(line).alias("raw"))


def parse_log(lines: DataFrame, key: str = "file") -> DataFrame:
    """One row for each file: sheets to process (the last such line counts), different sheets read, lines with warnings."""
    line = F.col("line")
    expected = part(line, EXPECTED, 1)
    return lines.groupBy(key).agg(
        F.max_by(expected.cast("int"), F.when(expected.isNotNull(), F.col("n"))).alias("sheets_to_process"), F.count_distinct(part(line, READING, 1)).alias("n_sheets"),
        F.count_if(part(line, BLANK, 1).isNotNull()).alias("n_blank"), F.count_if(line.rlike("(?i)warning")).alias("n_warnings"),
    )


def blank_descriptions(lines: DataFrame, key: str = "file") -> DataFrame:
    """(file, sheet, n) of blank descriptions by sheet."""
    sheet = part(F.col("line"), BLANK, 1)
    return lines.where(sheet.isNotNull()).groupBy(key, sheet.alias("sheet")).agg(F.count("*").alias("n"))


def parse_verify_report(lines: DataFrame, key: str = "file") -> DataFrame:
    """Verify report: sheet, block, fc, spec, src and ref of each issue; headers are carried down three levels."""
    line = F.col("line")
    marks = {"sheet": part(line, r"Drawing File\s*:\s*(?:.*[\\/])?([^\\/.]+)", 1), "block": part(line, r"Block Number\s+(\d+)", 1).cast("int"), "fc": part(line, r"FC:\s*(\d+)", 1).cast("int"), "spec": part(line, r"^\s*S(\d+)\b", 1).cast("int")}
    for name, mark in marks.items():
        lines = carry_forward(lines, mark, name, [key], ["n"])
    value = {"src": part(line, r"SRC:\s*(.*?)\s*(?:REF:|\z)", 1), "ref": part(line, r"REF:\s*(.*?)\s*\z", 1)}
    said = lines.where(line.rlike("SRC:|REF:"))
    return said.groupBy(key, "sheet", "block", "spec").agg(F.max("fc").alias("fc"), *[F.max_by(v, F.when(v.isNotNull(), F.col("n"))).alias(c) for c, v in value.items()])


def parse_spec_report(lines: DataFrame, key: str = "file") -> DataFrame:
    """`Block n: FC n` headers and `Sn type value` lines: block, fc, number, type, value."""
    line = F.col("line")
    head = r"^\s*Block\s+(\d+)\s*:\s*FC\s+(\d+)"
    for name, k in (("block", 1), ("fc", 2)):
        lines = carry_forward(lines, part(line, head, k).cast("int"), name, [key], ["n"])
    spec = r"^\s*S(\d+)\s+([IBR])\s+(.*?)\s*\z"
    return lines.where(line.rlike(spec)).select(key, "block", "fc", part(line, spec, 1).cast("int").alias("number"), part(line, spec, 2).alias("type"), part(line, spec, 3).alias("value"))


def parse_block_trace(lines: DataFrame, key: str = "file") -> DataFrame:
    """`bbbb[-bbbb (n)] FC n SH:xx`: block, span, fc, sheet."""
    line, grammar = F.col("line"), r"^\s*(\d+)(?:-(\d+)\s*\(\s*(\d+)\s*\))?\s+FC\s*(\d+)\s+SH:\s*(\S+)"
    span = F.coalesce(part(line, grammar, 3).cast("int"), F.lit(1))
    return lines.where(line.rlike(grammar)).select(key, "n", part(line, grammar, 1).cast("int").alias("block"), span.alias("span"), part(line, grammar, 4).cast("int").alias("fc"), part(line, grammar, 5).alias("sheet"))


def printable_runs(files: DataFrame, least: int = 4, tag_like: str | None = None) -> DataFrame:
    """(path, content) to (path, ord, text): runs of printable ASCII, each text once at its first place."""
    runs = files.select("path", F.posexplode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(f"[ -~]{{{least},}}"), F.lit(0))).alias("ord", "text"))
    runs = runs.withColumn("text", F.trim("text"))
    if tag_like:
        runs = runs.where(F.col("text").rlike(tag_like))
    return runs.groupBy("path", "text").agg(F.min("ord").alias("ord")).select("path", "ord", "text")


def descriptors(files: DataFrame, least: int = 4) -> DataFrame:
    """Printable runs cut at three blanks or more: (path, text), each once."""
    runs = printable_runs(files, least)
    return runs.select("path", F.explode(F.split("text", r"\s{3,}")).alias("text")).where("text <> ''").distinct()


def module_headers(files: DataFrame) -> DataFrame:
    """(path, controller, prefix): the first controller type and the first two-letter prefix among the runs."""
    runs = printable_runs(files, 2)
    first = lambda pattern: F.min_by(part(F.col("text"), pattern, 1), F.when(F.col("text").rlike(pattern), F.col("ord")))
    return runs.groupBy("path").agg(first(r"\b((?:MFP|MFC|BRC|AMM|COM|IMMFP|IMMFC)\d*)\b").alias("controller"), first(r"^([A-Z]{2})\z").alias("prefix"))


def latest_by_name(files: DataFrame, names: DataFrame) -> DataFrame:
    """The file of each wanted name (upper-case) with the shortest path."""
    named = files.withColumn("name", F.upper(F.regexp_extract("path", r"([^/\\]*)\z", 1)))
    shortest = Window.partitionBy("name").orderBy(F.length("path"), "path")
    return named.join(names, "name").withColumn("__r", F.row_number().over(shortest)).where("__r = 1").drop("__r")
