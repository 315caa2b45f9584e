"""File inventories, the knowledge base of function codes, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions import tags

#: Of a function code's JSON, what the engine reads.
CODE_SCHEMA = T.StructType([
    T.StructField("function_code", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("outputs", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("blk", "type", "description")]))),
    T.StructField("specifications", T.ArrayType(T.StructType([
        T.StructField("number", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("type", T.StringType()), T.StructField("default", T.StringType()), T.StructField("range", T.StringType()),
        T.StructField("tune", T.BooleanType()), T.StructField("is_block_address", T.BooleanType()), T.StructField("description", T.StringType()),
        T.StructField("enumerations", T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("meaning", T.StringType())]))),
    ]))),
])


def inventory(files: DataFrame) -> DataFrame:
    """(path, length, content) with extension, kind, provenance and sha256."""
    place = tags.provenance(F.col("path"))
    return files.select("path", "length", tags.extension(F.col("path")).alias("extension"), tags.file_kind(tags.extension(F.col("path"))).alias("kind"), place["loop"].alias("loop"), place["cpu"].alias("cpu"), place["module"].alias("module"), F.sha2("content", 256).alias("sha256"))


def by_kind(files: DataFrame) -> DataFrame:
    """Files and bytes of each kind, with the last known loop, cpu and module in path order."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("path"))).alias(c)
    return files.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), last("loop"), last("cpu"), last("module"))


def read_function_codes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Function codes, their specifications, outputs and enumerations, from one JSON file for each code."""
    codes = spark.read.schema(CODE_SCHEMA).option("multiLine", "true").json(folder)
    specs = codes.select(F.col("function_code").alias("fc"), F.explode("specifications").alias("s")).select("fc", "s.*")
    outputs = codes.select(F.col("function_code").alias("fc"), F.explode("outputs").alias("o")).select("fc", "o.*")
    enums = specs.select("fc", "number", F.explode("enumerations").alias("e")).select("fc", "number", "e.value", "e.meaning")
    types = specs.groupBy("fc").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "type"))), lambda x: x["type"]).alias("types"))
    offset = F.regexp_extract("blk", r"^N(?:\s*\+\s*(\d+))?$", 1)
    offsets = outputs.where(F.col("blk").rlike(r"^N(\s*\+\s*\d+)?$")).groupBy("fc").agg(F.array_sort(F.collect_set(F.coalesce(F.nullif(offset, F.lit("")).cast("int"), F.lit(0)))).alias("offsets"))
    return {"codes": codes.select(F.col("function_code").alias("fc"), "name"), "specs": specs.drop("enumerations"), "outputs": outputs, "enumerations": enums, "types": types, "offsets": offsets}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quotes doubled inside quotes; arrays are joined by semicolons."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, by: list[str] | None = None) -> None:
    """Each relation as Parquet in a folder of its own, partitioned by the columns of `by` that it has."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = [c for c in by or [] if c in df.columns]
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{folder}/{name}")


def spec_tree(specs: DataFrame) -> DataFrame:
    """One JSON text for each sheet: its blocks in order, each with its specs in order."""
    blocks = specs.groupBy("sheet", "block", "fc").agg(F.array_sort(F.collect_list(F.struct("number", "type", "value"))).alias("specs"))
    sheets = blocks.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("block", "fc", "specs"))).alias("blocks"))
    return sheets.select("sheet", F.to_json("blocks").alias("tree"))


def ordered_text(parts: Column) -> Column:
    """An array of (place, text) as one text in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), " ")
