"""Displays: object headers, the reference graph, bindings of instances, tag index and flattened hierarchies."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import numbers, tags
from plantlens.operators.graph import ensure_checkpoints

#: Reference slots at the beginning of an object's body, with the role of what they point to.
SLOTS = (("hdr.dynPropRef", "dynamic"), ("hdr.transformRef", "transform"), ("hdr.slot2Ref", "secondary"))

#: Forms of property values, and words of keys that bind to tags.
DOTTED, NAVIGATION, TAG_KEY = r"^[^\s.]+\.[A-Za-z_][A-Za-z0-9_]*\z", r"^graphic:\d+\z", "(?i)tag|atom|limit"


def _header(body: bytes) -> tuple:
    """Three references, flags, two zero-terminated names, a number, and where the header ends; nulls if it is cut off."""
    first, second = body.find(b"\0", 14), -1
    if first >= 0:
        second = body.find(b"\0", first + 1)
    if second < 0 or len(body) < second + 5:
        return (None,) * 8
    refs = struct.unpack_from("<IIIH", body)
    return (*refs, body[14:first].decode("latin1"), body[first + 1 : second].decode("latin1"), struct.unpack_from("<I", body, second + 1)[0], second + 5)


def object_headers(records: DataFrame) -> DataFrame:
    """Records of decode_displays with the fields of their common header."""
    schema = "path string, id int, class string, dynamic_ref long, transform_ref long, secondary_ref long, flags int, name string, name2 string, slot3 long, header_bytes int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = pd.DataFrame([_header(bytes(b)) for b in batch["body"]], columns=[f.split()[0] for f in schema.split(", ")[3:]], dtype=object)
            yield pd.concat([batch[["path", "id", "class"]].reset_index(drop=True), fields], axis=1)

    return records.select("path", "id", "class", "body").mapInPandas(run, schema)


def header_references(headers: DataFrame) -> DataFrame:
    """(path, id, field, role, target) of the references that are set; zero is none."""
    slots = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("role"), F.col(f"{r}_ref").alias("target")) for f, r in SLOTS])
    return headers.select("path", "id", F.explode(slots).alias("r")).select("path", "id", "r.*").where("target > 0")


def missing_references(objects: DataFrame, references: DataFrame) -> DataFrame:
    """References to objects that aren't there."""
    ids = objects.select("path", F.col("id").cast("long").alias("target"))
    return references.join(ids, ["path", "target"], "left_anti")


def allocation_faults(objects: DataFrame, references: DataFrame) -> DataFrame:
    """(path, id, field, expected, target): references beyond the next free id, walking objects and their references in order.

    references: path, id, n (place within the object), field, target.
    """
    walk = objects.select("path", "id", F.lit(-1).alias("n"), F.lit("(self)").alias("field"), F.col("id").cast("long").alias("target")).union(references.select("path", "id", "n", "field", "target"))
    before = F.coalesce(F.max("target").over(Window.partitionBy("path").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    found = walk.withColumn("expected", F.greatest(before, F.lit(1)) + 1)
    return found.where("target > expected or (field = '(self)' and target = expected)")


def role_evidence(objects: DataFrame, references: DataFrame) -> DataFrame:
    """(class, role, field, n, targets): which classes the references of a class and field point to, as `A 3, B 1`."""
    source = objects.select("path", "id", "class")
    target = objects.select("path", F.col("id").cast("long").alias("target"), F.col("class").alias("target_class"))
    field = F.regexp_replace("field", r"\[\d+\]", "[]")
    named = references.join(source, ["path", "id"]).join(target, ["path", "target"], "left")
    counts = named.groupBy("class", "role", field.alias("field"), F.coalesce("target_class", F.lit("(missing)")).alias("t")).agg(F.count("*").alias("n"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat_ws(" ", x["t"], x["n"].cast("string"))), ", ")
    return counts.groupBy("class", "role", "field").agg(F.sum("n").alias("n"), words.alias("targets"))


def classify_binding(key: Column, value: Column, number: Column, parameters: Column) -> Column:
    """Struct of kind, status, tag, atom and expanded: how a property of an instance binds.

    Keys with `$NAME$` are expanded by the parameters and compared with the value; other values are told by their form.
    """
    expanded = tags.expand_keys(key, parameters)
    keyed, atomic = key.contains("$"), F.coalesce(value.contains("#d"), F.lit(False))
    dotted = F.coalesce(value.rlike(DOTTED) & key.rlike(TAG_KEY), F.lit(False))
    graphic = F.coalesce(value.rlike(NAVIGATION), F.lit(False))
    kind = F.when(keyed, F.when(atomic, "tag-atom").otherwise("tag")).when(graphic, "navigation").when(dotted, "tag-dot-atom").when(number.isNotNull(), F.when(key.rlike("(?i)color"), "color").otherwise("number")).otherwise("text")
    status = F.when(keyed, F.when(expanded.isNull(), "UNRESOLVED").when(expanded.eqNullSafe(value), "RESOLVED").otherwise("INCONSISTENT")).when(~graphic & dotted, "RESOLVED").otherwise("LITERAL")
    split = lambda at: F.when(keyed, F.try_element_at(F.split(value, "#d"), F.lit(at))).when(~graphic & dotted, F.try_element_at(F.split(value, r"\."), F.lit(at)))
    return F.struct(kind.alias("kind"), status.alias("status"), split(1).alias("tag"), split(2).alias("atom"), F.when(keyed, expanded).alias("expanded"))


def tag_index(bindings: DataFrame) -> DataFrame:
    """bindings (tag, atom, instance, template) to one row for each tag with its atoms, instances and templates, sorted."""
    return bindings.where("tag is not null").groupBy("tag").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("atom", "instance", "template")])


def template_report(instances: DataFrame) -> DataFrame:
    """instances (template, instance, keys) to one row for each template: number of instances and all keys."""
    keys = instances.select("template", F.explode("keys").alias("key")).groupBy("template").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    counts = instances.groupBy("template").agg(F.count("*").alias("n_instances"))
    return counts.join(keys, counts["template"].eqNullSafe(keys["template"]), "left").select(counts["template"], "n_instances", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def flatten(roots: DataFrame, children: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every placement of every object below the roots: (path, id, depth, trail, m), m the composed transform.

    roots: path, id, m; children: path, id, child, cm (transform of the child in its parent). An object that would stand
    below itself is left out, so that an end is certain; deeper placements than max_depth too, if it is given.
    """
    ensure_checkpoints(roots.sparkSession)
    below = children.select("path", "id", "child", "cm").checkpoint()
    front = roots.select("path", "id", F.lit(0).alias("depth"), F.array("id").alias("trail"), "m")
    seen = front
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(below, ["path", "id"]).where(~F.array_contains("trail", F.col("child")))
        front = step.select("path", F.col("child").alias("id"), F.lit(depth).alias("depth"), F.array_append("trail", F.col("child")).alias("trail"), numbers.compose(F.col("m"), F.col("cm")).alias("m")).checkpoint()
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def coverage(records: DataFrame, sizes: DataFrame, header: int = 20) -> DataFrame:
    """(path, n_records, record_bytes, gap_bytes, overlap_bytes): how the records tile a file after its header.

    records: path, offset, end; sizes: path, length.
    """
    before = F.coalesce(F.lag("end").over(Window.partitionBy("path").orderBy("offset")), F.lit(header))
    tiled = records.withColumns({"gap": F.greatest(F.col("offset") - before, F.lit(0)), "overlap": F.greatest(before - F.col("offset"), F.lit(0))})
    sums = tiled.groupBy("path").agg(F.count("*").alias("n_records"), F.sum(F.col("end") - F.col("offset")).alias("record_bytes"), F.sum("gap").alias("gap_bytes"), F.sum("overlap").alias("overlap_bytes"), F.max("end").alias("last"))
    return sums.join(sizes, "path").select("path", "n_records", "record_bytes", (F.col("gap_bytes") + F.greatest(F.col("length") - F.col("last"), F.lit(0))).alias("gap_bytes"), "overlap_bytes")


def discrepancies(templates: DataFrame, instantiated: DataFrame, objects: DataFrame, recall: float = 0.35, most: int = 15) -> DataFrame:
    """(path, kind, subject, instances, resolved, percent, pixels): what of a display isn't confirmed by its reference.

    templates (path, name, status, instances): those whose geometry is outside of the file; resolved where `instantiated` (path,
    name) has them. objects (path, id, recall, pixels): the `most` worst below the recall, by recall and id.
    """
    outside = templates.where("status = 'EXTERNAL_UNRESOLVED'").join(instantiated.select("path", "name", F.lit(True).alias("held")).distinct(), ["path", "name"], "left")
    missing = outside.select("path", F.lit("TEMPLATE_OUTSIDE").alias("kind"), F.col("name").cast("string").alias("subject"), F.col("instances").cast("long").alias("instances"), F.coalesce("held", F.lit(False)).alias("resolved"), F.lit(None).cast("long").alias("percent"), F.lit(None).cast("long").alias("pixels"))
    worst = objects.where(F.col("recall") < recall).withColumn("__place", F.row_number().over(Window.partitionBy("path").orderBy("recall", "id"))).where(F.col("__place") <= most)
    low = worst.select("path", F.lit("LOW_RECALL").alias("kind"), F.col("id").cast("string").alias("subject"), F.lit(None).cast("long").alias("instances"), F.lit(False).alias("resolved"), F.round(F.col("recall") * 100).cast("long").alias("percent"), F.col("pixels").cast("long").alias("pixels"))
    return missing.union(low)


def audited(df: DataFrame, name: str = "created_at") -> DataFrame:
    """df with the time of the query, ISO 8601 in UTC with milliseconds; the same for all rows, and no part of any digest."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return df.withColumn(name, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
