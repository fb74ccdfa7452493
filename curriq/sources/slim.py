"""Canonical JSON, slim provenance and the progression part of a delivery file.

Canonical JSON has its keys in order of code points, no spaces, characters as they are, and numbers as Python writes
them. A slim record is the original one without some nested fields, and with the hash of the whole one's canonical bytes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curriq.sources.packages import _store
from curriq.sources.wire import strict_object

#: Fields that slim records lack, and the field of their hash.
ENTITY_REMOVED, ENTITY_HASH = ("candidate_source_refs",), "original_item_sha256"
COMPONENT_REMOVED, COMPONENT_HASH = (), "original_component_sha256"
LP_REMOVED, LP_HASH = ("claim.candidate.admissible_decisions", "claim.candidate.evidence", "claim.provenance.producer_judgment"), "original_entry_sha256"


def canonical(value) -> str:
    return json.dumps(value, allow_nan=False, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def slim_record(text: str, removed: tuple[str, ...], hash_field: str) -> str:
    """One record's slim form; an error if it is no strict JSON object, or a removed field stands in what is no object."""
    record = strict_object(text)
    digest = hashlib.sha256(canonical(record).encode()).hexdigest()
    for path in removed:
        *outer, name = path.split(".")
        at = record
        for step in outer:
            at = at.get(step)
            if not isinstance(at, dict):
                raise ValueError(f"no object at {step} of {path}")
        at.pop(name, None)
    return canonical(record | {hash_field: f"sha256:{digest}"})


@F.pandas_udf(T.StringType())
def canonical_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else canonical(json.loads(t)))


def slim_records(records: DataFrame, key: str, value: str, removed: tuple[str, ...], hash_field: str) -> DataFrame:
    """(key, slim) of records whose JSON text is `value`; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: None if t is None else slim_record(t, removed, hash_field))

    return records.select(key, run(value).alias("slim"))


def document_entries(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(document, key, value, rest): the entries of one object of each JSON document, as canonical text, and what else the
    document has. A document is read by one task; its entries are dealt to all for what follows."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document = strict_object(text)
                own = document.pop(field, None)
                if not isinstance(own, dict) or not all(isinstance(v, dict) for v in own.values()):
                    raise ValueError(f"{field} of {name} isn't an object of objects")
                rest, keys = canonical(document), list(own)
                for k in range(0, len(keys), 1000):
                    some = keys[k : k + 1000]
                    yield pa.RecordBatch.from_pydict({"document": [name] * len(some), "key": some, "value": [canonical(own[x]) for x in some], "rest": [rest] * len(some)})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document"), "value")
    return files.mapInArrow(entries, "document string, key string, value string, rest string").repartition("document", F.pmod(F.xxhash64("key"), F.lit(64)))


def slim_entities(spark: SparkSession, path: str) -> DataFrame:
    """(document, key, slim) of the items of entity provenance."""
    return slim_records(document_entries(spark, path, "items").withColumn("id", F.struct("document", "key")), "id", "value", ENTITY_REMOVED, ENTITY_HASH).select("id.document", "id.key", "slim")


def slim_components(spark: SparkSession, path: str) -> DataFrame:
    """(document, key, slim) of the components of component provenance, whose documents have to name their source."""
    rows = document_entries(spark, path, "learning_components")
    named = F.get_json_object("rest", "$.doc_key").isNotNull() & F.get_json_object("rest", "$.pdf_name").isNotNull()
    checked = rows.withColumn("value", F.when(named, F.col("value")).otherwise(F.raise_error(F.concat(F.col("document"), F.lit(" lacks doc_key or pdf_name")))))
    return slim_records(checked.withColumn("id", F.struct("document", "key")), "id", "value", COMPONENT_REMOVED, COMPONENT_HASH).select("id.document", "id.key", "slim")


# ---- Progression lines -----------------------------------------------------------------------------------------

EDGE_FIELDS = {
    "attribution_statement": "attributionStatement", "author": "author", "description": "description", "license": "license", "provider": "provider", "relationship_type": "relationshipType", "source_entity": "sourceEntity", "source_entity_key": "sourceEntityKey",
    "source_entity_value": "sourceEntityValue", "target_entity": "targetEntity", "target_entity_key": "targetEntityKey", "target_entity_value": "targetEntityValue",
}


def _python_escapes(text: Column) -> Column:
    """JSON text of to_json with the few escapes (of other control characters) that it writes in capitals as Python does."""
    for code in ("0B", "0E", "0F", *(f"1{x}" for x in "ABCDEF")):
        # an even number of backslashes before it: it isn't an escaped backslash and a u
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return text


def wire_lines(edges: DataFrame) -> DataFrame:
    """(label, edge_id, value): progression edges (edge_id, label, source, target, source_labels, target_labels and the columns of
    EDGE_FIELDS) as canonical wire lines; null fields are left out.

    All values are strings and the fields stand in order, so to_json's text is canonical but for the case of rare escapes.
    """
    held = {name: F.col(c).cast("string") for c, name in EDGE_FIELDS.items() if c in edges.columns} | {"identifier": F.col("edge_id")}
    bag = F.struct(*[held[name].alias(name) for name in sorted(held)])
    envelope = F.struct(F.col("edge_id").alias("identifier"), "label", bag.alias("properties"), F.col("source").alias("source_identifier"), "source_labels", F.col("target").alias("target_identifier"), "target_labels", F.lit("relationship").alias("type"))
    text = F.transform(F.array(F.to_json(envelope)), lambda t: F.when(F.contains(t, F.lit("\\u00")), _python_escapes(t)).otherwise(t))[0]
    return edges.select("label", "edge_id", text.alias("value"))


def write_delivery_file(prefix: str, edges: DataFrame, target: str) -> int:
    """One delivery file: the bytes of the file `prefix` as they are, a line end if they lack one, then the edges' canonical
    lines by (label, edge_id). Returns the offset at which these begin.

    Lines are sorted and written by Spark in parts, whose names follow their order; the parts are then copied one after
    another, through Hadoop's file system and in constant memory, into a file that is moved to its place when it is whole.
    """
    spark, staged = edges.sparkSession, f"{target}.staged-{uuid.uuid4().hex}"
    order = ["label", "edge_id"]
    wire_lines(edges).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.option("lineSep", "\n").text(f"{staged}-lines")
    store, at = _store(spark, staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = sorted((s.getPath() for s in store.listStatus(_store(spark, f"{staged}-lines")[1]) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    source_store, source = _store(spark, prefix)
    length = source_store.getFileStatus(source).getLen()
    out = store.create(at, False)
    try:
        stream = source_store.open(source)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            if length and parts:
                stream.seek(length - 1)
                if stream.read() != 10:
                    out.write(10)
                    length += 1
        finally:
            stream.close()
        for part in parts:
            stream = store.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    store.delete(_store(spark, f"{staged}-lines")[1], True)
    to = _store(spark, target)[1]
    if store.exists(to) or not store.rename(at, to):
        raise FileExistsError(target)
    return int(length)
