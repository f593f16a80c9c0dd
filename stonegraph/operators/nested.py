"""Deeply nested XML records, flattened to related tables in one pass.

A depth-first visitor, fed by the parser's events, emits every element once as
a tagged row (table tag, key, parent's tag and key, payload). The tagged rows
can be written partitioned by tag; each table's schema is applied when it is
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonegraph.session import BitTable, checkpointed, shared_folder

ELEMENTS = ("origPlace", "placeName", "rdg", "persName")
ENCLOSING = ("app", "provenance")

TAGGED = "record string, element string, element_no int, parent_element string, parent_no int, depth int, attributes map<string,string>, text string"
_SCHEMA = pa.schema([("record", pa.string()), ("element", pa.string()), ("element_no", pa.int32()), ("parent_element", pa.string()), ("parent_no", pa.int32()), ("depth", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


class Visitor:
    """Rows for the elements named in ``emit``, each tied to the nearest enclosing one of ``emit`` and ``enclose``; elements are known by local name and numbered by name from 1."""

    def __init__(self, emit: Iterable[str], enclose: Iterable[str], payload: bool):
        self.emit, self.named, self.payload = frozenset(emit), frozenset(emit) | frozenset(enclose), payload
        self.counts: Counter = Counter()
        self.path: list[tuple[str, int]] = []
        self.depth, self.rows, self.open, self.texts = 0, [], [], []

    def start(self, name: str, attributes: dict) -> None:
        local = name.rpartition("}")[2]
        self.depth += 1
        if local in self.named:
            self.counts[local] += 1
            parent = self.path[-1] if self.path else ("", 0)
            self.path.append((local, self.counts[local]))
            if local in self.emit:
                row = [local, self.counts[local], *parent, self.depth, None, None]
                self.rows.append(row)
                if self.payload:
                    row[5] = [(k.rpartition("}")[2], v) for k, v in attributes.items()]
                    self.open.append((row, len(self.texts)))

    def end(self, name: str) -> None:
        local = name.rpartition("}")[2]
        self.depth -= 1
        if local in self.named:
            self.path.pop()
            if self.payload and local in self.emit:
                row, at = self.open.pop()
                row[6] = " ".join("".join(self.texts[at:]).split())
                if not self.open:
                    self.texts.clear()

    def data(self, text: str) -> None:
        if self.open:
            self.texts.append(text)


def visit(content: str | None, emit: Iterable[str] = ELEMENTS, enclose: Iterable[str] = ENCLOSING, payload: bool = True) -> list[list] | None:
    """[element, element_no, parent_element, parent_no, depth, attributes, text] of each element, in document order; None if the text is missing or not well-formed.

    No external entity is ever fetched. Attributes that differ in their
    namespace only keep the last value.
    """
    if content is None:
        return None
    v = Visitor(emit, enclose, payload)
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler = v.start, v.end
    if payload:
        parser.CharacterDataHandler = v.data
        parser.buffer_text = True
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError):
        return None
    return v.rows


def _flatten(emit: tuple, enclose: tuple, payload: bool, rows_a_batch: int = 5000):
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def batch():
            cols = list(zip(*out))
            cols[6] = [None if a is None else list(dict(a).items()) for a in cols[6]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            for record, content in zip(b.column(0).to_pylist(), b.column(1)):
                out += [(record, *row) for row in visit(content.as_py(), emit, enclose, payload) or ()]
                if len(out) >= rows_a_batch:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return flatten


def _copies_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition the first row of each (record, at, h), so that copies of a hot key don't travel."""
    seen: set = set()
    for b in batches:
        keep = []
        for n, key in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
            if key not in seen:
                seen.add(key)
                keep.append(n)
        if keep:
            yield b.take(pa.array(keep))


def latest(records: DataFrame, *, key: str, content: str, at: str) -> DataFrame:
    """(record, content): of each key the row with the greatest ``at``.

    A null ``at`` is least; of ties a row with content comes before one
    without, then the greater content hash. Rows with a null key are left out.
    First the keys with several rows are found, without their contents, when
    the function is called; only those rows are shuffled to settle which wins,
    and copies of a row before that only once from each task. All others stay
    where they are read.
    """
    src = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.col(content).cast("string").alias("content")).withColumn("_k", F.xxhash64("record"))
    several = checkpointed(src.groupBy("_k").count().where("count > 1").select("_k"))
    sieve = BitTable(several, "_k", several.count())
    alone = sieve.strange(src, "_k").where("content is not null").select("record", "content")
    rivals = sieve.held(src, "_k").select("record", "at", F.when(F.col("content").isNotNull(), F.xxhash64("content")).alias("h"), "content")
    rivals = rivals.mapInArrow(_copies_once, "record string, at bigint, h bigint, content string")
    best = rivals.groupBy("record").agg(F.max(F.struct("at", "h")).alias("v")).select("record", "v.at", "v.h")
    on = ["record", "at", "h"]  # a winner without content has no h, meets nothing and gives no rows
    won = rivals.join(best.where("h is not null"), on).dropDuplicates(on).select("record", "content")
    return alone.unionByName(won)


def flatten_records(records: DataFrame, *, key: str, content: str, at: str | None = None, emit: Iterable[str] = ELEMENTS, enclose: Iterable[str] = ENCLOSING, payload: bool = True) -> DataFrame:
    """Tagged rows (see ``TAGGED``) of every element of ``emit`` in the XML texts of ``content``.

    Each row names its record, its element and number, and the nearest
    enclosing element of ``emit`` or ``enclose`` with its number ('' and 0 if
    there is none). With ``at``, only the row of each key fetched last counts
    (see ``latest``). Null, empty and ill-formed texts give no rows, nor does a
    null key; an empty table gives none; extra columns are ignored. Without
    ``payload`` attributes and text are null. Text is all text in the element
    with runs of blanks made one.
    """
    src = latest(records, key=key, content=content, at=at) if at else records.select(F.col(key).cast("string").alias("record"), F.col(content).cast("string").alias("content")).where("record is not null and content is not null")
    return src.mapInArrow(_flatten(tuple(emit), tuple(enclose), payload), TAGGED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Writes tagged rows to ``path``, one folder for each tag."""
    tagged.write.partitionBy("element").mode("overwrite").parquet(path)


#: The columns of each table, taken from the tagged rows' payload.
TABLES = {
    "origPlace": {"corresp": "string"},
    "placeName": {"type": "string"},
    "rdg": {"source": "string", "resp": "string"},
    "persName": {"lang": "string"},
}


def read_tables(spark: SparkSession, path: str, tables: dict[str, dict[str, str]] = TABLES) -> dict[str, DataFrame]:
    """The tables written by ``write_tables``: keys, parent's keys, text, and the attributes of each table's schema. A tag of which nothing was written gives an empty table."""
    tagged = spark.read.schema(TAGGED).parquet(path)
    keys = ["record", F.col("element_no"), "parent_element", "parent_no", "text"]
    return {tag: tagged.where(F.col("element") == tag).select(*keys, *(F.col("attributes")[a].cast(t).alias(a) for a, t in schema.items())) for tag, schema in tables.items()}


def nested_tables(records: DataFrame, *, key: str, content: str, at: str | None = None, tables: dict[str, dict[str, str]] = TABLES, enclose: Iterable[str] = ENCLOSING) -> dict[str, DataFrame]:
    """A table for each tag of ``tables``: the records' elements, flattened in one pass, written partitioned by tag under the shared checkpoint folder when this is called, and read back with their schemas."""
    folder = shared_folder(records.sparkSession, "nested")
    write_tables(flatten_records(records, key=key, content=content, at=at, emit=tables, enclose=enclose), folder)
    return read_tables(records.sparkSession, folder, tables)


def nested_elements(editions: DataFrame) -> DataFrame:
    """(ogham_id, element, element_no, parent_element, parent_no) of the latest record of each stone, from the tables of all four elements."""
    found = None
    for tag, rows in nested_tables(editions, key="ogham_id", content="content", at="fetched").items():
        keys = rows.select(F.col("record").alias("ogham_id"), F.lit(tag).alias("element"), "element_no", "parent_element", "parent_no")
        found = keys if found is None else found.unionByName(keys)
    return found
