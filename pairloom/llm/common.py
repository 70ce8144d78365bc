"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.session import ensure_checkpoint_dir

#: a word is a run of characters other than these six
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: rows handled at once inside a task; whole texts, so memory stays near
#: this many texts whatever the Arrow batch size
ROWS_AT_ONCE = 256

#: entries a task keeps in a per-word cache before it starts afresh
CACHE_ENTRIES = 400_000


def slim(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: extra or clashing columns of the input are gone,
    a null text is the empty text."""
    return df.select(df[id_col].cast("long").alias("doc_id"),
                     F.coalesce(df[text_col], F.lit("")).alias("text"))


def map_texts(df: DataFrame, make, schema: str) -> DataFrame:
    """Run ``make()`` once per task; it returns ``fn(ids, texts) -> columns``
    (lists or arrays in the order of ``schema``), called on slices of whole
    rows of the (doc_id, text) table.  No shuffle; a lost task is re-run."""
    spark = df.sparkSession
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                cols = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)],
                    names=names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: cuts lineage, survives lost executors, keeps statistics."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


class WordHashes(dict):
    """64-bit hash of each word (text or UTF-8), computed once per distinct word and task."""

    def __missing__(self, word) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of characters outside the six blanks, as UTF-8: ``bytes.split``
    cuts at exactly these, ``str.split`` would at other Unicode spaces too."""
    return text.encode().split()


def lower_words_of(text: str) -> list[bytes]:
    """The same with A-Z lower-cased (``bytes.lower`` touches no others)."""
    return text.encode().lower().split()
