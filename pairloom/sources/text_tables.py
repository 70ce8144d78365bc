"""Sources (S1-S5): tolerant TSV scan, CSV with header, guarded scans,
JSON log documents and many-file reads.  Explicit schemas everywhere:
inference costs a pass over the data."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from pairloom.operators.logs import LOG_DOC

# The raw edit corpus layout (tab separated, no header).
RAW_COLUMNS = ["id", "src_tok", "tgt_tok", "src_raw", "tgt_raw", "pos", "parse"]
LINE_BREAK = r"\r\n|\n|\r"


def parse_tsv_lines(lines: DataFrame, value: str = "value", columns: Sequence[str] = RAW_COLUMNS,
                    na_values: Sequence[str] = ()) -> DataFrame:
    """Split each line on tabs with quotes as ordinary characters;
    blank lines (empty or spaces only) are skipped, lines with too many fields are dropped and
    short lines are padded with nulls; fields equal to one of
    ``na_values`` become null.  (Spark's CSV reader cannot do this: its
    DROPMALFORMED mode also drops short lines and PERMISSIVE keeps
    over-wide ones, truncated.)"""
    n = len(columns)
    f = lines.where(~F.col(value).rlike("^ *$")).select(F.split(F.col(value), "\t", -1).alias("_f"))
    f = f.where(F.size("_f") <= n)
    cols = []
    for i, c in enumerate(columns):
        v = F.get(F.col("_f"), i)
        if na_values:
            v = F.when(v.isin(*na_values), F.lit(None).cast("string")).otherwise(v)
        cols.append(v.alias(c))
    return f.select(*cols)


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS,
             na_values: Sequence[str] = ()) -> DataFrame:
    """S1 over files: a line-splittable text scan, parsed in the JVM."""
    return parse_tsv_lines(spark.read.text(path), "value", columns, na_values)


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """The lines of a text column as a ``value`` column (S1 input)."""
    return df.select(F.explode(F.split(F.col(text), LINE_BREAK, -1)).alias("value"))


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with header, columns bound by header name: other columns are
    left out, a column that the file lacks is null.  Quoted fields may hold
    quotes, commas and newlines.  multiLine files are not splittable: keep parquet between
    stages and CSV only at the exchange boundary."""
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    found = set(raw.columns)
    return raw.select(*[
        (F.col(f"`{f.name}`") if f.name in found else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def guarded_read_pairs(spark: SparkSession, path: str, schema: T.StructType,
                       required: Sequence[str] = ("src_raw", "tgt_raw")) -> tuple[DataFrame | None, str]:
    """S3: (table, message).  A missing file or missing required columns
    give (None, reason) instead of an error; the header is read without a
    data pass."""
    if not path_exists(spark, path):
        return None, f"{path} not found, left out"
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:  # unreadable
        return None, f"{path} is unreadable, left out: {e}"
    missing = [c for c in required if c not in header]
    if missing:
        return None, f"{path} lacks {', '.join(missing)}, left out"
    return read_csv(spark, path, schema), "ok"


def read_log_json(spark: SparkSession, path: str) -> tuple[DataFrame | None, str]:
    """One JSON log document per file; distinct messages for a
    missing file, a file that is not JSON and an empty log history.  The id
    of a document is its file.  PERMISSIVE, so that a file that is not JSON
    is told by its row and not by a failed job."""
    if not path_exists(spark, path):
        return None, f"training log not found at {path}"
    schema = T.StructType(LOG_DOC.fields + [T.StructField("_corrupt", T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    probe = df.select(
        F.max(F.col("_corrupt").isNotNull().cast("int")).alias("bad"),
        F.max(F.coalesce(F.size("log_history"), F.lit(0))).alias("n"),
    ).first()
    if probe is None or probe["bad"] == 1:
        return None, f"training log at {path} is not valid JSON"
    if not probe["n"]:
        return None, f"training log at {path} has no entries"
    return df.drop("_corrupt").withColumn("doc_id", F.input_file_name()), "ok"


# ---- many files in one scan (S5, S4) -------------------------------------------

def _files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(path, uri, bytes) of a file, or of a folder's data files; none if absent."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = fs.listStatus(p)
    out = [(f.getPath(), f.getLen(), f.isFile()) for f in found]
    return sorted((q.toString(), q.toUri().toString(), size) for q, size, file in out if file and not q.getName().startswith(("_", ".")))


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The first line of a file, opened through Hadoop, as CSV fields."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").removeprefix("\ufeff")], quotechar='"', doublequote=True), []))


def _uri(uri: str) -> str:
    """A local file's uri is written with one slash or with three."""
    return re.sub("^file:/+", "file:/", uri)


def _row_uri() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def _tag(uris: dict[str, str]) -> Column:
    """The name under which a row's file was asked for, of a few names."""
    return F.element_at(F.create_map(*[F.lit(x) for uri, name in uris.items() for x in (_uri(uri), name)]), _row_uri())


def read_splits(spark: SparkSession, base_dir: str, names: dict[str, str], schema: T.StructType,
                required: Sequence[str] = ()) -> DataFrame:
    """Several CSV files (or folders of parts) as one table, tagged with
    their split name; the caller leaves out test.  Files with one header are
    one scan, whatever their number: the tag comes from each row's
    ``_metadata.file_path``.  Columns are bound by header name; columns that a
    file lacks are null.  Files that are absent, empty or lack a ``required``
    column are left out; ``split_status`` says which."""
    layouts: dict[tuple, list] = {}
    for split, status, header, files in _layouts(spark, base_dir, names, required):
        if status == "ok":
            layouts.setdefault(header, []).extend((path, uri, split) for path, uri in files)
    out = None
    for header, files in layouts.items():
        raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        raw = raw.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv([path for path, _, _ in files])
        df = raw.select(*[
            (F.col(f"`{f.name}`") if f.name in header else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ], _tag({uri: split for _, uri, split in files}).alias("split"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("split", T.StringType())]))
    return out


def _layouts(spark: SparkSession, base_dir: str, names: dict[str, str], required: Sequence[str]):
    """(split, status, header, files) of every name, from the listing and the headers alone."""
    for split, name in names.items():
        files = _files(spark, f"{base_dir.rstrip('/')}/{name}")
        full = [(path, uri) for path, uri, size in files if size]
        header = _header(spark, full[0][0]) if full else ()
        missing = [c for c in required if c not in header]
        status = "missing" if not files else "empty" if not full else f"lacks {', '.join(missing)}" if missing else "ok"
        yield split, status, header, full


def split_status(spark: SparkSession, base_dir: str, names: dict[str, str], required: Sequence[str] = ("src_raw", "tgt_raw")) -> dict[str, str]:
    """S3 for several files: missing, empty, lacks ..., or ok, by split name."""
    return {split: status for split, status, _, _ in _layouts(spark, base_dir, names, required)}


def read_logs(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """S4 over many logs, one scan: (documents, status).  ``files`` is {name:
    path}.  Documents are (name, global_step, log_history) of the logs that
    have entries; status is (name, status, entries) with a row per name:
    missing, corrupt (not JSON), empty (no entries) or ok.  A bad log leaves
    the others alone."""
    found = {name: _files(spark, path) for name, path in files.items()}
    uris = [(_uri(uri), name) for name, parts in found.items() for _, uri, _ in parts]
    schema = T.StructType([*LOG_DOC.fields, T.StructField("_corrupt", T.StringType())])
    named = spark.createDataFrame([(n, bool(f)) for n, f in found.items()], "name string, there boolean")
    if uris:
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        raw = raw.json([path for parts in found.values() for path, _, _ in parts]).withColumn("_uri", _row_uri())
        raw = raw.join(spark.createDataFrame(uris, "_uri string, name string"), "_uri").select("name", "global_step", "log_history", "_corrupt")
    else:
        raw = spark.createDataFrame([], T.StructType([T.StructField("name", T.StringType()), *schema.fields]))
    entries = F.coalesce(F.size("log_history"), F.lit(0))
    read = raw.groupBy("name").agg(F.max(F.col("_corrupt").isNotNull()).alias("bad"), F.sum(entries).alias("n"))
    status = (F.when(~F.col("there"), "missing").when(F.col("bad"), "corrupt").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("ok"))
    told = named.join(read, "name", "left").select("name", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("entries"))
    return raw.where(F.col("_corrupt").isNull() & (entries > 0)).drop("_corrupt"), told
