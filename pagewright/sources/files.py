"""Readers and writers of report tables: JSON lines, nested contents, CSV of unknown encoding, summaries, resumable output."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..operators.ordering import running_sum
from ..storage import written
from .staged import StagedTable

PAGES = "doc string, year string, doc_type string, page int, chars int, text string"
MANIFEST = "year string, doc_type string, date string, title_cn string, url string, file string"
# Encodings to try, in order; what a PDF file begins with and has at least.
ENCODINGS = ("utf-8", "gb18030")
PDF_MAGIC = b"%PDF"
LEAST_BYTES = 1024
BOM = "\ufeff"
#: Rows that an export for readers may have: it is one file, written by the driver.
EXPORT_ROWS = 100_000


def read_json_lines(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, null fields included."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """doc, pos, level, title, page of a JSON object of document -> bookmarks."""
    kind = "map<string,array<struct<level:int,title:string,page:int>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("doc", "marks"))
    return rows.select("doc", F.posexplode("marks").alias("pos", "mark")).select("doc", "pos", "mark.*")


def _parts(batches):
    """The batches in slices of bounded bytes."""
    for batch in batches:
        for a, b in slices(*batch.columns):
            yield batch.slice(a, b - a)


def _parsed(names: list[str], encoding: str):
    """Records (their lines, in order) as cells; cells that a record lacks are null, empty ones as well."""

    def run(batches):
        csv.field_size_limit((1 << 31) - 1)  # 131,072 characters by default
        for part in _parts(batches):
            texts = ("\n".join(p.decode(encoding).removeprefix(BOM) for p in r) for r in part.column(0).to_pylist())
            rows = (next(csv.reader(io.StringIO(t, newline="")), []) for t in texts)
            rows = [(r + [None] * len(names))[: len(names)] for r in rows if r]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] or None for r in rows], pa.string()) for i in range(len(names))], names)

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files: file, number (from 0 in each file), lines (binary, in order).

    Files are read in ranges, as lines of bytes: a line end, quote or comma is no part of a longer character in UTF-8 nor in GB
    18030.  Whether a line begins a record follows from the quotes before it: a running sum over ranges of lines, in which a
    range needs of those before it their number of quotes alone.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("value"),
    )
    lines = written(lines.withColumn("quotes", F.length("value") - F.length(F.translate(F.decode("value", "ISO-8859-1"), '"', ""))))
    order = ["block", "line"]
    narrow = running_sum(lines.select("file", *order, "quotes"), ["file"], order, "quotes", "upto")
    starts = narrow.withColumn("starts", ((F.col("upto") - F.col("quotes")) % 2 == 0).cast("int"))
    number = running_sum(starts.select("file", *order, "starts"), ["file"], order, "starts", "number").select("file", *order, "number")
    whole = lines.join(number, ["file", *order])
    return whole.groupBy("file", (F.col("number") - 1).alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]).alias("lines"))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """CSV files with a header each (the same), quoted line ends and a possible byte order mark, as strings in the order of the
    files; and the encoding that fits their bytes."""
    records = csv_records(spark, path)
    records = written(records)
    utf8 = records.select(F.every(F.forall("lines", lambda x: F.is_valid_utf8(x.cast("string")))).alias("ok")).first().ok is not False
    encoding = ENCODINGS[0] if utf8 else ENCODINGS[1]
    head = records.where("number = 0").select("lines").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader(io.StringIO("\n".join(bytes(x).decode(encoding) for x in head.lines).removeprefix(BOM), newline="")))
    return records.where("number > 0").orderBy("file", "number").select("lines").mapInArrow(_parsed(names, encoding), ", ".join(f"`{n}` string" for n in names)), encoding


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=True, escape='"')


def _encoded(names: list[str], encoding: str):
    """The rows as CSV in an encoding, a header before those of each task."""

    def run(batches):
        def lines(rows):
            for r in rows:
                out = io.StringIO(newline="")
                csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(["" if x is None else x for x in r])
                yield out.getvalue().encode(encoding)

        yield pa.RecordBatch.from_arrays([pa.array(lines([names]), pa.binary())], ["value"])
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(lines(zip(*(c.to_pylist() for c in part.columns))), pa.binary())], ["value"])

    return run


def write_csv_as(df: DataFrame, path: str, encoding: str) -> None:
    """CSV files in an encoding that Spark does not write, each with a header; all columns as text."""
    text = df.select(*(F.col(c).cast("string") for c in df.columns))
    rows = text.mapInArrow(_encoded(df.columns, encoding), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)  # the bytes as they are


def _exported(df: DataFrame) -> list:
    rows = df.limit(EXPORT_ROWS + 1).collect()
    if len(rows) > EXPORT_ROWS:
        raise ValueError(f"an export has at most {EXPORT_ROWS} rows; write larger tables with write_csv or write_json_lines")
    return rows


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One UTF-8 file on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def export_csv(df: DataFrame, path: str) -> None:
    """A CSV for spreadsheets: one file with a byte order mark."""
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(["" if x is None else x for x in r] for r in _exported(df))
    write_file(df.sparkSession, path, BOM + out.getvalue())


def export_markdown(df: DataFrame, path: str, title: str) -> None:
    """A summary as a Markdown table."""
    cell = lambda x: "—" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *_exported(df)]
    write_file(df.sparkSession, path, f"# {title}\n\n" + "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in rows) + "\n")


def export_json(df: DataFrame, path: str, *by: str) -> None:
    """A summary as one JSON object, nested by the values of columns; values that are no numbers become null."""
    out: dict = {}
    for r in _exported(df):
        row = {k: None if isinstance(v, float) and v != v else v for k, v in r.asDict(recursive=True).items()}
        at = out
        for c in by[:-1]:
            at = at.setdefault(str(row.pop(c)), {})
        at[str(row.pop(by[-1]))] = row
    write_file(df.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=2))


def stock_ids(replies: DataFrame, codes: DataFrame) -> DataFrame:
    """code, stock_id: the first entry of stored search replies (column `reply`: JSON, or JSON within a call of a function) for each
    code, leading zeros aside; codes that no reply has are left out.  codes: code."""
    inner = F.regexp_extract("reply", r"(?s)\((\{.*\})\)", 1)
    kind = "array<struct<code:string,stockId:string>>"
    body = F.when(inner != "", inner).otherwise(F.col("reply"))
    rows = replies.select(F.monotonically_increasing_id().alias("r"), F.posexplode(F.from_json(F.get_json_object(body, "$.stockInfo"), kind)).alias("at", "x"))
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    found = rows.groupBy(bare(F.col("x.code")).alias("bare")).agg(F.min_by("x.stockId", F.struct("r", "at")).alias("stock_id"))
    return codes.join(found, bare(codes["code"]) == found["bare"]).select("code", "stock_id")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and whether it is a whole PDF file, of binary files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", ((F.col("length") > LEAST_BYTES) & (F.substring("content", 1, 4) == F.lit(PDF_MAGIC))).alias("valid"))


def missing(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What a resumed run has left to do, by key and not by position."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def resumed(wanted: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], parts: int = 1) -> DataFrame:
    """A table of computed rows at a path, filled part by part (rows by a hash of their key) with what it lacks: a run that was
    stopped goes on where it ended.  Each part is committed as a whole (see `staged`), so that no row is lost or twice there."""
    table = StagedTable(wanted.sparkSession, path)
    made = uuid.uuid4().hex
    for i in range(parts):
        some = wanted.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        if (done := table.read()) is not None:
            some = missing(some, done, key)
        table.commit(compute(some), f"{made}-{i}")
    return table.read()
