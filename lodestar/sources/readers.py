"""Readers: record files with preambles, wrapped JSON, logs, rule databases."""

from __future__ import annotations

import csv
import io
import json
import sqlite3
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_with_preamble(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """Rows of CSV files that may begin with a byte-order mark, blank lines and `#` lines; all columns are text.

    The header is the first other line, or given. Every file must have the same header; a repeated column name or a row with
    another number of cells fails. Cells don't hold line breaks.
    """
    lines = spark.read.text(path).select("value")
    if header is None:
        first = lines.where(~F.col("value").rlike("^﻿?\\s*(#|$)")).limit(1).collect()
        if not first:
            return spark.createDataFrame([], "value string").drop("value")
        header = next(iter(pd.read_csv(pd.io.common.StringIO(first[0][0].lstrip("﻿")), header=None, dtype=str, keep_default_na=False).itertuples(index=False)))
    if len(set(header)) != len(header):
        raise ValueError(f"repeated column in {list(header)}")
    # Blank and comment lines go by the reader; the header line goes by its text, wherever splits fall.
    own = lines.where(~F.col("value").rlike("^\ufeff?\\s*(#|$)")).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    schema = ", ".join(f"`{h}` string" for h in header)
    rows = own.select(F.from_csv("value", schema, {"mode": "FAILFAST", "escape": "\""}).alias("r"))
    head = rows.where(F.col(f"r.`{header[0]}`").isNull() | (F.col(f"r.`{header[0]}`") != header[0]))
    return head.select("r.*")


def metadata_of(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the `# key: value` lines of files."""
    m = r"^﻿?#\s*([^:]+?)\s*:\s*(.*?)\s*$"
    return spark.read.text(path).where(F.col("value").rlike(m)).select(F.regexp_extract("value", m, 1).alias("key"), F.regexp_extract("value", m, 2).alias("value")).distinct()


def csv_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, row map<string,variant>) of CSV chunks with a header each: cells that are JSON are read as such, others are text.

    line counts from 2, the line after the header; chunks are bounded files, so each is read whole by one task.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, text in zip(f["file"], f["value"], strict=True):
                r = csv.reader(io.StringIO(text.lstrip("\ufeff")))
                head = next(r, None)
                at = r.line_num
                for cells in r:
                    if cells:
                        out.append((name, at + 1, dict(zip(head, cells, strict=True))))
                    at = r.line_num
            yield pd.DataFrame(out, columns=["file", "line", "cells"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    cells = whole.mapInPandas(rows, "file string, line int, cells map<string,string>")
    # A cell is JSON only as a whole: the parser alone would stop after a leading number.
    is_json = lambda v: v.rlike(r'^(null|true|false|-?\d+(\.\d+)?([eE][+-]?\d+)?|".*"|\{.*\}|\[.*\])$')
    return cells.select("file", "line", F.transform_values("cells", lambda _, v: F.coalesce(F.when(is_json(v), F.try_parse_json(v)), F.variant_get(F.parse_json(F.to_json(F.array(v))), "$[0]", "variant"))).alias("row"))


def uploads_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_size, uploaded_size, complete) of an index of uploads, one JSON object with `_Components` per line.

    Entries without components or with a negative or missing size are left out; of paths that differ only in case the first in
    order of spelling is kept.
    """
    raw = spark.read.schema("_Components array<string>, file_size bigint, uploaded_size bigint").json(path)
    ok = raw.where((F.size("_Components") > 0) & (F.col("file_size") >= 0) & (F.col("uploaded_size") >= 0))
    named = ok.select(F.array_join("_Components", "/").alias("path"), "file_size", "uploaded_size")
    first = named.groupBy(F.lower("path").alias("_k")).agg(F.min(F.struct("path", "file_size", "uploaded_size")).alias("r"))
    return first.select("r.*", (F.col("r.file_size") == F.col("r.uploaded_size")).alias("complete"))


def repeated_keys(text: Column) -> Column:
    """Whether a JSON text has an object, at any depth, with a repeated key; null for broken JSON and null."""

    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool | None:
            if t is None:
                return None
            seen = False

            def pairs(p: list[tuple[str, object]]) -> dict:
                nonlocal seen
                seen = seen or len({k for k, _ in p}) < len(p)
                return dict(p)

            try:
                json.loads(t, object_pairs_hook=pairs)
            except ValueError:
                return None
            return seen

        return s.map(one)

    return check(text)


def json_rows(spark: SparkSession, path: str, wrappers: Sequence[str] = ("rows", "items", "results", "data")) -> DataFrame:
    """(value variant) of every row of JSON files: a list, an object that wraps one, or one object per line.

    A file of several lines whose first is whole JSON is line-wise, any other is one document; lines that are no JSON are left to
    `broken_lines`.
    """
    texts = spark.read.text(path, wholetext=True).select("value", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    by_line = (F.size("lines") > 1) & F.try_parse_json(F.try_element_at("lines", F.lit(1))).isNotNull()
    whole = texts.select(F.when(~by_line, F.try_parse_json("value")).alias("v"), "lines")
    listed = F.coalesce(*[F.try_variant_get("v", f"$.{w}", "array<variant>") for w in wrappers], F.try_variant_get("v", "$", "array<variant>"), F.when(F.col("v").isNotNull(), F.array("v")))
    lines = F.filter(F.transform("lines", lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    return whole.select(F.explode(F.coalesce(listed, lines)).alias("value"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of line-wise JSON files that are neither blank nor JSON."""
    return spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def log_lines(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """(stamp, level, op, message, *keys) of lines `STAMP LEVEL [op] message | k=v …`; other lines are left out."""
    from lodestar.operators.fleet import log_fields

    m = r"^(\S+)\s+([A-Z]+)\s+\[([^\]]+)\]\s+([^|]*?)\s*(?:\|\s*(.*))?$"
    parts = [F.regexp_extract("value", m, i).alias(n) for i, n in enumerate(("stamp", "level", "op", "message"), 1)]
    return spark.read.text(path).where(F.col("value").rlike(m)).select(*parts, *log_fields(F.regexp_extract("value", m, 5), keys))


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a rule database, read on the driver: rule databases are files of reviewed rules, not of evidence."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if not db.execute("select 1 from sqlite_master where type = 'table' and name = ?", (table,)).fetchone():
            raise ValueError(f"no table {table}")
        pdf = pd.read_sql_query(f'select * from "{table}"', db)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).map(lambda x: None if x is None else str(x)), ", ".join(f"`{c}` string" for c in pdf.columns))

