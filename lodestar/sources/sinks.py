"""Writers; Spark's commit protocol makes each output appear whole or not at all."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str):
    """A CSV cell: null is empty, lists and structs are JSON, the rest is text."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    text = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
    return F.coalesce(text, F.lit("")).alias(name)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header in the given order (first seen by default; sorted names make equal content equal files)."""
    names = list(columns or df.columns)
    df.select(*[cell(df, n) for n in names]).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_csv_with_preamble(df: DataFrame, path: str, metadata: Mapping[str, object]) -> None:
    """CSV files that each begin with `# key: value` lines and a header, for `csv_with_preamble`; cells as in write_csv, on one line."""
    import csv
    import io

    names = list(df.columns)
    head = "".join(f"# {k}: {' '.join(str(v).split())}\n" for k, v in metadata.items())

    def line(values: Sequence[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(values)
        return out.getvalue()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head + line(names)]})
        for f in frames:
            yield pd.DataFrame({"value": [line(r) for r in f.itertuples(index=False)]})

    flat = df.select(*[F.regexp_replace(cell(df, n), r"[\r\n]+", " ").alias(n) for n in names])
    flat.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text per line."""
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def content_chunks(df: DataFrame, source: str, order: Sequence[str], most: int) -> DataFrame:
    """(source, chunk, sha256, rows, csv): each source's rows in order as CSV texts of at most `most` characters.

    The name of a chunk is the hash of its content, so the same rows give the same chunks. Columns are in sorted order; a row
    above the limit is a chunk of its own. Each partition writes its sources in one pass and holds one chunk.
    """
    import csv
    import hashlib
    import io

    names = sorted(c for c in df.columns if c != source)
    d = df.select(F.col(source).cast("string").alias("_source"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[cell(df, n) for n in names])
    s = d.repartition("_source").sortWithinPartitions("_source", *[f"_o{i}" for i in range(len(order))]).select("_source", *names)

    def line(values: Sequence[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(values)
        return out.getvalue()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = line(names)
        now, chunk, buf, size = None, 0, [], len(head)

        def full() -> tuple:
            text = head + "".join(buf)
            return (now, chunk, hashlib.sha256(text.encode()).hexdigest(), len(buf), text)

        cols = ["source", "chunk", "sha256", "n", "csv"]
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                src, text = row[0], line(row[1:])
                if buf and (src != now or size + len(text) > most):
                    out.append(full())
                    chunk = 0 if src != now else chunk + 1
                    buf, size = [], len(head)
                now = src
                buf.append(text)
                size += len(text)
            yield pd.DataFrame(out, columns=cols)
        if buf:
            yield pd.DataFrame([full()], columns=cols)

    return s.mapInPandas(run, "source string, chunk int, sha256 string, n int, csv string")


def merge_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    """The chunks of several snapshots, equal content once."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.dropDuplicates(["sha256"])
