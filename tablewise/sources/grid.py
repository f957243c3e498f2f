"""Delimited text files as a grid of cells: ``(source_file, sheet, row_no, cells)``."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import text
from tablewise.functions import vocab as V

GRID = "source_file string, sheet string, row_no bigint, cells array<string>"
_CHUNK_ROWS = 10_000
_DELIMITERS = V.DELIMITERS


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``(path, length, content)`` of every file below a folder, or of the files listed."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "content")
    )


def file_hash(content, version: str):
    """Identity of a file under a pipeline version."""
    head = F.concat(F.lit(version).cast("binary"), F.lit(b"\x00"))
    return F.sha2(F.concat(head, content), 256)


def new_files(files: DataFrame, profiled: DataFrame, version: str) -> DataFrame:
    """``(path, length, content_hash)`` of files not profiled yet under this pipeline version.

    The bytes are hashed where they are read and go no further; ``list_files`` of these paths reads the unknown ones.
    """
    light = files.select("path", "length", file_hash(F.col("content"), version).alias("content_hash"))
    return light.join(profiled.select("content_hash").distinct(), "content_hash", "left_anti").select("path", "length", "content_hash")


def decode(content: bytes) -> str | None:
    """Text of a file: UTF-16 only behind its byte-order mark, then UTF-8, then GB18030."""
    marked = content[:2] in (b"\xff\xfe", b"\xfe\xff")
    for name in (("utf-16",) if marked else ()) + ("utf-8-sig", "gb18030"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return None


def delimiter(body: str) -> str:
    """Most frequent delimiter of the first ten non-blank lines; earlier ones win ties."""
    head, pos = [], 0
    while pos < len(body) and len(head) < 10:
        piece = body[pos:pos + 65536]
        lines = piece.splitlines(keepends=True)
        if len(lines) > 1 and pos + len(piece) < len(body):
            piece = piece[:-len(lines.pop())]
        elif pos + len(piece) < len(body):
            lines = body[pos:].splitlines(keepends=True)[:10]
            piece = "".join(lines)
        head += [line.strip() for line in lines if line.strip()]
        pos += len(piece)
    sample = "\n".join(head[:10])
    return max(_DELIMITERS, key=sample.count)


def _unreadable(path: str, content: bytes) -> str | None:
    name = path.lower()
    if not content:
        return "empty file"
    if content.startswith(b"PK\x03\x04") or name.endswith((".xlsx", ".xls")):
        return "workbook container, not delimited text"
    return None if decode(content) is not None else "neither UTF-8 nor GB18030"


def _parse(batches):
    """One file at a time; rows leave in chunks so a large file is never held as rows."""
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            if _unreadable(path, content):
                continue
            body = decode(content)
            start, cells = 0, []
            for record in csv.reader(io.StringIO(body, newline=""), delimiter=delimiter(body)):
                cells.append([c.strip() or None for c in record])
                if len(cells) == _CHUNK_ROWS:
                    yield _frame(path, start, cells)
                    start, cells = start + len(cells), []
            if cells:
                yield _frame(path, start, cells)


def sheet_name(path: str) -> str:
    """File name without its last ending."""
    name = path.rsplit("/", 1)[-1]
    return (name.rsplit(".", 1)[0] if name.rfind(".") > 0 else name) or "sheet1"


def _frame(path, start, cells) -> pd.DataFrame:
    return pd.DataFrame({
        "source_file": path, "sheet": sheet_name(path),
        "row_no": range(start, start + len(cells)), "cells": cells,
    })


def _causes(batches):
    for batch in batches:
        causes = [_unreadable(p, c) for p, c in zip(batch["path"], batch["content"])]
        out = pd.DataFrame({"source_file": batch["path"], "cause": causes})
        yield out[out["cause"].notna()]


def read_grid(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Grid of all delimited files; quoted cells, blank cells null, empty lines kept.

    A file is one task's work; ``splits.read_split_grid`` gives the same grid for files of any size.
    """
    spread = files.repartition(parts, "path") if parts else files.repartition("path")
    return spread.select("path", "content").mapInPandas(_parse, GRID)


def unreadable_files(files: DataFrame) -> DataFrame:
    """Rejected files with the cause."""
    return files.select("path", "content").mapInPandas(_causes, "source_file string, cause string")


def _cell(df: DataFrame, name: str):
    c = text.as_text(df, name)
    return text.null_blank(c) if isinstance(df.schema[name].dataType, T.StringType) else c


def table_rows(df: DataFrame, source_file: str, sheet: str, order: str, columns=None) -> DataFrame:
    """A wide table as rows of text cells; ``order`` is a unique non-negative number."""
    cells = F.array(*[_cell(df, c) for c in columns or df.columns])
    return df.select(
        F.lit(source_file).alias("source_file"), F.lit(sheet).alias("sheet"),
        F.col(order).cast("bigint").alias("row_no"), cells.alias("cells"),
    )


def table_columns(df: DataFrame, source_file: str, sheet: str) -> DataFrame:
    """Header rows ``(source_file, sheet, pos, column)`` of a wide table."""
    names = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(names, "pos int, column string").select(
        F.lit(source_file).alias("source_file"), F.lit(sheet).alias("sheet"), "pos", "column"
    )
