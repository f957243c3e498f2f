"""Delimited files of any size as a grid: splits are read side by side, quotes decide where rows end.

Spark's text source cuts files at line feeds and hands out the raw bytes between them. Whether a
line feed ends a row depends on the quotes before it, back to the start of the file. So every split
is first read under both beliefs, "outside" and "inside" a quoted cell, and says for each delimiter
in which state it ends and how many rows end in it. Composing these small maps over the splits of a
file gives the state and the row number each split starts with; so are encoding and delimiter
settled for a whole file. The second reading then builds rows where they end. Only rows that
cross splits are put together by a shuffle, of the pieces of these rows alone.

UTF-16 takes a reading of its own, as a byte 0x0A may be half of another sign: the maps are made
again for these files, from whole units. Splits are cut the same in every reading, because a session
of their own fixes their size.
"""

from __future__ import annotations

import csv
import io
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions import vocab as V
from tablewise.sources.grid import GRID, delimiter, sheet_name

SPLIT_BYTES = 32 << 20
_DELIMITERS = [ord(d) for d in V.DELIMITERS]
_QUOTE, _FEED, _RETURN = 0x22, 0x0A, 0x0D
_MARK = b"\xef\xbb\xbf"  # of UTF-8; Spark's reader drops it
_MARKS = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_HEAD_LINES = 10


def _session(spark: SparkSession, split_bytes: int) -> SparkSession:
    own = spark.newSession()
    for name, value in (("maxPartitionBytes", split_bytes), ("openCostInBytes", 0), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    return own


def list_splittable(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, length, address)`` of every file below a folder; no content is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
            .select("path", "length", F.col("_metadata.file_path").alias("address")))


def _pieces(own: SparkSession, path: str, pattern: str, only: list[str] | None = None) -> DataFrame:
    """``(file, start, value)``: bytes up to the next line feed, in order within a split; other files are not opened."""
    lines = own.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    address = F.col("_metadata.file_path")
    return (lines if only is None else lines.filter(address.isin(only))).select(
        F.xxhash64(address).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _runs(batches):
    """``(file, start, bytes)`` of consecutive pieces of one split, each with its line feed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        values = batch.column(2)
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
            yield int(file[low]), int(start[low]), b"\n".join(values.slice(low, high - low).to_pylist()) + b"\n"


# --- what is known of a file and of its splits ----------------------------------

@dataclass
class Split:
    """How to read one split."""

    encoding: str = "utf-8-sig"
    delimiter: int = 0
    inside: bool = False  # starts in a quoted cell
    open: bool = False  # starts in the middle of a row
    row: int = 0  # rows that end before it
    offset: int = 0
    size: int = 0
    before: int = 0x0A  # unit ahead of it: a line feed, or 0 for any other
    after: int = -1  # first byte of the next split
    extra: bool = False  # its last line feed is not in the file
    marked: bool = False  # the file begins with the mark of UTF-8


class Units:
    """Bytes of a split as units of its encoding, batch by batch; one of UTF-16 is kept whole."""

    def __init__(self, split: Split):
        self.split = split
        self.wide = split.encoding.startswith("utf-16")
        self.kind = {"utf-16-le": "<u2", "utf-16-be": ">u2"}.get(split.encoding, "u1")
        self.codec = "utf-8" if split.encoding == "utf-8-sig" else split.encoding
        self.held, self.first = b"", True

    def _mark(self, data: bytes) -> bytes:
        if self.first and data:
            if self.split.offset == 0:
                data = data[2:] if self.wide else _MARK + data if self.split.marked and self.codec == "gb18030" else data
            elif self.wide and self.split.offset % 2:
                data = data[1:]  # it belongs to the split before
            self.first = False
        return data

    def add(self, data: bytes) -> bytes:
        data = self._mark(data) if not self.wide else self.held + self._mark(data)
        if not self.wide:
            return data
        cut = max(0, (len(data) - 1) // 2 * 2)
        while cut and data[cut - 2:cut] in (b"\r\0", b"\0\r"):  # a line feed may follow
            cut -= 2
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        data = self.held
        if self.wide:
            if self.split.extra:
                data = data[:-1]
            elif (self.split.offset + self.split.size) % 2 and self.split.after >= 0:
                data += bytes([self.split.after])
            data = data[:len(data) // 2 * 2]  # an odd byte at the end of a file is no unit
        self.held = b""
        return data


def walk(units: np.ndarray, delim: int, inside: bool, before: int) -> tuple[list[int], list[int], bool]:
    """Openings and closings of quoted cells, and whether the last one is open.

    A quote opens a cell only where the cell begins; inside, two of them stand for one. ``before`` is
    the unit ahead of the first one. An opening ahead of the units is -1, a closing behind them their number.
    """
    at = np.flatnonzero(units == _QUOTE)
    opened, closed = ([-1] if inside else []), []
    if len(at):
        ahead = np.where(at > 0, units[at - 1], before)
        begins = ((ahead == delim) | (ahead == _FEED) | (ahead == _RETURN)).tolist()
        place, i, n = at.tolist(), 0, len(at)
        while i < n:
            if not inside:
                if begins[i]:
                    inside = True
                    opened.append(place[i])
            elif i + 1 < n and place[i + 1] == place[i] + 1:
                i += 1
            else:
                inside = False
                closed.append(place[i])
            i += 1
    if inside:
        closed.append(len(units))
    return opened, closed, inside


def row_ends(units: np.ndarray, opened: list[int], closed: list[int]) -> np.ndarray:
    """Places of the line feeds, or carriage returns without one, that end a row."""
    feed = units == _FEED
    ends = feed.copy()
    back = np.flatnonzero(units == _RETURN)
    if len(back):
        ends[back[~feed[np.minimum(back + 1, len(units) - 1)] | (back + 1 == len(units))]] = True
    at = np.flatnonzero(ends)
    if opened and len(at):
        k = np.searchsorted(opened, at, "right") - 1
        at = at[(k < 0) | (at > np.array(closed)[np.maximum(k, 0)])]
    return at


def _head_counts(data: bytes, encoding: str, wanted: int) -> list[list[int]]:
    """Delimiters in the first lines that are not blank."""
    out, low = [], 0
    while low < len(data) and len(out) < wanted:
        high = data.find(b"\n", min(len(data), low + 65536)) + 1 or len(data)
        for line in data[low:high].decode(encoding, "replace").splitlines():
            if (line := line.strip()) and len(out) < wanted:
                out.append([line.count(d) for d in V.DELIMITERS])
        low = high
    return out


class Facts:
    """What one split says about itself, under every delimiter and both beliefs about its start."""

    def __init__(self, split: Split, wide: bool):
        self.split, self.units, self.wide = split, Units(split), wide
        self.size, self.start, self.tail, self.utf8, self.gb, self.valid = 0, b"", 0, True, True, True
        self.gb_marked = True
        self.heads: dict[str, list] = {"utf-8": [], "gb18030": []}
        self.head, self.lines = "", 0
        self.state = [[False, True] for _ in _DELIMITERS]
        self.ends = [[0, 0] for _ in _DELIMITERS]
        self.last, self.first_low, self.last_high = split.before, False, False
        self.seen = False

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if not self.start:
            self.start = data[:4]
            self.gb_marked = _decodes(_MARK + data, "gb18030")
        self.tail = data[-2] if len(data) > 1 else _FEED
        if not self.wide and not data.isascii():
            self.utf8 = self.utf8 and _decodes(data, "utf-8")
            good = _decodes(data, "gb18030")
            self.gb = self.gb and good
            self.gb_marked = self.gb_marked and (good or self.size == len(data))
        self._scan(self.units.add(data))

    def end(self) -> None:
        self._scan(self.units.end())

    def _scan(self, data: bytes) -> None:
        if not data:
            return
        units = np.frombuffer(data, self.units.kind)
        if self.wide:
            self._check(units)
            if self.lines <= _HEAD_LINES:
                text = data.decode(self.units.codec, "replace")
                lines = text.splitlines(keepends=True)
                for k, line in enumerate(lines):
                    self.lines += bool(line.strip())
                    if self.lines > _HEAD_LINES:  # the lines before it are whole
                        lines = lines[:k + 1]
                        break
                self.head += "".join(lines)
        else:
            for name, held in self.heads.items():
                if len(held) < _HEAD_LINES:
                    held += _head_counts(data, name, _HEAD_LINES - len(held))
        for d, delim in enumerate(_DELIMITERS):
            for s in (0, 1):
                opened, closed, now = walk(units, delim, self.state[d][s], self.last)
                self.ends[d][s] += len(row_ends(units, opened, closed))
                self.state[d][s] = now
        self.last = int(units[-1])

    def _check(self, units: np.ndarray) -> None:
        high, low = (units & 0xFC00) == 0xD800, (units & 0xFC00) == 0xDC00
        if not self.seen:
            self.first_low, self.seen = bool(low[0]), True
        elif self.last_high != bool(low[0]):
            self.valid = False
        self.valid = self.valid and bool((high[:-1] == low[1:]).all())
        self.last_high = bool(high[-1])

    def row(self, file: int, start: int) -> dict:
        return {
            "file": file, "start": start, "size": self.size, "first": self.start, "tail": self.tail, "utf8": self.utf8, "gb": self.gb, "gb_marked": self.gb_marked,
            "valid": self.valid, "first_low": self.first_low, "last_high": self.last_high, "last": self.last, "head": self.head,
            "heads_utf8": [c for h in self.heads["utf-8"] for c in h], "heads_gb": [c for h in self.heads["gb18030"] for c in h],
            "states": [bool(s) for pair in self.state for s in pair], "ends": [n for pair in self.ends for n in pair],
        }


_FACTS = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("first", pa.binary()), ("tail", pa.int32()), ("utf8", pa.bool_()), ("gb", pa.bool_()), ("gb_marked", pa.bool_()),
    ("valid", pa.bool_()), ("first_low", pa.bool_()), ("last_high", pa.bool_()), ("last", pa.int32()), ("head", pa.string()),
    ("heads_utf8", pa.list_(pa.int32())), ("heads_gb", pa.list_(pa.int32())), ("states", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64()))])
_FACTS_DDL = ("file bigint, start bigint, size bigint, first binary, tail int, utf8 boolean, gb boolean, gb_marked boolean, valid boolean, first_low boolean, "
              "last_high boolean, last int, head string, heads_utf8 array<int>, heads_gb array<int>, states array<boolean>, ends array<bigint>")


def _shared(spark: SparkSession, splits: dict[tuple[int, int], Split], names: dict[int, str]):
    """As plain values, which workers can read before they have this package."""
    return spark.sparkContext.broadcast(({k: tuple(vars(v).values()) for k, v in splits.items()}, names))


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def _facts(pieces: DataFrame, known: dict[tuple[int, int], Split] | None):
    """One row a split; ``known`` says how to read those of UTF-16."""
    shared = _shared(pieces.sparkSession, known or {}, {})

    def run(batches):
        plan, now, facts = {k: Split(*v) for k, v in shared.value[0].items()}, None, None

        def done():
            facts.end()
            return pa.RecordBatch.from_pylist([facts.row(*now)], _FACTS)

        for file, start, data in _runs(batches):
            if (file, start) != now:
                if facts:
                    yield done()
                now = file, start
                facts = Facts(plan[now] if plan else Split(offset=start), bool(plan) and plan[now].encoding.startswith("utf-16"))
            facts.add(data)
        if facts:
            yield done()

    return pieces.mapInArrow(run, _FACTS_DDL).collect()  # a row a split, which Spark's own planner holds too


@dataclass
class File:
    path: str
    length: int
    address: str
    splits: list = field(default_factory=list)
    encoding: str = ""
    cause: str = ""
    marked: bool = False

    def place(self) -> list[Split]:
        """Offsets of the splits, from the bytes that each has read."""
        out, at = [], 0
        for k, s in enumerate(self.splits):
            after = self.splits[k + 1]["first"][0] if k + 1 < len(self.splits) else -1
            before = _FEED
            if k and self.encoding == "utf-16-le":
                before = _FEED if at % 2 and s["first"][0] == 0 else 0
            elif k and self.encoding == "utf-16-be":
                before = _FEED if at % 2 == 0 and self.splits[k - 1]["tail"] == 0 else 0
            out.append(Split(self.encoding, offset=at, size=s["size"], before=before, after=after))
            at += s["size"]
        if out:
            out[-1].extra = at > self.length
            out[0].marked = self.marked
        return out

    def settle(self) -> None:
        """Encoding from the facts of all splits."""
        first = self.splits[0]["first"] if self.splits else b""
        mark = next((name for m, name in _MARKS if first.startswith(m)), "")
        self.marked = sum(s["size"] for s in self.splits) < self.length
        if not self.length:
            self.cause = "empty file"
        elif first.startswith(b"PK\x03\x04") or self.path.lower().endswith((".xlsx", ".xls")):
            self.cause = "workbook container, not delimited text"
        elif mark.startswith("utf-16"):
            self.encoding = mark
        elif all(s["utf8"] for s in self.splits):
            self.encoding = "utf-8-sig"
        elif all(s["gb_marked" if self.marked and k == 0 else "gb"] for k, s in enumerate(self.splits)):
            self.encoding = "gb18030"
        else:
            self.cause = "neither UTF-8 nor GB18030"
        # A UTF-8 mark in a GB18030 file is text, but never has a quote, delimiter or line feed behind it.

    def check(self) -> None:
        """UTF-16 has no odd byte and no half of a pair."""
        if self.encoding.startswith("utf-16"):
            highs, lows = [s["last_high"] for s in self.splits], [s["first_low"] for s in self.splits]
            if self.length % 2 or not all(s["valid"] for s in self.splits) or [False, *highs] != [*lows, False]:
                self.cause = "neither UTF-8 nor GB18030"

    def compose(self) -> list[Split]:
        """The delimiter, then state and row number ahead of every split."""
        if self.encoding.startswith("utf-16"):
            text, lines = "", 0
            for s in self.splits:
                text += s["head"]
                lines = sum(1 for line in text.splitlines() if line.strip())
                if lines > _HEAD_LINES:
                    break
            delim = _DELIMITERS.index(ord(delimiter(text)))
        else:
            totals, left = [0] * len(_DELIMITERS), _HEAD_LINES
            for s in self.splits:
                found = s["heads_utf8" if self.encoding == "utf-8-sig" else "heads_gb"][:left * len(_DELIMITERS)]
                left -= len(found) // len(_DELIMITERS)
                totals = [t + sum(found[d::len(_DELIMITERS)]) for d, t in enumerate(totals)]
                if not left:
                    break
            delim = max(range(len(_DELIMITERS)), key=totals.__getitem__)
        out, inside, row, is_open = self.place(), False, 0, False
        for split, s in zip(out, self.splits):
            split.delimiter, split.inside, split.row, split.open = _DELIMITERS[delim], inside, row, is_open
            k = 2 * delim + inside
            inside, row = s["states"][k], row + s["ends"][k]
            is_open = inside or s["last"] not in (_FEED, _RETURN)
        return out


# --- rows -----------------------------------------------------------------------

_OUT = pa.schema([("source_file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string()))])
_PART = pa.schema([("file", pa.int64()), ("row_no", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("part", pa.binary())])


def _records(text: str, delim: int) -> list[list[str | None]]:
    csv.field_size_limit(2**31 - 1)
    return [[c.strip() or None for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=chr(delim))]


class Rows:
    """Whole rows of a split, and the pieces of rows that it shares with its neighbours."""

    def __init__(self, split: Split):
        self.split, self.units = split, Units(split)
        self.inside, self.open, self.row = split.inside, split.open, split.row
        self.last, self.held, self.seq = split.before, b"", 0

    def add(self, data: bytes, last: bool = False) -> tuple[int, list, list[tuple[int, int, bytes]]]:
        """Number of the first row, rows, and pieces ``(row, seq, bytes)``."""
        fresh = self.units.end() if last else self.units.add(data)
        pieces, rows, first = [], [], self.row
        if fresh:
            units = np.frombuffer(fresh, self.units.kind)
            size = units.dtype.itemsize
            opened, closed, self.inside = walk(units, self.split.delimiter, self.inside, self.last)
            ends = (row_ends(units, opened, closed) + 1) * size
            self.last = int(units[-1])
            low = 0
            if self.open:  # the row began in another split
                low = int(ends[0]) if len(ends) else len(fresh)
                pieces.append((self.row, self.seq, fresh[:low]))
                self.seq += 1
                if len(ends):
                    self.open, self.row, ends = False, self.row + 1, ends[1:]
                    first = self.row
            if not self.open:
                if len(ends):
                    stop = int(ends[-1])
                    rows = _records((self.held + fresh[low:stop]).decode(self.units.codec), self.split.delimiter)
                    if len(rows) != len(ends):
                        raise ValueError(f"{len(rows)} rows where {len(ends)} end")
                    self.held, low, self.row = b"", stop, self.row + len(ends)
                self.held += fresh[low:]
        if last and self.held:
            pieces.append((self.row, self.seq, self.held))
            self.held = b""
        return first, rows, pieces


def _read(pieces: DataFrame, plan, wanted: str):
    """``rows``: the grid of whole rows; ``parts``: pieces of rows that lie in several splits."""
    def run(batches):
        splits, names = plan.value
        now = rows = None

        def step(data, last):
            first, found, parts = rows.add(data, last)
            if wanted == "parts":
                if parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([now[0]] * len(parts)), pa.array([p[0] for p in parts]), pa.array([now[1]] * len(parts)),
                        pa.array([p[1] for p in parts]), pa.array([p[2] for p in parts], pa.binary())], schema=_PART)
            elif found:
                path = names[now[0]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(found)), pa.array([sheet_name(path)] * len(found)),
                    pa.array(np.arange(first, first + len(found))), pa.array(found, pa.list_(pa.string()))], schema=_OUT)

        for file, start, data in _runs(batches):
            if (file, start) != now:
                if rows:
                    yield from step(b"", True)
                now, rows = (file, start), None
                if now in splits:
                    rows = Rows(Split(*splits[now]))
            if rows:
                yield from step(data, False)
        if rows:
            yield from step(b"", True)

    return pieces.mapInArrow(run, GRID if wanted == "rows" else "file bigint, row_no bigint, start bigint, seq bigint, part binary")


def _joined(parts: DataFrame, plan) -> DataFrame:
    """One row from its pieces."""
    def run(batches):
        splits, names = plan.value
        starts: dict[int, list[int]] = {}
        for file, start in sorted(splits):
            starts.setdefault(file, []).append(start)
        for batch in batches:
            for file, row, held in zip(*(c.to_pylist() for c in batch.columns)):
                own = starts[file]
                split = Split(*splits[file, own[bisect_right(own, held[0]["start"]) - 1]])
                text = b"".join(p["part"] for p in held).decode(Units(split).codec)
                cells = _records(text, split.delimiter)
                path = names[file]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path]), pa.array([sheet_name(path)]), pa.array([row]),
                    pa.array(cells[:1] or [[]], pa.list_(pa.string()))], schema=_OUT)

    whole = parts.groupBy("file", "row_no").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "part"))).alias("held"))
    return whole.mapInArrow(run, GRID)


def read_split_grid(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Grid of all delimited files below ``path``, the same as ``read_grid`` gives, with files read in splits.

    Quoted line breaks, doubled quotes, blank lines and every cell are kept; encoding and delimiter are those
    of the whole file. Files without a grid are left out, see ``unreadable_splits``. A single row has to fit a task.
    """
    grid, _ = _prepare(spark, path, pattern, split_bytes)
    return grid


def unreadable_splits(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rejected files with the cause."""
    _, files = _prepare(spark, path, pattern, split_bytes)
    return spark.createDataFrame([(f.path, f.cause) for f in files if f.cause], "source_file string, cause string")


def _prepare(spark: SparkSession, path: str, pattern: str, split_bytes: int) -> tuple[DataFrame, list[File]]:
    own = _session(spark, split_bytes)
    listed = list_splittable(own, path, pattern).withColumn("file", F.xxhash64("address")).collect()
    files = {r["file"]: File(r["path"], r["length"], r["address"]) for r in listed}
    for s in _facts(_pieces(own, path, pattern), None) if files else []:
        files[s["file"]].splits.append(s)
    for f in files.values():
        f.splits.sort(key=lambda s: s["start"])
        f.settle()
    again = {key: f for key, f in files.items() if f.encoding.startswith("utf-16")}
    if again:
        known = {(key, s["start"]): split for key, f in again.items() for s, split in zip(f.splits, f.place())}
        found: dict[int, list] = {}
        for s in _facts(_pieces(own, path, pattern, [f.address for f in again.values()]), known):
            found.setdefault(s["file"], []).append(s)
        for key, f in again.items():
            f.splits = sorted(found[key], key=lambda s: s["start"])
            f.check()
    splits, shared = {}, set()
    for key, f in files.items():
        if f.cause:
            continue
        placed = f.compose()
        for k, (s, split) in enumerate(zip(f.splits, placed)):
            splits[key, s["start"]] = split
            tail = placed[k + 1].open if k + 1 < len(placed) else s["states"][2 * _DELIMITERS.index(split.delimiter) + split.inside] or s["last"] != _FEED
            if split.open or tail:
                shared.add((key, s["start"]))
    if not splits:
        return spark.createDataFrame([], GRID), list(files.values())
    names = {key: f.path for key, f in files.items()}
    plan = _shared(spark, splits, names)
    grid = _read(_pieces(own, path, pattern), plan, "rows")
    if shared:
        crossed = _shared(spark, {k: splits[k] for k in shared}, names)
        held = sorted({files[key].address for key, _ in shared})
        grid = grid.unionByName(_joined(_read(_pieces(own, path, pattern, held), crossed, "parts"), crossed))
    return grid, list(files.values())
