"""``spark.read.format("idat")`` and ``df.write.format("idat")``: folders of channel files as tables of probe cells.

A partition of the table is one sample: its task opens both channel files and pairs their arrays in place, so no cell is
shuffled before markers meet.  Options of a read choose files before any is opened, and leave rows out before they leave the decoder:
``first`` (so many samples), ``samples`` (numbers with commas), ``low`` and ``high`` (least and greatest ``snp_id``), ``markers`` (path of
a Bloom filter by ``write_bloom``).  They belong to one ``load``.  Spark's own filters are not taken over: this release
keeps the reader of the last pushed filter with the table, so another query on the same DataFrame would lose rows.

Option of a write: ``gzip`` (true).  A written table has rows (sample, snp_id, red, grn) and each sample's rows are in one task, one
after the other.  ``register(spark)`` makes the format known to a session.
"""

from __future__ import annotations

import gzip
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import idat
from .places import Folder, opened

SCHEMA = "sample_idx int, sample string, snp_id long, red int, grn int"
#: Rows of a batch that leaves the decoder.
BATCH = 1 << 17
#: Bits of a Bloom filter of chosen markers (2 MB, whatever their number is) and bits set for each: of a million markers
#: about one in two thousand others passes.
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 5

def register(spark: SparkSession) -> None:
    """Make ``idat`` known to a session."""
    spark.dataSource.register(IdatSource)


@dataclass
class Sample(InputPartition):
    sample_idx: int
    sample: str
    green: str
    red: str


def pairs_below(root: str, first: int = 0) -> list[Sample]:
    """The pairs of channel files below ``root`` in the order of the green paths; the same rules as ``idat.find_pairs``."""
    files, place = opened(root)
    sides: dict[str, dict[bool, str]] = {}
    for info in files.get_file_info(fs.FileSelector(place, recursive=True)):
        name = posixpath.basename(info.path)
        if info.type == fs.FileType.File and (found := re.match(idat.NAME, name)):
            base, red = found[1], found[2] == "Red"
            if red in sides.setdefault(base, {}):
                raise ValueError(f"several files for one channel: {sides[base][red]}, {info.path}")
            sides[base][red] = info.path
    both = sorted((s[False].encode(), s[False], s[True]) for s in sides.values() if len(s) == 2)
    whole = [Sample(k, idat.stem(posixpath.basename(g)), g, r) for k, (_, g, r) in enumerate(both)]
    return whole[:first] if first else whole


class IdatReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed: load(path)")
        self.root, self.first, self.markers = options["path"], int(options.get("first", 0)), options.get("markers")
        self.samples = {int(k) for k in options["samples"].split(",") if k.strip()} if "samples" in options else None
        self.low, self.high = (int(options[k]) if k in options else None for k in ("low", "high"))

    def partitions(self) -> list[Sample]:
        every = pairs_below(self.root, self.first)
        return every if self.samples is None else [s for s in every if s.sample_idx in self.samples]

    def read(self, part: Sample | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark reads one partition of a source that has none
            return
        files, _ = opened(self.root)
        sides = []
        for path in (part.green, part.red):
            with files.open_input_stream(path, compression=None) as f:
                try:
                    sides.append(idat.decode(f.read()))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        ids, red, grn = idat.paired(*sides)
        keep = np.ones(len(ids), bool)
        if self.low is not None:
            keep &= ids >= self.low
        if self.high is not None:
            keep &= ids <= self.high
        if self.markers:
            keep &= bloom_has(read_bloom(self.markers), ids)
        at = np.flatnonzero(keep)
        for i in range(0, len(at), BATCH):
            on = at[i : i + BATCH]
            columns = [np.full(len(on), part.sample_idx, np.int32), pa.array([part.sample] * len(on), pa.string()), ids[on], red[on].astype(np.int32), grn[on].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["sample_idx", "sample", "snp_id", "red", "grn"])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class IdatWriter(DataSourceArrowWriter):
    """Two files for each sample, which appear when all tasks are done; a failed write leaves none."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = Folder(options["path"]), overwrite
        self.pack, self.end = (gzip.compress, ".gz") if options.get("gzip", "false").lower() == "true" else (bytes, "")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        moves: list[tuple[str, str]] = []
        held: list[pa.Table] = []

        def flush() -> None:
            rows = pa.concat_tables(held)
            name, ids = rows["sample"][0].as_py(), rows["snp_id"].to_numpy()
            for kind, column in (("Grn", "grn"), ("Red", "red")):
                data = self.pack(idat.encode(ids, rows[column].to_numpy()))
                moves.append((self.folder.write(data), f"{name}_{kind}.idat{self.end}"))
            held.clear()

        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["sample", "snp_id", "red", "grn"])
            names = rows["sample"].to_numpy()
            ends = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(ends, ends[1:], strict=False):
                part = rows.slice(a, b - a)
                if held and b > a and held[0]["sample"][0] != part["sample"][0]:
                    flush()
                if b > a:
                    held.append(part)
        if held:
            flush()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [m for x in messages if x for m in x.moves]
        if len({name for _, name in moves}) < len(moves):
            self.folder.clear()
            raise ValueError("a sample's rows are in several places: repartition by sample and sort within partitions")
        self.folder.publish(moves, self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.clear()


class IdatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "idat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdatReader:
        return IdatReader(self.options)

    def writer(self, schema, overwrite: bool) -> IdatWriter:
        return IdatWriter(self.options, overwrite)


# --- chosen markers as a filter of fixed size -----------------------------------------------------------


def _bits(ids: np.ndarray) -> np.ndarray:
    """The places [hash, id] that an id's bits have."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    one, two = h >> np.uint64(40), (h >> np.uint64(16)) | np.uint64(1)
    return np.stack([(one + np.uint64(k) * two) % np.uint64(BLOOM_BITS) for k in range(BLOOM_HASHES)]).astype(np.int64)


def bloom(markers: DataFrame) -> np.ndarray:
    """The filter's 64-bit words of all ``snp_id``: tasks set bits, words meet by OR, and the driver gets the words alone."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            mine[_bits(batch.column(0).to_numpy()).ravel()] = True
        words = np.packbits(mine, bitorder="little").view("<i8")
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full])], ["word", "bits"])

    rows = markers.select("snp_id").mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    for word, bits in rows.collect():  # BLOOM_BITS / 64 rows at most
        out[word] = bits
    return out


def bloom_has(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be among the filter's: never false for one that is."""
    at = _bits(ids)
    return (((words[at >> 6] >> (at & 63)) & 1) == 1).all(0)


def write_bloom(markers: DataFrame, path: str) -> str:
    files, place = opened(path)
    files.create_dir(posixpath.dirname(place), recursive=True)
    with files.open_output_stream(place) as f:
        f.write(bloom(markers).tobytes())
    return path


def read_bloom(path: str) -> np.ndarray:
    files, place = opened(path)
    with files.open_input_file(place) as f:
        return np.frombuffer(f.read(), "<i8")

