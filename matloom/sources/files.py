"""Matrices from text and raw binary files, id lists, sample sheets and alignment files."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import SCHEMA, BigMatrix, as_lists


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines with their number from 0 over all files in name order.

    The number is the count of lines in earlier splits plus the place in the split; splits are known
    by file and offset, so only a row per split is gathered.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    splits = raw.groupBy("f", "b").agg(F.min("i").alias("i0"), F.count("*").alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("f").alias("f_"), F.col("b").alias("b_"), "i0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    met = raw.join(starts, (F.col("f") == F.col("f_")) & (F.col("b") == F.col("b_")))
    return met.select((F.col("first") + F.col("i") - F.col("i0")).alias("line"), "value")


def text_matrix(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None, sep: str | None = None, skip_cols: int = 0, skip_rows: int = 0, col_names: Sequence[str] | bool = False, add: float = 0.0) -> BigMatrix:
    """Numbers from text: sep None splits at white space. Blank lines at the end do not count.

    col_names: a list, or True to take them from the last skipped line. A line of another arity or
    with what is no number is an error; n_rows too few or many as well. ``add`` is added to cells.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    names = col_names if not isinstance(col_names, bool) else None
    cut = lambda text: text.split(sep)[skip_cols:] if sep else text.split()[skip_cols:]
    if col_names is True:
        names = cut(lines.where(F.col("line") == skip_rows - 1).first()["value"])
    if n_cols is None:
        first = lines.where(F.col("line") >= skip_rows).orderBy("line").select("value").first()
        n_cols = len(cut(first["value"])) if first else 0
    cells = F.split("value", re.escape(sep), -1) if sep else F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cells = F.slice(cells, skip_cols + 1, 1 << 30)
    values = F.transform(cells, lambda x: F.trim(x).cast("double") + F.lit(float(add)))
    good = (F.size(cells) == n_cols) & ~F.exists(F.transform(cells, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNull())
    v = F.when(good, values).otherwise(F.raise_error(F.concat(F.lit("not a row of the matrix: line "), F.col("line").cast("string"))).cast("array<double>"))
    body = lines.where(F.col("line") >= skip_rows).select((F.col("line") - skip_rows).alias("row_idx"), v.alias("v"))
    if n_rows is not None and (got := body.select("row_idx").count()) != n_rows:
        raise ValueError(f"{got} rows, not {n_rows}")
    return BigMatrix.of(body, n_cols, names)


def split_records(spark: SparkSession, path: str, out: str, records: int, lines: int = 4) -> int:
    """Text files of records of ``lines`` lines each (sequence reads have four) as folders out/part=0, 1, ... of
    ``records`` records in order; the number of folders. A last record that is cut off is an error."""
    numbered = numbered_lines(spark, path)
    n = numbered.count()
    if n % lines:
        raise ValueError(f"{n} lines are no whole records of {lines}")
    dealt = numbered.select(F.expr(f"line div {records * lines}").alias("part"), "line", "value")
    dealt.repartitionByRange("line").sortWithinPartitions("part", "line").drop("line").write.partitionBy("part").text(out)
    return -(-n // (records * lines))


def row_ids(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """(pos, row_idx) of a file with one id per line, ids counted from ``base``; pos is the line's number."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select(F.col("line").cast("bigint").alias("pos"), (F.trim("value").cast("bigint") - base).alias("row_idx"))


# --- raw binary -------------------------------------------------------------------------------


def batch_rows(n_cols: int, item: int = 8, limit: int = 1 << 30) -> int:
    """Whole rows in a file of at most ``limit`` bytes."""
    return max(1, limit // (n_cols * item))


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())


def store_file(prefix: str, i: int, numbered: bool) -> str:
    """The one file of a matrix, or its i-th once it passes the limit."""
    return f"{prefix}_{i}.bfv" if numbered else f"{prefix}.bfv"


#: Small files and ranges are dealt to tasks in runs of about so many bytes, and read into batches of about so many.
TASK_BYTES, BATCH_BYTES = 64 << 20, 1 << 20


def _tasks(spark: SparkSession, n_bytes: int, parts: int) -> int:
    """Tasks for bytes in so many files or ranges: what they come to follows the bytes, not how small the parts are."""
    return max(1, min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))))


def binary_matrix(spark: SparkSession, prefix: str, n_rows: int, n_cols: int, kind: str = "<f8", limit: int = 1 << 30, chunk_bytes: int = 16 << 20, names: Sequence[str] | None = None) -> BigMatrix:
    """Row-major little-endian numbers without header, from one file or numbered ones.

    Byte ranges of whole rows are counted through all files; a task gets a run of them, works out where
    they lie, and reads them from any file system that pyarrow opens. A file that is too short is an error.
    """
    row = n_cols * np.dtype(kind).itemsize
    per_file = batch_rows(n_cols, np.dtype(kind).itemsize, limit)
    per = max(1, min(chunk_bytes // row, per_file))
    numbered, a_file = n_rows > per_file, -(-per_file // per)
    ranges = n_rows // per_file * a_file + -(-(n_rows % per_file) // per)

    def rows_of(first: int, data: bytes) -> pa.RecordBatch:
        x = np.frombuffer(data, kind).astype(float).reshape(-1, n_cols)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), as_lists(x)], ["row_idx", "v"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, size = [], 0, 0
        for i, run in groupby((q for b in batches for q in b.column(0).to_pylist()), lambda q: q // a_file):
            path = store_file(prefix, i, numbered)
            fs, local = _fs(path)
            with fs.open_input_file(local) as f:
                for q in run:
                    a = q % a_file * per
                    first, n = i * per_file + a, min(per, per_file - a, n_rows - i * per_file - a)
                    data = f.read_at(n * row, a * row)
                    if len(data) != n * row:
                        raise ValueError(f"{path} ends before row {first + n}")
                    if not held:
                        begin = first
                    held.append(data)
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield rows_of(begin, b"".join(held))
                        held, size = [], 0
        if held:
            yield rows_of(begin, b"".join(held))

    plan = spark.range(0, ranges, 1, _tasks(spark, n_rows * row, ranges))  # a partition's numbers are consecutive
    return BigMatrix.of(plan.mapInArrow(read, SCHEMA), n_cols, names)


def binary_vector(spark: SparkSession, prefix: str, n: int, kind: str = "<i4") -> DataFrame:
    """(row_idx, value)."""
    number = "bigint" if kind.startswith("<i") else "double"
    return binary_matrix(spark, prefix, n, 1, kind).df.select("row_idx", F.get("v", F.lit(0)).cast(number).alias("value"))


def write_binary(m: BigMatrix, prefix: str, n_rows: int, kind: str = "<f8", limit: int = 1 << 30) -> list[tuple[str, int]]:
    """(path, rows) of the files written: rows [i * R, (i + 1) * R) in file i, which one task writes; small files share tasks."""
    item, n_cols = np.dtype(kind).itemsize, m.n_cols
    per = batch_rows(n_cols, item, limit)
    numbered, n_files = n_rows > per, max(1, -(-n_rows // per))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..matrix import block

        at, out, written = None, None, 0
        done: list[tuple[str, int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            numbers, x = b.column(0).to_numpy(), block(b.column(2)).astype(kind)
            ends = [*(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip([0, *ends], ends):
                if numbers[start] != at:
                    if out is not None:
                        out.close()
                        done.append((store_file(prefix, at, numbered), written))
                    at, written = int(numbers[start]), 0
                    fs, local = _fs(store_file(prefix, at, numbered))
                    out = fs.open_output_stream(local)
                out.write(x[start:end].tobytes())
                written += end - start
        if out is not None:
            out.close()
            done.append((store_file(prefix, at, numbered), written))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n"])

    tasks = _tasks(m.df.sparkSession, n_rows * n_cols * item, n_files)
    dealt = m.df.select(F.expr(f"cast(row_idx div {per} as int)").alias("file"), "row_idx", "v").repartition(tasks, "file").sortWithinPartitions("file", "row_idx")
    return sorted((r["path"], r["n"]) for r in dealt.mapInArrow(write, "path string, n bigint").collect())


# --- alignments -------------------------------------------------------------------------------


def bam_header(data) -> list[tuple[str, int]]:
    """(name, length) of the references, from an open unzipped alignment stream."""
    if data.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.read(struct.unpack("<i", data.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", data.read(4))[0]):
        name = data.read(struct.unpack("<i", data.read(4))[0]).rstrip(b"\0").decode()
        out.append((name, struct.unpack("<i", data.read(4))[0]))
    return out


def bam_references(path: str) -> list[tuple[str, int]]:
    fs, local = _fs(path)
    with fs.open_input_stream(local, compression=None) as f, gzip.open(f) as g:
        return bam_header(g)


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian numbers at any places of a byte array."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(np.dtype(kind).itemsize)]).view(kind)[:, 0]


def _parse_records(data: bytes, begin: int, limit: int) -> tuple[np.ndarray, ...]:
    """(ref, pos, end, flag, place after) of the whole records that start in [begin, limit)."""
    starts, at, n = [], begin, len(data)
    while at < limit and at + 4 <= n:
        later = at + 4 + int.from_bytes(data[at : at + 4], "little")
        if later > n:
            break
        starts.append(at + 4)
        at = later
    raw, place = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    ref, pos = _numbers(raw, place, "<i4").astype(np.int64), _numbers(raw, place + 4, "<i4").astype(np.int64)
    ops, flag = _numbers(raw, place + 12, "<u2").astype(np.int64), _numbers(raw, place + 14, "<u2").astype(np.int64)
    first = np.cumsum(ops) - ops
    inside = np.arange(int(ops.sum())) - np.repeat(first, ops)
    op = _numbers(raw, np.repeat(place + 32 + raw[place + 8], ops) + 4 * inside, "<u4").astype(np.int64)
    size = np.where(np.isin(op & 15, (0, 2, 3, 7, 8)), op >> 4, 0)  # those that go along the reference
    total = np.concatenate([[0], np.cumsum(size)])
    return ref, pos, pos + total[first + ops] - total[first], flag, at


def _first_record(data: bytes, n_refs: int, chain: int = 8) -> int:
    """The first place at which a chain of plausible records starts; the end of data if there is none."""

    def next_of(at: int) -> int:
        if at + 36 > len(data):
            return len(data) + 1 if at <= len(data) else -1
        size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        fits = 32 <= size and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and l_name >= 1 and l_seq >= 0
        if not fits or 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size:
            return -1
        name_end = at + 36 + l_name - 1
        if name_end < len(data) and data[name_end] != 0:
            return -1
        return at + 4 + size

    for at in range(len(data)):
        place = at
        for _ in range(chain):
            place = next_of(place)
            if place < 0 or place >= len(data):
                break
        if place >= 0:
            return at
    return len(data)


_BLOCK = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00", re.S)


def _zipped_blocks(f, begin: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the BGZF blocks from the first that starts at ``begin`` or after it."""
    at, window = begin, b""
    if begin:
        window = f.read_at(min(1 << 17, size - begin), begin)
        for m in _BLOCK.finditer(window):
            after = m.start() + int.from_bytes(window[m.start() + 16 : m.start() + 18], "little") + 1
            if begin + after == size or _BLOCK.match(window, after):  # a block that is followed by one, or by nothing
                at = begin + m.start()
                break
        else:
            return
    while at + 18 <= size:
        head = f.read_at(18, at)
        if not _BLOCK.match(head):
            raise ValueError(f"no block at {at}")
        n = int.from_bytes(head[16:18], "little") + 1
        yield at, zlib.decompress(f.read_at(n - 18, at + 18)[:-8], -15)
        at += n


def _split_of(path: str, begin: int, end: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ref, pos, end, flag) of the records that start in the blocks of a file that start in [begin, end)."""
    n_refs = len(bam_references(path))
    fs, local = _fs(path)
    with fs.open_input_file(local) as f:
        data, base, limit, started = b"", 0, 0, False
        for at, content in _zipped_blocks(f, begin, size):
            own = at < end
            data += content
            limit += len(content) if own else 0
            if own and limit < 4 << 20:
                continue
            if not started:
                base = _header_size(data) if begin == 0 else _first_record(data, n_refs)
                started = True
            *found, after = _parse_records(data, base, limit)
            yield tuple(found)
            if not own and after >= limit:
                return
            data, base, limit = data[after:], 0, max(limit - after, 0)
        if not started:
            base = (_header_size(data) if begin == 0 else _first_record(data, n_refs)) if data else 0
        if base < limit:
            yield _parse_records(data, base, limit)[:4]


def _header_size(data: bytes) -> int:
    import io

    stream = io.BytesIO(data)
    bam_header(stream)
    return stream.tell()


def _whole_file(path: str) -> Iterator[tuple[np.ndarray, ...]]:
    fs, local = _fs(path)
    with fs.open_input_stream(local, compression=None) as f, gzip.open(f) as g:
        bam_header(g)
        data = b""
        while piece := g.read(8 << 20):
            data += piece
            *found, after = _parse_records(data, 0, len(data))
            data = data[after:]
            yield tuple(found)


def read_bam(spark: SparkSession, paths: Sequence[str], split_bytes: int = 64 << 20) -> DataFrame:
    """(sample, ref, start, end, is_mapped); end is where the reference-consuming operations end.

    Files of BGZF blocks are read in splits of ``split_bytes``: a split starts at the first block in
    it, and there at the first place from which plausible records follow one another. Other gzip
    files are read by a task each.
    """
    splits: list[tuple[str, int, int, int]] = []
    names: dict[str, list[str]] = {}
    for path in paths:
        names[path] = [n for n, _ in bam_references(path)]
        fs, local = _fs(path)
        size = fs.get_file_info(local).size
        with fs.open_input_file(local) as f:
            blocks = bool(_BLOCK.match(f.read_at(18, 0)))
        step = split_bytes if blocks else max(size, 1)
        splits += [(path, a, min(a + step, size), size if blocks else -1) for a in range(0, size, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end, size in zip(*(b.column(c).to_pylist() for c in range(4))):
                refs = np.array([*names[path], None], object)  # the last for reads without a reference
                for ref, pos, stop, flag in _whole_file(path) if size < 0 else _split_of(path, begin, end, size):
                    columns = [pa.array([path] * len(ref), pa.string()), pa.array(refs[ref], pa.string()), pa.array(pos), pa.array(stop), pa.array(flag & 4 == 0)]
                    yield pa.RecordBatch.from_arrays(columns, ["sample", "ref", "start", "end", "is_mapped"])

    plan = spark.createDataFrame(splits, "path string, begin bigint, stop bigint, size bigint").repartition(max(1, min(len(splits), 4096)))
    return plan.mapInArrow(run, "sample string, ref string, start bigint, end bigint, is_mapped boolean")


def bam_matrix(spark: SparkSession, listing: str, width: int, refs: Sequence[str] | None = None, paths: Sequence[str] | None = None) -> BigMatrix:
    """Counts of read midpoints: a row for every bin of ``width`` units, a column for each alignment file.

    listing names the files, a line each, taken from the listing's folder unless they are absolute
    (or give them as ``paths``). Bins are those of ``refs`` in their order, or of the references that
    all files have, in natural order; every file must have each with one length. Bins without reads
    are rows of zeros.
    """
    from ..operators.bins import bin_map, located, natural_key, total_bins

    if paths is None:
        folder = listing.rpartition("/")[0]
        names = [r["value"].strip() for r in numbered_lines(spark, listing).orderBy("line").collect()]  # a row per file
        paths = [n if n.startswith("/") or "://" in n else f"{folder}/{n}" for n in names if n and not n.startswith("#")]
    known = [dict(bam_references(p)) for p in paths]
    shared = set.intersection(*map(set, known)) if known else set()
    wanted = sorted(shared, key=natural_key) if refs is None else list(refs)
    for r in wanted:
        lengths = {k.get(r) for k in known}
        if len(lengths) != 1 or None in lengths:
            raise ValueError(f"the files do not agree on {r}: {lengths}")
    bins = bin_map(spark, [(r, known[0][r]) for r in wanted], width)
    place = F.create_map(*(x for j, p in enumerate(paths) for x in (F.lit(p), F.lit(j))))
    at = located(read_bam(spark, paths).where("is_mapped"), bins, width, F.expr("(start + end) div 2")).where("bin >= 0")
    cells = at.groupBy(F.col("bin").alias("row_idx"), place[F.col("sample")].alias("col")).agg(F.count("*").cast("double").alias("value"))
    every = spark.range(total_bins(bins)).select(F.col("id").alias("row_idx"), F.lit(0).alias("col"), F.lit(0.0).alias("value"))
    return BigMatrix.from_long(cells.unionByName(every), len(paths), names=[p.rpartition("/")[2] for p in paths])


def merge_strands(evidence: DataFrame) -> DataFrame:
    """Evidence with Crick positions moved to the Watson base of their CpG, one before."""
    at = F.col("RefOffset") - F.when(F.col("IsWaston") == 0, 1).otherwise(0)
    return evidence.withColumn("RefOffset", at)


def read_evidence(spark: SparkSession, path: str, min_mapq: int = 0, sep: str = "\t", cycles: Sequence[int] | None = None) -> DataFrame:
    """Methylation evidence rows with a mapping quality of at least min_mapq, repeated rows once.

    cycles: only bases of these sequencing cycles are read, all of them unless given.
    """
    # fixed values: the columns of the evidence format, with its spelling
    fields = "RefName string, RefOffset bigint, ReadID string, Allele string, IsWaston int, IsForward int, SamFlag int, Qual1 int, Qual2 int, SeqCycle int, AlLen int, AlScore int, MAPQ int, MateID string"
    rows = spark.read.csv(path, schema=fields, sep=sep, header=True).where(F.col("MAPQ") >= min_mapq)
    return (rows if cycles is None else rows.where(F.col("SeqCycle").isin([int(c) for c in cycles]))).dropDuplicates()


# --- sheets and specifications ----------------------------------------------------------------


def sample_sheet(text: str) -> list[dict]:
    """Rows sample, dir, file, group, tags...; an empty dir is that of the row above; # starts a comment."""
    out: list[dict] = []
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if line:
            sample, folder, file, group, *tags = (*(x.strip() for x in line.split(",")), "", "", "")[: max(4, line.count(",") + 1)]
            out.append({"sample": sample, "dir": folder or (out[-1]["dir"] if out else ""), "file": file, "group": group, "tags": [t for t in tags if t]})
    return out


def parse_spec(spec: str) -> tuple[str, str]:
    """"type@location", split at the last @."""
    kind, at, place = spec.rpartition("@")
    if not at or not kind or not place:
        raise ValueError(f"not type@location: {spec}")
    return kind, place


LOADERS: dict[str, Callable[..., object]] = {"text-mat": text_matrix, "binary-mat": binary_matrix, "text-rowids": row_ids, "bams": bam_matrix}
#: Further names of the kinds, for specifications written for other programs: {their name: kind}.
ALIASES: dict[str, str] = {}


def load(spark: SparkSession, spec: str, **options):
    """What a specification type@location names; other names of types are looked up in ALIASES."""
    from .store import load_output

    kind, place = parse_spec(spec)
    kind = ALIASES.get(kind, kind)
    if kind not in LOADERS and kind not in ("output", "matrix", "kmeans-data-mat", "kmeans-seeds-mat"):
        raise ValueError(f"unknown type {kind}: give one of {sorted(LOADERS)} or output, or name it in ALIASES")
    if kind in ("output", "matrix", "kmeans-data-mat", "kmeans-seeds-mat"):
        return load_output(spark, place)
    return LOADERS[kind](spark, place, **options)
