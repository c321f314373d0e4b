"""Random-access container files: a header, a table of sections, then the sections; read and written by a Spark data source.

Files are opened through pyarrow's file systems, so a path may be local or in a store that it knows (s3, gs, hdfs); only the header, the table and what is
asked for are read. load() reads the same tables through Spark's binaryFile, whole files at a time, for any other store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

# The layout. Numbers are little-endian; offsets count from the start of the file.
# Header: magic, format version (major, minor), oldest reader (major, minor), header size, flags, width, height, frame rate (two numbers), time scale,
# duration in ticks, pixel codec, schema version (major, minor), number of sections, size of a table row, 6 bytes spare, CRC32 of the table; then the CRC32 of what is before it.
HEADER = struct.Struct("<4sHHHHIIIIIIIQHHHHH6xI")
HEADER_SIZE = HEADER.size + 4
FIELDS = "magic major minor reader_major reader_minor header_size flags width height fps_num fps_den timescale duration codec schema_major schema_minor count row_size table_crc".split()
# A table row: type, layer, flags (1: zstd), offset, length, CRC32, first and last tick (0 and 0: the whole stream).
ROW = struct.Struct("<HBBQQIqq")
# A frame index: size of a record, spare, count; records of pts, dts, offset within the pixels, size, flags (1: key frame), in decode order.
INDEX_HEAD = struct.Struct("<IIQ")
RECORD = struct.Struct("<qqQII")
VERSION = (1, 0)
PIXEL, SEMANTIC, FRAME_INDEX, METADATA, AUDIO = 1, 2, 3, 4, 5
NO_LAYER, ALL_LAYERS = 0, 255
H264, H265, AV1 = 1, 2, 3


class ContainerError(ValueError):
    pass


@dataclass(frozen=True)
class Section:
    idx: int
    type: int
    layer: int
    flags: int
    offset: int
    length: int
    crc32: int
    start: int
    end: int


class Source:
    """Bytes at an offset: of an open file, or of bytes in memory."""

    def __init__(self, file=None, raw=None):
        self.file, self.raw = file, raw
        self.size = file.size() if file is not None else len(raw)

    def read(self, at: int, n: int) -> bytes:
        got = bytes(self.raw[at : at + n]) if self.file is None else self.file.read_at(n, at)
        if len(got) < n:
            raise ContainerError("the file is cut short")
        return got


class Container:
    """One file: its header and its sections. Nothing else is read before it is asked for."""

    def __init__(self, source: Source, magic: bytes | None = None):
        if source.size < HEADER_SIZE:
            raise ContainerError("not a container: too short")
        head = source.read(0, HEADER_SIZE)
        if magic is not None and head[:4] != magic:
            raise ContainerError("not a container: another magic")
        if zlib.crc32(head[:-4]) != int.from_bytes(head[-4:], "little"):
            raise ContainerError("header checksum differs")
        self.source, self.header = source, dict(zip(FIELDS, HEADER.unpack(head[:-4])))
        h = self.header
        if (h["reader_major"], h["reader_minor"]) > VERSION:
            raise ContainerError(f"the file needs a reader of version {h['reader_major']}.{h['reader_minor']}")
        if h["header_size"] < HEADER_SIZE or h["row_size"] < ROW.size:
            raise ContainerError("damaged header")
        table = source.read(h["header_size"], h["count"] * h["row_size"])
        if zlib.crc32(table) != h["table_crc"]:
            raise ContainerError("section table checksum differs")
        self.sections = [Section(i, *ROW.unpack_from(table, i * h["row_size"])) for i in range(h["count"])]
        if any(s.offset + s.length > source.size for s in self.sections):
            raise ContainerError("a section reaches past the end")

    def find(self, type_: int, layer: int | None = None) -> Section | None:
        return next((s for s in self.sections if s.type == type_ and layer in (None, s.layer)), None)

    def find_range(self, type_: int, layer: int, start: int, end: int) -> list[Section]:
        hit = [s for s in self.sections if s.type == type_ and s.layer == layer and ((s.start, s.end) == (0, 0) or s.start <= end and s.end >= start)]
        return sorted(hit, key=lambda s: s.start)

    def pieces(self, s: Section, size: int = 8 << 20):
        """A section's bytes in pieces, unchecked."""
        for at in range(0, s.length, size):
            yield self.source.read(s.offset + at, min(size, s.length - at))

    def verify(self, s: Section) -> None:
        """Check a section's checksum without holding it."""
        crc = 0
        for piece in self.pieces(s):
            crc = zlib.crc32(piece, crc)
        if crc != s.crc32:
            raise ContainerError(f"checksum of section {s.idx} differs")

    def verify_all(self) -> None:
        for s in self.sections:
            self.verify(s)

    def content(self, s: Section, verify: bool = True) -> bytes:
        got = b"".join(self.pieces(s))
        if verify and zlib.crc32(got) != s.crc32:
            raise ContainerError(f"checksum of section {s.idx} differs")
        return got

    def index(self, s: Section | None = None) -> tuple[int, int, int]:
        """(offset of the first record, size of one, how many) of the frame index."""
        s = s or self.find(FRAME_INDEX)
        if s is None or s.type != FRAME_INDEX or s.length < INDEX_HEAD.size:
            raise ContainerError("no frame index")
        size, _, n = INDEX_HEAD.unpack(self.source.read(s.offset, INDEX_HEAD.size))
        if size < RECORD.size or INDEX_HEAD.size + n * size > s.length:
            raise ContainerError("damaged frame index")
        return s.offset + INDEX_HEAD.size, size, n

    def records(self, first: int = 0, last: int | None = None, step: int = 1 << 16):
        """Records [first, last) of the frame index, read in pieces."""
        at, size, n = self.index()
        last = n if last is None else last
        if not 0 <= first <= last <= n:
            raise ContainerError("no such frame")
        for a in range(first, last, step):
            some = self.source.read(at + a * size, (min(last, a + step) - a) * size)
            for i in range(0, len(some), size):
                yield RECORD.unpack_from(some, i)

    def record(self, i: int) -> tuple[int, int, int, int, int]:
        return next(self.records(i, i + 1))


def encode_index(records: list[tuple[int, int, int, int, int]]) -> bytes:
    return INDEX_HEAD.pack(RECORD.size, 0, len(records)) + b"".join(RECORD.pack(*r) for r in records)


def write(out, header: dict, sections, count: int) -> int:
    """Write a container to a seekable file; sections: (type, layer, flags, pieces of bytes, start, end), as many as count says.

    The table and the header come last, so a file that is cut short has none; the bytes written.
    """
    get = lambda k, d=0: int(header.get(k) if header.get(k) is not None else d)
    if not 0 <= count <= 0xFFFF or not get("fps_den", 1) or not get("timescale", 90000):
        raise ContainerError("sections, frame rate or time scale out of range")
    at = HEADER_SIZE + count * ROW.size
    out.seek(at)
    rows = []
    for kind, layer, flags, pieces, start, end in sections:
        if len(rows) == count:
            raise ContainerError("more sections than declared")
        crc, n = 0, 0
        for p in [pieces] if isinstance(pieces, bytes | bytearray | memoryview) else pieces:
            out.write(p)
            crc, n = zlib.crc32(p, crc), n + len(p)
        rows.append(ROW.pack(kind, layer, flags, at, n, crc, start, end))
        at += n
    if len(rows) != count:
        raise ContainerError("fewer sections than declared")
    table = b"".join(rows)
    magic = header.get("magic") or b"FLOR"
    head = HEADER.pack(magic, get("major", VERSION[0]), get("minor", VERSION[1]), get("reader_major", 1), get("reader_minor"), HEADER_SIZE, get("flags"), get("width"), get("height"), get("fps_num", 30), get("fps_den", 1), get("timescale", 90000), get("duration"), get("codec", H264), get("schema_major"), get("schema_minor", 1), count, ROW.size, zlib.crc32(table))
    out.seek(0)
    out.write(head + zlib.crc32(head).to_bytes(4, "little") + table)
    return at


def encode(header: dict, sections: list[tuple[int, int, int, bytes, int, int]]) -> bytes:
    import io

    out = io.BytesIO()
    write(out, header, sections, len(sections))
    return out.getvalue()


SCHEMAS = {
    "header": "path string, major int, minor int, width long, height long, fps_num long, fps_den long, timescale long, duration long, codec int, schema_major int, schema_minor int, sections int",
    "sections": "path string, idx int, type int, layer int, flags int, offset long, length long, crc32 long, start long, end long",
    "frame_index": "path string, decode_idx long, pts long, dts long, offset long, size long, flags long",
    "content": "path string, idx int, type int, layer int, start long, end long, content binary",
}


def rows(table: str, path: str, held: Container, verify: bool = True, part: int = 0, parts: int = 1, keep=lambda s: True):
    """Rows of one file's table; of a frame index the part-th of equal parts. Sections that keep() refuses are not read."""
    if table == "header":
        h = held.header
        yield (path, *(h[k] for k in "major minor width height fps_num fps_den timescale duration codec schema_major schema_minor count".split()))
    elif table == "sections":
        yield from ((path, s.idx, s.type, s.layer, s.flags, s.offset, s.length, s.crc32, s.start, s.end) for s in held.sections if keep(s))
    elif table == "content":
        yield from ((path, s.idx, s.type, s.layer, s.start, s.end, held.content(s, verify)) for s in held.sections if keep(s))
    else:
        s = held.find(FRAME_INDEX)
        if s is None:
            return
        if verify and part == 0:
            held.verify(s)
        n = held.index(s)[2]
        first = n * part // parts
        yield from ((path, first + i, *r) for i, r in enumerate(held.records(first, n * (part + 1) // parts)))


def _files(path: str, suffix: str):
    """(file system, [(its path, size)])."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
    return system, sorted((f.path, f.size) for f in found)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


class _Piece(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.table, self.path, self.verify = options.get("table", "sections"), options["path"], options.get("verify", "true") != "false"
        self.magic = options["magic"].encode() if "magic" in options else None
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equalities on path, idx, type and layer decide what is read; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("path", "idx", "type", "layer"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            yield f

    def partitions(self):
        """A partition per file; a frame index in as many parts as the file has `split_bytes`, so that none of them needs to be opened here."""
        split = int(self.options.get("split_bytes", 1 << 30))
        found = [(p, n) for p, n in _files(self.path, self.options.get("suffix", ".vidx"))[1] if p in self.wanted.get("path", {p})]
        many = lambda n: max(1, -(-n // split)) if self.table == "frame_index" else 1
        return [_Piece(p, i, many(n)) for p, n in found for i in range(many(n))] or [_Piece("", 0, 1)]

    def read(self, partition):
        if not partition.path:
            return
        keep = lambda s: all(getattr(s, k) in v for k, v in self.wanted.items() if k != "path")
        with _system(self.path).open_input_file(partition.path) as f:
            yield from rows(self.table, partition.path, Container(Source(f), self.magic), self.verify, partition.part, partition.parts, keep)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """A file for each row: name, the header's fields that are columns, and sections, an array of (type, layer, flags, content, start, end).

    Files are written to a folder of their own beside the target and moved at commit; an abort, or a commit that fails, leaves none behind.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, dict(options)
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _where(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        import io

        system, at = self._where()
        system.create_dir(f"{at}/{self.staging}", recursive=True)
        names = []
        for row in iterator:
            row = row.asDict(True)
            name = row["name"]
            if "/" in name or name[:1] in "._":
                raise ContainerError(f"not a file name: {name}")
            mine = f"{uuid.uuid4().hex}-{name}"
            header = {k: v for k, v in row.items() if k not in ("name", "sections")} | ({"magic": self.options["magic"].encode()} if "magic" in self.options else {})
            told = io.BytesIO()  # stores do not seek while they write
            write(told, header, [(s["type"], s["layer"] or 0, s["flags"] or 0, bytes(s["content"] or b""), s["start"] or 0, s["end"] or 0) for s in row["sections"]], len(row["sections"]))
            with system.open_output_stream(f"{at}/{self.staging}/{mine}") as f:
                f.write(told.getbuffer())
            names.append(f"{mine}/{name}")
        return _Written(names)

    def commit(self, messages):
        from pyarrow import fs

        system, at = self._where()
        names = [n for m in messages if m is not None for n in m.names]
        final = [n.split("/")[1] for n in names]
        if len(set(final)) < len(final):
            self.abort(messages)
            raise ContainerError("two rows with one file name")
        if self.overwrite and system.get_file_info(at).type == fs.FileType.Directory:
            for f in _files(self.path, self.options.get("suffix", ".vidx"))[1]:
                system.delete_file(f[0])
        for n in names:
            mine, name = n.split("/")
            system.move(f"{at}/{self.staging}/{mine}", f"{at}/{name}")
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages):
        from pyarrow import fs

        system, at = self._where()
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


class ContainerSource(DataSource):
    """Options: path, table (header, sections, frame_index, content), magic (four letters; any if not given), verify, suffix, split_bytes."""

    @classmethod
    def name(cls):
        return "vidx"

    def schema(self):
        return SCHEMAS[self.options.get("table", "sections")]

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, which has to push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)


def load(spark: SparkSession, path: str, table: str = "sections", verify: bool = True, magic: bytes | None = None) -> DataFrame:
    """The same tables through Spark's binaryFile reader, for any store that Spark can open."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def run(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                if out := list(rows(table, p, Container(Source(raw=raw), magic), verify)):
                    yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMAS[table])


def frames_at(wanted: DataFrame, magic: bytes | None = None) -> DataFrame:
    """wanted(path, decode_idx) -> rows of the frame index, each read by itself; a file is opened once for its rows of a batch."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for path, some in b.groupby("path"):
                with _system(path).open_input_file(path.split("://", 1)[-1] if path.startswith("file://") else path) as f:
                    held = Container(Source(f), magic)
                    yield pd.DataFrame([(path, i, *held.record(int(i))) for i in some["decode_idx"]], columns=[c.split()[0] for c in SCHEMAS["frame_index"].split(", ")])

    return wanted.select("path", "decode_idx").repartition("path").mapInPandas(run, SCHEMAS["frame_index"])
