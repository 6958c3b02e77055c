"""Binary records of a journal and of a file table as rows: Arrow batches in, rows out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.names import ESCAPE

#: Fixed: the layout of one decoded record.
JOURNAL_SCHEMA = "buffer_id long, next_usn long, usn long, file_ref long, parent_ref long, reason long, attrs long, name string, error string"
TABLE_SCHEMA = "record_id long, in_use boolean, is_dir boolean, base_ref long, parent_ref long, name string, dos_name boolean, modified long, size long, alloc long, error string"


def stored_name(raw: bytes) -> str:
    """UTF-16 units as a stored name: what is no character, and the mark itself, becomes the mark and four digits."""
    out = []
    units = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
    i = 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append(chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00))
            i += 1
        elif 0xD800 <= u < 0xE000 or u == 0xFFFF:
            out.append(f"{ESCAPE}{u:04X}")
        else:
            out.append(chr(u))
        i += 1
    return "".join(out)


def journal_records(buffer: bytes) -> tuple[int | None, list[tuple], str | None]:
    """The next position, the records (usn, file_ref, parent_ref, reason, attrs, name) before any damage, and what is damaged."""
    if len(buffer) < 8:
        return None, [], "short buffer"
    (following,) = struct.unpack_from("<q", buffer)
    at, rows = 8, []
    while at + 8 <= len(buffer):
        length, major = struct.unpack_from("<IH", buffer, at)
        if length < 60 or at + length > len(buffer):
            return following, rows, f"bad length at {at}"
        if major == 2:
            ref, parent = struct.unpack_from("<qq", buffer, at + 8)
            rest = at + 24
        elif major == 3:
            ref, parent = struct.unpack_from("<q", buffer, at + 8)[0], struct.unpack_from("<q", buffer, at + 24)[0]
            rest = at + 40
        else:
            return following, rows, f"unknown version at {at}"
        (usn,) = struct.unpack_from("<q", buffer, rest)
        (reason,) = struct.unpack_from("<I", buffer, rest + 16)
        (attrs,) = struct.unpack_from("<I", buffer, rest + 28)
        n, off = struct.unpack_from("<HH", buffer, rest + 32)
        if off + n > length:
            return following, rows, f"bad name at {at}"
        rows.append((usn, ref, parent, reason, attrs, stored_name(buffer[at + off : at + off + n])))
        at += length
    return following, rows, None


def parse_journal(buffers: DataFrame, id: str = "buffer_id", data: str = "data") -> DataFrame:
    """One row per record of each buffer; a damaged buffer gives the records before the damage and one row with `error`. Null data gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                following, recs, error = journal_records(x)
                rows += [(i, following, *r, None) for r in recs]
                if error:
                    rows.append((i, following, None, None, None, None, None, None, error))
            names = [f.split()[0] for f in JOURNAL_SCHEMA.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return buffers.where(f"{data} IS NOT NULL").select(id, data).mapInArrow(run, JOURNAL_SCHEMA)


def journal_buffer(following: int, records: list[tuple], version: int = 2) -> bytes:
    """The inverse of journal_records, for fixtures."""
    out = struct.pack("<q", following)
    for usn, ref, parent, reason, attrs, name in records:
        raw = name.encode("utf-16-le", "surrogatepass")
        head = struct.pack("<qq", ref, parent) if version == 2 else struct.pack("<qqqq", ref, 0, parent, 0)
        fixed = 8 + len(head) + 36
        length = -(-(fixed + len(raw)) // 8) * 8
        body = head + struct.pack("<qqIIIIHH", usn, 0, reason, 0, 0, attrs, len(raw), fixed)
        out += (struct.pack("<IHH", length, version, 0) + body + raw).ljust(length, b"\0")
    return out


def repaired(record: bytes, sector: int = 512) -> bytes | None:
    """A file record with the last two bytes of each sector put back from its update sequence; None if they don't agree."""
    off, n = struct.unpack_from("<HH", record, 4)
    if n < 2 or (n - 1) * sector > len(record) or off + 2 * n > len(record):
        return None
    out, mark = bytearray(record), record[off : off + 2]
    for k in range(1, n):
        end = k * sector
        if record[end - 2 : end] != mark:
            return None
        out[end - 2 : end] = record[off + 2 * k : off + 2 * k + 2]
    return bytes(out)


def runs(data: bytes) -> list[tuple[int, int | None]]:
    """(clusters, first cluster) of a run list; None for a hole."""
    out, at, place = [], 0, 0
    while at < len(data) and data[at]:
        n, o = data[at] & 15, data[at] >> 4
        if not n or at + 1 + n + o > len(data):
            raise ValueError("damaged run list")
        count = int.from_bytes(data[at + 1 : at + 1 + n], "little")
        if o:
            place += int.from_bytes(data[at + 1 + n : at + 1 + n + o], "little", signed=True)
            out.append((count, place))
        else:
            out.append((count, None))
        at += 1 + n + o
    return out


#: Attribute types of a file record.
STANDARD, NAME, DATA = 0x10, 0x30, 0x80


def file_record(record: bytes) -> tuple[dict, list[tuple]] | None:
    """What a file record says: (in_use, is_dir, base_ref, modified, size, alloc) and its names (parent_ref, name, dos only)."""
    if record[:4] != b"FILE" or (fixed := repaired(record)) is None:
        return None
    (first, flags) = struct.unpack_from("<HH", fixed, 20)
    info = {"in_use": bool(flags & 1), "is_dir": bool(flags & 2), "base_ref": struct.unpack_from("<q", fixed, 32)[0], "modified": None, "size": None, "alloc": None}
    names, at = [], first
    while at + 16 <= len(fixed):
        kind, length = struct.unpack_from("<II", fixed, at)
        if kind == 0xFFFFFFFF or length < 16 or at + length > len(fixed):
            break
        outside, name_len = fixed[at + 8], fixed[at + 9]
        if not outside:
            size, off = struct.unpack_from("<IH", fixed, at + 16)
            body = fixed[at + off : at + off + size]
            if kind == STANDARD and len(body) >= 16:
                info["modified"] = struct.unpack_from("<q", body, 8)[0]
            elif kind == NAME and len(body) >= 66:
                names.append((struct.unpack_from("<q", body)[0], stored_name(body[66 : 66 + 2 * body[64]]), body[65] == 2))
            elif kind == DATA and not name_len:
                info["size"], info["alloc"] = size, 0
        elif kind == DATA and not name_len and struct.unpack_from("<q", fixed, at + 16)[0] == 0:
            info["alloc"], info["size"] = struct.unpack_from("<qq", fixed, at + 40)
        at += length
    return info, names


def parse_file_table(records: DataFrame, id: str = "record_id", data: str = "data") -> DataFrame:
    """One row per name of each file record (one without a name if it has none); extension records keep their base_ref to be merged by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TABLE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = file_record(x) if len(x) >= 48 else None
                if got is None:
                    rows.append((i, *[None] * 9, "damaged"))
                    continue
                f, own = got
                for parent, name, dos in own or [(None, None, None)]:
                    rows.append((i, f["in_use"], f["is_dir"], f["base_ref"], parent, name, dos, f["modified"], f["size"], f["alloc"], None))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return records.where(f"{data} IS NOT NULL").select(id, data).mapInArrow(run, TABLE_SCHEMA)


def merged_file_table(rows: DataFrame) -> DataFrame:
    """`file_id, parent_ref, name, is_dir, modified, size, alloc`: extension records merged into their base record.

    Names for old systems are dropped; every other name of a file is an entry, and only the least (parent, name)
    carries the allocated size.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    c = F.col
    # the low 48 bits of a reference are the record's number
    r = rows.where("error IS NULL AND in_use").withColumn("file_id", F.when(c("base_ref") == 0, c("record_id")).otherwise(c("base_ref").bitwiseAND((1 << 48) - 1)))
    facts = r.groupBy("file_id").agg(F.max("is_dir").alias("is_dir"), F.max("modified").alias("modified"), F.max("size").alias("size"), F.max("alloc").alias("alloc"))
    names = r.where("name IS NOT NULL AND NOT dos_name").select("file_id", "parent_ref", "name").distinct()
    first = F.row_number().over(Window.partitionBy("file_id").orderBy("parent_ref", "name")) == 1
    j = names.join(facts, "file_id").withColumn("_first", first)
    return j.select("file_id", "parent_ref", "name", "is_dir", "modified", "size", F.when(c("_first"), c("alloc")).otherwise(F.lit(0)).cast("long").alias("alloc"))
