"""Capture files of any size -> packet headers; a large file is read in byte ranges, each by a task of its own.

Files are listed by Spark (path and length, no content) and cut in ranges. A range starts anywhere, so its first
record has to be found. Around that byte, offsets that could be a record's header and from which a chain of such
headers runs on for longer than any record are marked. All true headers are among them; if the marked offsets form
one chain without gap or overlap, they are the true ones. Otherwise (a payload that holds records itself, records
that break the rules) the file's headers are followed from the last known one instead, so that a range never starts
at a guess. Block-structured captures carry sections and interfaces anywhere, and what a range's packets mean depends
on those before: each range lists its own, and they are carried on from range to range.

Headers are decoded in numpy arrays, some megabytes of capture at a time. A packet's place in its file orders it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netloom.operators.packets import normalise
from netloom.session import cut_lineage

HEADERS = ("path string, at bigint, frame bigint, ts_us bigint, ip_version int, ip_protocol int, src_ip string, "
           "dst_ip string, src_port bigint, dst_port bigint, tcp_flags bigint, tcp_data_offset bigint, tcp_window bigint, "
           "l4_payload_len bigint, payload binary, src_mac bigint, dst_mac bigint")   # hardware addresses as numbers
# File magics -> (byte order, fractions of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10 ** 6), b"\xa1\xb2\xc3\xd4": (">", 10 ** 6),
         b"\x4d\x3c\xb2\xa1": ("<", 10 ** 9), b"\xa1\xb2\x3c\x4d": (">", 10 ** 9)}
# Block types and the byte-order mark of block-structured captures.
SECTION, INTERFACE, SIMPLE, ENHANCED, OLD_PACKET, OTHER_BLOCKS = 0x0A0D0D0A, 1, 3, 6, 2, 0x0C00
ORDER_MARK = 0x1A2B3C4D
# Link type -> (bytes before the IP header, where the protocol is, what it is for IPv4).
LINK_ETHERNET, LINK_RAW = 1, (101, 12, 14, 228)
LINK_COOKED = {113: (16, 14, (b"\x08\x00",)), 276: (20, 0, (b"\x08\x00",)),
               0: (4, 0, (b"\x02\0\0\0", b"\0\0\0\x02")), 108: (4, 0, (b"\0\0\0\x02",))}
#: Bytes of a range, bytes read at once, and the longest record that is taken for plausible.
RANGE, BLOCK, LONGEST = 64 << 20, 4 << 20, 262_144
#: Seconds that plausible records may lie before or after the first one of their file.
EARLIER, LATER = 86_400, 10 * 366 * 86_400


class Interface(NamedTuple):
    link: int
    ticks: int          # fractions of a second in its timestamps
    offset: int         # seconds to add to them


class Form(NamedTuple):
    """How a file is written: classic (one interface for all), or blocks with the state at some place."""

    order: str
    blocks: bool
    interfaces: tuple[Interface, ...]
    snap: int
    first: int          # where the first record or block stands
    second: int         # seconds of the first record


# ---- reading ---------------------------------------------------------------------------------------


class _Bytes:
    """A capture in memory."""

    def __init__(self, content: bytes):
        self.content = content

    def read_at(self, n: int, at: int) -> bytes:
        return self.content[at:at + n]


def _open(path: str):
    """A file of any store that pyarrow knows, read by offset."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def form_of(file, path: str) -> Form:
    head = bytes(file.read_at(40, 0))
    if len(head) >= 12 and head[:4] == struct.pack(">I", SECTION):
        order = "<" if struct.unpack("<I", head[8:12])[0] == ORDER_MARK else ">"
        return Form(order, True, (), 0, 0, 0)
    order, ticks = MAGIC.get(head[:4], (None, None))
    if order is None or len(head) < 24:
        raise ValueError(f"not a classic capture file, nor a block-structured one: {path}")
    snap, link = struct.unpack(order + "II", head[16:24])
    second = struct.unpack(order + "I", head[24:28])[0] if len(head) >= 28 else 0
    return Form(order, False, (_checked(Interface(link & 0xFFFF, ticks, 0), path),), snap, 24, second)


def _checked(interface: Interface, path: str) -> Interface:
    link = interface.link
    if link != LINK_ETHERNET and link not in LINK_RAW and link not in LINK_COOKED:
        raise ValueError(f"link type {link} is not supported: {path}")
    return interface


def _interface(body: bytes, order: str, path: str) -> Interface:
    """An interface description: its link type, and resolution and offset of its clock among the options."""
    link, _, _ = struct.unpack_from(order + "HHI", body)
    at, ticks, offset = 8, 10 ** 6, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        value = body[at + 4:at + 4 + size]
        if code == 0:
            break
        if code == 9 and value:
            ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        if code == 14 and len(value) == 8:
            offset = struct.unpack(order + "q", value)[0]
        at += 4 + (size + 3) // 4 * 4
    return _checked(Interface(link, ticks, offset), path)


# ---- from record to record -------------------------------------------------------------------------


class Walk:
    """Records from ``at`` up to ``end``, a block of bytes at a time; keeps the state of sections on the way."""

    def __init__(self, file, path: str, form: Form, at: int, end: int, header_only: bool = False):
        self.file, self.path, self.form, self.at, self.end = file, path, form, at, end
        self.header_only = header_only
        self.sections: list[tuple] = []      # (order, interfaces) of each section met, the open one last

    def blocks(self) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, their place, and per packet: place of the record, start and size of the frame, microseconds, link)."""
        size = BLOCK
        while self.at < self.end:
            base, data = self.at, bytes(self.file.read_at(size, self.at))
            short = len(data) < size
            rows = self._step(data, base, short)
            if self.at == base:              # not even one record fits
                if short:
                    return
                size *= 2
                continue
            size = BLOCK
            if rows:
                place, start, kept, ts, link = np.array(rows, np.int64).T
                yield data, base, place, start, kept, ts, link

    def _step(self, data: bytes, base: int, short: bool) -> list[tuple]:
        return self._step_blocks(data, base, short) if self.form.blocks else self._step_classic(data, base, short)

    def _step_classic(self, data: bytes, base: int, short: bool) -> list[tuple]:
        rows, at, last = [], 0, min(len(data) - 16, self.end - base - 1)
        head = struct.Struct(self.form.order + "IIII").unpack_from
        (interface,), n = self.form.interfaces, len(data)
        scale, link = interface.ticks // 10 ** 6, interface.link
        while at <= last:
            second, part, kept, _ = head(data, at)
            after = at + 16 + kept
            if after > n:
                if not short:
                    break
                kept = n - at - 16           # the file ends inside its last record
            rows.append((base + at, at + 16, kept, second * 1_000_000 + part // scale, link))
            at = after
        self.at = base + at if at <= last or not short else max(base + at, self.end)
        return rows

    def _step_blocks(self, data: bytes, base: int, short: bool) -> list[tuple]:
        rows, at, n = [], 0, len(data)
        while base + at < self.end and at + 12 <= n:
            order = self.form.order
            kind, size = struct.unpack_from(order + "II", data, at)
            if kind == SECTION:
                order = "<" if struct.unpack_from("<I", data, at + 8)[0] == ORDER_MARK else ">"
                size = struct.unpack_from(order + "I", data, at + 4)[0]
            if size < 12 or size % 4:
                raise ValueError(f"no block at byte {base + at}: {self.path}")
            if at + size > n:
                if not short:
                    break
                self.at = max(base + n, self.end)  # the file ends inside its last block
                return rows
            if kind == SECTION:
                self.form = self.form._replace(order=order, interfaces=())
                self.sections.append((order, ()))
            elif kind == INTERFACE:
                new = _interface(data[at + 8:at + size - 4], order, self.path)
                self.form = self.form._replace(interfaces=self.form.interfaces + (new,))
                old = self.sections.pop() if self.sections else (None, ())
                self.sections.append((old[0], old[1] + (new,)))
            elif kind in (ENHANCED, OLD_PACKET) and not self.header_only:
                who, high, low, kept, _ = struct.unpack_from(order + ("IIIII" if kind == ENHANCED else "HxxIIII"), data, at + 8)
                interface = self.form.interfaces[who]
                ticks = high << 32 | low
                ts = interface.offset * 1_000_000 + ticks * 1_000_000 // interface.ticks
                rows.append((base + at, at + 28, min(kept, size - 32), ts, interface.link))
            elif kind == SIMPLE and not self.header_only:  # it has no time
                kept = min(struct.unpack_from(order + "I", data, at + 8)[0], size - 16)
                rows.append((base + at, at + 12, kept, 0, self.form.interfaces[0].link))
            at += size
        self.at = base + at if base + at < self.end and not (short and at + 12 > n) else max(base + at, self.end)
        return rows


def _next_record(file, form: Form, path: str, at: int, start: int) -> tuple[int, list[tuple]]:
    """The first record at or after ``start``, by the headers from the record at ``at`` on; and the sections between."""
    walk = Walk(file, path, form, at, start, header_only=True)
    for _ in walk.blocks():
        pass
    return walk.at, walk.sections


def _longest(form: Form) -> int:
    """Bytes of a frame at most: the file's own limit, unless it names none to speak of."""
    return max(form.snap, LONGEST) if form.snap <= 1 << 24 else LONGEST


def _marked(data: np.ndarray, form: Form) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that could be a record's header, and where the next one would stand."""
    n = len(data) - 16
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none
    wide = data.astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    if form.order == ">":
        four = four.byteswap()
    if form.blocks:
        at = np.arange(0, n, 1)
        size = four[4:4 + n].astype(np.int64)
        fits = (size >= 12) & (size % 4 == 0) & (size <= LONGEST + 64)
        at, size = at[fits], size[fits]
        inside = at + size + 4 <= len(four)
        same = np.ones(len(at), bool)
        same[inside] = four[(at + size - 4)[inside]] == size[inside]
        known = same & ((four[at] < OTHER_BLOCKS) | (four[at] == SECTION))
        return at[known], (at + size)[known]
    second, part, kept, whole = four[:n], four[4:4 + n], four[8:8 + n], four[12:12 + n]
    ticks = form.interfaces[0].ticks
    most = _longest(form)
    at = np.flatnonzero((part < ticks) & (kept >= 1) & (kept <= most) & (whole >= kept) & (whole <= 1 << 24)
                        & (second >= max(form.second - EARLIER, 1)) & (second <= form.second + LATER))
    return at, at + 16 + kept[at].astype(np.int64)


def entry(file, form: Form, start: int, length: int) -> int | None:
    """The first record at or after ``start``, if the bytes around it allow one reading only."""
    longest = _longest(form) + 64
    low, high = max(form.first, start - 2 * longest), min(length, start + 3 * longest)
    data = np.frombuffer(file.read_at(high - low, low), np.uint8)
    data = np.concatenate((data, np.zeros(20, np.uint8)))
    at, after = _marked(data[:high - low + 4], form)
    # from the last offset to the first: a header counts if the next one does, or lies beyond a whole record's length
    good = np.zeros(high - low + 1, bool)
    edge = high - low - (0 if high == length else longest)
    for place, then in zip(at[::-1].tolist(), after[::-1].tolist()):
        good[place] = then == high - low if high == length and then >= edge else then >= edge or good[then]
    chain = at[good[at]]
    follow = dict(zip(at.tolist(), after.tolist()))
    chain = [c for c in chain.tolist() if c < edge]
    if not chain or any(follow[a] != b for a, b in zip(chain, chain[1:])) or chain[0] > longest and low > form.first \
            or low == form.first and chain[0] != 0:
        return None
    return next((low + c for c in chain if low + c >= start), None)


# ---- decoding --------------------------------------------------------------------------------------


def decode_frames(data: bytes, start: np.ndarray, kept: np.ndarray, link: np.ndarray, payload: bool = True
                  ) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which frames are IPv4, and their header fields as arrays."""
    view = np.frombuffer(data + bytes(128), np.uint8).astype(np.int64)

    def two(at: np.ndarray) -> np.ndarray:
        return view[at] << 8 | view[at + 1]

    end, ip, ok = start + kept, start.copy(), np.ones(len(start), bool)
    ether = (link == LINK_ETHERNET) & (kept >= 14)
    for kind in np.unique(link).tolist():
        own = np.flatnonzero(link == kind)
        if kind == LINK_ETHERNET:
            fits = kept[own] >= 14
            ok[own[~fits]] = False
            own = own[fits]
            ip[own] = start[own] + 14
            proto = two(start[own] + 12)
            while len(tagged := np.flatnonzero((proto == 0x8100) | (proto == 0x88A8))):
                room = ip[own[tagged]] + 4 <= end[own[tagged]]
                proto[tagged[~room]] = 0
                tagged = tagged[room]
                proto[tagged] = two(ip[own[tagged]] + 2)
                ip[own[tagged]] += 4
            ok[own[proto != 0x0800]] = False
        elif kind in LINK_COOKED:
            size, where, wanted = LINK_COOKED[kind]
            fits = kept[own] > size
            ok[own[~fits]] = False
            own = own[fits]
            found = np.zeros(len(own), bool)
            for name in wanted:
                found |= np.all([view[start[own] + where + i] == b for i, b in enumerate(name)], axis=0)
            ok[own[~found]] = False
            ip[own] = start[own] + size
    ok &= end - ip >= 20
    ok[ok] &= view[ip[ok]] >> 4 == 4
    ip, end, ether, start = ip[ok], end[ok], ether[ok], start[ok]
    size, total = (view[ip] & 15) * 4, two(ip + 2)
    body = ip + size
    room = np.maximum(np.minimum(np.where(total == 0, end, ip + total), end) - body, 0)
    first = two(ip + 6) & 0x1FFF == 0
    proto = view[ip + 9]
    tcp, udp = (proto == 6) & first & (room >= 20), (proto == 17) & first & (room >= 8)
    known = tcp | udp
    at = np.where(known, body, 0)            # other frames may end before these places
    words = np.where(tcp, view[at + 12] >> 4, 2)
    left = np.where(known, np.maximum(room - words * 4, 0), 0)

    def numbers(values: np.ndarray, have: np.ndarray) -> pa.Array:
        return pa.array(values, pa.int64(), mask=~have)

    def addresses(at: np.ndarray) -> pa.Array:
        value, index = np.unique(two(at) << 16 | two(at + 2), return_inverse=True)
        names = pa.array([f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}" for v in value.tolist()], pa.string())
        return names.take(pa.array(index))

    def hardware(at: np.ndarray) -> pa.Array:
        place = np.where(ether, at, 0)
        return numbers(two(place) << 32 | two(place + 2) << 16 | two(place + 4), ether)

    out = {
        "ip_version": pa.array(np.full(len(ip), 4), pa.int32()),
        "ip_protocol": pa.array(np.where(known, proto, 0), pa.int32()),
        "src_ip": addresses(ip + 12), "dst_ip": addresses(ip + 16),
        "src_port": numbers(two(at), known), "dst_port": numbers(two(at + 2), known),
        "tcp_flags": numbers(view[at + 13], tcp), "tcp_data_offset": numbers(words, tcp),
        "tcp_window": numbers(two(at + 14), tcp), "l4_payload_len": pa.array(left, pa.int64()),
        "src_mac": hardware(start + 6), "dst_mac": hardware(start),
    }
    if payload:
        offsets = np.concatenate(([0], np.cumsum(left)))
        index = np.repeat(at + words * 4 - offsets[:-1], left) + np.arange(offsets[-1])
        values = np.frombuffer(data, np.uint8)[index] if len(index) else np.empty(0, np.uint8)
        bits = np.packbits(known, bitorder="little").tobytes()
        out["payload"] = pa.BinaryArray.from_buffers(
            pa.binary(), len(ip), [pa.py_buffer(bits), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    else:
        out["payload"] = pa.nulls(len(ip), pa.binary())
    return ok, out


def _batches(walk: Walk, path: str, payload: bool) -> Iterator[pa.RecordBatch]:
    names, done = [c.split()[0] for c in HEADERS.split(", ")], 0
    for data, _, place, start, kept, ts, link in walk.blocks():
        ok, columns = decode_frames(data, start, kept, link, payload)
        n = int(ok.sum())
        columns |= {"path": pa.array([path] * n, pa.string()), "at": pa.array(place[ok]), "ts_us": pa.array(ts[ok]),
                    "frame": pa.array((done + np.arange(len(ok)))[ok])}
        done += len(ok)
        yield pa.RecordBatch.from_pydict({name: columns[name] for name in names})


# ---- Spark -----------------------------------------------------------------------------------------


def decode(files: DataFrame) -> DataFrame:
    """Headers of captures in memory (path, content); (path, at) is arrival order, ``frame`` counts a file's frames."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = _Bytes(content.as_py())
                form = form_of(file, path)
                yield from _batches(Walk(file, path, form, form.first, len(file.content)), path, True)
    return files.select("path", "content").mapInArrow(run, HEADERS)


def _ranked(files: DataFrame) -> DataFrame:
    """``files`` with file_no, the rank of the path; a sort over all tasks, and one row for each task."""
    row = F.monotonically_increasing_id()
    rows = cut_lineage(files.sort("path").withColumn("row", row))
    task = F.shiftright("row", 33)
    before = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("task")) - F.col("n"))
    return (rows.withColumn("task", task).join(F.broadcast(before), "task")
            .withColumn("file_no", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1))
            .select("path", "length", "file_no"))


def byte_ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, length[, ...]) with start and end of each range of a file; an empty file has one, which names the error."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))
    return files.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size, F.col("length")))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges spread over tasks; they are rows of a few bytes, so their number does not show in sizes."""
    tasks = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * ranges.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "path", "start")


_ENTRIES = "path string, start bigint, entry bigint, state string"


def _found(path: str, start: int, end: int, length: int) -> tuple:
    """(entry or None, sections of the range as JSON): what a range's own bytes tell."""
    file = _open(path)
    form = form_of(file, path)
    at = form.first if start == 0 else entry(file, form, start, length)
    sections = []
    if at is not None and form.blocks:
        _, sections = _next_record(file, form, path, at, end)
    return at, json.dumps(sections)


def entries(ranges: DataFrame) -> DataFrame:
    """path, start, entry and state (sections open at the entry, JSON) of each range of files that have several."""
    def look(batches):
        for batch in batches:
            paths, starts, ends, lengths = (batch.column(c).to_pylist() for c in ("path", "start", "end", "length"))
            found = [_found(*row) for row in zip(paths, starts, ends, lengths)]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array(paths), "start": pa.array(starts), "end": pa.array(ends),
                "entry": pa.array([f[0] for f in found], pa.int64()), "sections": pa.array([f[1] for f in found])})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """A file's ranges in order: entries that are open follow from the one before, and sections are carried on."""
        pdf = pdf.sort_values("start")
        path, out = pdf["path"].iloc[0], []
        file = _open(path)
        form, at = form_of(file, path), None
        there = form                          # the state where the last known record stands
        for start, end, given, sections in zip(pdf["start"], pdf["end"], pdf["entry"], pdf["sections"]):
            missing = given != given or given is None
            if missing and at is not None and at < start:      # the range before ended earlier: follow its records
                at, _ = _next_record(file, there, path, at, int(start))
            elif not missing:
                at = int(given)
            there = form
            out.append((path, int(start), at, json.dumps([form.order, form.interfaces])))
            if form.blocks:
                found = _next_record(file, form, path, at, int(end))[1] if missing and at < end else json.loads(sections)
                for order, interfaces in found:
                    new = tuple(Interface(*i) for i in interfaces)
                    form = form._replace(order=order, interfaces=new) if order else form._replace(interfaces=form.interfaces + new)
        return pd.DataFrame(out, columns=["path", "start", "entry", "state"])

    asked = _dealt(ranges.select("path", "start", "end", "length"))
    seen = asked.mapInArrow(look, "path string, start bigint, end bigint, entry bigint, sections string")
    return seen.groupBy("path").applyInPandas(carry, _ENTRIES)


def read_headers(spark: SparkSession, path: str, range_bytes: int = RANGE, payload: bool = True) -> DataFrame:
    """Headers of all captures under ``path``, with file_no (rank of the path) and ``at`` (place in the file)."""
    files = _ranked(spark.read.format("binaryFile").load(path).select("path", "length"))
    ranges = byte_ranges(files, range_bytes)
    several = F.col("length") > range_bytes
    known = cut_lineage(entries(ranges.where(several)))
    tasks = ranges.join(known, ["path", "start"], "left").select("path", "file_no", "start", "end", "entry", "state")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = _open(row["path"])
                form, at = form_of(file, row["path"]), row["entry"]
                if row["state"]:
                    order, interfaces = json.loads(row["state"])
                    form = form._replace(order=order, interfaces=tuple(Interface(*i) for i in interfaces))
                for made in _batches(Walk(file, row["path"], form, form.first if at is None else at, row["end"]), row["path"], payload):
                    yield made.append_column("file_no", pa.array([row["file_no"]] * made.num_rows, pa.int64()))

    return _dealt(tasks).mapInArrow(run, HEADERS + ", file_no bigint").drop("frame")


def read_packets(spark: SparkSession, path: str, range_bytes: int = RANGE, payload: bool = True) -> DataFrame:
    """Captures under ``path`` as packet rows; files are replayed in path order.

    The high bits of ``seq`` rank the file, the low 40 bits are the record's place in it.
    """
    rows = read_headers(spark, path, range_bytes, payload)
    return normalise(rows.withColumn("seq", F.col("file_no") * F.lit(1 << 40) + F.col("at")))


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Packet rows as a stream; the schema is the contract and rate limits replace drops."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
