"""Capture files in ranges: every split gives the packets of one pass from the first header to the last."""

import random
import struct

import pytest

from netloom.sources import pcap

LIMIT = 700            # longest record of these files, so that windows are small


def ip_frame(rng, data):
    if rng.random() < 0.5:
        body = struct.pack(">HHIIBBHHH", rng.randrange(65536), 80, 0, 0, 5 << 4, rng.randrange(64), 512, 0, 0) + data
        kind = 6
    else:
        body, kind = struct.pack(">HHHH", rng.randrange(65536), 53, 8 + len(data), 0) + data, 17
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, kind, 0, bytes([10, 0, 0, rng.randrange(9)]), bytes([10, 0, 0, 2]))
    return bytes(12) + rng.choice([b"\x08\x00", b"\x81\x00\x00\x01\x08\x00"]) + head + body


def record(order, second, part, frame):
    return struct.pack(order + "IIII", second, part, len(frame), len(frame)) + frame


def payload(rng, order, nested):
    """Random bytes, zeros, or (a share of them) records of another capture that end where this frame ends."""
    if rng.random() < 0.25:
        return bytes(rng.randrange(400))
    if rng.random() < nested:
        return b"".join(record(order, 1000 + i, i, rng.randbytes(rng.randrange(1, 40))) for i in range(rng.randrange(1, 6)))
    return rng.randbytes(rng.randrange(300))


def classic(rng, n, order="<", nano=False, nested=0.3):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}
    scale = 1000 if nano else 1
    out = magic[order, nano] + struct.pack(order + "HHiIII", 2, 4, 0, 0, LIMIT, 1)
    return out + b"".join(record(order, 1000 + i // 9, i % 9 * 1000 * scale, ip_frame(rng, payload(rng, order, nested))) for i in range(n))


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def sections(rng, n, orders="<", nested=0.3):
    """Sections with interfaces of different clocks, some described only after packets of another one."""
    out = b""
    for section, order in enumerate(orders):
        out += block(order, pcap.SECTION, struct.pack(order + "IHHq", pcap.ORDER_MARK, 1, 0, -1))
        out += block(order, pcap.INTERFACE, struct.pack(order + "HHI", 1, 0, LIMIT))
        for i in range(n):
            if i == n // 2:
                options = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HHq", 14, 8, 50) + struct.pack(order + "HH", 0, 0)
                out += block(order, pcap.INTERFACE, struct.pack(order + "HHI", 1, 0, LIMIT) + options)
            second = i > n // 2 and rng.random() < 0.5
            ticks = (1000 + section * 100 + i) * (10 ** 9 if second else 10 ** 6) + i
            frame = ip_frame(rng, payload(rng, order, nested))
            out += block(order, pcap.ENHANCED, struct.pack(order + "IIIII", int(second), ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)
            if rng.random() < 0.1:
                out += block(order, 5, bytes(12))     # statistics
    return out


def places(content):
    file = pcap._Bytes(content)
    form = pcap.form_of(file, "x")
    walk = pcap.Walk(file, "x", form, form.first, len(content))
    return form, [p for _, _, place, *_ in walk.blocks() for p in place.tolist()]


@pytest.fixture
def small_records(monkeypatch):
    monkeypatch.setattr(pcap, "LONGEST", LIMIT)


@pytest.mark.parametrize("order,nano", [("<", False), (">", True)])
def test_an_entry_is_a_record_or_open(small_records, order, nano):
    rng = random.Random(1)
    content = classic(rng, 300, order, nano, nested=0.02)
    form, true = places(content)
    assert len(true) == 300
    found = 0
    for start in range(24, len(content), 37):
        at = pcap.entry(pcap._Bytes(content), form, start, len(content))
        if at is not None:
            assert at == min(p for p in true + [10 ** 9] if p >= start)
            found += 1
    assert found > 20


def test_block_entries(small_records):
    rng = random.Random(2)
    content = sections(rng, 200)
    file = pcap._Bytes(content)
    form, _ = places(content)
    blocks, at = set(), 0
    while at < len(content):
        blocks.add(at)
        at += struct.unpack_from("<I", content, at + 4)[0]
    found = 0
    for start in range(1, len(content), 53):
        at = pcap.entry(file, form, start, len(content))
        if at is not None:
            assert at == min(p for p in blocks if p >= start)
            found += 1
    assert found > 0.8 * len(content) / 53


def normal(df):
    return [tuple(r) for r in df.orderBy("seq").select(
        "seq", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "pkt_len", "payload").collect()]


def test_ranges_give_the_rows_of_one_pass(spark, tmp_path, small_records):
    rng = random.Random(3)
    files = {"a.pcap": classic(rng, 200), "b.pcap": classic(rng, 150, ">", True), "c.pcapng": sections(rng, 60, "<"),
             "d.pcapng": sections(rng, 40, "<><"), "e.pcap": classic(rng, 3), "f.pcap": classic(rng, 50)[:-7],
             "g.pcap": classic(rng, 0), "h.pcapng": sections(rng, 30, ">")[:-9]}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    whole = normal(pcap.read_packets(spark, str(tmp_path)))
    assert len(whole) == 200 + 150 + 60 + 120 + 3 + 50 + 29
    assert [s >> 40 for s, *_ in whole] == sorted(s >> 40 for s, *_ in whole)
    assert normal(pcap.read_packets(spark, str(tmp_path), range_bytes=3000)) == whole
    lean = pcap.read_packets(spark, str(tmp_path), range_bytes=5000, payload=False)
    assert [r[:-1] for r in normal(lean)] == [r[:-1] for r in whole] and {r[-1] for r in normal(lean)} == {None}
    times = sorted({t // 1_000_000 for s, t, *_ in whole if s >> 40 == 3})
    assert times[0] == 1000 and 1239 < times[-1] <= 1239 + 50      # the third section, on the interface with an offset


def test_capture_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.5 GB: records of 256 KB, most of them holes."""
    frame = ip_frame(random.Random(4), b"payload")
    size, n = 262_000, 10_000
    with open(tmp_path / "big.pcap", "wb") as file:
        file.write(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, size, 1))
        for i in range(n):
            file.seek(24 + i * (16 + size))
            file.write(struct.pack("<IIII", 1000 + i, 7, size, size) + frame)
        file.truncate(24 + n * (16 + size))
    packets = pcap.read_packets(spark, str(tmp_path), range_bytes=256 << 20, payload=False).select("seq", "ts_us")
    got = [(r["seq"], r["ts_us"]) for r in packets.orderBy("seq").collect()]
    assert got == [(24 + i * (16 + size), (1000 + i) * 1_000_000 + 7) for i in range(n)]
