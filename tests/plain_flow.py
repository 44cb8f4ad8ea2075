"""A deliberately plain per-packet fold over packets: the tests' second oracle."""

from __future__ import annotations

import statistics


def _stats(values):
    if not values:
        return 0.0, 0.0, 0.0, 0.0
    spread = statistics.stdev(values) if len(values) > 1 else 0.0
    return statistics.fmean(values), spread, float(max(values)), float(min(values))


class PlainFlow:
    def __init__(self, first):
        self.packets = []
        self.first = first
        self.origin = (first["src_ip"], first["src_port"])
        self.fins = set()
        self.closed = False
        self.emissions = 0
        self.pending = 0
        self.mark = first["ts_us"]
        self.last_seen = first["ts_us"]

    def forward(self, p):
        same = (p["src_ip"], p["src_port"]) == (p["dst_ip"], p["dst_port"])
        return same or (p["src_ip"], p["src_port"]) == self.origin


def snapshot(flow, reason):
    """Recompute everything from the packet list."""
    ps = flow.packets
    start = ps[0]["ts_us"]
    sides = {"Fwd": [p for p in ps if flow.forward(p)], "Bwd": [p for p in ps if not flow.forward(p)]}
    tcp = ps[0]["protocol"] == "TCP"
    duration = max(max(p["ts_us"] for p in ps) - start, 10)
    out = {"flow_seq": ps[0]["seq"], "last_seq": ps[-1]["seq"], "reason": reason,
           "source_ip": ps[0]["src_ip"], "Source Port": ps[0]["src_port"],
           "Flow Duration": float(duration)}
    for name, rows in sides.items():
        lengths = [p["pkt_len"] for p in rows]
        times = [p["ts_us"] for p in rows]
        gaps = [b - a for a, b in zip(times, times[1:])]
        avg, std, top, low = _stats(lengths)
        out[f"{name} Packet Length Mean"], out[f"{name} Packet Length Std"] = avg, std
        out[f"{name} Packet Length Max"], out[f"{name} Packet Length Min"] = top, low
        avg, std, top, low = _stats(gaps)
        out[f"{name} IAT Total"] = float(sum(gaps))
        out[f"{name} IAT Mean"], out[f"{name} IAT Std"] = avg, std
        out[f"{name} IAT Max"], out[f"{name} IAT Min"] = top, low
        out[f"{name} Header Length"] = sum(p["header_len"] for p in rows)
        out[f"{name} Packets/s"] = len(rows) / (duration / 1e6)
    out["Total Fwd Packets"], out["Total Backward Packets"] = len(sides["Fwd"]), len(sides["Bwd"])
    out["Fwd Packets Length Total"] = sum(p["pkt_len"] for p in sides["Fwd"])
    out["Bwd Packets Length Total"] = sum(p["pkt_len"] for p in sides["Bwd"])
    times = [p["ts_us"] for p in ps]
    gaps = [b - a for a, b in zip(times, times[1:])]
    (out["Flow IAT Mean"], out["Flow IAT Std"], out["Flow IAT Max"], out["Flow IAT Min"]) = _stats(gaps)
    doubled = [ps[0]["pkt_len"]] + [p["pkt_len"] for p in ps]
    (out["Packet Length Mean"], out["Packet Length Std"], out["Packet Length Max"], _) = _stats(doubled)
    out["Packet Length Variance"] = statistics.variance(doubled)
    out["Avg Packet Size"] = sum(doubled) / len(ps)
    for name, bit in (("FIN", 1), ("SYN", 2), ("PSH", 8), ("ACK", 16), ("URG", 32)):
        out[f"{name} Flag Count"] = sum(1 for p in ps if tcp and p["flags"] & bit)
    out["Fwd PSH Flags"] = int(tcp and bool(ps[0]["flags"] & 8))
    out["Init Fwd Win Bytes"] = ps[0]["win_size"] if tcp else -1
    out["Init Bwd Win Bytes"] = (sides["Bwd"][-1]["win_size"] if sides["Bwd"] else 0) if tcp else -1
    out["Fwd Act Data Packets"] = sum(1 for p in sides["Fwd"] if p["payload_len"] > 0)
    out["Fwd Seg Size Min"] = min(p["header_len"] or 20 for p in sides["Fwd"])
    active, idle = [], []
    since = until = start
    for p in ps:
        if p["ts_us"] - until > 5_000_000:
            if until > since:
                active.append(until - since)
            idle.append(p["ts_us"] - until)
            since = p["ts_us"]
        until = max(until, p["ts_us"])
    for name, values in (("Active", active), ("Idle", idle)):
        (out[f"{name} Mean"], out[f"{name} Std"], out[f"{name} Max"], out[f"{name} Min"]) = _stats(values)
    sample = b"".join(p.get("payload") or b"" for p in ps)[:512]
    out["payload_sample"] = sample.decode("latin1")
    return out


def fold(packets, inactivity_us, emit_after_us, emit_packets, grace_us=1_000_000):
    """All snapshots and the sequence numbers of dropped ACKs."""
    flows, armed, out, dropped = {}, {}, [], []
    for p in sorted(packets, key=lambda p: p["seq"]):
        p = dict(p)
        p.setdefault("payload_len", p["pkt_len"])
        here, there = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        way, back = (here, there, p["protocol"]), (there, here, p["protocol"])
        key = (frozenset((here, there)), p["protocol"])
        now, flags = p["ts_us"], p["flags"] if p["protocol"] == "TCP" else 0
        if way in armed:
            plain = p["protocol"] == "TCP" and flags & 63 == 16 and not p["pkt_len"] and not p["payload_len"]
            if plain and now <= armed[way]:
                dropped.append(p["seq"])
                continue
            del armed[way]
        flow = flows.get(key)
        if flow and inactivity_us is not None and now - flow.last_seen > inactivity_us:
            if flow.pending:
                out.append(snapshot(flow, "ended"))
            flow = None
        if flow is None:
            flow = flows[key] = PlainFlow(p)
        flow.packets.append(p)
        flow.pending += 1
        flow.last_seen = max(flow.last_seen, now)
        if flags & 1:
            flow.fins.add(flow.forward(p))
        flow.closed = len(flow.fins) == 2 or any(q["flags"] & 4 for q in flow.packets if flags)
        reason = None
        if flow.closed:
            reason = "terminated"
        elif flow.fins and not flow.emissions:
            reason = "first_fin"
        elif flow.pending >= emit_packets:
            reason = "packets"
        elif now - flow.mark >= emit_after_us:
            reason = "time"
        if reason:
            out.append(snapshot(flow, reason))
            flow.emissions += 1
            flow.pending, flow.mark = 0, now
        if flow.closed:
            if len(flow.fins) == 2 and not flags & 4:
                armed[back] = now + grace_us
            del flows[key]
    out.extend(snapshot(flow, "ended") for flow in flows.values() if flow.pending)
    return out, dropped
