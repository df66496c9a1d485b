"""Capture files built byte by byte: Ethernet, IPv4, TCP and Modbus, in pcap and pcapng."""

import struct

EPOCH = 1_700_000_000
C, S, G = ("192.0.2.10", "02:00:00:00:00:01"), ("192.0.2.20", "02:00:00:00:00:02"), ("192.0.2.30", "02:00:00:00:00:03")
WRITE, READ, READ_REPLY = bytes.fromhex("060001002A"), bytes.fromhex("0300000001"), bytes.fromhex("030200AA")
RTU = bytes.fromhex("01060001002A59D5")
FIN, SYN, ACK, PA = 1, 2, 16, 24


def checksum(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def frame(src, dst, sport, dport, flags, seq, ack, payload=b"") -> bytes:
    a, b = (bytes(map(int, x[0].split("."))) for x in (src, dst))
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 8192, 0, 0) + payload
    tcp = tcp[:16] + struct.pack(">H", checksum(a + b + struct.pack(">BBH", 0, 6, len(tcp)) + tcp)) + tcp[18:]
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0) + a + b
    ip = ip[:10] + struct.pack(">H", checksum(ip)) + ip[12:]
    mac = lambda x: bytes.fromhex(x[1].replace(":", ""))
    return mac(dst) + mac(src) + b"\x08\x00" + ip + tcp


def adu(tx: int, pdu: bytes, unit: int = 1, protocol: int = 0, length: int | None = None) -> bytes:
    return struct.pack(">HHHB", tx, protocol, len(pdu) + 1 if length is None else length, unit) + pdu


def pcap(packets, snaplen=65535, cut=None) -> bytes:
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, 1)
    for offset, data in packets:
        micros = EPOCH * 10**6 + round(offset * 10**6)
        kept = data[:cut]
        out += struct.pack("<IIII", micros // 10**6, micros % 10**6, len(kept), len(data)) + kept
    return out


def block(kind: int, body: bytes) -> bytes:
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def interface(snaplen=65535) -> bytes:
    return block(1, struct.pack("<HHI", 1, 0, snaplen))


def pcapng(packets, interfaces=(65535,)) -> bytes:
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + b"".join(map(interface, interfaces))
    for offset, data in packets:
        micros = EPOCH * 10**6 + round(offset * 10**6)
        out += block(6, struct.pack("<IIIII", 0, micros >> 32, micros & 0xFFFFFFFF, len(data), len(data)) + data + b"\0" * (-len(data) % 4))
    return out


def exchange(port=502, sport=50000):
    return [(0.0, frame(C, S, sport, port, PA, 1, 0, adu(1, WRITE))), (0.01, frame(S, C, port, sport, PA, 1, 1, adu(1, WRITE)))]


def poll(sport, times):
    out = []
    for i, t in enumerate(times):
        out.append((t, frame(C, S, sport, 502, PA, 2 * i + 1, 2 * i, adu(i + 1, READ))))
        out.append((t + 0.01, frame(S, C, 502, sport, PA, 2 * i + 1, 2 * i + 2, adu(i + 1, READ_REPLY))))
    return out


def cleartext():
    f = [(C, S, 49600, 23, b"\xff\xfb\x01"), (S, C, 23, 49600, b"\xff\xfd\x01"), (S, C, 21, 49601, b"220 Test FTP service ready\r\n"), (C, S, 49601, 21, b"USER testuser\r\n"), (C, S, 49601, 21, b"PASS testpass123\r\n")]
    f += [(C, S, 49602, 8080, b"GET /status.json HTTP/1.1\r\nHost: x\r\n\r\n"), (S, C, 8080, 49602, b"HTTP/1.1 200 OK\r\n\r\n")]
    return [(0.01 * k, frame(a, b, p, q, PA, 1, 0, d)) for k, (a, b, p, q, d) in enumerate(f)]


def handshake():
    p = 50400
    return [(0.0, frame(C, S, p, 502, SYN, 0, 0)), (0.01, frame(S, C, 502, p, SYN | ACK, 0, 1)), (0.02, frame(C, S, p, 502, ACK, 1, 1)), (0.03, frame(C, S, p, 502, PA, 1, 1, adu(1, WRITE))), (0.04, frame(S, C, 502, p, PA, 1, 1, adu(1, WRITE)))]


def gateway():
    out = []
    for k in range(3):
        out.append((0.01 * k, frame(C, G, 50300, 502, PA, 1, 0, adu(k + 1, READ, k + 1))))
        out.append((0.01 * k + 0.005, frame(G, C, 502, 50300, PA, 1, 1, adu(k + 1, READ_REPLY, k + 1))))
    return out


def malformed():
    return [(0.0, frame(C, S, 50001, 502, PA, 1, 0, adu(1, WRITE, protocol=1))), (0.01, frame(C, S, 50002, 502, PA, 1, 0, adu(2, WRITE, length=999)))]


def rtu():
    return [(0.0, frame(C, S, 50500, 10502, PA, 1, 0, RTU)), (0.01, frame(S, C, 10502, 50500, PA, 1, 1, RTU))]


def corrupted() -> bytes:
    data = pcap(exchange())
    return data[:32] + struct.pack("<I", 300000) + data[36:]
