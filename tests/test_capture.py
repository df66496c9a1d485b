"""Audit, error kinds, reading, and the accepted results of whole analyses."""

import json
import struct

import pytest
from pyspark.sql import functions as F

import captures as K
from wiretide import cli
from wiretide.plans import analysis, report
from wiretide.sources import capture as C
from wiretide.sources import datasource as D


@pytest.fixture
def put(tmp_path):
    def write(data: bytes, name="x.pcap"):
        path = tmp_path / name
        path.write_bytes(data)
        return path

    return write


def test_audit_of_sound_files(put):
    found = C.audit(put(K.pcap(K.exchange())))
    assert (found.capture_format, found.endianness, found.record_count, found.snaplen) == ("pcap", "little", 2, 65535)
    found = C.audit(put(K.pcapng(K.exchange()), "x.pcapng"))
    assert (found.capture_format, found.record_count, found.snaplen) == ("pcapng", 2, 65535)
    assert len(K.pcap(K.exchange())) == 188 and len(K.pcapng(K.exchange())) == 248
    assert C.audit(put(K.pcap([], 262144))).is_structurally_empty
    assert C.audit(put(K.pcap(K.exchange(), 54, 54))).snaplen_truncated_packet_numbers == (1, 2)


@pytest.mark.parametrize(
    ("data", "kind"),
    [
        (b"\xd4\xc3", C.CaptureTruncated),
        (K.pcap([])[:20], C.CaptureTruncated),
        (K.pcap(K.exchange())[:-10], C.CaptureTruncated),
        (K.pcap([]) + b"12345", C.CaptureTruncated),
        (K.corrupted(), C.CaptureCorrupt),
        (K.pcapng(K.exchange())[:-10], C.CaptureTruncated),
        (K.block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + K.block(1, b"1234"), C.CaptureTruncated),
        (K.pcapng(K.exchange())[:-4] + b"\1\0\0\0", C.CaptureCorrupt),
        (b"\x0a\x0d\x0d\x0a" + b"\x1c\0\0\0" + b"abcd", C.CaptureFormat),
        (b"not a capture", C.CaptureFormat),
    ],
)
def test_damage_is_told_apart(put, data, kind):
    with pytest.raises(kind) as error:
        C.audit(put(data))
    assert type(error.value) is kind


def test_snap_length_needs_agreement(put):
    assert C.audit(put(K.pcapng([], (100, 100)))).snaplen == 100
    for interfaces in ((), (100, 200)):
        found = C.audit(put(K.pcapng([], interfaces)))
        assert found.snaplen is None and found.snaplen_note


def test_reading_in_chunks_keeps_numbers(spark, put):
    path = put(K.pcap(K.poll(50201, [0, 1, 2, 3, 4, 5])))
    whole = C.read_capture(spark, path).orderBy("packet_number").collect()
    pieces = C.read_capture(spark, path, chunk_bytes=100)
    assert pieces.rdd.getNumPartitions() > 3
    assert pieces.orderBy("packet_number").collect() == whole
    assert [r.packet_number for r in whole] == list(range(1, 13))
    assert whole[1].ts == pytest.approx(K.EPOCH + 0.01, abs=1e-6)
    with pytest.raises(FileNotFoundError):
        C.read_capture(spark, path.parent / "absent.pcap")


def test_damaged_files_are_read_to_the_damage(spark, put, capsys):
    whole, ng = K.pcap(K.exchange()), K.pcapng(K.exchange())
    frames = lambda path: [bytes(r.frame) for r in C.read_capture(spark, path).orderBy("packet_number").collect()]
    one, two = (f for _, f in K.exchange())
    assert frames(put(whole[:-10])) == [one, two[:-10]] and frames(put(whole + b"1234")) == [one, two]
    assert frames(put(ng[:-10], "a.pcapng")) == [one] and frames(put(K.pcap([]), "none.pcap")) == []
    assert cli.main(["inspect", str(put(whole[:-10], "short.pcap"))]) == 0
    assert "Packet count: 2" in capsys.readouterr().out
    assert cli.main(["inspect", str(put(b"nothing here", "no.pcap"))]) == 2


def test_audit_of_many_files_and_other_stores(spark, put, tmp_path):
    put(K.pcap(K.exchange(), 54, 54), "a.pcap"), put(K.corrupted(), "b.pcap"), put(K.pcapng(K.exchange(), (1, 2)), "c.pcapng"), put(b"", "d.pcap"), put(b"x", "e.txt")
    files = C.list_files(spark, str(tmp_path))
    rows = {r.capture_id: r for r in C.audit_files(spark, files).collect()}
    assert [rows[k].error for k in sorted(rows)] == [None, "CaptureCorrupt", None, "CaptureTruncated"]
    assert (rows["a.pcap"].snaplen_truncated_packet_count, rows["a.pcap"].snaplen_truncated_first_packet_number) == (2, 1)
    assert rows["c.pcapng"].snaplen is None and rows["c.pcapng"].snaplen_note
    # A path that open() doesn't know comes through Spark's binary source.
    far = {r.capture_id: r for r in C.audit_files(spark, [(f"file://{p}", n) for p, n in files]).collect()}
    assert {k: r.sha256 for k, r in far.items()} == {k: r.sha256 for k, r in rows.items()}
    with pytest.raises(C.CaptureCorrupt):
        analysis.analyze_all(spark, [tmp_path])


def test_packets_of_another_store(spark, put, monkeypatch):
    path = put(K.pcap(K.poll(50201, range(6))))
    near = C.read_capture(spark, path).orderBy("packet_number").collect()
    monkeypatch.setattr(C, "list_files", lambda spark, p: [(f"file://{p}", 2000)])
    far = C.read_captures(spark, [path], 300)
    assert far.rdd.getNumPartitions() == 7 and far.orderBy("packet_number").collect() == near


def test_data_source_reads_folders(spark, put, tmp_path):
    put(K.pcap(K.exchange()), "a.pcap"), put(K.pcapng(K.exchange()), "b.pcapng")
    D.register(spark)
    rows = spark.read.format("capture").load(str(tmp_path)).collect()
    assert sorted((r.capture_id, r.packet_number) for r in rows) == [("a.pcap", 1), ("a.pcap", 2), ("b.pcapng", 1), ("b.pcapng", 2)]


def test_checksums_of_a_data_set(spark, put, tmp_path):
    import hashlib

    put(b"one", "a.bin"), put(b"two", "b.bin"), put(b"three", "c.bin")
    sums = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest().upper()), ("b.bin", "00"), ("z.bin", "11")], "name string, sha256 string")
    assert {r.name: r.state for r in C.verify_checksums(spark, str(tmp_path), sums).collect()} == {"a.bin": "ok", "b.bin": "differs", "c.bin": "unexpected", "z.bin": "missing"}


def busy(order="<", count=400, interfaces=None, seed=1, share=0.4):
    """Classic or pcapng bytes (where interfaces are given) with payloads that look like records themselves."""
    import random

    r = random.Random(seed)
    inner = K.pcap([(k, bytes(r.randrange(1, 60))) for k in range(6)])
    frames = [inner[r.randrange(24) :] if r.random() < share else bytes(r.randrange(256) for _ in range(r.randrange(0, 90))) for _ in range(count)]
    if interfaces is None:
        out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 600, 1)
        return out + b"".join(struct.pack(order + "IIII", 1000 + k, k, len(f), len(f) + (k % 7 == 0)) + f for k, f in enumerate(frames)), frames
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + b"".join(block(1, struct.pack(order + "HHI", link, 0, 500)) for link in interfaces)
    for k, f in enumerate(frames):
        if k == count // 2:
            out += block(1, struct.pack(order + "HHI", 147, 0, 500)) + block(4, b"name")
        interface = k % (len(interfaces) + (k >= count // 2))
        out += block(6, struct.pack(order + "IIIII", interface, 0, 10**6 + k, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out, frames


def columns(rows):
    return [(r.packet_number, round(r.ts, 6), r.caplen, r.wirelen, r.linktype, bytes(r.frame)) for r in sorted(rows, key=lambda r: r.packet_number)]


@pytest.mark.parametrize("kind", ["little", "big", "blocks", "two orders"])
@pytest.mark.parametrize("chunk", [50, 333, 4096])
def test_ranges_of_a_file_give_what_one_walk_gives(spark, put, kind, chunk):
    if kind in ("little", "big"):
        data, frames = busy("<" if kind == "little" else ">", 120)
    elif kind == "blocks":
        data, frames = busy("<", 120, (1, 101))
    else:
        (a, f), (b, g) = busy(">", 60, (1,)), busy("<", 60, (101, 1), 2)
        data, frames = a + b, f + g
    path = put(data, "x.pcap")
    whole = columns(C.read_capture(spark, path, 1 << 20).collect())
    assert [r[-1] for r in whole] == frames and len({r[4] for r in whole}) == (1 if kind in ("little", "big") else 3)
    assert columns(C.read_capture(spark, path, chunk).collect()) == whole
    one, many = (C.audit_files(spark, [(str(path), len(data))], n).first().asDict() for n in (1 << 20, chunk))
    assert one == many and (one["error"] is not None) == (kind == "two orders")
    if kind == "little":
        assert (many["packet_count"], many["snaplen_truncated_packet_count"], many["snaplen_truncated_first_packet_number"]) == (120, 18, 1)
        assert C.audit(path).snaplen_truncated_packet_numbers == tuple(range(1, 121, 7))


@pytest.mark.parametrize("interfaces", [None, (1,)])
def test_damage_is_the_same_however_a_file_is_cut(spark, put, interfaces):
    data, _ = busy("<", 60, interfaces)
    for name, broken in (("cut", data[:-7]), ("long", data[:900] + b"\xff" * 300 + data[1200:]), ("tail", data + b"\1\2\3")):
        path = put(broken, f"{name}.pcap")
        want = C.audit_files(spark, [(str(path), len(broken))]).first()
        assert want.error and C.audit_files(spark, [(str(path), len(broken))], 100).first() == want
        assert columns(C.read_capture(spark, path, 100).collect()) == columns(C.read_capture(spark, path).collect())


def test_guesses_hold_the_true_entry():
    data, _ = busy("<", 300, share=0)
    head = C.read_head(C.reader("", data), len(data))
    starts = [24]
    while starts[-1] < len(data):
        starts.append(starts[-1] + 16 + struct.unpack_from("<I", data, starts[-1] + 8)[0])
    hits = [min(s for s in starts if s >= base) in [at for at, _ in C.guesses(head, data[base : base + 5000], base)] for base in range(1000, len(data) - 6000, 997)]
    assert sum(hits) > 0.9 * len(hits)


def test_index_prunes_ranges(spark, put, tmp_path):
    data, frames = busy("<", 500)
    path = put(data)
    put(busy(">", 40)[0], "y.pcap")
    D.register(spark)
    D.index_captures(spark, [tmp_path], f"{tmp_path}/index", 1000)
    source = spark.read.format("capture").option("index", f"{tmp_path}/index").load()
    assert columns(source.filter("capture_id = 'x.pcap'").collect()) == columns(C.read_capture(spark, path).collect())
    assert source.rdd.getNumPartitions() > 20
    few = source.filter("capture_id = 'x.pcap' and packet_number between 101 and 110")
    assert 1 <= few.rdd.getNumPartitions() <= 4 and [bytes(r.frame) for r in few.orderBy("packet_number").collect()] == frames[100:110]
    late = source.filter("ts >= 1490")
    assert late.rdd.getNumPartitions() <= 3 and late.count() == 10
    reader = D.CaptureReader({"index": f"{tmp_path}/index"}, ["packet_number"])
    everything = sum(p.chunk["stop"] - p.chunk["start"] for p in reader.partitions())
    assert list(reader.pushFilters([D.EqualTo(("packet_number",), 3)])) and sum(p.chunk["stop"] - p.chunk["start"] for p in reader.partitions()) < everything / 5
    narrow = spark.read.format("capture").schema("packet_number long, ts double").option("path", str(path)).load()
    assert narrow.columns == ["packet_number", "ts"] and narrow.filter("packet_number > 490").count() == 10
    assert source.filter("packet_number > 100000").count() == 0


def test_slice_round_trip(spark, put, tmp_path):
    packets = C.read_capture(spark, put(K.pcap(K.exchange() + K.rtu())))
    out = tmp_path / "slice.pcap"
    assert D.write_pcap(C.slice_packets(packets, 1, 2), out) == 2
    again = C.read_capture(spark, out).orderBy("packet_number").collect()
    assert [bytes(r.frame) for r in again] == [K.exchange()[1][1], K.rtu()[0][1]]


def test_written_parts_are_named_by_the_commit(spark, put, tmp_path):
    data, frames = busy("<", 200)
    packets = C.read_capture(spark, put(data), 2000)
    out = tmp_path / "out"
    D.register(spark)
    packets.repartitionByRange(5, "packet_number").sortWithinPartitions("packet_number").write.format("capture").mode("append").save(str(out))
    parts = sorted(p.name for p in out.iterdir())
    assert len(parts) == 5 and parts[0] == "part-00000.pcap"
    assert [bytes(r.frame) for p in parts for r in sorted(C.read_capture(spark, out / p).collect(), key=lambda r: r.packet_number)] == frames
    one = tmp_path / "one.pcap"
    assert D.write_pcap(packets, one, 600) == 200
    assert [bytes(r.frame) for r in C.read_capture(spark, one, 3000).orderBy("packet_number").collect()] == frames
    bad = packets.withColumn("linktype", F.when(F.col("packet_number") == 150, 7).otherwise(F.col("linktype")))
    for target in (tmp_path / "failed", one):
        with pytest.raises(Exception, match="one link type"):
            bad.repartition(3).write.format("capture").option("single", "true").mode("overwrite").save(str(target))
    assert not (tmp_path / "failed").exists() and len(C.audit(one).snaplen_truncated_packet_numbers) == 29
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one.pcap", "out", "x.pcap"]
    with pytest.raises(Exception):
        packets.write.format("capture").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == parts


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """An analysis of each fixture."""
    folder = tmp_path_factory.mktemp("captures")
    made = {
        "write": K.pcap(K.exchange()),
        "port": K.pcap(K.exchange(10502)),
        "malformed": K.pcap(K.malformed()),
        "empty": K.pcap([], 262144),
        "cut": K.pcap(K.exchange(), 54, 54),
        "short": K.pcap(K.poll(50200, [0, 5])),
        "long": K.pcap(K.poll(50201, range(6))),
        "gateway": K.pcap(K.gateway()),
        "handshake": K.pcap(K.handshake()),
        "rtu": K.pcap(K.rtu()),
        "cleartext": K.pcap(K.cleartext()),
        "reads": K.pcap(K.poll(50300, [0, 0.02, 0.04])),
    }
    for name, data in made.items():
        (folder / f"{name}.pcap").write_bytes(data)
    found = analysis.analyze_all(spark, sorted(folder.iterdir()))
    return {name.removesuffix(".pcap"): result for name, result in found.items()}


def test_write_is_found_twice(results):
    a = results["write"].analysis
    assert [(f["check_id"], f["evidence"]["packet_number"], f["evidence"]["session_id"]) for f in a["findings"]] == [("modbus-unauthenticated-write", 1, 0), ("unauthenticated-industrial-protocol", 1, 0)]
    assert [e["direction"] for e in a["protocol_events"]] == ["request", "response"]
    assert [h["ip"]["value"] for h in a["assets"]] == ["192.0.2.10", "192.0.2.20"]
    assert a["capture"]["packet_count"] == 2 and set(a) == {"capture", "conversations", "protocol_events", "zones", "conduits", "findings", "methodology", "assets", "coverage", "low_confidence_events", "comm_matrix"}
    assert a["findings"][0]["standard_refs"][0]["clause"] == "SR 1.1" and a["findings"][0]["risk"] == "serious"
    assert len(results["port"].analysis["findings"]) == 2


def test_what_is_not_recognised(results):
    assert results["malformed"].analysis["protocol_events"] == []
    assert results["malformed"].analysis["comm_matrix"][0]["protocol"] == {"value": "tcp", "provenance": "observed"}
    assert results["empty"].analysis["assets"] == [] and results["empty"].warnings[0].startswith("The capture is well formed")
    assert any("cut 2 of 2 frames" in w for w in results["cut"].warnings)


def test_coverage_names_both_numbers(results):
    assert any("5.01 seconds" in w and "5.0 seconds" in w for w in results["short"].warnings)
    assert not any("polling" in w for w in results["long"].warnings)
    assert results["long"].analysis["coverage"]["polling_cycles"] == [{"session_id": 0, "measured_cycle_s": 1.0, "request_count": 6}]


def test_gateway_and_role(results):
    hosts = {h["ip"]["value"]: h for h in results["gateway"].analysis["assets"]}
    assert hosts["192.0.2.30"]["unit_ids"] == {"value": [1, 2, 3], "provenance": "observed"}
    assert hosts["192.0.2.30"]["gateway"] == {"value": True, "provenance": "inferred:multiple-unit-ids"}
    assert hosts["192.0.2.10"]["gateway"]["value"] is None and hosts["192.0.2.10"]["role"]["value"] == "Modbus client"
    assert hosts["192.0.2.10"]["role_confidence"]["value"] == "medium"


def test_handshake_tells_the_initiator(results):
    row = results["handshake"].analysis["comm_matrix"][0]
    assert row["initiator"] == {"value": "192.0.2.10:50400", "provenance": "observed"} and row["packet_count"]["value"] == 5
    assert results["handshake"].analysis["conversations"][0]["packet_count"] == 2


def test_serial_frames_stay_apart(results):
    a = results["rtu"].analysis
    assert (len(a["protocol_events"]), len(a["low_confidence_events"]), a["findings"]) == (0, 2, [])
    assert a["comm_matrix"][0]["protocol"]["value"] == "modbus-rtu-over-tcp"


def test_cleartext_and_reads(results):
    a = results["cleartext"].analysis
    assert [f["check_id"] for f in a["findings"]] == ["cleartext-protocol"] * 3
    assert next(e for e in a["protocol_events"] if e["protocol"] == "ftp")["src_ip"] == "192.0.2.20"
    assert next(e for e in a["protocol_events"] if e["protocol"] == "ftp")["direction"] == "request"
    assert "testpass123" not in report.dump(a)
    assert [f["check_id"] for f in results["reads"].analysis["findings"]] == ["unauthenticated-industrial-protocol"]


def test_command_line(put, tmp_path, capsys):
    path = put(K.pcap(K.exchange()))
    assert cli.main(["inspect", str(path)]) == 0
    assert "Packet count: 2" in capsys.readouterr().out
    for k in range(2):
        assert cli.main(["analyze", str(path), "--out-dir", str(tmp_path / f"out{k}")]) == 0
    one, two = ((tmp_path / f"out{k}" / "analysis.json").read_bytes() for k in range(2))
    assert one == two and json.loads(one)["capture"]["filename"] == "x.pcap"
    text = (tmp_path / "out0" / "report.md").read_text()
    assert [text.index(f"## {s}") for s in report.SECTIONS] == sorted(text.index(f"## {s}") for s in report.SECTIONS)
    assert cli.main(["analyze", str(put(K.corrupted(), "bad.pcap")), "--out-dir", str(tmp_path / "none")]) == 5
    assert cli.main(["analyze", str(put(b"nothing here", "no.pcap")), "--out-dir", str(tmp_path / "none")]) == 4
    assert cli.main(["analyze", str(put(K.pcap(K.exchange())[:-10], "cut.pcap")), "--out-dir", str(tmp_path / "none")]) == 3
    assert cli.main(["analyze", str(tmp_path / "absent.pcap"), "--out-dir", str(tmp_path / "none")]) == 2
    assert not (tmp_path / "none").exists()


def test_examples_are_the_same_each_time(results, tmp_path):
    from datetime import datetime, timezone

    when, made = datetime(2024, 1, 2, tzinfo=timezone.utc), []
    for k in range(2):
        (tmp_path / str(k)).mkdir()
        made.append([p.read_bytes() for p in report.example(results["gateway"].analysis, tmp_path / str(k), when, results["gateway"].warnings)])
    assert made[0] == made[1] and b"2024-01-02" in made[0][1]
    kinds = [kind for kind, _ in report.blocks(made[0][1].decode())]
    assert kinds.count("table") == 1 and kinds.count("head") > 8
    rows = next(lines for kind, lines in report.blocks(made[0][1].decode()) if kind == "table")
    assert len(rows) == 1 + len(results["gateway"].analysis["comm_matrix"]) and {len(r) for r in rows} == {8}


def test_sections_are_written_by_the_workers(spark, results, tmp_path):
    analysis.write_sections(results["gateway"].tables, str(tmp_path / "out"))
    kept = spark.read.schema("capture_id string, section string, place string, row string").json(str(tmp_path / "out")).filter("capture_id = 'gateway.pcap'")
    rows = {}
    for r in kept.orderBy("section", "place").collect():
        rows.setdefault(r.section, []).append(json.loads(r.row))
    a = results["gateway"].analysis
    assert rows["assets"] == a["assets"] and rows["comm_matrix"] == a["comm_matrix"] and rows["conversations"] == a["conversations"]
    assert rows["protocol_events"] == a["protocol_events"] and rows["findings"] == a["findings"]
    assert rows["polling_cycles"] == a["coverage"]["polling_cycles"]


def test_vendor_table_from_a_registry_file(spark, tmp_path, capsys):
    from wiretide.sources import vendors

    (tmp_path / "oui.csv").write_text('Registry,Assignment,Organization Name,Organization Address\nMA-L,0A0001,"One,  ""Inc""",x\nMA-L,zz,None,x\nMA-L,0a-00-02,Two,"a\nb"\nMA-L,0A0001,Last,x\nMA-L,0A0003,,x\n')
    assert cli.main(["vendors", str(tmp_path / "oui.csv"), str(tmp_path / "out.tsv")]) == 0
    said = capsys.readouterr()
    assert "Entries: 2" in said.out and said.err.strip().endswith("name: 2")
    assert {tuple(r) for r in vendors.load_table(spark, str(tmp_path / "out.tsv")).collect()} == {("0A0001", "Last"), ("0A0002", "Two")}
    assert cli.main(["vendors", str(tmp_path / "absent.csv"), str(tmp_path / "no.tsv")]) == 2 and not (tmp_path / "no.tsv").exists()


def test_guard_command(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    run = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    (tmp_path / "standards/.local").mkdir(parents=True)
    (tmp_path / "standards/.local/c.txt").write_text(run)
    (tmp_path / "a.txt").write_text(f"x\n{run}\nhost 10.0.0.7\n")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    assert cli.main(["guard", "a.txt", "b.bin", "--json"]) == 1
    assert [(r["path"], r["line"], r["layer"]) for r in json.loads(capsys.readouterr().out)] == [("a.txt", 2, "corpus"), ("a.txt", 3, "identity")]
    (tmp_path / ".confidentiality-allow").write_text("identity-value:10.0.0.7\n")
    assert cli.main(["guard", "a.txt", "--no-corpus"]) == 0


def test_folder_stream(spark, tmp_path):
    from wiretide.streaming.folder import analyse_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(K.pcap(K.exchange()))
    seen = {}
    analyse_folder(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda path, t: seen.update({path: t.high.count()})).awaitTermination(60)
    assert list(seen.values()) == [2]
