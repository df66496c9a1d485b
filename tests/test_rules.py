"""Single rules: octets, recognisers, registries, standards, provenance, text."""

import pytest
from pyspark.sql import functions as F

import captures as K
from wiretide.functions import provenance as P
from wiretide.functions import text as T
from wiretide.functions.addresses import mac_prefix, normalize_mac_prefix
from wiretide.functions.octets import crc16, crc16_of
from wiretide.functions.ranking import number_by_position
from wiretide.operators import checks, coverage, decode, inventory, recognise, records, standards, textscan
from wiretide.plans import analysis, plugins, registry, report
from wiretide.sources import capture, textfiles, vendors


def ask(spark, payloads, *columns):
    rows = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(payloads)], "k int, payload binary")
    out = rows.select("k", F.hex("payload").alias("h"), F.decode("payload", "ISO-8859-1").alias("t"))
    return [tuple(r)[1:] for r in out.select("k", *columns).orderBy("k").collect()]


def test_checksum(spark):
    assert crc16_of(b"") == 0xFFFF and crc16_of(b"\x02\x07") == 0x1241
    assert ask(spark, [b"\x02\x07", K.RTU], crc16(F.col("h"), F.lit(2))) == [(0x1241,), (crc16_of(K.RTU[:2]),)]


def test_modbus_shapes(spark):
    h = F.col("h")
    payloads = [K.adu(1, K.WRITE), K.adu(1, K.WRITE, protocol=1), K.adu(1, K.WRITE, length=9), b"", b"\0" * 7, K.RTU, K.RTU[:-1] + b"\0", b"\x01\x91" + crc16_of(b"\x01\x91").to_bytes(2, "little"), b"\0\x06" + crc16_of(b"\0\x06").to_bytes(2, "little")]
    got = ask(spark, payloads, recognise.mbap_valid(h), recognise.rtu_valid(h))
    assert got == [(True, False), (False, False), (False, False), (False, False), (False, False), (False, True), (False, False), (False, True), (False, False)]


def test_cleartext_shapes(spark):
    got = ask(
        spark,
        [b"\xff\xfb\x01", b"\xff\xf9\x01", b"USER x\r\n", b"user x\r\n", b"QUIT\r\n", b"USERX", b"220-hi", b"220hi", b"GET / HTTP/1.1", b"GET /\nHTTP/1.1 xx", b"HTTP/1.1 200 OK", b"HTTP/1.1 OK okay", b"TRACE / HTTP/1.1"],
        recognise.telnet_basis(F.col("h")),
        recognise.ftp_basis(F.col("t")),
        recognise.http_basis(F.col("t")),
    )
    assert [next((x for x in r if x), None) for r in got] == ["telnet-iac-negotiation", None, "ftp-control-verb", None, "ftp-control-verb", None, "ftp-reply-code", None, "http-request-line", None, "http-status-line", None, None]


def packets_of(spark, tmp_path, data, **options):
    (tmp_path / "c.pcap").write_bytes(data)
    return decode.tcp_packets(capture.read_capture(spark, tmp_path / "c.pcap"), **options)


def test_padding_counts_as_payload(spark, tmp_path):
    bare = K.frame(K.C, K.S, 1, 2, K.ACK, 0, 0)
    data = K.pcap([(0, bare + b"\0" * 6)])
    assert bytes(packets_of(spark, tmp_path, data).first().payload) == b"\0" * 6
    assert bytes(packets_of(spark, tmp_path, data, trailer_is_payload=False).first().payload) == b""


def test_other_traffic_is_left_out(spark, tmp_path):
    good = K.frame(K.C, K.S, 1, 2, K.PA, 0, 0, b"x")
    tagged = good[:12] + b"\x81\x00\x00\x07" + good[12:]
    udp = good[:23] + b"\x11" + good[24:]
    fragment = good[:20] + b"\x00\x01" + good[22:]
    found = packets_of(spark, tmp_path, K.pcap([(0, good), (1, tagged), (2, udp), (3, fragment), (4, b"\0" * 20), (5, b"")])).orderBy("packet_number").collect()
    assert [(r.packet_number, r.src_ip, r.src_mac, bytes(r.payload)) for r in found] == [(1, "192.0.2.10", K.C[1], b"x"), (2, "192.0.2.10", K.C[1], b"x")]


def test_dense_numbers_over_cells(spark):
    rows = spark.createDataFrame([("a", p) for p in (5, 900, 17, 901, 3000)] + [("b", 2)], "c string, p long")
    got = number_by_position(rows, "c", "p", "n", cell=100).orderBy("c", "p").collect()
    assert [(r.c, r.n) for r in got] == [("a", k) for k in range(5)] + [("b", 0)]


def test_hosts_keep_their_first_address(spark):
    schema = "capture_id string, packet_number long, src_ip string, dst_ip string, src_mac string, dst_mac string"
    seg = spark.createDataFrame([("c", 1, "a", "b", "m1", None), ("c", 2, "a", "b", "m2", "m3"), ("c", 3, "d", "a", "m4", "m1")], schema)
    got = {r.ip: (r.first_mac, r.mac) for r in inventory.hosts(seg).collect()}
    assert got == {"a": ("m1", None), "b": (None, None), "d": ("m4", "m4")}


def test_polling_uses_file_order(spark):
    events = spark.createDataFrame([("c", 0, 1, "request", "p", 5.0), ("c", 0, 2, "request", "p", 3.0), ("c", 0, 3, "response", "p", 9.0), ("c", 1, 4, "request", "p", 1.0)], "capture_id string, session_id long, packet_number long, direction string, protocol string, timestamp double")
    cycles = coverage.polling_cycles(events)
    assert [(r.session_id, r.measured_cycle_s, r.request_count) for r in cycles.collect()] == [(0, -2.0, 2)]
    windows = spark.createDataFrame([("c", 4.0)], "capture_id string, duration_s double")
    two = spark.createDataFrame([("c", 0, 2.0, 2), ("c", 1, 2.1, 2), ("c", 2, 0.0, 2)], "capture_id string, session_id long, measured_cycle_s double, request_count long")
    assert [r.session_id for r in coverage.short_windows(two, windows).collect()] == [1]


def test_registry_rules(spark, tmp_path):
    folder = tmp_path / "probe"
    folder.mkdir()
    (folder / "manifest.toml").write_text('id = "probe"\nconfidence = "high"\ndissector = "code:find"\n')
    (folder / "code.py").write_text("from pyspark.sql import functions as F\ndef find(s):\n    return s.select('capture_id', 'packet_number', 'session_id', F.lit('low').alias('confidence'))\n")
    found = registry.discover_dissectors(tmp_path)
    assert [d.id for d in found] == ["probe"] and registry.discover_dissectors(tmp_path / "none") == []
    segments = spark.createDataFrame([("c", 1, 0)], "capture_id string, packet_number long, session_id long")
    high, low = registry.run_dissectors(segments, found)
    assert [(r.protocol, r.confidence) for r in high.collect()] == [("probe", "high")] and low.count() == 0
    (folder / "code.py").write_text("class First:\n    def segment(self, row):\n        return [row] if row['packet_number'] == 1 else None\n")
    (folder / "manifest.toml").write_text('id = "probe"\nconfidence = "low"\ndissector = "code:First"\n')
    assert [tuple(r)[:5] for r in registry.run_dissectors(segments, registry.discover_dissectors(tmp_path))[1].collect()] == [("c", 1, 0, "probe", "low")]
    (folder / "manifest.toml").write_text('id = "probe"\nconfidence = "sure"\ndissector = "code:find"\n')
    with pytest.raises(registry.PluginError):
        registry.discover_dissectors(tmp_path)
    with pytest.raises(registry.PluginError):
        registry.load_function("../code:find", folder / "manifest.toml")


def row_plugins():
    """Local classes travel to the workers with their code."""

    class Pace:
        """Counts segments and says how many there were at the end of a session."""

        def __init__(self):
            self.count, self.last = 0, None

        def segment(self, row):
            assert self.last is None or self.last["packet_number"] < row["packet_number"] and self.last["session_id"] == row["session_id"]
            self.count, self.last = self.count + 1, row

        def end(self):
            yield {"packet_number": self.last["packet_number"], "session_id": self.last["session_id"], "transaction_id": self.count}

    class Nameless:
        def segment(self, row):
            yield {"packet_number": row["packet_number"]}

    class FirstEvent:
        done = False

        def event(self, event):
            if not self.done:
                self.done = True
                yield {"evidence": event, "title": "own"}

    return Pace, Nameless, FirstEvent


Pace, Nameless, FirstEvent = row_plugins()


def test_plugins_are_table_functions(spark):
    rows = spark.range(60_000).select(F.lit("c").alias("capture_id"), (60_000 - F.col("id")).alias("packet_number"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(3).cast("long").alias("session_id"))
    name = plugins.register(spark, "pace-1", plugins.dissector_function("pace-1", "high", Pace))
    got = {r.session_id: (r.packet_number, r.transaction_id, r.protocol) for r in spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}))", rows=rows).collect()}
    want = {r.session_id: (r.last, r.n, "pace-1") for r in rows.groupBy("session_id").agg(F.max("packet_number").alias("last"), F.count("*").alias("n")).collect()}
    assert name == "pace_1" and got == want
    with pytest.raises(Exception, match="without packet_number or session_id"):
        registry.run_dissectors(rows, [registry.row_dissector("x", "low", Nameless)])[1].collect()
    with pytest.raises(Exception, match="needs the columns"):
        registry.run_dissectors(rows.drop("session_id"), [registry.row_dissector("x", "low", Pace)])[1].collect()


CHECK = """
id = "probe"
title = "t"
severity = "low"
rationale = "r"
evaluator = "code:find"
remediation = "m"
[applies_to]
protocol = "x"
[[standards]]
standard = "IEC-62443-3-3"
clause = "SR 4.1"
"""


def test_checks_from_files(spark, tmp_path):
    (tmp_path / "probe.toml").write_text(CHECK)
    (tmp_path / "code.py").write_text("from pyspark.sql import functions as F\ndef find(events):\n    return events.select('capture_id', 'packet_number', 'session_id', F.lit('high').alias('severity'))\n")
    specs = registry.discover_checks(tmp_path)
    specs["plain"] = {**specs["probe"], "evaluate": registry.row_check("plain", FirstEvent)}
    (tmp_path / "c.pcap").write_bytes(K.pcap(K.exchange()))
    found = analysis.analyze(spark, tmp_path / "c.pcap", specs=specs).analysis["findings"]
    assert [(f["check_id"], f["title"], f["severity"], f["risk"]) for f in found] == [("plain", "own", "low", "minor"), ("probe", "t", "high", "serious"), ("probe", "t", "high", "serious")]
    assert found[0]["evidence"]["source"] == "192.0.2.10:50000" and found[0]["standard_refs"][0]["clause"] == "SR 4.1"
    (tmp_path / "again.toml").write_text(CHECK)
    with pytest.raises(registry.PluginError, match="taken"):
        registry.discover_checks(tmp_path)


def test_catalogue_from_files(tmp_path):
    (tmp_path / "catalog.toml").write_text('[[entries]]\nstandard = "S"\nedition = "1"\nclause = "c"\nclause_title = "t"\nclause_title_source = "own"\nparaphrase = "p"\nverified = false\nparaphrase_note = "n"\n')
    assert registry.load_catalogue(tmp_path)[0]["clause"] == "c" and "paraphrase_note" not in registry.load_catalogue(tmp_path)[0]


def test_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("Größe")
    (tmp_path / "y.bin").write_bytes(b"\xff\xfe")
    got = {r.path: r.content for r in textfiles.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {str(tmp_path / "a/x.txt"): "Größe", str(tmp_path / "y.bin"): None}


def test_standards(spark):
    entry = {"standard": "S", "edition": "1", "clause": "c", "clause_title": "t", "clause_title_source": "own", "paraphrase": "p", "verified": False}
    known = standards.catalogue(spark, [entry, {**entry, "clause": "d"}])
    refs = "finding_id int, standards array<struct<standard:string,clause:string>>"
    cited = standards.cite(spark.createDataFrame([(1, [("S", "d"), ("S", "c"), ("S", "d")])], refs), known).first()
    assert [r.clause for r in cited.standard_refs] == ["d", "c"]
    with pytest.raises(Exception, match="no catalogue entry"):
        standards.cite(spark.createDataFrame([(1, [("S", "x")])], refs), known).collect()
    for bad in ({**entry, "verified": 0}, {**entry, "verified": True}, {**entry, "clause": ""}, {**entry, "clause_title_source": "web"}):
        with pytest.raises(standards.CatalogueError):
            standards.checked(bad, "test")


def test_risk(spark):
    assert checks.severity_to_risk("high") == "serious"
    with pytest.raises(ValueError):
        checks.severity_to_risk("huge")
    with pytest.raises(Exception, match="unknown severity"):
        spark.range(1).select(checks.risk_of(F.lit("huge"))).collect()


def test_provenance_gate(spark):
    good = spark.range(1).select(P.observed(F.lit(1)).alias("a"), P.not_derivable("string").alias("b"))
    P.assert_complete(good, "x")
    with pytest.raises(P.ProvenanceError, match=r"x\.c"):
        P.assert_complete(good.withColumn("c", F.lit(1)), "x")
    with pytest.raises(P.ProvenanceError, match=r"x\.a"):
        P.assert_complete(good.withColumn("a", P.cell(F.lit(1), "guessed")), "x")
    assert [(r.field, r["count"], r.total) for r in P.not_derivable_counts(good, "x").collect()] == [("b", 1, 1)]


def test_vendor_tables(spark):
    assert vendors.parse_table("# c\n\n001C06\tA\n00-1c-06\tB\n") == {"001C06": "B"}
    for text in ("001C06", "zz1C06\tA"):
        with pytest.raises(vendors.VendorTableError, match="row 1"):
            vendors.parse_table(text)
    rows = vendors.read_registry(spark, "Assignment,Organization Name\n001C06, A  B \nxx,C\n001C06,D\n001C07,\n")
    table, skipped = vendors.build_table(rows)
    assert [tuple(r) for r in table.collect()] == [("001C06", "D")] and skipped.first()[0] == 2
    assert vendors.table_text([("b", "2"), ("a", "1")], "s", "d").splitlines()[2:] == ["# Entries: 2", "a\t1", "b\t2"]
    macs = ["00:1c:06:aa", "001c.06", "0:1", "zz:zz:zz"]
    frame = spark.createDataFrame([(m,) for m in macs], "m string")
    assert [r[0] for r in frame.select(mac_prefix(F.col("m"))).collect()] == [normalize_mac_prefix(m) for m in macs] == ["001C06", "001C06", None, None]


def scan(spark, text, path="a.txt", **options):
    files = spark.createDataFrame([(path, text)], "path string, content string")
    return sorted((r.line or 0, r.rule_id) for r in textscan.scan_files(files, **options).collect())


def test_text_layers(spark):
    clause = "The operator shall keep every controller behind a wall as clause 4.2.1 of the text asks"
    assert scan(spark, f"x\n{clause}\n") == [(2, textscan.CLAUSE_RULE)]
    assert scan(spark, clause.replace("4.2.1", "v4.2")) == [] and scan(spark, "must 4.2") == []
    assert scan(spark, clause, allow=textscan.AllowList("*.TXT")) == []
    lines = "host 10.1.2.3 and 10.1.2.3\nfar 110.1.2.3 8.8.8.8\nmac 00-1C-06-27-64-11\nplc-12 Plc_3 plcx\nRailGuard_Sentinel"
    want = [(1, textscan.IPV4_RULE)] * 2 + [(3, textscan.MAC_RULE)] + [(4, textscan.DEVICE_RULE)] * 2 + [(5, textscan.PROJECT_RULE)]
    assert scan(spark, lines) == want
    allow = textscan.AllowList("identity-value:10.1.2.3\nidentity-value:00:1c:06:27:64:11\nidentity-path:all:b*\nidentity-path:identity-device-name:A.*")
    assert scan(spark, lines, allow=allow) == [(5, textscan.PROJECT_RULE)]
    assert scan(spark, lines, "b.txt", allow=allow) == []
    assert scan(spark, "Größe des Geheimwörts", literals=["geheimwort"]) == [(1, textscan.LITERAL_RULE)]
    assert scan(spark, None, "Standards\\.local\\x.bin") == [(0, textscan.PATH_RULE)]
    for bad in ("identity-value:8.8.8.8", "identity-path:nothing:x", "identity-what:x", "identity-path:all"):
        with pytest.raises(textscan.AllowListError):
            textscan.AllowList(bad)


def test_corpus_runs_over_line_ends(spark):
    corpus = spark.createDataFrame([("c", "one two three four five six seven eight nine ten eleven twelve")], "path string, content string")
    text = "zero\nOne two three four five six\nseven, eight nine ten eleven twelve one\n"
    assert scan(spark, text, corpus=corpus) == [(2, textscan.CORPUS_RULE)]


def plain_runs(files, corpus, size=12):
    """(path, line) where a run of words begins that the corpus has too, word by word."""
    import re

    spoken = lambda text: [(w, k) for k, line in enumerate(text.splitlines(), 1) for w in re.findall(r"[^\W]+", line.lower())]
    known = {tuple(w for w, _ in x[k : k + size]) for text in corpus for x in [spoken(text)] for k in range(len(x) - size + 1)}
    return sorted({(path, x[k][1]) for path, text in files for x in [spoken(text)] for k in range(len(x) - size + 1) if tuple(w for w, _ in x[k : k + size]) in known})


@pytest.mark.parametrize(("limit", "block"), [(2_000_000, "300"), (0, "300"), (0, "100m")])
def test_files_of_many_blocks_are_scanned_as_whole_ones(spark, tmp_path, monkeypatch, limit, block):
    import random

    r = random.Random(7)
    word = lambda: f"w{r.randrange(30)}"
    corpus = [" ".join(word() for _ in range(40)) for _ in range(4)]
    files = []
    for n in range(5):
        text = ""
        for _ in range(40):
            passage = r.choice(corpus).split()
            some = passage[r.randrange(20) :][: r.randrange(8, 30)] if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 30))]
            text += "".join(w + r.choice([" ", " ", " ", "\n", "\r\n", "\r", " ", "\n\n", " é\u0085"]) for w in some)
        files.append((f"{tmp_path}/text/{n}.txt", text))
    (tmp_path / "text").mkdir()
    for path, text in files:
        with open(path, "wb") as file:
            file.write(text.encode())
    (tmp_path / "text/bad.txt").write_bytes(b"\xff\xfe " + corpus[0].encode())
    table = spark.createDataFrame([("c", x) for x in corpus], "path string, content string")
    monkeypatch.setattr(textscan.shingles.known, "__defaults__", (limit,))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        pieces, blocks = textfiles.numbered_pieces(spark, f"file://{tmp_path}/text")
        got = sorted((r.path, r.line) for r in textscan.scan_corpus_pieces(pieces, blocks, table).collect())
        read = sorted((r.path, r.line, r.text) for r in textfiles.read_lines(spark, f"file://{tmp_path}/text").filter("readable").collect())
        assert (pieces.select("path", "block").distinct().count() > 12) == (block != "100m")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == plain_runs(files, corpus) and len(got) > 50
    # An empty line may follow a file's last line end, if that is no line feed.
    want = [(path, k, line) for path, text in files for k, line in enumerate(text.splitlines(), 1) if line]
    assert [x for x in read if x[2]] == sorted(want)
    whole = spark.createDataFrame(files, "path string, content string")
    assert sorted((r.path, r.line) for r in textscan.scan_corpus(whole, table).collect()) == got


@pytest.mark.parametrize("sent", [1000, 10])
def test_literals_are_looked_up_by_pieces(spark, sent):
    import random

    r = random.Random(8)
    text = ["".join(r.choice("abcde ") for _ in range(r.randrange(60))) for _ in range(200)]
    literals = {"".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(300)}
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "path string, line int, folded string")
    terms = spark.createDataFrame([(x,) for x in literals], "term string")
    found = textscan.literal_lines(rows, terms, sent)
    assert sorted((x.line, x.term) for x in found.collect()) == sorted((k, x) for k, t in enumerate(text) for x in literals if x in t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folding_keeps_letters_that_do_not_decompose(spark):
    frame = spark.createDataFrame([("ŁÓDŹ",), ("plain A",), (None,)], "t string")
    assert [r.f for r in T.with_folded(frame, "t", "f").collect() if r.t == "ŁÓDŹ"] == ["łodz"]
    files = spark.createDataFrame([("r", "It is fully compliant, SL 3, 90 / 100")], "path string, content string")
    assert {r.rule_id for r in textscan.forbidden_phrases(files).collect()} == {"compliant-en", "security-level-acronym", "numeric-indicator"}


def test_phrases_near_each_other_count_apart(spark):
    dense = "compliance and compliance, compliance"
    files = spark.createDataFrame([("a", dense), ("b", "ł" * 40 + " compliance " + "x" * 40), ("c", "none"), ("d", None)], "path string, content string")
    got = sorted((r.path, r.rule_id, r.context) for r in textscan.forbidden_phrases(files).collect())
    assert got == [("a", "compliance-en", dense)] * 3 + [("b", "compliance-en", "ł" * 29 + " compliance " + "x" * 29)]


def test_mentions_of_addresses_equal_their_sql(spark, tmp_path):
    import duckdb

    texts = ["1.2.3.4 5.6.7.8", "1.2.3.4\n5.6.7.8\n9.9.9.9\n", "1.2.3.4, 5.6.7.8", "\u2026 \u20261.2.3.4", "\u00bd1.2.3.4\u00bd", "1.2.3.4.5.6.7.8", ".1.2.3.4", "v1.2.3.4.", "\u24601.2.3.4\u2028", "none", "", None, "1.2.3.4\r\n"]
    rows = [(k // 2, text) for k, text in enumerate(texts)] + [(None, "1.2.3.4")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in textscan.ipv4_mentions(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(textscan.contract_sql()["ipv4_mentions"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cells_of_nested_documents():
    cell = lambda v, p="observed": {"value": v, "provenance": p}
    document = {"a": [{"x": cell(1), "deep": {"y": [cell({"value": 2, "provenance": "no"}, P.NOT_DERIVABLE)]}}], "b": cell(None)}
    assert [(p, c["value"]) for p, c in P.walk(document)] == [("a[0].x", 1), ("a[0].deep.y[0]", {"value": 2, "provenance": "no"}), ("b", None)]
    assert report.not_derivable({"assets": [{"x": cell(None, P.NOT_DERIVABLE), "in": {"x": cell(None, P.NOT_DERIVABLE)}}, {"x": cell(1)}]}) == [{"section": "assets", "field": "x", "count": 2, "total": 2}]


def test_markers_of_nested_columns(spark):
    one = P.observed(F.lit(1))
    rows = spark.range(2).select(F.struct(one.alias("x"), F.array(one, P.not_derivable("int"), P.cell(F.lit(1), "guessed")).alias("list")).alias("top"), F.array(F.struct(one.alias("in"))).alias("b"))
    assert list(P.fields(rows.schema)) == [("top.x", True), ("top.list[]", True), ("b[].in", True)]
    assert {tuple(r) for r in P.markers(rows).collect()} == {("top.x", "observed", 2), ("top.list[]", "observed", 2), ("top.list[]", P.NOT_DERIVABLE, 2), ("top.list[]", "guessed", 2), ("b[].in", "observed", 2)}
    with pytest.raises(P.ProvenanceError, match=r"x.top.list\[\]"):
        P.assert_complete(rows, "x")
    with pytest.raises(P.ProvenanceError, match="bare"):
        P.assert_complete(rows.withColumn("bare", F.struct(F.lit(1).alias("n"))), "x")


def test_differences_go_both_ways(spark):
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    got = {tuple(r) for r in records.differences(names("a", "a", "b", None), names("b", "c")).collect()}
    assert got == {("a", "left"), (None, "left"), ("c", "right")}
    assert records.differences(names(), names()).count() == 0
    assert [tuple(r) for r in records.stopped(names("Some-Bot", "robot", None, ""), ["bot", "tbd"]).collect()] == [("Some-Bot", ["bot"])]


def test_gaps_over_the_bounds_of_cells(spark, monkeypatch):
    monkeypatch.setattr(coverage, "CELL", 3)
    rows = [("c", 1, n, "p", float(t), "request") for n, t in ((1, 0), (2, 1), (4, 9), (7, 10), (8, 5), (11, 6))] + [("c", 2, 3, "p", 1.0, "request")]
    events = spark.createDataFrame(rows, "capture_id string, session_id long, packet_number long, protocol string, timestamp double, direction string")
    assert [tuple(r) for r in coverage.polling_cycles(events).collect()] == [("c", 1, 8.0, 6)]


def test_differences_of_documents(spark):
    from wiretide.operators import documents

    put = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, json string")
    left = put('{"a": 1, "b": {"c": [1, {"d": null}], "e": []}, "f": [{"n": 1, "v": "x"}, {"n": 2, "v": "y"}]}', '{"same": [1.5, true, "t"]}', None)
    right = put('{"a": 2, "b": {"c": [1, {"d": 3}], "e": [7]}, "f": [{"n": 2, "v": "z"}, {"n": 3}]}', '{"same": [1.5, true, "t"]}', "{}")
    got = sorted(tuple(r) for r in documents.differences(left, right, "id", "json", {"f": "n"}).collect())
    want = [(0, "a", "changed", "1", "2"), (0, "b/c/1/d", "changed", "null", "3"), (0, "b/e", "missing", "[]", None), (0, "b/e/0", "added", None, "7")]
    want += [(0, "f/[n=1]/n", "missing", "1", None), (0, "f/[n=1]/v", "missing", '"x"', None), (0, "f/[n=2]/v", "changed", '"y"', '"z"'), (0, "f/[n=3]/n", "added", None, "3"), (2, "", "added", None, "{}")]
    assert got == sorted(want)
    assert documents.differences(left, left, "id", "json").count() == 0
    assert {r.path for r in documents.differences(left, right, "id", "json", {"f": "n"}, ["f/", "b"]).filter("id = 0").collect()} == {"a"}
    shapes = {(r.path, r.state) for r in documents.same_shape(put('{"a": 1, "l": [{"x": 1}], "n": null}'), put('{"a": "1", "l": [{"x": 2.5}, {"y": 1}], "n": 4}'), "id", "json").collect()}
    assert shapes == {("a", "kind"), ("l/*/y", "added")}


def test_differences_exchange_texts_and_no_leaves(spark):
    from wiretide.operators import documents

    put = lambda *rows: spark.createDataFrame(rows, "id long, json string")
    left, right = put((1, r'{"a\\\"{[": [1, {"b": "]"}], "e": {}}'), (None, '{"x": 1}')), put((1, '{"e": { }}'), (None, '{"x": 1}'))
    found = documents.differences(left, right, "id", "json")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.id or 0, r.state, r.left or r.right) for r in found.collect()) == [(0, "added", "1"), (0, "missing", "1"), (1, "missing", '"]"'), (1, "missing", "1")]
    texts = ["1", "{}", "[ ]", '{"a": [{ }]}', '["{[\\"{", [[2]]]', r'["\\", [1]]']
    assert [r.d for r in put(*enumerate(texts)).orderBy("id").select(documents.depth(F.col("json")).alias("d")).collect()] == [0, 0, 0, 2, 3, 2]


def test_folding_takes_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert T.with_folded(spark.createDataFrame([("\u00e9",)], "t string"), "t", "f").columns == ["t", "f"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(T.ARROW_ROWS)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(T.ARROW_BYTES)
