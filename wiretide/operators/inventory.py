"""Host inventory: addresses in order of first sight, with vendor, sub-addresses, gateway and role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..functions.addresses import mac_prefix

#: Roles, what a role rests on, and the number of requests that makes it medium.
CLIENT, SERVER, BOTH, UNDETERMINED = "Modbus client", "Modbus server", "Modbus client and server", "undetermined"
BY_VENDOR_TABLE, BY_UNIT_IDS, BY_DIRECTION, BY_COUNT = "oui-lookup", "multiple-unit-ids", "modbus-traffic-direction", "event-count-and-direction"
MEDIUM_FROM = 3
NO_REQUESTS = "Zero Modbus events associated with this address in this capture (requests sent: 0, requests received: 0)."

HOST = ["capture_id", "ip"]


def hosts(segments: DataFrame) -> DataFrame:
    """(capture_id, ip, place, first_mac, mac): mac is null if it was at first sight or changed later.

    A segment shows its sender before its receiver; place orders both over the capture.
    """
    sides = F.array(
        F.struct((F.col("packet_number") * 2).alias("place"), F.col("src_ip").alias("ip"), F.col("src_mac").alias("mac")),
        F.struct((F.col("packet_number") * 2 + 1).alias("place"), F.col("dst_ip").alias("ip"), F.col("dst_mac").alias("mac")),
    )
    seen = segments.select("capture_id", F.explode(sides).alias("s")).select("capture_id", "s.*")
    # Distinct addresses are few: one aggregation gives the first and the range of all that were seen.
    found = seen.groupBy(*HOST).agg(F.min("place").alias("first_place"), F.min_by(F.struct("mac"), "place").alias("first"), F.min("mac").alias("low"), F.max("mac").alias("high"))
    first = F.col("first.mac")
    steady = first.isNotNull() & (F.col("low") == F.col("high"))
    return found.select(*HOST, F.col("first_place").alias("place"), first.alias("first_mac"), F.when(steady, first).alias("mac"))


def requests(events: DataFrame) -> DataFrame:
    """(capture_id, ip, sent, received, unit_ids) over requests of all protocols."""
    asked = events.filter("direction = 'request'")
    sides = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("sent"), F.lit(0).alias("received"), F.lit(None).cast("int").alias("unit")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("sent"), F.lit(1).alias("received"), F.col("unit_id").alias("unit")),
    )
    rows = asked.select("capture_id", F.explode(sides).alias("s")).select("capture_id", "s.*")
    return rows.groupBy(*HOST).agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.array_sort(F.collect_set("unit")).alias("unit_ids"))


def inventory(segments: DataFrame, events: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """One row of provenance cells for each host, plus capture_id and place.

    vendors: (prefix, vendor), or none if there is no vendor table. The vendor is that of the first
    address seen, whatever comes later. A gateway is never ruled out: one unit id proves nothing.
    """
    rows = hosts(segments).join(requests(events), HOST, "left")
    rows = rows.withColumns({"sent": F.coalesce("sent", F.lit(0)), "received": F.coalesce("received", F.lit(0))})
    if vendors is None:
        rows = rows.withColumn("vendor", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("prefix", mac_prefix(F.col("first_mac"))).join(vendors.select("prefix", "vendor"), "prefix", "left")
    sent, received = F.col("sent"), F.col("received")
    units = F.coalesce(F.size("unit_ids"), F.lit(0))
    has_units, many = units > 0, units > 1
    role = F.when((sent > 0) & (received > 0), BOTH).when(sent > 0, CLIENT).when(received > 0, SERVER).otherwise(UNDETERMINED)
    evidence = F.when(sent + received == 0, NO_REQUESTS).otherwise(F.format_string("Modbus requests sent by this address: %d; Modbus requests received by this address: %d.", sent, received))
    medium = (sent + received >= MEDIUM_FROM) & ((sent == 0) | (received == 0))
    known = lambda ok, method: F.when(ok, method).otherwise(P.NOT_DERIVABLE)
    return rows.select(
        "capture_id",
        "place",
        P.observed(F.col("ip")).alias("ip"),
        P.cell(F.col("mac"), known(F.col("mac").isNotNull(), P.OBSERVED)).alias("mac"),
        P.cell(F.col("vendor"), known(F.col("vendor").isNotNull(), f"inferred:{BY_VENDOR_TABLE}")).alias("oui_vendor"),
        P.cell(F.when(has_units, F.col("unit_ids")), known(has_units, P.OBSERVED)).alias("unit_ids"),
        P.cell(F.when(many, F.lit(True)), known(many, f"inferred:{BY_UNIT_IDS}")).alias("gateway"),
        P.cell(role, known(sent + received > 0, f"inferred:{BY_DIRECTION}")).alias("role"),
        P.observed(evidence).alias("role_evidence"),
        P.inferred(F.when(medium, "medium").otherwise("low"), BY_COUNT).alias("role_confidence"),
    )
