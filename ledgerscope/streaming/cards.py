"""Rules about cards on a stream: swarms and impossible journeys, found as rows arrive."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerscope.functions import geo
from ledgerscope.operators.predicates import has_card, not_refund
from ledgerscope.operators.rings import identities
from ledgerscope.operators.typology import Rule

FOUND = (
    "hashed_pan string, kind string, source_txn_id string, merchant_id string, occurred_at timestamp, touched long, apart long, "
    "from_source_txn_id string, from_merchant_id string, minutes double, km double, kmh double"
)
_EVENT = "struct<t:long,id:string,merchant:string,values:array<string>,lat:double,lon:double>"
_STATE = f"waiting array<{_EVENT}>, alive array<{_EVENT}>, last {_EVENT}, swarmed long"
_DAY = 86_400_000_000


def card_rows(rows: DataFrame, merchants: DataFrame, places: DataFrame) -> DataFrame:
    """Card rows of a stream of the ledger, each with its merchant's registration values (three at most) and place."""
    values = identities(merchants).groupBy("merchant_id").agg(F.collect_list(F.concat_ws("=", "attribute", "value")).alias("values"))
    known = merchants.select("merchant_id").join(values, "merchant_id", "left").join(geo.locate(merchants, places), "merchant_id", "left")
    live = rows.where(not_refund() & has_card()).select("hashed_pan", "merchant_id", "source_txn_id", "occurred_at")
    return live.join(known, "merchant_id", "left")


def _km(a: dict, b: dict) -> float:
    la, lb = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def watch(rows: DataFrame, swarm: Rule, travel: Rule, late: str = "30 minutes") -> DataFrame:
    """Hits of ``card_rows`` as FOUND: a card's first swarm of each day, and every leg that is too fast.

    A card's rows wait until the watermark has passed them, so that they are judged in order of time
    whatever the order of arrival; rows later than ``late`` are not judged. The state of a card holds
    its waiting rows, for each merchant of the last window its last visit, and its last row; it ends
    when the watermark has passed both rules' spans. A swarm's window ends at the hit's transaction.
    """
    reach, least = int(swarm.value("window_minutes") * 60_000_000), swarm.value("min_merchants")
    fastest, nearest, longest = travel.value("max_kmh"), travel.value("min_km"), travel.value("max_minutes")
    span_ms = int(max(reach / 1000, longest * 60_000)) + 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, alive, last, swarmed = state.get if state.exists else ([], [], None, -1)
        plain = lambda e: e if isinstance(e, dict) else {k: e[k] for k in ("t", "id", "merchant", "values", "lat", "lon")}
        waiting, alive = [plain(e) for e in waiting], {e["merchant"]: e for e in map(plain, alive)}
        last = plain(last) if last is not None else None
        for b in batches:
            for r in b.itertuples(index=False):
                values = [] if r.values is None else list(r.values)
                at = lambda v: None if v is None or math.isnan(v) else float(v)
                waiting.append({"t": r.occurred_at.value // 1000, "id": r.source_txn_id, "merchant": r.merchant_id, "values": values, "lat": at(r.lat), "lon": at(r.lon)})
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted((e for e in waiting if e["t"] < mark), key=lambda e: (e["t"], e["id"]))
        waiting, out = [e for e in waiting if e["t"] >= mark], []
        for e in ready:
            hit = {"hashed_pan": key[0], "source_txn_id": e["id"], "merchant_id": e["merchant"], "occurred_at": pd.Timestamp(e["t"] * 1000)}
            if last is not None and e["t"] // _DAY != last["t"] // _DAY:
                alive, last = {}, None  # a day's cards are judged by themselves
            alive[e["merchant"]] = e
            alive = {m: x for m, x in alive.items() if x["t"] >= e["t"] - reach}
            shared = Counter(v for x in alive.values() for v in x["values"])
            apart = sum(all(shared[v] == 1 for v in x["values"]) for x in alive.values())
            if len(alive) >= least and apart >= least and swarmed != e["t"] // _DAY:
                swarmed = e["t"] // _DAY
                out.append(hit | {"kind": "card_swarm", "touched": len(alive), "apart": apart})
            if last is not None and last["merchant"] != e["merchant"] and None not in (last["lat"], e["lat"]):
                minutes = (e["t"] - last["t"]) / 60e6
                if 0 < minutes <= longest and (km := _km(last, e)) >= nearest and km / (minutes / 60) > fastest:
                    leg = {"from_source_txn_id": last["id"], "from_merchant_id": last["merchant"], "minutes": minutes, "km": km, "kmh": km / (minutes / 60)}
                    out.append(hit | leg | {"kind": "impossible_geo_velocity"})
            last = e
        if not waiting and (last is None or last["t"] // 1000 + span_ms < mark // 1000):
            state.remove()
        else:
            state.update((waiting, list(alive.values()), last, swarmed))
            due = min(e["t"] for e in waiting) // 1000 if waiting else last["t"] // 1000 + span_ms
            state.setTimeoutTimestamp(max(due, mark // 1000) + 1)
        columns = [c.split(" ")[0] for c in FOUND.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"touched": "Int64", "apart": "Int64"})

    timed = rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    return timed.groupBy("hashed_pan").applyInPandasWithState(step, FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
