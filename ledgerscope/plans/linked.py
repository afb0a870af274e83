"""Registered queries of the evidence behind hits about cards, and of linked transactions; their SQL twins."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import rings, trails
from ledgerscope.operators.detectors import Portfolio
from ledgerscope.operators.typology import Rule
from ledgerscope.plans import registry as reg
from ledgerscope.plans.registry import query
from ledgerscope.sources import fixture, tables

RULES = [r for r in reg.RULES if r.template in ("card_across_related_merchants", "card_swarm", "impossible_geo_velocity")]
_GEO: Rule = next(r for r in RULES if r.template == "impossible_geo_velocity")


def _ctes(name: str) -> str:
    """The subqueries of a ring rule's twin, behind those of the cards."""
    return reg.SQL[name].split(f"{reg.CARDS}, ")[1].split(" SELECT merchant_id, 'C' AS family")[0]


_CASES = f"""{reg.IDS}, {reg.LEGS}, {_ctes("c03_card_across_related")}, {_ctes("c04_card_swarm")},
    lw AS (SELECT hashed_pan, min((-kmh, source_txn_id, merchant_id)) AS w FROM legs GROUP BY 1),
    kc AS (SELECT 'card_across_related_merchants' AS detector, hashed_pan, hashed_pan || txn_date || grp AS subject, w[2] AS carrier FROM cx
      UNION ALL SELECT 'card_swarm', hashed_pan, hashed_pan, w[2] FROM wf WHERE k = 1 UNION ALL SELECT 'impossible_geo_velocity', hashed_pan, hashed_pan, w[3] FROM lw),
    fo AS (SELECT 'card_across_related_merchants' AS detector, hashed_pan || txn_date || grp AS subject, source_txn_id, merchant_id FROM cg
      UNION ALL SELECT 'card_swarm', hashed_pan, xid, wn.merchant_id FROM wn JOIN wf USING (hashed_pan, t, id) WHERE k = 1
      UNION SELECT 'impossible_geo_velocity', hashed_pan, source_txn_id, merchant_id FROM legs UNION SELECT 'impossible_geo_velocity', hashed_pan, fi, fm FROM legs),
    fs AS (SELECT detector, subject, count(DISTINCT merchant_id) AS merchants, count(*) AS transactions FROM fo GROUP BY 1, 2),
    tr AS (SELECT kc.detector, kc.subject, kc.carrier, ce.card_ref, ce.merchant_id, ce.source_txn_id, ce.occurred_at, ce.t, fo.source_txn_id IS NOT NULL AS focus, merchants
      FROM kc JOIN ce USING (hashed_pan) JOIN fs USING (detector, subject) LEFT JOIN fo ON fo.detector = kc.detector AND fo.subject = kc.subject AND fo.source_txn_id = ce.source_txn_id)"""


def _stored(p: Portfolio) -> Portfolio:
    """``p`` with the day's card rows written: every rule about cards reads them."""
    p = reg.stored(p)
    return replace(p, written={"card_events": tables.write(rings.card_events(p), "card_events")})


def _places(p: Portfolio) -> DataFrame:
    return fixture.places(p.ledger.sparkSession)


query("c07_trails", f""", {_CASES} SELECT detector, card_ref, carrier, source_txn_id, 'merchant_id' AS field, merchant_id AS value, focus, CASE WHEN NOT focus THEN 'same card, same day — context for the trail'
      WHEN detector = 'card_across_related_merchants' THEN 'same card, same owner group, same day' WHEN detector = 'card_swarm' THEN 'part of a same-card burst across merchants'
      ELSE 'same card at ' || merchants || ' merchants, at times the journey between them does not allow' END AS reason FROM tr""")(
    lambda p: rings.trails(_stored(p), _places(p), RULES).drop("subject", "occurred_at")
)
query("c07_linkage", f", {_CASES} SELECT DISTINCT detector, carrier AS merchant_id, card_ref, detector = 'card_across_related_merchants' AS related, merchants, transactions FROM tr JOIN fs USING (detector, subject, merchants)")(
    lambda p: rings.linkage(_stored(p), _places(p), RULES).drop("subject").distinct()
)
query("c05_journeys", f""", {reg.LEGS}, pl AS (SELECT merchant_id, coalesce(nullif(merchant_subdistrict, ''), nullif(merchant_district, ''), 'unknown') AS place FROM merchants)
    SELECT card_ref AS subject, fm AS from_merchant, a.place AS from_place, fi AS from_txn_id, ft AS from_t, l.merchant_id AS to_merchant, b.place AS to_place, source_txn_id AS to_txn_id, t AS to_t,
      round(km, 2) AS distance_km, round(minutes, 1) AS minutes, round(kmh, 1) AS kmh, CAST(5.0 AS DOUBLE) AS limit_kmh, round(kmh / 5, 2) AS over_limit_multiple
    FROM legs l JOIN pl a ON a.merchant_id = fm JOIN pl b ON b.merchant_id = l.merchant_id""")(lambda p: rings.journeys(p, _places(p), _GEO))


def _linked(p: Portfolio) -> DataFrame:
    frozen = tables.write_all(p.ledger.sparkSession, {"trails": partial(rings.trails, p, _places(p), RULES), "journeys": partial(rings.journeys, p, _places(p), _GEO)})
    return trails.linked_transactions(frozen["trails"], p.ledger, p.merchants, frozen["journeys"])


#: Groups of owners in order of the merchants' ids: one that no group holds yet opens one with all its relatives that none holds.
_GROUPS = f"""{_CASES}, ms AS (SELECT detector, subject, list_sort(list(DISTINCT merchant_id)) AS ms FROM tr GROUP BY 1, 2),
    gr(detector, subject, ms, k, done) AS (SELECT detector, subject, ms, 0, CAST([] AS STRUCT(m VARCHAR, l VARCHAR)[]) FROM ms UNION ALL
      SELECT g.detector, g.subject, g.ms, k + 1, CASE WHEN len(list_intersect(coalesce(related, []), g.ms)) = 0 OR list_contains(list_transform(done, lambda x: x.m), g.ms[k + 1]) THEN done
        ELSE list_concat(done, list_transform(list_filter(list_append(list_intersect(related, g.ms), g.ms[k + 1]), lambda x: NOT list_contains(list_transform(done, lambda d: d.m), x)), lambda x: {{'m': x, 'l': g.ms[k + 1]}})) END
      FROM gr g LEFT JOIN rel ON rel.merchant_id = g.ms[k + 1] WHERE k < len(g.ms)),
    gl AS (SELECT detector, subject, unnest(done) AS d FROM gr WHERE k = len(ms)),
    og AS (SELECT detector, subject, d.m AS merchant_id, 'Chain ' || chr(CAST(64 + dense_rank() OVER (PARTITION BY detector, subject ORDER BY d.l) AS INT)) AS owner_group FROM gl),
    lt AS (SELECT tr.*, l.total_amount, owner_group, row_number() OVER w AS place, round((tr.t - lag(tr.t) OVER w) / 60000000.0, 1) AS gap, x.kmh, x.km
      FROM tr JOIN (SELECT source_txn_id, total_amount FROM ledger) l USING (source_txn_id) LEFT JOIN og USING (detector, subject, merchant_id) LEFT JOIN legs x ON tr.detector = 'impossible_geo_velocity' AND x.source_txn_id = tr.source_txn_id
      WINDOW w AS (PARTITION BY tr.detector, tr.subject ORDER BY tr.occurred_at, tr.source_txn_id))"""
query("m14_linked_transactions", f""", {_GROUPS} SELECT detector, card_ref, carrier, lt.merchant_id, source_txn_id, place, gap AS minutes_since_previous, owner_group, focus, merchant_id = carrier AS is_alert_merchant, mcc, mcc_description,
      round(kmh, 1) AS arrived_at_kmh, round(km, 2) AS arrived_from_km FROM lt JOIN merchants USING (merchant_id)""")(
    lambda p: _linked(_stored(p)).select(
        "detector", "card_ref", "carrier", "merchant_id", "source_txn_id", "place", "minutes_since_previous", "owner_group", "focus", "is_alert_merchant", "mcc", "mcc_description", "arrived_at_kmh", "arrived_from_km"
    )
)
query("m14_rollup", f", {_GROUPS} SELECT detector, merchant_id, owner_group, merchant_id = carrier AS is_alert_merchant, count(*) AS transactions, round(sum(total_amount), 4) AS total_amount, min(occurred_at)::VARCHAR AS first_seen, max(occurred_at)::VARCHAR AS last_seen FROM lt GROUP BY detector, subject, merchant_id, owner_group, carrier")(
    lambda p: trails.rolled_up(_linked(_stored(p))).withColumn("total_amount", F.round("total_amount", 4)).drop("subject")
)
