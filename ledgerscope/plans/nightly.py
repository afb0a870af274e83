"""The nightly run: fit, route, detect in three families, rank, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import alerts, baselines, contributions, detectors, profiles, rings, typology
from ledgerscope.operators.detectors import Portfolio
from ledgerscope.operators.typology import DEFAULT_RULES, Rule
from ledgerscope.sources import tables
from ledgerscope.sources.store import RunStore


def score(p: Portfolio, places: DataFrame, rules: list[Rule] = DEFAULT_RULES, open_alerts: DataFrame | None = None) -> DataFrame:
    """Ranked alerts of the scored day, one for each hit.

    Baselines and the day's rows are written once and read by every check; so are each check's
    hits. Families A and B come first; the merchants they flag, and those with ``open_alerts``, are
    what the rules of family C call flagged.
    """
    spark = p.ledger.sparkSession
    p = detectors.write_fits(p)
    shared = {"features": partial(typology.day_features, p), "card_events": partial(rings.card_events, p)}
    p = replace(p, written={**p.written, **tables.write_all(spark, {n: make for n, make in shared.items() if n not in p.written})})
    checks = {d.__name__: partial(d, p) for d in detectors.DETECTORS}
    for template, given in typology.by_template(rules).items():
        checks[f"rule-{template}"] = partial(typology.EVALUATORS[template], p, p.written["features"], given)
    first = reduce(DataFrame.unionByName, tables.write_all(spark, checks).values())
    flagged = first.select("merchant_id")
    if open_alerts is not None:
        flagged = flagged.union(open_alerts.select("merchant_id"))
    flagged = tables.write(flagged.distinct(), "flagged")
    rung = tables.write_all(spark, {f"ring-{r.name}": partial(rings.evaluate, p, flagged, places, [r]) for r in rules if r.enabled and r.template in rings.EVALUATORS})
    return alerts.rank(reduce(DataFrame.unionByName, rung.values(), first), detectors.lanes(p))


def everything(p: Portfolio, rules: list[Rule], places: DataFrame) -> dict[str, DataFrame]:
    """What a night publishes: ranked alerts and the rows behind them, profiles, cohorts and their members.

    Evidence is frozen with the alerts: ``contributions`` of families A and B, and, of cases about
    cards, ``trails`` (the card's day), ``linkage`` and ``journeys`` (legs that are too fast).
    """
    spark = p.ledger.sparkSession
    p = detectors.write_fits(p)
    p = replace(p, written={**p.written, **tables.write_all(spark, {"features": partial(typology.day_features, p), "card_events": partial(rings.card_events, p)})})
    cohorts = baselines.cohort_snapshots(p.fitted("peer_amount"), p.as_of).drop("as_of")
    made = {"alerts": score(p, places, rules), "profiles": profiles.assemble(p), "cohorts": cohorts, "cohort_members": profiles.cohort_members(p)}
    rows = tables.write_all(spark, contributions.family_a(p) | contributions.family_b(p, rules, p.written["features"]))
    made["contributions"] = reduce(DataFrame.unionByName, rows.values())
    if rings.card_cases(p, places, rules):
        made |= {"trails": rings.trails(p, places, rules), "linkage": rings.linkage(p, places, rules)}
    if fast := [r for r in rules if r.enabled and r.template == "impossible_geo_velocity"]:
        made["journeys"] = reduce(DataFrame.unionByName, [rings.journeys(p, places, r).withColumn("detector", F.lit(r.name)) for r in fast])
    return made


def night(store: RunStore, p: Portfolio, places: DataFrame, label: str | None = None, triggered_by: str | None = None, made: Callable = everything) -> int:
    """Open a run, fit and score the day of ``p`` under the thresholds and rules in force, publish; the run's number.

    The store's thresholds take the place of those of ``p``. If the night dies, its day keeps what an
    earlier run said; if the day is scored again, the new run supersedes it. Tables that ``p`` has
    written already are not fitted again, which suits a second run that changes cut-offs or rules.
    ``made(p, rules, places)`` gives what is published.
    """
    run_id = store.open_run(p.as_of, label, triggered_by)
    tuning, fit, rules = store.settings_of_run(run_id)
    store.publish(run_id, made(replace(p, tuning=tuning, fit=fit), rules, places))
    return run_id
