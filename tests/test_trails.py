"""Owner groups of a case's merchants, against the walk in order of ids."""

import random

from ledgerscope.operators import trails


def plain(cases, merchants):
    out = []
    for case, members in cases.items():
        shared = lambda a, b: any(x and x == y for x, y in zip(merchants[a], merchants[b]))
        related = {m: {o for o in members if o != m and shared(m, o)} for m in members}
        groups, labels = {}, []
        for m in sorted(m for m in members if related[m]):
            if m in groups:
                continue
            labels.append(m)
            for o in related[m] | {m}:
                groups.setdefault(o, f"Chain {chr(64 + len(labels))}")
        out += [(case, m, g) for m, g in groups.items()]
    return sorted(out)


def test_groups_by_order_of_ids(spark):
    rng = random.Random(4)
    merchants = {f"M{i:02d}": [rng.choice([None, "", *(f"{a}{k}" for k in range(9))]) for a in "bah"] for i in range(40)}
    cases = {f"c{k}": sorted(rng.sample(sorted(merchants), rng.randint(1, 18))) for k in range(12)}
    m = spark.createDataFrame([(k, *v) for k, v in merchants.items()], "merchant_id string, hashed_br_number string, hashed_merchant_address string, hashed_merchant_name string")
    members = spark.createDataFrame([(c, x) for c, ms in cases.items() for x in ms for _ in range(2)], "subject string, merchant_id string")
    out = trails.labelled(trails.owner_groups(members, m, ["subject"]), ["subject"])
    assert sorted((r["subject"], r["merchant_id"], r["owner_group"]) for r in out.collect()) == plain(cases, merchants)
    assert trails.owner_groups(members.limit(0), m, ["subject"]).count() == 0


def test_leader_of_a_later_round(spark):
    """M3 leads only once M1 has taken M2, but comes before M4 in the order of ids."""
    values = {"M1": ("x1", None, None), "M2": ("x1", "y2", None), "M3": (None, "y2", "z3"), "M4": ("x4", None, None), "M5": ("x4", None, "z3")}
    m = spark.createDataFrame([(k, *v) for k, v in values.items()], "merchant_id string, hashed_br_number string, hashed_merchant_address string, hashed_merchant_name string")
    members = spark.createDataFrame([("c", x) for x in values], "subject string, merchant_id string")
    out = trails.owner_groups(members, m, ["subject"])
    assert {r["merchant_id"]: r["leader"] for r in out.collect()} == {"M1": "M1", "M2": "M1", "M3": "M3", "M4": "M4", "M5": "M3"}


def test_names_beyond_z(spark):
    groups = spark.createDataFrame([("c", f"M{k:04d}", f"M{k:04d}") for k in range(1, 301)], "subject string, merchant_id string, leader string")
    got = {r["merchant_id"]: r["owner_group"] for r in trails.labelled(groups, ["subject"]).collect()}
    assert got == {f"M{k:04d}": f"Chain {chr(64 + k)}" for k in range(1, 301)}
