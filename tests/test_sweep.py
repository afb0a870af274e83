"""Sliding counts of a card's merchants by sweep, against windows that are looked into one by one."""

import random

from ledgerscope.operators import sweep


def plain(events, values, reach):
    shared = {}
    for m, a, v in values:
        shared.setdefault(m, set()).add((a, v))
    out = []
    for card, _, t, i in events:
        seen = {m for c, m, u, j in events if c == card and t - reach <= u and (u, j) <= (t, i)}
        apart = [m for m in seen if not any(o != m and shared.get(o, set()) & shared.get(m, set()) for o in seen)]
        out.append((card, t, i, len(seen), len(apart)))
    return sorted(out)


def swept(spark, events, values, reach):
    e = spark.createDataFrame(events, "card string, m string, t long, id string")
    v = spark.createDataFrame(values, "m string, attribute string, value string")
    return sorted(tuple(r) for r in sweep.counts(e, v, "card", "m", reach).collect())


def test_counts_equal_windows(spark):
    rng = random.Random(8)
    merchants = [f"m{i}" for i in range(14)]
    values = [(m, a, f"{a}{rng.randint(0, 6)}") for m in merchants for a in "xyz" if rng.random() < 0.6]
    events = [(f"c{rng.randint(0, 5)}", rng.choice(merchants), rng.randint(0, 300), f"t{i:04d}") for i in range(900)]
    for reach in (0, 1, 15, 60):
        assert swept(spark, events, values, reach) == plain(events, values, reach)


def test_one_card_with_a_third_of_all_rows_stays_linear(spark):
    """20,000 events of a card within one window: each sees hundreds of merchants, none is gathered."""
    n = 20_000
    events = [("hot", f"m{i % 700}", i // 10, f"t{i:06d}") for i in range(n)]
    values = [(f"m{k}", "x", f"x{k // 2}") for k in range(600)]  # 300 pairs of relatives, 100 without
    out = swept(spark, events, values, 10**6)
    assert out[-1][3:] == (700, 100) and out[699][3:] == (700, 100) and out[0][3:] == (1, 1) and out[1][3:] == (2, 0)
