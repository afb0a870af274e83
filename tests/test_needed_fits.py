"""Queries that read a few baselines make these alone, with the results of a whole night."""

from ledgerscope.operators import daytables, detectors as det, profiles, typology as ty
from ledgerscope.plans import registry

SF = "/root/testdata/sf0.001"


def test_what_fits_read():
    assert set(daytables.READS) == {*daytables.SHARED, *daytables.FITS} and set(daytables.FITS) == set(det.FITS)
    assert daytables.needed(det.FITS) == (set(daytables.SHARED), set(daytables.TABLES))
    assert daytables.needed(["own_hours", "peer_amount"]) == ({"own_stats"}, {"bins", "amounts", "activity"})


def test_some_fits_equal_those_of_all(spark):
    p = registry.stored(registry.portfolio(spark, SF))
    every, some = det.write_fits(p), det.write_fits(p, [*ty.FITS, "mcc_tickets"])
    assert set(some.written) == {*ty.FITS, "mcc_tickets", "day"}
    rows = lambda q, name: sorted(map(str, q.fitted(name).select(*sorted(q.fitted(name).columns)).collect()))
    for name in some.written.keys() - {"day"}:
        assert rows(some, name) == rows(every, name), name
    assert profiles.overview(profiles.headlines(p)).collect() == profiles.overview(profiles.assemble(every)).collect()
