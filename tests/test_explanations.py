"""Explanation reports of many windows at once against one report a window."""

from __future__ import annotations

import random

from stratolab.operators import attrib


def test_reports_by_window_are_those_of_each_window(spark):
    rng = random.Random(2)
    cells = [(w, t, f"ch{c}", r, float(rng.randrange(-9, 10))) for w in range(5) for t in range(4) for c in range(8) for r in range(3)]
    seen = [(w, t, r, 0, rng.randrange(1, 9) / 8) for w in range(5) for t in range(4) for r in range(3)]
    checks = [(w, float(w * 7 - 10), 6 + w % 3, 8) for w in range(5)]
    attr = spark.createDataFrame(cells, "w long, t int, channel string, map_row int, attribution double")
    share = spark.createDataFrame(seen, "w long, t int, map_row int, map_col int, share double")
    shares = attrib.attention_share(share, keys=["w"])
    check = spark.createDataFrame(checks, "w long, difference double, attributed int, served int")
    got = {r.w: tuple(r)[1:] for r in attrib.explanation_reports(attr, shares, check, ["w"], ["mask"], k=3).collect()}
    assert set(got) == set(range(5))
    for w, difference, attributed, served in checks:
        residual = abs(sum(c[4] for c in cells if c[0] == w) - difference)
        one = attrib.explanation_report(
            attr.where(f"w = {w}"), attrib.attention_share(share.where(f"w = {w}")), ["mask"],
            residual=residual, attributed=attributed, served=served, k=3,
        )
        assert got[w] == tuple(one.first())
        assert len(got[w][0]) == 3 and got[w][0][0].rank == 1


def test_windows_that_lack_a_part(spark):
    """No attributions, no shares, neither, and a window without a check; a null key; empty tables."""
    attr = spark.createDataFrame([(1, "a", 2.0), (1, "b", -3.0), (4, "a", 1.0), (None, "a", 1.0)], "w long, channel string, attribution double")
    share = spark.createDataFrame([(2, 0, 0.75, 1.5), (2, 1, 0.25, 0.5)], "w long, t int, share double, relative_to_uniform double")
    check = spark.createDataFrame([(1, -1.0, 8, 8), (2, 1.0, 8, 8), (3, 0.0, 7, 8), (None, 0.0, 8, 8)], "w long, difference double, attributed int, served int")
    got = {r.w: r for r in attrib.explanation_reports(attr, share, check, ["w"], []).collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(d.channel, d.score, d.direction) for d in got[1].drivers] == [("b", -3.0, "lowered"), ("a", 2.0, "raised")]
    assert got[1].evidence == [] and got[1].caveats == [] and got[1].excluded == []
    assert got[2].drivers == [] and [e.t for e in got[2].evidence] == [0, 1]
    assert got[2].caveats == ["attributions leave a residual of 1.00; raise the steps above 32"]
    assert (got[3].drivers, got[3].evidence, got[3].caveats) == ([], [], ["covers 7 of 8 members"])
    assert (got[None].drivers, got[None].evidence) == ([], [])
    assert attrib.explanation_reports(attr.limit(0), share, check.limit(0), ["w"], []).count() == 0
