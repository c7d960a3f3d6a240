"""Displacements from coarse to fine against the full search."""

from __future__ import annotations

import numpy as np
import pytest

from stratolab.operators import sync

KIND = "seq int, frame int, row int, col int, value double"


def smooth(dr: int, dc: int) -> list[tuple]:
    """A smooth field, and the same moved by (dr, dc), on 48 x 48 cells."""
    y, x = np.mgrid[0:48, 0:48].astype(float)
    field = lambda a, b: 9 * np.sin((y - a) / 8.0 + 0.3) * np.cos((x - b) / 9.0) + 0.11 * (y - a) + 0.07 * (x - b)
    first, last = field(0, 0), field(dr, dc)
    return [(0, f, r, c, float(v[r, c])) for f, v in ((0, first), (2, last)) for r in range(48) for c in range(48)]


@pytest.mark.parametrize("move", [(6, -5), (-7, 3), (0, 0)])
def test_smooth_fields_give_the_full_searchs_shifts(spark, move):
    rows = smooth(*move)
    present = spark.createDataFrame(rows, KIND).cache()
    pairs = spark.createDataFrame([(0, 0, 2)], "seq int, before int, after int")
    shifts = lambda levels: {(r.tile_row, r.tile_col): tuple(r.d) for r in sync.tile_shifts(pairs, present, 16, 8, levels).collect()}
    full, coarse = shifts(0), shifts(2)
    assert len(full) == 9 and full[1, 1] == move
    assert coarse == full
    gap = [(0, 1, r, c, None) for r in range(48) for c in range(48)]
    cells = spark.createDataFrame(rows + gap, KIND)
    pick = lambda df: sorted((r.frame, r.row, r.col, r.value is None, round(r.value or 0.0, 9), r.filled) for r in df.collect())
    assert pick(sync.fill_advective(cells, 16, 8, levels=2)) == pick(sync.fill_advective(cells, 16, 8))
    present.unpersist()


def test_levels_must_fit_the_tile(spark):
    empty = spark.createDataFrame([], KIND)
    with pytest.raises(ValueError, match="coarsest"):
        sync.fill_advective(empty, 12, 4, levels=3)
    assert sync.fill_advective(empty, 12, 4, levels=2).count() == 0


def test_copies_are_bounded(spark):
    """Rows tried, counted by the plan's generators: nine a level, not (2 x 8 + 1)^2."""
    present = spark.createDataFrame(smooth(2, 1), KIND)
    pairs = spark.createDataFrame([(0, 0, 2)], "seq int, before int, after int")

    def tried(levels: int) -> int:
        out = sync.tile_shifts(pairs, present, 16, 8, levels)
        out.collect()
        plan, total = [out._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                plan.append(node.executedPlan())
            elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
                plan.append(node.plan())
            else:
                if node.nodeName() == "Generate":
                    total += node.metrics().apply("numOutputRows").value()
                children = node.children()
                plan += [children.apply(i) for i in range(children.size())]
        return total

    cells = 48 * 48
    assert tried(0) >= 17 * 17 * cells
    assert 0 < tried(3) <= 4 * 9 * cells * 2
