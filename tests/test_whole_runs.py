"""Runs with a column or statistic left out train with the chosen number of trees and their depth."""

from __future__ import annotations

import pickle

import numpy as np
import pytest

from rangeloom.operators import boosting
from rangeloom.operators.boosting import Boosted, Run, Tree
from rangeloom.plans import models, training


@pytest.mark.parametrize(("name", "runs"), [("drop_column_runs", 10), ("drop_statistic_runs", 4)])
def test_dropped_columns_are_tried_with_all_trees(name, runs, monkeypatch):
    asked = []
    monkeypatch.setattr(training, "_train_test", lambda spark, sf_dir: (None, None))
    monkeypatch.setattr(models, "fit_boosted", lambda train, features, runs, *a, **k: asked.extend(runs) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        training.QUERIES[name](None, "")
    assert len(asked) == runs and all((r.rounds, r.depth, r.rate) == (200, 4, 0.1) for r in asked)


def test_tasks_get_the_rounds_that_margins_lack():
    """What a pass over the rows is sent does not grow with the rounds before it."""
    model = Boosted(("a",), [np.array([0.5])], (0, 1), (Run("one", rounds=300, depth=4),))
    sizes = []
    for _ in range(150):
        model.rounds += [{(0, k): Tree.empty(4) for k in (0, 1)} for _ in range(2)]
        sizes.append(len(pickle.dumps(model.since(len(model.rounds) - 1))))
    assert sizes[0] == sizes[-1] and len(model.since(299).rounds) == 1 and boosting.KEPT_ROUNDS <= 8
