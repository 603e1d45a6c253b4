"""Registered queries at the operators' defaults and over whole tables."""

import inspect

import pytest
from compare import SMALL

import __spark_entry__ as entry
from strandframe.operators import learning, sets


class Called(Exception):
    pass


@pytest.mark.parametrize("name, module, operator, figures", [
    ("preranked_enrichment", sets, "preranked_gsea", {"permutations": 1000}),
    ("forest_classifier", learning, "forest_classifier", {"trees": 100, "folds": 5}),
    ("forest_confusion", learning, "forest_classifier", {"trees": 100, "folds": 5}),
    ("forest_regressor", learning, "forest_regressor", {"trees": 100}),
    ("forest_importances", learning, "forest_regressor", {"trees": 100}),
])
def test_query_runs_at_full_size(spark, name, module, operator, figures, monkeypatch):
    signature = inspect.signature(getattr(module, operator))

    def spy(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in figures})

    monkeypatch.setattr(module, operator, spy)
    with pytest.raises(Called) as seen:
        entry.queries()[name](spark, SMALL)
    assert seen.value.args[0] == figures
