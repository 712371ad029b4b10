import pytest

from gridloom.plans import catalog


def test_no_query_replaces_another():
    assert "v > 36000.0 AND v < 40000.0" in catalog.ORACLES["threshold_between"]
    assert "v > 45000 AND v < 50000" in catalog.ORACLES["blank_between"]
    with pytest.raises(ValueError):
        catalog._add("threshold_between", None)
