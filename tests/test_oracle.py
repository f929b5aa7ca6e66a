"""Every registered query of the library's own operators against its SQL twin."""

import math

import pytest

from conftest import SF
from kinfold.plans import registry


def plain(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(round(float(x), 5)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[c]) for c in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.execute(registry.ORACLE_SQL[name]).fetchdf().to_dict("records")
    assert plain(got) == plain(want)


def test_golden_score(spark):
    assert registry.QUERIES["report"](spark, SF).first().score == pytest.approx(0.284292, abs=1e-6)
