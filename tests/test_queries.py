"""Every registered query against its SQL over the smallest whole tables."""

import pytest
from compare import compare

from valora.bindings import catalog

CHECKS = catalog.checks()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in CHECKS:
        assert compare(df, duck, CHECKS[name]) is None
    else:
        assert df.count() >= 0


def test_names_are_unique():
    total = sum(len(m.catalog.queries) for m in catalog.MODULES)
    assert total == len(catalog.queries())
