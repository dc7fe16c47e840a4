"""Every query of the subpackage that has SQL, over the smallest whole tables."""

import pytest
from compare import compare

from valora.llm import registry


@pytest.mark.parametrize("name", list(registry.checks()))
def test_query(spark, duck, sf_dir, name):
    assert compare(registry.queries()[name](spark, sf_dir), duck, registry.checks()[name]) is None
