"""Pages are read in parts of bounded size."""

import pandas as pd

from valora.operators import page_tree


def test_trees_are_handed_on_in_parts():
    pages = pd.DataFrame({"page_id": range(50), "html": ["<p>x</p>" * 1000] * 49 + [None]})
    parts = list(page_tree.read_nodes(iter([pages])))
    assert max(sum(map(len, p["nodes"])) for p in parts) <= 20_000
    assert [i for p in parts for i in p["page_id"]] == list(range(50))
    assert {len(n) for p in parts for n in p["nodes"]} == {1 + 2 * 1000, 1}
