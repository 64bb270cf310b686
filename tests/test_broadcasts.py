"""What is broadcast passes through the driver. Spark takes what is exploded, or made in Python, for as small as its input."""

import os
import re

import pytest

DATA = os.environ.get("KINDRED_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

#: Queries whose joins are of rows that the planner can't count.
NAMES = ["hamming_strict", "hamming_pairs", "reference_relations", "finder_matches", "diff_regions_tiled", "op6_document_fingerprints"]


def broadcast_of_made_rows(df):
    """Broadcasts of a plan with a generator or a Python step below them."""
    lines = [re.match(r"([\s:+\-|]*)(?:\*\(\d+\) )?(\w+)", x).groups() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x.strip()]
    out = []
    for i, (indent, node) in enumerate(lines):
        if node == "BroadcastExchange":
            below = []
            for deeper, name in lines[i + 1 :]:
                if len(deeper) <= len(indent):
                    break
                below.append(name)
            out += [x for x in below if x in ("Generate", "MapInArrow", "MapInPandas")]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_rows_that_no_one_counted_are_not_broadcast(spark, name):
    import __spark_entry__

    assert broadcast_of_made_rows(__spark_entry__.queries()[name](spark, DATA)) == []
