"""Every registered query of the subpackage on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import os

import pytest

from refrain.llm.queries import ORACLES, QUERIES
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_rows(frame, ORACLES[name], SF)
    else:
        assert frame.count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 50
