import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def few_slices():
    """Small tables are counted in one slice; a test of its own counts in four."""
    from drawspark.llm import ngram_join

    whole, ngram_join.SLICES = ngram_join.SLICES, 1
    yield whole
    ngram_join.SLICES = whole
