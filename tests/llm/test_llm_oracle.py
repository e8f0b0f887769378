"""Queries of this subpackage against their DuckDB SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from barloom.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    assert not compare.compare(spark, compare.connect(sf), queries.QUERIES[name], queries.ORACLE[name], sf)
