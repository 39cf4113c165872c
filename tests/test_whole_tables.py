"""Queries start at predicates on data, not at fixed ids; test_oracles compares them with DuckDB."""

import re

import pytest

from cohort import queries


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLE_SQL if not n.startswith("pred_")))
def test_without_id_range(name):
    """Comparisons of keys with numbers are the feature of predicates alone."""
    sql = queries.ORACLE_SQL[name].replace(queries.C, "").replace(queries.O, "").replace(queries.E, "")
    assert not re.search(r"(?:key|event_id|owner_id|buyer|user_id|\bpk|\bk) (?:<|<=|>=|>|=|IN \()\s*\d", sql)
    assert not re.search(r"LIMIT \d{4,}", sql) or name.startswith("take_")
