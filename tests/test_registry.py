"""Queries against their SQL, run by DuckDB on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from emberline.plans import queries as incident

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
#: One of each kind; the driver compares all of them.
SOME = [
    "b1_b2_metric_fields", "b5_b7_parse", "b8_e4_e5_log_events", "b14_gate", "b20_offending_value", "e1_e3_anomalies", "k1_classify", "d3_failure_signals", "c1_change_correlation",
    "b1_b2_b4_attributes", "a6_log_files", "a8_tail", "a2_architectures", "h1_propagation", "k2_timeline", "k3_f2_hypotheses", "k5_actions", "b22_b25_texts", "h7_e12_trace", "h4_cycles", "h10_dependency_levels", "c14_state_as_of", "e11_compose", "j2_resolved_calls", "d9_catalog_facts",
]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    at = [found.columns.index(c) for c in cols]
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(incident.ORACLES) <= set(incident.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
