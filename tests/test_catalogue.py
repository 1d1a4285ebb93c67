"""Every named query runs on the small tables, and agrees with its SQL where it has one."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronoloom.plans.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"
#: Queries without SQL (random draws of numpy, a sequential schedule) and the tests that hold their operators against something else.
ELSEWHERE = {
    "seg_lane_batches": "test_builders.test_segments_partition_and_schedule", "seg_epoch": "test_builders.test_epochs", "panel_epoch": "test_builders.test_epochs",
    "kf_enkf": "test_features.test_random_filters", "kf_enkf_nl": "test_features.test_random_filters", "kf_particle": "test_features.test_random_filters",
    "kf_particle_gbm": "test_features.test_random_filters", "syn_nar": "test_builders.test_synthetic_recursions", "syn_fbm": "test_builders.test_varying_exponent",
    "syn_multifractal": "test_builders.test_synthetic_recursions", "syn_composite": "test_builders.test_composite_parts",
}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, pd.Timestamp):
        return str(v)
    return float(v) + 0.0 if isinstance(v, int | float) or hasattr(v, "dtype") and not getattr(v, "shape", ()) else repr(list(v))


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr(tuple(map(plain, r))) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, duck, name):
    query, sql = CATALOGUE[name]
    got = query(spark, SF).toPandas()
    if sql is None:
        import importlib

        module, test = ELSEWHERE[name].split(".")
        assert len(got) > 0 and callable(getattr(importlib.import_module(f"tests.{module}"), test))
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert len(got) == len(want)
    differing = [(a, b) for a, b in zip(rows(got, columns), rows(want, columns), strict=True) if a != b]
    assert not differing, differing[:3]
