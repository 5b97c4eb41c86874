"""Every filtering query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from prismgrid.plans import catalog


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in ("events", "embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


# the command line's cells go the ways of the methods: the driver compares them, and tests/test_rasters.py runs them
@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if not n.startswith("cells_")))
def test_query_equals_sql(spark, sf, con, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_query_gives_finite_rows(spark, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    assert len(got) and got.select_dtypes("number").notna().all(axis=None)


def test_equal_gradients_are_ties_whatever_their_last_bits(spark, tmp_path):
    """0.1 / 2 + 0.2 / 2 is more than 0.3 / 2 in its last bit alone: the first pixel of the block is taken."""
    value = {102: 0.3, 304: 0.2, 403: 0.1}
    duckdb.sql(f"""COPY (SELECT i AS event_id, CASE {" ".join(f"WHEN i = {i} THEN {v}" for i, v in value.items())} ELSE 0 END::DOUBLE AS value, '{{"k": 0}}' AS props
        FROM range(600) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = catalog.queries()["sample_gradient_max"](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()["sample_gradient_max"]).df()
    assert rows(got) == rows(want)
    assert ((got.y == 2) & (got.x == 2)).sum() == 1


JOINS = ("nlm_exact", "hdgf_exact", "hdgf_join", "im2col_r1", "pca_project", "pca_reconstruction_psnr", "patch_pca", "pad_reflect", "resize_area_2x", "gain_vs_baseline", "embedding_kernel_smooth", "method_4", "psnr_cropped", "gradient")


@pytest.mark.parametrize("name", JOINS)
def test_plan_has_no_nested_loop(spark, sf, name):
    """No core query joins without a key."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_settings_without_a_public_definition_are_refused():
    from prismgrid.model import FilterSpec

    for wrong in ({"local_statistics_prior": True}, {"local_statistics_delta": 1.0}, {"cluster_refine": 1}, {"patch_pca_method": 2}, {"variant": "interpolation2"}):
        with pytest.raises(NotImplementedError):
            FilterSpec(**wrong)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["y", "x", "v"] and out.count() == 1000
