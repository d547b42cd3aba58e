import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from pagelode.plans import core  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = core.queries()[name](spark, str(DATA))
    found = con.sql(core.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)

    def plain(v):
        return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    at = {c: k for k, c in enumerate(found.columns)}
    want = sorted(repr([plain(r[at[c]]) for c in cols]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_scans_prune_the_html(spark):
    plan = core.queries()["daily_collection"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "html" not in schema


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    """The test tables without rows, and with rows of nulls and extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    empty, dirty = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("dirty")
    for f in DATA.iterdir():
        t = spark.read.parquet(str(f))
        t.limit(0).write.parquet(str(empty / f.name))
        nulls = spark.range(2).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in t.schema])
        more = t.unionByName(nulls)
        for name in ("id", "key", "host", "n", "kind"):
            more = more.withColumn(name, F.lit("clash"))
        more.write.parquet(str(dirty / f.name))
    return empty, dirty


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_no_rows_nulls_and_clashing_names(spark, edge_tables, name):
    for folder in edge_tables:
        assert core.queries()[name](spark, str(folder)).count() >= 0
