from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelode.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    empty, dirty = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("dirty")
    for f in DATA.iterdir():
        t = spark.read.parquet(str(f))
        t.limit(0).write.parquet(str(empty / f.name))
        nulls = spark.range(2).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in t.schema])
        more = t.unionByName(t).unionByName(nulls)
        for name in ("id", "key", "host", "n", "kind"):
            more = more.withColumn(name, F.lit("clash"))
        more.write.parquet(str(dirty / f.name))
    return empty, dirty


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_no_rows_repeated_rows_nulls_and_clashing_names(spark, edge_tables, name):
    empty, dirty = edge_tables
    made = q.queries()[name](spark, str(empty))
    assert made.count() == 0 or name.endswith("_report")
    found = q.queries()[name](spark, str(dirty))
    assert found.count() >= 0 and set(made.columns) <= set(found.columns)
