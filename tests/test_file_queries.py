import pytest
from oracle import same

from docquarry import file_queries


@pytest.mark.parametrize("name", sorted(file_queries.queries()))
def test_files_hold_what_the_rows_say(spark, tiny, name):
    same(file_queries.queries()[name](spark, tiny), file_queries.oracle_sql()[name], tiny)


@pytest.mark.parametrize("name", ["file_xls", "file_xlsx"])
def test_keys_wider_than_their_header(spark, tiny, tmp_path, name):
    spark.read.parquet(f"{tiny}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, f"Supplier#{k:09}", k % 2) for k in (7, 999, 1000, 1001, 12345)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    same(file_queries.queries()[name](spark, str(tmp_path)), file_queries.oracle_sql()[name], str(tmp_path))
