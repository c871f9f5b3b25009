"""Every registered query with an oracle gives DuckDB's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tidalframe.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(map(norm, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    b = sorted((tuple(map(norm, r)) for r in want.fetchall()), key=key)
    assert a == b


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bit_fields_of_short_and_null_texts_equal_their_oracle(spark, tmp_path):
    texts = ["a", "b", "Re", "De", "Re.", "Erö", "Von.", "Avec.", "Erö.", "sixsix", "longer text", None, None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = registry.queries()["bit_fields"](spark, str(tmp_path)).select("blob_id", "a", "b", "c", "clear").collect()
    want = con.execute(f"SELECT blob_id, a, b, c, clear FROM ({registry.oracle_sql()['bit_fields']})").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["descriptor", "window_info", "pulse_fields", "reorder_lengths", "downmix_fields", "metadata_bytes", "spatial_fields", "range_payload", "writer_options", "file_header"])
def test_records_of_a_table_in_one_split_are_dealt_out(spark, name):
    assert spark.read.parquet(f"{DATA}/part.parquet").rdd.getNumPartitions() == 1
    assert registry.queries()[name](spark, str(DATA)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
