"""Every query with SQL gives the SQL's rows on the smallest tables; queries without SQL run."""

import os

import duckdb
import pandas as pd
import pytest

from quireworks.plans import catalog, catalog_cards, catalog_governance, catalog_plans, catalog_records  # noqa: F401  (each registers its queries)
from quireworks.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("QUIREWORKS_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return f"{float(v):.7g}" if not isinstance(v, str) else v
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)


def test_events_of_one_second_come_as_in_the_sql_on_one_thread(spark, tmp_path):
    """The SQL does not order them; on more than two threads its rows change from run to run."""
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"copy (select i::bigint as event_id, i // 2 as user_id, timestamp '2024-01-01' + to_days(i::int // 2) as ts from range(40) t(i)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(ORACLE_SQL["span_overlaps"]).fetchall()
    assert sorted(map(tuple, QUERIES["span_overlaps"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 20


def test_constants_that_touch_or_overlap_are_in_no_row_left_out(spark, tmp_path):
    texts = ["erer", "Licenser", "LicenserLicenseer token", "tokenr tokener ertoken erLicense", "tokentokenLicenseLicense", "plain", "", None, "a\nerer\n務er"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["strip_page_constants"]).fetchall())
    assert sorted(map(tuple, QUERIES["strip_page_constants"](spark, str(tmp_path)).collect())) == want
    assert [r[1:] for r in want] == [("", 1), ("", 1), (" ", 2), ("r   ", 4), ("", 1), ("plain", 0), ("", 0), (None, None), ("a\n\n務", 2)]
