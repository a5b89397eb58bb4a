import glob
import os

import duckdb
import pytest

from cuelake.functions import text as T
from cuelake.plans import protocol_queries, queries, workflow_queries
from cuelake.plans.queries import flagship
from cuelake.sources import srt

QUERIES = queries.QUERIES | workflow_queries.QUERIES | protocol_queries.QUERIES
ORACLES = queries.ORACLES | workflow_queries.ORACLES | protocol_queries.ORACLES
SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype.kind in "iuf":
            got[c], want[c] = got[c].astype(float).round(9), want[c].astype(float).round(9)
    assert rows(got) == rows(want)


def test_flagship_has_rows(spark):
    assert flagship(spark, SF).count() > 0


def test_parse_srt(spark):
    files = [("a", "﻿1\r\n00:00:00,000-->00:00:01.5\r\nHi\r\n \r\n\r\n7\r\n0:0:2,000 --> 0:0:2,000\r\nx\r\ny\r\n"), ("b", "1\n00:00:02,000 --> 00:00:01,000\nno\n"), ("c", "")]
    cues, rejects = srt.parse_srt(spark.createDataFrame(files, "media_id string, content string"))
    assert [tuple(r) for r in cues.orderBy("pos").collect()] == [("a", 0, 1, 0, 1005, "Hi"), ("a", 1, 7, 2000, 2000, "x\ny")]
    assert [r[0] for r in rejects.collect()] == ["b"]


def test_text_rules(spark):
    df = spark.createDataFrame([("Hello,  WORLD 今天",)], "t string")
    t = df.t
    got = df.select(T.transcript_key(t), T.boundary_key(t), T.has_cjk(t), T.char_limit(t), T.is_wholesale_rewrite(t, t)).first()
    assert tuple(got) == ("hello world今天", "helloworld今天", True, 18, False)
