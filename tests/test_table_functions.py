"""The table function of turns against the window's turns, and what it refuses."""

import pytest

from keepsake.operators import conversations as cv
from keepsake.sources import tables
from keepsake.sources.archive import chat_messages


def test_turns_in_sql(spark, sf):
    tables.register(spark)
    log = chat_messages(spark, sf)
    log.createOrReplaceTempView("test_log")
    got = spark.sql("SELECT * FROM turns(TABLE(test_log))").select("thread_id", "turn_no", "author", "start_ts", "end_ts", "n_messages", "first_msg")
    want = cv.turn_table(log).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT count(*) FROM turns(TABLE(test_log), -1)").first()[0] == log.count()


def test_refuses(spark):
    tables.register(spark)
    spark.range(3).createOrReplaceTempView("no_log")
    with pytest.raises(Exception, match="lacks the columns thread_id, author, ts, msg_id"):
        spark.sql("SELECT * FROM turns(TABLE(no_log))").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM turns(1)").collect()
