"""What the near-duplicate join writes and what is sent to Python."""

from __future__ import annotations

import time

from pyspark.sql import functions as F


def files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_written_tables_leave_no_shuffle_files(spark):
    from gridloom.session import SHUFFLE_CLEANUP, discard, materialise

    before, n = spark.conf.get(SHUFFLE_CLEANUP), files(spark)
    table = materialise(spark.range(20_000).repartition(5, "id"))
    for _ in range(50):
        if files(spark) <= n:
            break
        time.sleep(0.1)
    assert files(spark) <= n and spark.conf.get(SHUFFLE_CLEANUP) == before
    assert table.agg(F.sum("id")).first()[0] == 19_999 * 10_000
    discard(table)


def test_posting_lists_hold_no_sketches(spark):
    from gridloom.llm.jaccard_join import grouped, posting_lists, profiles
    from gridloom.session import materialise

    words = [" ".join(f"w{d}x{i}" for i in range(60)) for d in range(4)]
    texts = [*words, *(w + " end" for w in words), *(w + " stop" for w in words), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists, marks = posting_lists(*grouped(materialise(profiles(docs, "doc_id", "text", 5, 80))), 80)
    assert set(lists.columns) == {"token", "node", "n", "pos", "multi"}
    nodes = {bytes(r.node) for r in lists.collect()}
    marked = [bytes(r.node) for r in marks.collect()]
    assert len(nodes) == 12 and nodes <= set(marked) and len(marked) == len(set(marked))


def test_batches_sent_to_python_are_small(spark):
    from gridloom.llm.common import BATCH_CONF, BATCH_ROWS, map_rows

    before = spark.conf.get(BATCH_CONF)
    try:
        spark.conf.set(BATCH_CONF, 10_000)
        assert map_rows(spark.range(5), lambda r: r, "id long").count() == 5
        assert 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS
    finally:
        spark.conf.set(BATCH_CONF, before)
