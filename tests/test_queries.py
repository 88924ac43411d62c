"""Every registered query of the reference's operators runs on the smallest tables; determinism over partition counts."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain():
    return {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


def test_oracles_are_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]


def test_partition_counts_do_not_matter(spark):
    names = ["bm25_topk", "clean_lines", "group_summary", "session_state", "chunk_recursive", "trace_steps"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in names:
            out = []
            for n in ("1", "8"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                df = plain()[name](spark, SF)
                out.append(sorted(map(repr, df.select(*sorted(df.columns)).collect())))
            assert out[0] == out[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
