"""Sharding along a Hilbert curve through metadata space; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.llm.common import materialize

SHARDS = 24
BITS = 5
GROUP_ROWS = 100_000


def _hilbert(cells: DataFrame, bits: int) -> DataFrame:
    """Adds h, the place of (x0, x1, x2), each of ``bits`` bits, on the three-dimensional Hilbert curve."""
    x = [F.col(f"x{i}") for i in range(3)]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(3):
            on = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            new = {"x0": F.when(on, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t))}
            if i:
                new[f"x{i}"] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(t))
            cells = cells.withColumns(new)
    cells = cells.withColumn("x1", x[1].bitwiseXOR(x[0])).withColumn("x2", x[2].bitwiseXOR(x[1]))
    flip = F.lit(0)
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(x[2].bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0))
    cells = cells.withColumn("flip", flip)
    h = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for i in range(3):
            h = h * 2 + F.shiftright(x[i].bitwiseXOR(F.col("flip")), level).bitwiseAND(1)
    return cells.withColumn("h", h.cast("int")).drop("flip")


def _running(counts: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``counts(…, n)`` with before, the sum of n over all rows that come earlier in ``order`` (no two alike), and total.

    Rows are dealt to ranges of the order; each range sums its own, and one row a range gives what comes before it.
    """
    ranged = materialize(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), tag)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").withColumn("before", F.col("base") + F.col("within")).drop("part", "base", "within")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, str] = ("lang", "source"), bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Shards of equal row count cut from the Hilbert order of (first dim, second dim, text size).

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, h, law ``rows``, shard, slot (gapless from 0), and
    grown_shard (null under this law). String dims are quantised by the rank of their value over the whole range. Sizes fall
    into eight classes a doubling and those into cells of about equal row counts, so the curve uses its whole range. Order on
    the curve: h, the two dims, size class, c, doc_id, CRC-32 of the text; c is the CRC-32 of doc_id as text, that of the text
    where doc_id is null. Row r of N is in shard floor(r * shards / N), so counts differ by one at most.

    No task sorts more than about ``group_rows`` rows of one cell, unless they share a doc_id: a cell is divided by ranges of
    c into as many groups as its count asks for; group sizes are summed into offsets (one row a group) and rows numbered in groups.
    Null texts have size 8 and CRC 0, null dims and null doc_ids count as empty strings in the order. Repeated rows are rows
    like others; an empty table gives no row; extra columns are ignored. Values of a dim and groups of cells are numbered by
    ranges, so a dim may have any number of values; one task sees one row a range, and one a size class.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = materialize(
        docs.select(
            "doc_id", F.coalesce(F.col(dims[0]).cast("string"), F.lit("")).alias("d0"), F.coalesce(F.col(dims[1]).cast("string"), F.lit("")).alias("d1"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
        )
        .withColumn("b", F.expr("cast(length(bin(size)) * 8 + (shiftright(size, length(bin(size)) - 4) & 7) as int)"))
        .withColumn("c", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.col("text_crc32"))),
        "narrow",
    )
    key, side = ["d0", "d1", "b"], 1 << bits
    cells = materialize(narrow.groupBy(*key).agg(F.count("*").alias("n")), "counts")
    for i in range(2):
        values = _running(cells.select(f"d{i}").distinct().withColumn("n", F.lit(1)), [f"d{i}"], "values")
        cells = cells.join(values.select(f"d{i}", F.expr(f"cast(before * {side} div total as int)").alias(f"x{i}")), f"d{i}")
    classes, earlier = cells.groupBy("b").agg(F.sum("n").alias("m")), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("m").over(earlier), F.lit(0)), F.sum("m").over(Window.partitionBy())
    classes = classes.withColumns({"before": before, "total": total}).select("b", F.expr(f"cast(before * {side} div total as int)").alias("x2"))
    cells = cells.join(classes, "b")
    cells = materialize(_hilbert(cells, bits).select(*key, "h", F.expr(f"cast((n + {group_rows - 1}) div {group_rows} as int)").alias("parts")), "cells")
    placed = narrow.join(cells, key).withColumn("g", F.expr("cast(c * parts div 4294967296 as int)"))
    order = ["h", *key, "g"]
    offsets = materialize(_running(placed.groupBy(*order).agg(F.count("*").alias("n")), order, "groups").select(*order, F.col("before").alias("offset"), "total"), "offsets")
    within = F.row_number().over(Window.partitionBy(*order).orderBy("c", "doc_id", "text_crc32")) - 1
    ranked = placed.withColumn("within", within).join(offsets, order).withColumn("r", F.col("offset") + F.col("within"))
    out = ranked.withColumn("shard", F.expr(f"cast(r * {shards} div total as int)"))
    return out.select(
        "doc_id", "size", "text_crc32", "h", F.lit("rows").alias("law"), "shard", F.expr(f"r - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1, **params) -> None:
    """Writes ``docs`` as one folder a shard, each of about ``files`` files in curve order, so that a filter on any dim reads few.

    Rows are dealt to shards x files ranges of (shard, slot), so a task writes one file, not a shard; all rows are written,
    also those with null or shared doc_ids. Rows of one doc_id, CRC and size are numbered on both sides of the join.
    """
    text, key = F.coalesce("text", F.lit("")), ["_i_9f3c", "_s_9f3c", "_c_9f3c", "_n_9f3c"]

    def keyed(df: DataFrame, size, crc) -> DataFrame:
        df = df.withColumns({key[0]: F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")), key[1]: size, key[2]: crc})
        return df.withColumn(key[3], F.row_number().over(Window.partitionBy(*key[:3]).orderBy(F.lit(0))))

    placed = hilbert_shards(docs, shards, **params).select("doc_id", "size", "text_crc32", F.col("shard").alias("_shard_9f3c"), F.col("slot").alias("_slot_9f3c"))
    placed = keyed(placed, F.col("size"), F.col("text_crc32")).drop("doc_id", "size", "text_crc32")
    rows = keyed(docs, (F.octet_length(text) + 8).cast("long"), F.crc32(text)).join(placed, key).drop(*key)
    order = ["_shard_9f3c", "_slot_9f3c"]
    out = rows.repartitionByRange(shards * files, *order).sortWithinPartitions(*order).drop("_slot_9f3c")
    out.drop("shard").withColumnRenamed("_shard_9f3c", "shard").write.partitionBy("shard").parquet(path)


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _curve_sql() -> str:
    """The curve's steps as a chain of CTEs from x(…, x0, x1, x2) to ``curve`` with h."""
    steps, now = [], "x"
    for level in range(BITS - 1, 0, -1):
        for i in range(3):
            q, p = 1 << level, (1 << level) - 1
            a = "x0" if not i else f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {p}) END"
            others = ", ".join(f"x{j}" if j != i or not i else f"{a} AS x{j}" for j in (1, 2))
            steps.append(f"s{len(steps)} AS (SELECT d0, d1, b, CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, xor(x0, x{i}) & {p}) END AS x0, {others} FROM {now})")
            now = f"s{len(steps) - 1}"
    flip = "0"
    for level in range(BITS - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x2 & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    h = "0"
    for level in range(BITS - 1, -1, -1):
        for i in range(3):
            h = f"({h} * 2 + ((xor(x{i}, flip) >> {level}) & 1))"
    steps.append(f"g0 AS (SELECT d0, d1, b, x0, xor(x1, x0) AS x1, x2 FROM {now})")
    steps.append("g1 AS (SELECT d0, d1, b, x0, x1, xor(x2, x1) AS x2 FROM g0)")
    steps.append(f"g2 AS (SELECT *, {flip} AS flip FROM g1)")
    steps.append(f"curve AS (SELECT d0, d1, b, ({h})::INTEGER AS h FROM g2)")
    return ",\n".join(steps)


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB, with the byte table in crc.tab."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda z: ('0x' || z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _sql() -> str:
    from ragmill.llm.langid import CRC_TABLE

    return f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
sized AS (
  SELECT doc_id, coalesce(lang, '') AS d0, coalesce(source, '') AS d1, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
    length(bin((octet_length(encode(coalesce(text, ''))) + 8)::BIGINT))::INTEGER AS bits, ({crc32_sql("coalesce(doc_id::VARCHAR, text, '')")})::BIGINT AS c, ({crc32_sql("coalesce(text, '')")})::BIGINT AS text_crc32
  FROM documents, crc),
narrow AS MATERIALIZED (SELECT *, bits * 8 + ((size >> (bits - 4)) & 7) AS b FROM sized),
v0 AS (SELECT d0, ((row_number() OVER (ORDER BY d0) - 1) * 32 // count(*) OVER ())::INTEGER AS x0 FROM (SELECT DISTINCT d0 FROM narrow)),
v1 AS (SELECT d1, ((row_number() OVER (ORDER BY d1) - 1) * 32 // count(*) OVER ())::INTEGER AS x1 FROM (SELECT DISTINCT d1 FROM narrow)),
v2 AS (SELECT b, ((sum(n) OVER (ORDER BY b) - n) * 32 // sum(n) OVER ())::INTEGER AS x2 FROM (SELECT b, count(*) AS n FROM narrow GROUP BY 1)),
x AS (SELECT d0, d1, b, x0, x1, x2 FROM (SELECT DISTINCT d0, d1, b FROM narrow) JOIN v0 USING (d0) JOIN v1 USING (d1) JOIN v2 USING (b)),
{_curve_sql()},
ranked AS (
  SELECT n.*, h, row_number() OVER (ORDER BY h, d0, d1, b, c, doc_id NULLS FIRST, text_crc32) - 1 AS r, count(*) OVER () AS total
  FROM narrow n JOIN curve USING (d0, d1, b))
SELECT doc_id, size, text_crc32, h, 'rows' AS law, (r * {SHARDS} // total)::INTEGER AS shard,
  (r - ((r * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM ranked
"""


SHARDING_SQL = _sql()
