"""What the operators share: table access, whole-text columns, joins with checked sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a written table is broadcast; beyond, :func:`join_small` deals it out.
BROADCAST_ROWS = 50_000
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out() -> Column:
    """Rows whose labels are never learnt from; rows without an id are held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` (null where a column is missing) and the whole row as ``row``, so that no column of
    the rows can clash with one of ours."""
    cols = [(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in needed]
    return docs.select(F.struct(*docs.columns).alias("row"), *cols)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` as a lambda variable, so that ``value`` is computed once per row
    however often ``body`` (also inside its own lambdas) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a written table that has one row per key. It is broadcast if its counted rows are
    few; else a key's rows of ``big`` are dealt over ``SALTS`` partitions."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c not in on]), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def in_batches(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``f`` turns an Arrow batch into columns of ``schema``; batches are independent, so a lost
    task is simply run again."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct documents as (doc, text), where the numbers ``doc`` order them, and the (doc, doc_id)
    of every row. Where ids are unique the number is the id itself, and None stands for the second
    table; else distinct (doc_id, text) are numbered in order, rows without id last."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n, distinct, named = texts.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if n == distinct == named:
        return texts.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text"), None
    marked = texts.withColumn("tie", F.xxhash64("text"))
    known = marked.select("doc_id", "tie").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    numbers = docs.sparkSession.createDataFrame(known.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), "known long, tie2 long, doc long")
    rows = marked.join(numbers, F.col("doc_id").eqNullSafe(F.col("known")) & (F.col("tie") == F.col("tie2")))
    return rows.select("doc", "text").dropDuplicates(["doc"]), rows.select("doc", "doc_id")
