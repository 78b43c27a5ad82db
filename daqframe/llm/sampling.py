"""Bounded, reproducible samples of labelled rows, and the columns that operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daqframe.llm.session import checkpointed


def narrow(documents: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has."""
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(rows: DataFrame, most: int, longest: int, most_bytes: int, marks: DataFrame | None = None) -> DataFrame:
    """A bounded sample of rows (doc_id, text, label) in which no label is missing: at most `most` rows of at most most_bytes of text together.

    marks: (doc_id, label), where rows have no label of their own. Drawn are the smallest by a hash of doc_id, one row for each doc_id and label (the smallest by a
    hash of its text). An eighth of the sample is kept for labels in equal parts, the rest is filled as rows come. Texts over longest bytes are drawn only after a label's
    shorter ones, so a label that has longer ones alone is still seen. Rows without doc_id or label take no part. Nothing but numbers is shuffled until the rows are chosen.
    """
    own = [] if marks is not None else ["label"]
    key = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *own, F.xxhash64("text").alias("text_key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    if marks is not None:
        key = key.join(marks, "doc_id")
    key = key.where("doc_id is not null and label is not null")
    one = key.groupBy("doc_id", "label").agg(F.min(F.struct((F.col("size") > longest).alias("long"), "text_key", "size")).alias("x")).select("doc_id", "label", "x.*")
    one = one.withColumn("pick", F.xxhash64("doc_id"))
    # hashes are spread evenly: about twice the rows that a label can need lie below this share of them, so no task ranks more however large the table
    counts = checkpointed(one.groupBy("label").agg(F.count_if(~F.col("long")).alias("n_short"), F.count_if("long").alias("n_long")))
    labels = max(1, counts.count())
    place = F.col("pick").cast("double") / float(1 << 64) + 0.5
    need = F.when(~F.col("long"), place * F.col("n_short") < 2 * most + 64).otherwise((F.col("n_short") < most) & (place * F.col("n_long") < 2 * most + 64))
    some = one.join(F.broadcast(counts) if labels <= 1 << 16 else counts, "label").where(need).drop("n_short", "n_long")
    nth = some.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("long", "pick", "doc_id"))).where(F.col("nth") <= most)
    first = [(F.col("nth") > max(1, most // (8 * labels))), F.col("long"), F.col("pick"), F.col("doc_id"), F.col("label")]
    chosen, left = [], most_bytes
    for r in nth.orderBy(*first).limit(most).collect():  # at most `most` rows of numbers
        if r["size"] <= left:
            chosen.append((r["doc_id"], r["label"], r["text_key"]))
            left -= r["size"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), key.schema["label"], T.StructField("text_key", T.LongType())])
    wanted = rows.sparkSession.createDataFrame(chosen, schema)
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).withColumn("text_key", F.xxhash64("text"))
    met = found.join(F.broadcast(wanted), ["doc_id", *own, "text_key"])
    return met.groupBy("doc_id", "label", "text_key").agg(F.first("text").alias("text")).select("doc_id", "text", "label")


def marks_of(labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """(doc_id, label) of what a labels table marks. A doc_id with several labels has the smallest."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        marked = marked.where(where)
    return marked.groupBy("doc_id").agg(F.min("label").alias("label"))


def unused(table: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
