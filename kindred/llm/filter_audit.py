"""Audit of how filters interact, by Walsh-Hadamard sums.

A document fails some of five filters: a mask of five bits. For each part and label 32 signed parity sums are aggregated:
sum w adds +1 for a document that fails an even number of the filters in w, and -1 for an odd number. Sums are all that
is shuffled, one row a part, label and task, however large a part is. The transform is its own inverse up to the factor
32, so the sums give back, exactly, how many documents have each mask. From these 32 cells follows what every filter
removes at every place of every order, and the Shapley value in closed form: of the 120 orders, a document that fails
k filters is removed by each of them in 120 / k.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialise, tidily, utf8
from kindred.llm.repeats import cut_at_space

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
REPEATED = 1 << FILTERS.index("E")
MARKS = re.compile(rb"[#$%&*|]")
NOT_CAPITAL, CONTINUED = bytes(set(range(256)) - set(range(65, 91))), bytes(range(0x80, 0xC0))
STRETCH = 1 << 22  # bytes of a text whose words are held at once


def failures(text: bytes) -> int:
    """The mask of filters A to D: few words, few distinct words, many capitals, marks."""
    n, distinct = 0, set()
    for part in cut_at_space(text, STRETCH):
        words = part.split()
        n += len(words)
        distinct.update(words)
    capitals, points = len(text.translate(None, NOT_CAPITAL)), len(text.translate(None, CONTINUED))
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (MARKS.search(text) is not None) << 3


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of filters A to D) and the SHA-256 of the text, one row a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            mask = np.fromiter(map(failures, texts), np.int32, len(texts))
            same = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(mask), same], names=["doc_id", "part", "mask", "same"])

    return rows.mapInArrow(tidily(run), "doc_id long, part string, mask int, same binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good (a label says quality 1) and toxic (a label says toxic 1). A null doc_id has no label, and no join."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    joined = rows.filter("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, flag("good"), flag("toxic"))
    return joined.unionByName(rows.filter("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def masks(rows: DataFrame) -> DataFrame:
    """part, good, toxic, mask (of all five filters) and n, from labelled rows.

    Copies of a text have one mask of A to D. So a text is kept as a row for each part and label that it occurs in: how often, its least
    doc_id there, and how often that one. Only rows with the least doc_id of all pass E. Tasks combine first; a text that
    is a third of the table sends a few rows a task.
    """
    key = F.coalesce("doc_id", F.lit(2**63 - 1))  # nulls last
    once = rows.groupBy("same", "mask", "part", "good", "toxic", key.alias("id")).agg(F.count("*").alias("n"))
    texts = once.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    texts = materialise(texts, "texts")
    least = texts.groupBy("same").agg(F.min("first").alias("least"))
    passing = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.inline(F.array(F.struct(F.col("mask").alias("mask_"), passing.alias("n_")), F.struct((F.col("mask") + REPEATED).alias("mask_"), (F.col("n") - passing).alias("n_"))))
    return texts.join(least, "same").select("part", "good", "toxic", split).select("part", "good", "toxic", F.col("mask_").alias("mask"), F.col("n_").alias("n"))


def sign(mask: Column, w: Column) -> Column:
    return F.lit(1) - F.lit(2) * F.bit_count(mask.bitwiseAND(w)).bitwiseAND(F.lit(1))


def parity_sums(counted: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed parity sums."""
    sums = [F.sum(F.col("n") * sign(F.col("mask"), F.lit(w))).alias(f"s{w}") for w in range(CELLS)]
    return counted.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*(F.col(f"s{w}") for w in range(CELLS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """One row a part: all, good and toxic, each the 32 numbers of documents by mask. The inversion is exact: its sum is 32 times a count."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    inverse = F.transform(every, lambda m: F.aggregate(F.transform(every, lambda w: F.element_at("sums", w + 1) * sign(m, w)), F.lit(0).cast("long"), lambda x, y: x + y))
    found = sums.select("part", "good", "toxic", F.posexplode(inverse).alias("mask", "n")).withColumn("n", F.shiftright("n", len(FILTERS)))
    of = lambda m, which: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col("n")) if which is None else F.when((F.col("mask") == m) & F.col(which), F.col("n"))), F.lit(0))
    return found.groupBy("part").agg(*(F.array(*(of(m, which) for m in range(CELLS))).alias(name) for name, which in (("all", None), ("good", "good"), ("toxic", "toxic"))))


def orders(table: DataFrame) -> DataFrame:
    """600 rows a part: each order and step with what is kept, removed, redundant, failed alone, lost, and the Shapley value."""
    letters = [F.lit(x) for x in FILTERS]
    bits = lambda text: sum((F.when(F.instr(text, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    x = table.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    own, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    x = x.withColumn("own", bits(own)).withColumn("before", bits(before))
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    total = lambda which, weight: F.aggregate(every, F.lit(0).cast("long"), lambda s, m: s + F.element_at(which, m + 1) * weight(m)).cast("long")
    has, gone = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    kept = lambda m: (~has(m) & ~gone(m)).cast("long")
    removed = lambda m: (has(m) & ~gone(m)).cast("long")
    share = F.lit([0, *(len(ORDERS) // k for k in range(1, len(FILTERS) + 1))])
    return x.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("all", kept).alias("kept"), total("all", removed).alias("removed"), total("all", lambda m: (has(m) & gone(m)).cast("long")).alias("redundant"),
        total("all", lambda m: (m == F.col("own")).cast("long")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        total("all", lambda m: F.when(has(m), F.element_at(share, (F.bit_count(m) + 1).cast("int"))).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is the empty text, which fails A alone (and E, where a smaller doc_id has no text either); a null source
    is the part of the empty text. Rows of one doc_id and text are documents of their own, none of which repeats another; a null doc_id
    comes after all others. Labels of one doc_id count together: one that says so is enough. No documents, no parts, no
    rows. Further columns of both tables are not looked at.
    """
    rows = materialise(measured(docs), "measured")
    return orders(materialise(cells(parity_sums(masks(labelled(rows, labels)))), "cells"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_BIT = "CASE substr(filter_order, {at}, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END"
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, (len({_WORDS}) < 200)::INT + 2 * (100 * len(list_distinct({_WORDS})) < 50 * len({_WORDS}))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(q) AS g, sum(x) AS x FROM m GROUP BY part, mask),
o AS (SELECT a || b || c || d || e AS filter_order FROM unnest(['A','B','C','D','E']) t1(a), unnest(['A','B','C','D','E']) t2(b), unnest(['A','B','C','D','E']) t3(c), unnest(['A','B','C','D','E']) t4(d), unnest(['A','B','C','D','E']) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, {_BIT.format(at="step")} AS own, {" + ".join(f"CASE WHEN step > {i} THEN {_BIT.format(at=i)} ELSE 0 END" for i in range(1, 5))} AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (own | before) = 0) AS kept, sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0) AS redundant,
  sum(n) FILTER (WHERE mask = own) AS unique_fails, sum(g) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS good_lost, sum(x) FILTER (WHERE mask & own <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r"""
