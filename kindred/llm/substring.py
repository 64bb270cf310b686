"""Substring de-duplication over words: seed and extend.

Seeds are winnowed anchors (seven-word grams, the least of each thirteen-word window). Documents that share a seed
meet there; the seed is extended both ways, first to the whole span of windows around it and, where spans differ, window
by window; runs of covered windows join into maximal repeats. See ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import tidily, utf8
from kindred.llm.repeats import LOWEST, covered_ranges, covered_units, keyed, word_units

WINDOW, GRAM = 13, 7


def repeated_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, repeats (array of start, end in words): maximal stretches covered by windows of ``width``
    words whose words also start in a document with a smaller doc_id, and kept_text, the other words joined by a space.

    A null text has no words; a null doc_id counts as the least; repeated rows each get their row. Windows are judged
    on the input. Rows that share a doc_id do not cover one another.
    """
    rows, distinct = keyed(docs)
    found = rows.join(covered_ranges(distinct, word_units, width, min(GRAM, width), across=True), ["doc", "version"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, kept = [], [], []
            for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                gone = covered_units(ranges, width, len(words))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x) if len(edges) else b" ".join(words))
            yield pa.record_batch([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "repeats", "kept_text"])

    out = found.select("doc", "text", "ranges").mapInArrow(tidily(cut), "doc long, n_words long, repeats array<struct<start:long,end:long>>, kept_text string")
    return out.select(F.nullif(F.col("doc"), F.lit(LOWEST)).alias("doc_id"), "n_words", "repeats", "kept_text")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM n, unnest(range(1, n - 11)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k.range AS p FROM windows JOIN firsts USING (h), range(13) k WHERE first_doc < doc_id),
counts AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(range(1, n + 1)) AS p, unnest(w) AS word FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + r.end - r.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
