import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_duplicates import near_copies_of
from test_mixing import brute_targets
from test_quality import brute as brute_quality
from test_secrets import brute_base, brute_method
from test_tokens import direct, encoder, plain_best_fit  # noqa: F401

import corpus_pipeline
from kindred.llm import catalogue, quality


def plain_redacted(text):
    """Marks in place of all stretches that the fixed patterns and the entropy windows cover."""
    if text is None:
        return None
    spans = brute_base(text)
    on, begin = [*brute_method(text), False], None
    for i, x in enumerate(on):
        if x and begin is None:
            begin = i
        elif not x and begin is not None:
            spans.append(("entropy", begin, i))
            begin = None
    order = ("assign", "access", "hex", "entropy")
    out, at, until = "", 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))):
        if a >= until or not out:
            out += text[max(at, until) : a] + f"<{kind}>"
        until = at = max(until, b)
    return out + text[until:]


def check_quality(before, after):
    verdict = {r["doc_id"]: r for r in quality.assess(before).collect()}
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        failed = brute_quality(r["text"])[-1]
        assert verdict[r["doc_id"]]["base_failed"] == failed
        assert (r["doc_id"] in kept) == (not failed and verdict[r["doc_id"]]["quality"] >= 0.5)


def check_near_dedup(before, after):
    rows, first = sorted(map(tuple, before.select("doc_id", "text").collect())), {}
    for r, c in zip(rows, near_copies_of([r[1] for r in rows]), strict=True):
        first.setdefault(c, r[0])
    assert len(first) < len(rows) and {r["doc_id"] for r in after.collect()} == set(first.values())


def check_secrets(before, after):
    expected = {r["doc_id"]: plain_redacted(r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected


def check_mixing(before, after):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, sizes, taken, noise = {tuple(r) for r in before.collect()}, defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r["source"]] += size(r["text"])
        noise[r["source"]] += size(r["text"]) ** 2
    out = after.collect()
    for r in out:
        assert tuple(r) in rows
        taken[r["source"]] += size(r["text"])
    assert max(Counter(r["doc_id"] for r in out).values()) <= 2
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= 128 + 2 * noise[s] ** 0.5


def check_packing(before, after, tokens):
    expected = Counter()
    for r in before.collect():
        ids = [*direct(tokens, r["text"]), 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            expected[r["doc_id"], k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    got = after.collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == expected
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(2048 - v for v in bins.values()) == plain_best_fit([r["length"] for r in got], 2048)


def test_stages_in_turn_against_plain_versions(spark, folder, tmp_path, encoder):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, checks = docs.columns, (check_quality, check_near_dedup, check_secrets, check_mixing, lambda b, a: check_packing(b, a, encoder))
    for k, ((_, stage), check) in enumerate(zip(corpus_pipeline.STAGES, checks, strict=True)):
        path = f"{tmp_path}/stage{k}"
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == names or k == 4
        check(before, docs)


def test_layout_has_no_say(spark, docs):
    """All stages whose rows a hash or an order picks: the same rows come out of any layout, and of a second run. Repeated rows, nulls
    and clashing names included."""
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.secrets, corpus_pipeline.mixing):
        results = [Counter(map(str, stage(spark, d, "").collect())) for d in (docs, docs, docs.repartition(7), docs.coalesce(1).sortWithinPartitions("n_chars", "text"))]
        assert results[0] and all(r == results[0] for r in results)


def test_run_and_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_catalogue():
    names = list(catalogue.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(catalogue.oracle_sql()) <= set(names)
