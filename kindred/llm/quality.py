"""Quality rules by weak supervision.

Each rule votes for good (+), for bad (-) or abstains (0) on one document. The rules are well-known rough tests that err
in their own ways: half of all good documents break one of them or come near it. Expectation maximisation over the counts of
vote patterns estimates how often each rule votes against good documents and against bad ones of either kind, from nothing but
how the rules agree; the posterior probability of good decides, in place of demanding that all rules pass. A rule that
votes against good documents as often as against bad ones loses its say, and a lone negative vote that nothing supports is outvoted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACES, materialise, mix64, tidily, utf8
from kindred.llm.tokens import text_slices

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5
RULES = ("symbols", "any_symbol", "symbol_words", "plain", "repeats", "lines", "capitals", "exclaims", "lengths", "digits", "variety", "stutter", "ends", "short_lines", "short", "long")
KINDS = 2  # hidden classes of bad documents
# Letters, and the punctuation that may stand around a word.
PLAIN = r"""^["'(]*[A-Za-z\x{80}-\x{10FFFF}'-]+[.,;:!?"')]*$"""
SYMBOLIC = r"[#*$%&|<>]"
# How a sentence ends, and the words that a line has.
ENDS = (b".", b"!", b"?", b'"', "”".encode())
FEW_WORDS = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each word in the list of distinct words, offsets of each text, distinct words) of an Arrow array."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    return coded.indices.to_numpy().astype(np.int64), bounds, coded.dictionary


def owner_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def repeated_words(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text, the first one included."""
    n, owner = len(ids), owner_of(bounds)
    out = np.zeros(len(bounds) - 1, np.int64)
    starts = n - window + 1
    if starts < 2:
        return out
    r = mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(starts, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + r[j : j + starts]
    inside = np.flatnonzero(owner[:starts] == owner[window - 1 :])
    key = h[inside] ^ mix64(owner[inside].astype(np.uint64))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(ordered), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = inside[order[twice]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    np.add.at(out, owner[np.cumsum(edge)[:-1] > 0], 1)
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The features of an Arrow array of non-null texts."""
    raw = utf8(texts)
    ids, bounds, words = split_words(texts)
    n_words = np.diff(bounds)
    word_chars = np.fromiter((len(x.translate(None, SPACES + CONTINUATION)) for x in raw), np.int64, len(raw))
    count = lambda which: np.fromiter((len(x) - len(x.translate(None, which)) for x in raw), np.int64, len(raw))
    dup, n_lines, n_ends, n_short = (np.zeros(len(raw), np.int64) for _ in range(4))
    for i, x in enumerate(raw):
        lines = [y for y in x.split(b"\n") if y.strip(SPACES)]
        n_lines[i], dup[i] = len(lines), len(lines) - len(set(lines))
        n_ends[i] = sum(y.rstrip(SPACES).endswith(ENDS) for y in lines)
        n_short[i] = sum(len(y.split(None, FEW_WORDS)) < FEW_WORDS for y in lines)
    upper = count(bytes(range(65, 91)))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": count(SYMBOLS), "n_dup_lines": dup, "n_repeat_words": repeated_words(ids, bounds),
        "n_lines": n_lines, "n_ends": n_ends, "n_short_lines": n_short, "n_upper": upper, "n_lower": count(bytes(range(97, 123))), "n_exclaims": count(b"!"), "n_digits": count(b"0123456789"),
        "n_distinct": distinct_words(ids, bounds), "n_stutters": stutters(ids, bounds),
        "n_symbol_words": matching_words(ids, bounds, words, SYMBOLIC), "n_plain": matching_words(ids, bounds, words, PLAIN),
    }


def matching_words(ids: np.ndarray, bounds: np.ndarray, words: pa.Array, pattern: str) -> np.ndarray:
    """Words of each text that a pattern finds; each distinct word is looked at once."""
    found = pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    return np.bincount(owner_of(bounds), weights=found[ids], minlength=len(bounds) - 1).astype(np.int64) if len(ids) else np.zeros(len(bounds) - 1, np.int64)


def distinct_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    owner = owner_of(bounds)
    if not len(ids):
        return np.zeros(len(bounds) - 1, np.int64)
    pair = np.unique(owner * (int(ids.max()) + 1) + ids)
    return np.bincount(pair // (int(ids.max()) + 1), minlength=len(bounds) - 1)


def stutters(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words that equal the word before them in the same text."""
    owner = owner_of(bounds)
    same = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=len(bounds) - 1)


def votes(x: dict[str, np.ndarray]) -> np.ndarray:
    """One column a rule: 1 good, -1 bad, 0 abstains (where the text has too little for the rule)."""
    n, lines = np.maximum(x["n_words"], 1).astype(float), np.maximum(x["n_lines"], 1).astype(float)
    letters, mean = (x["n_upper"] + x["n_lower"]).astype(float), x["word_chars"] / n

    def vote(bad, asked=True):
        return np.where(asked, np.where(bad, -1, 1), 0)

    return np.stack(
        [
            vote(x["n_symbols"] / n > 0.1),
            vote(x["n_symbols"] > 0),
            vote(x["n_symbol_words"] / n > 0.1),
            vote(x["n_plain"] / n < 0.9),
            vote(x["n_repeat_words"] / n > 0.15),
            vote(x["n_dup_lines"] / lines > 0.3, x["n_lines"] >= 2),
            vote(x["n_upper"] / np.maximum(letters, 1) > 0.2, letters >= 20),
            vote(x["n_exclaims"] / n > 0.02),
            vote((mean < 4) | (mean > 7)),
            vote(x["n_digits"] / np.maximum(x["word_chars"], 1) > 0.05),
            vote(x["n_distinct"] / n < 0.5, x["n_words"] >= 50),
            vote(x["n_stutters"] / n > 0.05),
            vote(x["n_ends"] / lines < 0.5),
            vote(x["n_short_lines"] / lines > 0.3),
            vote(x["n_words"] < 100),
            vote(x["n_words"] > 2000),
        ],
        axis=1,
    ).astype(np.int8)


def seeds(against: np.ndarray, weight: np.ndarray, kinds: int) -> list[int]:
    """Patterns that stand for the kinds of bad to begin with: frequent, with two negative votes at least, and each unlike those before it."""
    some = np.flatnonzero(against.sum(1) >= 2)
    unlike, out = np.ones(len(some)), []
    for _ in range(kinds):
        score = weight[some] * unlike
        if not score.max(initial=0) > 0:
            break
        i = some[score.argmax()]
        out.append(int(i))
        both = against[some] @ against[i]
        unlike = np.minimum(unlike, 1 - both / (against[some].sum(1) + against[i].sum() - both))
    return out


def score_votes(patterns: list[str], counts: list[int], rounds: int = 500, strength: float = 4.0, kinds: int = KINDS) -> tuple[np.ndarray, dict]:
    """Posterior probability of good of each vote pattern, by expectation maximisation over all counts.

    The hidden classes are good and ``kinds`` kinds of bad; in each, each rule has a probability that its vote
    is negative. All of these and the classes' shares are estimated, with no bounds; priors worth ``strength`` documents
    a class say where to begin: good documents seldom get a negative vote, a kind of bad mostly gets those of the pattern that it
    begins with. Abstentions say nothing. Also gives the shares, the probabilities and each rule's accuracy (how often its votes
    agree with the posterior). Without a pattern of two negative votes there is nothing to learn from, and all is good.
    """
    if not patterns:
        return np.zeros(0), {}
    order = np.argsort(np.array(patterns), kind="stable")
    v = np.array([["-0+".index(c) for c in patterns[i]] for i in order])
    w = np.array(counts, float)[order]
    against, votes_cast = (v == 0).astype(float), (v != 1).astype(float)  # pattern, rule
    first = seeds(against, w, kinds)
    prior = np.vstack([np.full((1, len(RULES)), 0.05), np.where(against[first] > 0, 0.7, 0.1)])  # probability that a vote of the rule is negative
    shares_prior = np.array([0.8] + [0.2 / len(first)] * len(first)) if first else np.ones(1)
    shares, negative, good = shares_prior, prior.copy(), np.zeros(len(v))
    for _ in range(rounds):
        logs = np.log(shares) + against @ np.log(negative).T + (votes_cast - against) @ np.log1p(-negative).T
        belong = np.exp(logs - logs.max(1, keepdims=True))
        belong /= belong.sum(1, keepdims=True)
        moved, good = np.abs(belong[:, 0] - good).max(), belong[:, 0]
        weight = (w[:, None] * belong).T
        shares = (weight.sum(1) + strength * shares_prior) / (w.sum() + strength)
        negative = (weight @ against + strength * prior) / (weight @ votes_cast + strength)
        if moved < 1e-9:
            break
    agree = w @ (against * (1 - good)[:, None] + (votes_cast - against) * good[:, None])
    accuracy = agree / np.maximum(w @ votes_cast, 1)
    out = np.empty(len(v))
    out[order] = good
    return out, {"shares": shares.tolist(), "negative": negative.tolist(), "accuracy": dict(zip(RULES, accuracy.tolist(), strict=True))}


def _measured(docs: DataFrame, keep: Column, name: str) -> DataFrame:
    """A written table: ``row`` (what is kept of each row, as one struct, so no name can clash), features and votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_slices(whole):
                x = measure(part.column("text"))
                signs = ["".join("-0+"[y + 1] for y in r) for r in votes(x).tolist()]
                yield pa.record_batch([part.column("row"), *(pa.array(x[k], pa.int64()) for k in FEATURES), pa.array(signs, pa.string())], names=["row", *FEATURES, "votes"])

    rows = docs.select(keep.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {', '.join(f'{k} long' for k in FEATURES)}, votes string"
    return materialise(rows.mapInArrow(tidily(run), schema), name)


def _judged(measured: DataFrame) -> DataFrame:
    """Adds quality (posterior), base_failed and kept. Of 16 rules 13 never abstain, so there are fewer than 2**13 * 3**3 vote patterns (221,184), at any
    size of the table."""
    spark = measured.sparkSession
    counted = measured.groupBy("votes").count().collect()
    good, _ = score_votes([r["votes"] for r in counted], [r["count"] for r in counted])
    table = spark.createDataFrame([(r["votes"], float(g)) for r, g in zip(counted, good, strict=True)], "votes string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.join(F.broadcast(table), "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))


def assess(docs: DataFrame) -> DataFrame:
    """Features, votes, quality, base_failed and kept of each row, beside doc_id.

    A null text is empty: no words, base_failed. Rows are judged one by one, so repeated rows get equal verdicts; an
    empty table gives an empty result. What the rules learn comes from the vote patterns of all rows.
    """
    judged = _judged(_measured(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), "features"))
    return judged.select("row.*", *FEATURES, "votes", "quality", "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
    judged = _judged(_measured(docs, F.struct("*"), "measured"))
    return judged.filter("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
