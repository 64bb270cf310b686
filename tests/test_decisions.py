"""Decision-list, group, plan and name fixtures."""

import pytest
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Profile, ProfileMismatch, guard_distance, guard_ids, guard_profile
from kindred.functions import bits, measures, naming, paths
from kindred.operators import classify, events, fileplan, finder, graph, match, sets, stats
from kindred.schema import SETTINGS, assert_domain, assert_unique

FOUND = "c_id long, b_id long, b_path string, distance long, rank long, truncated boolean, score double, exact boolean, b_width long, b_height long, b_file_size long"


def one_class(spark, image, candidates, profile=DEFAULT):
    images = spark.createDataFrame([(1, *image)], "image_id long, width long, height long, file_size long")
    rows = [(1, 10 + i, f"p{i}", d, i + 1, t, s, e, w, h, z) for i, (w, h, z, e, d, s, t) in enumerate(candidates)]
    return classify.classify(images, spark.createDataFrame(rows, FOUND), profile).first()


ALL = DEFAULT.__class__(score_scope="all")


@pytest.mark.parametrize(
    "image,candidates,expected",
    [
        ((1920, 1080, 500000), [(1920, 1080, 500000, True, 0, None, False)], "exact_duplicate"),
        ((1920, 1080, 200000), [(3840, 2160, 800000, False, 2, 0.996, False)], "likely_compressed"),
        ((1920, 1080, 500000), [(1920, 1080, 550000, False, 5, 0.85, False)], "variant"),
        ((1920, 1080, 500000), [], "no_baseline_match"),
        ((10, 10, 10), [(10, 10, 10, False, 1, 0.9, True)] * 50, "inconclusive"),
        ((10, 10, 10), [(10, 10, 10, True, 1, 0.9, True)] * 50, "inconclusive"),
        ((10, 10, 10), [(20, 20, 20, False, 1, 0.9, False), (20, 20, 20, False, 2, 0.8995, False)], "inconclusive"),
        ((10, 10, 10), [(10, 10, 10, False, 1, 0.996, False)], "similar_keep"),
        ((10, 10, 10), [(10, 10, 10, False, 1, 0.7499, False)], "no_baseline_match"),
        ((10, 10, 10), [(10, 10, 10, False, 1, None, False)], "not_evaluated"),
        ((10, 10, 10), [(10, 10, 10, False, 1, 0.75, False)], "variant"),
        ((10, 10, 10), [(30, 30, 10, False, 1, 0.75, False)], "similar_keep"),
    ],
)
def test_decision_list(spark, image, candidates, expected):
    assert one_class(spark, image, candidates, ALL)["analysis_type"] == expected


def test_primary_scope_ties_every_pair(spark):
    two = [(30, 30, 30, False, 1, 0.9, False), (30, 30, 30, False, 2, 0.2, False)]
    row = one_class(spark, (10, 10, 10), two)
    assert (row["analysis_type"], row["primary_id"]) == ("inconclusive", 10)
    assert one_class(spark, (10, 10, 10), two, ALL)["analysis_type"] == "similar_keep"
    none = one_class(spark, (10, 10, 10), [(30, 30, 30, False, 1, 0.2, False)])
    assert (none["analysis_type"], none["primary_id"]) == ("no_baseline_match", 10)


@pytest.mark.parametrize("same,d,s,w,h,expected", [(True, 64, None, 1, 1, "exact"), (False, 64, 0.99, 1, 1, None), (False, 2, 0.999, 500, 500, "compressed_or_reencoded"), (False, 3, 0.90, 1000, 1000, "variant"), (False, 8, 0.80, 700, 1000, "related_group"), (False, 14, 0.60, 700, 1000, "weak_candidate"), (False, 10, None, 700, 1000, "related_group")])
def test_relations(spark, same, d, s, w, h, expected):
    df = spark.createDataFrame([(same, d, s, w * h / 1e6)], "same boolean, d long, s double, ratio double")
    assert df.select(classify.relation(F.col("same"), F.col("d"), F.col("s"), F.col("ratio")).alias("c")).first()["c"] == expected


def test_relation_aggregation(spark):
    rows = [(1, "t", "a", "variant", 2, 0.98, 1), (1, "t", "b", "related_group", 3, 0.90, 2)]
    found = spark.createDataFrame(rows, "t_image_id long, t_relative_path string, r_image_id string, classification string, class_rank long, score double, distance long")
    (row,) = finder.matches(found).collect()
    assert (row["best_reference_id"], row["classification"], row["n_relations"]) == ("a", "variant", 2)
    assert finder.filter_matches(finder.matches(found), "b", "related_group").count() == 1
    assert finder.filter_matches(finder.matches(found), "b", "variant").count() == 0


IMAGES = "image_id long, phash_hex string, width long, height long, file_size long, relative_path string"


def images(spark, rows):
    df = spark.createDataFrame([(i + 1, p, w, h, z, f"{chr(97 + i)}.png") for i, (p, w, h, z) in enumerate(rows)], IMAGES)
    return df.withColumn("phash", bits.from_hex(F.col("phash_hex"))).withColumn("digest", F.lit("d"))


def components_of(spark, rows, d):
    i = images(spark, rows)
    out = {}
    for r in graph.connected_components(i, match.pairs_within(i, d)).collect():
        out.setdefault(r["component"], set()).add(r["image_id"])
    return sorted(map(sorted, out.values()))


def test_transitive_groups(spark):
    rows = [("0" * 16, 10, 10, 100), ("0" * 15 + "1", 10, 10, 101), ("0" * 15 + "3", 10, 10, 102), ("f" * 16, 10, 10, 103)]
    assert components_of(spark, rows, 1) == [[1, 2, 3], [4]]
    assert components_of(spark, rows[:2], 10) == [[1, 2]]
    assert components_of(spark, rows[:2], 0) == [[1], [2]]
    assert components_of(spark, [("0" * 16, 1, 1, 1), (None, 1, 1, 1)], 24) == [[1], [2]]


def test_components_on_long_paths_and_cycles(spark):
    v = spark.range(200).withColumnRenamed("id", "image_id")
    path = spark.range(99).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(150, 151), (151, 152), (152, 150), (199, 199)], "a long, b long"))
    got = {r["image_id"]: r["component"] for r in graph.connected_components(v, path).collect()}
    assert all(got[i] == 0 for i in range(100)) and {got[i] for i in (150, 151, 152)} == {150} and got[199] == 199 and len(got) == 200


@pytest.mark.parametrize("d", [0, 3, 7, 9, 11, 24])
def test_hamming_join_strategies_agree(spark, d):
    df = spark.range(120).select(F.col("id").alias("l_id"), F.expr("shiftrightunsigned(xxhash64(id div 4), 8) ^ shiftleft(1L, cast(id % 63 as int))").alias("l_hash"))
    right = df.select(F.col("l_id").alias("r_id"), F.col("l_hash").alias("r_hash"))
    got = {(r["l_id"], r["r_id"], r["distance"]) for r in match.hamming_join(df, right, d).select("l_id", "r_id", "distance").collect()}
    h = {r["l_id"]: r["l_hash"] & 2**64 - 1 for r in df.collect()}
    assert got == {(a, b, (h[a] ^ h[b]).bit_count()) for a in h for b in h if (h[a] ^ h[b]).bit_count() <= d}


def test_pair_plan(spark):
    rows = [("0" * 15 + x, 4000, 3000, 9_000_000) for x in "013"] + [("0" * 15 + x, 1000, 750, 400_000) for x in "013"]
    plan = graph.plan_pairs(images(spark, rows).withColumn("component", F.lit(1)))
    assert {(r["left_id"], r["right_id"]) for r in plan.collect()} == {(a, b) for a in (1, 2, 3) for b in (4, 5, 6)}
    far = images(spark, [("0" * 16, 4000, 3000, 9), ("f" * 16, 1000, 750, 4)]).withColumn("component", F.lit(1))
    assert graph.plan_pairs(far).count() == 0


def test_originals(spark):
    base = "component long, image_id long, width long, height long, file_size long, relative_path string, member_role string, reference_id long, score double"
    m = spark.createDataFrame([(1, 1, 1500, 2400, 4_000_000, "a", "reference", 1, 1.0), (1, 2, 800, 1280, 120_000, "b", "candidate", 1, 0.97)], base)
    assert {r["image_id"] for r in graph.automatic_originals(m).filter("is_original").collect()} == {1}
    m = spark.createDataFrame([(1, 1, 1500, 2400, 4_000_000, "a", "reference", 1, 1.0), (1, 3, 1450, 2320, 3_000_000, "c", "candidate", 1, 0.99)], base)
    assert {r["image_id"] for r in graph.automatic_originals(m).filter("is_original").collect()} == {1, 3}
    none = m.limit(0).select("image_id")
    chosen = graph.choose_originals(graph.automatic_originals(m), none, m.select("image_id"))
    assert {(r["image_id"], r["source"]) for r in chosen.filter("source is not null").collect()} == {(1, "fallback")}


def test_hamming_function(spark):
    df = spark.createDataFrame([("0" * 16, "0" * 16), ("0" * 16, "0" * 15 + "1"), ("0" * 16, "f" * 16), ("0" * 16, "0" * 15 + "3"), ("0" * 16, "invalid"), ("0" * 16, None)], "a string, b string")
    assert [r[0] for r in df.select(bits.hex_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 64, 2, None, None]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(naming.render("$ref-$n:02.$ext", F.lit("立绘.png"), F.lit("三月七"), F.lit(1), F.lit(2))) == "三月七-02.png"
    assert one(naming.render("$unknown.png", F.lit("a.png"), F.lit("r"), F.lit(1), F.lit(2))) is None
    fits, captures = naming.wildcards("*_*.png", F.lit("表情_角色.png"))
    assert one(fits) and one(naming.render("$2-$1.png", F.lit("x.png"), F.lit("r"), F.lit(1), F.lit(1), captures)) == "角色-表情.png"
    assert not one(naming.wildcards("*_*.jpg", F.lit("a_b.png"))[0])
    assert one(naming.wildcards("same", F.lit("same"))[0]) and not one(naming.wildcards("same", F.lit("other"))[0])
    _, c = naming.wildcards("a*b*c", F.lit("axbybzc"))
    assert [one(x) for x in c] == ["x", "ybz"]
    assert [one(naming.quick_name(F.lit("三月七.png"), F.lit(i), F.lit(e))) for i, e in ((1, "png"), (2, "jpg"), (3, "webp"))] == ["三月七_1.png", "三月七_2.jpg", "三月七_3.webp"]
    assert [one(naming.invalid_name(F.lit(n))) for n in ("a.png", " ", "..", "a.", "a?b", "con.txt", "LPT9.x", "com0.x")] == [None, "empty", "empty", "ending", "character", "reserved", "reserved", None]


@pytest.mark.parametrize("d", [10, 24])
def test_no_join_compares_all_pairs(spark, d):
    i = spark.range(50).select(F.col("id").alias("image_id"), F.xxhash64("id").alias("phash"), (F.col("id") % 3 + 1.0).alias("aspect"), F.col("id").cast("string").alias("relative_path"))
    for df in (match.pairs_within(i, d), match.candidates(i, i, Profile(max_distance=d))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [0, 100_000])
def test_places_within_keys(spark, few):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 37 % 101).alias("v")).repartition(5)
    rows = sorted((r["k"], -r["v"], r["id"]) for r in df.collect())
    want = {i: sum(x[0] == k and (x[1], x[2]) <= (v, i) for x in rows) for k, v, i in rows}
    got = {r["id"]: r["place"] for r in stats.numbered_within(df, ["k"], F.desc("v"), "id", few=few).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_running_sums_over_ranges(spark, few):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 500).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    got = [(r["k"], r["s"], r["n"]) for r in stats.numbered(stats.running(df, F.col("v"), F.desc("k"), name="s", few=few), F.desc("k"), name="n", few=few).collect()]
    total, expected = 0, []
    for n, (k, v) in enumerate(sorted(((i * 37 % 500, i % 3) for i in range(500)), reverse=True)):
        total += v
        expected.append((k, total, n + 1))
    assert sorted(got, reverse=True) == expected
    assert stats.numbered(df.limit(0), "k").count() == 0


def test_explicit_issues(spark):
    items = spark.createDataFrame([("d/a.png", "same.png", "f"), ("d/b.png", "SAME.png", "f"), ("d/c.png", "free.png", "old"), ("d/x.png", "new.png", "f"), ("d/e.png", "taken.png", "f"), ("d/g.png", "g2.png", None)], "path string, proposed_name string, expected string")
    listing = spark.createDataFrame([(f"d/{n}.png", "f", n) for n in "abceg"] + [("d/taken.png", "f", "e")], "path string, fingerprint string, digest string")
    got = {r["path"]: list(r["issues"]) for r in fileplan.explicit_issues(items, listing).collect()}
    assert got == {"d/a.png": ["BatchDuplicate"], "d/b.png": ["BatchDuplicate"], "d/c.png": ["SourceChanged"], "d/x.png": ["SourceMissing"], "d/e.png": ["SameContentExists"], "d/g.png": ["SourceChanged"]}


def test_events(spark):
    log = spark.createDataFrame([(1, 7, "prepared", 10), (2, 7, "recycled", 10), (3, 8, "recycled", 5), (4, 8, "restored", 9)], "id long, result_id long, operation_type string, created_at long")
    assert {r["result_id"]: r["operation_type"] for r in events.latest(log).collect()} == {7: "recycled", 8: "restored"}
    results = spark.createDataFrame([(7, 71, "exact_duplicate"), (8, 72, "likely_compressed"), (6, 72, "exact_duplicate"), (5, 71, "variant")], "result_id long, image_id long, analysis_type string")
    left = events.active(spark.createDataFrame([(71,), (72,), (7,)], "image_id long"), results, log)
    assert {r["image_id"] for r in left.collect()} == {72, 7}
    assert [tuple(r) for r in events.recyclable(results, log).collect()] == [(72, 6, "exact_duplicate")]
    assert {r["id"]: r["legal"] for r in events.transitions(log).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_guards(spark):
    assert guard_distance(24) == 24
    for bad in (-1, 25):
        with pytest.raises(ValueError):
            guard_distance(bad)
    with pytest.raises(ValueError):
        guard_ids(list(range(801)))
    with pytest.raises(ProfileMismatch):
        guard_profile(spark.createDataFrame([("other",)], "algorithm_profile_id string"))
    with pytest.raises(ValueError):
        assert_unique(spark.createDataFrame([(1,), (1,)], "a long"), "a")
    with pytest.raises(ValueError):
        assert_domain(spark.createDataFrame([("x",)], "a string"), "a", ("y",))


def test_null_digests_match_nothing(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "image_id long, relative_path string, digest string")
    b = spark.createDataFrame([(3, "c", None), (4, "z", "x"), (5, "y", "x")], "image_id long, relative_path string, digest string")
    (row,) = match.exact_matches(c, b).collect()
    assert (row["image_id"], row["primary_id"], list(row["candidate_ids"])) == (2, 5, [5, 4])


def test_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(paths.file_name(F.lit("a\\b/c.d.png"))) == "c.d.png" and one(paths.extension(F.lit("a/.hidden"))) == "" and one(paths.stem(F.lit("a/b.c.d"))) == "b.c"
    assert one(paths.nested(F.lit("/a/b"), F.lit("/a"))) and not one(paths.nested(F.lit("/ab"), F.lit("/a"))) and not one(paths.nested(F.lit("/a"), F.lit("/a")))
    assert not one(paths.included(F.lit("/x/.git/y.png"))) and one(paths.supported(F.lit("a.JPG"))) and not one(paths.supported(F.lit("a.tiff")))


def test_small_pieces(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(measures.percent(F.lit(0), F.lit(0))) == 0 and one(measures.percent(F.lit(1), F.lit(3))) == 33
    assert one(stats.reorder(F.lit(2), 2, 0)) == 0 and one(stats.reorder(F.lit(0), 2, 0)) == 1
    pairs = sets.unordered_pairs(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "a long, b long"), "a", "b")
    assert {(r["lo"], r["hi"]) for r in pairs.collect()} == {(1, 2), (1, 3)}


def test_settings_fall_back(spark):
    rows = spark.createDataFrame([("default_phash_max_distance", "12"), ("default_compressed_ssim_threshold", "bad"), ("other", "1")], "key string, value string")
    got = events.settings(rows, SETTINGS).first().asDict()
    assert got["default_phash_max_distance"] == 12 and got["default_compressed_ssim_threshold"] == 0.995 and got["max_candidate_per_image"] == 50
