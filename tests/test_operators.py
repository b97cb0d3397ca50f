import pytest
from pyspark.sql import functions as F

from kinspark.functions import text, tokens
from kinspark.operators import blocking, decide, features, metrics, model, profile, relative, vector
from kinspark.sources import files
from kinspark.streaming import ingest


def test_f_half(spark):
    cases = [(2, 3, 2, 0.714), (1, 1, 2, 0.833), (2, 2, 3, 0.909), (0, 0, 0, 1.0), (0, 1, 0, 0.0)]
    for tp, p, t, want in cases:
        assert metrics.f_half_value(tp, p, t) == pytest.approx(want, abs=1e-3)
    rows = spark.createDataFrame([c[:3] for c in cases], "tp int, p int, t int")
    got = [r[0] for r in rows.select(metrics.f_half(F.col("tp"), F.col("p"), F.col("t"))).collect()]
    assert got == pytest.approx([c[3] for c in cases], abs=1e-3)


def test_break_even(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 3), (1, 1, 2), (2, 2, 3)], "a int, b int, c int")
    got = [r[0] for r in rows.select(metrics.break_even(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == pytest.approx([0.444, 0.571, 0.667, 0.727], abs=1e-3)


def test_conflicts(spark):
    rows = [("q1", "c1", 0.6, 0.9), ("q2", "c1", 0.9, 0.1), ("q1", "c2", None, 0.2), ("q2", "c2", 0.9, 0.9), ("q1", "c3", None, 0.2), ("q2", "c3", None, 0.3)]
    got = decide.resolve_conflicts(spark.createDataFrame(rows, "q string, c string, score double, containment double"))
    assert {(r["c"], r["q"]) for r in got.collect()} == {("c1", "q2"), ("c2", "q1"), ("c3", "q2")}


def test_rules(spark):
    s = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.9), ("b", "z", 0.3)], "q string, c string, p double")
    pairs = lambda df: {(r["q"], r["c"]) for r in df.collect()}
    assert pairs(decide.flat(s, 0.5)) == {("a", "x"), ("a", "y"), ("b", "x")}
    assert pairs(decide.exclusive(s)) == {("a", "x"), ("a", "y"), ("b", "z")}
    assert pairs(decide.rescue(s, 0.95, 0.9)) == {("a", "x"), ("b", "x")}
    assert pairs(decide.rank_aware(s, 0.4, 0.2)) == {("a", "x"), ("b", "x")}
    assert pairs(decide.prune(s, 1)) == {("a", "x"), ("b", "x")}
    everyone = spark.createDataFrame([("a",), ("b",), ("e",)], "q string")
    lists = {r[0]: r[1] for r in decide.submission(everyone, decide.flat(s, 0.5)).collect()}
    assert lists == {"a": "x,y", "b": "x", "e": ""}


def test_splice_keeps_fresh_empty_lists(spark):
    e = spark.createDataFrame([("a",), ("b",), ("d",)], "q string")
    fresh = spark.createDataFrame([("a", "")], "q string, ids string")
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "q string, ids string")
    assert {r["q"]: r["ids"] for r in decide.splice(e, fresh, old).collect()} == {"a": "", "b": "y", "d": ""}


def test_relative_ties(spark):
    s = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5)], "q string, c string, addr_idf_overlap double")
    got = {r["c"]: r for r in relative.relative_features(s, ("addr_idf_overlap",)).collect()}
    assert got["x"]["addr_idf_overlap_z"] == 0 and got["x"]["addr_idf_overlap_rank"] == 0 and got["y"]["addr_idf_overlap_rank"] == 1
    assert got["x"]["is_argmax"] == 1 and got["y"]["is_argmax"] == 0


def test_top_k_shuffles_no_pairs(spark):
    """A shared term makes pairs of all that hold it; only the best of each query leave a task, over any blocks and chunks."""
    rows = [(f"S{1 + i % 3}-{i}", f"S{1 + i % 3}", "US", f"common w{i % 7} v{i % 11}", f"x{i % 5}") for i in range(300)]
    r = spark.createDataFrame([*rows, ("S2-n", "S2", None, "common", ""), rows[1]], "entity_id string, source string, country string, name_norm string, addr_norm string")
    preset = blocking.Preset(max_df=1.0, k=3)
    whole = blocking.cosine_top_k(r, preset)
    got = {(x["q"], x["c"], x["source"], x["sim"], x["rn"]) for x in whole.collect()}
    assert got == {(x["q"], x["c"], x["source"], x["sim"], x["rn"]) for x in blocking.cosine_top_k(r, preset, block=20, chunk=7).collect()}
    tf = lambda part, fit: {(x["entity_id"], x["source"], x["term"]): x["w"] for x in tokens.tfidf(part, "t", "entity_id", ("source",), fit=fit).collect()}
    own = r.where("country is not null").select("entity_id", "source", tokens.words(text.combo("name_norm", "addr_norm")).alias("t"))
    index = own.where("source <> 'S1'")
    asked = own.where("source = 'S1'").drop("source").crossJoin(index.select("source").distinct())
    sums = {}
    right = tf(index, index)
    for (q, s, t), w in tf(asked, index).items():
        for (c, s2, t2), v in right.items():
            if (s, t) == (s2, t2):
                sums[q, s, c] = sums.get((q, s, c), 0) + w * v
    want = set()
    for q, s in {x[:2] for x in sums}:
        best = sorted((-round(v, 6), c) for (a, b, c), v in sums.items() if (a, b) == (q, s))[:3]
        want |= {(q, c, s, -v, n + 1) for n, (v, c) in enumerate(best)}
    assert got == want
    assert "SortMergeJoin" not in whole._jdf.queryExecution().executedPlan().toString()


def _records(spark):
    rows = [("S1-1", "S1", "US", "zephyr mill", "12 oak"), ("S2-1", "S2", "US", "zephyr mill", "12 oak"), ("S3-1", "S3", "US", "zephyr", "14 elm"), ("S2-2", "S2", "de", "zephyr mill", "12 oak"), ("S3-2", "S3", "US", "", "")]
    return spark.createDataFrame(rows, "entity_id string, source string, country string, name_norm string, addr_norm string")


def test_blocking(spark):
    r = _records(spark)
    top = blocking.cosine_top_k(r, blocking.PRESETS["prod-word"]).collect()
    assert {(x["q"], x["c"]) for x in top} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    assert {(x["q"], x["c"]) for x in blocking.exact_key(r).collect()} == {("S1-1", "S2-1")}
    assert max(x["rn"] for x in blocking.cosine_top_k(r, blocking.Preset(k=1)).collect()) == 1
    for name in ("lib", "prod-char", "many-core", "word-count"):
        blocking.block(r, blocking.PRESETS[name]).collect()


def test_levels_count_each_pair_once(spark):
    """Counts by level stand for the pairs of every K or combination that takes them in; pairs aren't multiplied."""
    pairs = [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 5), ("d", "y", 5), ("not asked", "x", 1)]
    cand = spark.createDataFrame(pairs, "q string, c string, level int")
    truth, queries = spark.createDataFrame([("a", "x"), ("a", "v"), ("b", "z")], "q string, c string"), spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "q string")
    levels = [(level, k) for level in (1, 2, 5) for k in (1, 2, 5) if k >= level]
    got = blocking.evaluate(cand, truth, queries, ("k",), (("level",), spark.createDataFrame(levels, "level int, k int"))).collect()
    plain = spark.createDataFrame([(q, c, k) for q, c, n in pairs for level, k in levels if level == n], "q string, c string, k int")
    assert sorted(map(tuple, got)) == sorted(map(tuple, blocking.evaluate(plain, truth, queries, ("k",)).collect()))
    assert {r["k"]: (r["tp"], r["candidates"]) for r in got} == {1: (1, 2), 2: (1, 3), 5: (2, 5)}


def test_few_candidates_are_shuffled_once_as_lists(spark):
    """Lists of each entity's candidates count like the pairs, repeats included, and no exchange deals pairs out by (q, c)."""
    pairs = [("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 5), ("d", "y", 5), ("not asked", "x", 1)]
    cand = spark.createDataFrame(pairs, "q string, c string, level int")
    truth, queries = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "v"), ("b", "z")], "q string, c string"), spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "q string")
    levels = (("level",), spark.createDataFrame([(level, k) for level in (1, 2, 5) for k in (1, 2, 5) if k >= level], "level int, k int"))
    lists = blocking.evaluate(cand, truth, queries, ("k",), levels, few=True)
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, blocking.evaluate(cand, truth, queries, ("k",), levels).collect()))
    before = [x for x in lists._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(q" in x and "level" in x]
    assert not before


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = blocking.cosine_top_k(_records(spark), blocking.PRESETS["prod-word"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_auc_and_map(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert metrics.auc(rows, "p", "y").first()["auc"] == 0.75
    assert metrics.score("accuracy", rows.select("y", "y").toDF("a", "b"), "a", "b") == 1.0
    with pytest.raises(KeyError):
        metrics.score("nothing", rows, "p", "y")
    pred = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")], "q string, rank int, item string")
    want = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "q string, item string")
    assert metrics.mean_average_precision(pred, want).first()[0] == pytest.approx((1 + 2 / 3) / 2 / 2, abs=1e-6)


def test_model_and_cascade(spark):
    rows = spark.createDataFrame([(f"q{i % 20}", f"c{i}", i % 2 + 0.01 * (i % 7), i % 2) for i in range(200)], "q string, c string, f double, label int")
    split = model.split(rows)
    assert not {r["q"] for r in split.where("validation").collect()} & {r["q"] for r in split.where("not validation").collect()}
    fitted = model.train(rows, ["f"], model.TreePreset(rounds=3, depth=2, least=1))
    scored = model.predict(fitted, rows, ["f"])
    assert metrics.auc(scored, "p", "label").first()["auc"] == 1.0
    with pytest.raises(ValueError):
        model.predict(fitted, rows, ["f", "label"])
    assert model.out_of_fold(rows, ["f"], 2, model.TreePreset(rounds=2, depth=2, least=1)).count() == 200
    texts = spark.createDataFrame([(x, "n", "a") for x in [*(f"q{i}" for i in range(20)), *(f"c{i}" for i in range(200))]], "entity_id string, name_norm string, addr_norm string")
    blended = model.cascade(scored.select("q", "c", F.lit(0.5).alias("p")), texts, model.pandas_rescorer(lambda a, b: [1.0] * len(a)), 0.05, 0.95, 0.6)
    assert {round(r["p"], 6) for r in blended.collect()} == {0.8}


def test_specialist_on_the_band(spark):
    rows = spark.createDataFrame([(f"q{i % 40}", f"c{i}", 0.3 + 0.01 * (i % 40), i % 2 + 0.01 * (i % 7), i % 2) for i in range(400)], "q string, c string, p double, f double, label int")
    made, report = model.specialist(model.split(rows), ["f"], 0.35, 0.65, model.TreePreset(rounds=3, depth=2, least=1))
    own = report.first()
    assert made.count() == rows.where("p >= 0.35 and p < 0.65").count()
    assert own["pairs"] == made.where("validation").count() and own["auc_p2"] == 1.0 > own["auc_p"] and own["accuracy_p2"] == 1.0


def test_passes_and_resume(spark, tmp_path):
    scored = spark.createDataFrame([("S1-1", "S2-1", "S2", 0.9), ("S1-1", "S2-2", "S2", 0.1), ("S1-1", "S2-3", "S2", 0.5)], "q string, c string, source string, sim double")
    files.save_pass(scored, f"{tmp_path}/a")
    files.save_pass(scored.drop("sim"), f"{tmp_path}/b")
    assert files.load_pass(spark, f"{tmp_path}/a").columns == scored.columns and files.load_pass(spark, f"{tmp_path}/b").columns == ["q", "c", "source"]
    assert sorted(r["c"] for r in blocking.build_candidates({"x": scored}, {"x": 0.2}, 1).collect()) == ["S2-1"]
    built = []

    def part(name, fails=False):
        def build():
            built.append(name)
            if fails:
                raise RuntimeError("stopped")
            return scored

        return build

    with pytest.raises(RuntimeError):
        files.resumed(spark, f"{tmp_path}/r", {"one": part("one"), "two": part("two", True)})
    assert files.resumed(spark, f"{tmp_path}/r", {"one": part("one"), "two": part("two")}).count() == 6
    assert built == ["one", "two", "two"]


def test_fingerprints_count_repeats(spark):
    once = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    twice = once.union(once.where("a = 1")).union(once.where("a = 1"))
    other = once.union(once.where("a = 2")).union(once.where("a = 2"))
    assert len({files.fingerprint(x).first()["fingerprint"] for x in (once, twice, other)}) == 3


def test_shards_by_crc(spark):
    import zlib

    rows = spark.createDataFrame([(f"S1-{i}", "US") for i in range(50)], "q string, country string")
    assert all(r["shard"] == zlib.crc32(r["q"].encode()) % 16 for r in files.shard(rows).collect())


def test_unnamed_scripts_go_by_block(spark):
    rows = spark.createDataFrame([("ᚠᚢᚦ",), ("ᚠ a",), ("abc",), ("12",)], "business_name string")
    assert {r["script"]: r["n"] for r in profile.script_histogram(rows).collect()}["U+16xx"] >= 1


def test_evaluation_by_configuration(spark):
    """Totals in place of a row for each configuration and entity give what those rows would."""
    truth = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "q string, c string")
    queries = spark.createDataFrame([(f"q{i}",) for i in range(1, 6)], "q string")
    cand = spark.createDataFrame([(1, "q1", "a"), (1, "q4", "z"), (2, "q1", "a"), (2, "q1", "b"), (2, "q2", "x")], "k int, q string, c string")
    got = {r["k"]: r for r in blocking.evaluate(cand, truth, queries, ("k",)).collect()}
    for k in (1, 2):
        alone = blocking.evaluate(cand.where(f"k = {k}").drop("k"), truth, queries).first().asDict()
        assert {n: v for n, v in got[k].asDict().items() if n != "k"} == alone
    assert (got[1]["tp"], got[1]["fn"], got[1]["candidates"], got[1]["complete_share"]) == (1, 2, 2, 0.6)
    assert got[2]["max_macro_f05"] == pytest.approx((1 + 0 + 3) / 5)
    assert blocking.evaluate(cand.limit(0).drop("k"), truth, queries).first()["complete_share"] == 0.6


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([("entity_id\tbusiness_name\tbusiness_address\tcountry",), ("S1-1\ta\tb\tUS",), ("S1-2\ta\tb",), ('S2-3\t"q\t\tUS\textra',)], "value string")
    got = {r["entity_id"]: r["business_name"] for r in files.split_lines(lines).collect()}
    assert got == {"S1-1": "a", "S2-3": '"q'}
    assert tuple(files.malformed(lines).first()) == (4, 1, 1)
    wide = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], "q string, ids string")
    files.write_lists(wide, f"{tmp_path}/lists", ("source1_entity_id", "matched_entity_ids"))
    assert {(r["q"], r["c"]) for r in files.read_pairs(spark, f"{tmp_path}/lists").collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    built = []
    build = lambda: built.append(1) or wide
    for _ in range(2):
        assert files.cache_frame(spark, f"{tmp_path}/kept", build).count() == 2
    assert built == [1]
    a, b = (files.fingerprint(wide.orderBy(F.col("q") if up else F.desc("q"))).first() for up in (True, False))
    assert a == b
    files.write_shards(wide.withColumn("country", F.lit("US")), f"{tmp_path}/shards", 4)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 2
    for suffix in ("csv", "jsonl", "parquet"):
        wide.write.format({"jsonl": "json"}.get(suffix, suffix)).option("header", True).save(f"{tmp_path}/t.{suffix}")
        assert files.load(spark, f"{tmp_path}/t.{suffix}").count() == 2
    with pytest.raises(ValueError):
        files.load(spark, "x.bin")


def test_streaming(spark, tmp_path):
    records = spark.createDataFrame([("S1-1", "US", "zephyr mill", "12 oak")], "entity_id string, country string, name_norm string, addr_norm string")
    records.write.parquet(f"{tmp_path}/in")
    index = spark.createDataFrame([("US", "zephyr", "S2-1"), ("US", "mill", "S2-1"), ("US", "oak", "S2-9")], "country string, term string, c string")
    query = ingest.match_stream(spark.readStream.schema(records.schema).parquet(f"{tmp_path}/in"), index, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(60)
    assert [(r["q"], r["c"], r["shared"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("S1-1", "S2-1", 2)]


def test_vector_is_what_the_single_features_are(spark):
    texts = [
        ("cafe paris sarl", "12 main street 3rd floor springfield"), ("cafe pariss", "0012 main st third floor springfield"), ("paris cafe", "12 mane street"),
        ("intl trading house", "125 oak avenue texas 7"), ("international trading", "1250 oak avenue california 8"), ("trading", ""), ("", "12 main street"), ("", ""),
        ("cafe cafe paris", "main 12 street 12"), ("grand hotel of the northern lights and of the southern cross resort", "99 oak avenue berlin 125"), ("intl tradnig hous", "15 oak avenu texas 07"),
    ]
    rows = [(f"{s}-{i}", n, a) for i, (n, a) in enumerate(texts) for s in ("S1", "S2", "S3")]
    records = spark.createDataFrame(rows, "entity_id string, name_norm string, addr_norm string")
    pairs = spark.createDataFrame([(x[0], y[0], y[0][:2], int(x[1:] == y[1:])) for x in rows for y in rows if x[0][:2] == "S1" != y[0][:2]], "q string, c string, source string, label int")
    idf = tokens.feature_idf(records.select(text.tokens(text.combo("name_norm", "addr_norm")).alias("terms")), "terms").where("term <> 'oak'")
    nine = lambda frame, names: frame.withColumns({n: F.round(n, 9) for n in names})
    own = nine(features.pair_features(pairs, records, idf, keep=("q", "c", "source", "label")), relative.BASE)
    crossed = nine(relative.cross_source(own, features.record_forms(records, idf)), ["cross_addr", "cross_name"])
    want = relative.cross_rank(relative.relative_features(own).join(crossed, ["q", "c"])).toPandas().set_index(["q", "c"]).sort_index()
    got = vector.pair_vectors(pairs.repartition(3), records, idf, ("label",)).toPandas().set_index(["q", "c"]).sort_index()
    assert list(got.index) == list(want.index) and list(got["label"]) == list(want["label"])
    assert vector.NAMES == [n for n in want.columns if n not in ("source", "label", features.DEAD)]
    for i, name in enumerate(vector.NAMES):
        assert [v[i] for v in got["vector"]] == pytest.approx(list(want[name]), abs=1e-6), name


def test_stored_frames_have_no_lineage(spark):
    from kinspark.plans import bridge

    frame, path = bridge.stored(spark.range(100).repartition(3).selectExpr("id % 7 AS k").groupBy("k").count(), "test")
    assert sorted(map(tuple, frame.collect())) == [(0, 15), (1, 15), *((k, 14) for k in range(2, 7))]
    assert "Exchange" not in frame._jdf.queryExecution().toString() and "Shuffled" not in frame.rdd.toDebugString().decode()
    bridge.drop(spark, path)
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()
