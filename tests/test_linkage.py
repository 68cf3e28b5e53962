"""Whole runs: pair features against the queries that hold each of their groups, stored stages, both stages of models, id lists."""

import math

import pytest
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.operators import blocking, enrich, features, model
from reclink.operators import pairs as P
from reclink.plans import linkage, registry
from reclink.sources import records as R
from reclink.sources import stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return registry.linked(spark, SF)


@pytest.fixture(scope="module")
def listed(found):
    return registry.listed(found)


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) or isinstance(b, float) else a == b


def test_pair_table_holds_all_groups(spark, found, listed):
    """The wide table has, for every pair, what the single operators give."""
    vectors, unseen = features.vectors(found.weighted), features.unseen(found.feats, found.stats)
    profile = linkage.profiles(found.recs, vectors, unseen)
    wide = {(r["q_id"], r["s1_id"]): r for r in linkage.pair_features(listed, profile, old=True).collect()}
    assert len(wide) == listed.count()
    scored = registry.with_scores(listed)
    groups = [P.cosines(listed, vectors), P.native(scored, found.recs), P.names(scored, found.recs), enrich.legal_difference(scored, found.recs), enrich.code_difference(scored, found.recs), listed.drop("country")]
    q, s = enrich.structure(found.recs)
    freq = blocking.name_frequency(found.recs)
    groups += [listed.select("q_id", "s1_id").join(q, "q_id").join(s, "s1_id")]
    groups += [listed.select("q_id", "s1_id").join(freq.select(F.col("entity_id").alias("q_id"), F.col("name_freq").alias("q_name_freq")), "q_id").join(freq.select(F.col("entity_id").alias("s1_id"), F.col("name_freq").alias("s_name_freq")), "s1_id")]
    for group in groups:
        rows = group.collect()
        assert len(rows) == len(wide)
        for r in rows:
            own = wide[r["q_id"], r["s1_id"]]
            assert all(same(own[c], r[c]) for c in group.columns), (r, own)
    for r in unseen.collect():
        assert all(same(w[f"q_unseen_{r['ns']}"], r["unseen"]) for (q_id, _), w in wide.items() if q_id == r["rec_id"])
    tokens = enrich.long_tokens(scored, found.recs, enrich.token_stats(found.recs)).collect()
    assert tokens and all(same(wide[r["q_id"], r["s1_id"]][f"nm_{r['side']}x_{c}"], r[c]) for r in tokens for c in enrich.TOKEN_COLUMNS)
    some = {(r["q_id"], r["s1_id"], r["side"]) for r in tokens}
    for (q_id, s1_id), w in wide.items():
        for side in "qs":
            assert w[f"nm_{side}x_known"] + w[f"nm_{side}x_rare"] + w[f"nm_{side}x_typo"] == w[f"nm_{side}x_n"]
            assert (q_id, s1_id, side) in some or w[f"nm_{side}x_n"] == 0 and w[f"nm_{side}x_minjw"] is None


def test_feature_groups():
    names = ["cos_nw", "q_support", "nm_qx_maxpct", "nm_sx_n", "legal_equal", "code_affix", "q_nmlen", "s1_rank", "bscore"]
    assert linkage.newest_groups(names)["base"] == [n for n in names if n not in ("q_support", "nm_qx_maxpct")] and linkage.newest_groups(names)["full"] == names
    assert "q_nmlen" not in linkage.scale_groups(names)["-lengths"] and linkage.scale_groups(names)["-all_scale"] == names[:6]
    assert linkage.legal_groups(names)["base+legal_code"] == ["cos_nw", "q_support", "q_nmlen", "s1_rank", "bscore", "legal_equal", "code_affix"]


def records(spark):
    """Twenty businesses in each of two countries; four records of each but every fifth one's, with noise; some that match nothing."""
    rows, truth = [], []
    words = ["acorn", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven", "ivory", "jolly", "karma", "lunar", "maple", "north", "ocean", "pearl", "quartz", "river", "solar", "tiger"]
    for c, country in enumerate(("US", "IN")):
        for k, w in enumerate(words):
            s1 = f"{country}-{k}"
            name, street = f"{w} {words[(k * 7 + c) % 20]} trading", f"{100 + 13 * k} {words[(k * 3 + 5) % 20]} street, springfield"
            rows.append((s1, f"{name} Private Limited", street, country, 1))
            for j in range(4 if k % 5 else 0):
                q = f"q{s1}-{j}"
                rows.append((q, [name, f"{name} pvt ltd", f"The {w} {words[(k * 7 + c) % 20]}", f"{w[:-1]} {words[(k * 7 + c) % 20]} trading co"][j], street.replace("street", "St"), country, 2 + j % 2))
                truth.append((s1, q))
        rows += [(f"x{country}-{k}", f"{words[k]} unrelated {words[k + 3]}", f"{900 + k} elsewhere road", country, 2) for k in range(8)]
    return spark.createDataFrame(rows, [*R.SCHEMA.names, "src"]), spark.createDataFrame(truth, "s1_id string, match_id string")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    raw, truth = records(spark)
    settings = linkage.Settings(rounds=(4, 6), model={"depth": 3, "step": 0.3, "bins": 32}, fit_share=1000, collective=True, gone_share=200)
    return linkage.Linkage(spark, str(tmp_path_factory.mktemp("run")), {"train": lambda: raw, "test": lambda: raw}, truth, settings)


@pytest.fixture(scope="module")
def everything_held(monkeypatch_module):
    """With few records, more of them are held out."""
    monkeypatch_module.setattr(linkage.K, "HELD_SHARE", 400)


@pytest.fixture(scope="module")
def monkeypatch_module():
    with pytest.MonkeyPatch.context() as m:
        yield m


def test_whole_run(spark, run, everything_held, tmp_path):
    report = run.run("test", str(tmp_path / "out"))
    assert report["metrics"]["f"] > 0.8 and set(report["by_country"]) == {"US", "IN"}
    assert report["importance"][0][1] >= report["importance"][-1][1] and len(report["features"]) > 150 and not {"q_name_freq", "p1"} & set(report["features"])
    written = report["written"][""]
    assert written["matches"] > 60 and not any(v for k, v in written.items() if not k.startswith("match"))
    back = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(str(tmp_path / "out" / "matching_results")).collect()
    assert len(back) == 40
    # All again is read, not made.
    again = linkage.Linkage(spark, run.work, {}, run.truth, run.set)
    assert again.report() == {k: v for k, v in report.items() if k != "written"}
    assert model.rounds_of(model.load(f"{run.work}/models/second")) == report["rounds"]
    # No query record that touches a held-out primary record is fitted on.
    fit, held = run.split_rows(run.first("train"))
    assert fit.join(held, "q_id", "left_semi").isEmpty() and fit.where(model.held_out(F.col("s1_id"))).isEmpty()


def test_one_country_anew(spark, run, everything_held):
    before = run.pairs("test").count()
    files = lambda c: {f.path for f in _files(spark, f"{run.work}/test/pairs/country={c}")}
    us, india = files("US"), files("IN")
    run.p1("test")
    run.rebuild("test", ["US"])
    assert files("IN") == india and not files("US") & us and run.pairs("test").count() == before
    assert not stages.finished(spark, f"{run.work}/test/p1") and run.p1("test").count() == before


def _files(spark, path):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()


def test_self_training(run, everything_held):
    run.p1("test")
    assert run.self_trained("test")["metrics"]["f"] > 0.5


def test_single_stage(run, everything_held):
    fitted, rule = run.single()
    assert model.rounds_of(fitted) >= 1 and rule["metrics"]["f"] > 0.5


def test_orphans(run, everything_held):
    out = run.orphans()
    assert set(out["orphans"]) == set(out["normal"]) == {"root", "rootph", "ph"}
    assert 0 < out["orphans"]["root"]["n"] < out["normal"]["root"]["n"] and out["choice"] in ("champion", "root", "rootph", "ph")
    gone = run.s1("train").where(run.gone()).count()
    assert gone and run.spark.read.parquet(f"{run.work}/orphans/pairs").where(run.gone()).isEmpty()


def test_transfer(run, everything_held, monkeypatch):
    monkeypatch.setattr(linkage.K, "TRANSFER_SHARE", 1000)
    rows = linkage.transfer(run, lambda names: {"base": linkage.newest_groups(names)["base"]}, rounds=3, self_train=True, depth=3, step=0.3, bins=32)
    assert {(r["train"], r["eval"]) for r in rows} == {("US", "IN"), ("IN", "US")}
    assert all(0 <= r["cross"] <= 1 and r["same"] > 0.4 and r["n_features"] > 130 and r["pseudo_pos"] >= 0 for r in rows)


def test_stored_stages(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def build(columns):
        made.append(columns)
        return spark.range(4).select((F.col("id") % 2).cast("string").alias("country"), *[F.col("id").alias(c) for c in columns])

    first = stages.stage(spark, path, lambda: build(["a"]), ["a"], ("country",))
    assert first.count() == 4 and first.schema["country"].dataType.simpleString() == "string"
    assert stages.stage(spark, path, lambda: build(["a"]), ["a"], ("country",)).count() == 4 and len(made) == 1
    # A column more: stale. An unfinished write: made anew.
    assert "b" in stages.stage(spark, path, lambda: build(["a", "b"]), ["b"], ("country",)).columns and len(made) == 2
    (tmp_path / "t" / "_SUCCESS").unlink()
    stages.stage(spark, path, lambda: build(["a", "b"]), ["b"], ("country",))
    assert len(made) == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    stages.write_json(spark, {"a": [1, "é"]}, str(tmp_path / "r.json"))
    assert stages.read_json(spark, str(tmp_path / "r.json")) == {"a": [1, "é"]}
    lists = spark.createDataFrame([("1", "a,b"), ("1", "a"), ("9", "z")], "source1_entity_id string, matched_entity_ids string")
    s1, others = spark.createDataFrame([("1",), ("2",)], "s1_id string"), spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert stages.check_lists(lists, s1, others) == {"repeated_rows": 1, "missing_rows": 1, "unknown_rows": 1, "unknown_ids": 1, "shared_ids": 1}


def test_cached_split(spark, tmp_path):
    (tmp_path / "train").mkdir()
    for k in (1, 2, 3):
        (tmp_path / "train" / f"train_source{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\n{k}\tA\tB\tX\n")
    assert R.read_cached(spark, str(tmp_path), "train", str(tmp_path / "cache")).count() == 3
    (tmp_path / "train" / "train_source1.tsv").unlink()
    assert R.read_cached(spark, str(tmp_path), "train", str(tmp_path / "cache")).where("src = 1").first()["entity_id"] == "1"


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def __init__(self, real):
            self._jsc, self.real = real._jsc, real

        def getConf(self):
            return self

        def get(self, name):
            return None

    class Session:
        sparkContext = Context(spark.sparkContext)

    class Nothing:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isEmpty(self):
            return True

    Session.sparkContext._jsc = Nothing()
    with pytest.raises(ValueError, match="checkpoint"):
        stages.shared_dir(Session())


def test_blocking_by_parts_and_blocks(found, monkeypatch):
    """Cells of any size give the same lists, and few blocks mean few copies of what primary records have."""
    whole = blocking.topk(found.weighted).collect()
    grid, _ = blocking._grid(found.weighted.where("in_product"))
    assert sum(blocks for _, _, blocks in grid.values()) <= blocking.TASKS + len(grid)
    monkeypatch.setattr(blocking, "PART", 150)
    monkeypatch.setattr(blocking, "BLOCK", 40)
    grid, parts = blocking._grid(found.weighted.where("in_product"))
    assert parts > 3 and max(blocks for _, _, blocks in grid.values()) > 3
    dealt = blocking.topk(found.weighted.repartition(7)).collect()
    key = lambda r: (r["q_id"], r["brank"], r["s1_id"], r["country"], round(r["bscore"], 9))
    assert len(whole) > 100 and sorted(map(key, dealt)) == sorted(map(key, whole))


def test_weights_by_parts(spark, monkeypatch):
    """Weights by parts, here more than a mask holds, are those of the join by feature, also for nulls and repeated ids, and no feature of a record is shuffled."""
    monkeypatch.setattr(features, "PER_PART", 2)
    docs = [(k % 170, f"{'Acme Widgets' if k % 3 else 'Old Mill Tea'} {k % 11} Oak Street north{k % 7} end", "en" if k % 2 else "fr", "web", 40 + k % 5) for k in range(200)]
    docs += [(301, None, "en", "web", 1), (302, "lonely words here", None, "web", 17), (None, "Acme Widgets 7", "en", "web", 14), (303, "", "fr", None, None)]
    raw = registry.R.record_view(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    recs = stages.materialize(registry.normalize(features.dealt(raw)).drop("ck"))
    assert recs.agg(F.max("part")).first()[0] >= features.BITS
    feats = features.features(recs)
    stats = stages.materialize(features.statistics(feats, recs))
    weighted = features.part_weights(recs, stats)
    key = lambda r: tuple(str(r[c]) for c in ("rec_id", "src", "country", "ns", "key", "in_product")) + (round(r["norm"], 9), round(r["w"], 9))
    plain = feats.drop("part")
    expected = sorted(map(key, features.weights(plain, features.statistics(plain, recs)).collect()))
    assert len(expected) > 1000 and sorted(map(key, weighted.collect())) == expected
    plan = weighted._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[2]
    assert plan.count("Exchange") == 1
    share = lambda r: (str(r["rec_id"]), r["ns"], r["unseen"])
    assert sorted(map(share, features.unseen_left(feats, weighted).where("rec_id IS NOT NULL").collect())) == sorted(map(share, features.unseen(plain, stats).where("rec_id IS NOT NULL").collect()))


def test_cosines_need_no_weights_of_queries(found, listed):
    """Keys and norms are all that has to travel to a pair from its query record."""
    vectors = features.vectors(found.weighted)
    bare = vectors.withColumn("vec", F.when(F.col("rec_id").isin([r["q_id"] for r in listed.select("q_id").distinct().collect()]), F.transform("vec", lambda x: x.withField("w", F.lit(None).cast("double")))).otherwise(F.col("vec")))
    one, two = ({(r["q_id"], r["s1_id"]): r for r in P.cosines(listed, v).collect()} for v in (vectors, bare))
    assert len(one) > 100 and one == two


def test_only_keys_of_both_sides_are_dealt(found, monkeypatch):
    """A key of primary records that no query record has adds to no score and does not travel; the lists stay as they are."""
    seen = []
    grid = blocking._grid
    monkeypatch.setattr(blocking, "_grid", lambda used: seen.append(used) or grid(used))
    key = lambda r: (r["q_id"], r["brank"], r["s1_id"], r["country"], r["bscore"])
    short = sorted(map(key, blocking.topk(found.weighted).collect()))
    whole = sorted(map(key, blocking.topk(found.weighted.drop("met")).collect()))
    assert len(short) > 100 and short == whole
    own, asked = ({(r["country"], r["ns"], r["key"]) for r in seen[0].where(side).collect()} for side in ("src = 1", "src > 1"))
    assert own == asked and seen[0].count() < seen[1].count()


@pytest.mark.parametrize("part", [blocking.PART, 150])
def test_pruned_in_the_task(found, monkeypatch, part):
    """Lists that are pruned where they are made are those of the whole lists, and with one part only kept pairs are shuffled."""
    monkeypatch.setattr(blocking, "PART", part)
    whole = blocking.prune(blocking.context(blocking.topk(found.weighted)))
    short = blocking.pruned(found.weighted)
    assert short.schema.simpleString() == whole.schema.simpleString()
    rows = sorted(map(tuple, short.collect()))
    assert len(rows) > 100 and rows == sorted(map(tuple, whole.collect()))
    if part > 150:
        lists = blocking._cells(found.weighted, K.WEIGHTS)[0].mapInArrow(blocking._solve(K.TOP_K, pruned=True), f"{blocking._LIST}, n long, second double")
        assert lists.count() == len(rows) < blocking.topk(found.weighted).count() / 2


def test_meta_needs_no_texts(spark):
    """Only numbers of a record travel to its pairs."""
    plan = registry.record_meta(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(q_id" in x and "nm_tok" in x]
    joined = [x for x in plan.splitlines() if "Project" in x and "q_nm" in x]
    assert not [x for x in joined if "q_nm_tok" in x or "q_nm_core" in x or "q_ad#" in x]
