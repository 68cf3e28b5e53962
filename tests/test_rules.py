"""Rules by hand-made rows."""

import math
import random

import pandas as pd
import pytest

from reclink.functions import strings
from reclink.operators import decide, model, pairs, translit
from reclink.operators.normalize import normalize
from reclink.sources import records as R


def one(spark, name="", address=""):
    return normalize(spark.createDataFrame([("1", name, address, "x")], R.SCHEMA)).first()


@pytest.mark.parametrize(("name", "column", "expected"), [
    ("C0nsultants", "nm_tok", ["consultants"]), ("Acme Private Limited", "nm", "acme pvt ltd"), ("Acme Private Limited", "nm_tok", ["acme"]),
    ("Foo Ltd d/b/a Bar Inc", "nm_parts", ["foo", "bar"]), ("healthoncology.com", "nm_core", "healthoncology"), ("A & B", "nm", "a and b"), ("Société Générale", "nm_core", "societe generale"), (None, "nm", ""),
])
def test_names(spark, name, column, expected):
    assert one(spark, name)[column] == expected


@pytest.mark.parametrize(("address", "column", "expected"), [
    ("203-Q, Main Road", "ad_code", ["203q", "203"]), ("C-24-144/4/1", "ad_code", ["c2414441", "2414441"]), ("09315 Oak Street", "ad_first_num", "9315"),
    ("09315 Oak Street", "ad", "9315 oak st"), ("null, 12 Rue X", "ad", "12 rue x"), ("", "ad_first_num", None),
])
def test_addresses(spark, address, column, expected):
    assert one(spark, "", address)[column] == expected


def test_older_address_codes(spark):
    from pyspark.sql import functions as F

    from reclink.functions import text

    rows = spark.createDataFrame([("C-24/1 Oak #12b ndeg Row",)], "a string")
    got = [rows.select(*[c.alias(n) for n, c in text.address_columns(F.col("a"), old).items()]).first() for old in (False, True)]
    assert [g["ad_code"] for g in got] == [["c241", "12b", "241", "12"], ["c241", "12b"]] and [g["ad_tok"] for g in got] == [["oak", "row"], ["oak", "ndeg", "row"]]


def subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def one_ratio(a, b):
    return 200.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def one_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    best = lambda short, long: max(one_ratio(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long)))
    return max(best(x, y), best(y, x) if len(a) == len(b) else 0.0)


def one_winkler(a, b):
    if not a or not b:
        return float(a == b)
    reach, taken, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_similarities():
    one = lambda f, a, b: f([a], [b])[0]
    assert round(one(strings.jaro_winkler, "martha", "marhta"), 4) == 0.9611
    assert one(strings.jaro_winkler, "", "") == 1 and one(strings.jaro_winkler, "a", "") == 0
    assert one(strings.ratio, "", "") == 100 and one(strings.ratio, "abcd", "abxd") == 75
    assert one(strings.token_sort_ratio, "b a", "a b") == 100 and one(strings.token_set_ratio, "a b", "a b c") == 100 and one(strings.token_set_ratio, "", "a") == 0
    assert one(strings.partial_ratio, "abc", "xxabcxx") == 100
    assert [None if pd.isna(x) else x for x in strings.compare("ratio", pd.Series(["a", None, "b", "a"]), pd.Series(["a", "x", None, "a"]))] == [100, None, None, 100]


def test_similarities_over_batches():
    """The matrix forms equal the definitions, pair by pair; strings of up to 150 characters, accents and empty ones."""
    r = random.Random(1)
    text = lambda: "".join(r.choice("abc dé") for _ in range(r.choice([0, 1, 3, 8, 20, 63, 64, 150])))
    a = [text() for _ in range(400)]
    b = [text() if r.random() < 0.5 else x[::-1][:5] + x for x in a]
    assert strings.common_subsequence(a, b).tolist() == [subsequence(x, y) for x, y in zip(a, b)]
    assert strings.jaro_winkler(a, b) == pytest.approx([one_winkler(x, y) for x, y in zip(a, b)])
    assert strings.partial_ratio(a[:60], b[:60]) == pytest.approx([one_partial(x, y) for x, y in zip(a[:60], b[:60])])


def pair_rows(spark, q, s):
    """Normalised records of one query and one primary record (name, address), and their pair."""
    recs = normalize(spark.createDataFrame([("q", *q, "x", 2), ("s", *s, "x", 1)], "entity_id string, business_name string, business_address string, country string, src int"))
    return spark.createDataFrame([("q", "s", 1.0)], "q_id string, s1_id string, p1 double"), recs


@pytest.mark.parametrize(("q", "s", "expected"), [
    ("100 Oak St", "101 Oak St", {"hn_logdiff": math.log(2), "hn_lev": 1, "hn_lendiff": 0, "hn_affix": 0, "fnum_eq": 0}), ("12 Oak St", "123 Oak St", {"hn_lendiff": -1, "hn_affix": 1, "hn_logdiff": math.log(112)}),
    ("1234 Oak", "34 Oak", {"hn_lendiff": 2, "hn_affix": 1}), ("Oak St", "5 Oak", {"hn_lev": None, "hn_logdiff": None, "fnum_eq": None}), ("12345678901 Oak", "12345678901 Oak", {"hn_logdiff": 0.0, "fnum_eq": 1}),
])
def test_house_numbers(spark, q, s, expected):
    got = pairs.native(*pair_rows(spark, ("A", q), ("B", s))).first()
    assert {k: got[k] for k in expected} == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in expected.items()}


def test_native_names(spark):
    got = pairs.native(*pair_rows(spark, ("हाईटेक Private", ""), ("Hitek Pvt Ltd", ""))).first()
    assert got["q_native"] == 1 and got["legal_both"] == 1 and got["legal_same"] == 1
    assert pairs.native(*pair_rows(spark, ("Hitek", ""), ("हाईटेक", ""))).first()["q_native"] == 0


@pytest.mark.parametrize(("name", "expected"), [("हाईटेक लॉजिस्टिक्स", "haitek lojistiks"), ("Газпром Нефть", "gazprom neft"), ("Αθήνα", "athina"), ("Щука & Ёж", "shchuka and ezh"), ("తెలుగు १२", "telugu 12"), ("Łódź Straße", "lodz strasse")])
def test_other_scripts(spark, name, expected):
    row = one(spark, name)
    assert row["nm"] == expected and row["nm_nonascii"]


def test_metric(spark):
    pred = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "x")], "s1_id string, rid string")
    truth = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "s1_id string, match_id string")
    s1 = spark.createDataFrame([("1",), ("2",), ("3",)], "s1_id string")
    got = decide.macro_f(decide.f_parts(pred, truth, s1)).first()
    assert got["f"] == pytest.approx((0.833333 + 0.555556 + 1) / 3, abs=2e-6) and got["n"] == 3 and got["f_single"] == 1


def test_expected_f_keeps_a_likely_record(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("q", "s", 0.9)], "q_id string, s1_id string, p double")
    assert decide.assign_expected_f(decide.best(rows), F.lit(0.0), F.lit(0.05)).collect() == [("s", "q")]


def test_files(spark, tmp_path):
    text = 'entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tA "quoted\t\tX\n2\t b\\\tc\t\n'
    for k in (1, 2, 3):
        (tmp_path / "train").mkdir(exist_ok=True)
        (tmp_path / "train" / f"train_source{k}.tsv").write_text(text)
    rows = R.read_split(spark, str(tmp_path), "train").where("src = 1").orderBy("entity_id").collect()
    assert [tuple(r)[:4] for r in rows] == [("1", 'A "quoted', "", "X"), ("2", " b\\", "c", "")]
    lists = R.id_lists(spark.createDataFrame([("1",), ("2",)], "s1_id string"), spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "a"), ("9", "z")], "s1_id string, rid string"))
    R.write_id_lists(lists, str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(str(tmp_path / "out")).na.fill("")
    assert sorted(map(tuple, back.collect())) == [("1", "a,b"), ("2", "")]
    assert R.truth_long(back).count() == 2


def test_transliteration(spark):
    rows = [("हाईटेक लॉजिस्टिक्स प्राइवेट लिमिटेड", "Hitech Logistics Private Limited")] * 2 + [("एक बार", "Ek Bar")]
    learned = translit.learn_names(spark.createDataFrame(rows, "q_name string, s_name string"))
    assert dict(map(tuple, learned.collect())) == {"हाईटेक": "hitech", "लॉजिस्टिक्स": "logistics", "प्राइवेट": "private", "लिमिटेड": "limited"}
    done = translit.apply_names(spark.createDataFrame([("हाईटेक Foo बार",), ("हाईटेक Foo बार",), (None,), ("plain",)], "n string"), learned, "n")
    assert sorted(map(str, (r["n"] for r in done.collect()))) == ["None", "hitech Foo बार", "hitech Foo बार", "plain"]
    addresses = spark.createDataFrame([("1", "हाईटेक बार", " 5 Oak,  महाराष्ट्र ,X", "in")], R.SCHEMA)
    mapped = normalize(addresses, {"name": learned, "addr": spark.createDataFrame([("महाराष्ट्र", "maharashtra")], "k string, v string")}).first()
    assert mapped["ad"] == "5 oak maharashtra x" and mapped["nm"].startswith("hitech") and mapped["nm_native"]


def test_boosting(spark):
    from pyspark.sql import functions as F

    data = spark.range(400).select(F.col("id").cast("string").alias("q_id"), F.lit("s").alias("s1_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 10).alias("x"), (F.col("id") % 10 > 4).cast("double").alias("y"))
    scored = model.out_of_fold(data, ["x"], rounds=5, depth=3)
    right = scored.where("x IS NOT NULL").select(F.avg(((F.col("p1") > 0.5) == (F.col("y") > 0.5)).cast("double"))).first()[0]
    assert scored.count() == 400 and right > 0.95


def test_pseudo_labels_are_one_a_record(spark):
    rows = [("a", "1", 0.99), ("a", "2", 0.99), ("b", "1", 0.5), ("c", "1", 0.01), ("c", "2", 0.98)]
    got = model.pseudo_labels(spark.createDataFrame(rows, "q_id string, s1_id string, p double"), share=1000).collect()
    assert sorted(map(tuple, got)) == [("a", "1", 1), ("c", "1", 0), ("c", "2", 1)]


def test_variant_gates():
    normal, orphan = {"root": 0.9890, "rootph": 0.9889, "ph": 0.9880}, {"root": 0.980, "rootph": 0.981, "ph": 0.99}
    assert decide.pick_variant({"root": 0.98}, {"root": 0.9})[0] == "champion"
    assert decide.pick_variant({"root": 0.989}, {"root": 0.9})[0] == "root"
    # The one loses too much without orphans, the other gains enough with them.
    assert decide.pick_variant(normal, orphan)[0] == "rootph"
    assert decide.pick_variant(normal | {"ph2": 0.9888}, orphan | {"ph2": 0.9815})[0] == "ph2"
    assert decide.pick_variant(normal | {"ph2": 0.9886}, orphan | {"ph2": 0.9815})[0] == "rootph"


def test_decisions_are_dispatched(spark):
    rows = spark.createDataFrame([("q", "s", 0.9), ("r", "s", 0.2)], "q_id string, s1_id string, p double")
    assert decide.decide(rows, {"rule": "threshold", "t": 0.5}).collect() == [("s", "q")]
    assert decide.decide(rows, {"rule": "expected_f", "lam": 0.0, "floor": 0.05}).collect() == [("s", "q")]
    truth, s1 = spark.createDataFrame([("s", "q")], "s1_id string, match_id string"), spark.createDataFrame([("s",)], "s1_id string")
    rule = decide.tune(rows, truth, s1)
    # Both rules find it, and the threshold wins a tie.
    assert rule["rule"] == "threshold" and rule["metrics"]["f"] == 1.0 and rule["t"] == 0.2 + 0.025
