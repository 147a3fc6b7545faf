"""Order statistics of many columns, bounded distinct counts, split CSV files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from opinia.operators import prep as P
from opinia.operators.evaluate import confusion_square, result_bundle
from opinia.operators.few_values import few_distinct
from opinia.operators.order_stats import order_statistics
from opinia.sources import records as R
from opinia.sources.csv import read_reviews


def test_order_statistics_of_ties_nulls_and_classes(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        rows.append((rnd.choice(["a", "b", None]), rnd.choice([None, 5, 5, 5, 7, rnd.randrange(1000)]),
                     rnd.choice([None, math.nan, 0.25, rnd.random()]), rnd.randrange(-10 ** 17, 10 ** 17)))
    df = spark.createDataFrame(rows, "k string, i int, x double, b long")

    def ranks(n):
        return sorted({1, n // 3 + 1, (n + 1) // 2, n})

    for by in (None, "k"):
        got = order_statistics(df, dict.fromkeys(("i", "x", "b"), ranks), by=by, max_band=30)
        for cls in {r[0] for r in rows} if by else {None}:
            own = [r for r in rows if not by or r[0] == cls]
            for j, c in ((1, "i"), (2, "x"), (3, "b")):
                values = sorted(r[j] for r in own if r[j] is not None and not (isinstance(r[j], float) and math.isnan(r[j])))
                assert got[cls, c] == [values[k - 1] for k in ranks(len(values))], (by, cls, c)


def test_order_statistics_jobs_do_not_grow_with_columns(spark):
    df = spark.range(5000).select(*[(F.hash("id", F.lit(j)) % 1000).alias(f"c{j}") for j in range(6)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(cols, group):
        spark.sparkContext.setJobGroup(group, group)
        order_statistics(df, {c: lambda n: [n // 2] for c in cols}, max_band=100)
        return len(tracker.getJobIdsForGroup(group))

    one, six = jobs(["c0"], "one column"), jobs([f"c{j}" for j in range(6)], "six columns")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert six <= one + 12  # one or two rounds more, for the column that needs them; no search of its own


def test_order_statistics_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert order_statistics(df, {"x": lambda n: [1]}) == {(None, "x"): []}
    assert P.exact_medians(df, ["x"]) == {"x": None}
    assert order_statistics(df.where("false"), {"x": lambda n: [1]}, by="x") == {}


def test_exact_split_has_exact_sizes(spark):
    parts = P.split_column(spark.range(1001), "id", (0.6, 0.2, 0.2), exact=True).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 601, "dev": 200, "test": 200}


def test_few_distinct_stops_counting(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("string").alias("few"), F.col("id").cast("string").alias("many"),
                                  F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, "x").alias("half"))
    got = {r["column"]: r.n_distinct for r in few_distinct(df.repartition(5), ["few", "many", "none", "half"], 51).collect()}
    assert got == {"few": 7, "many": 52, "half": 1}
    roles = P.column_roles(df)
    assert (roles.categorical, roles.text) == (["few", "none", "half"], ["many"])
    assert few_distinct(df.where("false"), ["few"], 51).count() == 0


def test_bundle_matrix_is_square_and_zero_filled(spark):
    df = spark.createDataFrame([("dev", "a", "b"), ("dev", "a", "a"), ("dev", "c", "a"), ("test", "a", "a"), ("dev", None, "a"), ("test", "a", None)],
                               "part string, label string, prediction string")
    square = {(r.split, r.label, r.prediction): r.n for r in confusion_square(df, "part").collect()}
    assert len(square) == 10 and square["dev", "a", "b"] == 1 and square["dev", "b", "c"] == 0 and sum(square.values()) == 4
    out = result_bundle(df, params={"k": 3}, score=0.5).collect()
    values = {(r.split, r.section, r.name, r.measure): r.value for r in out}
    assert values["dev", "scores", "all", "accuracy"] == pytest.approx(1 / 3)
    assert values["dev", "report", "b", "recall"] == 0 and values[None, "model", "Best Score", "score"] == 0.5
    assert next(r.said for r in out if r.name == "k") == "3"


# --- CSV -----------------------------------------------------------------------------------------------------------

FIELDS = ['plain text', '"quoted, text"', '"two\nlines"', '"say ""hi"" now"', '"""x"" y\n\n\nlast ""z"""', 'mid"quote here', '', '""', '"a"junk',
          '"line one\n,""x"",\n""\n"" end"', '"unescaped "in, side"', '  "lead"']


def hostile(n, seed=4, nl="\n"):
    rnd = random.Random(seed)
    out = ["id,Review,Rating"]
    for i in range(n):
        out.append(f"{i},{rnd.choice(FIELDS)},{rnd.randrange(5)}")
        if rnd.random() < 0.05:
            out.append("")
    return ("\n".join(out) + "\n").replace("\n", nl)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("text,nl", [(hostile(1500), "\n"), (hostile(300, nl="\r\n"), "\r\n"),
                                     ('id,Review,Rating\n1,"' + "long line, text\n" * 2000 + '",5\n' + hostile(30).split("\n", 1)[1], "\n")])
def test_split_files_give_the_rows_of_one_task(spark, tmp_path, small_splits, text, nl):
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    rules = {"sep": ",", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    schema = "id string, Review string, Rating string, _extra string"
    whole = spark.read.options(**rules, header="true", multiLine="true", enforceSchema="true").schema(schema).csv(str(path))
    want = sorted(map(str, whole.where("_extra IS NULL").drop("_extra").collect()))
    for size in (700, 3000, 1 << 20):
        small_splits(size)
        df = read_reviews(spark, str(path))
        assert sorted(map(str, df.collect())) == want
    small_splits(700)
    assert read_reviews(spark, str(path)).rdd.getNumPartitions() > 1


def test_two_files_and_an_open_field(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2,"never closed\n3,z\n')
    (tmp_path / "b.csv").write_text('\nid,t\n4,"p\n\nq"\n')
    small_splits(8)
    got = sorted(tuple(r) for r in read_reviews(spark, str(tmp_path)).collect())
    assert got == [("1", "x\ny"), ("2", "never closed\n3,z"), ("4", "p\n\nq")]


def test_fields_in_single_byte_files(spark, tmp_path, small_splits):
    path = tmp_path / "x.csv"
    path.write_bytes(("Review;Rating\n" + '"It’s\nfine; yes";4\nplain;3\n' * 50).encode("cp1252"))
    small_splits(100)
    got = read_reviews(spark, str(path)).groupBy("Review", "Rating").count().collect()
    assert {tuple(r) for r in got} == {("It’s\nfine; yes", "4", 50), ("plain", "3", 50)}


def test_lines_by_how_they_start():
    m = R.Machine(",")
    assert m.open_after('1,"open', False) and not m.open_after('closed",2', True)
    assert not m.open_after('1,mid"quote', False) and m.open_after('still ""open', True)
    assert not m.open_after('1,"a"junk,"b"', False) and m.open_after('1,"a"junk,"b', False)
    assert not m.open_after('""",x', True) and m.open_after('"",x', True)
