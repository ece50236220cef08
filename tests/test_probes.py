"""Cases of attention maps, portions and configuration differences."""

from pyspark.sql import functions as F

from tessera.operators import probes


def test_portions(spark):
    def frames(n, start, end, k):
        return spark.range(1).select(probes.portion_frames(F.lit(n), start, end, k)).first()[0]

    assert frames(100, 0.0, 1.0, 4) == [0, 25, 50, 75]
    assert frames(0, 0.0, 1.0, 4) == []
    assert frames(3, 0.0, 1.0, 5) == [0, 0, 1, 1, 2]  # fewer frames than asked for
    assert frames(100, 0.0, 0.02, 4) == [0, 1, 2, 3]  # grows to the end only
    assert frames(100, 0.98, 1.0, 4) == [96, 97, 98, 99]
    assert frames(100, 0.5, 0.5, 1) == [49]


def test_softmax_and_segments(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0]), (1, [1000.0, 0.0, 0.0, 0.0])], "g int, v array<double>").withColumn("p", probes.softmax(F.col("v")))
    assert probes.segment_mass(df, "g", "p", {"a": (0, 1), "b": (1, 4), "c": (4, 4)}).first()[1:] == (0.625, 0.375, 0.0)


def test_pooled_map_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0, 1, [0.25] * 4)], "g int, r int, n int, p array<double>")
    got = {(x["row_bin"], x["key_bin"]): x["mass"] for x in probes.pooled_map(df, "g", "r", "n", "p", 2, 2).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 0.5}  # edges 0, round(0.5) = 0, 1


def test_config_diff(spark):
    table = lambda c: spark.createDataFrame(probes.config_nodes(c), "path string, parent string, is_map boolean, value string")
    a = {"x": 1, "deep": {"same": [1], "list": [1, 2], "gone": {"p": 1}}, "map": {"p": 1}}
    b = {"x": 1, "deep": {"same": [1], "list": [2, 1]}, "map": 3, "new": None}
    got = {tuple(r) for r in probes.config_diff(table(a), table(b)).collect()}
    assert got == {("deep.list", "different"), ("deep.gone", "only_first"), ("map", "different"), ("new", "only_second")}
    assert probes.config_diff(table(a), table(a)).count() == 0
