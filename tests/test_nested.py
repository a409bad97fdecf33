from orrery.operators.nested import (
    explode_two_level,
    explode_with_position,
    has_any,
    inline_rows,
    map_of,
)


def test_inline_drops_null_and_empty(spark):
    df = spark.createDataFrame(
        [(1, [("a", 1)]), (2, []), (3, None), (4, [("b", None)])], "id int, l array<struct<n string, v int>>")
    got = sorted((r.id, r.n, r.v) for r in inline_rows(df, "l").collect())
    assert got == [(1, "a", 1), (4, "b", None)]


def test_positions_are_one_based(spark):
    df = spark.createDataFrame([(1, ["x", "y"])], "id int, l array<string>")
    assert [(r.pos, r.x) for r in explode_with_position(df, "l", "x").collect()] == [(1, "x"), (2, "y")]


def test_has_any_false_not_null(spark):
    df = spark.createDataFrame([(["a", None],), (["b"],), (None,)], "l array<string>")
    got = [r.h for r in df.select(has_any("l", ["b"]).alias("h")).collect()]
    assert got == [False, True, False]


def test_two_level_explode_suffixes_duplicate_names(spark):
    df = spark.createDataFrame(
        [(1, [("B1", [("R1", "Icy")], None)])],
        "sys int, bodies array<struct<name string, rings array<struct<name string, type string>>, "
        "belts array<struct<name string, type string>>>>",
    )
    out = explode_two_level(df, "bodies", ["belts", "rings"], keep=["sys"])
    assert out.columns == ["sys", "name", "name_1", "type"]
    assert [tuple(r) for r in out.collect()] == [(1, "B1", "R1", "Icy")]


def test_map_of_first_key_wins(spark):
    df = spark.createDataFrame([([("p", 1.0), ("q", 2.0), ("p", 3.0)],)], "e array<struct<key string, v double>>")
    m = df.select(map_of("e").alias("m")).first().m
    assert m == {"p": 1.0, "q": 2.0}
