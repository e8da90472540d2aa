import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tarn.functions import types as Y
from tarn.functions.expressions import exact_sum, in_list, like
from tarn.operators import changes as C
from tarn.operators import errors as E
from tarn.operators import relational as R
from tarn.operators.constraints import ConstraintViolation, check, duplicates
from tarn.operators.definition import ColumnDefinition, TableDefinition
from tarn.operators.render import json_cells, text_table
from tarn.plans.explain import explain, pushed_filters, read_columns
from tarn.sources import catalog as K

col, lit = F.col, F.lit


def people(spark):
    return spark.createDataFrame([(1, "ann", 30), (2, "bob", None), (3, None, 25)], "id int, name string, age int")


def test_three_valued_logic(spark):
    row = spark.range(1).select(in_list(lit(2), [1, None]).alias("a"), in_list(lit(1), [1, None]).alias("b"), in_list(lit(2), [1, None], True).alias("c"), like(lit("a\\b"), "a\\_").alias("d"), like(lit(None), "%").alias("e")).first()
    assert tuple(row) == (None, True, None, True, None)


def test_where_drops_false_and_null_and_needs_a_boolean(spark):
    assert [r["id"] for r in R.where(people(spark), col("age") > 26).collect()] == [1]
    with pytest.raises(AnalysisException):
        R.where(people(spark), col("age")).collect()


def test_conditions_on_blobs_are_refused(spark):
    files = spark.createDataFrame([(1, bytearray(b"x"))], "id int, payload binary")
    assert R.where(files, col("id") == 1).count() == 1
    with pytest.raises(R.BlobPredicateError):
        R.where(files, col("payload").isNull())


def test_order_nulls_last_both_ways_and_paging(spark):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(R.sort(people(spark), "age")) == [3, 1, 2]
    assert ids(R.sort(people(spark), ("age", "desc"))) == [1, 3, 2]
    assert ids(R.sort(people(spark), ("age", "desc", "first"))) == [2, 1, 3]
    assert ids(R.page(people(spark), ["id"], 2, 2)) == [3] and ids(R.page(people(spark), ["id"], 9, 2)) == []
    assert R.page_count(people(spark), 2) == 2


def test_joins(spark):
    ship = spark.createDataFrame([(3, "Heron"), (8, "Tern"), (9, "Skua")], "id int, name string").alias("s")
    crate = spark.createDataFrame([(70, 8), (71, 3), (72, 8), (73, None), (74, 8)], "id int, ship int").alias("c")
    on = col("s.id") == col("c.ship")
    assert sorted(map(tuple, R.join(ship, crate, on).select("s.id", "name", "c.id").collect())) == [(3, "Heron", 71), (8, "Tern", 70), (8, "Tern", 72), (8, "Tern", 74)]
    assert R.join(ship, crate, on, "full").count() == 6 and R.join(ship, crate, how="cross").count() == 15
    with pytest.raises(ValueError):
        R.join(ship, crate)
    with pytest.raises(AnalysisException):
        R.join(ship, crate, on).select("id").collect()


def test_joins_on_blobs_are_refused(spark):
    a = spark.createDataFrame([(1, bytearray(b"x"))], "id int, payload binary").alias("a")
    b = spark.createDataFrame([(1, bytearray(b"x"))], "id int, payload binary").alias("b")
    assert R.join(a, b, col("a.id") == col("b.id")).count() == 1 and R.join(a, b, ["id"]).count() == 1
    for on in (col("a.payload") == col("b.payload"), (col("a.id") == col("b.id")) & col("b.payload").isNotNull(), ["payload"]):
        with pytest.raises(R.BlobPredicateError):
            R.join(a, b, on)


def test_table_definition(spark):
    table = TableDefinition([ColumnDefinition("id", "INT", primary_key=True, auto=True), ColumnDefinition("mail", "TEXT", unique=True), ColumnDefinition("n", "INT", not_null=True, default=0)])
    rows = table.insert(table.empty(spark), [("a",), ("b",), (None,), (None,)], ["mail"])
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "a", 0), (2, "b", 0), (3, None, 0), (4, None, 0)]
    assert sorted(r["id"] for r in table.insert(rows, [(9, "c", 1), (None, "d", 2)]).collect()) == [1, 2, 3, 4, 9, 10]
    for wrong in (lambda: table.insert(rows, [("a",)], ["mail"]), lambda: table.insert(rows, [(1, "z", 1)]), lambda: table.insert(rows, [("z", None)], ["mail", "n"]), lambda: table.update(rows, {"id": lit(1)}), lambda: table.update(rows, {"n": lit(None)}), lambda: table.drop_column(rows, "ID")):
        with pytest.raises(ConstraintViolation):
            wrong()
    assert sorted(r["id"] for r in table.update(rows, {"id": 5 - col("id")}).collect()) == [1, 2, 3, 4]
    with pytest.raises(E.WrongArity):
        table.insert(rows, [(1, 2)], ["mail"])
    with pytest.raises(E.NoSuchColumn):
        table.insert(rows, [(1,)], ["nope"])
    for columns, more in (([ColumnDefinition("b", "BLOB", unique=True)], {}), ([ColumnDefinition("b", "BLOB", primary_key=True)], {}), ([ColumnDefinition("a", "INT"), ColumnDefinition("A", "INT")], {}), ([ColumnDefinition("a", "INT")], {"unique": [["x"]]}), ([ColumnDefinition("a", "TEXT", auto=True)], {}), ([ColumnDefinition("a", "INT", primary_key=True)], {"primary_key": ["a"]})):
        with pytest.raises(E.TableError):
            TableDefinition(columns, **more)


def test_names_of_tables(spark):
    K.register(people(spark), "folk_a")
    with pytest.raises(E.TableExists):
        K.register(people(spark), "folk_a")
    K.rename_table(spark, "folk_a", "folk_b")
    assert [n for n in K.list_tables(spark) if n.startswith("folk")] == ["folk_b"]
    people(spark).write.saveAsTable("folk_stored")
    K.rename_table(spark, "folk_stored", "folk_kept")
    assert spark.table("folk_kept").count() == 3
    assert K.drop_table(spark, "folk_b") and K.drop_table(spark, "folk_kept") and not K.drop_table(spark, "folk_kept", if_exists=True)
    for wrong in (lambda: K.drop_table(spark, "folk_b"), lambda: K.rename_table(spark, "folk_b", "x")):
        with pytest.raises(E.NoSuchTable):
            wrong()


def test_exact_sum(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.000001,), (None,)], "v double")
    assert df.agg(exact_sum(col("v"))).first()[0] == 0.300001


def test_insert(spark):
    table = spark.createDataFrame([(4, "a", 0)], "id long, name string, price int")
    got = C.insert(table, [("b", None), ("c", 9), ("d", None)], ["name", "id"], {"price": lit(5)}, auto="id")
    assert sorted(map(tuple, got.collect())) == [(4, "a", 0), (9, "c", 5), (10, "b", 5), (11, "d", 5)]
    with pytest.raises(ValueError):
        C.insert(table, [(1,)], ["id", "name"])
    with pytest.raises(ValueError):
        C.insert(table, [(1, 2)], ["id", "id"])
    with pytest.raises(ConstraintViolation):
        C.insert(table, [(1, None)], ["id", "name"], not_null=["name"])


def test_numbers_are_dense_over_partitions(spark):
    got = C.number(spark.range(1000).repartition(7).select((999 - col("id")).alias("v")), "n", 5, by=["v"])
    assert sorted(map(tuple, got.collect())) == [(i, i + 6) for i in range(1000)]


def test_update_and_delete(spark):
    table = people(spark)
    assert sorted((r["id"], r["age"]) for r in C.update(table, {"age": col("id")}, col("age") > 26).collect()) == [(1, 1), (2, None), (3, 25)]
    assert sorted(r["id"] for r in C.delete(table, col("age") > 26).collect()) == [2, 3]
    assert C.affected(table, col("age") > 26) == 1 and C.delete(table).count() == 0 and table.count() == 3
    with pytest.raises(ValueError):
        C.update(table, {"nope": lit(1)})


def test_constraints(spark):
    table = people(spark)
    assert check(table, not_null=["id"], unique=[["name"]], primary_key=["id"]) is table
    with pytest.raises(ConstraintViolation):
        check(table, not_null=["name"])
    with pytest.raises(ConstraintViolation):
        check(C.update(table, {"id": lit(1)}), primary_key=["id"])
    assert check(C.update(table, {"id": col("id") + 1}), primary_key=["id"]).count() == 3  # the final state counts
    assert duplicates(C.update(table, {"name": lit(None)}), ["name"]).count() == 0


def test_columns(spark):
    table = C.rename_column(people(spark), "name", "tag")
    table = C.add_column(table, "password", Y.sql_type("TEXT"))
    assert C.drop_column(table, "id").columns == ["tag", "age", "password"]
    for wrong in (lambda: C.add_column(table, "TAG", Y.sql_type("INT")), lambda: C.rename_column(table, "tag", "id"), lambda: C.drop_column(table, "x"), lambda: C.drop_column(table, "id", ["id"])):
        with pytest.raises(ValueError):
            wrong()


def test_types_and_casts(spark):
    assert Y.sql_type("varchar(20)").simpleString() == "string" and Y.sql_type("FLOAT").simpleString() == "double"
    with pytest.raises(ValueError):
        Y.sql_type("DECIMAL(3,1)")
    with pytest.raises(ValueError):
        Y.cast(lit("a"), "BLOB")
    row = spark.range(1).select(Y.cast(lit(-2.7), "INT"), Y.cast(lit(True), "INT"), Y.cast(lit(5), "TIMESTAMP").cast("long"), Y.text_to_boolean(lit(" TRUE ")), Y.text_to_boolean(lit(None).cast("string")), Y.cast(lit("False"), "BOOLEAN"), Y.cast(lit(3), "BOOLEAN")).first()
    assert tuple(row) == (-2, 1, 5, True, None, False, True)
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        spark.range(1).select(Y.cast(lit("x"), "INT")).collect()
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(Y.cast(lit("yes"), "BOOLEAN")).collect()


def test_rendering(spark):
    shown = text_table(people(spark))
    assert "NULL" in shown and shown.endswith("(3 rows)")
    assert text_table(spark.range(120)).endswith("(120 rows)\n... (20 rows hidden)")
    cells = json_cells(spark.createDataFrame([(1, None, True, bytearray(b"\xff"), datetime.datetime(1970, 1, 1, 0, 0, 5))], "a int, b string, c boolean, d binary, e timestamp")).first()[0]
    assert cells == '[{"type":"int","value":1},{"type":"Null"},{"type":"bool","value":true},{"type":"blob","value":"FF"},{"type":"int","value":5}]'


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (col("id") * 2).alias("b"), lit("x").alias("c")).write.parquet(str(tmp_path / "t"))
    found = R.where(spark.read.parquet(str(tmp_path / "t")), (col("id") == 42) & (col("b") > 3)).select("id")
    assert "EqualTo(id,42)" in pushed_filters(found)[0] and read_columns(found) == ["struct<id:bigint,b:bigint>"]
    assert "Exchange" not in explain(found)
