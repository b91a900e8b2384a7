import pytest

from lakehaul.names import TableRef, database_name, is_plugin, quote, table_name, text


def test_parts_are_quoted():
    assert quote("a`b", "c d") == "`a``b`.`c d`"
    assert text("it's \\ here") == "'it\\'s \\\\ here'"


def test_names_read_from_text():
    assert TableRef.of("a.b.c") == TableRef("b", "c", "a")
    assert TableRef.of("b.c") == TableRef("b", "c")
    assert str(TableRef.of("a.b.c")) == "a.b.c"
    for wrong in ("c", "a.b.c.d", "a..c"):
        with pytest.raises(ValueError):
            TableRef.of(wrong)


def test_catalog_without_plugin_is_a_database_prefix(spark):
    assert table_name(spark, TableRef("db", "t", "src")) == "`spark_catalog`.`src__db`.`t`"
    assert database_name(spark, "db") == "`spark_catalog`.`db`"
    assert not is_plugin(spark, "src")


def test_configured_catalog_is_used_as_it_is(spark):
    spark.conf.set("spark.sql.catalog.configured", "some.Catalog")
    try:
        assert is_plugin(spark, "configured")
        assert table_name(spark, TableRef("db", "t", "configured")) == "`configured`.`db`.`t`"
    finally:
        spark.conf.unset("spark.sql.catalog.configured")
