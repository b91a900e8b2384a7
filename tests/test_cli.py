import pytest

from lakehaul.cli import main
from lakehaul.names import TableRef
from lakehaul.sinks import replace_table
from lakehaul.sources import read_folder, read_table


def test_jobs(spark, given, lake, capsys):
    source = lake.table("orders")
    replace_table(given("orders"), source)
    lake.database("db", lake.target)
    csv, out = f"{lake.folder}/csv", f"{lake.folder}/out"
    given("orders").write.option("header", True).csv(csv)

    main(["load", csv, out, "--table", f"{lake.source}.db.loaded"])
    assert "rows: 1500" in capsys.readouterr().out
    assert read_table(spark, lake.table("loaded")).count() == 1500
    main(["load", csv, f"{out}2", "--schema", given("orders").schema.toDDL()])

    main(["append", str(source), f"{lake.source}.db.more"])
    assert read_table(spark, lake.table("more")).count() == 1500
    main(["copy", str(source), f"{lake.target}.db.copied"])
    assert "source_count=1500" in capsys.readouterr().out
    main(["copy", str(source), f"{lake.target}.db.added", "--append"])
    assert "rows in the copy: 1500" in capsys.readouterr().out

    keyed = f"{lake.folder}/keyed"
    main(["keyed", str(source), keyed, "--keys", "o_custkey", "--order-by", "o_orderdate"])
    customers = given("orders").select("o_custkey").distinct().count()
    assert read_folder(spark, keyed).count() == customers

    main(["migrate", "*", lake.source, lake.target, "--parallelism", "2"])
    assert read_table(spark, TableRef("db", "more", lake.target)).count() == 1500
    main(["inventory", "--catalog", lake.source])
    assert "more" in capsys.readouterr().out
    main(["clean", "--tables", f"{lake.source}.db.more", "--database", f"{lake.target}.db"])
    main(["inventory", "--catalog", lake.target])
    assert "more" not in capsys.readouterr().out


def test_wrong_arguments_print_usage(capsys):
    with pytest.raises(SystemExit):
        main(["load", "only-one-folder"])
    assert "usage" in capsys.readouterr().err
