"""Migrations that go on where they stopped, and the order of their copies."""

import pathlib
import threading
import time

import pytest

from lakehaul.catalog import drop_tables
from lakehaul.names import TableRef
from lakehaul.plans import migrate_database, migrate_databases
from lakehaul.plans.ledger import Ledger
from lakehaul.sinks import CONTENT, replace_table
from lakehaul.sources import read_table
from lakehaul.threads import POOL, largest_first
from tests.test_migration import IDLE, ONE, TWO, filled, outcome

__all__ = ["filled"]


class Stopped(BaseException):
    """A driver that is killed."""


@pytest.fixture
def ledger(filled):
    return f"{filled.folder}/ledger"


def stop_after(monkeypatch, copies: int) -> list:
    """Lets that many copies through and stops the run at the next; what was copied."""
    import lakehaul.plans.migration as migration

    real, done = migration.try_copy_table, []

    def copy(spark, source, *rest):
        if len(done) == copies:
            raise Stopped
        done.append(source.table)
        return real(spark, source, *rest)

    monkeypatch.setattr(migration, "try_copy_table", copy)
    return done


@pytest.mark.parametrize("copies", [0, 1, 3])
def test_a_stopped_run_goes_on(spark, filled, ledger, monkeypatch, copies):
    with monkeypatch.context() as patched:
        first = stop_after(patched, copies)
        with pytest.raises(Stopped):
            migrate_databases(spark, "*", filled.source, filled.target, parallelism=1, ledger=ledger)
    with monkeypatch.context() as patched:
        second = stop_after(patched, 99)
        done = migrate_databases(spark, "*", filled.source, filled.target, ledger=ledger)
    assert outcome(done.report) == sorted(IDLE + ONE + TWO)
    # A table that failed is tried again, one that was copied is not.
    assert not {*first} & {*second} - {"spoiled"}
    assert {*first, *second} == {"customer", "embeddings", "spoiled", "documents"}
    unbroken = migrate_databases(spark, "*", filled.source, filled.target)
    assert [r[:2] + r[3:] for r in done.report.collect()] == [r[:2] + r[3:] for r in unbroken.report.collect()]


def test_what_is_gone_from_the_target_is_copied_again(spark, filled, ledger, monkeypatch):
    migrate_database(spark, "two", filled.source, filled.target, ledger=ledger)
    copied = stop_after(monkeypatch, 99)
    migrate_database(spark, "two", filled.source, filled.target, ledger=ledger)
    assert copied == []
    lost = TableRef("two", "documents", filled.target)
    drop_tables(spark, [lost])
    migrate_database(spark, "two", filled.source, filled.target, ledger=ledger)
    assert copied == ["documents"] and read_table(spark, lost).count() == 200


def test_a_failed_table_succeeds_later(spark, given, filled, ledger):
    migrate_databases(spark, "one", filled.source, filled.target, ledger=ledger)
    drop_tables(spark, [TableRef("one", "spoiled", filled.source)])
    replace_table(given("supplier"), TableRef("one", "spoiled", filled.source))
    done = migrate_databases(spark, "one", filled.source, filled.target, ledger=ledger, check=CONTENT)
    assert all(r.succeeded for r in done.report.collect())
    entries = Ledger(spark, ledger, filled.source, filled.target)
    assert entries.entries().count() == 4 and entries.latest().count() == 3


def test_ledgers_of_other_catalogs_in_one_folder(spark, filled, ledger):
    migrate_database(spark, "two", filled.source, filled.target, ledger=ledger)
    assert Ledger(spark, ledger, filled.target, filled.source).finished() == {}
    assert Ledger(spark, ledger, None, filled.target).finished() == {}
    assert set(Ledger(spark, ledger, filled.source, filled.target).finished()) == {("two", "documents")}


def test_a_half_written_entry_does_not_count(spark, filled, ledger):
    migrate_database(spark, "two", filled.source, filled.target, ledger=ledger)
    entries = Ledger(spark, ledger, filled.source, filled.target)
    [whole] = pathlib.Path(ledger).glob("*/*.parquet")
    temporary = pathlib.Path(ledger) / "later" / "_temporary" / "0"
    temporary.mkdir(parents=True)
    (temporary / "part.parquet").write_bytes(whole.read_bytes()[:40])
    assert entries.entries().count() == 1


def test_entries_of_many_threads(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), "a", "b")
    threads = [
        threading.Thread(target=ledger.append, args=("db", f"t{i}", (i, i), None, 0.0, float(i))) for i in range(12)
    ]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(ledger.finished()) == 12


def test_the_largest_listed_table_comes_first(spark):
    done = []
    sizes = {"a": [(1, "a1"), (30, "a30")], "b": [(20, "b20"), (0, "b0")]}
    largest_first(spark, ["a", "b"], sizes.__getitem__, done.append, 1)
    assert done == ["a30", "b20", "a1", "b0"]


def test_copies_do_not_wait_for_the_slowest_listing(spark):
    ended: dict[str, float] = {}

    def expand(group):
        time.sleep(1.0 if group == "slow" else 0.0)
        ended[group] = time.monotonic()
        return [(1, f"{group} table")]

    def work(item):
        ended[item] = time.monotonic()

    largest_first(spark, ["slow", "quick"], expand, work, 2)
    assert ended["quick table"] < ended["slow"] < ended["slow table"]


def test_each_thread_has_a_pool_of_its_own(spark):
    pools = set()

    def work(_):
        time.sleep(0.2)
        pools.add(spark.sparkContext.getLocalProperty(POOL))

    before = spark.sparkContext.getLocalProperty(POOL)
    largest_first(spark, [0], lambda _: [(1, n) for n in range(6)], work, 3)
    assert pools == {"lakehaul-0", "lakehaul-1", "lakehaul-2"}
    assert spark.sparkContext.getLocalProperty(POOL) == before


def test_an_error_ends_the_call(spark):
    def work(item):
        raise RuntimeError(f"cannot do {item}")

    with pytest.raises(RuntimeError, match="cannot do"):
        largest_first(spark, [1, 2], lambda group: [(1, group)], work, 2)
