import pytest

from lexiforge.plans.queries import ORACLES, QUERIES
from tests.parity import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_islands_of_lines_beyond_ascii(spark, tmp_path):
    """Letters with accents bound words, and a line's end is its last character; each document has one line of words and one more."""
    prose = "four words of prose"
    lines = ['Êréè de çque le enéré éêçaux token = "222fb9ba" ou ouêier en étre', "naïfs = éaux", "αbeta = βgamma", "x_abc = deux", "éabc = édef", "a (1)", "a (1)\x85", "a (1)\u2028", "a (1)\x0b", "a (1) \t", "a (1)\r", "", "x = 1"]
    table = [(i, f"{prose}\n{x}\n{prose}") for i, x in enumerate(lines)] + [(90, "éaux éêçaux ouêier étre\nx = 1"), (91, "abcé defé ghié\nx = 1"), (92, None)]
    spark.createDataFrame([(*r, "s") for r in table], "doc_id long, text string, source string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), QUERIES["line_islands"], ORACLES["line_islands"])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
