import pytest

from netquarry.operators import rejects as R

CASES = [
    ("spef", "HEAD", '*DESIGN "top" // x', None), ("spef", "HEAD", '*DESIGN "a // b"', None), ("spef", "HEAD", '*DESIGN "a', "quoting"), ("spef", "HEAD", '*DESIGN x"a"', "quoting"),
    ("spef", "HEAD", '*DESIGN top', "value"), ("spef", "HEAD", '"a"', "columns"), ("spef", "HEAD", "", None), ("spef", "HEAD", '// only "', None), ("spef", "MAP", "*12\tn1\r", None),
    ("spef", "MAP", "*1x n", "value"), ("spef", "MAP", "*1", "columns"), ("spef", "CONN", "*i a:Y o *l 1:2:3", None), ("spef", "CONN", "*I a:Y O *L 1:2", "value"), ("spef", "CONN", "*P p B", None),
    ("spef", "CONN", "*P p IO", "value"), ("spef", "CONN", "*I a Y", "columns"), ("spef", "CAP", "1 a 2.5e-3", None), ("spef", "CAP", "1 a b -2", "value"), ("spef", "CAP", "1 a", "columns"),
    ("spef", "RES", "1 a b .5", None), ("spef", "RES", "x1 a b 5", "value"), ("spef", "RES", "1 a b .", "value"), ("spef", "RES", "1 a b 1 2", "columns"), ("spef", None, "a b", "command"),
    ("sdc", None, "# x [", None), ("sdc", None, "create_clock -name c -period 2 [get_ports a] ; # x [", None), ("sdc", None, "create_clock -name c -period 0.0e5 [get_ports a]", "value"),
    ("sdc", None, "set_load 1 [get_ports {a b}]", None), ("sdc", None, "set_load 1 [get_ports {a b]}", "quoting"), ("sdc", None, 'set_load 1 "a [b"', None), ("sdc", None, 'set_load 1 "a', "quoting"),
    ("sdc", None, "set_load 1 a\\ b", None), ("sdc", None, "set_load 1:2:3 a", "value"), ("sdc", None, "set_load -1 a", "value"), ("sdc", None, "SET_LOAD 1 a", "command"), ("sdc", None, "set_load 1", "columns"),
    ("sdc", None, "set_multicycle_path 2 -from a -to b", None), ("sdc", None, "set_multicycle_path 0 -from a -to b", "value"), ("sdc", None, "set_multicycle_path 1.5 -from a -to b", "value"),
    ("sdc", None, "set_false_path -from a -to b", None), (None, None, "x", "command"), ("sdc", None, None, None), ("sdc", None, "  ", None), ("sdc", None, "set_load 1 " + "a" * 200_000, None),
]


def test_reasons(spark):
    rows = [(i, *c[:3], "extra") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:10], "line_id long, fmt string, line_block string, raw_text string, reason string")
    got = [tuple(r) for r in R.reasons(df).collect()]
    assert len(got) == len(set(got))
    assert dict(got) == {i: c[3] for i, c in enumerate(CASES) if c[3]}
    good, bad = R.split(df)
    assert good.count() + bad.count() == df.count() and set(good.columns) == set(df.columns)
    assert R.reasons(df.limit(0)).count() == 0
    # lines without an id are known by their content
    lost = spark.createDataFrame([(None, *c[:3], "extra") for c in CASES], df.schema)
    good, bad = R.split(lost)
    assert good.count() == sum(c[3] is None for c in CASES) and bad.count() == sum(c[3] is not None for c in CASES)


@pytest.mark.parametrize("line", ["{[}]", "]", "a}", '"a" "'])
def test_unbalanced(line):
    assert R.sdc_words(line) is None
