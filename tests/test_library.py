import pytest

import __spark_entry__ as entry
from netquarry.operators import library as L
from netquarry.plans import library_queries as Q
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture
def eager(spark):
    """A session that broadcasts whatever it guesses to be below 1 GB."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    plan = df._jdf.queryExecution()
    df.collect()
    text = plan.executedPlan().toString()
    return "SortMergeJoin" in text, "Broadcast" in text


@pytest.mark.parametrize("name", ["cell_equivalence", "upsize", "downsize"])
def test_no_side_that_grows_with_the_cells_is_broadcast(eager, name):
    assert joins(L.classes(Q._cells(eager, SF))) == (True, False)
    assert joins(entry.queries()[name](eager, SF)) == (True, False)
    assert compare(eager, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def one_class(spark, cells=4000, areas=10):
    """A class of cells with few areas, beside cells that stand for themselves."""
    rows = [(i, float(i * 7 % areas), "footprint", 0, True, "f:x") for i in range(cells)] + [(cells + i, 1.0, "self", cells + i, False, f"c:{cells + i}") for i in range(50)]
    return spark.createDataFrame(rows, "cell long, area double, rule string, class_id long, has_footprint boolean, k string")


def ran(df):
    """Rows of the result, and what each node of the plan that ran put out: (name, rows)."""
    query = df._jdf.queryExecution()
    rows = [tuple(r) for r in df.collect()]
    out, left = [], [query.executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            left.append(node.plan())
            continue
        m = node.metrics().get("numOutputRows")
        out.append((name, m.get().value() if m.isDefined() else 0))
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return rows, out


def test_upsize_repeats_no_side_as_long_as_the_cells(spark):
    cells, areas = 4000, 10
    rows, nodes = ran(L.upsizes(L.ladder(one_class(spark, cells, areas))))
    first = [min(i for i in range(cells) if i * 7 % areas == a) for a in range(areas)]
    assert sorted(rows) == [(i, "footprint", 0, (areas - 1 - i * 7 % areas) * cells // areas, first[i * 7 % areas + 1]) for i in range(cells) if i * 7 % areas < areas - 1]
    assert max(n for name, n in nodes if name == "Generate") < cells


def test_downsize_reads_the_cells_once(spark):
    cells, areas = 4000, 10
    rows, nodes = ran(L.downsizes(L.ladder(one_class(spark, cells, areas))))
    first = [min(i for i in range(cells) if i * 7 % areas == a) for a in range(areas)]
    assert sorted(rows) == [(i, "footprint", 0, i * 7 % areas * cells // areas, first[i * 7 % areas - 1]) for i in range(cells) if i * 7 % areas > 0]
    assert sum(n for name, n in nodes if name.startswith("Scan parquet")) < 2 * cells


def test_ladder_equals_brute_force_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    made = one_class(spark, 300, 7).collect() + [(1000 + i, float(i), "function", 1000, False, "s:y") for i in range(100)]
    schema = "cell long, area double, rule string, class_id long, has_footprint boolean, k string"
    want = []
    for c in made:
        same = sorted((x[1], x[0]) for x in made if x[5] == c[5])
        more, less = [x for x in same if x[0] > c[1]], sorted((-x[0], x[1]) for x in same if x[0] < c[1])
        want.append((c[0], same.index((c[1], c[0])) + 1, len(same), len(less), len(more), less[0][1] if less else None, more[0][1] if more else None))
    got = L.ladder(spark.createDataFrame([tuple(x) for x in made], schema)).select("cell", "place", "n_cells", "n_smaller", "n_larger", "next_smaller", "next_larger")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def fits(a, b):
    """Whether two cells (key, footprint, is_seq, area, function) can stand for each other, by the rule for a pair."""
    if a[1] is not None and b[1] is not None:
        return a[1] == b[1]
    return not (a[2] or b[2]) and a[4] is not None and a[4] == b[4]


def parts(spark, path, n=240):
    """Parts with few brands and types, so two thirds of them are one type, and with what may be missing; gives them as cells too."""
    cells, rows = [], []
    for i in range(n):
        brand, kind, size = None if i % 17 == 5 else f"B{i % 2}", None if i % 29 == 7 else "A T" if i % 3 < 2 else f"T{i % 4}", 2 + i % 2 * (i % 5)
        price = None if i % 19 == 3 else float("nan") if i % 23 == 4 else float(i * 7 % 10)
        rows.append((i, brand, kind, size, price))
        cells.append((i, brand + kind if i % 3 == 0 and brand and kind else None, i % 7 == 0, 0.0 if price is None else price, kind + str(size) if size > 2 and kind else None))
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return cells


def candidates(cells, better):
    return sorted((a[0], "footprint" if a[1] and b[1] else "function", b[0], b[3]) for a in cells for b in cells if fits(a, b) and better(b[3], a[3]))


def listed(spark, path, name):
    rows = entry.queries()[name](spark, str(path)).select("cell", "rule", "candidate", "area").collect()
    assert compare(spark, str(path), name, entry.queries()[name], entry.oracle_sql()[name]) is None
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("block", [8, 4096])
def test_downsize_lists_every_smaller_cell_that_fits(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(L, "BLOCK", block)
    want = candidates(parts(spark, tmp_path), lambda b, a: b < a)
    assert {r[1] for r in want} == {"footprint", "function"} and len(want) > 500
    assert listed(spark, tmp_path, "downsize") == want


@pytest.mark.parametrize("block", [8, 4096])
def test_upsize_lists_every_larger_cell_that_fits(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(L, "BLOCK", block)
    want = candidates(parts(spark, tmp_path), lambda b, a: b > a)
    assert {r[1] for r in want} == {"footprint", "function"} and len(want) > 500
    assert listed(spark, tmp_path, "upsize") == want
