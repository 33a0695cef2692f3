"""What shows on larger tables only, on small tables made for it."""

import time

import duckdb
import numpy as np
import pytest

from gridlume import catalog
from gridlume.operators import spatial
from tests.test_oracle import normal


@pytest.fixture
def alike(spark, tmp_path):
    """A check of a query against its SQL over tables made of DuckDB queries."""

    def run(name: str, **made: str):
        con = duckdb.connect()
        for t, text in made.items():
            con.execute(f"copy ({text}) to '{tmp_path}/{t}.parquet' (format parquet)").fetchall()
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'").fetchall()
        got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
        assert normal(got) == normal(want)
        return got

    return run


def test_exact_halves(alike):
    # 62500 / -1e6 is a half at three digits, 25 / 20 one at one digit, 100.25 / -8 one at four
    price = "case when i % 3 = 0 then 100.25 when i % 3 = 1 then 100.75 else 900.1 end::double"
    alike("fixed_decimals", part=f"select i as p_partkey, {price} as p_retailprice from (select unnest(range(0, 100)) as i union all select unnest(range(500, 700000, 500)))")


def test_a_place_of_more_than_a_report_may_have(alike):
    got = alike("landed_fact", nation="select unnest([3, 5]) as n_nationkey", customer="select i as c_custkey, case i % 20 when 7 then 5 else 3 end as c_nationkey, 'BUILDING' as c_mktsegment from range(20000) t(i)")
    assert (got["kind"] == "street").sum() == 38


def test_rows_a_cell_are_not_broadcast(spark, data):
    """A small table's boxes are many rows a cell, too many to be sent whole through the driver."""
    text = catalog.QUERIES["bbox_join"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 2


def _plots(spark, n: int, key: str, box: str, kind: str, far: int):
    """Boxes that begin at places of a lattice, so many are alike or only touch: a few large, one in a hundred of half a degree, small ones and points."""
    i = f"(id * {far})"
    size = f"case when id % 500 = 3 then 2 when id % 100 = 7 then 0.5 when id % 700 = 9 then 60 else id % 5 / 32 end"
    at = spark.range(n).selectExpr("id", f"{i} * 37 % 61 / 32 - 1 as s", f"{i} * 53 % 67 / 32 - 1 as w", f"cast({size} as double) as d")
    k = f"case when id % 97 = 5 then null else cast(id % 4000 as {kind}) end as {key}"
    return at.selectExpr(k, f"named_struct('south', s, 'west', w, 'north', s + d, 'east', w + d * 0.5) as {box}")


def test_boxes_in_blocks_are_paired_as_one_by_one(spark):
    """Cells of many blocks, keys of two types, some null or given twice: the same pairs as often as a plain join has them."""
    left, right = _plots(spark, 6000, "a", "ab", "long", 1), _plots(spark, 5000, "z", "zb", "string", 7)
    test = "ab.west <= zb.east and zb.west <= ab.east and ab.south <= zb.north and zb.south <= ab.north"
    pairs = lambda df: df.groupBy("a", "z").count()
    got, want = pairs(spatial.bbox_join(left, right, "ab", "zb", "a", "z", 0.03)).persist(), pairs(left.join(right).where(test).select("a", "z")).persist()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 100_000


def test_pairs_of_boxes_take_few_bytes(spark, tmp_path):
    """Keys of a block are paired in the same order with each larger box, so written pairs shrink: they filled the disk."""
    box = lambda size: f"named_struct('south', s, 'west', w, 'north', s + {size}, 'east', w + {size})"
    at = lambda n: spark.range(n).selectExpr("id", "id * 37 % 997 / 1000 as s", "id * 53 % 991 / 1000 as w")
    df = spatial.bbox_join(at(500).selectExpr("id as a", f"{box(0.5)} as ab"), at(40_000).selectExpr("id as z", f"{box(0.001)} as zb"), "ab", "zb", "a", "z", 0.03)
    df.coalesce(4).write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 2_000_000 and sum(x.stat().st_size for x in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * n


def test_many_lines_of_few_ends_are_joined_in_linear_work():
    node = lambda i: [2 + i * 0.001, 48 + i * i % 13 * 0.001]
    lines = [np.array([node(i * 7 % 50), node(i * 7 % 50 + 1)][:: 1 if i % 3 else -1]) for i in range(20_000)]
    start = time.process_time()
    chained = spatial.chain_lines(lines)
    assert time.process_time() - start < 20  # quadratic before: 3.4 s for 3,600 such lines
    assert sum(len(x) - 1 for x in chained) == 20_000


def test_lists_of_pages_gather_distinct_values_only(spark, data):
    """No set of (place, text) pairs a page: it held every row."""
    for name in ("partial_final_merge", "page_merge_browser"):
        assert "collect_set" not in catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_dealt_to_all_cores(spark, data):
    """A small file is one split, whatever the work a row."""
    from gridlume.plans.standins import addresses

    assert addresses(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_street_is_rewritten_once(spark, data):
    """Label, name and key are of one name: three chains of rewrites stood in the plan."""
    text = catalog.QUERIES["street_rollup"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("VINCI") == 1


def test_incidents_are_gone_through_once(spark, data):
    """Scalars and lists came from two passes over all rows that were joined."""
    for name in ("merge_incidents", "entity_rollup"):
        text = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("FileScan") == 1


def test_scalars_of_a_row_count_once_however_many_addresses(spark):
    from gridlume.operators.rollup import incident_rollup

    schema = "k string, seq long, id string, households double, start string, restore string, addresses array<struct<location: string, households: double>>"
    x, y = ("x", 1.0), ("y", 2.0)
    rows = [("a", 2, "i2", 5.0, "02/01/2025 10:00", "", [x, y, x]), ("a", 1, None, 7.0, "", "01/01/2025 10:00", [y]), ("a", 3, "i3", 1.0, "01/01/2025 10:00", "03/01/2025 10:00", []), ("b", 1, "i", None, "x", None, None), (None, 1, "n", 2.0, None, "", [None, x, None])]
    got = {r["k"]: r for r in incident_rollup(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert tuple(got["a"]) == ("a", None, 13.0, "01/01/2025 10:00", "03/01/2025 10:00", [y, x])
    assert tuple(got["b"]) == ("b", "i", None, "x", "", [])
    assert tuple(got[None]) == (None, "n", 2.0, "", "", [None, x])


class _Kept(dict):
    """A state that counts how often it is looked at."""

    looks = 0

    def containsKey(self, at):  # noqa: N802
        self.looks += 1
        return at in self

    def getValue(self, at):  # noqa: N802
        self.looks += 1
        return self[at]

    def updateValue(self, at, value):  # noqa: N802
        self.looks += 1
        self[at] = value

    def iterator(self):
        return iter(self.items())


def test_deliveries_of_a_page_meet_the_state_once_a_batch():
    import pandas as pd

    from gridlume.streaming.facts import PageFacts

    class Revision(list):
        exists, get, update = lambda self: bool(self), lambda self: self[-1], lambda self, v: self.append(v)

    facts = PageFacts()
    facts.pages, facts.revision = _Kept(), Revision()
    batch = lambda versions: pd.DataFrame({"page": [v % 4 for v in versions], "version": versions, "fact": [f'{{"households": {v}}}' for v in versions]})
    out = [*facts.handleInputRows(("k",), iter([batch(range(500)), batch(range(999, 499, -1))]), None)]
    assert facts.pages.looks <= 12 and {k[0]: v[0] for k, v in facts.pages.items()} == {0: 996, 1: 997, 2: 998, 3: 999}
    assert out[0]["households"].tolist() == [996 + 997 + 998 + 999.0]
    assert [*facts.handleInputRows(("k",), iter([batch(range(900))]), None)] == []


def test_lines_alike_are_one_line(spark, monkeypatch):
    """Only lines that differ are labelled, and each line still has its component's least line."""
    from gridlume.operators import nearness

    seen, real = [], nearness._components_of
    monkeypatch.setattr(nearness, "_components_of", lambda ends, *a: (seen.append(ends.count()), real(ends, *a))[1])
    rows = [(None if i % 2 else "a", i, 48.0 + i % 6, 2.0, 48.0 + i % 6, 2.0 + i % 3 * 1e-5) for i in range(600)] + [("a", 600, None, 2.0, 48.0, 2.0), ("a", 601, -0.0, 0.0, 0.0, -0.0), ("a", 602, 0.0, -0.0, -0.0, 0.0)]
    ends = spark.createDataFrame(rows, "k string, idx long, y0 double, x0 double, y1 double, x1 double")
    got = {(r["k"], r["idx"]): r["component"] for r in nearness.line_components(ends, "k", nearness.Earth(35.0)).collect()}
    assert seen == [7]
    assert got == {(None if i % 2 else "a", i): i % 6 for i in range(600)} | {("a", 600): 600, ("a", 601): 601, ("a", 602): 601}


def test_ways_are_found_once(spark, data):
    """Found lines are read again, not found again from the tables, by each step after."""
    files = catalog.QUERIES["matched_fact"](spark, data).inputFiles()
    assert not [f for f in files if f.endswith("customer.parquet")]


@pytest.mark.parametrize("name", ["partial_final_merge", "page_merge_browser"])
def test_merges_of_pages_read_a_row_a_page_and_key(spark, data, name):
    """The merge read all rows that differ in any text, once for its lists and once for all else."""
    read = spark.read.parquet(*catalog.QUERIES[name](spark, data).inputFiles())
    lines = spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_suppkey % 5 as page", "l_orderkey % 300 as k")
    assert read.count() == lines.distinct().count()


@pytest.mark.parametrize("name", ["partial_final_merge", "page_merge_browser"])
def test_pages_of_many_alike_rows_and_of_none_but_nulls(alike, name):
    line = "i // 4 * 7 % 900 as l_orderkey, i as l_partkey, case when i // 4 % 3 = 0 then 5 else i % 11 end as l_suppkey, (i % 4 + i // 900)::int as l_linenumber, (i % 50)::double as l_quantity, i::double as l_extendedprice"
    date = "case when i // 4 % 5 > 0 then timestamp '1998-01-01' + to_days((i * 37 % 40)::int) end as l_shipdate"
    got = alike(name, lineitem=f"select {line}, substr('ANR', 1 + (i * 5 % 3)::int, 1) as l_returnflag, substr('OF', 1 + (i % 2)::int, 1) as l_linestatus, {date} from range(5000) t(i)")
    assert len(got) == 300
