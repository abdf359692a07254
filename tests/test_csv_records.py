"""Record boundaries of CSV files that are cut into byte ranges, against the standard library's reader."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.sources import readers as RD
from veritab.sources.records import csv_records, entry_states, open_after, states


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a less than a thousand bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _written(path, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def _rows(seed, n, long=0):
    rng = np.random.default_rng(seed)
    parts = ["a", "b,", '"', "\n", "x y", '""', ",\n", "é", "1"]
    rows = [["k", "text", "note"]]
    for i in range(n):
        rows.append([f"k{i}", "t" + "".join(rng.choice(parts, rng.integers(0, 12))), "n" + "".join(rng.choice(parts, 3))])
    if long:
        rows[len(rows) // 2][1] = 't\n"z",' * long
    return rows


@pytest.mark.parametrize("seed,long,end", [(1, 0, "\r\n"), (2, 0, "\n"), (3, 400, "\n")])
def test_records_over_ranges(spark, small_ranges, tmp_path, seed, long, end):
    rows = _rows(seed, 120, long)
    _written(tmp_path / "t.csv", rows, end)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 3
    got = RD.load_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == rows[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows[1:]))


def test_several_files_keep_their_own_headers(spark, small_ranges, tmp_path):
    every = []
    for k in range(3):
        rows = _rows(10 + k, 40, 100 * k)
        _written(tmp_path / f"{k}.csv", rows)
        every += rows[1:]
    got = RD.load_csv(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every))


def test_without_header_blank_lines_and_an_open_end(spark, small_ranges, tmp_path):
    (tmp_path / "t.csv").write_text('x,1\n\n"y\nz",2\nw"q,3\n"open\nend')
    got = RD.load_csv(spark, str(tmp_path / "t.csv"), header="false")
    assert sorted(map(tuple, got.select("_c0").collect())) == [("open\nend",), ('w"q',), ("x",), ("y\nz",)]
    (tmp_path / "e.csv").write_text("a,b\n")
    assert RD.load_csv(spark, str(tmp_path / "e.csv")).collect() == []


def test_same_rows_as_one_task_a_file(spark, small_ranges, tmp_path):
    _written(tmp_path / "t.csv", _rows(5, 200, 50))
    split = RD.load_csv(spark, str(tmp_path / "t.csv"))
    whole = RD.load_csv(spark, str(tmp_path / "t.csv"), multiLine="true")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    assert csv_records(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 1


def test_the_map_of_a_line(spark):
    lines = ["a,b", '"a,b', 'a,"b', 'a,"b"', 'a"b', '"a""', '"a"",b', '""', '"', 'a,"b""",c', '"a" x,"', ",,", ""]
    open_ = [False, True, True, False, False, True, True, False, True, False, True, False, False]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", open_after(F.col("line")).alias("o"))
    assert [r["o"] for r in sorted(got.collect())] == open_
    long = spark.createDataFrame([('"' + 'a""' * 1_000_000 + '",' + "b," * 1_000_000 + '"c',)], "line string")
    assert long.select(open_after(F.col("line"))).first()[0] is True


def test_states_and_their_composition_step_by_step(spark):
    rng = np.random.default_rng(4)
    opens, stays = rng.random(500) < 0.3, rng.random(500) < 0.7
    for state in (0, 1):
        want, now = [], bool(state)
        for o, s in zip(opens, stays, strict=True):
            now = bool(s if now else o)
            want.append(now)
        assert states(state, opens, stays).tolist() == want
    maps = spark.createDataFrame([(i, "f", i * 10, bool(o), bool(s)) for i, (o, s) in enumerate(zip(opens, stays, strict=True))],
                                 "range bigint, file string, block bigint, opens boolean, stays boolean")
    got = [r["open"] for r in sorted(entry_states(maps).collect())]
    assert got == [False, *states(0, opens, stays).tolist()[:-1]]
