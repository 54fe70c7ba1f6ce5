from fenland.sources import fixtures, grids, stages


def test_ascii_grid_with_many_splits(spark, tmp_path):
    n = 300
    text = "ncols 3\nnrows %d\nxll 10.0\nyll 20.0\ncellsize 2\nnodata -9999\n" % n + "".join(f"{i} {i + 0.5} {-9999 if i % 7 == 0 else i * 2}\n" for i in range(n))
    (tmp_path / "a.asc").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = {(x.r, x.c): x.z for x in grids.read_ascii_grid(spark, str(tmp_path / "a.asc")).collect()}
        head = grids.read_grid_header(spark, str(tmp_path / "a.asc")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3 * n and all(rows[i, 1] == i + 0.5 for i in range(n)) and all(rows[i, 2] == (None if i % 7 == 0 else i * 2.0) for i in range(n))
    assert (head.site_id, head.ncols, head.nrows, head.gs) == ("a", 3, n, 2.0)


def test_site_params_are_parsed_not_run(spark, tmp_path):
    (tmp_path / "UserVar_x.txt").write_text("# comment\nname='abc';\t# the name\nLZth=-0.05\t# low\nHAT = 2.286;\n")
    row = grids.read_site_params(spark, str(tmp_path / "UserVar_x.txt")).first()
    assert (row["name"], row["LZth"], row["HAT"]) == ("abc", -0.05, 2.286)


def test_phony_network(spark):
    assert fixtures.phony_network(spark, 2, 128).select("site_id").distinct().count() == 2


def test_tables_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 1.5, None), (1, 0, 1, None, 2.0), (2, 3, 4, 0.0, 1.0)], "site_id long, r int, c int, z double, slope double")
    grids.write_cells(cells, f"{tmp_path}/cells")
    assert sorted(grids.read_cells(spark, f"{tmp_path}/cells").select(*cells.columns).collect(), key=repr) == sorted(cells.collect(), key=repr)
    for turn in (cells, cells.where("site_id = 1")):
        stages.write_stage(turn, str(tmp_path), "stage")
        assert sorted(stages.read_stage(spark, str(tmp_path), "stage").collect(), key=repr) == sorted(turn.collect(), key=repr)


def test_bucketed_tables_join_without_an_exchange(spark):
    from fenland.sources import stages

    cells = spark.range(3000).selectExpr("id % 3 as site_id", "id div 60 * 20 as r", "id % 60 * 20 as c", "id * 1.0 as z")
    names = ("bucketed_left", "bucketed_right")
    try:
        a, b = stages.write_bucketed(cells, names[0], 8), stages.write_bucketed(cells.where("r % 40 = 0").selectExpr("site_id", "r", "c", "z + 1 as y"), names[1], 8)
        both = stages.joined(a, b)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.count() == cells.where("r % 40 = 0").count() and both.where("y <> z + 1").count() == 0
        assert "Exchange" not in stages.joined(a, b, "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in stages.joined(a, b, "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_byte_ranges_read_each_line_once(spark, tmp_path):
    """Ranges of every size from one byte on, two grids in folders, a hidden file, long and empty lines, Windows line ends."""
    from fenland.sources import ranges

    want = {}
    for site, n, end in (("a", 9, "\n"), ("b", 4, "\r\n")):
        folder = tmp_path / f"site={site}"
        folder.mkdir()
        rows = [[-9999 if (i + j) % 5 == 0 else i * 100 + j + 0.5 for j in range(3)] for i in range(n)]
        head = ["ncols 3", f"nrows {n}", "xllcorner 1", "yllcorner 2", "cellsize 2.5", "NODATA_value -9999"]
        (folder / "grid.asc").write_bytes((end.join(head + [" ".join(map(str, r)) for r in rows]) + end + end).encode())
        want |= {(site, i, j): None if v == -9999 else v for i, r in enumerate(rows) for j, v in enumerate(r)}
    (tmp_path / "_SUCCESS").write_text("not a grid\n")
    for size in (1, 7, 50, 1 << 20):
        for path in (str(tmp_path), f"file://{tmp_path}"):
            got = ranges.read_grid_ranges(spark, path, site=r"site=([^/]*)/", range_bytes=size).collect()
            assert len(got) == len(want) and {(x.site_id, x.r, x.c): x.z for x in got} == want
    heads = {x.file.split("site=")[1][0]: (x.ncols, x.nrows, x.gs, x.nodata) for x in ranges.grid_headers(spark, str(tmp_path)).collect()}
    assert heads == {"a": (3, 9, 2.5, -9999.0), "b": (3, 4, 2.5, -9999.0)}
    (tmp_path / "none").mkdir()
    assert ranges.read_grid_ranges(spark, f"{tmp_path}/none").count() == 0
