"""Sites of other sizes and thresholds in one run give what a run for each of them gives."""

import pytest

from fenland.plans import workloads as wo

SITES = {
    0: {"nrows": 30, "ncols": 40, "hat": 2.2, "mhws": 1.7, "cth": 8.0, "lzth": 0.42, "hzth": 0.52, "nbbreaches": 1, "smoothing": 1, "hole": 5, "small": 10, "large": 1_000_000, "ordermax": 4, "hops": 4},
    1: {"nrows": 36, "ncols": 28, "hat": 1.6, "mhws": 1.2, "cth": 5.0, "lzth": 0.60, "hzth": 0.75, "nbbreaches": 2, "smoothing": 2, "hole": 3, "small": 6, "large": 900, "ordermax": 3, "hops": 3},
}


def cells_of(spark):
    """A trunk with two arms in each site, its banks, and some ponds."""
    rows = []
    for site, p in SITES.items():
        mid = p["ncols"] // 2
        for r in range(p["nrows"]):
            for c in range(p["ncols"]):
                far = min(2 * abs(c - mid), abs(2 * (r - 20) + (c - mid)) if c >= mid else 99, abs(2 * (r - 12) + (mid - c)) if c <= mid else 99, 4 * max(abs(r - 26), abs(c - 4)))
                z = None if (r * 31 + c) % 211 == 0 else (18 + min(220, 4 * far) + (p["nrows"] - r) // 4 + (r * 7 + c * 3) % 5) / 100 * (1 + site * 0.3)
                rows.append((site, r, c, z, 10.5 if 4 <= far <= 7 else 1.3))
    return spark.createDataFrame(rows, "site_id long, r long, c long, z double, slope double")


def sorted_rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("what", ["overland", "morphometry"])
def test_one_run_equals_one_for_each_site(spark, what):
    cells = cells_of(spark)

    def run(c, s):
        if what == "morphometry":
            return sorted_rows(wo.morphometry(c, s))
        return sorted_rows(wo.overland_paths(c, wo.creek_mask(c, s), s))

    params = spark.createDataFrame([{"site_id": k, **v} for k, v in SITES.items()])
    both = run(cells, wo.settings_of(params))
    # The longer workload is run again for one of them only.
    for k in (0, 1) if what == "overland" else (1,):
        assert [x for x in both if x[0] == k] == run(cells.where(f"site_id = {k}"), wo.Settings(**SITES[k]))
    assert {x[0] for x in both} == {0, 1}
