"""Neighbourhood operators work their cells out once, however many passes follow each other."""

from gridloom.operators import neighbour as B

SPEC = "img_id long, y int, x int, c int"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _pairs(spark):
    rows = [(i, y, x, 2, (7 * i + 3 * y + 5 * x * x) % 23, (y * x + i) % 17) for i in range(2) for y in range(6) for x in range(5)]
    return rows, spark.createDataFrame(rows, SPEC + ", a int, b int")


def test_guided_has_no_plane_rows_and_no_cell_join(spark):
    """planes were rows that a pivot brought together, joined with the cells: several sorts of all cells in a task."""
    plan = _plan(B.guided(_pairs(spark)[1], 3, 4.0, "REPLICATE"))
    assert "pivotfirst" not in plan
    assert plan.count("posexplode") == 2  # one a pass, none worked out again


def test_guided_by_hand(spark):
    rows, pairs = _pairs(spark)
    a, b = ({(i, y, x): r[k] for i, y, x, *r in rows} for k in (1, 2))
    clip = lambda y, x: (min(max(y, 0), 5), min(max(x, 0), 4))
    mean = lambda f, i, y, x: sum(f(i, *clip(y + u, x + v)) for u in (-1, 0, 1) for v in (-1, 0, 1)) / 9

    def model(i, y, x):
        ma, mb = mean(lambda *p: a[p], i, y, x), mean(lambda *p: b[p], i, y, x)
        k = (mean(lambda *p: a[p] * b[p], i, y, x) - ma * mb) / (mean(lambda *p: a[p] ** 2, i, y, x) - ma * ma + 4.0)
        return k, mb - k * ma

    got = B.guided(pairs, 3, 4.0, "REPLICATE").collect()
    assert len(got) == len(rows)
    for r in got:
        at = (r.img_id, r.y, r.x)
        want = mean(lambda *p: model(*p)[0], *at) * a[at] + mean(lambda *p: model(*p)[1], *at)
        assert r.c == 2 and abs(r.v - want) < 1e-9


def test_features_work_cells_out_once(spark):
    """the derivatives were worked out again for the rows, heights, shapes and tops of every later pass."""
    cells = _pairs(spark)[1].where("a >= 0").selectExpr("img_id", "y", "x", "0 AS c", "a AS v")
    plan = _plan(B.min_eigen(cells, 3, "REPLICATE"))
    assert plan.count("posexplode") == 2 and "pivotfirst" not in plan
    assert _plan(B.good_features(B.min_eigen(cells, 3, "REPLICATE"), 0.1, 20)).count("posexplode") <= 7


def test_rows_that_are_missing(spark):
    """A row that an image lacks gives null in the rows around it and none in its own place, whatever the border."""
    cells = spark.createDataFrame([(0, y, x, 0, 10 * y + x) for y in (0, 1, 3) for x in range(2)], SPEC + ", v int")
    got = {(r.y, r.x): r.v for r in B.box(cells, 3, "REPLICATE", whole=False).collect()}
    assert {y for y, _ in got} == {0, 1, 3}
    assert got[1, 0] is None and got[3, 0] is None
    assert abs(got[0, 0] - sum(10 * y + x for y in (0, 0, 1) for x in (0, 0, 1)) / 9) < 1e-9
