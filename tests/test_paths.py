"""Places along paths that stand still for a while, or all the time."""

from gridloom.operators import lines


def test_equal_corners_lose_no_place(spark):
    rows = [(1, 0, 4.0, 4.0), (1, 1, 4.0, 4.0), (2, 0, 0.0, 0.0), (2, 1, 15.0, 0.0), (2, 2, 15.0, 0.0), (3, 0, 9.0, 9.0), (4, 0, 0.0, 0.0), (4, 1, 0.0, 0.0), (4, 2, 0.0, 8.0)]
    got = lines.along_path(spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), 7.5).collect()
    assert sorted((r.line_id, r.k, r.x, r.y) for r in got) == [(1, 0, 4.0, 4.0), (2, 0, 0.0, 0.0), (2, 1, 7.5, 0.0), (2, 2, 15.0, 0.0), (3, 0, 9.0, 9.0), (4, 0, 0.0, 0.0), (4, 1, 0.0, 7.5)]
