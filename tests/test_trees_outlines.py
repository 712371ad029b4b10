import random

import numpy as np
import pytest

from gridloom.operators import graph, outlines, worms


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def test_forest_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m, kinds, smalls in ((40, 70, 3, (0, 10**6)), (12, 66, 1, (10**6,))):
        edges = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(kinds))) for _ in range(m)]
        df = spark.createDataFrame([*edges, (1, None, 1.0), (2, 3, None)], "src long, dst long, weight double")
        for small in smalls:
            got = {tuple(r) for r in graph.minimum_spanning_forest(df, small).collect()}
            assert got == kruskal(edges)
    assert graph.minimum_spanning_forest(spark.createDataFrame([], "src long, dst long, weight double")).count() == 0


def test_paths_between_ends_and_branches(spark):
    # 1-2-3-4 with 3-5-6 and 3-7: three paths leave 3; 10-...-30 is one path; 40-41 a single edge.
    edges = [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (7, 3), *((k, k + 1) for k in range(10, 30)), (41, 40)]
    rows = graph.forest_paths(spark.createDataFrame(edges, "src long, dst long")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.start, r.stop, r.seq)):
        found.setdefault((r.start, r.stop), []).append((r.src, r.dst))
    assert found == {
        (1, 3): [(1, 2), (2, 3)], (3, 4): [(3, 4)], (3, 6): [(3, 5), (5, 6)], (3, 7): [(3, 7)], (10, 30): [(k, k + 1) for k in range(10, 30)], (40, 41): [(40, 41)],
    }
    with pytest.raises(ValueError):
        graph.forest_paths(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))


def test_links_to_the_two_nearest_cells(spark):
    cells = [(1, 5, 5), (2, 5, 6), (3, 6, 5), (4, 4, 4), (5, 4, 5), (6, 9, 9)]
    links = worms.neighbour_links(spark.createDataFrame(cells, "id long, row int, col int")).collect()
    assert {(r.src, r.dst) for r in links if r.src == 1} == {(1, 5), (1, 2)}  # both beside it; the third at distance 1 comes later
    assert {(r.src, r.dst) for r in links if r.src == 4} == {(4, 5), (4, 1)} and not [r for r in links if 6 in (r.src, r.dst)]
    both = spark.createDataFrame([(z * 100 + i, z, r, c) for z in (0, 1) for i, r, c in cells], "id long, z int, row int, col int")
    parts = worms.edge_segments(both, ["z"]).collect()
    assert {r.id for r in parts} == {z * 100 + i for z in (0, 1) for i in range(1, 6)}
    assert len({r.segment for r in parts if r.id < 100}) == len({r.segment for r in parts if r.id > 100})


def grid_of(spark, a):
    return spark.createDataFrame([(r, c, float(a[r, c]) if a[r, c] else None) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, v double")


def walked(a):
    """{ring: corners} by walking round every region and hole with the cells on the right, turning right where two meet."""
    nr, nc = a.shape
    on = lambda r, c: 0 <= r < nr and 0 <= c < nc and bool(a[r, c])
    step, sides = [(0, 1), (1, 0), (0, -1), (-1, 0)], set()
    for r in range(nr):
        for c in range(nc):
            if on(r, c):
                sides |= {s for s, beside in (((r, c, 0), (r - 1, c)), ((r, c + 1, 1), (r, c + 1)), ((r + 1, c + 1, 2), (r + 1, c)), ((r + 1, c, 3), (r, c - 1))) if not on(*beside)}
    rings, seen = {}, set()
    for start in sorted(sides):
        if start in seen:
            continue
        ring, at = [], start
        while at not in seen:
            seen.add(at)
            ring.append(at[:2])
            r, c, w = at[0] + step[at[2]][0], at[1] + step[at[2]][1], at[2]
            at = next((r, c, (w + t) % 4) for t in (1, 0, 3) if (r, c, (w + t) % 4) in sides)
        rings[start[0] * (1 << 33) + start[1] * 4 + start[2]] = [*ring, start[:2]]
    return rings


def regions(a):
    """Number of the region of side-by-side cells that each cell is in."""
    label = np.zeros(a.shape, int)
    n = 0
    for r, c in np.argwhere(a):
        if label[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x] and not label[y, x]:
                label[y, x] = n
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return label


@pytest.mark.parametrize("tile", [3, 256])
def test_rings_and_holes_of_random_grids(spark, tile):
    rng = np.random.default_rng(tile)
    spiral = np.zeros((15, 15), int)
    spiral[::2] = 1
    spiral[1::4, -1] = spiral[3::4, 0] = 1  # one long band that crosses every tile
    nested = np.zeros((13, 13), int)
    for k in range(0, 7, 2):
        nested[k : 13 - k, k : 13 - k] = 1
        nested[k + 1 : 12 - k, k + 1 : 12 - k] = 0
    for a in (rng.random((14, 17)) < 0.6, spiral, nested) if tile == 3 else (rng.random((9, 9)) < 0.85,):
        grid = grid_of(spark, np.asarray(a))
        found = outlines.rings(grid, tile).cache()
        got = {}
        for r in found.orderBy("ring", "seq").collect():
            got.setdefault(r.ring, []).append((r.row, r.col))
        assert got == walked(a)
        label = regions(a)
        home = {}
        for ring, way in got.items():  # the valid cell right of the first side
            (r, c), (r1, c1) = way[:2]
            home[ring] = label[{(0, 1): (r, c), (1, 0): (r, c - 1), (0, -1): (r - 1, c - 1), (-1, 0): (r - 1, c)}[r1 - r, c1 - c]]
        about = {r.ring: r for r in outlines.with_parents(found).collect()}
        outer = {home[k]: k for k, r in about.items() if r.area > 0}
        assert len(outer) == label.max() and all(r.parent == (None if r.area > 0 else outer[home[k]]) for k, r in about.items())
        assert sum(r.area for r in about.values()) == np.asarray(a).sum()


def test_pieces_make_up_the_texts(spark):
    a = np.zeros((8, 9), int)
    a[1:7, 1:8] = 1
    a[2, 2] = a[4:6, 4] = 0
    a[0, 8] = 1
    grid = grid_of(spark, a)
    whole = {r.id: r for r in outlines.polygons(grid, 10.0, 20.0, 2.0, -1.0).collect()}
    parts = {}
    for r in outlines.polygon_pieces(grid, 10.0, 20.0, 2.0, -1.0, tile=3, piece=4).orderBy("id", "hole", "ring", "piece").collect():
        assert r.text.count(" ") <= 2 * 4 + 4
        parts[r.id] = parts.get(r.id, "") + r.text
    assert parts == {k: r.wkt for k, r in whole.items()}
    assert (whole[2].area, whole[2].holes, whole[1].area) == (39.0, 2, 1.0)
    assert whole[1].wkt == "POLYGON ((26.0 20.0, 28.0 20.0, 28.0 19.0, 26.0 19.0, 26.0 20.0))"
    assert whole[2].wkt.count("(") == 4 and whole[2].wkt.startswith("POLYGON ((12.0 19.0, ")


def test_close_points_link_like_all_pairs(spark):
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.random((150, 2)) * 12, rng.normal(20, 0.05, (200, 2)), rng.normal(20, 0.05, (150, 2)) + [1.05, 0], [[30, 30], [31, 30], [30, 31.0001]], rng.random((40, 2)) - 3])
    df = spark.createDataFrame([(float(z), int(i + 1000 * z), float(x), float(y)) for z in (1, 2) for i, (x, y) in enumerate(xy)], "z double, id long, x double, y double")
    for eps in (1.0,):
        pairs = graph.connected_components(worms.near_pairs(df, eps, ["z"])).collect()
        links = worms.near_links(df, eps, ["z"])
        assert {(r.node, r.component) for r in graph.connected_components(links).collect() if r.node in {p.node for p in pairs}} == {(r.node, r.component) for r in pairs}
        assert links.count() < 12 * df.count()


def test_walk_of_many_points_keeps_the_rule():
    rng = np.random.default_rng(13)
    for xy, eps in ((np.cumsum(rng.normal(size=(300, 2)), axis=0), 3.0), (rng.normal(size=(200, 2)), 4.0), (np.round(rng.random((120, 2)) * 8), 1.5)):
        order, is_open = worms._path(xy, eps), np.ones(len(xy), bool)
        assert sorted(order) == list(range(len(xy)))
        is_open[order[0]] = False
        for k in range(1, len(order)):
            d = np.hypot(*(xy - xy[order[k - 1]]).T)
            ranked = sorted(range(len(xy)), key=lambda j: (d[j], j))[:10]
            step = [j for j in ranked if is_open[j] and d[j] <= eps]
            if step:
                assert order[k] == step[0]
            else:
                gap = np.hypot(*np.moveaxis(xy[:, None] - xy[None, order[:k]], 2, 0)).min(axis=1)
                want = min((gap[j], j) for j in np.flatnonzero(is_open))
                assert want[0] > eps or order[k] == want[1]
                if want[0] > eps:  # not one cluster: the test's points end here
                    break
            is_open[order[k]] = False
