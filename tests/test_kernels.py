"""Numpy kernels and expressions against hand-computed answers."""

import math

import numpy as np
import pyarrow as pa
import pytest

from voxelgrain.operators import distance, geometry, measure, report
from voxelgrain.sources import tiff


def ball(shape, centre, radius, size):
    at = np.stack(np.indices(shape), -1)
    return (((at - centre) * size) ** 2).sum(-1) <= radius**2


def test_distance_transform_is_brute_force():
    rng = np.random.default_rng(1)
    target = rng.random((5, 9, 7)) < 0.05
    size = (0.1, 0.02, 0.03)
    cells = np.argwhere(target) * size
    want = np.array([np.sqrt(((cells - c * np.array(size)) ** 2).sum(1).min()) for c in np.ndindex(target.shape)]).reshape(target.shape)
    assert np.allclose(distance.distance_transform(target, size), want)
    assert np.isinf(distance.distance_transform(np.zeros((2, 3), bool), (1, 1))).all()


def test_distance_transform_over_long_lines():
    rng = np.random.default_rng(3)
    target, wanted = rng.random((3, 4, 700)) < 0.004, np.zeros((3, 4, 700), bool)
    wanted[1, 2, 5] = True
    size = (1.0, 0.3, 0.07)
    cells = np.argwhere(target) * size
    got = distance.distance_transform(target, size, wanted)[1, 2]
    want = [np.sqrt(((cells - np.array((1, 2, k)) * size) ** 2).sum(1).min()) for k in range(700)]
    assert np.allclose(got, want)
    flat = rng.random((300, 300)) < 0.001
    assert distance.distance_transform(flat, (1, 1)).max() < 300


def test_component_labels():
    cells = np.array([(0, 0), (0, 1), (1, 2), (5, 5), (6, 4), (9, 9)])
    assert measure.component_labels(cells).tolist() == [1, 1, 1, 2, 2, 3]
    # A spiral is one piece however far round it goes, and edges of rows don't wrap.
    snake = [(y, x) for y in range(0, 21, 2) for x in range(11)] + [(y, 10 if y % 4 == 1 else 0) for y in range(1, 20, 2)]
    assert set(measure.component_labels(np.array(snake)).tolist()) == {1}
    assert measure.component_labels(np.array([(0, 5), (1, 0), (1, 5)])).tolist() == [1, 2, 1]
    assert len(measure.component_labels(np.zeros((0, 2), int))) == 0


@pytest.mark.parametrize(
    ("vertices", "edges", "branches", "length", "tortuosity"),
    [
        ([(0, 0, k) for k in range(5)], [(k, k + 1) for k in range(4)], 1, 4.0, 1.0),
        ([(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 3), (0, -1, 3)], [(0, 1), (1, 2), (2, 3), (2, 4)], 3, None, None),
        ([(0, 0), (0, 1), (1, 1), (1, 0)], [(0, 1), (1, 2), (2, 3), (3, 0)], 1, 4.0, None),
        ([(0, k) for k in range(3)] + [(5, k) for k in range(3)], [(0, 1), (1, 2), (3, 4), (4, 5)], 2, 4.0, 1.0),
        ([], [], 0, 0.0, None),
        ([(1, 1, 1)], [], 0, 0.0, None),
    ],
)
def test_skeleton_graphs(vertices, edges, branches, length, tortuosity):
    got = geometry.skeleton_graph_metrics(vertices, edges)
    assert got[0] == branches
    if length is not None:
        assert got[1] == pytest.approx(length)
    if tortuosity is not None:
        assert got[2] == pytest.approx(tortuosity)


def test_curved_and_stepped_skeletons():
    arc = [(math.sin(t), math.cos(t)) for t in np.linspace(0, math.pi / 2, 40)]
    assert geometry.skeleton_graph_metrics(arc, [(k, k + 1) for k in range(39)])[2] == pytest.approx((math.pi / 2) / math.sqrt(2), abs=0.02)
    stairs = [((k + 1) // 2, k // 2) for k in range(13)]
    assert 1.0 <= geometry.skeleton_graph_metrics(stairs, [(k, k + 1) for k in range(12)])[2] < 1.2


def test_payload_round_trip():
    rng = np.random.default_rng(2)
    vertices, faces = rng.random((50, 3)) * 3, rng.integers(0, 50, (20, 3))
    data = geometry.encode_payload(vertices, faces)
    assert len(data) == 32 + 50 * 6 + 60 * 4
    back, same = geometry.decode_payload(data)
    assert np.abs(back - vertices).max() < 3 / 65535 + 1e-6 and (same == faces).all()
    assert geometry.encode_payload(np.zeros((0, 3)), faces) is None and geometry.decode_payload(b"short") is None
    merged, index = geometry.merge([(vertices, faces), (vertices, faces)])
    assert len(merged) == 100 and (index[20:] == faces + 50).all()


def test_mesh_is_closed_and_has_the_balls_size():
    size = np.array((0.1, 0.05, 0.05))
    cells = np.argwhere(ball((41, 81, 81), np.array((20, 40, 40)), 1.0, size))[::1]
    points, faces = geometry.mesh(cells, tuple(size))
    edges = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all()
    volume = abs(np.einsum("ij,ij->i", points[faces[:, 0]], np.cross(points[faces[:, 1]], points[faces[:, 2]])).sum() / 6)
    assert volume == pytest.approx(4 * math.pi / 3, rel=0.05)
    assert len(geometry.mesh(cells[:5], tuple(size))[1]) == 0


def closed(faces):
    """Every directed edge has its opposite."""
    edges = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    net = {}
    for a, b in edges.tolist():
        net[min(a, b), max(a, b)] = net.get((min(a, b), max(a, b)), 0) + (1 if a < b else -1)
    return not any(net.values())


def test_smoothed_and_thinned_mesh():
    size = (0.1, 0.05, 0.05)
    cells = np.argwhere(ball((41, 81, 81), np.array((20, 40, 40)), 1.0, np.array(size)))
    whole = geometry.mesh(cells, size, sigma=0.7, step=2)
    points, faces = geometry.mesh(cells, size, sigma=0.7, step=2, reduction=0.8)
    assert 100 < len(faces) <= 0.2 * len(whole[1]) and closed(faces) and closed(whole[1])
    volume = abs(np.einsum("ij,ij->i", points[faces[:, 0]], np.cross(points[faces[:, 1]], points[faces[:, 2]])).sum() / 6)
    assert volume == pytest.approx(4 * math.pi / 3, rel=0.12)
    # A small instance is neither blurred away nor stepped over, and a mesh of few faces isn't thinned.
    small = np.argwhere(np.ones((2, 2, 2), bool))
    assert 0 < len(geometry.mesh(small, (1, 1, 1), sigma=1.5, step=2, reduction=0.8)[1]) and closed(geometry.mesh(small, (1, 1, 1), sigma=1.5, step=2)[1])


def test_pixel_graph_keeps_diagonals():
    corner = np.array([(0, 0), (0, 1), (1, 1)])
    points, edges = geometry.pixel_graph(corner, (1.0, 1.0))
    assert sorted(tuple(sorted(e)) for e in edges.tolist()) == [(0, 1), (0, 2), (1, 2)]
    branches, length, _ = geometry.skeleton_graph_metrics(points, edges)
    assert length == pytest.approx(2 + math.sqrt(2))


def test_outline_of_a_ring_has_a_hole():
    cells = np.array([(y, x) for y in range(5) for x in range(5) if not (y == 2 and x == 2)])
    points, lines = geometry.outline(cells, (1, 1))
    assert len(lines) == 20 + 4 and (np.bincount(lines.ravel()) == 2).all()


def test_thinning_and_curve_skeleton():
    bar = np.zeros((9, 30), bool)
    bar[3:6, 3:27] = True
    cells = np.argwhere(geometry.thin(bar))
    branches, length, _ = geometry.skeleton_graph_metrics(*geometry.pixel_graph(cells, (1, 1)))
    assert branches == 1 and 18 <= length <= 24
    rod = np.argwhere(np.ones((3, 3, 25), bool))
    branches, length, bent = geometry.skeleton_graph_metrics(*geometry.curve_skeleton(rod, (0.1, 0.1, 0.1)))
    assert branches == 1 and 1.8 <= length <= 2.7 and bent < 1.1


def test_gallery_has_whole_rows():
    assert report.gallery_size(6) == 24 and report.gallery_size(7, rows=100) == 119 and report.gallery_size(200) == 200


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
def test_tiff_round_trip(dtype):
    volume = (np.arange(3 * 4 * 5).reshape(3, 4, 5) % 7).astype(dtype)
    data = tiff.write_volume(volume, spacing=0.1, resolution=(500_000, 1))
    assert (tiff.read_volume(data) == volume).all()
    assert tiff.voxel_size(data) == pytest.approx((0.1, 0.02, 0.02))
    plane = tiff.write_volume(volume[0])
    assert tiff.read_volume(plane).shape == (4, 5)
    with pytest.raises(ValueError):
        tiff.voxel_size(plane)


def test_label_check():
    assert tiff.check_labels(np.array([[0.0, 300.0]])).dtype == np.uint16
    for bad in (np.array([0.5]), np.array([-1])):
        with pytest.raises(ValueError):
            tiff.check_labels(bad)


def many_cells(rng, dims, n=60):
    """Cells of some instances: scattered, lumps, one cell, none, and null."""
    lists = []
    for k in range(n):
        box = [(4, 9, 6), (2, 3, 2), (1, 1, 1), (3, 30, 5)][k % 4][-dims:]
        cells = np.unique(rng.integers(0, box, (rng.integers(1, 40), dims)) + rng.integers(0, 300, dims), axis=0)
        packed = [int(sum(int(v) << 21 * (dims - 1 - i) for i, v in enumerate(c))) for c in cells]
        rng.shuffle(packed)
        lists.append(packed)
    return pa.array([*lists, [], None, lists[0]], pa.list_(pa.int64()))


def test_outlines_of_many_are_those_of_each(monkeypatch):
    cells = many_cells(np.random.default_rng(1), 2)
    for most in (200_000, 50):
        monkeypatch.setattr(geometry, "PART_CELLS", most)
        got = [p for _, many in geometry._parts(cells, 2) for p in geometry.outlined(many, (0.02, 0.03))]
        assert got == [geometry.encode_payload(*geometry.outline(geometry._unpacked(c, 2), (0.02, 0.03))) if c else None for c in cells.to_pylist()]


@pytest.mark.parametrize("size", [(0.02, 0.03), (0.1, 0.02, 0.02)])
def test_skeletons_of_many_are_those_of_each(monkeypatch, size):
    cells = many_cells(np.random.default_rng(2), len(size))
    monkeypatch.setattr(geometry, "CANVAS_CELLS", 200)
    got = [r for _, many in geometry._parts(cells, len(size)) for r in geometry.skeletons_of(many, size).to_pylist()]
    assert len(got) == len(cells)
    for c, r in zip(cells.to_pylist(), got, strict=True):
        if not c or len(c) < 2:
            assert (r["skeleton"], r["vertices"], r["branches"], r["cable_length_um"], r["tortuosity"]) == (None, 0, 0, 0, None)
            continue
        at = geometry._unpacked(c, len(size))
        if len(size) == 2:
            grid, low = geometry._grid(at)
            points, edges = geometry.pixel_graph(np.argwhere(geometry.thin(grid)) + low, size)
        else:
            points, edges = geometry.curve_skeleton(at, size)
        branches, length, bent = geometry.skeleton_graph_metrics(points, edges)
        assert (r["skeleton"] is None, r["vertices"], r["branches"]) == (geometry.skeleton_payload(points, edges) is None, len(points), branches)
        assert r["cable_length_um"] == pytest.approx(length) and r["tortuosity"] == (None if bent is None else pytest.approx(bent))


def test_components_of_many_groups():
    rng = np.random.default_rng(3)
    cells = [np.unique(rng.integers(0, 9, (rng.integers(1, 20), 2)) + rng.integers(0, 1000, 2), axis=0) for _ in range(30)]
    got = measure.component_labels(np.concatenate(cells), np.repeat(np.arange(30), [len(c) for c in cells]))
    assert got.tolist() == [k for c in cells for k in measure.component_labels(c).tolist()]


def test_a_mesh_of_scattered_cells_takes_few_steps_over_its_grid(monkeypatch):
    rng = np.random.default_rng(6)
    cells = np.unique(np.stack([rng.integers(0, n, 12) for n in (7, 50, 11)], 1), axis=0)
    size = (0.1, 0.02, 0.02)
    many = geometry.mesh(cells, size, sigma=0.35, step=2, reduction=0.8)
    for name in ("_shifted", "_envelope", "_scan"):
        monkeypatch.setattr(distance, name, None)
    few = geometry.mesh(cells, size, sigma=0.35, step=2, reduction=0.8)
    assert len(few[1]) and all((a == b).all() for a, b in zip(many, few, strict=True))


def test_transforms_of_few_cells_up_to_a_distance_and_of_many_agree(monkeypatch):
    rng = np.random.default_rng(7)
    target, size = rng.random((6, 30, 9)) < 0.02, (0.1, 0.02, 0.02)
    want = np.sqrt(np.min([sum(((np.indices(target.shape)[k] - c[k]) * s) ** 2 for k, s in enumerate(size)) for c in np.argwhere(target)], axis=0))
    for few in (1000, 0):
        monkeypatch.setattr(distance, "FEW_CELLS", few)
        assert np.allclose(distance.distance_transform(target, size), want)
        near = distance.distance_transform(target, size, upto=0.1)
        assert np.allclose(near[want <= 0.1], want[want <= 0.1]) and (near[want > 0.1] > 0.1).all()
    monkeypatch.setattr(distance, "SHORT_LINE", 0)
    assert np.allclose(distance.distance_transform(target, size), want)
