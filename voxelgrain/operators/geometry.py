"""Geometry: the quantised payload, outlines, meshes, and skeletons with their metrics, and the rows that hold them.

Kernels are numpy. Each takes one instance's cells, which a grouped aggregate has gathered as packed numbers, so that
an Arrow batch holds many small instances; what kernels return are binary columns and numbers.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions import expressions as ex
from voxelgrain.operators import groups, measure
from voxelgrain.operators.distance import distance_transform
from voxelgrain.operators.lineage import kept
from voxelgrain.operators.measure import Size

HEADER = struct.Struct("<II6f")
#: Faces above which a mesh is thinned out, and cells below which an instance has no skeleton.
MANY_FACES, DUST_CELLS = 100, 2
#: Cells of many instances, and of the canvas on which some are thinned, that are worked on at a time.
PART_CELLS, CANVAS_CELLS = 200_000, 1_000_000


def encode_payload(vertices: np.ndarray, indices: np.ndarray) -> bytes | None:
    """Little-endian: vertex and index counts, minimum and scale of each axis, 16-bit vertices, 32-bit indices; nothing for nothing."""
    if not len(vertices) or not len(indices):
        return None
    low = vertices.min(axis=0).astype(np.float32)
    scale = (vertices.max(axis=0) - vertices.min(axis=0)).astype(np.float32)
    scale[scale == 0] = 1
    steps = np.clip((vertices - low) / scale * 65535 + 0.5, 0, 65535).astype("<u2")
    return HEADER.pack(len(vertices), indices.size, *low, *scale) + steps.tobytes() + indices.astype("<u4").tobytes()


def decode_payload(data: bytes | None, per_index: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Vertices and indices (rows of ``per_index``); nothing for a short or empty payload."""
    if data is None or len(data) < HEADER.size:
        return None
    n, m, *box = HEADER.unpack_from(data)
    if not n or not m:
        return None
    steps = np.frombuffer(data, "<u2", n * 3, HEADER.size).reshape(n, 3)
    indices = np.frombuffer(data, "<u4", m, HEADER.size + n * 6).reshape(-1, per_index)
    return np.array(box[:3]) + steps / 65535 * np.array(box[3:]), indices


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One mesh of several: vertices one after the other, indices moved along."""
    offsets = np.cumsum([0, *(len(v) for v, _ in parts)])
    return np.concatenate([v for v, _ in parts]), np.concatenate([i + o for (_, i), o in zip(parts, offsets, strict=False)])


def _grid(cells: np.ndarray, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A boolean grid around the cells and its origin."""
    low = cells.min(axis=0) - pad
    grid = np.zeros(cells.max(axis=0) - low + 1 + pad, bool)
    grid[tuple((cells - low).T)] = True
    return grid, low


#: The six tetrahedra of a cell, by the bits of their corners: paths from corner 0 to corner 7.
_PATHS = [(0, a, a | b, 7) for a in (1, 2, 4) for b in (1, 2, 4) if a != b]


def _blurred(field: np.ndarray, widths: list[float]) -> np.ndarray:
    """Gaussian blur, ``widths`` in cells along each axis, with the edge values going on outside."""
    for axis, width in enumerate(widths):
        reach = math.ceil(4 * width)
        if width <= 0 or reach < 1:
            continue
        weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
        weights /= weights.sum()
        lines = np.moveaxis(field, axis, -1)
        padded = np.pad(lines, [(0, 0)] * (field.ndim - 1) + [(reach, reach)], mode="edge")
        blurred = sum(w * padded[..., k : k + lines.shape[-1]] for k, w in enumerate(weights))
        field = np.moveaxis(blurred, -1, axis)
    return field


def _unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of three whole numbers from 0, in order, and the place of each row among them."""
    n = int(rows.max()) + 1
    if n >= 2**21:
        found, back = np.unique(rows, axis=0, return_inverse=True)
        return found, back.reshape(-1)
    keys, back = np.unique((rows[:, 0] * n + rows[:, 1]) * n + rows[:, 2], return_inverse=True)
    return np.stack([keys // (n * n), keys // n % n, keys % n], 1), back


def decimated(points: np.ndarray, faces: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` faces: vertices in one cell of a grid become one, in the finest grid that leaves so few.

    A face that loses a corner goes, and so do two that cover each other, so a closed mesh stays closed.
    """
    low = points.min(axis=0)
    span = float((points.max(axis=0) - low).max())

    def merged(cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.floor((points - low) / span * cells).astype(np.int64)
        _, of = np.unique((place[:, 0] * (cells + 1) + place[:, 1]) * (cells + 1) + place[:, 2], return_inverse=True)
        found = of[faces]
        found = found[(found[:, 0] != found[:, 1]) & (found[:, 1] != found[:, 2]) & (found[:, 2] != found[:, 0])]
        if len(found):
            # Faces with the same corners count by the way they go round them; what cancels out goes.
            first = found.argmin(axis=1)
            found = np.take_along_axis(found, (first[:, None] + np.arange(3)) % 3, 1)
            turned = found[:, 1] > found[:, 2]
            corners, back = _unique_rows(np.where(turned[:, None], found[:, [0, 2, 1]], found))
            net = np.bincount(back, np.where(turned, -1, 1), len(corners)).astype(int)
            found = np.concatenate([np.repeat(corners, np.maximum(net, 0), axis=0), np.repeat(corners[:, [0, 2, 1]], np.maximum(-net, 0), axis=0)])
        return of, found, place

    few, many = 1, max(2, int(math.sqrt(len(faces))) * 4)
    while many - few > 1:
        middle = (few + many) // 2
        few, many = (middle, many) if len(merged(middle)[1]) <= most else (few, middle)
    of, found, _ = merged(few)
    if span <= 0 or not len(found):
        return points, faces
    counts = np.bincount(of)
    centres = np.stack([np.bincount(of, points[:, k]) / counts for k in range(3)], 1)
    used, index = np.unique(found, return_inverse=True)
    return centres[used], index.reshape(-1, 3)


def _depth(grid: np.ndarray, at: np.ndarray, size: Size) -> np.ndarray:
    """Distance of every cell inside to the nearest one outside; 0 outside. Nothing is nearer than the next cell along the finest axis."""
    finest = int(np.argmin(size))
    beside = np.eye(grid.ndim, dtype=at.dtype)[finest]
    if (grid[tuple((at - beside).T)] & grid[tuple((at + beside).T)]).any():
        return distance_transform(~grid, size)
    return np.where(grid, math.sqrt(size[finest] ** 2), 0.0)


def mesh(cells: np.ndarray, size: Size, least: int = 8, sigma: float = 0.0, step: int = 1, reduction: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Closed triangle mesh (x, y, z) where the signed distance of the cells is zero, by marching tetrahedra; nothing below ``least`` cells.

    The field is blurred by ``sigma`` finest cells and taken at every ``step``-th cell, but neither by more than the
    instance can bear: half its inscribed radius, and a step less than that radius in coarsest cells. Of more than
    ``MANY_FACES`` faces the share ``reduction`` goes.
    """
    if len(cells) < least:
        return np.zeros((0, 3)), np.zeros((0, 3), int)
    width = max(0.0, sigma) * min(size)
    pad = 2 if width <= 0 else max(math.ceil(3 * width / s) + 1 for s in size)
    grid, low = _grid(cells, max(pad, 2 * step))
    inside = _depth(grid, cells - low, size)
    radius = float(inside.max())
    width = min(width, radius / 2)
    step = max(1, min(step, int(radius / max(size)) - 1))
    # What is far off never reaches a cell with a surface: a blur there and one back, and a step.
    upto = math.sqrt(sum(((2 * math.ceil(4 * width / s) + step) * s) ** 2 for s in size))
    field = inside - distance_transform(grid, size, upto=upto)
    if width > 0:
        field = _blurred(field, [width / s for s in size])
    field = field[::step, ::step, ::step]
    found = np.argwhere(field > 0)
    if not len(found):
        return np.zeros((0, 3)), np.zeros((0, 3), int)
    # The cells that have a corner inside, in raster order; those that have one outside, too, are cut.
    corners = np.array([[(c >> k) & 1 for k in (2, 1, 0)] for c in range(8)])
    base = (found[:, None] - corners).reshape(-1, 3)
    base = base[((base >= 0) & (base < np.array(field.shape) - 1)).all(axis=1)]
    strides = np.array([field.shape[1] * field.shape[2], field.shape[2], 1])
    ids = np.unique(base @ strides)[:, None] + corners @ strides
    values = field.ravel()
    crossed = ids[(values[ids] <= 0).any(1)]
    triangles = []
    for path in _PATHS:
        tet = crossed[:, path]
        inside = values[tet] > 0
        count = inside.sum(1)
        # Corners inside first: then one, two or three of them decide the shape of the cut.
        order = np.argsort(~inside, axis=1, kind="stable")
        tet = np.take_along_axis(tet, order, 1)
        edge = lambda t, i, j: np.sort(t[:, [i, j]], axis=1)
        one, two, three = tet[count == 1], tet[count == 2], tet[count == 3]
        triangles.append(np.stack([edge(one, 0, 1), edge(one, 0, 2), edge(one, 0, 3)], 1))
        triangles.append(np.stack([edge(three, 0, 3), edge(three, 1, 3), edge(three, 2, 3)], 1))
        a, b, c, d = edge(two, 0, 2), edge(two, 0, 3), edge(two, 1, 3), edge(two, 1, 2)
        triangles += [np.stack([a, b, c], 1), np.stack([a, c, d], 1)]
    cut = np.concatenate(triangles)
    keys = cut[..., 0] * field.size + cut[..., 1]
    unique, faces = np.unique(keys.ravel(), return_inverse=True)
    p, q = unique // field.size, unique % field.size
    t = values[p] / (values[p] - values[q])
    at = lambda i: np.stack(np.unravel_index(i, field.shape), -1) * step + low
    points = (at(p) + (at(q) - at(p)) * t[:, None]) * np.array(size)
    faces = faces.reshape(-1, 3)
    # Every face looks along the falling field.
    middle = points[faces].mean(1)
    normal = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    centre_in = at(np.where(values[cut[:, 0, 0]] > 0, cut[:, 0, 0], cut[:, 0, 1])) * np.array(size)
    flip = ((middle - centre_in) * normal).sum(1) < 0
    faces[flip] = faces[flip][:, ::-1]
    points, faces = points[:, ::-1], faces[:, ::-1]
    return decimated(points, faces, int(len(faces) * (1 - reduction))) if reduction > 0 and len(faces) > MANY_FACES else (points, faces)


def outline(cells: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray]:
    """Closed loops around the cells (x, y, 0) half a step out, holes as loops of their own, as line segments."""
    grid, low = _grid(cells)
    segments = []
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        edge = np.argwhere(grid & ~np.roll(grid, (-dy, -dx), (0, 1)))
        middle = edge * 2 + (dy, dx)
        along = np.array((dx, dy)) if (dy, dx) in ((0, 1), (-1, 0)) else np.array((dx, dy))
        segments.append(np.stack([middle - np.abs(along), middle + np.abs(along)], 1))
    ends = np.concatenate(segments)
    unique, lines = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    points = (unique / 2 + low) * np.array(size)
    return np.column_stack([points[:, ::-1], np.zeros(len(points))]), lines.reshape(-1, 2)


def thin(grid: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of a padded boolean image."""
    image = grid.astype(np.uint8)
    while True:
        changed = False
        for phase in (0, 1):
            p = [np.roll(image, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            around = sum(p)
            turns = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            free = (n * e * s == 0) & (e * s * w == 0) if phase == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = (image == 1) & (around >= 2) & (around <= 6) & (turns == 1) & free
            if gone.any():
                image[gone] = 0
                changed = True
        if not changed:
            return image.astype(bool)


def pixel_graph(cells: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (micrometres) and edges between all cells that touch, at sides and corners, each pair once."""
    if not len(cells):
        return np.zeros((0, 2)), np.zeros((0, 2), int)
    low, wide = cells.min(axis=0), int(np.ptp(cells[:, 1])) + 3
    keys = (cells[:, 0] - low[0]) * wide + cells[:, 1] - low[1] + 1
    order = np.argsort(keys)
    edges = []
    for dy, dx in measure.half_directions(2):
        place = np.minimum(np.searchsorted(keys[order], keys + dy * wide + dx), len(keys) - 1)
        hit = np.flatnonzero(keys[order][place] == keys + dy * wide + dx)
        edges.append(np.column_stack([hit, order[place[hit]]]))
    return cells * np.array(size), np.concatenate(edges)


def _branches(n: int, edges: np.ndarray) -> list[list[int]]:
    """Maximal chains between vertices that don't have two neighbours; a loop without such a vertex is one chain."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges.tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)
    used, out = set(), []

    def follow(a: int, b: int) -> list[int]:
        chain = [a, b]
        used.add((min(a, b), max(a, b)))
        while len(near[chain[-1]]) == 2 and chain[-1] != chain[0]:
            step = next(x for x in near[chain[-1]] if x != chain[-2])
            used.add((min(chain[-1], step), max(chain[-1], step)))
            chain.append(step)
        return chain

    for knots in (True, False):
        for a in range(n):
            if (len(near[a]) != 2) == knots:
                out += [follow(a, b) for b in sorted(near[a]) if (min(a, b), max(a, b)) not in used]
    return out


def _smoothed(points: np.ndarray, window: int = 2, rounds: int = 2) -> np.ndarray:
    """Moving average over ``window`` neighbours to each side; the ends stay."""
    for _ in range(rounds):
        if len(points) > 2:
            points = np.array([points[0], *(points[max(0, k - window) : k + window + 1].mean(axis=0) for k in range(1, len(points) - 1)), points[-1]])
    return points


def skeleton_graph_metrics(vertices: np.ndarray | list, edges: np.ndarray | list) -> tuple[int, float, float | None]:
    """Branches, cable length, and tortuosity: each branch's smoothed length over its chord, weighted by length."""
    points, links = np.array(vertices, float).reshape(len(vertices), -1) if len(vertices) else np.zeros((0, 3)), np.array(edges, int).reshape(-1, 2)
    if len(points) < 2 or not len(links):
        return 0, 0.0, None
    length = lambda p: float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())
    chains = _branches(len(points), links)
    cable = float(np.linalg.norm(points[links[:, 0]] - points[links[:, 1]], axis=1).sum())
    top = weight = 0.0
    for chain in chains:
        line = _smoothed(points[chain])
        arc, chord = length(line), float(np.linalg.norm(line[-1] - line[0]))
        if chord > 0:
            top, weight = top + arc * arc / chord, weight + arc
    return len(chains), cable, top / weight if weight > 0 else None


def curve_skeleton(cells: np.ndarray, size: Size, scale: float = 1.5, const: float = 0.05, piece: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tree skeleton of a 3D instance: paths from the farthest cells to the root, cheap near the centre, each clearing what lies around it.

    The published scheme: a root far from an arbitrary cell, then repeatedly the cell farthest from the root among
    those not yet covered; a path covers all cells within ``scale`` times the local radius plus ``const``. ``piece`` numbers
    the connected pieces, each of which has a root of its own.
    """
    piece = measure.component_labels(cells) if piece is None else piece
    places = cells * np.array(size)
    order = np.argsort(piece, kind="stable")
    parts = np.split(order, groups.starts(piece[order])[1:])
    vertices, edges = {}, []
    for part in sorted(parts, key=lambda p: p[0]):
        for path in _piece_paths(cells[part], size, scale, const):
            path = part[path].tolist()
            for v in path:
                vertices.setdefault(v, len(vertices))
            edges += [(vertices[a], vertices[b]) for a, b in zip(path, path[1:], strict=False)]
    return places[list(vertices)], np.array(edges, int).reshape(-1, 2)


def _piece_paths(cells: np.ndarray, size: Size, scale: float, const: float) -> list[list[int]]:
    """The paths of one connected piece, each from its far end to the root or an earlier path."""
    if len(cells) <= 2:
        return [list(range(len(cells)))]
    steps = [tuple(v - 1 for v in d) for d in np.ndindex(3, 3, 3) if d != (1, 1, 1)]
    steps = [(d, float(np.linalg.norm(np.multiply(d, size)))) for d in steps]
    index = {tuple(c): k for k, c in enumerate(cells.tolist())}
    near = [[(j, width) for (a, b, c), width in steps if (j := index.get((z + a, y + b, x + c))) is not None] for z, y, x in index]
    # What lies nearest outside a piece is next to it, so its own box is enough.
    grid, low = _grid(cells)
    radius = distance_transform(~grid, size)[tuple((cells - low).T)]
    places = cells * np.array(size)

    def spread(start: int, cost: list[float] | None) -> tuple[np.ndarray, list[int]]:
        far, before = [math.inf] * len(cells), [-1] * len(cells)
        far[start] = 0.0
        heap = [(0.0, start)]
        while heap:
            d, k = heapq.heappop(heap)
            if d > far[k]:
                continue
            for j, width in near[k]:
                if (new := d + width * (1 if cost is None else cost[j])) < far[j]:
                    far[j], before[j] = new, k
                    heapq.heappush(heap, (new, j))
        return np.array(far), before

    root = int(np.argmax(spread(0, None)[0]))
    far, _ = spread(root, None)
    penalty = 1 + 100000 / 4 * (1 - radius / max(radius.max(), 1e-12)) ** 4
    _, before = spread(root, penalty.tolist())
    paths, on_path, left = [], set(), np.ones(len(cells), bool)
    while left.any():
        path = [int(np.argmax(np.where(left, far, -1)))]
        while path[-1] != root and path[-1] not in on_path and before[path[-1]] >= 0:
            path.append(before[path[-1]])
        on_path.update(path)
        for v in path:
            left &= np.linalg.norm(places - places[v], axis=1) > scale * radius[v] + const
        left[path] = False
        paths.append(path)
    return paths


def skeleton_payload(vertices: np.ndarray, edges: np.ndarray) -> bytes | None:
    """Payload of a skeleton (array order in, x first out; z is 0 in the plane); nothing below two vertices and one edge."""
    if len(vertices) < 2 or not len(edges):
        return None
    points = np.asarray(vertices)[:, ::-1]
    return encode_payload(np.column_stack([points, *[np.zeros(len(points))] * (3 - points.shape[1])]), np.asarray(edges))


def gathered(rows: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    """``by``, ``n_voxels`` and ``cells``: every group's cells as numbers of 21 bits an axis."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_voxels"), F.collect_list(_packed(axes)).alias("cells"))


def _packed(axes: tuple[str, ...]) -> Column:
    packed = F.lit(0).cast("long")
    for a in axes:
        packed = F.shiftleft(packed, 21).bitwiseOR(F.col(a).cast("long"))
    return packed


def _unpacked(cells: np.ndarray, dims: int) -> np.ndarray:
    cells = np.sort(np.asarray(cells, np.int64))
    return np.stack([cells >> (21 * (dims - 1 - k)) & 0x1FFFFF for k in range(dims)], 1)


@dataclass(frozen=True)
class Many:
    """The cells of many instances, each one's in raster order: of which instance, where, and as one number (a step is a difference of numbers)."""

    n: int
    of: np.ndarray
    at: np.ndarray
    key: np.ndarray
    strides: tuple[int, ...]

    def step(self, d: tuple[int, ...]) -> int:
        return sum(k * s for k, s in zip(d, self.strides, strict=True))

    def has(self, key: np.ndarray) -> np.ndarray:
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key


def _parts(lists: pa.ListArray, dims: int) -> Iterator[tuple[slice, Many]]:
    """The instances of a batch, some thousands of cells at a time; an instance that is null has none."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    packed = lists.flatten().to_numpy()
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PART_CELLS, "right")) - 1)
        of = np.repeat(np.arange(last - first), lengths[first:last])
        cells = packed[ends[first] : ends[last]]
        cells = cells[np.lexsort((cells, of))]
        at = np.stack([cells >> (21 * (dims - 1 - k)) & 0x1FFFFF for k in range(dims)], 1)
        if not len(at):
            yield slice(first, last), Many(last - first, of, at, cells, (1,) * dims)
            first = last
            continue
        begins = groups.starts(of)
        local = at - np.minimum.reduceat(at, begins, axis=0)[groups.within(begins, len(of))] + 1
        spans = (local.max(axis=0) + 2).tolist()
        if math.prod(spans) * (last - first) > 2**62 and last - first > 1:
            # Numbers would not fit: half the instances at a time, at worst each by itself.
            last = first + (last - first) // 2
            half = ends[last] - ends[first]
            of, at, local = of[:half], at[:half], local[:half]
            spans = (local.max(axis=0) + 2).tolist() if half else [1] * dims
        strides = tuple(math.prod(spans[k + 1 :]) for k in range(dims))
        yield slice(first, last), Many(last - first, of, at, of * math.prod(spans) + local @ np.array(strides), strides)
        first = last


def _encoded(n: int, points: np.ndarray, of: np.ndarray, indices: np.ndarray, index_of: np.ndarray) -> list[bytes | None]:
    """The payload of each of ``n`` shapes, whose points and (own) indices follow one another."""
    out: list[bytes | None] = [None] * n
    if not len(points):
        return out
    begins = groups.starts(of)
    group = groups.within(begins, len(of))
    low, high = np.minimum.reduceat(points, begins, axis=0), np.maximum.reduceat(points, begins, axis=0)
    scale = (high - low).astype(np.float32)
    scale[scale == 0] = 1
    low = low.astype(np.float32)
    steps = np.clip((points - low[group]) / scale[group] * 65535 + 0.5, 0, 65535).astype("<u2").tobytes()
    data = indices.astype("<u4").tobytes()
    ends = np.append(begins, len(of)).tolist()
    where = np.searchsorted(index_of, np.arange(n + 1)).tolist()
    for k, i in enumerate(of[begins].tolist()):
        a, b = where[i], where[i + 1]
        if b > a:
            out[i] = HEADER.pack(ends[k + 1] - ends[k], b - a, *low[k], *scale[k]) + steps[6 * ends[k] : 6 * ends[k + 1]] + data[4 * a : 4 * b]
    return out


def _boundary_udf(size: Size):
    """The Crofton boundary, by the same terms as ``measure.boundary``."""

    @F.arrow_udf("double")
    def run(cells: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for _, many in _parts(cells, len(size)):
            total = np.zeros(many.n)
            for *d, term in measure.boundary_terms(size):
                open_ends = ~many.has(many.key + many.step(d)) if len(many.key) else np.zeros(0, bool)
                total += np.bincount(many.of[open_ends], minlength=many.n) * term
            found.append(total)
        return pa.array(np.concatenate(found))

    return run


def _mesh_udf(size: Size, step: int, reduction: float):
    @F.arrow_udf("binary")
    def run(cells: pa.Array, sigma: pa.Array) -> pa.Array:
        return pa.array([encode_payload(*mesh(_unpacked(c.values.to_numpy(), 3), size, sigma=s.as_py(), step=step, reduction=reduction)) for c, s in zip(cells, sigma, strict=True)], pa.binary())

    return run


def outlined(many: Many, size: Size) -> list[bytes | None]:
    """The payload of every instance's ``outline``, all made at once."""
    if not len(many.of):
        return [None] * many.n
    begins = groups.starts(many.of)
    low = np.minimum.reduceat(many.at, begins, axis=0) - 1
    rank = groups.within(begins, len(many.of))
    local = many.at - low[rank]
    wide = 2 * (int(local[:, 1].max()) + 2)
    tall = 2 * (int(local[:, 0].max()) + 2)
    ends, of = [], []
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        edge = np.flatnonzero(~many.has(many.key + many.step((dy, dx))))
        middle, along = local[edge] * 2 + (dy, dx), np.abs((dx, dy))
        both = np.stack([middle - along, middle + along], 1)
        ends.append((rank[edge, None] * tall + both[..., 0]) * wide + both[..., 1])
        of.append(many.of[edge])
    of_edge = np.concatenate(of)
    order = np.argsort(of_edge, kind="stable")
    keys, lines = np.unique(np.concatenate(ends)[order].ravel(), return_inverse=True)
    of_point = keys // (tall * wide)
    points = (np.stack([keys // wide % tall, keys % wide], 1) / 2 + low[of_point]) * np.array(size)
    first = groups.starts(of_point)
    lines = lines.reshape(-1) - first[of_point[lines.reshape(-1)]]
    names = many.of[begins]
    return _encoded(many.n, np.column_stack([points[:, ::-1], np.zeros(len(points))]), names[of_point], lines, np.repeat(of_edge[order], 2))


def _outline_udf(size: Size):
    @F.arrow_udf("binary")
    def run(cells: pa.Array) -> pa.Array:
        return pa.array([p for _, many in _parts(cells, 2) for p in outlined(many, size)], pa.binary())

    return run


def thinned(many: Many) -> np.ndarray:
    """Which cells ``thin`` leaves of every instance. Instances of about one width are laid out below one another on one canvas."""
    stays = np.ones(len(many.of), bool)
    if not len(many.of):
        return stays
    begins = groups.starts(many.of)
    rank = groups.within(begins, len(many.of))
    low, high = np.minimum.reduceat(many.at, begins, axis=0), np.maximum.reduceat(many.at, begins, axis=0)
    tall, wide = (high - low + 1).T
    times = np.diff(np.append(begins, len(many.of)))
    kind = np.where(times > 2, np.ceil(np.log2(wide)).astype(int), -1)
    for k in np.unique(kind[kind >= 0]).tolist():
        chosen = np.flatnonzero(kind == k)
        rows = np.cumsum(tall[chosen] + 1)
        for some in np.split(chosen, np.flatnonzero(np.diff(rows // max(1, CANVAS_CELLS // (2**k + 2)))) + 1):
            top = np.zeros(len(begins), np.int64)
            top[some] = np.cumsum(tall[some] + 1) - tall[some]
            canvas = np.zeros((int((tall[some] + 1).sum()) + 1, 2**k + 2), bool)
            use = np.flatnonzero(np.isin(rank, some)) if len(some) < len(begins) else np.arange(len(rank))
            y, x = top[rank[use]] + many.at[use, 0] - low[rank[use], 0], many.at[use, 1] - low[rank[use], 1] + 1
            canvas[y, x] = True
            stays[use] = thin(canvas)[y, x]
    return stays


def _touching(many: Many, keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of ``pixel_graph`` between the cells ``keys``, as places among all of them, and whose they are."""
    hits, ends = [], []
    for d in measure.half_directions(2):
        place = np.minimum(np.searchsorted(keys, keys + many.step(d)), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == keys + many.step(d))
        hits.append(hit)
        ends.append(place[hit])
    a, b = np.concatenate(hits), np.concatenate(ends)
    order = np.argsort(of[a], kind="stable")
    return np.column_stack([a[order], b[order]]), of[a[order]]


_SKELETON = "skeleton binary, vertices int, branches long, cable_length_um double, tortuosity double"


def _bones(many: Many, size: Size) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices (micrometres) and edges (places among an instance's own vertices) of all skeletons, each with whose they are."""
    times = np.bincount(many.of, minlength=many.n)
    if len(size) == 2:
        stays = thinned(many) & (times >= DUST_CELLS)[many.of]
        of, at = many.of[stays], many.at[stays]
        if not len(of):
            return np.zeros((0, 2)), of, np.zeros((0, 2), int), of
        edges, edge_of = _touching(many, many.key[stays], of)
        first = np.searchsorted(of, edge_of)
        return at * np.array(size), of, edges - first[:, None], edge_of
    use = (times >= DUST_CELLS)[many.of]
    of, at = many.of[use], many.at[use]
    if not len(of):
        return np.zeros((0, 3)), of, np.zeros((0, 2), int), of
    piece = measure.component_labels(at, groups.within(groups.starts(of), len(of)))
    order = np.lexsort((piece, of))
    new = groups.starts(of[order], piece[order])
    sizes = np.diff(np.append(new, len(of)))
    large = np.zeros(many.n, bool)
    large[of[order[new[sizes > 2]]]] = True
    # A piece of one cell is a vertex, and one of two cells an edge; only what has a larger piece is searched for paths.
    simple = ~large[of[order]]
    vertices, vertex_of = [at[order][simple] * np.array(size)], [of[order][simple]]
    pair = new[(sizes == 2) & ~large[of[order[new]]]]
    edge_of = [of[order[pair]]]
    place = pair - np.searchsorted(of[order], of[order[pair]])
    edges = [np.column_stack([place, place + 1])]
    begins = groups.starts(of)
    for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(of)], strict=True):
        if large[of[i]]:
            points, links = curve_skeleton(at[i:j], size, piece=piece[i:j])
            vertices.append(points)
            vertex_of.append(np.full(len(points), of[i]))
            edges.append(links)
            edge_of.append(np.full(len(links), of[i]))
    vertex_of, edge_of = np.concatenate(vertex_of), np.concatenate(edge_of)
    by_vertex, by_edge = np.argsort(vertex_of, kind="stable"), np.argsort(edge_of, kind="stable")
    return np.concatenate(vertices)[by_vertex], vertex_of[by_vertex], np.concatenate(edges)[by_edge], edge_of[by_edge]


def skeletons_of(many: Many, size: Size) -> pa.Array:
    """The skeleton of every instance, its vertices and its metrics; no vertices for dust."""
    points, of, edges, edge_of = _bones(many, size)
    vertices = np.bincount(of, minlength=many.n)
    branches, cable = np.zeros(many.n, np.int64), np.zeros(many.n)
    winding = np.full(many.n, np.nan)
    begins, ends = np.searchsorted(of, np.arange(many.n)), np.searchsorted(edge_of, np.arange(many.n + 1))
    at = begins[edge_of][:, None] + edges
    long = np.linalg.norm(points[at[:, 0]] - points[at[:, 1]], axis=1)
    # Edges that share no vertex are a branch each, and straight.
    shared = np.bincount(at.ravel(), minlength=len(points)) > 1
    knotted = np.zeros(many.n, bool)
    knotted[edge_of[shared[at].any(axis=1)]] = True
    branches += np.diff(ends)
    cable += np.bincount(edge_of, long, many.n)
    winding[branches > 0] = 1.0
    for i in np.flatnonzero(knotted).tolist():
        branches[i], cable[i], t = skeleton_graph_metrics(points[begins[i] : begins[i] + vertices[i]], edges[ends[i] : ends[i + 1]])
        winding[i] = np.nan if t is None else t
    flipped = points[:, ::-1]
    flipped = np.column_stack([flipped, *[np.zeros(len(points))] * (3 - flipped.shape[1])])
    data = pa.array(_encoded(many.n, flipped, of, edges.ravel(), np.repeat(edge_of, 2)), pa.binary())
    columns = [data, pa.array(vertices.astype(np.int32)), pa.array(branches), pa.array(cable), pa.array(winding, mask=np.isnan(winding))]
    return pa.StructArray.from_arrays(columns, [c.split()[0] for c in _SKELETON.split(", ")])


def _skeleton_udf(size: Size):
    """``skeletons_of``, for instances whose cells aren't null."""

    @F.arrow_udf(_SKELETON)
    def run(cells: pa.Array) -> pa.Array:
        return pa.concat_arrays([skeletons_of(many, size) for _, many in _parts(cells, len(size))])

    return run


def entity_filter(text: str | None, none: bool = False) -> frozenset[str] | None:
    """Which entities get skeletons, from names with commas between them: all for nothing, and no entity at all if ``none``."""
    if none:
        return frozenset()
    return None if text is None else frozenset(x for x in (ex.normal_name(part) for part in text.split(",")) if x)


def wants_skeletons(entity: Column, allowed: frozenset[str] | None) -> Column:
    return F.lit(True) if allowed is None else ex.normalize_name(entity).isin(sorted(allowed)) if allowed else F.lit(False)


def skeletons(rows: DataFrame, size: Size, allowed: frozenset[str] | None = None, most: int | None = None, by: tuple[str, ...] = measure.INSTANCE, cells: DataFrame | None = None) -> DataFrame:
    """``by``, ``skeleton, branches, cable_length_um, tortuosity`` of every instance, in the plane or in space by ``size``.

    Not measured, and so null: entities that aren't wanted, those of whose instances in an object none has a skeleton,
    and instances of more than ``most`` cells. Any other instance without a skeleton has no branch and no length.
    """
    cells = gathered(rows, list(by), measure.AXES[len(size)]) if cells is None else cells
    return with_skeletons(cells, size, allowed, most).select(*by, "skeleton", "branches", "cable_length_um", "tortuosity")


def with_skeletons(cells: DataFrame, size: Size, allowed: frozenset[str] | None = None, most: int | None = None) -> DataFrame:
    """Gathered ``cells`` with what ``skeletons`` tells, but without the cells."""
    small = F.lit(True) if most is None else F.col("n_voxels") <= most
    wanted = wants_skeletons(F.col("entity"), allowed) & small
    others = [c for c in cells.columns if c != "cells"]
    found = cells.select(*others, wanted.alias("wanted"), _skeleton_udf(size)(F.when(wanted, F.col("cells"))).alias("s"))
    some = F.max(F.col("s.vertices") > 0).over(Window.partitionBy("object_id", "entity"))
    found = found.withColumn("measured", F.col("wanted") & some)
    known = lambda c: F.when(F.col("measured"), F.col(f"s.{c}")).alias(c)
    return found.select(*others, F.col("s.skeleton").alias("skeleton"), known("branches"), known("cable_length_um"), known("tortuosity"))


def meshes(masks: DataFrame, size: Size) -> DataFrame:
    """``object_id, entity, mesh`` of 3D masks; null where there is too little to mesh."""
    cells = gathered(masks, ["object_id", "entity"], ("z", "y", "x"))
    return cells.select("object_id", "entity", _mesh_udf(size, 1, 0.0)("cells", F.lit(0.0)).alias("mesh"))


def outlines(masks: DataFrame, size: Size) -> DataFrame:
    cells = gathered(masks, ["object_id", "entity"], ("y", "x"))
    return cells.select("object_id", "entity", _outline_udf(size)("cells").alias("outline"))


def planar_skeletons(masks: DataFrame, size: Size, most: int | None = None) -> DataFrame:
    """``branches, cable_length_um, tortuosity`` of 2D masks; null above ``most`` cells."""
    return skeletons(masks, size, most=most, by=("object_id", "entity")).drop("skeleton")


@dataclass(frozen=True)
class Options:
    """How geometry is made: the step and blur of meshes, the share of faces that goes, and which instances get skeletons."""

    step: int = 2
    smoothing: float = 0.7
    reduction: float = 0.8
    skeleton_entities: frozenset[str] | None = None
    most_skeleton_voxels: int | None = None


SIZES = {3: ("volume_um3", "surface_um2", "sphericity"), 2: ("area_um2", "perimeter_um", "circularity")}


def shapes(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    """Extent, centroid, boundary, roundness, aspect ratio and fill of every group."""
    dims = len(size)
    extent, bound, roundness = SIZES[dims]
    round_of = ex.roundness_3d if dims == 3 else ex.roundness_2d
    ratio = measure.aspect_ratio_3d if dims == 3 else measure.aspect_ratio_2d
    found = measure.extent(voxels, by, size, extent).join(measure.boundary(voxels, by, size), list(by), "left")
    found = found.join(ratio(voxels, by, size), list(by), "left").join(measure.fill_ratio(voxels, by, dims).drop("n_voxels", "bbox_cells"), list(by), "left")
    return found.withColumn(roundness, round_of(F.col(extent), F.col(bound)))


def shaped(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    """What ``shapes`` tells of every group, and its gathered cells, from one aggregate."""
    dims = len(size)
    extent, bound, roundness = SIZES[dims]
    axes = measure.AXES[dims]
    centre = [(F.avg(a) * s).alias(f"centroid_{a}_um") for a, s in zip(axes, size, strict=True)]
    packed = F.collect_list(_packed(axes)).alias("cells")
    found = voxels.groupBy(*by).agg(F.count("*").alias("n_voxels"), packed, (F.count("*") * math.prod(size)).alias(extent), *centre, *measure.covariances(size), measure.box_cells(dims))
    found = measure.with_aspect_ratio(found, dims).withColumn("fill_ratio", F.col("n_voxels") / F.col("bbox_cells")).drop("bbox_cells")
    round_of = ex.roundness_3d if dims == 3 else ex.roundness_2d
    return found.withColumn(bound, _boundary_udf(size)("cells")).withColumn(roundness, round_of(F.col(extent), F.col(bound)))


def geometry_rows(labels: DataFrame, masks: DataFrame, size: Size, object_mask: str | None = None, contacts: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """One table of an object's geometry: a row for each instance, for each whole mask (``row_type`` file), and for each contact.

    Instances carry their shape, their direction from the object mask's centre, and their skeleton; instances and masks
    a mesh in space or an outline in the plane. Counts from the payloads' headers are columns, so that a budget can be
    kept without reading geometry. Nothing is made before it is asked for: who reads the rows more than once keeps them.
    """
    options, dims = options or Options(), len(size)
    roundness = SIZES[dims][2]

    def drawn(cells: DataFrame) -> DataFrame:
        if dims == 2:
            return cells.withColumns({"mesh": F.lit(None).cast("binary"), "outline": _outline_udf(size)("cells")})
        sigma = ex.smoothing(F.col(roundness), F.col("fill_ratio"), 0.3, 2 * options.smoothing)
        return cells.withColumns({"mesh": _mesh_udf(size, options.step, options.reduction)("cells", sigma), "outline": F.lit(None).cast("binary")})

    found = with_skeletons(drawn(shaped(labels, measure.INSTANCE, size)), size, options.skeleton_entities, options.most_skeleton_voxels)
    if object_mask is not None:
        centres = measure.extent(masks.where(F.col("entity") == object_mask), ("object_id",), size)
        found = (measure.polarity if dims == 3 else measure.polarity_2d)(found, centres)
    found = found.withColumns({"entity_kind": F.lit("label"), "row_type": F.lit("instance")})
    whole = ("object_id", "entity")
    files = drawn(shaped(masks, whole, size)).drop("cells")
    files = files.withColumns({"entity_kind": F.lit("mask"), "row_type": F.lit("file")})
    rows = found.unionByName(files, allowMissingColumns=True)
    if contacts is not None:
        rows = rows.unionByName(contacts.withColumn("row_type", F.lit("contact")), allowMissingColumns=True)
    counts = {"mesh_vertices": ex.payload_count(F.col("mesh"), 0), "mesh_faces": F.expr("mesh_indices div 3"), "outline_vertices": ex.payload_count(F.col("outline"), 0)}
    rows = rows.withColumns({"mesh_indices": ex.payload_count(F.col("mesh"), 1), "spatial_dims": F.lit(dims)}).withColumns(counts).drop("mesh_indices")
    return rows


def has_geometry() -> Column:
    return F.col("mesh").isNotNull() | F.col("outline").isNotNull()


def geometry_size(rows: DataFrame) -> Column:
    """The extent by which geometry is ordered, whichever the table has."""
    return F.coalesce(*(F.col(c) for c in ("volume_um3", "area_um2") if c in rows.columns))


def summary(rows: DataFrame) -> DataFrame:
    """Rows with geometry and their faces, by entity and kind of row; and, for an entity of null, the widest gap of the contacts."""
    gap = F.col("gap_um") if "gap_um" in rows.columns else F.lit(None).cast("double")
    rows = kept(rows.select("entity", "row_type", "mesh_faces", gap.alias("gap_um"), has_geometry().alias("drawn")))
    drawn = rows.where("drawn").groupBy("entity", "row_type").agg(F.count("*").alias("n"), F.sum("mesh_faces").alias("faces"))
    widest = rows.where("row_type = 'contact'").agg(F.max("gap_um").alias("widest_gap_um"))
    widest = widest.select(F.lit(None).cast("string").alias("entity"), F.lit("contact").alias("row_type"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("faces"), "widest_gap_um")
    return drawn.withColumn("widest_gap_um", F.lit(None).cast("double")).unionByName(widest)


def carry(rows: DataFrame, report: DataFrame, metrics: list[str], by: tuple[str, ...] = measure.INSTANCE) -> DataFrame:
    """Geometry rows with what a report says of the same instance; where both have a value, the report's is taken."""
    told = report.select(*(F.col(c).alias(f"of_{c}") for c in by), *(F.col(m).alias(f"told_{m}") for m in metrics))
    joined = rows.join(told, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], "left")
    mine = {m: F.coalesce(f"told_{m}", m) if m in rows.columns else F.col(f"told_{m}") for m in metrics}
    return joined.withColumns(mine).drop(*told.columns)


def merged_meshes(rows: DataFrame, by: tuple[str, ...] = ("object_id", "entity")) -> DataFrame:
    """``by``, ``parts`` and one ``mesh`` of all meshes of a group, vertices one after the other."""

    @F.pandas_udf("binary")
    def run(payloads: pd.Series) -> pd.Series:
        return pd.Series([encode_payload(*merge([decode_payload(p) for p in some])) for some in payloads], dtype=object)

    parts = rows.where("mesh is not null").groupBy(*by).agg(F.count("*").alias("parts"), F.sort_array(F.collect_list("mesh")).alias("meshes"))
    return parts.select(*by, "parts", run("meshes").alias("mesh"))


def importable(rows: DataFrame, objects: Iterable[str] | None = None, entities: Iterable[str] | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """Meshes that a scene takes: of the named objects and entities, or all, but for excluded entities; by object, entity and kind of row."""
    chosen = rows
    for column, names in (("object_id", objects), ("entity", entities)):
        if names is not None:
            chosen = chosen.where(F.col(column).cast("string").isin([str(n) for n in names]))
    # Kept before it is asked which rows have a mesh, as meshes would else be made for the question, too.
    return kept(chosen.where(~F.col("entity").isin(list(excluded)))).where("mesh is not null")


def locations(objects: DataFrame, base: str | None = None) -> DataFrame:
    """Where every object's geometry is: what its row says, or below ``base`` if that is given."""
    known = objects.where("mesh_geometry_file is not null and object_id is not null")
    told = F.col("mesh_geometry_file") if not base else F.concat(F.lit(base.rstrip("/") + "/"), F.col("object_id").cast("string"), F.lit("/geometry.parquet"))
    return known.select("object_id", *[c for c in known.columns if c == "grp"], told.alias("path"))


def palette(rows: DataFrame, chosen: DataFrame, colours: tuple[str, ...]) -> DataFrame:
    """``entity`` and ``colour`` of all entities with geometry: the one chosen for it, else that of its place in the order of names."""
    names = kept(rows.select("entity", has_geometry().alias("drawn")).distinct()).where("drawn").select("entity")
    # One row for each structure: a short order.
    place = F.pmod(F.row_number().over(Window.orderBy("entity")) - 1, F.lit(len(colours)))
    own = chosen.where("entity_colour is not null").select(F.col("entity").alias("of"), "entity_colour").distinct()
    turn = F.get(F.array(*map(F.lit, colours)), place)
    return names.select("entity", turn.alias("turn")).join(own, F.col("entity") == F.col("of"), "left").select("entity", F.coalesce("entity_colour", "turn").alias("colour"))


def payload_steps(points: DataFrame) -> DataFrame:
    """``entity``, the counts of the header, and the sum of each axis's quantised steps, from every entity's points as a payload."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        data = encode_payload(group[["x", "y", "z"]].to_numpy(), np.zeros((1, 3), int))
        n, m = np.frombuffer(data, "<u4", 2).tolist()
        steps = np.frombuffer(data, "<u2", n * 3, 32).reshape(n, 3).astype(np.int64).sum(axis=0)
        return pd.DataFrame([(group["entity"].iloc[0], n, m, *steps.tolist())], columns=["entity", "n", "indices", "x_steps", "y_steps", "z_steps"])

    return points.groupBy("entity").applyInPandas(run, f"entity {points.schema['entity'].dataType.simpleString()}, n long, indices long, x_steps long, y_steps long, z_steps long")


def spread_preview(rows: DataFrame, row_type: str, per_entity: int, budget: int, limit: int) -> DataFrame:
    """The largest geometries of one kind of row below a vertex budget, some of every entity, largest first."""
    size, vertices = geometry_size(rows), F.coalesce("mesh_vertices", "outline_vertices", F.lit(0))
    tie = ["entity", "label", "object_id"]
    place = F.row_number().over(Window.partitionBy("entity").orderBy(size.desc_nulls_last(), *tie))
    some = rows.where((F.col("row_type") == row_type) & has_geometry() & (vertices < budget)).withColumn("place", place)
    return some.where(F.col("place") <= per_entity).orderBy(size.desc_nulls_last(), *tie).limit(limit).drop("place")
