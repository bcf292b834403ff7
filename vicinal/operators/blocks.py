"""Task-side arithmetic of the kNN join: best ``k`` index rows for each query row of one block pair."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# One tile of scores, small enough to stay in a core's cache, and the largest slice scored exactly.
QUERY_TILE, INDEX_TILE = 256, 4096
EXACT_CELLS = 4_000_000
# Rows of up to so many columns are compared box by box, in boxes of so many rows; rows are prepared so many at a time.
BOX_DIM, BOX_ROWS = 8, 256
SLAB_ROWS = 16_384
# Wider rows are multiplied in tiles of so many queries and index rows. From so many tiles on, rows of a tile are close to each other
# along the leading directions of a sample.
TILE_QUERIES, TILE_ROWS, SORTED_TILES = 1024, 512, 8
LEADING, SAMPLE_ROWS = 4, 4096


def as_matrix(column: pa.Array | pa.ChunkedArray, what: str) -> np.ndarray:
    """Arrow list column to a dense float32 matrix; ragged or null vectors are an error."""
    values = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if values.null_count:
        raise ValueError(f"null vector in {what}")
    lengths = np.unique(np.diff(values.offsets.to_numpy()))
    if len(lengths) != 1:
        raise ValueError(f"vectors of different length in {what}: {lengths.tolist()[:10]}")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    matrix = flat.reshape(len(values), int(lengths[0]))
    if not np.isfinite(matrix).all():
        raise ValueError(f"null, NaN or infinite value in {what}")
    return matrix


def norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(matrix.astype(np.float64)).sum(axis=1))


def surplus_copies(ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Positions left after keeping, of equal vectors, the ``k`` with the smallest ids.

    Equal vectors score equally, and ties go to the smaller id, so no other copy can be among the
    ``k`` best of any query. The result is unchanged, however many copies a block holds.
    """
    words = np.ascontiguousarray(matrix).view(np.uint32)
    factors = np.random.default_rng(0).integers(1, 2**63, words.shape[1], dtype=np.uint64)
    digest = np.zeros(len(words), dtype=np.uint64)
    for column, factor in zip(words.T, factors):
        digest += column * factor
    _, group, sizes = np.unique(digest, return_inverse=True, return_counts=True)
    many = np.flatnonzero(sizes[group] > k)
    if not len(many):
        return np.arange(len(ids))
    # equal digests are only a hint: among those rows compare the vectors themselves
    many = many[np.argsort(ids[many], kind="stable")]
    rows = np.ascontiguousarray(matrix[many])
    keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, same, copies = np.unique(keys, return_inverse=True, return_counts=True)
    grouped = np.argsort(same, kind="stable")
    starts = np.repeat(np.cumsum(copies) - copies, copies)
    nth = np.empty(len(many), dtype=np.int64)
    nth[grouped] = np.arange(len(many)) - starts
    keep = np.ones(len(ids), dtype=bool)
    keep[many[nth >= k]] = False
    return np.flatnonzero(keep)


@dataclass(frozen=True)
class Space:
    """Where the rows of an index block are compared: as points whose distances bound the scores, and as single-precision rows of
    length at most one, whose products order the index rows of every query as the metric does.

    Inner products keep their order when a query is scaled and when the index is scaled as a whole. For
    L2 the order is that of q.x - |x|^2 / 2: one more column, after moving the index to its mean.
    """

    metric: str
    centre: np.ndarray
    radius: float

    @property
    def largest(self) -> float:
        """Length of the longest index row before it is scaled."""
        return self.radius * (1.25**0.5 if self.metric == "l2" else 1.0)

    def points(self, rows: np.ndarray) -> np.ndarray:
        return rows - self.centre if self.metric == "l2" else in_space(rows, self.metric)

    def queries(self, points: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            points = np.column_stack([points, np.full(len(points), self.radius)])
        length = norms(points)
        return (points / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)

    def index(self, points: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            points = np.column_stack([points, -np.square(points).sum(axis=1) / (2 * self.radius)])
        return (points if self.metric == "cosine" else points / self.largest).astype(np.float32)

    def product_bounds(self, points: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """The products that points can reach with rows whose squared distances are at least ``squares``, one column per point."""
        if self.metric == "cosine":
            return 1.0 - squares / 2
        length = np.square(points).sum(axis=1)
        return (length - squares) / (2 * self.largest * np.sqrt(length + self.radius**2))


def _slabs(rows: int) -> list[slice]:
    return [slice(at, at + SLAB_ROWS) for at in range(0, rows, SLAB_ROWS)]


def space_of(x: np.ndarray, metric: str) -> Space:
    centre = x.mean(axis=0, dtype=np.float64) if metric == "l2" else np.zeros(x.shape[1])
    if metric == "cosine":
        return Space(metric, centre, 1.0)
    return Space(metric, centre, max(float(norms(x[slab] - centre).max()) for slab in _slabs(len(x))) or 1.0)


def _leading(points: np.ndarray) -> np.ndarray:
    """Orthonormal directions in which the points differ most, roughly. Any would do: they only decide how much is left out."""
    points = points - points.mean(axis=0)
    found = np.random.default_rng(0).normal(size=(points.shape[1], min(LEADING, points.shape[1])))
    for _ in range(8):
        found = np.linalg.qr(points.T @ (points @ np.linalg.qr(found)[0]))[0]
    return found


def _places(points: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Points by their coordinates along ``axes`` and the length of the rest: no two are farther apart there than they are."""
    along = points @ axes
    rest = np.square(points).sum(axis=1) - np.square(along).sum(axis=1)
    return np.column_stack([along, np.sqrt(np.maximum(rest, 0.0))])


def _all_places(space: Space, rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.concatenate([_places(space.points(rows[slab]), axes) for slab in _slabs(len(rows))])


@dataclass(frozen=True)
class Tiles:
    """The rows of an index block in tiles; a tile ends where the next begins. ``axes`` are None if rows lie in no order."""

    space: Space
    axes: np.ndarray | None
    rows: np.ndarray
    begins: np.ndarray
    low: np.ndarray | None
    high: np.ndarray | None
    reach: np.ndarray | None  # length of the longest point
    products: np.ndarray
    error: tuple[np.ndarray, np.ndarray]
    error_most: tuple[np.ndarray, np.ndarray]

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """The largest product each point could reach in each tile, with room for rounding: tiles x points."""
        if self.axes is None:
            return np.full((len(self.begins) - 1, len(points)), np.inf)
        squares = np.zeros((len(self.reach), len(points)))
        for at, low, high in zip(_places(points, self.axes).T, self.low.T, self.high.T):
            gap = np.maximum(low[:, None] - at, at - high[:, None])
            squares += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
        squares -= 1e-6 * np.square(norms(points) + self.reach[:, None])
        return self.space.product_bounds(points, squares) + 1e-9


def tiles_of(x: np.ndarray, metric: str, queries: int) -> Tiles:
    """Tiles for so many queries. Few queries, a short index and inner products are not worth an order."""
    space, axes, low, high, reach = space_of(x, metric), None, None, None, None
    if metric != "ip" and min(queries // TILE_QUERIES, len(x) // TILE_ROWS // SORTED_TILES):
        axes = _leading(space.points(x[:: -(-len(x) // SAMPLE_ROWS)]))
        places = _all_places(space, x, axes)
        order, begins = boxes(places, TILE_ROWS)
        places = places[order]
        low, high = (f.reduceat(places, begins[:-1], axis=0) for f in (np.minimum, np.maximum))
        reach = np.maximum.reduceat(np.sqrt(np.square(places).sum(axis=1)), begins[:-1])
    else:
        order, height = np.arange(len(x)), min(max(queries, 1), TILE_QUERIES)
        begins = np.append(np.arange(0, len(x), TILE_QUERIES * TILE_ROWS // height), len(x))
    products = np.concatenate([space.index(space.points(x[order[slab]])) for slab in _slabs(len(x))])
    error = _error_by_row(products, metric)
    return Tiles(space, axes, order, begins, low, high, reach, products, error, tuple(np.maximum.reduceat(e, begins[:-1]) for e in error))


def _room(dim: int) -> float:
    """Bound of the rounding error of a product of two rows of length one."""
    return (dim + 16) * 2.0**-23


def _error_by_query(a: np.ndarray, metric: str) -> np.ndarray:
    """u of ``_error_by_row``."""
    return (norms(a[:, :-1] if metric == "l2" else a) * _room(a.shape[1])).astype(np.float32)


def _error_by_row(b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(v, w): the rounding error of product (i, j) is at most u_i * v_j + w_j.

    The bound follows the length of each row, so one long row does not widen it for the others. The last column of L2
    is counted apart, because it is 1 for every query and tiny for most index rows.
    """
    short = b[:, :-1] if metric == "l2" else b
    v = np.concatenate([norms(short[slab]) for slab in _slabs(len(b))])
    w = np.abs(b[:, -1]) * _room(b.shape[1]) if metric == "l2" else np.zeros(len(b))
    return v.astype(np.float32), w.astype(np.float32)


def _raise_top(top: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Put values of rows into ``top``, the k largest of every row."""
    k = top.shape[1]
    order = np.lexsort((-values, rows))
    rows, values = rows[order], values[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    changed, place = np.unique(rows, return_inverse=True)
    more = np.full((len(changed), k), -np.inf, dtype=top.dtype)
    more[place[nth < k], nth[nth < k]] = values[nth < k]
    top[changed] = np.partition(np.concatenate([top[changed], more], axis=1), k, axis=1)[:, k:]


def _candidates(points: np.ndarray, tiles: Tiles, k: int, buffers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the order of tiles) of every product that could be among the k largest of its row, given its rounding error.

    Tiles pass by, the most promising first. A row remembers the k largest values that are certainly reached so far; it leaves
    out tiles that cannot reach them, and others only yield what may reach them. Most products are met by one comparison
    with a threshold that is low enough for the whole tile.
    """
    a = tiles.space.queries(points)
    u = _error_by_query(a, tiles.space.metric)
    bounds = tiles.bounds(points)
    best = bounds.max(axis=1)
    top = np.full((len(a), k), -np.inf, dtype=np.float32)
    least = np.full(len(a), -np.inf, dtype=np.float32)
    rows, cols, values = [], [], []
    for tile in np.argsort(-best, kind="stable"):
        if best[tile] < least.min():
            break
        near = np.flatnonzero(bounds[tile] >= least)
        if not len(near):
            continue
        begin, end = tiles.begins[tile], tiles.begins[tile + 1]
        v, w = (e[begin:end] for e in tiles.error)
        shape = (len(near), end - begin)
        s, over = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in buffers)
        np.matmul(a if len(near) == len(a) else a[near], tiles.products[begin:end].T, out=s)
        if least[near].min() == -np.inf:
            error = np.multiply.outer(u[near], v) + w
            merged = np.concatenate([top[near], s - error], axis=1)
            top[near] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            least[near] = top[near].min(axis=1)
            error += s
            r, c = np.nonzero(error >= least[near][:, None])
            high, r = error[r, c], near[r]
        else:
            v_most, w_most = (e[tile] for e in tiles.error_most)
            np.greater_equal(s, (least[near] - u[near] * v_most - w_most)[:, None], out=over)
            hit = np.flatnonzero(over)
            if not len(hit):
                continue
            r, c = np.divmod(hit, shape[1])
            value, r = s.ravel()[hit], near[r]
            error = u[r] * v[c] + w[c]
            high = value + error
            may = np.flatnonzero(high >= least[r])
            r, c, high, sure = r[may], c[may], high[may], (value - error)[may]
            up = np.flatnonzero(sure > least[r])
            if len(up):
                _raise_top(top, r[up], sure[up])
                least[r[up]] = top[r[up]].min(axis=1)
        rows.append(r)
        cols.append(c + begin)
        values.append(high)
    row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    last = value >= least[row]
    return row[last], col[last]


def boxes(points: np.ndarray, most: int = BOX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): rows in boxes of at most ``most``, by halving along the widest column; a box ends where the next begins."""
    order, begins, open_ = np.arange(len(points)), [], [(0, len(points))]
    while open_:
        low, high = open_.pop()
        if high - low <= most:
            begins.append(low)
            continue
        part = points[order[low:high]]
        column = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(column, middle)]
        open_ += [(low + middle, high), (low, low + middle)]  # the left half comes next, so boxes begin in order
    return order, np.array([*begins, len(points)])


def nearest_in_boxes(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_in_block`` for L2 and few columns: a query meets the boxes of index rows by their distance from the box of
    its own neighbours, until a box is farther away than the k-th row it has. All in double precision; what could be among the
    k best within rounding is scored by ``exact_scores``.
    """
    kept = surplus_copies(ids, x, k) if len(ids) > k else np.arange(len(ids))
    k = min(k, len(kept))
    order, at = boxes(x[kept])
    kept = kept[order]
    points, asked = x[kept].astype(np.float64), q.astype(np.float64)
    low, high = (f.reduceat(points, at[:-1], axis=0) for f in (np.minimum, np.maximum))
    q_order, q_at = boxes(asked)
    out = []
    for begin, end in zip(q_at, q_at[1:]):
        own = q_order[begin:end]
        here = asked[own]
        gap = np.maximum(np.maximum(low - here.max(axis=0), here.min(axis=0) - high), 0.0)
        away = np.square(gap).sum(axis=1) * (1 - 1e-9)
        near = np.argsort(away, kind="stable")
        top = np.full((len(own), k), np.inf)
        active, rows, cols, values, done, step = np.arange(len(own)), [], [], [], 0, 2
        while done < len(near):
            active = active[top[active, -1] >= away[near[done]]]
            if not len(active):
                break
            block = np.concatenate([np.arange(at[b], at[b + 1]) for b in near[done : done + step]])
            square = np.zeros((len(active), len(block)))
            for column in range(x.shape[1]):
                d = np.subtract.outer(here[active, column], points[block, column])
                square += np.multiply(d, d, out=d)
            merged = np.concatenate([top[active], square], axis=1)
            merged = np.partition(merged, k - 1, axis=1)[:, :k] if merged.shape[1] > k else merged
            top[active] = np.sort(merged, axis=1)
            r, c = np.nonzero(square <= top[active, -1][:, None] * (1 + 1e-9))
            rows.append(active[r])
            cols.append(block[c])
            values.append(square[r, c])
            done, step = done + step, min(2 * step, INDEX_TILE // BOX_ROWS)
        row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        last = value <= top[row, -1] * (1 + 1e-9)
        out.append(_ranked(own[row[last]], kept[col[last]], q, x, ids, k, "l2"))
    rows, cols, scores = (np.concatenate(part) for part in zip(*out))
    return rows, cols, scores


def _ranked(rows: np.ndarray, cols: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates scored in double precision: the k best of each row."""
    step = max(1, EXACT_CELLS // q.shape[1])
    scores = np.concatenate([exact_scores(metric, q[rows[i : i + step]], x[cols[i : i + step]]) for i in range(0, max(1, len(rows)), step)])
    order = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], scores[keep]


def exact_scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of matched rows in double precision. The order of additions depends on the width only, so
    equal vectors get equal scores in every block."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    if metric == "l2":
        return -np.square(a - b).sum(axis=1)
    inner = (a * b).sum(axis=1)
    if metric == "ip":
        return inner
    scale = norms(a) * norms(b)
    return np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0)


def best_in_block(
    q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, score), score descending then id ascending, at most k per query row.

    Single-precision products choose candidates. Their rounding error is bounded by the width, and every
    row that could be among the k best given that bound is scored again in double precision. Both sides are cut into
    tiles of rows that are close to each other, and a query leaves out the tiles that are too far away.
    """
    if metric == "l2" and q.shape[1] <= BOX_DIM:
        return in_query_order(*nearest_in_boxes(q, x, ids, k))
    kept = surplus_copies(ids, x, k) if len(ids) > k else np.arange(len(ids))
    tiles = tiles_of(x[kept], metric, len(q))
    kept = kept[tiles.rows]
    k = min(k, len(kept))
    space, out = tiles.space, []
    q_order, q_at = np.arange(len(q)), np.append(np.arange(0, len(q), TILE_QUERIES), len(q))
    if tiles.axes is not None:
        q_order, q_at = boxes(_all_places(space, q, tiles.axes), TILE_QUERIES)
    buffers = tuple(np.empty(np.diff(q_at).max() * np.diff(tiles.begins).max(), dtype=t) for t in (np.float32, np.bool_))
    for begin, end in zip(q_at, q_at[1:]):
        own = q_order[begin:end]
        rows, cols = _candidates(space.points(q[own]), tiles, k, buffers)
        out.append(_ranked(own[rows], kept[cols], q, x, ids, k, metric))
    return in_query_order(*(np.concatenate(part) for part in zip(*out)))


def in_query_order(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], scores[order]


def in_space(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Rows as points whose distances bound the scores: unit vectors for cosine, else as they are."""
    points = matrix.astype(np.float64)
    if metric != "cosine":
        return points
    length = norms(matrix)
    return points / np.where(length > 0, length, 1.0)[:, None]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.square(points).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * (points @ pivots.T), 0.0))


def nearest_cells(points: np.ndarray, pivots: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Per point the closest cells that together hold at least ``k`` index rows."""
    order = np.argsort(distances(points, pivots), axis=1, kind="stable")
    enough = np.cumsum(counts[order], axis=1) >= k
    need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
    return [row[:n][counts[row[:n]] > 0] for row, n in zip(order, need)]


def reachable_cells(
    points: np.ndarray,
    pivots: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    kth: np.ndarray,
    metric: str,
) -> np.ndarray:
    """Mask of (point, cell): False only if no row of the cell can score as well as ``kth``.

    ``low`` and ``high`` are the smallest and largest distance of a cell's rows to its pivot, hence by
    the triangle inequality no row is closer to the point than ``nearest``. All comparisons leave room
    for rounding; an infinite ``kth`` keeps every cell.
    """
    d = distances(points, pivots)
    size = np.sqrt(np.square(points).sum(axis=1))[:, None] + np.sqrt(np.square(pivots).sum(axis=1))[None, :]
    room = 1e-6 * (size + high[None, :])
    nearest = np.maximum(np.maximum(d - high[None, :], low[None, :] - d) - room, 0.0)
    if metric == "l2":
        return nearest <= np.sqrt(np.maximum(-kth, 0.0))[:, None] * (1 + 1e-9)
    if metric == "cosine":
        return 1.0 - np.square(nearest) / 2 >= kth[:, None] - 1e-9
    length = np.sqrt(np.square(points).sum(axis=1))[:, None]
    best = points @ pivots.T + length * (high[None, :] + room)
    return best + 1e-9 * (1 + np.abs(best)) >= kth[:, None]
