"""Exact top-k by inner product: M-trees searched best first.

The inner product becomes a metric by one more component: with M the largest
norm of a tree's vectors, sqrt(M^2 - |v|^2) is added to each vector and nothing
to the query, so a larger product is a smaller distance and the triangle
inequality holds. Rows are dealt to cells by their nearest pivot and a cell of
over ``SHARD_ROWS`` rows to parts by hash; each part gets a tree of pages,
written as a table. An entry of a page has a routing vector, the radius that
covers all below it, and its distance to the page's own routing vector. A
search takes the page of least possible distance next. The stored distances
rule out entries before their own distance is worked out, and covering radii
rule out pages, once k rows are known that are better than anything in them.

A query is searched in its own part first. Its k-th score there rules out whole
cells by their pivots' products and radii; in all others it is searched again
with that score to begin with. Queries are dealt to lots, so that a task has one
part and at most some ``QUERY_ROWS`` queries.

The pivots come from at most ``SAMPLE_ROWS`` rows, those of smallest hash, and
there are at most ``PIVOTS`` for each length of vectors; they only steer the
speed, and every row is indexed. Of rows with equal vectors only the k + 1 of
smallest id can be among any query's k best, so only these go into a tree.

Cases: null vectors and those with null or non-finite components take no part;
vectors of different lengths have no product and don't meet; rows that repeat
id and vector count once; a query meets no row of its own id; null ids come
last among equal scores and are no queries; an empty table gives an empty
result; components and scores are 64-bit integers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import maybe_broadcast, spool, tune

PIVOTS = 256
SAMPLE_ROWS = 4_096
SHARD_ROWS = 4_096
QUERY_ROWS = 2_048
#: Entries of a page of vectors, and of one of routing vectors.
PAGE = 256
FANOUT = 64
#: Cells whose radii may go to the driver; there are more only if vectors have thousands of lengths.
CELLS = 100_000
#: Part of the norms by which a bound may be off, since distances are doubles.
SLACK = 1e-6

CELL = ["dims", "cell"]
PART = [*CELL, "part"]


def quantised(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows that take part: vec_id and ``v``, the floor of ``scale`` times each component."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), dims)


# --- pivots and cells


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres: the farthest from those before, then moved to the mean of what is nearest."""
    at, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < n and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    centres = sample[at].copy()
    for _ in range(5):
        own = _nearest(sample, centres)[0]
        for k in range(len(centres)):
            if (mine := own == k).any():
                centres[k] = sample[mine].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
    own = squares.argmin(axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their cell and distance to its pivot; lengths without pivots are one cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
            for d in np.unique(dims):
                if d in pivots:
                    mine = np.flatnonzero(dims == d)
                    cell[mine], far[mine] = _nearest(_matrix(batch["v"].take(pa.array(mine)), d).astype(float), pivots[d])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["dims"], pa.array(cell), pa.array(far)], ["vec_id", "v", "dims", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, dims int, cell int, far double")


# --- trees


def _lengthened(v: np.ndarray, bound: float) -> np.ndarray:
    x = v.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(0, bound - (x**2).sum(axis=1)))[:, None]], axis=1)


def build_pages(ids: list, v: np.ndarray) -> Iterator[dict]:
    """Pages of the tree of the rows of ``v``; page 0 is the root."""
    bound = float((v.astype(float) ** 2).sum(axis=1).max())
    x = _lengthened(v, bound)
    middle = lambda rows: int(rows[((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1).argmin()])
    apart = lambda rows, o: np.sqrt(((x[rows] - x[o]) ** 2).sum(axis=1))
    every = np.arange(len(v))
    todo, pages = [(0, every, middle(every))], 1
    while todo:
        page, rows, o = todo.pop()
        if len(rows) <= PAGE:
            yield {"page": page, "bound": bound, "own": v[o].tolist(), "below": None, "ids": [ids[i] for i in rows], "vectors": v[rows].ravel().tolist(), "radius": None, "up": apart(rows, o).tolist()}
            continue
        seeds, far = [int(apart(rows, o).argmax())], None
        wide = min(FANOUT, -(-2 * len(rows) // PAGE))
        while len(seeds) < wide:
            last = apart(rows, rows[seeds[-1]])
            far = last if far is None else np.minimum(far, last)
            seeds.append(int(far.argmax()))
        own = _nearest(x[rows], x[rows[seeds]])[0]
        groups = [g for k in range(wide) if len(g := rows[own == k])]
        if len(groups) < 2:  # nearly equal vectors
            groups = np.array_split(rows, wide)
        routes = [middle(g) for g in groups]
        below = list(range(pages, pages + len(groups)))
        pages += len(groups)
        yield {
            "page": page, "bound": bound, "own": v[o].tolist(), "below": below, "ids": None, "vectors": v[routes].ravel().tolist(),
            "radius": [float(apart(g, r).max()) for g, r in zip(groups, routes)], "up": apart(np.array(routes), o).tolist(),
        }
        todo += zip(below, groups, routes)


PAGES = "page int, bound double, own array<long>, below array<int>, ids array<long>, vectors array<long>, radius array<double>, up array<double>"
PAGE_FIELDS = pa.schema([("page", pa.int32()), ("bound", pa.float64()), ("own", pa.list_(pa.int64())), ("below", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64())), ("up", pa.list_(pa.float64()))])


def _build(key: tuple, t: pa.Table) -> pa.Table:
    pages = pa.Table.from_pylist(list(build_pages(t["vec_id"].to_pylist(), _matrix(t["v"], key[0].as_py()))), PAGE_FIELDS)
    for name, value in reversed(list(zip(PART, key))):
        pages = pages.add_column(0, pa.field(name, pa.int32()), pa.array([value.as_py()] * pages.num_rows, pa.int32()))
    return pages


class Tree:
    """The pages of one part, and the search in them. ``computed`` counts the distances and products worked out."""

    def __init__(self, pages: pa.Table, dims: int):
        pages = pages.combine_chunks()
        self.computed, self.most, self.pages = 0, 0.0, [None] * pages.num_rows
        self.bound = pages["bound"][0].as_py() if pages.num_rows else 0.0
        at = pages["page"].to_pylist()
        take = lambda name, i: pages[name][i].values.to_numpy(zero_copy_only=False)
        for i, page in enumerate(at):
            up = take("up", i)
            v = take("vectors", i).reshape(len(up), dims)
            self.most = max(self.most, float(np.abs(v.astype(float)).max(initial=0)))
            if page == 0:
                self.root = _lengthened(take("own", i).reshape(1, dims), self.bound)
            if pages["below"][i].is_valid:
                self.pages[page] = (_lengthened(v, self.bound), up, take("below", i), take("radius", i))
            else:
                ids = pages["ids"][i].values
                self.pages[page] = (v, up, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, id is null) of the ``k`` best rows of each query: best first, ties by id, none of its own id, none below its ``least`` (NaN: no bound).

        Each query goes its own way, to its page of least possible distance next;
        queries that are at the same page are worked out together.
        """
        n, x = len(q), q.astype(float)
        norms = (x**2).sum(axis=1)
        slack = SLACK * (np.sqrt(norms) + self.bound**0.5) + 1e-9
        # no score is as low as this; a bound given by a score is one of a distance
        floor = -np.sqrt(norms) * self.bound**0.5 - 1
        known = np.where(np.isnan(least), floor, least)
        reach = lambda rows: np.sqrt(np.maximum(0, norms[rows] + self.bound - 2 * known[rows])) + slack[rows]
        within = reach(np.arange(n)) * (1 + SLACK)
        exact = self.most * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52
        score, ids, none = np.full((n, k), LOWEST), np.zeros((n, k), np.int64), np.ones((n, k), bool)
        away = np.zeros((n, len(self.pages)))
        away[:, 0] = np.sqrt(((x - self.root[:, :-1]) ** 2).sum(axis=1) + self.root[0, -1] ** 2)
        nearest = np.full((n, len(self.pages)), np.inf)
        nearest[:, 0] = 0
        self.computed += n
        while True:
            page = nearest.argmin(axis=1)
            live = np.flatnonzero(nearest[np.arange(n), page] <= within)
            if not len(live):
                break
            nearest[live, page[live]] = np.inf
            for p in np.unique(page[live]):
                rows = live[page[live] == p]
                v, up, a, b = self.pages[p]
                gap = np.abs(away[rows, p][:, None] - up)
                if v.shape[1] > q.shape[1]:  # routing vectors; a: the pages below, b: their radii
                    near = gap - b <= within[rows][:, None]
                    use = np.flatnonzero(near.any(axis=0))
                    near, w = near[:, use], v[use]
                    self.computed += int(near.sum())
                    d = np.sqrt(np.maximum(0, norms[rows][:, None] + (w**2).sum(axis=1) - 2 * x[rows] @ w[:, :-1].T))
                    away[rows[:, None], a[use]] = d
                    nearest[rows[:, None], a[use]] = np.where(near, np.maximum(0, d - b[use] - slack[rows][:, None]), np.inf)
                    continue
                near = gap <= within[rows][:, None]
                use = np.flatnonzero(near.any(axis=0))
                near, w = near[:, use], v[use]
                self.computed += int(near.sum())
                s = (x[rows] @ w.astype(float).T).astype(np.int64) if exact else q[rows] @ w.T
                good = near & (s >= known[rows][:, None]) & ((a[use] != own[rows][:, None]) | b[use])
                at, column = np.nonzero(good)
                if not len(at):
                    continue
                some = np.unique(at)
                mine = rows[some]
                # what these queries hold and what the page adds, in one list by query and rank
                row = np.concatenate([np.repeat(mine, k), rows[at]])
                every = np.concatenate([score[mine].ravel(), s[at, column]])
                names = np.concatenate([ids[mine].ravel(), a[use][column]])
                nulls = np.concatenate([none[mine].ravel(), b[use][column]])
                order = np.lexsort((names, nulls, -every, row))
                first = np.searchsorted(row[order], mine)
                best = order[first[:, None] + np.arange(k)]
                score[mine], ids[mine], none[mine] = every[best], names[best], nulls[best]
                full = mine[score[mine, -1] > LOWEST]
                known[full] = np.maximum(known[full], score[full, -1])
                within[full] = reach(full)
        query, rank = np.nonzero(score > LOWEST)
        return query, score[query, rank], ids[query, rank], none[query, rank]


#: Stands for no row; it is below all scores.
LOWEST = -(2**63) + 1


def _search(k: int):
    def run(key: tuple, queries: pa.Table, pages: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)] * 2 + [pa.array([], pa.int64())] + [np.empty(0, np.int64)]
        if queries.num_rows and pages.num_rows:
            dims = key[0].as_py()
            name, own = queries["query"].to_numpy(), queries["query_id"].to_numpy()
            least = queries["least"].cast(pa.float64()).to_numpy()
            query, score, ids, none = Tree(pages, dims).search(_matrix(queries["v"], dims), own, k, least)
            found = [name[query], own[query], pa.array(ids, pa.int64(), mask=none), score]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "query_id", "vec_id", "score"), found)})

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """The ``k`` highest integer products of each query with all rows: query_id, rank, vec_id, score.

    Both tables have ``vec_id`` and ``vector``; components become the floor of ``scale`` times them.
    """
    spark = df.sparkSession
    tune(spark)
    sized = lambda rows: quantised(rows, vector, scale).distinct().withColumn("dims", F.size("v"))
    rows, _ = spool(sized(df))
    n = rows.count()
    pivots: dict[int, np.ndarray] = {}
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE_ROWS).select("v").collect() if n else []
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    for d, some in by_length.items():
        pivots[d] = _pivots(np.array(some, float).reshape(len(some), d), min(PIVOTS, max(1, -(-n // SHARD_ROWS))))

    best = Window.partitionBy("dims", "v").orderBy(F.col("vec_id").asc_nulls_last())
    cells, _ = spool(_dealt(rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), pivots))
    sizes, _ = spool(cells.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias("parts"), F.max("far").alias("radius")))
    few = sizes.count()
    parted = lambda own: own.join(maybe_broadcast(sizes.drop("radius"), few), CELL, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(-1)).cast("int"))
    pages, _ = spool(parted(cells).groupBy(*PART).applyInArrow(_build, ", ".join(f"{c} int" for c in PART) + ", " + PAGES))

    asked = _dealt(sized(queries.where("vec_id is not null")), pivots)
    asked, _ = spool(parted(asked).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v", *PART))
    lots = max(1, -(-asked.count() // QUERY_ROWS))
    lot = F.pmod(F.xxhash64("query"), F.lit(lots)).cast("int").alias("lot")
    shelves = pages.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    keys = [*PART, "lot"]

    def found(q: DataFrame) -> DataFrame:
        hits = q.select("query", "query_id", "v", "least", *PART, lot).groupBy(*keys).cogroup(shelves.groupBy(*keys))
        return spool(hits.applyInArrow(_search(k), "query long, query_id long, vec_id long, score long"))[0]

    near = found(asked.withColumn("least", F.lit(None).cast("long")))
    kth = near.groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("least")).select("query", F.when(F.col("_n") >= k, F.col("least")).alias("least"))
    held = asked.join(kth, "query", "left").select("query", "query_id", "v", "least", *PART)
    if few <= CELLS:
        known = {(r["dims"], r["cell"]): (r["parts"], r["radius"]) for r in sizes.collect()}
        away = held.mapInArrow(_elsewhere(known, pivots), "query long, query_id long, v array<long>, least long, dims int, cell int, part int")
    else:
        there = sizes.select("dims", F.col("cell").alias("there"), F.explode(F.expr("sequence(0, parts - 1)")).alias("at"))
        away = held.join(there, "dims").where("not (cell = there and part = at)").select("query", "query_id", "v", "least", "dims", F.col("there").alias("cell"), F.col("at").alias("part"))
    far = found(away)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _elsewhere(known: dict[tuple[int, int], tuple[int, float]], pivots: dict[int, np.ndarray]):
    """Deal each query to the other parts that may hold a row as good as its k-th so far."""
    cells: dict[int, list[int]] = {}
    for d, c in sorted(known):
        cells.setdefault(d, []).append(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, cell, part = [], [], []
            least = batch["least"].to_pylist()
            for i, (d, c, p) in enumerate(zip(*(batch[n].to_pylist() for n in PART))):
                q = batch["v"][i].values.to_numpy().astype(float)
                norm = float(np.sqrt(q @ q))
                for other in cells.get(d, ()):
                    parts, radius = known[d, other]
                    if least[i] is not None and d in pivots:
                        centre = pivots[d][other]
                        if float(q @ centre) + norm * radius + SLACK * norm * (radius + float(np.sqrt(centre @ centre)) + 1) < least[i]:
                            continue
                    for k in range(parts):
                        if (other, k) != (c, p):
                            at.append(i)
                            cell.append(other)
                            part.append(k)
            out = pa.RecordBatch.from_arrays([batch[n].take(pa.array(at, pa.int64())) for n in names[:5]] + [pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names)
            yield from (out.slice(lo, 4096) for lo in range(0, max(1, out.num_rows), 4096))

    return run
