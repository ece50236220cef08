"""Near-duplicate embeddings by cross-polytope hashing.

Vectors of one label are hashed by ``TABLES`` tables of two cross-polytope
functions each: three sign flips and fast Hadamard transforms rotate the
vector, and the function's value is the signed axis closest to it. A vector is
stored in its own bucket of a table and queries the ``PROBES - 1`` next best
buckets, ranked by how little the rotated coordinates fall short of the
largest. Pairs that meet in a bucket are verified by cosine in double
precision, and each verified pair is counted once: in the first table, and
there the smallest bucket, in which it can meet, which a task can tell from
the two vectors alone. So no list of pairs is shuffled; a bucket emits the
links per vector and a spanning forest. Equal vectors of a label are one
class with a weight and a number of its own. Codes are worked out once and
written down; buckets in which no two vectors meet, or that none of theirs
calls its own, get no vectors. Buckets over ``BUCKET_CAP`` rows are split into
tiles.

Cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are kept; they
never count as links. Vectors of different lengths do not link. Rows that
repeat an id, of one label or several, count as vectors of their own, each with
its own links and component; all rows with a component's smallest id are kept.
A null id takes part; a component has a null id only if it has no other, and
its rows are kept then. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, drop_table, local_roots, lookup, map_groups, spool, tiled, tune

THRESHOLD = 0.93
TABLES = 6
PROBES = 4
BUCKET_CAP = 4096
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def probe_codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(n, tables, probes) bucket codes, the own bucket first."""
    n, d = unit.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, size))
    out = np.zeros((n, tables, probes), np.int64)
    top = min(3, size)
    rows = np.arange(n)[:, None]
    for t in range(tables):
        code, gap = [], []
        for j in range(2):
            r = padded
            for s in signs[t, j]:
                r = hadamard(r * s) / np.sqrt(size)
            best = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :top]
            v = r[rows, best]
            code.append(best * 2 + (v < 0))
            gap.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        both = (code[0][:, :, None] * (2 * size) + code[1][:, None, :]).reshape(n, -1)
        miss = (gap[0][:, :, None] + gap[1][:, None, :]).reshape(n, -1)
        order = np.argsort(miss, axis=1, kind="stable")[:, :probes]
        got = both[rows, order]
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, :1]
    return out


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(col, rows: np.ndarray, d: int) -> np.ndarray:
    return col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, cell, cls, home): every bucket that a vector is stored in or queries."""
    for b in batches:
        label, cls, vec = b.columns
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False).astype(int)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            codes = probe_codes(unit_rows(_matrix(vec, own, d)))
            seen = np.zeros(codes.shape, bool)  # a code may repeat where there are few axes
            for p in range(1, codes.shape[2]):
                seen[:, :, p] = (codes[:, :, :p] == codes[:, :, p : p + 1]).any(2)
            at, t, p = np.nonzero(~seen)
            cell = (np.int64(d) << 40) + (t.astype(np.int64) << 32) + codes[at, t, p]
            take = pa.array(own[at])
            yield pa.RecordBatch.from_arrays([label.take(take), pa.array(cell), cls.take(take), pa.array(p == 0)], ["label", "cell", "cls", "home"])


def _owned(codes: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which of the pairs a-b are counted in this bucket."""
    in_a = (codes[b][:, :, :1] == codes[a]).any(2)  # b's own bucket is one that a queries
    in_b = (codes[a][:, :, :1] == codes[b]).any(2)
    first = (in_a | in_b).argmax(1)
    far = np.int64(1) << 40
    low = np.minimum(np.where(in_a[:, table], codes[b][:, table, 0], far), np.where(in_b[:, table], codes[a][:, table, 0], far))
    return (first == table) & (low == code)


def bucket_links(g: pa.Table, threshold: float = THRESHOLD) -> pa.Table | None:
    """Links per vector (kind 0) and spanning links (kind 1) of one bucket or tile."""
    home = g["home"].to_numpy()
    if not home.any():
        return None
    cell = int(g["cell"][0].as_py())
    d, table, code = cell >> 40, (cell >> 32) & 255, cell & 0xFFFFFFFF
    rep, weight, side = g["cls"].to_numpy(), g["n"].to_numpy(), g["side"].to_numpy()
    unit = unit_rows(g["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), d))
    links = np.zeros(len(rep), np.int64)
    codes: np.ndarray | None = None
    ends: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    for at in range(0, len(rep), 512):
        near = unit[at : at + 512] @ unit[at:].T >= threshold
        near &= home[at : at + 512, None] | home[None, at:]
        near &= (side[at : at + 512, None] != side[None, at:]) | (side[None, at:] == 2)
        a, b = np.nonzero(np.triu(near, 1))
        a, b = a + at, b + at
        if not len(a):
            continue
        codes = probe_codes(unit) if codes is None else codes
        for i in range(0, len(a), 65536):
            x, y = a[i : i + 65536], b[i : i + 65536]
            mine = _owned(codes, x, y, table, code)
            x, y = x[mine], y[mine]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            if len(x):  # keep a forest of what this chunk links
                root = local_roots(len(rep), x, y)
                own = np.flatnonzero(root != np.arange(len(rep)))
                starts.append(own)
                ends.append(root[own])
    if not ends:
        return None
    root = local_roots(len(rep), np.concatenate(starts), np.concatenate(ends))
    own, linked = np.flatnonzero(root != np.arange(len(rep))), np.flatnonzero(links)
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [len(linked), len(own)]).astype(np.int32)),
        "a": np.concatenate([rep[linked], rep[own]]), "b": np.concatenate([links[linked], rep[root[own]]]),
    })


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; only equal non-null labels are compared."""
    tune(vectors.sparkSession)
    v = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = v.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vec"))
    rows = rows.withColumn("vec", F.when(sound, v))
    grouped = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = cut(grouped.withColumn("cls", F.monotonically_increasing_id()))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("label", "cls", "vec").repartition(n, "cls").mapInArrow(_codes, "label long, cell long, cls long, home boolean")
    codes, codes_at = spool(dealt)
    cells = codes.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("label", "cell", "n")
    met = tiled(lookup(codes, cells, ["label", "cell"], "n"), ["label", "cell"], "cls", BUCKET_CAP).join(classes.select("cls", "n", "vec"), "cls")
    found = cut(map_groups(met, ["label", "cell", "tile"], bucket_links, "kind int, a long, b long"))
    drop_table(vectors.sparkSession, codes_at)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("near"))
    comp = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")), "cls", "root")
    own = cut(classes.join(counts, "cls", "left").join(comp, "cls", "left").select("label", "vec", "n", "first", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    per_class = lookup(own, least, ["root"], "size").select("label", "vec", "n", "n_links", "component_id")
    lone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = lookup(rows.where("vec is not null"), per_class, ["label", "vec"], "n").select("vec_id", "n_links", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
