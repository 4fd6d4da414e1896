"""Near copies among vectors by random-rotation binary codes with correction factors.

A unit vector ``x`` is turned by a random rotation and coded by the signs of its coordinates,
together with the factor ``f = <sign code, x>``. For two vectors, the product with
the code, divided by the factor, is an unbiased estimate of their inner product, whose error
is bounded with high probability by a multiple of ``sqrt((1 - f^2) / (f^2 (d - 1)))``. Bands of the code
pick the candidates, the estimate and its bound drop those that are surely too far, and
the rest is computed exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import forest
from triagelake.llm.components import components
from triagelake.llm.store import materialize

#: Bands of a code, bits of a band. At cosine 0.98 two codes agree in a bit with probability 0.936,
#: so a pair meets in some band with probability 0.99999 at least.
BANDS = 32
BITS = 18
#: Width of the confidence bound in standard deviations of the estimate.
WIDTH = 6.0
#: Vectors compared with as many others at a time.
BLOCK = 512
SEED = 11


@lru_cache(maxsize=16)
def rotations(dim: int) -> np.ndarray:
    """As many random rotations as the bands need bits, one below the other."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(-(-BANDS * BITS // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.vstack(out)


def _doubles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All components of a column of lists, one after the other."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # Divided by a power of two first, which is exact, squares of huge and tiny components neither overflow nor vanish.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _codes(batches):
    """name, embedding -> the key of every band, for vectors of finite components that are not all zero."""
    for b in batches:
        names = b.column(0).to_numpy(zero_copy_only=False)
        count = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = _doubles(b.column(1))
        ends = np.cumsum(count)
        for dim in np.unique(count):
            rows = np.flatnonzero(count == dim)
            if not dim:
                continue
            x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[good], x[good]
            bits = (_unit(x) @ rotations(int(dim)).T)[:, : BANDS * BITS] > 0
            keys = bits.reshape(len(rows), BANDS, BITS) @ (1 << np.arange(BITS, dtype=np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, keys.astype(np.int32).ravel())
            yield pa.record_batch([pa.array(names[rows]), pa.array(np.full(len(rows), dim, np.int32)), lists], names=["name", "dim", "keys"])


_CODED = "name long, dim int, keys array<int>"


def _compare(band: int, same: np.ndarray, i: np.ndarray, j: np.ndarray, code: np.ndarray, unit: np.ndarray, threshold: float):
    """Links between rows i and rows j of a bucket that do not meet in an earlier band."""
    ci, cj = code[i], code[j]
    first = np.ones((len(i), len(j)), bool)
    for k in range(band):
        first &= ci[:, k][:, None] != cj[:, k][None, :]
    if same:
        first &= np.triu(np.ones((len(i), len(j)), bool), 1)
    a, b = np.nonzero(first)
    if not len(a):
        return a, b
    dim = unit.shape[1]
    turn = rotations(dim)[:dim]
    # Estimate from the sign code of the first rotation of one side.
    sign = np.where(unit[i] @ turn.T > 0, 1.0, -1.0) / np.sqrt(dim)
    factor = (sign * (unit[i] @ turn.T)).sum(axis=1)
    estimate = (sign @ turn @ unit[j].T) / factor[:, None]
    bound = WIDTH * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(dim - 1, 1)))
    maybe = (estimate + bound[:, None])[a, b] >= threshold
    a, b = a[maybe], b[maybe]
    # One product of the two blocks; gathering the rows of all pairs would take their number times the length.
    link = (unit[i] @ unit[j].T)[a, b] >= threshold
    return a[link], b[link]


def _linker(threshold: float):
    """A part of one bucket, or two parts -> kind 0: links of a vector; kind 1: spanning edges."""

    def run(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        dim = table.column("dim")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        side = table.column("side").to_numpy()
        weight = table.column("copies").to_numpy()
        n = len(ids)
        code = _doubles(table.column("keys")).astype(np.int32).reshape(n, BANDS)
        unit = _unit(_doubles(table.column("embedding")).reshape(n, dim))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        single = not len(right) or not len(left)
        left, right = (np.arange(n), np.arange(n)) if single else (left, right)
        links = np.zeros(n, np.int64)
        us, vs = [], []
        for s in range(0, len(left), BLOCK):
            for t in range(s if single else 0, len(right), BLOCK):
                i, j = left[s : s + BLOCK], right[t : t + BLOCK]
                a, b = _compare(band, single and s == t, i, j, code, unit, threshold)
                np.add.at(links, i[a], weight[j[b]])
                np.add.at(links, j[b], weight[i[a]])
                if len(a):
                    u, v = forest(ids[i[a]], ids[j[b]])
                    us.append(u)
                    vs.append(v)
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
        else:
            u = v = np.zeros(0, np.int64)
        hit = np.flatnonzero(links)
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(u), np.int32)])),
                "u": pa.array(np.concatenate([ids[hit], u]).astype(np.int64)),
                "v": pa.array(np.concatenate([links[hit], v]).astype(np.int64)),
            }
        )

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row per row of ``vec_id, embedding, label``.

    Vectors link if their labels are equal and not null and their cosine in double precision is at least
    ``threshold``. Null, empty and zero vectors, and those with null or non-finite components,
    link with nothing; vectors of different length do not link either. Equal vectors
    with equal labels are compared once. A crowded bucket is cut into parts by hash and each
    pair of parts is a task of its own. Rows sharing a vec_id are told apart by their
    vector; a null vec_id counts as a link of others and keeps a null component unless
    something with an id is reachable.
    """
    good = (F.col("embedding").isNotNull()) & (F.size("embedding") > 0) & F.col("label").isNotNull()
    good &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good &= F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("name", F.when(good, F.shiftleft(F.shiftrightunsigned(F.xxhash64("label", "embedding"), 2), 1)))
    rows = materialize(rows.select("vec_id", "label", "name", F.when(F.col("name").isNotNull(), F.col("embedding")).alias("embedding")), "vectors")
    classes = rows.filter("name is not null").groupBy("name").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialize(classes, "classes")
    coded = materialize(classes.select("name", "embedding").mapInArrow(_codes, _CODED), "codes")
    coded = coded.join(classes.select("name", "label", "copies", "embedding"), "name")
    bucket = ["label", "dim", "band", "key"]
    places = coded.select("name", "label", "dim", F.posexplode("keys").alias("band", "key"))
    crowd = places.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    met = places.join(crowd, bucket).join(coded.select("name", "copies", "keys", "embedding"), "name")
    met = met.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "name"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), F.col("name").alias("vec_id"), "copies", "keys", "embedding")
    found = materialize(met.groupBy(*bucket, "i", "j").applyInArrow(_linker(threshold), "kind int, u long, v long"), "links")
    reach = components(found.filter("kind = 1").select("u", "v")).toDF("name", "root")
    links = found.filter("kind = 0").groupBy(F.col("u").alias("name")).agg(F.sum("v").alias("links"))
    named = classes.select("name", "copies", "low").join(reach, "name", "left").join(links, "name", "left").withColumn("root", F.coalesce("root", "name"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "name").join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
