"""Problem 5: the most similar vectors of every vector, by an inverted file with product quantisation.

Per embedding identity (identities never meet):

* Fit, on a bounded sample (``40`` vectors a cell, at most ``40 * MAX_CELLS``):
  coarse centroids by Lloyd's iterations, and a codebook per subspace of the
  residuals. Only the fit sees the sample; every vector is indexed and queried.
* Index: each vector goes to its nearest cell as (id, vector, residual codes).
* Query: each vector visits its ``probes`` nearest cells. Within a cell, scores
  come from asymmetric distance tables (query against codewords, summed over
  subspaces, plus query against centroid); the ``rerank`` best per cell and
  query are compared exactly.
* The best ``k`` over all visited cells remain.
* Vectors travel to the cells in packs, without loss: the bytes that hold sign
  and exponent, which take few values in unit vectors, are Huffman-coded.

A cell with many vectors is cut into chunks that are blocks of their own, and
its queries visit every chunk, so no block is unbounded and no vector is left
out. The model's size is bounded by ``MAX_CELLS`` per identity.

Defined cases: vectors that are null, all zero, not of length ``dim`` or hold a
null, NaN or infinity take no part; repeated rows of (fact, identity) count
once (rows of one fact with different vectors keep the first in vector order);
ties go to the smaller identifier; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Cut, partitions, ship

VECTORS_A_CELL = 300
MAX_CELLS = 4096
SAMPLE_A_CELL = 40
SUBSPACES = 8
CODES = 256
CHUNK = 8192
TILE = 1024
#: Bits of the filter that finds rows which may repeat a (fact, identity).
REPEAT_BITS = 1 << 24
#: Vectors of one block that travel in one row.
PACK = 16
#: Bytes of vectors that a task of the search reads, about, and the most tasks that are made to keep to it.
TASK_BYTES = 12 << 20
MAX_TASKS = 50_000


def usable(vectors: DataFrame) -> DataFrame:
    """(identity, id, embedding, dim): rows whose length is right; values are looked at in the Arrow step."""
    return vectors.where(
        F.col("embedding").isNotNull() & F.col("fact_id").isNotNull() & F.col("embedding_identity").isNotNull() & (F.size("embedding") == F.col("dim"))
    ).select(F.col("embedding_identity").alias("identity"), F.col("fact_id").alias("id"), "embedding", "dim")


def repeats(rows: DataFrame):
    """A bitmap of hash spots, with that of every (identity, id) that has several rows; its size does not grow with the table."""
    import numpy as np

    spot = F.pmod("hash", F.lit(REPEAT_BITS))
    twice = rows.select(F.xxhash64("identity", "id").alias("hash")).groupBy("hash").count().where("count > 1")
    words = twice.groupBy(F.shiftright(spot, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {REPEAT_BITS}) % 32 as int))")).alias("bits"))
    out = np.zeros(-(-REPEAT_BITS // 32), np.uint32)
    for r in words.toLocalIterator(prefetchPartitions=True):
        out[r["word"]] = r["bits"]
    return out


def _first(rows: DataFrame) -> DataFrame:
    """One usable row of each (identity, id): the first in vector order."""
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(sound).groupBy("identity", "id").agg(F.min("embedding").alias("embedding"))


def _marked(bits, spots):
    """Which spots are set in the bitmap."""
    import numpy as np

    return (bits[spots >> 5] >> (spots & 31).astype(np.uint32) & 1).astype(bool)


def _unit(batch):
    """Per (identity, dim) of a batch: (identity, ids, unit vectors float32); unusable rows left out."""
    import numpy as np

    identity = batch.column("identity").dictionary_encode()
    names, code = identity.dictionary.to_pylist(), identity.indices.to_numpy()
    ids = batch.column("id").to_numpy()
    lists = batch.column("embedding")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    off = lists.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    n = np.diff(off)
    for c, name in enumerate(names):
        for d in np.unique(n[code == c]):
            rows = np.flatnonzero((code == c) & (n == d))
            if d == 0:
                continue
            v = flat[off[rows][:, None] + np.arange(d)[None, :]]
            norm = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v))
            good = np.isfinite(norm) & (norm > 0)
            yield name, ids[rows[good]], (v[good] / norm[good][:, None]).astype(np.float32)


def _nearest(x, centroids):
    """The nearest centroid of every row, by squared distance."""
    import numpy as np

    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = (x[s : s + 4096] @ centroids.T - half).argmax(axis=1)
    return out


def _lloyd(x, k: int, rounds: int, rng):
    import numpy as np

    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        full = n > 0
        c[full] = total[full] / n[full][:, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c.astype(np.float32)


def _fit(cells: dict[str, int], subspaces: int, seed: int):
    """One sample frame of an identity to its model: centroids and codebooks as bytes."""

    def run(key, frame):
        import numpy as np
        import pandas as pd

        rng = np.random.default_rng(seed)
        name = key[0]
        x = np.stack([np.frombuffer(v, np.float32) for v in frame.sort_values("id")["v"]])
        c = _lloyd(x, cells[name], 8, rng)
        r = x - c[_nearest(x, c)]
        books = [_lloyd(part, CODES, 6, rng) for part in np.array_split(r, min(subspaces, x.shape[1]), axis=1)]
        return pd.DataFrame({
            "identity": [name], "dim": [x.shape[1]], "centroids": [c.tobytes()], "books": [[b.tobytes() for b in books]], "widths": [[int(b.shape[1]) for b in books]],
        })

    return run


def fit(vectors: DataFrame, cells: dict[str, int], fraction: dict[str, float], subspaces: int = SUBSPACES, seed: int = 7) -> dict:
    """identity -> (centroids, codebooks), from a hash sample of each identity of the given fraction."""
    import numpy as np

    kind = vectors.schema["id"].dataType.simpleString()
    share = F.coalesce(*[F.when(F.col("identity") == i, F.lit(f)) for i, f in fraction.items()], F.lit(1.0))
    picked = vectors.where((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6) < share)

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for name, ids, v in _unit(b):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), pa.array([x.tobytes() for x in v], pa.binary())], ["identity", "id", "v"])

    schema = "identity string, dim int, centroids binary, books array<binary>, widths array<int>"
    rows = picked.mapInArrow(pack, f"identity string, id {kind}, v binary").groupBy("identity").applyInPandas(_fit(cells, subspaces, seed), schema).collect()
    return {
        r["identity"]: (
            np.frombuffer(r["centroids"], np.float32).reshape(-1, r["dim"]),
            [np.frombuffer(b, np.float32).reshape(-1, w) for b, w in zip(r["books"], r["widths"], strict=True)],
        )
        for r in rows
    }


def _codes(residual, books):
    import numpy as np

    parts = np.split(residual, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)
    return np.stack([_nearest(np.ascontiguousarray(p), b) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)


def _cell_counts(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            for name, _, v in _unit(b):
                if name in model.value:
                    c, k = np.unique(_nearest(v, model.value[name][0]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(c.astype(np.int32)), pa.array(k)], ["identity", "cell", "k"])

    return run


def _packs(block, role: int, ids, v, codes=None):
    """A record batch of packs: rows of one block together, at most PACK each."""
    import zlib

    import numpy as np
    import pyarrow as pa

    order = np.argsort(block, kind="stable")
    block, ids, planes = block[order], ids[order].astype(np.int64), v[order].view(np.uint8).reshape(len(order), v.shape[1], 4)
    codes = None if codes is None else codes[order]
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    place = np.arange(len(block)) - np.repeat(start, np.diff(np.r_[start, len(block)]))
    start = np.flatnonzero(place % PACK == 0)
    packed = []
    for s, e in zip(start, np.r_[start, len(block)][1:], strict=True):
        z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        head = z.compress(planes[s:e, :, 3].tobytes()) + z.flush()
        packed.append((ids[s:e].tobytes(), planes[s:e, :, :3].tobytes() + head, b"" if codes is None else codes[s:e].tobytes()))
    columns = [pa.array([x[i] for x in packed], pa.binary()) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(np.full(len(start), role, np.int32)), *columns], ["block", "role", "ids", "v", "codes"])


def _unpacked(packs, dim: int):
    """(ids, unit vectors, role of each row, codes of the index rows) of packs."""
    import zlib

    import numpy as np

    role = packs.column("role").to_numpy()
    ids = [np.frombuffer(x, np.int64) for x in packs.column("ids").to_pylist()]
    n = [len(x) for x in ids]
    planes, at = np.empty((sum(n), dim, 4), np.uint8), 0
    for k, x in zip(n, packs.column("v").to_pylist(), strict=True):
        planes[at : at + k, :, :3] = np.frombuffer(x, np.uint8, 3 * dim * k).reshape(k, dim, 3)
        planes[at : at + k, :, 3] = np.frombuffer(zlib.decompress(x[3 * dim * k :], -15), np.uint8).reshape(k, dim)
        at += k
    role = np.repeat(role, n)
    codes = np.frombuffer(b"".join(packs.column("codes").to_pylist()), np.uint8)
    return np.concatenate(ids), planes.reshape(at, 4 * dim).view(np.float32), role, codes.reshape(int((role != 1).sum()), -1) if len(codes) else codes


def _repeated(bits):
    """The rows whose (identity, id) may have others."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(_marked(bits.value, b.column("spot").to_numpy()))).select(["identity", "id", "embedding"])

    return run


def _visits(model, chunks: dict[tuple[str, int], int], probes: int, every: int, bits=None):
    """Packs of index rows (role 0; 2 where the row asks nothing) and of visiting queries (role 1) by block; ``bits``: without the rows at these spots."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        order = {n: i for i, n in enumerate(sorted(model.value))}
        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(~_marked(bits.value, b.column("spot").to_numpy())))
            if not b.num_rows:
                continue
            for name, ids, v in _unit(b):
                if name not in model.value or not len(ids):
                    continue
                cent, books = model.value[name]
                p = min(probes, len(cent))
                score = v @ cent.T - 0.5 * np.einsum("ij,ij->i", cent, cent)
                home = score.argmax(axis=1)
                near = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < len(cent) else np.tile(np.arange(p), (len(v), 1))
                codes = _codes(v - cent[home], books)
                n_chunks = np.ones(len(cent), np.int64)
                for (i, c), k in chunks.items():
                    if i == name:
                        n_chunks[c] = k
                mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n_chunks[home]
                base = order[name] << 48
                # index rows; as queries they meet their own chunk without a second copy
                asks = ids % every == 0
                for role in (0, 2):
                    if (of := asks if role == 0 else ~asks).any():
                        yield _packs((base | (home << 16) | mine)[of], role, ids[of], v[of], codes[of])
                row = np.repeat(np.flatnonzero(asks), p)
                cell = near[asks].ravel()
                row, cell = np.repeat(row, n_chunks[cell]), np.repeat(cell, n_chunks[cell])
                first = np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]
                run_start = np.flatnonzero(first)
                chunk = np.arange(len(row)) - np.repeat(run_start, np.diff(np.r_[run_start, len(row)]))
                away = ~((cell == home[row]) & (chunk == mine[row]))
                row, cell, chunk = row[away], cell[away], chunk[away]
                yield _packs(base | (cell << 16) | chunk, 1, ids[row], v[row])

    return run


def _search(x_ids, x, codes, q_ids, q, centroid, books, k: int, rerank: int, least: float):
    """The k best of one block for every query: asymmetric tables, then exact products. ``x_ids`` ascend: ties go to the smaller."""
    import numpy as np

    cuts = np.cumsum([b.shape[1] for b in books])[:-1]
    r = min(rerank, len(x_ids))
    qs, cs, sims = [], [], []
    for s in range(0, len(q_ids), TILE):
        qq, qi = q[s : s + TILE], q_ids[s : s + TILE]
        parts = np.split(qq, cuts, axis=1)
        approx = np.zeros((len(qq), len(x_ids)), np.float32)
        for m, book in enumerate(books):
            approx += np.take(parts[m] @ book.T, codes[:, m], axis=1)  # the table of subspace m, looked up
        approx += (qq @ centroid)[:, None]
        top = np.argpartition(-approx, r - 1, axis=1)[:, :r] if r < len(x_ids) else np.tile(np.arange(r), (len(qq), 1))
        if r < len(x_ids):
            bar = np.take_along_axis(approx, top, 1).min(axis=1)
            for b in np.flatnonzero((approx >= bar[:, None]).sum(axis=1) > r):  # more rows at the bar than there is room for
                over = np.flatnonzero(approx[b] > bar[b])
                top[b] = np.r_[over, np.flatnonzero(approx[b] == bar[b])[: r - len(over)]]
            top.sort(axis=1)
        sim = np.einsum("brd,bd->br", x[top], qq)
        sim[x_ids[top] == qi[:, None]] = -2.0
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        sim, got = np.take_along_axis(sim, best, 1), x_ids[np.take_along_axis(top, best, 1)]
        b, j = np.nonzero(sim >= max(least, -1.5))
        qs.append(qi[b])
        cs.append(got[b, j])
        sims.append(sim[b, j])
    return np.concatenate(qs), np.concatenate(cs), np.concatenate(sims)


def _blocks(model, k: int, rerank: int, least: float, kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = sorted(model.value)
        held, current = [], None

        def flush():
            block = pa.Table.from_batches(held).combine_chunks()
            name = names[current >> 48]
            cent, books = model.value[name]
            ids, vec, role, codes = _unpacked(block, cent.shape[1])
            index = np.flatnonzero(role != 1)
            if not len(index):
                return None
            _, once = np.unique(ids[index], return_index=True)
            index = index[once]
            ask = np.r_[index[role[index] == 0], np.flatnonzero(role == 1)]
            if not len(ask):
                return None
            q, c, sim = _search(ids[index], vec[index], codes[once], ids[ask], vec[ask], cent[(current >> 16) & 0xFFFFFFFF], books, k, rerank, least)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(q), pa.string()), pa.array(q).cast(kind), pa.array(c).cast(kind), pa.array(sim.astype(np.float64))], ["identity", "id", "other", "cosine"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            if not len(block):
                continue
            edges = np.flatnonzero(np.diff(block)) + 1
            for s, e in zip(np.r_[0, edges], np.r_[edges, len(block)], strict=True):
                if block[s] != current:
                    if held and (x := flush()) is not None:
                        yield x
                    held, current = [], int(block[s])
                held.append(batch.slice(s, e - s))
        if held and (x := flush()) is not None:
            yield x

    return run


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, probes: int = 6, rerank: int = 24, subspaces: int = SUBSPACES, every: int = 1) -> DataFrame:
    """(identity, id, other, cosine, rank): the k most similar vectors of each usable vector, from ``least`` on.

    ``vectors``: fact_id, embedding, dim, embedding_identity; ``every``: only the
    vectors whose id it divides ask, against all.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("count"), F.max("dim").alias("dim")).collect()  # one row per identity
    sizes = {r["identity"]: r["count"] for r in found}
    moved = sum(4 * r["dim"] * r["count"] * (1 + probes / every) for r in found)
    tasks = max(partitions(spark), min(MAX_TASKS, int(moved // TASK_BYTES) + 1))
    cells = {i: max(1, min(MAX_CELLS, n // VECTORS_A_CELL)) for i, n in sizes.items()}
    fraction = {i: min(1.0, max(SAMPLE_A_CELL * cells[i], 4 * CODES) / n) for i, n in sizes.items()}
    fitted = fit(rows, cells, fraction, subspaces) if sizes else {}
    model = spark.sparkContext.broadcast(fitted)
    crowd = (
        rows.mapInArrow(_cell_counts(model), "identity string, cell int, k long").groupBy("identity", "cell").agg(F.sum("k").alias("k")).where(F.col("k") > CHUNK).collect()
        if any(n > CHUNK for n in sizes.values()) else []
    )  # at most MAX_CELLS rows per identity
    chunks = {(r["identity"], r["cell"]): -(-r["k"] // CHUNK) for r in crowd}
    packs = "block long, role int, ids binary, v binary, codes binary"
    bitmap = repeats(rows)
    if bitmap.any():
        bits = spark.sparkContext.broadcast(bitmap)
        spotted = rows.select("identity", "id", "embedding", F.pmod(F.xxhash64("identity", "id"), F.lit(REPEAT_BITS)).alias("spot"))
        once = _first(spotted.mapInArrow(_repeated(bits), f"identity string, id {kind}, embedding {rows.schema['embedding'].dataType.simpleString()}"))
        visits = spotted.mapInArrow(_visits(model, chunks, probes, every, bits), packs).unionByName(once.mapInArrow(_visits(model, chunks, probes, every), packs))
    else:
        visits = rows.mapInArrow(_visits(model, chunks, probes, every), packs)
    found = visits.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(
        _blocks(model, k, rerank, least, {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}[kind]), f"identity string, id {kind}, other {kind}, cosine double"
    )
    w = Window.partitionBy("identity", "id").orderBy(F.col("cosine").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """p5_found: pairs of facts where one is among the other's k nearest, at a cosine of at least ``least``."""
    n = neighbours(vectors, k, least)
    return n.select(F.col("identity").alias("embedding_identity"), F.least("id", "other").alias("fact_id_a"), F.greatest("id", "other").alias("fact_id_b")).distinct()


def searched(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest of every vector whose id is divisible by 20, against all vectors."""
    return neighbours(vectors, k, every=20)
