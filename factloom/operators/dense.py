"""Exact cosine over stored vectors, in Arrow batches against a bounded query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, partitions, ship

#: A query set travels to every task, so a larger one goes in blocks of this size, one pass each.
MAX_QUERIES = 10_000
#: Queries compared at once with an Arrow batch.
TILE = 1000
#: Vectors of one pack in the shared folder, queries compared with it at once, and pairs whose cosines are computed at once.
PACK, ASKED, PAIRS = 4096, 512, 1 << 17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def absent(v: Column) -> Column:
    """A null or all-zero vector is a missing one."""
    return v.isNull() | ~F.exists(v, lambda x: x != 0)


def present(vectors: DataFrame, identity: str | None = None) -> DataFrame:
    """One usable vector per fact and identity."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) == F.col("dim")) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok)
    if identity is not None:
        rows = rows.where(F.col("embedding_identity") == identity)
    return rows.groupBy("fact_id", "embedding_identity").agg(F.min("embedding").alias("embedding"))


def _query_blocks(queries: DataFrame):
    """(ids, unit vectors) of at most MAX_QUERIES queries, block after block."""
    import numpy as np

    def block(ids, q):
        m = np.stack(q)
        return ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    ids, q = [], []
    for r in queries.select("query_id", "embedding").toLocalIterator(prefetchPartitions=True):
        ids.append(r["query_id"])
        q.append(np.array(r["embedding"], np.float64))
        if len(ids) == MAX_QUERIES:
            yield block(ids, q)
            ids, q = [], []
    if ids:
        yield block(ids, q)


def _best(queries, k: int, least: float):
    """The k best rows of every batch for each query of a block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, m = pa.array(queries.value[0], pa.int64()), queries.value[1]
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            n = min(k, b.num_rows)
            for t in range(0, len(m), TILE):
                sim = m[t : t + TILE] @ x.T
                best = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < b.num_rows else np.tile(np.arange(n), (len(sim), 1))
                s = np.take_along_axis(sim, best, 1)
                i, j = np.nonzero(s >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(t + i)), b.column(0).take(pa.array(best[i, j])), pa.array(s[i, j])], ["query_id", "fact_id", "cosine"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, fact_id, cosine, rank): exact top-k of each query vector against all rows.

    ``queries`` (query_id, embedding) run in blocks of at most MAX_QUERIES.
    Each task keeps k per query, so the shuffle holds tasks * queries * k rows,
    not all pairs.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("fact_id", "embedding")
    found = None
    for block in _query_blocks(queries):
        part = rows.mapInArrow(_best(spark.sparkContext.broadcast(block), k, least), "query_id long, fact_id long, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, fact_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.round("cosine", 6).desc(), "fact_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packs(batches):
    """(fact_id, embedding) to packs of PACK vectors: identifiers and elements as bytes."""
    import numpy as np
    import pyarrow as pa

    parts, held = [], 0

    def done(parts):
        ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["ids", "v"])

    for b in batches:
        for s in range(0, b.num_rows, PACK):
            x = b.slice(s, PACK)
            parts.append((x.column(0).to_numpy(), x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)))
            held += x.num_rows
            if held >= PACK:
                yield done(parts)
                parts, held = [], 0
    if held:
        yield done(parts)


def rounded(x):
    """Halves away from zero, to six digits, as integers."""
    import numpy as np

    return (np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5)).astype(np.int64)


def _nearest(path: str, k: int):
    """Queries (query_id, embedding) to their k nearest of all packs, ties to the smaller identifier."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        files = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))

        def packs():
            for f in files:
                for b in pq.ParquetFile(system.open_input_file(f)).iter_batches(batch_size=1):
                    ids = np.frombuffer(b.column("ids")[0].as_buffer(), np.int64)
                    v = np.frombuffer(b.column("v")[0].as_buffer(), np.float32).reshape(len(ids), -1)
                    yield ids, v, np.linalg.norm(v.astype(np.float64), axis=1)

        def merged(found):
            """The k best of each query, from (query, rounded cosine, fact, cosine)."""
            who, what, fact, exact = (np.concatenate([f[n] for f in found]) for n in range(4))
            order = np.lexsort((fact, -what, who))
            who = who[order]
            at = np.arange(len(who))
            start = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], at, 0)) if len(who) else at
            keep = at - start < k
            order = order[keep]
            return who[keep], what[order], fact[order], exact[order], (at - start)[keep]

        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
            tiles = [(m[t : t + ASKED], m[t : t + ASKED].astype(np.float32)) for t in range(0, len(m), ASKED)]
            bars, kept, waiting = [np.full(len(t[0]), -np.inf, np.float32) for t in tiles], [[] for _ in tiles], [0] * len(tiles)
            for ids, v, norm in packs():
                unit = (v / np.maximum(norm, 1e-30)[:, None]).astype(np.float32)
                for n, (exact, plain) in enumerate(tiles):
                    sim = plain @ unit.T
                    bar = bars[n]
                    if len(ids) > k and not np.isfinite(bar).all():
                        bar = np.maximum(bar, np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k] - np.float32(2e-5))
                    i, j = np.nonzero(sim >= bar[:, None])
                    for s in range(0, len(i), PAIRS):  # the product in single precision only says which pairs are looked at
                        x, y = i[s : s + PAIRS], j[s : s + PAIRS]
                        c = np.einsum("ij,ij->i", exact[x], v[y].astype(np.float64)) / np.maximum(norm[y], 1e-30)
                        kept[n].append((x, rounded(c), ids[y], c))
                    waiting[n] += len(i)
                    if waiting[n] >= k * len(exact):
                        *best, place = merged(kept[n])
                        kept[n], waiting[n] = [tuple(best)], 0
                        last = place == k - 1
                        # whoever is below the k-th by more than single precision and rounding may hide is no candidate
                        bars[n][best[0][last]] = (best[1][last] / 1e6 - 2e-5).astype(np.float32)
            for n in range(len(tiles)):
                if kept[n]:
                    who, _, fact, c, place = merged(kept[n])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n * ASKED + who)), pa.array(fact), pa.array(c), pa.array((place + 1).astype(np.int32))], ["query_id", "fact_id", "cosine", "rank"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, cosine, rank): as ``top_k``, for query sets that grow with the vectors.

    Queries are dealt out and go through all vectors, which lie packed in the
    shared folder: nothing of either is collected or broadcast, and only the
    k rows of each query leave a task.
    """
    spark = vectors.sparkSession
    ship(spark)
    packed = Cut(spark, "nearest")(vectors.select("fact_id", "embedding").mapInArrow(_packs, "ids binary, v binary"), "packs")
    rows = queries.select("query_id", "embedding").repartition(max(spark.sparkContext.defaultParallelism, partitions(spark)), "query_id")
    return rows.mapInArrow(_nearest(packed._factloom_path, k), "query_id long, fact_id long, cosine double, rank int")


def hash_embedding(texts: DataFrame, text: str = "content", width: int = 256) -> DataFrame:
    """(fact_id, embedding): deterministic feature hashing of words and character trigrams, unit length.

    Features ``w:word`` and ``c3:trigram`` fall into a cell by 8 bytes of
    BLAKE2b, with a sign from the top bit. A text without features is a zero
    vector.
    """
    ship(texts.sparkSession)

    def run(batches):
        import hashlib
        import re

        import numpy as np
        import pyarrow as pa

        word = re.compile("[a-z0-9]+")
        memo: dict[str, int] = {}

        def cell(f: str) -> int:
            h = memo.get(f)
            if h is None:
                if len(memo) > 500_000:
                    memo.clear()
                h = memo[f] = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            return h

        for b in batches:
            m = np.zeros((b.num_rows, width), np.float32)
            for r, t in enumerate(b.column(1).to_pylist()):
                for w in word.findall((t or "").lower()):
                    padded = f"^{w}$"
                    for f in ["w:" + w, *("c3:" + padded[i : i + 3] for i in range(len(padded) - 2))]:
                        h = cell(f)
                        m[r, h % width] += -1.0 if h >> 63 else 1.0
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(n == 0, 1, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width, dtype=np.int32)), pa.array(m.ravel()))], ["fact_id", "embedding"])

    return texts.select("fact_id", text).mapInArrow(run, "fact_id long, embedding array<float>")
