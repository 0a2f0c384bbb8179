"""Problem 2: groups of records whose word sets are alike, by a blocked sparse matrix product.

Documents are rows of a sparse incidence matrix over the words (n-grams of
length ``ngram``; 1 in this project's statement of the problem, 5 elsewhere).
Similarity is |A and B| / |A or B| >= num/den over distinct n-grams. The
product of the matrix with its transpose is computed block by block, one block
for each column:

1. Equal sets collapse to one class (its smallest identifier) by a 128-bit key.
2. Columns are ordered by rarity. Counts come from a sketch of 65,536 cells, a
   fixed size at any input, which may be broadcast; any order is correct, a
   rough order by rarity is fast. A pair above the threshold shares one of the
   first ``n - ceil(t n) + 1`` columns of the larger row and one of the first
   ``n - ceil(2t/(1+t) n) + 1`` of the smaller: only those entries have blocks.
3. An entry takes the rest of its row, the columns after its own, along into
   the block, as 16-bit cells. So a block multiplies whole rows from its column
   on, and the first column two rows share is the block that sees all of their
   overlap.
4. Within a block, bounds from the sizes, from the position of the column, and
   from the Hamming distance of 128-bit signatures (never more than the sets'
   difference) discard pairs. For those left the product is accumulated: one
   for the block's column and one for each common cell of the rests, compared
   with the least overlap that the two sizes need. None of these can discard a
   pair above the threshold: cells only merge words, which adds to a count.
5. An exact check follows: the few pairs left are counted over 32-bit columns.

A column with more than ``CHUNK`` entries is cut into chunks of that size and
every pair of chunks is a block, so no block is unbounded and no row is
dropped. The list of such columns goes to the workers while it is short
(``HOT_LIST``) and is joined by a shuffle beyond.

Words are compared by 32-bit fingerprints; two different words of one pair of
texts share one with probability below 1e-6, which can only add to an overlap.
Groups are connected components of the pairs between classes.

Defined cases: null texts and texts without a word are in no group; repeated
rows of an identifier count once; ties cannot occur in the representative;
rows of more than ``LONG`` n-grams send no rest, so only the bounds and the
exact check see their pairs; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import Cut, partitions, ship
from .collapse import groups

CELLS = 1 << 16
CHUNK = 8192
#: So many cut columns may travel with the task; more are joined by a shuffle.
HOT_LIST = 20_000
#: Rows with more columns than this send no rest into their blocks.
LONG = 1024
#: Pairs looked at in one step of a block.
STEP = 1 << 20


def _incidence(ngram: int):
    """Batches of (id, text) to (id, k1, k2, cols): each text's distinct n-grams as sorted 32-bit fingerprints."""

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash

        word = re.compile(r"[^\W_]+")
        class Memo(dict):
            def __missing__(self, x):
                h = self[x] = xxhash.xxh64_intdigest(x) & 0xFFFFFFFF
                return h

        memo = Memo()
        for b in batches:
            ids, k1, k2, cols = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                w = word.findall(text.lower().replace("ß", "ss"))
                if not w:
                    continue
                if ngram > 1:
                    w = [" ".join(w[j : j + ngram]) for j in range(max(1, len(w) - ngram + 1))]
                if len(memo) > 500_000:
                    memo.clear()
                fp = {memo[x] for x in w}
                a = np.sort(np.fromiter(fp, np.uint32, len(fp)))
                d = xxhash.xxh128_intdigest(a.tobytes())
                ids.append(i)
                k1.append((d >> 64) - (1 << 63))
                k2.append((d & ((1 << 64) - 1)) - (1 << 63))
                cols.append(a.view(np.int32))
            offsets = np.zeros(len(cols) + 1, np.int32)
            np.cumsum([len(a) for a in cols], out=offsets[1:])
            flat = np.concatenate(cols) if cols else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["id", "k1", "k2", "cols"],
            )

    return run


def _ordered(batch, counts, num: int, den: int):
    """A batch's kept entries: (row, column, position, size) with the row's columns by rarity, up to the larger prefix."""
    import numpy as np

    lists = batch.column("cols")
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    row = np.repeat(np.arange(len(n)), n)
    rank = (counts[flat & (CELLS - 1)].astype(np.uint64) << np.uint64(32)) | flat
    order = np.lexsort((rank, row))
    flat = flat[order]
    start = np.cumsum(n) - n
    pos = np.arange(len(flat)) - np.repeat(start, n)
    keep = pos < np.repeat(n - -(-num * n // den) + 1, n)
    return n, flat, row, pos, keep


def _column_counts(counts, num: int, den: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            _, flat, _, _, keep = _ordered(b, counts, num, den)
            c, k = np.unique(flat[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int32)), pa.array(k)], ["col", "k"])

    return run


def _rests(n, flat, row, pos, r, p):
    """The cells after position ``p`` of each row in ``r``, ascending by cell: (offsets, cells)."""
    import numpy as np

    cell = (flat & np.uint32(CELLS - 1)).astype(np.uint16)
    order = np.lexsort((cell, row))
    cell, at = cell[order], pos[order]
    start = np.cumsum(n) - n
    size = np.where(n[r] > LONG, 0, n[r])
    first = np.cumsum(size) - size
    idx = np.repeat(start[r] - first, size) + np.arange(int(size.sum()))
    keep = at[idx] > np.repeat(p, size)
    left = np.where(n[r] > LONG, 0, n[r] - 1 - p)
    return np.r_[0, np.cumsum(left)], cell[idx[keep]]


def _dealt(col, rep, chunks):
    """Entries of cut columns go to every pair of chunks with their own: (entry, low chunk, high chunk, side)."""
    import numpy as np

    mine = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks
    entry = np.repeat(np.arange(len(col)), chunks)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    mine = mine[entry]
    lo, hi = np.minimum(mine, other), np.maximum(mine, other)
    # a row met in a block of two chunks only meets the other one there
    return entry, lo, hi, np.where(lo == hi, 0, np.where(mine == lo, 1, 2))


def _entries(counts, hot: dict[int, int], num: int, den: int):
    """Kept entries as rows of blocks: (col, tile, rep, meta, rest)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hot_cols = np.array(sorted(hot), np.uint32)
        hot_chunks = np.array([hot[c] for c in sorted(hot)], np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            n, flat, row, pos, keep = _ordered(b, counts, num, den)
            col, r, p = flat[keep], row[keep], pos[keep]
            rep = b.column("rep").to_numpy()[r]
            offsets, cells = _rests(n, flat, row, pos, r, p)
            rest = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(cells)])
            tile, side = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            if len(hot_cols):
                at = np.minimum(np.searchsorted(hot_cols, col), len(hot_cols) - 1)
                entry, lo, hi, side = _dealt(col, rep, np.where(hot_cols[at] == col, hot_chunks[at], 1))
                tile = (lo << 31) | hi
                col, r, p, rep, rest = col[entry], r[entry], p[entry], rep[entry], rest.take(pa.array(entry))
            meta = n[r] | (p << 24) | (side << 48)
            yield pa.RecordBatch.from_arrays([pa.array(col.view(np.int32)), pa.array(tile), pa.array(rep), pa.array(meta), rest], ["col", "tile", "rep", "meta", "rest"])

    return run


def _cut_entries(batches):
    """Entries with their column's number of chunks, null for one, dealt to pairs of chunks."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        chunks = b.column("chunks").fill_null(1).to_numpy().astype(np.int64)
        entry, lo, hi, side = _dealt(chunks, b.column("rep").to_numpy(), chunks)
        got = b.take(pa.array(entry))
        meta = got.column("meta").to_numpy() | (side << 48)
        yield pa.RecordBatch.from_arrays([got.column("col"), pa.array((lo << 31) | hi), got.column("rep"), pa.array(meta), got.column("rest")], ["col", "tile", "rep", "meta", "rest"])


def _product(x, y, off, key, need):
    """Accumulates the overlaps of pairs of entries over their sorted cells and tells which reach the need."""
    import numpy as np

    good = np.zeros(len(x), bool)
    step = 1 << 16
    for s in range(0, len(x), step):
        a, b = x[s : s + step], y[s : s + step]
        both = []
        for side in (a, b):
            size = off[side + 1] - off[side]
            first = np.cumsum(size) - size
            pair = np.repeat(np.arange(len(side)), size)
            both.append(((pair << 24) | key[np.repeat(off[side] - first, size) + np.arange(len(pair))], pair))
        (ka, pa_), (kb, _) = both
        if len(kb):
            hit = kb[np.minimum(np.searchsorted(kb, ka), len(kb) - 1)] == ka
            overlap = 1 + np.bincount(pa_[hit], minlength=len(a))
        else:
            overlap = np.ones(len(a), np.int64)
        good[s : s + step] = overlap >= need[s : s + step]
    return good


def _block_pairs(block, rep, meta, length, cells, num: int, den: int):
    """The pairs of whole blocks whose accumulated overlap reaches the need; ``block`` ascends."""
    import numpy as np

    size, pos, side = meta & 0xFFFFFF, (meta >> 24) & 0xFFFFFF, meta >> 48
    order = np.lexsort((rep, size, block))
    off = np.r_[0, np.cumsum(length)]
    # signatures, and cells with the number of their repetition, per entry as it came
    owner = np.repeat(np.arange(len(rep)), length)
    bit = (cells >> np.uint16(9)).astype(np.uint64)
    one = np.uint64(1) << (bit & np.uint64(63))
    sig = []
    for half in (bit < 64, bit >= 64):
        v = np.zeros(len(rep), np.uint64)
        full = length > 0
        if full.any():
            v[full] = np.bitwise_or.reduceat(np.where(half, one, np.uint64(0)), off[:-1][full])
        sig.append(v[order])
    key = cells.astype(np.int64) << 8
    again = np.flatnonzero((cells[1:] == cells[:-1]) & (owner[1:] == owner[:-1])) + 1
    for i in again.tolist():
        key[i] = key[i - 1] + 1
    start, length = off[:-1][order], length[order]
    at = np.r_[0, np.cumsum(length)]
    key = key[np.repeat(start - at[:-1], length) + np.arange(int(at[-1]))]
    block, rep, size, pos, side = block[order], rep[order], size[order], pos[order], side[order]
    left = size - pos  # what an overlap can still reach, the block's column included
    open_ = length != left - 1  # sent no rest
    # left >= need, for both ends of a pair, without a division: (num + den) left >= num (both sizes)
    weight = (num * size).astype(np.int32)
    slack = ((num + den) * left).astype(np.int32) - weight
    cut_up = bool(side.any())
    both = (block << 24) | size
    # the largest size that the smaller row reaches, by the ratio of sizes and by what it has left
    most = np.minimum(np.minimum(size * den // num, slack // num), 0xFFFFFF)
    end = np.searchsorted(both, (block << 24) | np.maximum(most, 0), side="right")
    count = np.where(slack >= weight, end - np.arange(len(rep)) - 1, 0)
    rows = np.flatnonzero(count > 0)
    upto = np.cumsum(count[rows])
    out = []
    done = 0
    while done < len(rows):
        base = upto[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(upto, base + STEP, side="right")))
        r = rows[done:stop]
        done = stop
        k = count[r]
        y = np.arange(int(k.sum())) + np.repeat(r + 1 - np.cumsum(k) + k, k)
        ok = slack[y] >= np.repeat(weight[r], k)
        if cut_up:
            ok &= (np.repeat(side[r], k) == 0) | (np.repeat(side[r], k) != side[y])
        x, y = np.repeat(r, k)[ok], y[ok]
        need = -(-num * (size[x] + size[y]) // (num + den))
        far = np.bitwise_count(sig[0][x] ^ sig[0][y]).astype(np.int64) + np.bitwise_count(sig[1][x] ^ sig[1][y])
        known = ~(open_[x] | open_[y])
        ok = ~known | (far <= length[x] + length[y] - 2 * (need - 1))
        x, y, need, known = x[ok], y[ok], need[ok], known[ok]
        good = ~known
        good[known] = _product(x[known], y[known], at, key, need[known])
        if good.any():
            out.append((rep[x[good]], rep[y[good]]))
    if not out:
        return None
    x, y = (np.concatenate(z) for z in zip(*out, strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def _pairs(num: int, den: int, at_once: int = 4 * CHUNK):
    """Batches sorted by block to pairs; whole blocks are multiplied, several small ones together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[pa.RecordBatch] = []

        def product(batch):
            col, tile = batch.column("col").to_numpy(), batch.column("tile").to_numpy()
            block = np.r_[0, np.cumsum((col[1:] != col[:-1]) | (tile[1:] != tile[:-1]))]
            off = np.frombuffer(batch.column("rest").buffers()[1], np.int32)[batch.column("rest").offset :][: len(col) + 1].astype(np.int64) // 2
            data = batch.column("rest").buffers()[2]
            cells = np.frombuffer(data, np.uint16)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint16)
            got = _block_pairs(block, batch.column("rep").to_numpy(), batch.column("meta").to_numpy(), np.diff(off), cells, num, den)
            return got and pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(h.num_rows for h in held) < at_once:
                continue
            full = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            col, tile = full.column("col").to_numpy(), full.column("tile").to_numpy()
            edges = np.flatnonzero((col[1:] != col[:-1]) | (tile[1:] != tile[:-1]))
            if not len(edges):  # one block so far, of at most two chunks
                held = [full]
                continue
            last = int(edges[-1]) + 1
            if (x := product(full.slice(0, last))) is not None:
                yield x
            held = [full.slice(last)]
        if held:
            full = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if (x := product(full)) is not None:
                yield x

    return run


def similar_pairs(classes: DataFrame, cut: Cut, num: int = 7, den: int = 10, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, b): all pairs of classes at or above the threshold, exactly, each once.

    ``classes``: (rep, cols), one row per class.
    """
    import numpy as np

    spark = classes.sparkSession
    cells = classes.select(F.explode("cols").alias("c")).groupBy(F.col("c").bitwiseAND(CELLS - 1).alias("cell")).count()
    counts = np.zeros(CELLS, np.int64)
    for r in cells.collect():  # at most CELLS rows
        counts[r["cell"]] = r["count"]
    counts = np.minimum(counts, 2**31 - 1).astype(np.uint32)
    per_col = classes.select("cols").mapInArrow(_column_counts(counts, num, den), "col int, k long").groupBy("col").agg(F.sum("k").alias("k"))
    crowded = cut(per_col.where(F.col("k") > CHUNK).select("col", F.ceil(F.col("k") / CHUNK).alias("chunks")), "crowded")
    short = crowded.limit(hot_list + 1).collect()
    schema = "col int, tile long, rep long, meta long, rest binary"
    rows = classes.select("rep", "cols")
    if len(short) <= hot_list:
        entries = rows.mapInArrow(_entries(counts, {r["col"] & 0xFFFFFFFF: r["chunks"] for r in short}, num, den), schema)
    else:
        entries = rows.mapInArrow(_entries(counts, {}, num, den), schema).join(crowded, "col", "left").select("col", "rep", "meta", "rest", "chunks").mapInArrow(_cut_entries, schema)
    found = entries.repartition(partitions(spark), "col", "tile").sortWithinPartitions("col", "tile").mapInArrow(_pairs(num, den), "a long, b long").distinct()
    found = cut(found, "candidates")
    ends = found.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
    both = ends.join(rows, "rep").groupBy("a", "b").agg(F.collect_list("cols").alias("x"))
    shared = F.size(F.array_intersect(F.col("x")[0], F.col("x")[1]))
    total_size = F.size(F.col("x")[0]) + F.size(F.col("x")[1])
    pairs = cut(both.where(shared * (num + den) >= total_size * num).select("a", "b"), "pairs")
    cut.drop(found)
    cut.drop(crowded)
    return pairs


def alike(facts: DataFrame, ident: str = "fact_id", text: str = "content", num: int = 7, den: int = 10, ngram: int = 1) -> dict[str, DataFrame]:
    """classes (rep, cols), pairs (a, b), members (rep, ident; copies only), roots (node, root)."""
    spark = facts.sparkSession
    ship(spark)
    cut = Cut(spark, "alike")
    rows = facts.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    rows = cut(rows.mapInArrow(_incidence(ngram), "id long, k1 long, k2 long, cols array<int>"), "rows")
    classes = cut(rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("cols").alias("cols")).select("rep", "cols"), "classes")
    pairs = similar_pairs(classes, cut, num, den)
    ids = rows.select("id", "k1", "k2").distinct()
    _, members = groups(ids, ["k1", "k2"], "id", rows.count())
    members = members.where("id != first").select(F.col("first").alias("rep"), F.col("id").alias(ident))
    return {"classes": classes, "pairs": pairs, "members": members, "roots": components(pairs, "a", "b")}


def group_members(parts: dict[str, DataFrame], ident: str = "fact_id", first: str = "first_fact_id") -> DataFrame:
    """(first, ident): every member of a group but its smallest identifier."""
    roots, members = parts["roots"], parts["members"]
    linked = roots.where("node != root").select(F.col("root").alias(first), F.col("node").alias(ident))
    copies = members.join(roots, F.col("rep") == F.col("node"), "left").select(F.coalesce("root", "rep").alias(first), ident)
    return linked.unionByName(copies)
