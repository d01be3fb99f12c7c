"""Exact top-k inner products of integer vectors.

Vectors are sorted by descending length and cut into blocks. A query meets the block of the
longest vectors first, which gives it a score that its answers must reach; by Cauchy-Schwarz
only blocks whose longest vector can reach it are met after that, and within a block the walk
ends where the lengths are too small. What is left is measured in a rotation by the singular
vectors of all data, so that the first coordinates hold most of the length: a partial sum over
them plus the product of the lengths of what remains bounds the score, and only pairs whose
bound reaches the query's score are multiplied out, in exact integers.

Equal vectors are one node that carries its smallest ids.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed, ship

# Below 2^52 all doubles with a fraction, below 2^53 all sums of integers are exact.
WHOLE, EXACT = 2.0 ** 52, 2.0 ** 53
# Share of |q| |v| by which a rotated partial sum in doubles may be off, with room to spare.
SLACK = 1e-9
NOT_FOUND = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """`block` vectors and `asked` queries at most meet in one step, in `chunk`s of vectors;
    `parts` are the shares of the coordinates after which a partial sum is looked at."""
    k: int = 5
    scale: int = 256
    block: int = 4096
    asked: int = 512
    chunk: int = 512
    parts: tuple = (0.25, 0.6)


def usable(vectors, scale):
    """Distinct (vec_id, v): floor(scale * x) of every component, as whole doubles."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) != F.lit(float("inf"))))

    def whole(x):
        y = x.cast("double") * float(scale)
        return (F.when(F.abs(y) < WHOLE, F.floor(y).cast("double"))
                .when(F.abs(y) < float("inf"), y)
                .otherwise(F.raise_error(F.lit("a component is too large")).cast("double")))

    return (vectors.select("vec_id", "embedding")
            .where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good)
            .select(F.col("vec_id").cast("long"), F.transform("embedding", whole).alias("v"))
            .distinct())


def length(v="v"):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def matrices(column):
    """(dimension, row numbers, matrix) for every number of dimensions in a list array."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = column.take(at).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), at, flat.reshape(len(at), int(dim))


def rotations(nodes):
    """{dimension: orthogonal matrix}, the right singular vectors of all nodes, those with the
    largest singular value first. Every task sums the products of its vectors; only sums per
    pair of dimensions are shuffled, and one matrix per dimension reaches the driver."""
    widest = nodes.agg(F.max(F.size("v"))).head()[0] or 0

    def summed(batches):
        import pyarrow as pa
        sums = {}
        for batch in batches:
            for dim, _, x in matrices(batch.column(0)):
                if dim:
                    sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                 pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "i", "sums"])

    parts = nodes.select("v").mapInArrow(summed, "dim int, i int, sums array<double>")
    rows = parts.groupBy("dim", "i").agg(
        F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(widest)]).alias("sums")).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        own = sorted((r["i"], r["sums"][:dim]) for r in rows if r["dim"] == dim)
        total = np.array([sums for _, sums in own])
        if np.isfinite(total).all():  # else any rotation does; the plain axes are one
            out[dim] = np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()
    return out


def index(vectors, settings=Settings()):
    """(blocks, rotations). A block is a row: dim, block, longest, and as bytes the vectors by
    descending length, the ids of each one's rows (up to k + 1 smallest) and where they begin.

    Blocks of one dimension are numbered from the longest vectors on, by range cuts over
    length, so that no length is too common for one task. Every usable vector is in one.
    """
    s = settings
    ship(vectors.sparkSession)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = checkpointed(
        usable(vectors, s.scale).withColumn("rank", rank).where(F.col("rank") <= s.k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select("v", "ids", F.size("v").alias("dim"), length().alias("length")))
    cuts = max(1, -(-nodes.count() // s.block))
    dealt = nodes.repartitionByRange(
        cuts, "dim", F.col("length").desc(), F.xxhash64("v")).sortWithinPartitions(
            "dim", F.col("length").desc(), F.xxhash64("v"))

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        ids = column["ids"].to_pylist()
        lengths = column["length"].to_numpy()
        for dim, at, x in matrices(column["v"]):
            for i in range(0, len(at), s.block):
                own = at[i:i + s.block]
                mine = [np.asarray(ids[j], np.int64) for j in own]
                begins = np.cumsum([0, *map(len, mine)]).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "dim": dim, "block": number, "longest": float(lengths[own[0]]),
                    "vectors": x[i:i + s.block].tobytes(),
                    "ids": np.concatenate(mine).tobytes(), "begins": begins.tobytes()}],
                    schema=schema)
                number += 1

    import pyarrow as pa
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("longest", pa.float64()),
                        ("vectors", pa.binary()), ("ids", pa.binary()), ("begins", pa.binary())])
    blocks = checkpointed(dealt.mapInArrow(
        packed, "dim int, block long, longest double, vectors binary, ids binary, begins binary"))
    return blocks, rotations(nodes)


class Block:
    """A block's row as arrays, its vectors also rotated, with the lengths of what remains of
    them after each part of the coordinates."""

    def __init__(self, row, rotation, parts):
        self.begins = np.frombuffer(row["begins"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.exact = np.frombuffer(row["vectors"]).reshape(len(self.begins) - 1, row["dim"])
        self.cuts = sorted({max(1, round(row["dim"] * p)) for p in parts}) if row["dim"] else []
        self.length, self.rotated, self.rest = measured(self.exact, rotation, self.cuts)


def measured(x, rotation, cuts):
    with np.errstate(over="ignore", invalid="ignore"):
        turned = x if rotation is None else x @ rotation
        total = np.sqrt((x * x).sum(1))
        rest = [np.sqrt((turned[:, c:] ** 2).sum(1)) for c in cuts]
    return total, turned, rest


def products(left, right, i, j):
    """Inner products of chosen pairs of rows: all pairs at once where many are wanted."""
    if len(i) * 5 > len(left) * len(right):
        return (left @ right.T)[i, j]
    return np.einsum("ij,ij->i", left[i], right[j])


def exact_products(left, right, i, j):
    """As Python integers, for sums that doubles do not hold."""
    rows = {n: [int(x) for x in left[n]] for n in np.unique(i)}
    columns = {n: [int(x) for x in right[n]] for n in np.unique(j)}
    return np.array([sum(a * b for a, b in zip(rows[m], columns[n]))
                     for m, n in zip(i.tolist(), j.tolist())] + [None], object)[:-1]


class Best:
    """The k best (score, id) of every query so far: higher scores, then smaller ids."""

    def __init__(self, asked, floors, k, kind):
        self.asked, self.k = asked, k
        self.scores = np.full((len(asked), k), -np.inf).astype(kind)
        self.ids = np.full((len(asked), k), NOT_FOUND)
        self.floors = floors.astype(kind)

    def bound(self):
        return np.maximum(self.floors, self.scores[:, -1])

    def add(self, i, scores, nodes, block):
        """Nodes of a block with their scores for queries `i`."""
        first = block.ids[block.begins[nodes]]
        order = np.lexsort((first, -scores, i))
        i, scores, nodes = i[order], scores[order], nodes[order]
        kept = _place(i) <= self.k        # no more nodes than that can hold the k best
        i, scores, nodes = i[kept], scores[kept], nodes[kept]
        counts = block.begins[nodes + 1] - block.begins[nodes]
        at = np.repeat(block.begins[nodes] - np.cumsum(counts) + counts, counts)
        ids = block.ids[at + np.arange(len(at))]
        i, scores = np.repeat(i, counts), np.repeat(scores, counts)
        other = ids != self.asked[i]
        touched = np.unique(i)
        i = np.concatenate([i[other], np.repeat(touched, self.k)])
        scores = np.concatenate([scores[other], self.scores[touched].ravel()])
        ids = np.concatenate([ids[other], self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, i))
        i, scores, ids = i[order], scores[order], ids[order]
        place = _place(i)
        kept = place < self.k
        self.scores[i[kept], place[kept]] = scores[kept]
        self.ids[i[kept], place[kept]] = ids[kept]


def _place(groups):
    """Place within its group of each row of sorted groups."""
    new = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return np.arange(len(groups)) - np.flatnonzero(new)[np.cumsum(new) - 1]


def answer(block, rotation, asked, wanted, floors, s):
    """(query ids, ids, scores): for each query its k best in the block that reach its floor."""
    size, turned, rest = measured(wanted, rotation, block.cuts)
    with np.errstate(over="ignore"):
        huge = not size.max(initial=0) * block.length.max(initial=0) < EXACT
    best = Best(asked, floors, s.k, object if huge else np.float64)
    for start in range(0, len(block.length), s.chunk):
        part = slice(start, start + s.chunk)
        with np.errstate(over="ignore", invalid="ignore"):
            least = best.bound().astype(np.float64)
            least -= np.abs(np.where(np.isfinite(least), least, 0)) * SLACK
            reach = size * block.length[start] * (1 + SLACK)
            live = np.flatnonzero(~(reach < least))
            if not len(live):
                break
            i, j = np.nonzero(~(size[live, None] * block.length[None, part] * (1 + SLACK)
                                < least[live, None]))
            i, sums, done = live[i], np.zeros(len(i)), 0
            for cut, left, right in zip(block.cuts, rest, block.rest):
                sums = sums + products(turned[:, done:cut], block.rotated[part, done:cut], i, j)
                bound = sums + left[i] * right[part][j] + SLACK * size[i] * block.length[part][j]
                kept = ~(bound < least[i])
                i, j, sums, done = i[kept], j[kept], sums[kept], cut
        exact = exact_products if huge else products
        scores = exact(wanted, block.exact[part], i, j)
        kept = np.flatnonzero(scores >= best.bound()[i]) if len(i) else []
        if len(kept):
            best.add(i[kept], scores[kept], j[kept] + start, block)
    i, place = np.nonzero(best.ids != NOT_FOUND)
    return asked[i], best.ids[i, place], [int(x) for x in best.scores[i, place]]


def search(indexed, queries, settings=Settings()):
    """query_id, rank, vec_id and score: the k rows of the highest inner product with each
    query in the index, exactly; equal scores go to the smaller id.

    `queries` has vec_id and embedding. Vectors that are NULL or hold a NULL or a component
    that is not finite take no part, nor do those without an id; vectors are compared within
    their number of dimensions. A query's own id is never an answer, equal vectors under other
    ids are, and fewer rows than k are all returned. Rows repeated in id and vector count once;
    of several vectors under one id the greatest is asked and each is a candidate. A zero
    vector is as good as any other. Other columns play no part; empty tables give no rows. A
    score beyond 64 bits among the answers fails the query.

    Queries, in blocks, meet the block of the longest vectors, then, ordered by the length that
    an answer needs, all blocks that have it; no block is left out for any other reason.
    """
    s, (blocks, rotation) = settings, indexed
    ship(queries.sparkSession)
    asked = checkpointed(usable(queries, s.scale).groupBy("vec_id").agg(F.max("v").alias("v"))
                         .select("vec_id", "v", F.size("v").alias("dim"), length().alias("size")))
    cuts = max(1, -(-asked.count() // s.asked))
    numbers = blocks.groupBy("dim").agg(
        F.min("block").alias("first"),
        F.collect_list(F.struct("block", "longest")).alias("all"))

    def packed(batches):
        import pyarrow as pa
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        ids, needs = column["vec_id"].to_numpy(), column["need"].to_numpy()
        floors = column["floor"].to_numpy(zero_copy_only=False)
        for dim, at, x in matrices(column["v"]):
            for i in range(0, len(at), s.asked):
                own = at[i:i + s.asked]
                yield pa.RecordBatch.from_pylist([{
                    "dim": dim, "need": float(needs[own].min()), "asked": ids[own].tobytes(),
                    "wanted": x[i:i + s.asked].tobytes(), "floors": floors[own].tobytes()}],
                    schema=schema)

    import pyarrow as pa
    schema = pa.schema([("dim", pa.int32()), ("need", pa.float64()), ("asked", pa.binary()),
                        ("wanted", pa.binary()), ("floors", pa.binary())])

    def met(batches):
        @lru_cache(maxsize=1)
        def block(dim, number):
            return Block(row, rotation.get(dim), s.parts)

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["asked"], np.int64)
                found = answer(block(row["dim"], row["block"]), rotation.get(row["dim"]), ids,
                               np.frombuffer(row["wanted"]).reshape(len(ids), row["dim"]),
                               np.frombuffer(row["floors"]), s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    def meet(asked, chosen):
        """Blocks of queries (by the length they need) with the blocks chosen for each."""
        queries = asked.repartitionByRange(cuts, "dim", "need", "vec_id").mapInArrow(
            packed, "dim int, need double, asked binary, wanted binary, floors binary")
        pairs = queries.join(numbers, "dim").select(
            "dim", F.explode(chosen).alias("block"), "asked", "wanted", "floors")
        return pairs.join(blocks, ["dim", "block"]).mapInArrow(
            met, "query_id long, vec_id long, score long")

    plain = asked.select("dim", "vec_id", "v", F.lit(0.0).alias("need"),
                         F.lit(float("-inf")).alias("floor"))
    first = checkpointed(meet(plain, F.array("first")))
    floors = first.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
    # Less than the floor by more than the cast to a double may have added to it.
    floor = F.when(F.col("n") >= s.k, F.col("floor") - F.abs("floor") * 1e-15)
    need = F.when((floor > 0) & (F.col("size") > 0), floor / F.col("size") * (1 - SLACK))
    second = meet(
        asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select(
            "dim", "vec_id", "v", F.coalesce(need, F.lit(0.0)).alias("need"),
            F.coalesce(floor, F.lit(float("-inf"))).alias("floor")),
        F.transform(F.filter("all", lambda b: (b["block"] != F.col("first"))
                             & (b["longest"] >= F.col("need"))), lambda b: b["block"]))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(second).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score"))


SQL = """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(
               embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
      WHERE q.vec_id % 50 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
