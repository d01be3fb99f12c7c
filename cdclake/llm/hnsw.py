"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per
shard, kept as flat arrays of neighbour numbers; the answers of all shards are merged.

Equal vectors are one node that carries its smallest ids, so a vector that fills a third of
the table neither crowds a shard nor the lists of its neighbours.
"""

import heapq
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed, ship


@dataclass(frozen=True)
class Settings:
    """`shard` is the mean number of nodes per shard and `block` that of queries per block;
    both bound what one task holds. Every row is indexed."""
    k: int = 5
    shard: int = 8192
    block: int = 1024
    links: int = 12
    build: int = 64
    search: int = 192
    seed: int = 3


class Graph:
    """Level 0 has up to 2 `links` neighbours per node, higher levels `links`; -1 for none."""

    def __init__(self, vectors, neighbours, entry, top):
        self.vectors, self.neighbours, self.entry, self.top = vectors, neighbours, entry, top

    @classmethod
    def build(cls, vectors, s):
        """Insert all rows of an array of unit vectors, each on its level and those below."""
        n = len(vectors)
        draw = np.random.default_rng(s.seed)
        levels = np.minimum((-np.log(draw.random(n) + 1e-12) / math.log(s.links)).astype(int), 12)
        # One array per level; on level 0 with twice the width.
        neighbours = [np.full((n, 2 * s.links if level == 0 else s.links), -1, np.int32)
                      for level in range(int(levels.max(initial=0)) + 1)]
        graph = cls(vectors, neighbours, 0, int(levels[0]) if n else 0)
        for i in range(1, n):
            at = graph._descend(vectors[i], graph.entry, graph.top, int(levels[i]))
            for level in range(min(graph.top, int(levels[i])), -1, -1):
                found = graph._search(vectors[i], at, s.build, level)
                graph._connect(i, found, level, s.links)
                at = [found[0][1]]
            if levels[i] > graph.top:
                graph.entry, graph.top = i, int(levels[i])
        return graph

    def _descend(self, query, entry, top, level):
        """The nearest node that greedy steps reach on the levels above `level`."""
        best, value = entry, float(self.vectors[entry] @ query)
        for at in range(top, level, -1):
            while True:
                row = self.neighbours[at][best]
                row = row[row >= 0]
                if not len(row):
                    break
                near = self.vectors[row] @ query
                j = int(near.argmax())
                if near[j] <= value:
                    break
                best, value = int(row[j]), float(near[j])
        return [best]

    def _search(self, query, entries, width, level):
        """Up to `width` (similarity, node) on a level, nearest first, by best-first search."""
        links, vectors = self.neighbours[level], self.vectors
        seen = np.zeros(len(vectors), bool)
        seen[entries] = True
        first = [(float(vectors[e] @ query), e) for e in entries]
        todo = [(-d, e) for d, e in first]
        kept = list(first)
        heapq.heapify(todo)
        heapq.heapify(kept)
        while todo:
            d, node = heapq.heappop(todo)
            if -d < kept[0][0] and len(kept) >= width:
                break
            row = links[node]
            row = row[row >= 0]
            row = row[~seen[row]]
            if not len(row):
                continue
            seen[row] = True
            near = vectors[row] @ query
            if len(kept) >= width:
                good = near > kept[0][0]
                row, near = row[good], near[good]
            for x, e in zip(near.tolist(), row.tolist()):
                if len(kept) < width:
                    heapq.heappush(kept, (x, e))
                elif x > kept[0][0]:
                    heapq.heapreplace(kept, (x, e))
                else:
                    continue
                heapq.heappush(todo, (-x, e))
        return sorted(kept, key=lambda x: (-x[0], x[1]))

    def _choose(self, nodes, near, count):
        """Up to `count` of `nodes`, nearest first: one that is nearer to a chosen node than to
        the new one is left out, so links point in different directions; what is left over
        fills up the rest."""
        own = self.vectors[nodes]
        between = own @ own.T
        chosen, rest = [], []
        for i in range(len(nodes)):
            if len(chosen) == count:
                break
            (chosen if not chosen or between[i, chosen].max() < near[i] else rest).append(i)
        return nodes[(chosen + rest)[:count]]

    def _connect(self, i, found, level, count):
        nodes = np.array([e for _, e in found])
        chosen = self._choose(nodes, np.array([d for d, _ in found]), count)
        links = self.neighbours[level]
        links[i, :len(chosen)] = chosen
        for e in chosen.tolist():
            row = links[e]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
                continue
            nodes = np.append(row, i)
            near = self.vectors[nodes] @ self.vectors[e]
            order = np.argsort(-near, kind="stable")
            new = self._choose(nodes[order], near[order], len(row))
            row[:] = -1
            row[:len(new)] = new

    def nearest(self, query, width):
        """(similarity, node) of about the `width` nearest nodes."""
        if not len(self.vectors):
            return []
        return self._search(query, self._descend(query, self.entry, self.top, 0), width, 0)


def usable(vectors):
    """Distinct (vec_id, embedding) that have a direction: not NULL, not all zero, all finite."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) != F.lit(float("inf"))))
    return (vectors.select("vec_id", "embedding")
            .where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good)
            .where(F.exists("embedding", lambda x: x != 0)).distinct())


def _unit(x):
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def index(vectors, settings=Settings()):
    """One row per shard: dim, shard, and as bytes the vectors, the neighbours by level, the
    ids of each node's rows (up to k + 1 smallest) and where they begin; entry and top level.

    Nodes are dealt to shards by a hash, by their number of dimensions, and every usable
    vector is in one. `shards` in each row is the number of shards of all.
    """
    s = settings
    ship(vectors.sparkSession)
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = checkpointed(
        usable(vectors).withColumn("rank", rank).where(F.col("rank") <= s.k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // s.shard))
    dealt = nodes.select(
        F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards))
        .cast("int").alias("shard"), "embedding", "ids")

    def build(key, rows):
        import pandas as pd
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        vectors = np.stack(rows["embedding"].to_list())
        graph = Graph.build(_unit(vectors), s)
        ids = [np.asarray(x, np.int64) for x in rows["ids"]]
        return pd.DataFrame([{
            "dim": int(key[0]), "shard": int(key[1]), "rows": len(rows),
            "kind": vectors.dtype.str, "vectors": vectors.tobytes(),
            "neighbours": b"".join(x.tobytes() for x in graph.neighbours),
            "levels": len(graph.neighbours), "entry": graph.entry, "top": graph.top,
            "ids": np.concatenate(ids).tobytes(),
            "begins": np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes()}])

    return checkpointed(dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, rows int, kind string, vectors binary, neighbours binary, "
        "levels int, entry int, top int, ids binary, begins binary"))


class Shard:
    """A shard's row made into arrays again."""

    def __init__(self, row, links):
        n, dim = row["rows"], row["dim"]
        self.exact = np.frombuffer(row["vectors"], row["kind"]).reshape(n, dim).astype(np.float64)
        self.length = np.sqrt((self.exact * self.exact).sum(1))
        flat, at, levels = np.frombuffer(row["neighbours"], np.int32), 0, []
        for level in range(row["levels"]):
            width = links * 2 if level == 0 else links
            levels.append(flat[at:at + n * width].reshape(n, width))
            at += n * width
        self.graph = Graph(_unit(self.exact), levels, row["entry"], row["top"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.begins = np.frombuffer(row["begins"], np.int64)

    def answer(self, query_id, query, s):
        """The k best (score, vec_id): the cosine in double precision of the vectors as given."""
        unit = _unit(query[None])[0]
        nodes = np.array([e for _, e in self.graph.nearest(unit, s.search)])
        if not len(nodes):
            return []
        exact = self.exact[nodes]
        scores = (exact * query).sum(1) / (self.length[nodes] * np.sqrt((query * query).sum()))
        out = [(-x, i) for x, e in zip(scores.tolist(), nodes.tolist())
               for i in self.ids[self.begins[e]:self.begins[e + 1]].tolist() if i != query_id]
        return [(-x, i) for x, i in heapq.nsmallest(s.k, out)]


def search(index_rows, queries, settings=Settings()):
    """query_id, rank, vec_id and score of the k nearest rows of each query in the index.

    `queries` has vec_id and embedding; one that is NULL, zero or not finite takes no part,
    and of several vectors under one id the greatest is asked. A query's own id is never an
    answer, equal vectors under other ids are; ties go to the smaller id. Queries are met
    with the shards of their dimension in blocks.
    """
    s = settings
    ship(queries.sparkSession)
    asked = checkpointed(usable(queries).groupBy("vec_id")
                         .agg(F.max("embedding").alias("embedding")))
    blocks = max(1, -(-asked.count() // s.block))

    def gather(key, rows):
        import pandas as pd
        rows = rows.sort_values("vec_id")
        vectors = np.stack(rows["embedding"].to_list()).astype(np.float64)
        return pd.DataFrame([{"dim": int(key[0]), "asked": rows["vec_id"].to_numpy().tobytes(),
                              "wanted": vectors.tobytes()}])

    packed = (asked.select(F.size("embedding").alias("dim"), F.pmod(
        F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.col("vec_id").cast("long"),
        "embedding").groupBy("dim", "block")
        .applyInPandas(gather, "dim int, asked binary, wanted binary"))
    shards = index_rows.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    sent = (packed.join(shards, "dim")
            .select("dim", F.explode("shards").alias("shard"), "asked", "wanted"))

    def answer(batches):
        import pyarrow as pa

        @lru_cache(maxsize=2)
        def shard(dim, number):
            return Shard(row, s.links)

        for batch in batches:
            for row in batch.to_pylist():
                own = shard(row["dim"], row["shard"])
                ids = np.frombuffer(row["asked"], np.int64).tolist()
                wanted = np.frombuffer(row["wanted"]).reshape(len(ids), row["dim"])
                found = [(i, v, x) for i, q in zip(ids, wanted) for x, v in own.answer(i, q, s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.float64())],
                    names=["query_id", "vec_id", "score"])

    found = sent.join(index_rows, ["dim", "shard"]).mapInArrow(
        answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
            .select("query_id", "rank", "vec_id", "score"))


def brute_force(vectors, query_ids, k):
    """The exact answer from (id, vector) pairs held in memory, to measure recall against."""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    length = np.sqrt((x * x).sum(1))
    out = {}
    for q in query_ids:
        at = int(np.flatnonzero(ids == q)[0])
        scores = (x * x[at]).sum(1) / (length * length[at])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(scores[j])) for j in order]
    return out
