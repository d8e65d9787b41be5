"""Property graphs as two DataFrames: nodes(id, ...) and edges(src, dst, rel, weight).

Traversals are frontier loops of joins; each round is cut by a checkpoint in the shared folder, so lineage stays short and a
lost executor costs one round. Neighbourhood is undirected unless a direction is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.shared import cut

#: Links of a graph whose adjacency (4 bytes a link) every task may hold; closeness and diameter of a larger one are found by joins.
ADJACENCY_LINKS = 1 << 23
#: Numbers of 8 bytes in one of a task's matrices of nodes by sources, and in a part of it that is worked on at once.
MATRIX, PART = 1 << 23, 1 << 16
#: Nodes with more neighbours are handled one by one.
HUB = 64


class _Adjacency:
    """Neighbours of all nodes that have any: ids by falling degree, near[start[i]:start[i + 1]] are the places of node i's neighbours."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.ids, self.start, self.near = (np.frombuffer(row[name].as_buffer(), kind) for name, kind in (("ids", np.int64), ("start", np.int64), ("near", np.int32)))
        self.degree = np.diff(self.start)

    @staticmethod
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of links in both directions (a, b)."""
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches]
        if not sum(len(a) for a, _ in parts):
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, degree = np.unique(a, return_counts=True)
        order = np.argsort(-degree, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        a, b = place[np.searchsorted(ids, a)], place[np.searchsorted(ids, b)]
        near = b[np.lexsort((b, a))]
        start = np.concatenate([[0], np.cumsum(degree[order])]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[order].astype(np.int64), start, near)], ["ids", "start", "near"])

    def gathered(self, x: np.ndarray, op: np.ufunc) -> np.ndarray:
        """For each node its neighbours' rows of x, joined by op."""
        out, n = np.empty_like(x), len(x)
        hubs = int(np.searchsorted(-self.degree, -HUB))
        for i in range(hubs):
            own, step = self.near[self.start[i] : self.start[i + 1]], max(1, PART // x.shape[1])
            op.reduce([op.reduce(x[own[at : at + step]], axis=0) for at in range(0, len(own), step)], axis=0, out=out[i])
        step = max(1, PART // x.shape[1])
        for low in range(hubs, n, step):
            part, first, degree = out[low : low + step], self.start[low : min(n, low + step)], -self.degree[low : low + step]
            part[:] = x[self.near[first]]
            for j in range(1, -degree[0]):
                c = int(np.searchsorted(degree, -j))  # those with more than j neighbours
                op(part[:c], x[self.near[first[:c] + j]], out=part[:c])
        return out

    def shares(self, task: int, tasks: int, width: int) -> Iterator[np.ndarray]:
        """A task's sources, so many at once."""
        for at in range(task * width, len(self.ids), tasks * width):
            yield np.arange(at, min(len(self.ids), at + width))

    def levels(self, task: int, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
        """(depth, nodes by sources): a bit is set where a source first reaches a node; for each share of a task's sources, one depth after the other."""
        n = len(self.ids)
        words = max(1, min(64, MATRIX // n, -(-n // (64 * tasks))))
        for sources in self.shares(task, tasks, 64 * words):
            at = np.arange(len(sources))
            new = np.zeros((n, words), np.uint64)
            np.bitwise_or.at(new, (sources, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            unseen, depth = ~new, 0
            while True:
                new, depth = self.gathered(new, np.bitwise_or), depth + 1
                new &= unseen
                if not new.any():
                    break
                unseen ^= new
                yield depth, new

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        """Brandes: for each node the sum over sources of the share of shortest paths that lead through it."""
        at, n = np.arange(len(sources)), len(self.ids)
        depth, paths = np.full((n, len(sources)), -1, np.int32), np.zeros((n, len(sources)))
        depth[sources, at], paths[sources, at] = 0, 1
        new, d = paths, 0
        while True:
            new = self.gathered(new, np.add)
            new *= depth < 0
            if not new.any():
                break
            d += 1
            depth[new > 0] = d
            paths = paths + new
        one = np.divide(1, paths, out=np.zeros_like(paths), where=paths > 0)
        delta = np.zeros_like(paths)
        for k in range(d, 0, -1):
            x = 1 + delta
            x *= one
            x *= depth == k
            x = self.gathered(x, np.add)
            x *= paths
            x *= depth == k - 1
            delta += x
        delta[sources, at] = 0
        return delta.sum(axis=1)


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    # Changes give a new graph; keeping the old one is a rollback.

    def add_nodes(self, rows: DataFrame) -> Graph:
        return Graph(self.nodes.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> Graph:
        """Edges whose ends both exist."""
        ids = self.nodes.select("id")
        known = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes, self.edges.unionByName(known.select(*self.edges.columns)))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Their edges go too."""
        gone = ids.select("id")
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def remove_edges(self, condition: Column) -> Graph:
        return Graph(self.nodes, self.edges.where(~F.coalesce(condition, F.lit(False))))

    def find_nodes(self, condition: Column) -> DataFrame:
        return self.nodes.where(condition).select("id").orderBy("id")

    def links(self, direction: str = "both") -> DataFrame:
        """Distinct (a, b) without loops: from a node to its neighbours."""
        out = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        back = self.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[direction].where("a <> b").distinct()

    def neighbors(self, direction: str = "both") -> DataFrame:
        """(id, neighbors): of every node that has any, sorted."""
        return self.links(direction).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("neighbors"))

    def count_nodes_with_relationship(self, direction: str = "both") -> DataFrame:
        """(rel, n): distinct ends of the edges of each name."""
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        return self.edges.select("rel", F.explode(F.array(*ends)).alias("id")).groupBy("rel").agg(F.count_distinct("id").alias("n"))

    # Traversal.

    def bfs(self, sources: DataFrame, max_depth: int | None = None, direction: str = "both", stop: DataFrame | None = None, visit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(source, id, depth, parent): each node reached from each source, with the least parent on a shortest path.

        stop (id): a source whose search reaches one of these goes no deeper. visit is called with the rows of each depth and returns those from
        which the search goes on.
        """
        links = cut(self.links(direction))
        seen = cut(sources.select(F.col("id").alias("source"), F.col("id"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent")))

        def onwards(rows: DataFrame) -> DataFrame:
            if stop is not None:
                done = rows.join(stop.select("id"), "id", "left_semi").select("source").distinct()
                rows = rows.join(done, "source", "left_anti").select(*seen.columns)
            return rows if visit is None else visit(rows)

        frontier, depth = onwards(seen), 0
        while max_depth is None or depth < max_depth:
            depth += 1
            reached = frontier.join(links, frontier["id"] == links["a"]).groupBy("source", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
            frontier = cut(reached.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("depth"), "parent"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
            frontier = onwards(frontier)
        return seen

    def dfs(self, start: int, max_depth: int | None = None) -> DataFrame:
        """(id, depth, place): depth-first order, neighbours ascending. The order is sequential by nature: one task walks the component."""
        component = self.components()
        own = component.where(F.col("id") == start).select("root")
        pairs = self.links().join(component.join(own, "root", "left_semi").select(F.col("id").alias("a")), "a", "left_semi")

        def walk(p: pd.DataFrame) -> pd.DataFrame:
            near = p.sort_values("b").groupby("a")["b"].apply(list).to_dict()
            seen, order, stack = set(), [], [(start, 0)]
            while stack:
                x, d = stack.pop()
                if x in seen:
                    continue
                seen.add(x)
                order.append((x, d, len(order)))
                if max_depth is None or d < max_depth:
                    stack += [(y, d + 1) for y in reversed(near.get(x, [])) if y not in seen]
            return pd.DataFrame(order, columns=["id", "depth", "place"])

        return pairs.select("a", "b", F.lit(1).alias("all")).groupBy("all").applyInPandas(walk, "id long, depth int, place int")

    def shortest_path(self, start: int, end: int) -> list[int]:
        """Nodes of a shortest undirected path with its ends; empty without one."""
        if start == end:
            return [start]
        tree = self.bfs(self.nodes.where(F.col("id") == start)).select("id", "parent")
        path, at = [end], end
        while at != start:  # one lookup per step of the path
            row = tree.where(F.col("id") == at).first()
            if row is None:
                return []
            at = row["parent"]
            path.append(at)
        return path[::-1]

    def paths(self, starts: DataFrame, max_depth: int, relation: Column | None = None) -> DataFrame:
        """(source, id, path, weight): all simple directed paths up to a number of edges, with their total weight."""
        edges = self.edges if relation is None else self.edges.where(relation)
        step = cut(edges.select("src", "dst", "weight"))
        level = starts.select(F.col("id").alias("source"), F.col("id"), F.array("id").alias("path"), F.lit(0.0).alias("weight"))
        out = None
        for _ in range(max_depth):
            x = level.join(step.withColumnRenamed("weight", "w"), level["id"] == step["src"]).where(~F.array_contains("path", F.col("dst")))
            level = cut(x.select("source", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight")))
            out = level if out is None else out.unionByName(level)
            if level.isEmpty():
                break
        return out

    # Algorithms.

    def components(self) -> DataFrame:
        """(id, root): the least id of each connected component, by label propagation with shortcuts to the label's label."""
        links = cut(self.links())
        label = cut(self.nodes.select("id", F.col("id").alias("root")))
        while True:
            near = links.join(label, links["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("m"))
            least = label.join(near, label["id"] == near["a"], "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
            jump = least.select(F.col("id").alias("r"), F.col("root").alias("further"))
            after = cut(least.join(jump, least["root"] == jump["r"]).select("id", "old", F.least("root", "further").alias("root")))
            if after.where("old <> root").isEmpty():
                return after.select("id", "root")
            label = after.select("id", "root")

    def degree_centrality(self) -> DataFrame:
        n = self.nodes.count()
        d = self.links().groupBy("a").count()
        j = self.nodes.select("id").join(d, F.col("id") == F.col("a"), "left")
        return j.select("id", (F.coalesce("count", F.lit(0)) / max(n - 1, 1)).alias("value"))

    def _by_tasks(self, links: DataFrame, f: Callable[[_Adjacency, int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What each of so many tasks, twice the cores, finds for its share of the sources: f(adjacency, task, tasks)."""
        spark = links.sparkSession
        tasks = 2 * spark.sparkContext.defaultParallelism
        packed = cut(links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).repartition(1).mapInArrow(_Adjacency.pack, "ids binary, start binary, near binary"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield from f(_Adjacency({x: b.column(x)[i] for x in ("ids", "start", "near")}), b.column("task")[i].as_py(), tasks)

        return spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task")).hint("shuffle_replicate_nl").crossJoin(packed).mapInArrow(run, schema)

    def closeness_centrality(self) -> DataFrame:
        """(reached nodes) / (sum of distances), 0 for a node that reaches none.

        Links go both ways, so what a node reaches is what reaches it: a task searches from its share of the sources, 64 to a word,
        and counts at each node. All pairs are looked at; a task's memory is that of the adjacency and of matrices of a fixed size.
        """
        links = cut(self.links())
        if links.count() > ADJACENCY_LINKS:
            reach = self.bfs(self.nodes.select("id"))
            return reach.groupBy(F.col("source").alias("id")).agg(F.coalesce(F.try_divide(F.count(F.lit(1)) - 1, F.sum("depth")), F.lit(0.0)).cast("double").alias("value"))

        def count(g: _Adjacency, task: int, tasks: int) -> Iterator[pa.RecordBatch]:
            reached, total = np.zeros((2, len(g.ids)), np.int64)
            for depth, new in g.levels(task, tasks):
                n = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
                reached += n
                total += depth * n
            yield pa.RecordBatch.from_arrays([pa.array(g.ids), pa.array(reached), pa.array(total)], ["id", "reached", "total"])

        sums = self._by_tasks(links, count, "id long, reached long, total long").groupBy("id").agg((F.sum("reached") / F.sum("total")).alias("value"))
        return self.nodes.select("id").distinct().join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def betweenness_centrality(self) -> DataFrame:
        """Brandes; summed over ordered pairs, times 2 / ((n - 1)(n - 2)).

        Each task has the adjacency (4 bytes a link) and its share of the sources, of which it follows so many at once that its matrices
        have a fixed size. The time is that of nodes times links times depths.
        """
        n = self.nodes.count()
        scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0

        def brandes(g: _Adjacency, task: int, tasks: int) -> Iterator[pa.RecordBatch]:
            m = len(g.ids)
            score = np.zeros(m)
            for sources in g.shares(task, tasks, max(1, min(64, MATRIX // (2 * m), -(-m // tasks)))):
                score += g.dependencies(sources)
            yield pa.RecordBatch.from_arrays([pa.array(g.ids), pa.array(score)], ["id", "value"])

        part = self._by_tasks(self.links(), brandes, "id long, value double").groupBy("id").agg((F.sum("value") * scale).alias("value"))
        return self.nodes.select("id").join(part, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def distances(self, sources: DataFrame) -> DataFrame:
        """(source, id, distance, parent): least total weight over undirected edges of weight 0 or more.

        Rounds of relaxation: each improves all nodes on the frontier at once.
        """
        return self._relax(sources, None, None)

    def a_star(self, sources: DataFrame, goal: int, heuristic: DataFrame) -> DataFrame:
        """(source, id, distance, parent) of one goal. heuristic (id, h): never more than the distance that is left.

        The relaxation follows only nodes whose distance and heuristic together are less than the best distance to the goal so far;
        nodes without a heuristic can't reach it.
        """
        return self._relax(sources, goal, heuristic.select("id", "h")).where(F.col("id") == goal)

    def _relax(self, sources: DataFrame, goal: int | None, heuristic: DataFrame | None) -> DataFrame:
        both = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(self.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
        links = cut(both.where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("w")))
        best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(None).cast("bigint").alias("parent")))
        frontier = best
        while True:
            step = frontier.join(links, frontier["id"] == links["a"]).select("source", F.col("b").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.col("a").alias("parent"))
            tried = step.groupBy("source", "id").agg(F.min(F.struct("distance", "parent")).alias("x")).select("source", "id", "x.distance", "x.parent")
            old = best.select("source", "id", F.col("distance").alias("old"))
            frontier = tried.join(old, ["source", "id"], "left").where("old is null or distance < old - 1e-12").drop("old")
            if heuristic is not None:
                bound = best.where(F.col("id") == goal).select("source", F.col("distance").alias("bound"))
                frontier = frontier.join(heuristic, "id").join(bound, "source", "left").where("bound is null or distance + h < bound").select("source", "id", "distance", "parent")
            frontier = cut(frontier)
            if frontier.isEmpty():
                return best
            best = cut(best.join(frontier.select("source", "id"), ["source", "id"], "left_anti").unionByName(frontier))

    def label_propagation(self, rounds: int) -> DataFrame:
        """(id, label): every round each node takes its neighbours' most frequent label, the least one of several."""
        links = cut(self.links())
        label = self.nodes.select("id", F.col("id").alias("label"))
        for _ in range(rounds):
            votes = links.join(label, links["b"] == label["id"]).groupBy("a", "label").count()
            w = Window.partitionBy("a").orderBy(F.desc("count"), "label")
            top = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("a", F.col("label").alias("new"))
            label = cut(label.join(top, label["id"] == top["a"], "left").select("id", F.coalesce("new", "label").alias("label")))
        return label

    def detect_communities(self, rounds: int = 10) -> DataFrame:
        """(community, members) by label propagation."""
        return self.label_propagation(rounds).groupBy(F.col("label").alias("community")).agg(F.count(F.lit(1)).alias("members"))

    def triangles(self) -> DataFrame:
        """(id, n): triangles through each node.

        Edges point from the node of fewer neighbours to that of more, so a node has at most about sqrt(2 * edges) of them and a hub
        makes no square of its neighbours.
        """
        links = cut(self.links())
        degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        ends = links.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("j")), "b")
        up = cut(ends.where("k < j or (k = j and a < b)").select("a", "b"))
        x, y, z = up.alias("x"), up.alias("y"), up.alias("z")
        t = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")))
        closed = F.least("z.a", "z.b") == F.col("x.b")
        t = t.join(z, closed & (F.greatest("z.a", "z.b") == F.col("y.b")))
        return t.select(F.explode(F.array("x.a", "x.b", "y.b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))

    def clustering(self) -> DataFrame:
        """Edges among the neighbours over the possible ones; 0 for fewer than two neighbours."""
        d = self.links().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("k"))
        j = self.nodes.select("id").join(d, "id", "left").join(self.triangles(), "id", "left")
        k = F.coalesce("k", F.lit(0))
        return j.select("id", F.when(k >= 2, F.coalesce("n", F.lit(0)) / (k * (k - 1) / 2)).otherwise(0.0).alias("value"))

    def average_clustering(self) -> DataFrame:
        return self.clustering().agg(F.avg("value").alias("value"))

    def is_connected(self) -> bool:
        return self.components().select("root").distinct().limit(2).count() <= 1

    def diameter(self) -> DataFrame:
        """The longest of the shortest paths between connected nodes, by the searches of closeness_centrality."""
        links = cut(self.links())
        if links.count() > ADJACENCY_LINKS:
            return self.bfs(self.nodes.select("id")).agg(F.max("depth").alias("diameter"))

        def longest(g: _Adjacency, task: int, tasks: int) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([max((depth for depth, _ in g.levels(task, tasks)), default=0)], pa.int32())], ["depth"])

        found = self._by_tasks(links, longest, "depth int").unionByName(self.nodes.limit(1).select(F.lit(0).alias("depth")))
        return found.agg(F.max("depth").alias("diameter"))

    def within(self, sources: DataFrame, distance: float) -> DataFrame:
        return self.distances(sources).where(F.col("distance") <= distance)

    def all_shortest_paths(self, start: int, end: int) -> DataFrame:
        """(path): every undirected path of the least number of edges."""
        tree = self.bfs(self.nodes.where(F.col("id") == start)).select("id", "depth")
        goal = tree.where(F.col("id") == end).first()
        links = self.links()
        level = tree.where(F.col("id") == start).select("id", F.array("id").alias("path"))
        for depth in range(1, (goal["depth"] if goal else 0) + 1):
            nxt = tree.where(F.col("depth") == depth).select(F.col("id").alias("b"))
            level = cut(level.join(links, level["id"] == links["a"]).join(nxt, "b", "left_semi").select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path")))
        return level.where(F.col("id") == end).select("path") if goal else level.limit(0).select("path")

    def k_shortest_paths(self, start: int, end: int, k: int, max_depth: int) -> DataFrame:
        """The k lightest simple directed paths of at most max_depth edges."""
        found = self.paths(self.nodes.where(F.col("id") == start), max_depth).where(F.col("id") == end)
        return found.orderBy("weight", "path").limit(k).select("path", "weight")
