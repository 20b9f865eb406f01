"""Exact top-k search by inner product in an M-tree whose pages are rows of a table.

Vectors become points of a metric space by one more component, sqrt(M - |x|^2) with M the largest squared norm: the Euclidean distance
from (q, 0) is sqrt(|q|^2 + M - 2 q.x), so the nearest points have the largest products. The tree has three levels: regions
around pivots (a bounded sample; large regions are dealt into several subtrees), pages of bounded size within a
subtree, and their entries. Each node keeps its routing point, covering radius and distance to its parent; each entry
its distance to the routing point. A query first searches its own region; the k-th score found there then rules out
regions, pages (taken best first) and entries by the triangle inequality.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import saved

#: Pivots at most, vectors for each, vectors in a subtree and in a page, about, and queries searched together.
PIVOTS, REGION, SUBTREE, PAGE, BLOCK = 256, 1024, 8192, 128, 4096
#: Distances are floating point; bounds give way by this part of them.
SLACK = 1e-7
#: Scaled components and squared lengths stay below; from EXACT on, products are summed as whole numbers, as floating point no longer is.
TOO_LARGE, TOO_LONG, EXACT = 2.0**32, 2.0**63, 2.0**53
#: As a score: none so far.
NONE = -(2**63)

PAGES = ("pivot int, part int, page int, routing array<long>, lift double, radius double, to_parent double, ids array<long>, "
         "vectors array<long>, distances array<double>")


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and the vector as whole numbers floor(scale * x); without nulls and vectors that hold null, NaN or infinity, or are so long
    that a product with one of like length does not fit 64 bits."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < TOO_LARGE))).where(
        F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1)) < TOO_LONG).select(
        "vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def _matrix(rows: pd.Series, size: int) -> np.ndarray:
    """Vectors as rows; short ones are filled with zeros."""
    out = np.zeros((len(rows), size))
    for at, row in enumerate(rows):
        out[at, :len(row)] = row
    return out


def _lifts(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0))


def _distances(points, lifts, others, other_lifts) -> np.ndarray:
    squares = ((points * points).sum(1) + lifts * lifts)[:, None] + (others * others).sum(1) + other_lifts * other_lifts
    return np.sqrt(np.maximum(squares - 2 * (points @ others.T + np.outer(lifts, other_lifts)), 0))


class Index:
    """The pages of a table of whole-number vectors. `build` covers every row."""

    def __init__(self, pages: DataFrame, pivots: np.ndarray, radii: np.ndarray, parts: np.ndarray, most: float):
        self.pages, self.pivots, self.radii, self.parts, self.most = pages, pivots, radii, parts, most
        self.lifts = _lifts(pivots, most)

    @staticmethod
    def build(vectors: DataFrame) -> Index | None:
        """None for an empty table."""
        norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size"), F.max(norm).alias("most")).first()
        if not row["n"]:
            return None
        size, most = row["size"], float(row["most"])
        number = max(1, min(PIVOTS, row["n"] // REGION))
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * number).toPandas()  # 2048 rows at most
        different = np.unique(_matrix(sample["vector"], size), axis=0)
        pivots = different[np.random.default_rng(0).permutation(len(different))[:number]]
        lifts = _lifts(pivots, most)

        def assign(batches):
            for rows in batches:
                if len(rows):
                    points = _matrix(rows["vector"], size)
                    found = _distances(points, _lifts(points, most), pivots, lifts)
                    at = found.argmin(1)
                    yield rows.assign(pivot=at.astype(np.int32), distance=found[np.arange(len(rows)), at])

        assigned = saved(vectors.mapInPandas(assign, "vec_id long, vector array<long>, pivot int, distance double"))
        counted = assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
        radii, parts = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
        for found in counted:  # a row for each pivot
            radii[found["pivot"]], parts[found["pivot"]] = found["radius"], -(-found["n"] // SUBTREE)
        many = F.create_map(*[F.lit(x) for at, n in enumerate(parts.tolist()) for x in (at, n)])
        dealt = assigned.withColumn("part", F.pmod(F.xxhash64("vec_id"), many[F.col("pivot")]).cast("int"))

        def page(rows: pd.DataFrame) -> pd.DataFrame:
            pivot = int(rows["pivot"].iloc[0])
            rows = rows.sort_values("vec_id", kind="stable")
            points, ids = _matrix(rows["vector"], size), rows["vec_id"].to_numpy()
            own = _lifts(points, most)
            # Order by nearest of a few routing points, then cut: pages stay of bounded size whatever repeats.
            step = max(1, len(rows) // max(1, len(rows) // PAGE))
            chosen = np.arange(0, len(rows), step)
            near = _distances(points, own, points[chosen], own[chosen]).argmin(1)
            order = np.argsort(near, kind="stable")
            out = []
            for first in range(0, len(order), PAGE):
                part = order[first:first + PAGE]
                middle = part[[np.abs(points[part] - points[part].mean(0)).sum(1).argmin()]]
                away = _distances(points[middle], own[middle], points[part], own[part])[0]
                up = _distances(points[middle], own[middle], pivots[[pivot]], lifts[[pivot]])[0, 0]
                out.append((pivot, rows["part"].iloc[0], len(out), points[middle[0]].astype(np.int64), own[middle[0]], away.max(), up,
                            ids[part], points[part].astype(np.int64).ravel(), away))
            return pd.DataFrame(out, columns=[field.split()[0] for field in PAGES.split(", ")])

        pages = saved(dealt.groupBy("pivot", "part").applyInPandas(page, PAGES))
        return Index(pages, pivots, radii, parts, most)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score: the k best of all rows with another id; ties go to the smaller vec_id.

        Equal (id, vector) queries are one; each different vector under an id is asked for itself, as `ask`.
        """
        size = self.pivots.shape[1]
        queries = saved(saved(queries.dropDuplicates(["vec_id", "vector"])).withColumn("ask", F.monotonically_increasing_id()))
        blocks = max(1, -(-queries.count() // BLOCK))
        pivots, lifts, radii, parts, most = self.pivots, self.lifts, self.radii, self.parts, self.most

        def visit(home: bool):
            def run(batches):
                for rows in batches:
                    if not len(rows):
                        continue
                    points = _matrix(rows["vector"], size)
                    away = _distances(points, np.zeros(len(rows)), pivots, lifts)
                    own = np.where(radii >= 0, away, np.inf).argmin(1)
                    chosen = np.zeros(away.shape, bool)
                    chosen[np.arange(len(rows)), own] = True
                    if not home:
                        reach = _reach(points, rows["least"].to_numpy(np.int64), most)
                        chosen = ~chosen & (radii >= 0) & (away - radii <= reach[:, None])
                    at, pivot = np.nonzero(chosen)
                    at, pivot = np.repeat(at, parts[pivot]), np.repeat(pivot, parts[pivot])
                    part = np.arange(len(at)) - np.maximum.accumulate(
                        np.where(np.append(True, (np.diff(at) != 0) | (np.diff(pivot) != 0)), np.arange(len(at)), 0)) \
                        if len(at) else at
                    yield rows.iloc[at].assign(up=away[at, pivot], pivot=pivot.astype(np.int32), part=part.astype(np.int32))

            return run

        def find(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return _search_subtree(pages, asked, k, size, most)

        def searched(asked: DataFrame, home: bool) -> DataFrame:
            spread = asked.mapInPandas(visit(home), "ask long, query_id long, vector array<long>, least long, up double, pivot int, part int")
            spread = spread.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int"))
            pages = self.pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            keys = ("pivot", "part", "block")
            return saved(pages.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(
                find, "ask long, query_id long, vec_id long, score long"))

        asked = queries.select("ask", F.col("vec_id").alias("query_id"), "vector", F.lit(NONE).cast("long").alias("least"))
        first = searched(asked, True)
        kth = _best(first, k).where(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
        rest = asked.join(kth, "ask", "left").select(
            "ask", "query_id", "vector", F.coalesce("kth", "least").alias("least"))
        return _best(first.union(searched(rest, False)), k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reach(points: np.ndarray, least: np.ndarray, most: float) -> np.ndarray:
    """The distance at which a score falls to `least`, and a little more; without end where there is none so far."""
    squares = (points * points).sum(1) + most
    some = least != NONE
    return np.sqrt(np.maximum(squares - 2 * np.where(some, least, 0).astype(float), 0)) * (1 + SLACK) + SLACK + np.where(some, 0, np.inf)


def _search_subtree(pages: pd.DataFrame, asked: pd.DataFrame, k: int, size: int, most: float) -> pd.DataFrame:
    """Best first: each query takes its pages in the order of their bounds, until none can hold a better entry."""
    empty = pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(pages) or not len(asked):
        return empty
    points, names = _matrix(asked["vector"], size), asked["query_id"].to_numpy()
    least = asked["least"].to_numpy(np.int64).copy()
    exact = most >= EXACT
    whole = points.astype(np.int64)
    # A page's routing point lies at least |d(query, pivot) - d(routing, pivot)| away: pages that this rules out cost no distance.
    least_away = np.abs(asked["up"].to_numpy(float)[:, None] - pages["to_parent"].to_numpy()) - pages["radius"].to_numpy()
    pages = pages[(least_away <= _reach(points, least, most)[:, None]).any(0)]
    if not len(pages):
        return empty
    routing, lifts = _matrix(pages["routing"], size), pages["lift"].to_numpy()
    away = _distances(points, np.zeros(len(points)), routing, lifts)
    bounds = np.maximum(away - pages["radius"].to_numpy(), 0)
    order = np.argsort(bounds, axis=1, kind="stable")
    entries = [(np.asarray(ids), np.asarray(flat, np.int64 if exact else float).reshape(len(ids), -1), np.asarray(distances)) for ids, flat, distances in
               zip(pages["ids"], pages["vectors"], pages["distances"], strict=True)]
    scores = np.full((len(points), k), NONE)
    ids = np.full((len(points), k), np.iinfo(np.int64).max)
    active = np.arange(len(points))
    for turn in range(len(pages)):
        page = order[active, turn]
        reach = _reach(points[active], least[active], most)
        going = bounds[active, page] <= reach
        active, page, reach = active[going], page[going], reach[going]
        if not active.size:
            break
        for one in np.unique(page):
            mine = active[page == one]
            near = reach[page == one]
            entry_ids, vectors, distances = entries[one]
            # An entry lies at least |d(query, routing) - d(entry, routing)| away.
            wanted = np.abs(away[mine, one][:, None] - distances) <= near[:, None]
            columns = np.flatnonzero(wanted.any(0))
            if not columns.size:
                continue
            found = whole[mine] @ vectors[columns].T if exact else (points[mine] @ vectors[columns].T).astype(np.int64)
            found[~wanted[:, columns] | (names[mine][:, None] == entry_ids[columns])] = NONE
            better = found.max(1) >= least[mine]
            mine, found = mine[better], found[better]
            if not mine.size:
                continue
            every = np.concatenate((scores[mine], found), 1)
            every_ids = np.concatenate((ids[mine], np.broadcast_to(entry_ids[columns], found.shape)), 1)
            best = np.lexsort((every_ids, ~every), axis=1)[:, :k]  # ~ turns the order, also of the least number
            scores[mine] = np.take_along_axis(every, best, 1)
            ids[mine] = np.take_along_axis(every_ids, best, 1)
            least[mine] = np.maximum(least[mine], scores[mine, -1])
    held = scores != NONE
    at, _ = np.nonzero(held)
    return pd.DataFrame({"ask": asked["ask"].to_numpy()[at], "query_id": names[at], "vec_id": ids[held], "score": scores[held]})


def top_k(vectors: DataFrame, queries: DataFrame | None, k: int, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k rows with the largest integer inner product.

    Both tables hold (id, vector); components count as floor(scale * x), and short vectors as if zeros followed. A query does not find rows with
    its own id. Null ids, null vectors and vectors with null or non-finite components take no part, nor do those whose scaled components reach
    2^32 or whose scaled length reaches 2^31.5, as their products do not fit 64 bits. Fewer rows than
    k: all of them. A row that is there twice is found twice, but asked for once; each different vector under one id is
    a query with ranks of its own. `queries` None: every row is one.
    """
    rows = saved(scaled(vectors, id_col, vector_col, scale))
    asked = rows if queries is None else scaled(queries, id_col, vector_col, scale)
    index = Index.build(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = index.pivots.shape[1]
    return index.search(asked.withColumn("vector", F.slice("vector", 1, size)), k)
