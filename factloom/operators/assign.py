"""One-to-one assignment, clustering and packing inside components: what SQL can't say, run on small components in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import ROUNDS, components, unsettled
from factloom.session import written

#: Rows and columns of a component up to which the best assignment is found; beyond, the greedy one.
DENSE = 128


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a heaviest one-to-one assignment of positive weights, by shortest augmenting paths."""
    rows, cols = weights.shape
    # Every row may stay free by a column of its own that weighs nothing.
    cost = np.concatenate([-np.maximum(weights, 0), np.zeros((rows, rows))], axis=1)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = np.concatenate([[np.inf], cost[i0 - 1] - u[i0] - v[1:]])
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.where(used, np.inf, least).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, cols + 1) if match[j] and weights[match[j] - 1, j - 1] > 0)


def greedy_assignment(rows: list, cols: list, weights: list[float]) -> list[tuple]:
    """Heaviest pair first, then by row and column, as long as both are free."""
    taken_rows, taken_cols, out = set(), set(), []
    for w, r, c in sorted(zip(weights, rows, cols, strict=True), key=lambda x: (-x[0], x[1], x[2])):
        if w > 0 and r not in taken_rows and c not in taken_cols:
            taken_rows.add(r)
            taken_cols.add(c)
            out.append((r, c, w))
    return out


def _assign(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> list[tuple]:
    row_names, at_row = np.unique(rows, return_inverse=True)
    col_names, at_col = np.unique(cols, return_inverse=True)
    grid = np.zeros((len(row_names), len(col_names)))
    grid[at_row, at_col] = weights
    return [(row_names[i], col_names[j], float(grid[i, j])) for i, j in best_assignment(grid)]


def _assign_sorted(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components that lie one after the other; the last one of a block may go on in the next. None has over DENSE * DENSE edges."""
    rest = None
    for block in chain(blocks, [None]):
        held = block if rest is None else rest if block is None else pd.concat([rest, block], ignore_index=True)
        if held is None or held.empty:
            continue
        part, row, col, weight = (held[c].to_numpy() for c in ("component", "row", "col", "weight"))
        starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1)]
        ends = [*starts[1:], len(held)]
        if block is not None:
            rest = held.iloc[starts.pop() :]
        found = [pair for i, j in zip(starts, ends, strict=False) for pair in _assign(row[i:j], col[i:j], weight[i:j])]
        yield pd.DataFrame(found, columns=["row", "col", "weight"])


def _greedy_rounds(edges: DataFrame) -> DataFrame:
    """What greedy_assignment finds, without gathering a component: an edge that comes first at both its ends is taken, in rounds, until no edge is left."""
    first = F.min(F.struct((-F.col("weight")).alias("cost"), "row", "col")).alias("e")
    left, taken = written(edges.select("row", "col", "weight")), []
    for _ in range(ROUNDS):
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken, left)
        by_row, by_col = (left.groupBy(end).agg(first).select("e.row", "e.col", (-F.col("e.cost")).alias("weight")) for end in ("row", "col"))
        both = written(by_row.join(by_col, ["row", "col"], "left_semi"))
        taken.append(both)
        left = written(left.join(both.select("row"), "row", "left_anti").join(both.select("col"), "col", "left_anti"))
    raise unsettled("greedy assignment")


def assign(edges: DataFrame) -> DataFrame:
    """(row, col, weight) of a heaviest assignment of edges (row string, col string, weight double), component by component.

    Of repeated edges the heaviest counts; edges without a positive weight are never taken. Components of more than DENSE rows or columns
    get the greedy assignment (by weight, row and column), found in rounds over the whole table; the others are solved exactly.
    """
    best = written(edges.filter("weight > 0 and not isnan(weight)").groupBy("row", "col").agg(F.max("weight").alias("weight")))
    row_node = F.concat(F.lit("r:"), "row")
    parts = written(components(best.select(row_node.alias("src"), F.concat(F.lit("c:"), "col").alias("dst"))))
    sizes = parts.groupBy("component").agg(F.count_if(F.col("node").startswith("r:")).alias("rows"), F.count_if(F.col("node").startswith("c:")).alias("cols"))
    large = written(sizes.filter(F.greatest("rows", "cols") > DENSE).select("component"))
    keyed = best.join(parts.withColumnRenamed("node", "_node"), row_node == F.col("_node")).select("component", "row", "col", "weight")
    small = keyed if large.isEmpty() else keyed.join(large, "component", "left_anti")
    solved = small.repartition("component").sortWithinPartitions("component").mapInPandas(_assign_sorted, "row string, col string, weight double")
    return solved if large.isEmpty() else solved.unionByName(_greedy_rounds(keyed.join(large, "component", "left_semi")))


def _louvain(block: pd.DataFrame) -> pd.DataFrame:
    """One level: each node in turn joins the neighbouring community that raises modularity most; ties go to the least community."""
    links: dict[str, dict[str, float]] = {}
    for a, b, w in block[["src", "dst", "weight"]].itertuples(index=False):
        for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
            links.setdefault(x, {})
            links[x][y] = links[x].get(y, 0.0) + w
    degree = {x: sum(n.values()) + n.get(x, 0.0) for x, n in links.items()}
    total = sum(degree.values())
    community = {x: x for x in links}
    mass = dict(degree)
    for _ in range(100):
        moved = False
        for x in sorted(links):
            own = community[x]
            mass[own] -= degree[x]
            to: dict[str, float] = {own: 0.0}
            for y, w in links[x].items():
                if y != x:
                    to[community[y]] = to.get(community[y], 0.0) + w
            best = min(to, key=lambda c: (-(to[c] - mass[c] * degree[x] / total), c != own, c))
            community[x] = best
            mass[best] = mass.get(best, 0.0) + degree[x]
            moved |= best != own
        if not moved:
            break
    names: dict[str, str] = {}
    for x in sorted(community):
        names.setdefault(community[x], x)
    return pd.DataFrame({"node": list(community), "community": [names[c] for c in community.values()]})


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community) of weighted edges (src string, dst string, weight double); communities are named by their least node."""
    parts = components(edges).withColumnRenamed("node", "src")
    return edges.join(parts, "src").groupBy("component").applyInPandas(_louvain, "node string, community string")


def _packed(limit: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        bins, held, k = [], 0, 0
        for size in block["size"]:
            if held and held + size > limit:
                k, held = k + 1, 0
            held += size
            bins.append(k)
        return pd.DataFrame({"scope": block["scope"], "place": block["place"], "bin": bins})

    return run


def pack_in_order(items: DataFrame, limit: int) -> DataFrame:
    """(scope, place, bin) for items (scope string, place long, size long) of each scope in order; a new bin when the next doesn't fit."""
    return items.groupBy("scope").applyInPandas(_packed(limit), "scope string, place long, bin long")


def _budgeted(limit: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block, left, keep = block.sort_values(["rank", "item"]), limit, []
        for size in block["size"]:
            keep.append(size <= left)
            left -= size if keep[-1] else 0
        return block[keep][["scope", "item", "rank", "size"]]

    return run


def within_budget(items: DataFrame, limit: int) -> DataFrame:
    """Items (scope string, item string, rank long, size long) taken by rank as long as they fit; one that doesn't is passed over."""
    return items.groupBy("scope").applyInPandas(_budgeted(limit), "scope string, item string, rank long, size long")


def _distinct_greedy(block: pd.DataFrame) -> pd.DataFrame:
    taken, keep = set(), []
    block = block.sort_values(["score", "subject"], ascending=[False, True])
    for name in block["name"]:
        keep.append(name not in taken)
        taken.add(name)
    return block[keep][["reference", "subject", "name", "score"]]


def distinct_names(proposals: DataFrame) -> DataFrame:
    """Of a reference's proposals (reference, subject, name, score), strongest first, those whose name is still free."""
    return proposals.groupBy("reference").applyInPandas(_distinct_greedy, "reference string, subject string, name string, score double")
