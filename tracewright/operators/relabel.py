"""Labels over small query graphs: the soft Markov field, bridges that part two sources, components.

A query holds seven components, so each group that Python sees is bounded; queries spread over executors."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SWEEPS, ROUNDS, STARTS, TOP = 50, 20, 3, 5


def _grouped(table: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distances and edges of each query, each in one row."""
    near = table.groupBy("query_id").agg(F.collect_list(F.struct("node_id", "parent", "fused")).alias("rows"))
    e = edges.groupBy("query_id").agg(F.collect_list(F.struct(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))).alias("edges"))
    return near.join(e, "query_id", "left")


def _read(row) -> tuple[dict, list]:
    evidence: dict = {}
    for r in row.rows:
        evidence.setdefault(r["node_id"], {})[r["parent"]] = r["fused"]
    links = row.edges if isinstance(row.edges, (list, tuple)) or hasattr(row.edges, "__len__") else []
    return evidence, sorted({(r["a"], r["b"]) for r in links if r["a"] != r["b"]})


def _neighbours(nodes, edges) -> dict:
    out = {n: set() for n in nodes}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def candidate_labels(evidence: dict, top: int) -> list:
    """The labels of least summed normalised rank, ties by label."""
    total: Counter = Counter()
    for d in evidence.values():
        ordered = sorted(d, key=lambda p: (d[p], p))
        for i, p in enumerate(ordered):
            total[p] += i / max(len(ordered) - 1, 1)
    return sorted(total, key=lambda p: (round(total[p], 12), p))[:top]


def energy(labels: dict, unary: dict, edges: list, cut: float, each: float) -> float:
    return sum(unary[n][labels[n]] for n in unary) + cut * sum(labels[a] != labels[b] for a, b in edges) + each * len({labels[n] for n in unary})


def settle(labels: dict, unary: dict, edges: list, names: list, cut: float, each: float) -> dict:
    """Iterated conditional modes: each node in turn takes the label of least energy, ties to the smaller."""
    near, used = _neighbours(labels, edges), Counter(labels[n] for n in unary)
    for _ in range(SWEEPS):
        moved = False
        for n in sorted(labels):
            own = int(n in unary)
            used[labels[n]] -= own
            change = lambda p: round((unary[n][p] if own else 0.0) + cut * sum(labels[m] != p for m in near[n]) + (each if own and not used[p] else 0.0), 12)  # noqa: B023, E731
            best = min(names, key=lambda p: (change(p), p))
            used[best] += own
            moved |= best != labels[n]
            labels[n] = best
        if not moved:
            break
    return labels


def markov(evidence: dict, edges: list, cut: float, each: float, top: int = TOP) -> tuple[dict, float]:
    """Labels of least energy over a start from each node's nearest label and single-label starts."""
    names = candidate_labels(evidence, top)
    unary = {n: {p: d[p] - min(d.values()) if p in d else 1.0 for p in names} for n, d in evidence.items()}
    start = {n: min(names, key=lambda p: (u[p], p)) for n, u in unary.items()}
    near = _neighbours(evidence, edges)
    waiting = sorted(set(near) - set(start))
    while waiting:  # nodes without evidence take their neighbours' commonest label
        rest = []
        for n in waiting:
            heard = Counter(start[m] for m in near[n] if m in start)
            if heard:
                start[n] = min(heard, key=lambda p: (-heard[p], p))
            else:
                rest.append(n)
        if len(rest) == len(waiting):
            start |= dict.fromkeys(rest, names[0])
            rest = []
        waiting = rest
    tried = [settle(s, unary, edges, names, cut, each) for s in (start, *({n: p for n in near} for p in names[:STARTS]))]
    best = min(tried, key=lambda s: round(energy(s, unary, edges, cut, each), 12))
    return best, energy(best, unary, edges, cut, each)


def bridges(nodes, edges: list) -> list[tuple[tuple, set]]:
    """Edges whose loss parts a component, each with the nodes on the far side (depth-first low points)."""
    near, seen, low, found = _neighbours(nodes, edges), {}, {}, []
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        path, members = [(root, None, iter(sorted(near[root])))], {root: {root}}
        while path:
            n, above, rest = path[-1]
            m = next(rest, None)
            if m is None:
                path.pop()
                if above is not None:
                    low[above] = min(low[above], low[n])
                    if low[n] > seen[above]:
                        found.append(((min(n, above), max(n, above)), set(members[n])))
                    members[above] |= members[n]
            elif m not in seen:
                seen[m] = low[m] = len(seen)
                members[m] = {m}
                path.append((m, n, iter(sorted(near[m]))))
            elif m != above:
                low[n] = min(low[n], seen[m])
    return sorted(found, key=lambda x: x[0])


def component_of(node, edges: list) -> set:
    near, out, todo = _neighbours([node], edges), {node}, [node]
    while todo:
        new = near[todo.pop()] - out
        out |= new
        todo += new
    return out


def preference(side: set, evidence: dict):
    """(parent, lead over the next) of least mean regret among parents that all of a side's nodes know."""
    known = [evidence[n] for n in sorted(side) if n in evidence]
    shared = set.intersection(*(set(d) for d in known)) if known else set()
    ranked = sorted((sum(d[p] - min(d.values()) for d in known) / len(known), p) for p in shared)
    return (ranked[0][1], ranked[1][0] - ranked[0][0] if len(ranked) > 1 else 1.0) if ranked else None


def pruned(evidence: dict, edges: list, least: float) -> tuple[list, list]:
    """(edges kept, cuts): bridges between sides of different parents go while both sides are sure enough."""
    edges, cuts = list(edges), []
    for _ in range(ROUNDS):
        now = []
        for (a, b), far in bridges(evidence, edges):
            whole = component_of(a, edges)
            left, right = (far, whole - far) if a in far else (whole - far, far)
            x, y = preference(left, evidence), preference(right, evidence)
            if x and y and x[0] != y[0] and min(x[1], y[1]) >= least:
                now.append((a, b, x[0], y[0], min(x[1], y[1])))
        if not now:
            break
        cuts += now
        gone = {(a, b) for a, b, *_ in now}
        edges = [e for e in edges if e not in gone]
    return edges, cuts


def _mapped(df: DataFrame, told, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def each(frames):
        for frame in frames:
            yield pd.DataFrame([(row.query_id, *r) for row in frame.itertuples() for r in told(*_read(row))], columns=names)

    return df.mapInPandas(each, schema)


def soft_graph(table: DataFrame, edges: DataFrame, cut: float, each: float) -> DataFrame:
    """(query_id, node_id, parent, energy) of the soft field over each query's edges."""

    def told(evidence, links):
        labels, cost = markov(evidence, links, cut, each)
        return [(n, labels[n], round(cost, 9)) for n in sorted(labels)]

    return _mapped(_grouped(table, edges), told, f"query_id {_type(table, 'query_id')}, node_id {_type(table, 'node_id')}, parent {_type(table, 'parent')}, energy double")


def bridge_cuts(table: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(query_id, node_a, node_b, left_parent, right_parent, confidence) of each edge that goes."""

    def told(evidence, links):
        return [(a, b, x, y, round(c, 9)) for a, b, x, y, c in pruned(evidence, links, least)[1]]

    n, p = _type(table, "node_id"), _type(table, "parent")
    return _mapped(_grouped(table, edges), told, f"query_id {_type(table, 'query_id')}, node_a {n}, node_b {n}, left_parent {p}, right_parent {p}, confidence double")


def hierarchical(table: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(query_id, node_id, component, parent): after pruning, each component takes its preferred parent."""

    def told(evidence, links):
        kept, out = pruned(evidence, links, least)[0], []
        for n in sorted(evidence):
            side = component_of(n, kept)
            found = preference(side, evidence)
            out.append((n, min(side), found[0] if found else None))
        return out

    n = _type(table, "node_id")
    return _mapped(_grouped(table, edges), told, f"query_id {_type(table, 'query_id')}, node_id {n}, component {n}, parent {_type(table, 'parent')}")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
