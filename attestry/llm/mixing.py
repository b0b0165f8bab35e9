"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from patterns to sources up to
the sources' targets; a pattern's k-th copy costs more than its (k-1)-th, so nothing is repeated while fresh text can still serve a
target. Every augmenting path leaves the origin once, hence costs as much as the copy it draws on: filling copy after copy with a
maximum flow is the successive shortest path method. The flow fixes how many tokens each pattern gives; documents are then chosen in
seeded hash order, whole, and a few documents at the boundary are fitted to what is left.

Only patterns reach the driver (``MAX_PATTERNS`` at most, else an error); documents are counted in ``BUCKETS`` hash buckets a pattern,
and one task sees keys and sizes of no more than one pattern's boundary buckets, no texts.

Defined cases: a document without sources is never taken; a null source is a source of its own, last in order; a size of null is 0;
equal hashes are ordered by id, size and a hash of the whole row; repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


WEIGHTS, SHARE, MAX_COPIES = (5, 2, 1), 1.5, 2
MAX_PATTERNS, BUCKETS, FIT_DOCS = 200_000, 4096, 256
SEED = 7
EPS = 1e-9


def water_fill(sizes: list[float], weights: list[float], total: float, most: float = MAX_COPIES) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again until none is above."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while active:
        per = left / sum(weights[i] for i in active)
        over = [i for i in active if per * weights[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
        left = max(left, 0.0)
    return out


def route(capacity: list[float], members: list[list[int]], targets: list[float], copies: int = MAX_COPIES) -> list[dict[int, float]]:
    """Per pattern, the tokens that go to each of its sources: a maximum flow of least repetition cost."""
    flow: list[dict[int, float]] = [dict.fromkeys(m, 0.0) for m in members]
    into: list[set[int]] = [set() for _ in targets]
    left, given = list(map(float, targets)), [0.0] * len(capacity)
    for k in range(1, copies + 1):
        # disjoint patterns need no search
        for p, m in enumerate(members):
            if len(m) == 1 and (x := min(k * capacity[p] - given[p], left[m[0]])) > 0:
                flow[p][m[0]] += x
                given[p] += x
                left[m[0]] -= x
                into[m[0]].add(p)
        while True:
            parent: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(len(members)) if members[p] and k * capacity[p] - given[p] > EPS * max(1.0, capacity[p])}
            queue, goal = deque(parent), None
            while queue and goal is None:
                kind, i = node = queue.popleft()
                following = [("s", s) for s in members[i]] if kind == "p" else [("p", p) for p in sorted(into[i]) if flow[p][i] > 0]
                for nxt in following:
                    if nxt not in parent:
                        parent[nxt] = node
                        if nxt[0] == "s" and left[nxt[1]] > EPS * max(1.0, targets[nxt[1]]):
                            goal = nxt
                            break
                        queue.append(nxt)
            if goal is None:
                break
            path = [goal]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            path.reverse()
            start = path[0][1]
            amount = min([k * capacity[start] - given[start], left[goal[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s")])
            for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                if ka == "p":
                    flow[a][b] += amount
                    into[b].add(a)
                else:
                    flow[b][a] -= amount
                    if flow[b][a] <= 0:
                        into[a].discard(b)
            given[start] += amount
            left[goal[1]] -= amount
    return flow


def source_order(names: set[str | None]) -> list[str | None]:
    return sorted((x for x in names if x is not None)) + [None] * (None in names)


_KEY = ("hash", "id", "size", "tie", "turn")


def _fit(group: pa.Table) -> pa.Table:
    """One pattern's boundary documents (keys and sizes alone) in seeded order: those that fit go in, then the one that brings the sum nearest."""
    group = group.take(pc.sort_indices(group, [(c, "ascending") for c in _KEY]))
    sizes, left = group["size"].to_numpy(), float(group["left"][0].as_py())
    more = np.zeros(len(sizes), np.int32)
    for i, s in enumerate(sizes):
        if s <= left:
            more[i], left = 1, left - s
    rest = np.flatnonzero(more == 0)
    if len(rest):
        i = rest[np.abs(sizes[rest] - left).argmin()]
        if abs(sizes[i] - left) < left:
            more[i] = 1
    return group.select(["pattern", *_KEY]).append_column("more", pa.array(more))


def mix(docs: DataFrame, id_col: str, size_col: str, members_col: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``copies`` (0 to ``copies``), ``source_size`` and ``target``.

    Sources in code point order weigh ``weights``, repeating, and share ``share`` of all sizes. ``source_size`` and ``target`` are those
    of the document's first source. Columns of these names are replaced; others are kept, whatever their names.
    """
    spark = docs.sparkSession
    names_kept = [c for c in docs.columns if c.lower() not in ("copies", "source_size", "target")]
    pattern = F.to_json(F.sort_array(F.array_distinct(F.coalesce(members_col, F.array().cast("array<string>"))), asc=False))
    docs = docs.select(F.struct(*names_kept).alias("row"), pattern.alias("_pattern"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_size"), F.col(id_col).cast("string").alias("_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_hash")).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    by_bucket = docs.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("sum"), F.count("*").alias("n"))

    found = docs.groupBy("_pattern").agg(F.sum("_size").alias("size")).orderBy("_pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    lists = [json.loads(r["_pattern"]) for r in found]
    names = source_order({s for m in lists for s in m})
    at = {s: i for i, s in enumerate(names)}
    members = [[at[s] for s in source_order(set(m))] for m in lists]
    sizes = [0.0] * len(names)
    for r, m in zip(found, members, strict=True):
        for s in m:
            sizes[s] += r["size"]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r["size"] for r in found), copies)
    plan = []
    for r, m, f in zip(found, members, route([float(r["size"]) for r in found], members, targets, copies), strict=True):
        size, given = r["size"], sum(f.values())
        base = min(copies, int((given + 0.5) // size)) if size else 0
        plan.append((r["_pattern"], base, max(0.0, given - base * size), int(sizes[m[0]]) if m else 0, targets[m[0]] if m else 0.0))
    kind = T.StructType([T.StructField("_pattern", T.StringType()), T.StructField("_base", T.IntegerType()), T.StructField("_rest", T.DoubleType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    plans = F.broadcast(spark.createDataFrame(plan, kind))  # MAX_PATTERNS rows at most

    w = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by_bucket.withColumns({"upto": F.sum("sum").over(w), "seen": F.sum("n").over(w)}).join(plans.select("_pattern", "_rest"), "_pattern").where("upto > _rest")
    first = F.min_by(F.struct("_bucket", (F.col("upto") - F.col("sum")).alias("before"), (F.col("seen") - F.col("n")).alias("earlier")), "_bucket").over(Window.partitionBy("_pattern"))
    edges = run.withColumn("f", first).where(F.col("seen") - F.col("n") < F.col("f.earlier") + FIT_DOCS)
    edges = edges.groupBy("_pattern").agg(F.min("_bucket").alias("_from"), F.max("_bucket").alias("_to"), F.first("f.before").alias("_before")).collect()  # a row a pattern
    kind = T.StructType([T.StructField("_pattern", T.StringType()), T.StructField("_from", T.IntegerType()), T.StructField("_to", T.IntegerType()), T.StructField("_before", T.LongType())])
    plans = F.broadcast(plans.join(spark.createDataFrame([tuple(r) for r in edges], kind), "_pattern", "left"))

    all_docs = docs.join(plans, "_pattern")
    inside = F.coalesce(F.col("_bucket").between(F.col("_from"), F.col("_to")) & (F.col("_rest") > 0), F.lit(False))
    extra = F.when((F.col("_rest") > 0) & (F.col("_bucket") < F.coalesce("_from", F.lit(BUCKETS))), 1).otherwise(0)
    columns = lambda more: [*(F.col("row").getField(c).alias(c) for c in names_kept), (F.col("_base") + more).cast("int").alias("copies"), "source_size", "target"]
    plain = all_docs.where(~inside).select(columns(extra))
    # boundary documents: keys and sizes are fitted; equal keys are told apart by what the rows hold, and equal rows by their turn
    key = {"pattern": "_pattern", "hash": "_hash", "id": "_id", "size": "_size", "tie": F.xxhash64(F.to_json("row"))}
    rows = all_docs.where(inside).select("row", "_base", "source_size", "target", (F.col("_rest") - F.col("_before")).alias("left"), *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in key.items()])
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    slim = rows.select("pattern", *_KEY, "left")
    kinds = ", ".join(f"{k} {dict(slim.dtypes)[k]}" for k in ("pattern", *_KEY))
    fitted = slim.groupBy("pattern").applyInArrow(_fit, f"{kinds}, more int").select(*[F.col(k).alias(f"f_{k}") for k in ("pattern", *_KEY)], "more")
    same = F.lit(True)
    for k in ("pattern", *_KEY):
        same = same & F.col(k).eqNullSafe(F.col(f"f_{k}"))
    return plain.unionByName(rows.join(fitted, same).select(columns(F.col("more"))))
