"""Jaccard self-join of word n-gram sets with prefix filters under several global token orders.

A set of s n-grams can reach similarity t only with sets that have at least o = ceil(t*s) of its n-grams, so of its first s - o + l n-grams
under any order of all n-grams, l must be among the first ones of the other set. ``hashed`` orders n-grams by a seeded hash alone. Every
distinct text sends its first s - o + l n-grams under that order, with l a fixed share of s; they are counted exactly, and a text of which too
few are found elsewhere can't link. Of the texts that are left, all n-grams are counted exactly; what occurs in one text alone is in no
intersection, and a text with fewer than o n-grams that others have drops out too.

Three further orders rank what is left: by exact frequency, by the binary logarithm of the frequency, and shared n-grams in order of a
hash; ties fall by hashes of their own. Prefixes under the first (l = 1) become inverted lists; a pair from a list is a candidate only if its
sizes allow the similarity and its prefixes meet under the two others as well. What passes all filters is verified on the exact sets.

Texts with equal word sequences are one node. Components don't need every pair of a large group: in two rounds every list proposes the
pairs of one leader with the members outside the leader's component, and links found contract components. Then every pair of a list that
still lies in two components is tested, so no link between components is missed: in lists of few components as pairs; the nodes of longer
lists are dealt into blocks, and each two blocks meet in one task that filters and verifies with matrix products and returns a forest.

Every count is exact and moves each n-gram once, so work and disk grow as the input does. Bit sets of bounded size spare the shuffles what
they can rule out; when the data fill them up, results stay the same and at most all counted n-grams are moved.

Defined cases: null, empty and blank texts have an empty set and link with nothing; fewer than ``size`` words make one n-gram of the whole
sequence; a row with a null ``doc_id`` is scored but takes part in no component (null); rows that share a ``doc_id`` are separate rows;
repeated rows get the same component; ties don't matter, since a component is named by its smallest id; other columns, whatever their
names, are kept, except that those named as a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from attestry.llm.common import Scratch, bit_set, bounded_batches, utf8
from attestry.llm.components import components

#: Share of a set, in percent, that the hashed prefix is longer than the shortest one that loses no pair.
EXTRA = 15
#: Rounds of leaders; components of a list that are paired row by row; nodes and n-grams of one block.
ROUNDS, SHORT_LIST, BLOCK_NODES, BLOCK_GRAMS = 2, 16, 256, 400_000
#: Orders beside the first, whose prefixes a candidate must share.
OTHERS = ("p1", "p2")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer; one bijection for each seed."""
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX[0]
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The set of n-gram hashes (sorted)."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.frombuffer(hashlib.md5(b" ".join(words)).digest()[:8], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * _MIX[2] + h[i : i + n]
    return np.unique(_mixed(out, 2))


def normalized(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def node_of(words: list[bytes], seed: int) -> tuple[int, int]:
    """A 128-bit name of a word sequence, as two longs."""
    return struct.unpack("<qq", hashlib.md5(seed.to_bytes(4, "little") + b" ".join(words)).digest())


def needed(size: int, percent: int) -> int:
    """The least overlap that a set of ``size`` has with one it links with: ceil(t*s) in whole numbers."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int, least: int = 1) -> int:
    """How many of its first n-grams a set must look at, for ``least`` of them to be shared with every set it links with."""
    return size - needed(size, percent) + least


def shared_least(size: int, percent: int) -> int:
    """How many n-grams of the hashed prefix are shared with every set it links with; never falls as sets grow."""
    return max(1, min(EXTRA, percent) * size // 100)


def hashed(grams: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams under the seeded hash."""
    n = min(len(grams), prefix_length(len(grams), percent, shared_least(len(grams), percent)))
    return grams if n == len(grams) else grams[np.argpartition(_mixed(grams, 10), n - 1)[:n]]


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """Prefixes of shared n-grams by exact frequency, by its binary logarithm, and by a hash."""
    if length <= 0:
        return [grams[:0]] * 3
    ranks = [counts, np.log2(counts).astype(np.int64), np.zeros(len(grams), np.int64)]
    return [grams[np.lexsort((_mixed(grams, 20 + k), r))[:length]] for k, r in enumerate(ranks)]


def alike(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether two sets of ``n_a`` and ``n_b`` n-grams link; a and b hold those that more than one text has."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (n_a + n_b - common)


def _arrays(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


def _lists(found: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    return pa.array([None if x is None else x.view(np.int64) for x in found], pa.list_(kind))


class _Forest:
    """Links between nodes, kept as trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        return _arrays([(x, r) for x in self.parent if (r := self.root(x)) != x], [pa.int64(), pa.int64()], ["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int, text: str):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        bounded_batches(self.spark)
        self.scratch = Scratch(self.spark, "jaccard_join")
        self.rest = [c for c in docs.columns if c != text]
        self.docs = docs.select(F.struct(*self.rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8(text).alias("raw"))

    def measured(self) -> None:
        """One pass: every row's node and set size, and a hashed prefix a node (once a task). A second seed is tried should two word sequences share a node."""
        size, percent = self.size, self.percent
        row = dict(self.docs.dtypes)["row"]
        for seed in range(100):
            def measure(batches, seed=seed):
                seen: set[int] = set()  # no longer than the task's rows
                for b in batches:
                    rows, prefixes = [], []
                    for doc_id, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                        words = normalized(raw)
                        grams = shingles(words, size)
                        node, check = node_of(words, seed) if words else (None, None)
                        rows.append((node, check, len(grams)))
                        fresh = node is not None and doc_id is not None and node not in seen
                        seen.add(node)
                        prefixes.append(hashed(grams, percent) if fresh else None)
                    new = _arrays(rows, [pa.int64(), pa.int64(), pa.int64()], ["node", "check", "n"])
                    yield pa.RecordBatch.from_arrays([*b.columns[:2], *new.columns, _lists(prefixes, pa.int64())], names=["row", "doc_id", "node", "check", "n", "prefix"])

            found = self.scratch.write(self.docs.mapInArrow(measure, f"row {row}, doc_id long, node long, check long, n long, prefix array<long>"), f"measured-{seed}", "lz4")
            self.seed = seed
            if found.where("node is not null").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
                break
            self.scratch.drop(f"measured-{seed}")
        self.rows = self.scratch.write(found.drop("check", "prefix"), "rows")
        self.heads = found.where("prefix is not null").select("node", "n", "prefix")

    def suspects(self) -> DataFrame:
        """Nodes of which enough of the hashed prefix occurs elsewhere."""
        percent = self.percent
        tokens = self.heads.select(F.explode("prefix").alias("token"))
        shared = self.scratch.write(tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"), "shared")
        bits = bit_set(shared)

        def probable(batches):
            for b in batches:
                lists = b.column(1)
                token = lists.flatten().to_numpy()
                keep = bits.value.test(token)
                node = np.repeat(b.column(0).to_numpy(), lists.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(token[keep])], names=["node", "token"])

        hits = self.heads.select("node", "prefix").mapInArrow(probable, "node long, token long").join(shared, "token").groupBy("node").agg(F.count("*").alias("hits"))
        sizes = self.heads.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
        need = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
        least = F.greatest(F.lit(1), F.floor(need * min(EXTRA, percent) / F.lit(100)))  # shared_least of the smallest set that it can link with
        found = sizes.join(hits, "node").where(F.col("hits") >= least * F.col("copies")).select("node")
        found = self.scratch.write(found, "suspects")
        self.scratch.drop(f"measured-{self.seed}", "shared")
        return found

    def profiles(self, suspects: DataFrame) -> DataFrame:
        """Of each suspect that may still link: n, the n-grams that others have, and their prefixes under the three orders."""
        size, percent, seed, bits = self.size, self.percent, self.seed, bit_set(suspects)

        def sets(batches):
            seen: set[int] = set()
            for b in batches:
                nodes, found = [], []
                for raw in b.column(0).to_pylist():
                    words = normalized(raw)
                    if not words:
                        continue
                    node = node_of(words, seed)[0]
                    if node not in seen and bits.value.test(np.array([node]))[0]:
                        seen.add(node)
                        nodes.append(node)
                        found.append(shingles(words, size))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(found, pa.int64())], names=["node", "grams"])

        rows = self.docs.where("doc_id is not null").select("raw").mapInArrow(sets, "node long, grams array<long>")
        known = self.scratch.write(rows.join(suspects, "node", "left_semi").dropDuplicates(["node"]), "sets", "lz4")
        pairs = known.select("node", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
        counts = self.scratch.write(pairs.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "counts")
        own = pairs.join(counts, "gram").groupBy("node", "n").agg(F.collect_list(F.struct("gram", "times")).alias("grams"))  # no longer than the node's text
        own = own.where(F.size("grams") >= F.ceil(F.col("n") * percent / F.lit(100)))

        def rank(batches):
            for b in batches:
                out: list[list] = [[], [], [], []]
                n = b.column(1).to_numpy()
                for k in range(b.num_rows):
                    flat = b.column(2)[k].values.flatten()
                    grams, times = flat[0].to_numpy().view(np.uint64), flat[1].to_numpy()
                    order = np.argsort(grams)
                    grams, times = grams[order], times[order]
                    # what one text alone has stands first under each of the orders
                    for into, x in zip(out, [grams, *ranked(grams, times, prefix_length(int(n[k]), percent) - (int(n[k]) - len(grams)))], strict=True):
                        into.append(x)
                short = [pa.array([(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in p], pa.list_(pa.int32())) for p in out[2:]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in out[0]], pa.binary()), _lists(out[1], pa.int64()), *short], names=["node", "n", "grams", "p0", *OTHERS])

        kinds = ", ".join(["node long, n long, grams binary, p0 array<long>", *(f"{p} array<int>" for p in OTHERS)])
        found = self.scratch.write(own.mapInArrow(rank, kinds), "profiles")
        self.scratch.drop("sets", "counts", "suspects")
        return found

    def listed(self, profiles: DataFrame) -> DataFrame:
        """Inverted lists of the first order's prefixes with at least two nodes: (token, node)."""
        rows = profiles.select(F.explode("p0").alias("token"), "node")
        shared = rows.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
        return self.scratch.write(rows.join(shared, "token"), "lists")

    def links(self, pairs: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
        """Filter and verify ``pairs`` (a, b): (a, b) of a spanning forest, task by task, of the links."""
        percent = self.percent
        slim = profiles.select("node", "n", *OTHERS)
        for side in ("a", "b"):
            pairs = pairs.join(slim.select([F.col(c).alias(f"{side}_{c}") for c in slim.columns]), F.col(side) == F.col(f"{side}_node"))
        keep = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
        for p in OTHERS:
            keep = keep & F.arrays_overlap(f"a_{p}", f"b_{p}")
        pairs = self.scratch.write(pairs.where(keep).select("a", "b", "a_n", "b_n"), f"{name}-pairs")
        sets = profiles.select("node", "grams")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("b_grams")), "b")

        def verify(batches):
            forest = _Forest()  # no larger than the task's pairs
            for batch in batches:
                for a, b, n_a, n_b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if forest.root(a) != forest.root(b) and alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n_a, n_b, percent):
                        forest.join(a, b)
            yield forest.batch()

        found = self.scratch.write(both.select("a", "b", "a_n", "b_n", "a_grams", "b_grams").mapInArrow(verify, "a long, b long"), f"{name}-links")
        self.scratch.drop(f"{name}-pairs")
        return found

    def block_links(self, members: DataFrame, profiles: DataFrame) -> DataFrame:
        """Forests of all links among nodes that long lists connect; ``members`` has token, node and comp."""
        percent = self.percent
        lead = members.groupBy("token").agg(F.min("node").alias("b"))
        groups = components(self.scratch, members.join(lead, "token").select(F.col("node").alias("a"), "b"), "blocks").withColumnRenamed("root", "group")
        dealt = groups.join(profiles.select("node", F.floor(F.length("grams") / 8).alias("held")), "node")
        totals = dealt.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("held") / BLOCK_GRAMS)).cast("int").alias("blocks"))
        dealt = dealt.select("group", "node").join(totals, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("group", "node", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(profiles.select("node", "n", "grams", *OTHERS), "node")

        def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """How many members each two sets have in common, from products of incidence matrices."""
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            keep = times[at] > 1  # what one set has alone is in no intersection
            _, at = np.unique(at[keep], return_inverse=True)
            owner, out = owner[keep], np.zeros((len(left), len(right)), np.float32)
            for first in range(0, int(at.max(initial=-1)) + 1, 4096):
                part = (at >= first) & (at < first + 4096)
                m = np.zeros((len(sets), 4096), np.float32)
                m[owner[part], at[part] - first] = 1
                out += m[left] @ m[right].T
            return out

        def meet(t: pa.Table) -> pa.Table:
            nodes, own = t["node"].to_numpy(), t["own"].to_numpy()
            low, high = t["low"][0].as_py(), t["high"][0].as_py()
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            n = t["n"].to_numpy().astype(np.int64)
            a, b = n[left][:, None], n[right][None, :]
            fits = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (nodes[left][:, None] != nodes[right][None, :])
            for p in OTHERS:
                if fits.any():
                    fits &= shared([np.unique(x) for x in t[p].to_numpy(zero_copy_only=False)], left, right) > 0
            forest = _Forest()
            if fits.any():
                common = shared([np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()], left, right).astype(np.int64)
                for i, j in zip(*np.nonzero(fits & (100 * common >= percent * (a + b - common))), strict=True):
                    forest.join(int(nodes[left[i]]), int(nodes[right[j]]))
            return pa.Table.from_batches([forest.batch()])

        return self.scratch.write(dealt.groupBy("group", "low", "high").applyInArrow(meet, "a long, b long"), "block-links")

    def joined(self) -> DataFrame | None:
        """(node, root) of all nodes that lists connect; None without any."""
        suspects = self.suspects()
        if suspects.isEmpty():
            return None
        profiles = self.profiles(suspects)
        lists = self.listed(profiles)
        if lists.isEmpty():
            return None
        roots = self.scratch.write(lists.select("node").distinct().withColumn("root", F.col("node")), "roots")
        tested, before = None, "roots"
        for turn in range(ROUNDS + 1):
            current = self.scratch.write(lists.join(roots.withColumnRenamed("root", "comp"), "node"), f"current-{turn}")
            pick = F.min_by if turn % 2 == 0 else F.max_by
            per = current.groupBy("token").agg(F.count_distinct("comp").alias("comps"), pick(F.struct("comp", "node"), "node").alias("lead")).where("comps > 1")
            per = self.scratch.write(per, f"open-{turn}")
            if per.isEmpty():
                break
            if turn < ROUNDS:
                pairs = current.join(per, "token").where("comp <> lead.comp").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
            else:
                short = current.join(per.where(F.col("comps") <= SHORT_LIST).select("token"), "token")
                # a list of few components may still have many members; then it counts as long
                sides = self.scratch.write(short.select("token", "node", "comp"), "short")
                sizes = sides.groupBy("token").agg(F.count("*").alias("n"))
                long = per.where(F.col("comps") > SHORT_LIST).select("token").unionByName(sizes.where(F.col("n") > 4 * SHORT_LIST).select("token"))
                long = self.scratch.write(long, "long")
                sides = sides.join(long, "token", "left_anti")
                other = sides.select("token", F.col("node").alias("b"), F.col("comp").alias("b_comp"))
                pairs = sides.join(other, "token").where((F.col("node") < F.col("b")) & (F.col("comp") != F.col("b_comp"))).select(F.col("node").alias("a"), "b").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = self.scratch.write(pairs, f"new-{turn}")
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = self.links(pairs, profiles, f"round-{turn}")
            if turn == ROUNDS:
                links = links.unionByName(self.block_links(current.join(long, "token"), profiles))
            named = roots.select(F.col("node").alias("_n"), "root")
            for side in ("a", "b"):
                links = links.join(named, links[side] == named["_n"]).drop(side, "_n").withColumnRenamed("root", side)
            merged = components(self.scratch, links, f"round-{turn}")
            moved = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            roots = self.scratch.write(roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), f"roots-{turn}")
            self.scratch.drop(before, f"current-{turn}", f"open-{turn}", f"round-{turn}-links")
            before = f"roots-{turn}"
        return roots

    def run(self) -> DataFrame:
        """row, n, component_id and group_id of every row."""
        self.measured()
        roots = self.joined()
        rows = self.rows
        rows = rows.withColumn("comp", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        smallest = rows.where("comp is not null and doc_id is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
        found = rows.join(smallest, "comp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
        found = self.scratch.write(found.select("row", "n", "component_id", F.col("comp").alias("group_id")), "result")
        self.scratch.drop("rows", "profiles", "lists", "short", "long", "block-links", *(f"{x}-{k}" for x in ("new", "roots", "current", "open") for k in range(ROUNDS + 1)), "roots")
        return found


def jaccard_components(docs: DataFrame, size: int, percent: int, text: str = "text", keep_group: bool = False) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id`` in place of the text; links need ``percent`` / 100 of the union in common.

    ``docs`` has a ``doc_id``. ``keep_group`` adds ``group_id``, the component's own name, which tells rows of one doc_id in different
    components apart (null: empty set).
    """
    own = {"n_shingles": F.col("n"), "component_id": F.col("component_id")} | ({"group_id": F.col("group_id")} if keep_group else {})
    found = _Join(docs, size, percent, text)
    kept = [F.col("row").getField(c).alias(c) for c in found.rest if c.lower() not in own]
    return found.run().select(*kept, *(c.alias(k) for k, c in own.items()))
