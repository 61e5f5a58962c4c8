"""Mixing sources to target weights.

Documents with one and the same text may stand in several sources.  Texts are aggregated by membership
pattern, the set of target sources they stand in; a min-cost flow routes the tokens of each pattern to the
quotas of its sources, where every further use of a text costs one more than the last (convex), up to each
source's cap.  The total is the largest that all sources with any text can fill in the target shares, unless
a smaller one is given.  Within a pattern, texts in the order of a seeded hash form a tape that is read round
and round; each source takes its stretch of it, so that no text exceeds its cap and shares are met to within
one text per pattern and source.

The flow sees patterns, not documents; their number is checked, and cumulative sizes are summed per hash
bucket before they are joined, so that one pattern may hold any share of the rows.

Defined results: null and empty texts have no tokens and are never used; sources without a target are left
out; a target source without texts gets share 0 and the others keep their proportions; null sources count as
without a target.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_PATTERNS = 20_000
ROWS = 200_000  # texts of one pattern whose sizes are summed in one group


class Flow:
    """Min-cost flow by successive cheapest paths; capacities are whole tokens."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(p)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> int:
        total = 0
        while True:
            best, via, queued = {start: 0}, {}, {start}
            queue = deque([start])
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    if self.left[e] > 0 and best[a] + self.cost[e] < best.get(self.to[e], 1 << 60):
                        best[self.to[e]] = best[a] + self.cost[e]
                        via[self.to[e]] = e
                        if self.to[e] not in queued:
                            queued.add(self.to[e])
                            queue.append(self.to[e])
            if end not in via:
                return total
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            push = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= push
                self.left[e ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(tokens routed, tokens of each pattern that go to each source) for quotas that add up to `total`."""
    sources, keys = sorted(shares), sorted(patterns)
    flow = Flow(2 + len(keys) + len(sources))
    at_source = {s: 2 + len(keys) + i for i, s in enumerate(sources)}
    arcs = {}
    for i, p in enumerate(keys):
        for use in range(sum(repeats[s] for s in p)):
            flow.arc(0, 2 + i, patterns[p], use)
        for s in p:
            arcs[p, s] = flow.arc(2 + i, at_source[s], patterns[p] * repeats[s])
    for s in sources:
        flow.arc(at_source[s], 1, math.floor(shares[s] * total))
    done = flow.run(0, 1)
    return done, {k: flow.left[e ^ 1] for k, e in arcs.items() if flow.left[e ^ 1]}


def solve(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(total, routes): the largest total that keeps all shares, or the given one if it can be met."""
    live = {s for p, n in patterns.items() if n for s in p if shares.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    merged: dict[tuple[str, ...], int] = {}
    for p, n in patterns.items():
        kept = tuple(sorted(s for s in p if s in live))
        if kept and n:
            merged[kept] = merged.get(kept, 0) + n
    if not live:
        return 0, {}
    whole = sum(shares[s] for s in live)
    weights = {s: shares[s] / whole for s in live}
    caps = {s: repeats[s] for s in live}

    def feasible(t: int) -> bool:
        return route(merged, weights, caps, t)[0] >= sum(math.floor(weights[s] * t) for s in live)

    high = min(math.floor(sum(n * caps[s] for p, n in merged.items() if s in p) / weights[s]) for s in live)
    if total is not None:
        high = min(high, total)
    low = 0
    if feasible(high):
        low = high
    while high - low > max(1, high // 10_000):
        mid = (low + high) // 2
        low, high = (mid, high) if feasible(mid) else (low, mid)
    return low, route(merged, weights, caps, low)[1]


def texts_of(docs: DataFrame, sized: DataFrame, targets: Sequence[str], key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(digest, n_tokens, members): distinct texts of the target sources, with one document for each source they stand in."""
    keyed = docs.where(F.col(source).isin(list(targets)) & (F.coalesce(F.length(text), F.lit(0)) > 0)).select(key, F.col(source).alias("source"), F.sha2(text, 256).alias("digest"))
    single = keyed.join(sized.select(key, "n_tokens"), key).groupBy("digest", "source").agg(F.min(key).alias("doc"), F.max("n_tokens").alias("n_tokens"))
    members = F.array_sort(F.collect_list(F.struct("source", F.col("doc").alias("doc"))))
    return single.groupBy("digest").agg(members.alias("members"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0").withColumn("pattern", F.concat_ws("\x1f", F.col("members.source")))


def mix(spark: SparkSession, docs: DataFrame, sized: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((source, doc_id, n_tokens, n_uses), (source, target_share, actual_share, …)): the mixture, and the shares reached."""
    goals = {r.source: (r.target_share, r.max_repeats) for r in targets.collect()}  # one row per source
    texts = texts_of(docs, sized, list(goals)).persist()
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources")
    patterns = {tuple(r.pattern.split("\x1f")): r.tokens for r in sums}
    reached, routes = solve(patterns, {s: g[0] for s, g in goals.items()}, {s: g[1] or 0 for s, g in goals.items()}, total)
    stretches, start = [], {}
    live = {s for _, s in routes}
    for (p, s), tokens in sorted(routes.items()):
        for full in (q for q in patterns if tuple(sorted(x for x in q if x in live)) == p):
            # Patterns that differ only in sources out of play share the route in proportion to their tokens.
            same = sum(n for q, n in patterns.items() if tuple(sorted(x for x in q if x in live)) == p)
            part = tokens * patterns[full] // same
            begin = start.get(full, 0)
            stretches.append(("\x1f".join(full), s, begin, begin + part, patterns[full]))
            start[full] = (begin + part) % patterns[full] if part else begin
    plan = spark.createDataFrame(stretches or [("", "", 0, 0, 1)], "pattern string, source string, begin long, end long, tape long")
    # The leading bits of the hash part a pattern into groups, as many as its largest number of texts asks for.
    bits = max((r.n for r in sums), default=0) // ROWS
    hashed = texts.withColumn("_h", F.xxhash64(F.lit(seed), "digest")).withColumn("_b", F.shiftright("_h", 64 - bits.bit_length()) if bits else F.lit(0).cast("long"))
    per = hashed.groupBy("pattern", "_b").agg(F.sum("n_tokens").alias("_s"))
    before = per.withColumn("_before", F.sum("_s").over(Window.partitionBy("pattern").orderBy("_b")) - F.col("_s")).drop("_s")
    within = F.sum("n_tokens").over(Window.partitionBy("pattern", "_b").orderBy("_h", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = hashed.withColumn("_in", within).join(before, ["pattern", "_b"]).withColumn("at", F.col("_in") + F.col("_before"))
    taken = placed.join(F.broadcast(plan), "pattern")  # one row per pattern and source of it, of MOST_PATTERNS patterns at most
    # Times that the text's place on the endless tape falls into the stretch [begin, end).
    rounds = lambda x: F.floor((x - F.col("at") + F.col("tape") - 1) / F.col("tape"))
    uses = (rounds(F.col("end")) - rounds(F.col("begin"))).cast("int")
    doc = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["doc"]
    chosen = taken.withColumn("n_uses", uses).where("n_uses > 0").select("source", doc.alias("doc_id"), F.col("n_tokens"), "n_uses")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count("*").alias("n_texts"), F.max("n_uses").alias("most_uses"))
    all_ = got.agg(F.sum("tokens").alias("all"))
    shares = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(all_))  # one row on that side
    return chosen, shares.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
