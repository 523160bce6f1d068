"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new."""

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import FILE, ROW, placed, ranked, shared


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a cheapest greatest flow,
    by cheapest augmenting paths with node potentials. Costs must not be negative."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for u, v, capacity, price in arcs:
        graph[u].append(len(to))
        to.append(v), room.append(capacity), cost.append(price)
        graph[v].append(len(to))
        to.append(u), room.append(0), cost.append(-price)
    high = [0.0] * n
    while True:
        far = [float("inf")] * n
        came: list[int] = [-1] * n
        far[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                step = d + cost[e] + high[u] - high[to[e]]
                if room[e] > 0 and step < far[to[e]] - 1e-9:
                    far[to[e]], came[to[e]] = step, e
                    heapq.heappush(heap, (step, to[e]))
        if came[sink] < 0:
            return [room[2 * i + 1] for i in range(len(arcs))]
        high = [h + f if f < float("inf") else h for h, f in zip(high, far)]
        v, most = sink, None
        while v != source:
            most = room[came[v]] if most is None else min(most, room[came[v]])
            v = to[came[v] ^ 1]
        v = sink
        while v != source:
            room[came[v]] -= most
            room[came[v] ^ 1] += most
            v = to[came[v] ^ 1]


def transfers(old: list[int], capacity: list[int], price: list[float] | None = None) -> list[tuple[int, int, int]]:
    """(old shard, new shard, amount) of a cheapest way to fit old shards' sizes into
    the new capacities. What stays costs nothing; what leaves shard i costs
    price[i] a unit (1 by default). Capacities must hold all."""
    if sum(capacity) < sum(old):
        raise ValueError("the new shards can't hold all")
    n, m = len(old), len(capacity)
    price = price or [1.0] * n
    s, t = n + m, n + m + 1
    arcs = [(s, i, old[i], 0.0) for i in range(n)] + [(n + j, t, capacity[j], 0.0) for j in range(m)]
    between = [(i, j) for i in range(n) for j in range(m)]
    arcs += [(i, n + j, old[i], 0.0 if i == j else float(price[i])) for i, j in between]
    flow = min_cost_flow(n + m + 2, arcs, s, t)[n + m :]
    return [(i, j, f) for (i, j), f in zip(between, flow) if f]


def capacities(total: int, shards: int, keep: list[float]) -> list[int]:
    """Row counts at most one apart; the shards of greatest ``keep`` get the odd rows."""
    base, odd = divmod(total, shards)
    keep = [*keep, *[0.0] * (shards - len(keep))]
    first = set(sorted(range(shards), key=lambda j: (-keep[j], j))[:odd])
    return [base + (j in first) for j in range(shards)]


KEY = "size", "id", "file", "row"


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


class Plan:
    """Where rows go: ``moves`` are (old shard, new shard, rows); ``cuts`` has, for
    each old shard, the first key (size, id, file, row) of each stretch of its rows
    in key order and the shard that stretch goes to. Both are as long as there are
    pairs of shards with a transfer, however many rows there are."""

    def __init__(self, moves, cuts, old_shard: Column, id_column: str):
        self.moves, self.cuts, self.old_shard, self.id_column = moves, cuts, old_shard, id_column
        self.touched = sorted({x for i, j, _ in moves if i != j for x in (i, j)})

    def assign(self, docs: DataFrame, *columns: str) -> DataFrame:
        """The named columns of docs, the row's place, size, old_shard and shard."""
        mine = {"_rs_size": size_of(), "_rs_id": F.col(self.id_column).cast("long"), "_rs_old": self.old_shard.cast("int")}
        rows = placed(docs.withColumns(mine), *columns, *mine)
        if not self.cuts:
            return rows.withColumnsRenamed({"_rs_size": "size", "_rs_old": "old_shard"}).withColumn("shard", F.lit(None).cast("int")).drop("_rs_id")
        kinds = dict(zip(KEY, ("long",) * 4))
        entry = lambda c: F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(KEY, c[:4])], F.lit(c[4]).alias("shard"))
        table = F.create_map(*[x for i, cs in self.cuts.items() for x in (F.lit(i), F.array(*map(entry, cs)))])
        key = F.struct(*[F.col(c).alias(k) for k, c in zip(KEY, ("_rs_size", "_rs_id", FILE, ROW))])
        at_or_before = F.filter(table[F.col("_rs_old")], lambda c: F.struct(*[c[k].alias(k) for k in KEY]) <= key)
        out = rows.withColumn("shard", F.element_at(at_or_before, -1)["shard"])
        return out.withColumnsRenamed({"_rs_size": "size", "_rs_old": "old_shard"}).drop("_rs_id")


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, id_column: str = "doc_id") -> Plan:
    """Plans how to spread rows over ``shards`` shards whose row counts differ by one
    at most, moving as few bytes as can be from where ``old_shard`` (0 to
    old_shards - 1, never null) says they lie.

    Rows leave a shard in order of size, smallest first, so the flow's amounts are
    moved at least cost; the odd rows of the counts go to the shards whose next row
    to move would be the largest. What comes to the driver is one row for each old
    shard and each transfer. Size is the UTF-8 length of the text (null: none) plus
    16. Null ids are least; rows alike in size and id are told apart by place, so
    repeated rows are moved like others. An empty table has an empty plan.
    """
    mine = {"_size": size_of(), "_id": F.col(id_column).cast("long"), "_old": old_shard.cast("int")}
    rows = ranked(placed(docs.withColumns(mine), *mine), ["_old"], ["_size", "_id", FILE, ROW])
    rows = rows.withColumnRenamed("_rank", "_at")
    counts = {r[0]: r[1] for r in rows.groupBy("_old").count().collect()}
    old = [counts.get(i, 0) for i in range(old_shards)]
    base = sum(old) // shards
    spark = docs.sparkSession
    at_rank = lambda pairs: {
        (r["_old"], r["_at"]): (r["_size"], r["_id"], r[FILE], r[ROW])
        for r in rows.join(spark.createDataFrame(pairs, "_old int, _at long"), ["_old", "_at"]).collect()
    }
    last = {i: k[0] for (i, _), k in at_rank([(i, n - base - 1) for i, n in enumerate(old) if n > base] or [(-1, 0)]).items()}
    moves = transfers(
        old,
        capacities(sum(old), shards, [float(last.get(i, 0)) for i in range(old_shards)]),
        [float(last.get(i, 1)) for i in range(old_shards)],
    )
    spans, done = [], [0] * old_shards
    for i, j, amount in sorted(moves, key=lambda x: (x[0], x[0] == x[1], x[1])):  # the largest rows stay
        spans.append((i, done[i], j))
        done[i] += amount
    keys = at_rank([s[:2] for s in spans] or [(-1, 0)])
    cuts: dict[int, list] = {}
    for i, at, j in spans:
        cuts.setdefault(i, []).append((*keys[i, at], j))
    return Plan(moves, cuts, old_shard, id_column)


def rewrite(docs: DataFrame, plan: Plan, out: str | None = None) -> DataFrame:
    """Writes every shard that gains or loses rows anew as Parquet files (shard=<n>/),
    rows in order of place, and returns all rows read back: docs' columns, then
    _at_file, _at_row, size, old_shard, shard. Shards that stay as they are aren't
    written; their rows come from docs. Columns of docs with one of these names give
    way to ours.
    """
    names = [c for c in docs.columns if c not in (FILE, ROW, "size", "old_shard", "shard")]
    rows = plan.assign(docs, *names)
    if not plan.touched:
        return rows
    changed = F.col("shard").isin(plan.touched)
    path = out or shared(docs.sparkSession)
    dealt = rows.where(changed).repartitionByRange("shard", FILE, ROW).sortWithinPartitions("shard", FILE, ROW)
    dealt.write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
    kept = [j for j in {j for _, j, _ in plan.moves} if j not in plan.touched]
    return back.unionByName(rows.where(F.col("shard").isin(kept))) if kept else back


def with_slots(df: DataFrame) -> DataFrame:
    """df with slot, gapless from 0 in each shard, by place. df should be narrow."""
    return ranked(df, ["shard"], [FILE, ROW]).withColumnRenamed("_rank", "slot")
