"""Balanced label propagation: linked documents gather in shards whose row counts stay even.

Documents with the same text are linked.  Texts with many rows, whose number is bounded by the
number of shards, are packed first, the largest first, each whole where it fits; only a text that
fits in no shard is split, over as few shards as it needs.

The rows of all other texts start spread over the places left.  In each round a join tells every
group how its members are spread; rows outside the shard that most of them are in ask to go there.
What is granted is a flow between shards: a row may enter a shard that has room, or one that
another row leaves in the same round, along any cycle.  Every granted move joins more rows than it
parts, so rounds go on until none is granted.  Documents without links weigh nothing on the cut and
give way: in the end they fill the places that are left, which makes every quota exact.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import given_id, identified, numbered
from tidepanel.sources.storage import written

SHARDS, OVERHEAD = 40, 16
ROWS_PER_PIECE = 50_000
#: Texts of at least this part of a shard are packed whole: at most 2 x shards x PARTS texts.
PARTS = 16
#: Bands of agreement in which moves are granted.
BANDS = 8
#: Rounds in a row without a grant, each with other draws between shards of equal count, after which propagation ends.
IDLE = 3


def seated(docs: DataFrame) -> tuple[DataFrame, int]:
    """(seat, id, size, crc, text_key) with a gapless seat per row, written; and the number of rows."""
    text = F.coalesce("text", F.lit(""))
    rows = identified(docs, "text").select(
        "id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2("text", 256)).alias("text_key"),
    )
    rows = written(rows, "rows")
    n = rows.count()
    return written(numbered(rows, "seat", ["id", "crc", "size", "text_key"], pieces=1 + n // ROWS_PER_PIECE), "seats"), n


def packed(members: list[tuple[bytes, int]], quotas: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(text_key, from, to, shard): where the rows of every large text go, numbered from 0 within it.

    Largest first, each into the shard with the least room that holds it; a text that no shard holds
    fills the emptiest one and goes on with the rest of its rows.
    """
    room, out = list(quotas), []
    waiting = [(-n, key, 0) for key, n in members]
    while waiting:
        waiting.sort(reverse=True)  # few texts; the next one is the last
        less, key, at = waiting.pop()
        fits = [j for j, r in enumerate(room) if r >= -less]
        shard = min(fits, key=lambda j: (room[j], j)) if fits else max(range(len(room)), key=lambda j: (room[j], -j))
        took = min(-less, room[shard])
        out.append((key, at, at + took, shard))
        room[shard] -= took
        if took < -less:
            waiting.append((less + took, key, at + took))
    return out


def spread(rows: DataFrame, room: list[int], n: int, total: int) -> DataFrame:
    """``rows`` (seat, ...), ``total`` of them, with a shard each: evenly over the ``n`` places of ``room``."""
    ends = [sum(room[: j + 1]) for j in range(len(room))]
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    place = numbered(rows, "place", ["seat"], pieces=1 + total // ROWS_PER_PIECE)
    # Whole numbers only: place * n would pass a long at some 10^9 rows, and as doubles places could meet.
    gap, rest = (n // total, n % total) if total else (0, 0)
    at = F.col("place") * gap + F.expr(f"cast(cast(place as decimal(19,0)) * cast({rest} as decimal(19,0)) div {max(1, total)} as long)")
    return place.withColumn("place", at).withColumn(
        "shard", F.size(F.filter(bounds, lambda e: e <= F.col("place"))).cast("int")
    ).drop("place")


def flows(asked: dict[tuple[int, int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows granted per (source, target) of those ``asked`` for per (source, target, band), lower bands first.

    No target gains more than its room over what leaves it.  What is not granted lies on no cycle
    and on no way to a shard with room, so no single further grant is possible.
    """
    shards = len(room)
    left = [[0] * shards for _ in range(shards)]
    free, granted = list(room), {}

    def way(start: int) -> list[int] | None:
        """Shortest way over open requests from ``start`` to a shard with room or back to ``start``."""
        before, queue = {start: -1}, deque([start])
        while queue:
            here = queue.popleft()
            for there in range(shards):
                if not left[here][there]:
                    continue
                if there == start or (there not in before and free[there] > 0):
                    out = [there, here]
                    while before[out[-1]] >= 0:
                        out.append(before[out[-1]])
                    return out[::-1]
                if there not in before:
                    before[there] = here
                    queue.append(there)
        return None

    for band in sorted({b for _, _, b in asked}):
        for (source, target, b), n in asked.items():
            if b == band:
                left[source][target] += n
        again = True
        while again:
            again = False
            for start in range(shards):
                while (path := way(start)) is not None:
                    again = True
                    arcs = list(zip(path, path[1:]))
                    n = min(left[a][b] for a, b in arcs)
                    if path[-1] != start:
                        n = min(n, free[path[-1]])
                        free[path[-1]] -= n
                        free[start] += n
                    for a, b in arcs:
                        left[a][b] -= n
                        granted[a, b] = granted.get((a, b), 0) + n
    return granted


def _asked(tally: DataFrame, turn: int) -> DataFrame:
    """(text_key, shard, n, target, band, start): rows asking to join most of their text, numbered per way and band."""
    draw = F.xxhash64("text_key", "shard", F.lit(turn))
    wish = (
        tally.groupBy("text_key")
        .agg(F.max(F.struct("n", draw.alias("draw"), "shard")).alias("top"), F.sum("n").alias("total"))
        .where("top.n < total")
        .select(
            "text_key",
            F.col("top.shard").alias("target"),
            F.floor((1 - F.col("top.n") / F.col("total")) * BANDS).cast("int").alias("band"),
        )
    )
    return written(tally.join(wish, "text_key").where("shard <> target"), "asked")


def _granted(asked: DataFrame, room: list[int]) -> tuple[DataFrame, int]:
    """(text_key, shard, target, n, take) of the requests of which ``take`` > 0 rows may go; and the number of rows."""
    way = ["shard", "target", "band"]
    sums = asked.groupBy(*way).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("requests")).collect()  # shards^2 x BANDS at most
    may = flows({(r.shard, r.target, r.band): r.n for r in sorted(sums)}, room)
    if not may:
        return asked, 0
    limits = []
    for source, target in may:
        rest = may[source, target]
        for r in sorted((r for r in sums if (r.shard, r.target) == (source, target)), key=lambda r: r.band):
            limits.append((source, target, r.band, min(rest, r.n)))
            rest -= limits[-1][-1]
    limits = asked.sparkSession.createDataFrame(limits, "shard int, target int, band int, most long")
    pieces = 1 + max(r.requests for r in sums) // ROWS_PER_PIECE
    split = asked.join(F.broadcast(limits.where("most > 0")), way).withColumn(
        "piece", F.pmod(F.xxhash64("text_key", F.lit("piece")), F.lit(pieces)).cast("int")
    )
    first = Window.unboundedPreceding
    sizes = split.groupBy(*way, "piece").agg(F.sum("n").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy(*way).orderBy("piece").rowsBetween(first, -1))
    sizes = sizes.select(*way, "piece", F.coalesce(earlier, F.lit(0)).alias("before"))
    start = F.sum("n").over(Window.partitionBy(*way, "piece").orderBy("text_key").rowsBetween(first, -1))
    take = F.least("n", F.col("most") - F.col("before") - F.coalesce("start", F.lit(0)))
    moves = split.withColumn("start", start).join(sizes, [*way, "piece"]).withColumn("take", take)
    return written(moves.where("take > 0").select("text_key", "shard", "target", "n", "take"), "moves"), sum(may.values())


def propagated(units: DataFrame, quotas: list[int]) -> DataFrame:
    """``units`` (seat, text_key, shard, ...) after moves until none is granted.

    No shard ever holds more rows than its quota, if none does at first.
    """
    state = written(units, "units")
    turn = idle = 0
    while idle < IDLE:
        tally = written(state.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n")), "tally")
        load = {r.shard: r.n for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard
        asked = _asked(tally, turn)
        if asked.isEmpty():
            break
        moves, n = _granted(asked, [q - load.get(j, 0) for j, q in enumerate(quotas)])
        turn += 1
        idle = idle + 1 if n == 0 else 0
        if n == 0:
            continue
        moved = written(state.join(moves, ["text_key", "shard"], "left"), "moved")
        # Of a request granted in part, at most one per way, the first rows go.
        part = numbered(moved.where("take < n"), "rank", ["seat"], ["text_key", "shard"]).withColumn(
            "target", F.expr("if(rank < take, target, null)")
        )
        moved = moved.where("take is null or take = n").unionByName(part.drop("rank"))
        state = written(moved.withColumn("shard", F.coalesce("target", "shard")).select(*state.columns), "units")
    return state


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    Law ``rows``: the shards' row counts are at most one apart.  Size is the text's UTF-8 bytes
    plus 16.  Equal texts are linked; null texts have size 16, the checksum of nothing, and no
    link.  Repeated rows are rows of their own.  Slots count from 0 within a shard.  An empty table
    gives an empty table.
    """
    rows, n = seated(docs)
    quotas = [n // shards + (j < n % shards) for j in range(shards)]
    groups = rows.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.count(F.lit(1)).alias("members"))
    # Written apart, so that the join has a plain exchange on both sides and a hot text can be split.
    groups = written(groups.where("members > 1"), "groups")
    linked = written(rows.join(groups, "text_key"), "linked")
    is_large = F.col("members") * PARTS >= max(1, n // shards)
    large = groups.where(is_large).select("text_key", "members").collect()  # at most 2 x shards x PARTS texts
    parts = packed([(bytes(r.text_key), r.members) for r in large], quotas)
    room = list(quotas)
    for _, a, b, j in parts:
        room[j] -= b - a
    parts = docs.sparkSession.createDataFrame(
        [(bytearray(k), *x) for k, *x in parts], "text_key binary, first long, end long, shard int"
    )
    whole = numbered(linked.where(is_large), "place", ["seat"], ["text_key"], pieces=64 + n // ROWS_PER_PIECE)
    whole = whole.join(F.broadcast(parts), "text_key").where("place >= first and place < end")
    small = linked.where(~is_large)
    start = spread(small, room, sum(room), small.count())
    columns = [*rows.columns, "shard"]
    gathered = whole.select(*columns).unionByName(propagated(start, room).select(*columns))
    gathered = written(gathered, "gathered")
    single = rows.join(linked.select("seat"), "seat", "left_anti")
    load = {r.shard: r.n for r in gathered.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = [q - load.get(j, 0) for j, q in enumerate(quotas)]
    filled = spread(single, left, sum(left), sum(left)).select(*columns)
    placed = written(gathered.unionByName(filled), "placed")
    out = numbered(placed, "slot", ["seat"], ["shard"], pieces=1 + n // shards // ROWS_PER_PIECE)
    return out.select(
        given_id().alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
