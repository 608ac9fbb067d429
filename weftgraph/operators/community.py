"""Communities by the Leiden method, with labels and cohesion."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import quote
from weftgraph.operators.components import connected_components
from weftgraph.storage import drop_table, held_setting, write_table

#: Folder names that say nothing about a community (fixed values).
GENERIC_FOLDERS = ["src", "lib", "core", "utils", "common", "shared", "helpers"]


def _pairs(edges: DataFrame) -> DataFrame:
    """Simple undirected links, each once: (u, v)."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.select(F.explode(both).alias("l")).select("l.u", "l.v")


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected links, both ways round: (u, v)."""
    return _both_ways(_pairs(edges))


#: A round of moves or a pass over all levels that adds less modularity is the last of its kind, and so is a level that adds less
#: than LEVEL_GAIN, and a round of the first pass that adds less than FIRST_GAIN: the passes after it take up what that leaves.
LEAST_GAIN, LEVEL_GAIN, FIRST_GAIN = 1e-4, 1e-6, 2e-3


def _written(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, Row]:
    """``df`` written, and aggregates of its rows that the same job gathers."""
    seen = Observation()
    out = write_table(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), label)
    return out, Row(**seen.get)


def _numbered(degree: DataFrame) -> DataFrame:
    """(name, k, node): nodes numbered from 0 in the order of their names, so that the lesser number has the lesser name."""
    row = F.monotonically_increasing_id()
    placed = write_table(degree.orderBy("node").select(F.col("node").alias("name"), "k", F.shiftright(row, 33).alias("at"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "numbers")
    before = F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("at").agg(F.count("*").alias("n")).select("at", F.coalesce(before, F.lit(0)).alias("start"))
    return write_table(placed.join(starts, "at").select("name", "k", (F.col("start") + F.col("row")).alias("node")), "numbers")


#: Links (each counted from both ends) that a task takes at once; the blocks grow with the input, a task does not.
BLOCK_LINKS = 1 << 20

#: Links of a row of a level's table, and links that are dealt to blocks at once.
FAN_LINKS, DEALT_LINKS = 512, 1 << 18

#: Orders in which the nodes of a graph of one block are gone through, each in a task of its own; the best result counts.
TRIES = 4

SENT = ["u", "v", "w", "c", "tot", "k", "d"]
MOVED = "node long, mine long, k long, d long, mine_tot long, inside long, to long, gain double, block int"
REFINED = "node long, part long, c long, k long, d long"


def _flat(column: pa.Array) -> np.ndarray:
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def _sent(batches: Iterator[pa.RecordBatch], r: int, blocks: int, tries: int, hubs: list[int]) -> Iterator[pa.RecordBatch]:
    """Where nodes are, sent over their links: rows (block, lists of SENT), where u is a neighbour of v in that block, which
    r changes, and the others are of v. A single block is sent ``tries`` times. To ``hubs`` only they themselves and sums (v
    below 0) are sent."""
    for b in batches:
        sizes = b.column("to").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // DEALT_LINKS)) + 1):
            of = np.repeat(part, sizes[part])
            if not len(of):
                continue
            x = b.slice(part[0], len(part))
            v, c, tot, k, d = (b.column(n).to_numpy()[of] for n in ("node", "c", "tot", "k", "d"))
            u, w = _flat(x.column("to")), _flat(x.column("w"))
            kept = (u == v) | (v < 0) | ~np.isin(u, hubs) if hubs else slice(None)
            columns = [y[kept] for y in (u, v, w, c, tot, k, d)]
            mixed = (columns[0].astype(np.uint64) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            block = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            found, starts = np.unique(block[order].astype(np.int64), return_index=True)
            cuts = pa.array(np.r_[starts, len(order)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(y[order])) for y in columns]
            for t in range(tries):
                yield pa.RecordBatch.from_arrays([pa.array((found + t).astype(np.int32)), *lists], names=["block", *SENT])


class _Block:
    """The links of a block's nodes, in order: neighbours and communities go by places 0, 1, ... in the order of their numbers."""

    def __init__(self, batches: list[pa.RecordBatch], *more: str):
        u, v, w, c, *rest = (np.concatenate([_flat(b.column(x)) for b in batches]) for x in ("u", "v", "w", "c", *more))
        order = np.lexsort((v, u))
        u, v, w, c = u[order], v[order], w[order], c[order]
        own, first = u == v, np.r_[True, u[1:] != u[:-1]]
        self.u, self.c, self.w, self.own, self.rest = u, c, w, own, [x[order] for x in rest]
        self.starts = np.flatnonzero(first)
        self.row_of = np.cumsum(first) - 1
        self.nodes, ids = u[self.starts], np.unique(v)
        self.at = np.searchsorted(ids, v)
        self.me = np.searchsorted(ids, self.nodes)
        self.node_at = np.full(len(ids), -1)
        self.node_at[self.me] = np.arange(len(self.nodes))
        self.free = np.where(own, 0, w)  # a link to itself goes along with its node

    def links(self) -> list[tuple[list[int], list[int]]]:
        at, w, ends = self.at.tolist(), self.free.tolist(), [*self.starts.tolist(), len(self.u)]
        return [(at[x:y], w[x:y]) for x, y in zip(ends, ends[1:])]


def _moved(batches: Iterator[pa.RecordBatch], two_m: float, resolution: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """Moves of a block's nodes, one after the other until none gains, while all other nodes stay: MOVED rows with the
    present community, its total and the weight inside, the one to go to, and in the first row what the block's moves
    add. Of a block that is the ``whole`` graph, they are those after the moves, made in an order that goes by the block's number."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    b = _Block(batches, "k", "d", "tot")
    # a node's own size comes with its link to itself
    (k, d), tot = (x[b.own] for x in b.rest[:2]), b.rest[2]
    names, c = np.unique(b.c, return_inverse=True)
    label, total = np.empty(len(b.node_at), np.int64), np.empty(len(names), np.int64)
    label[b.at], total[c] = c, tot
    before, before_total = label.copy(), total.copy()
    label, total, me, node_at, ks, links = label.tolist(), total.tolist(), b.me.tolist(), b.node_at.tolist(), k.tolist(), b.links()
    number = batches[0].column("block")[0].as_py()
    order = np.random.default_rng(number).permutation(len(me)) if whole and number else np.arange(len(me))
    todo, waits, gained = deque(order.tolist()), [True] * len(me), 0.0
    while todo:
        i = todo.popleft()
        waits[i] = False
        near, weights = links[i]
        own, size, sums = label[me[i]], ks[i], {}
        for x, w in zip(near, weights):
            sums[label[x]] = sums.get(label[x], 0) + w
        rate = resolution * size / two_m
        stay = max(sums[own] - rate * (total[own] - size), 0.0)
        best, aim = stay + 1e-9 * (1 + size), own
        for t, w in sums.items():
            gain = w - rate * total[t]
            if t != own and (gain > best or gain == best and t < aim != own):
                best, aim = gain, t
        if aim != own:
            gained += best - stay
            total[own] -= size
            total[aim] += size
            label[me[i]] = aim
            for x in near:
                j = node_at[x]
                if j >= 0 and not waits[j] and label[x] != aim:
                    waits[j] = True
                    todo.append(j)
    after = np.array(label, np.int64)
    now, sizes = (after, np.array(total, np.int64)) if whole else (before, before_total)
    mine, aims = now[b.me], after[b.me]
    inside = np.zeros(len(me), np.int64)
    np.add.at(inside, b.row_of, np.where(now[b.at] == mine[b.row_of], b.w, 0))
    gain = np.zeros(len(me))
    gain[0] = 0.0 if whole else gained
    columns = [b.nodes, names[mine], k, d, sizes[mine], inside, pa.array(names[aims], mask=aims == mine), gain]
    columns.append(np.full(len(me), number, np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "mine", "k", "d", "mine_tot", "inside", "to", "gain", "block"])


def _merged(batches: Iterator[pa.RecordBatch], two_m: float, resolution: float) -> Iterator[pa.RecordBatch]:
    """REFINED rows of whole communities (links inside them): a node that is alone joins, over a link, the part with the
    largest gain above 0, one after the other until none does. A part bears the name of its first node, which never leaves."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    b = _Block(batches, "k", "d")
    k, d = (x[b.starts] for x in b.rest)
    # the links' other ends are in the block too, so its nodes have the places 0, 1, ...
    part, links, ks, n = list(range(len(b.nodes))), b.links(), k.tolist(), [1] * len(b.nodes)
    total, todo, waits = list(ks), deque(range(len(ks))), [True] * len(ks)
    while todo:
        i = todo.popleft()
        waits[i] = False
        if n[part[i]] > 1:
            continue
        sums = {}
        for x, w in zip(*links[i]):
            sums[part[x]] = sums.get(part[x], 0) + w
        rate, best, aim = resolution * ks[i] / two_m, 1e-9 * (1 + ks[i]), i
        for t, w in sums.items():
            gain = w - rate * total[t]
            if t != i and (gain > best or gain == best and t < aim != i):
                best, aim = gain, t
        if aim != i:
            part[i] = aim
            n[i], n[aim] = 0, n[aim] + 1
            total[aim] += ks[i]
            for x in links[i][0]:
                if n[x] == 1 and part[x] == x and not waits[x]:
                    waits[x] = True
                    todo.append(x)
    columns = [b.nodes, b.nodes[part], b.c[b.starts], k, d]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "part", "c", "k", "d"])


class _Level(NamedTuple):
    """A graph, written as rows (node, k, d, to, w) of up to about FAN_LINKS links of a node to others and their weights, with
    its degree k and d, at least the number of its links, and a link from each node to itself that weighs what is inside it;
    the number of links, and the nodes of more than BLOCK_LINKS."""

    fans: DataFrame
    n: int
    hubs: list[int]

    def blocks(self) -> int:
        return max(1, -(-self.n // BLOCK_LINKS))

    def links(self) -> DataFrame:
        """(u, v, w, k, d)"""
        return self.fans.select(F.col("node").alias("u"), "k", "d", F.explode(F.arrays_zip("to", "w")).alias("l")).select("u", "l.to", "l.w", "k", "d").withColumnRenamed("to", "v")


def _level(links: DataFrame) -> _Level:
    """A level of links (u, v, w, k, d), with those of nodes to themselves."""
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("d") / FAN_LINKS))
    fans = links.groupBy(F.col("u").alias("node"), "k", "d", part.alias("part")).agg(F.collect_list(F.struct("v", "w")).alias("l"))
    fans, seen = _written(fans.select("node", "k", "d", F.col("l.v").alias("to"), F.col("l.w").alias("w")), "links", n=F.sum(F.size("to")), widest=F.max("d"))
    # no more than one in a block's links
    hubs = [r.node for r in fans.where(F.col("d") > BLOCK_LINKS).select("node").distinct().collect()] if (seen["widest"] or 0) > BLOCK_LINKS else []
    return _Level(fans, seen["n"] or 0, hubs)


def _of_hubs(level: _Level, label: DataFrame, placed: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """Rows (node, c, tot, k, d, to, w) that stand for all links of hubs to others: what goes to its own community and to the one of the largest gain."""
    mine = label.where(F.col("node").isin(level.hubs)).select(F.col("node").alias("u"), F.col("c").alias("mine"))
    far = level.links().where(F.col("u").isin(level.hubs) & (F.col("u") != F.col("v"))).join(placed.withColumnRenamed("node", "v"), "v")
    met = far.groupBy("u", "k", "c", "tot").agg(F.sum("w").alias("w")).join(mine, "u").withColumn("own", F.col("c") == F.col("mine"))
    gain = F.col("w") - resolution * F.col("k") * F.col("tot") / two_m
    best = met.groupBy("u", "own").agg(F.max(F.struct(gain.alias("g"), (-F.col("c")).alias("c"), "tot", "w")).alias("x"))
    none = F.lit(0).cast("long")
    return best.select((F.col("x.c") - 1).alias("node"), (-F.col("x.c")).alias("c"), "x.tot", none.alias("k"), none.alias("d"), F.array("u").alias("to"), F.array("x.w").alias("w"))


def _local_moves(level: _Level, label: DataFrame, two_m: float, resolution: float, least: float = LEAST_GAIN) -> tuple[DataFrame, float]:
    """Labels (node, c, k, d) after moves of single nodes, and their modularity.

    Nodes are dealt by hash into blocks of about BLOCK_LINKS links, anew in each round. The nodes of a block move one
    after the other, each to the neighbouring community of the largest gain (ties: the least name), while those of other
    blocks count as they were. Half the blocks move at once. Where that adds less than half of what they gain each by
    itself, because blocks are at cross purposes, half as many move next, in the end the one that gains most alone, and
    otherwise more; where the modularity falls, the labels before count again. Moves end when the blocks have less than
    LEAST_GAIN to gain, when one that moves alone does not add as much, or when a round adds, but less than ``least`` where that
    is more. A round is one written table: where each node is, where it would go, and what the modularity of the present
    labels is made of; a graph of one block needs a single round, in which TRIES orders are tried. Links of a node with
    more than a block's are summed by community before they go to its task."""
    best, share, told, alone, written, blocks = float("-inf"), 0.5, 0.0, False, [], level.blocks()
    tries = TRIES if blocks == 1 else 1
    dealt = "block int, " + ", ".join(f"{x} array<long>" for x in SENT)
    for r in count():
        placed = label.select("node", "c").join(label.groupBy("c").agg(F.sum("k").alias("tot")), "c")
        sent = level.fans.join(placed, "node").select("node", "c", "tot", "k", "d", "to", "w")
        if level.hubs:
            sent = sent.unionByName(_of_hubs(level, label, placed, two_m, resolution))
        sent = sent.mapInArrow(partial(_sent, r=r, blocks=blocks, tries=tries, hubs=level.hubs), dealt).repartitionById(max(blocks, tries), "block")
        state = sent.mapInArrow(partial(_moved, two_m=two_m, resolution=resolution, whole=blocks == 1), MOVED)
        of = lambda t, x: F.sum(F.when(F.col("block") == t, x) if tries > 1 else x)
        inside = {f"inside{t}": of(t, F.col("inside")) for t in range(tries)}
        squares = {f"squares{t}": of(t, F.col("k").cast("double") * F.col("mine_tot")) for t in range(tries)}
        state, sums = _written(state, "moves", **inside, **squares, hoped=F.sum("gain"), first=F.max(F.struct("gain", "block")))
        written.append(state)
        now, t = max((sums[f"inside{t}"] / two_m - resolution * sums[f"squares{t}"] / two_m**2, -t) for t in range(tries))
        grown = now - best
        if grown > 0:
            best, best_state, best_sums, best_try = now, state, sums, -t
        if r:
            share = min(1.0, share * 2) if grown > max(told / 2, LEAST_GAIN) else share / 2
        hoped = 2 * best_sums["hoped"] / two_m
        if hoped < LEAST_GAIN or (alone and grown < LEAST_GAIN) or LEAST_GAIN < grown < least:
            break
        moving = max(1, int(share * blocks))
        alone, block = moving == 1, F.col("block")
        told = 2 * best_sums["first"]["gain"] / two_m if alone else hoped * moving / blocks
        drawn = block == best_sums["first"]["block"] if alone else F.pmod(block + F.lit(r), F.lit(blocks)) < moving
        label = best_state.select("node", F.when(drawn, F.coalesce("to", "mine")).otherwise(F.col("mine")).alias("c"), "k")
    for older in written:
        if older is not best_state:
            drop_table(older)
    kept = best_state.where(F.col("block") == best_try) if tries > 1 else best_state
    return kept.select("node", F.col("mine").alias("c"), "k", "d"), best


def _refined(level: _Level, label: DataFrame, two_m: float, resolution: float) -> tuple[DataFrame, int]:
    """(node, part, c, k, d), written, and the number of parts: connected parts of each community. Communities of at most
    BLOCK_LINKS links go to one task each, where the nodes that are alone join parts one after the other. Larger ones are cut
    by hash; nodes that are alone after that join the others' parts in rounds."""
    size = label.groupBy("c").agg(F.ceil(F.sum("d") / BLOCK_LINKS).alias("cuts"))
    sized = label.select("node", "c").join(size, "c")
    cu, cv = sized.select(F.col("node").alias("u"), "c", "cuts"), label.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    inner = level.links().join(cu, "u").join(cv, "v").where("c = cv").select("u", "v", "w", "k", "d", "c", "cuts")
    cut, tasks = lambda x: F.pmod(F.xxhash64(x), "cuts"), -(-4 * level.n // BLOCK_LINKS)
    near = inner.where(cut("u") == cut("v")).repartitionById(tasks, F.pmod(F.xxhash64("c", cut("u")), F.lit(tasks)).cast("int"))
    parts = near.drop("cuts").mapInArrow(partial(_merged, two_m=two_m, resolution=resolution), REFINED)
    parts = parts.join(size.select("c", (F.col("cuts") > 1).alias("large")), "c").select("node", "part", "c", "k", "d", "large")
    state, sums = _written(parts, "parts", n=F.count_if(F.col("part") == F.col("node")), large=F.count_if("large"))
    if not sums["large"]:
        return state.drop("large"), sums["n"]
    return _refined_in_rounds(inner.where("cuts > 1 and u != v").select("u", "v", "w"), state, two_m, resolution)


def _refined_in_rounds(inner: DataFrame, state: DataFrame, two_m: float, resolution: float) -> tuple[DataFrame, int]:
    """Parts of ``state`` with its large communities refined, whose links inside are ``inner``. A node that is alone
    joins, over a link, the part of its community with the largest gain above 0, if that part stays where it is this
    round: parts of several nodes always stay, and of the single ones a drawn half, every other round a sixteenth. So a
    part is connected at any time."""
    inner = write_table(inner, "inner")
    for r in count():
        stays = (F.col("n") > 1) | (F.pmod(F.xxhash64("part", F.lit(r)), F.lit(16 if r % 2 else 2)) == 0)
        now = state.where("large")
        parts = now.groupBy("part").agg(F.sum("k").alias("tot"), F.count("*").alias("n")).withColumn("stays", stays)
        # a part of one node bears its name
        alone = parts.where("n = 1").select(F.col("part").alias("u"), F.col("tot").alias("own"), F.col("stays").alias("u_stays"))
        met = inner.join(alone, "u").join(now.select(F.col("node").alias("v"), "part"), "v").groupBy("u", "own", "u_stays", "part")
        near = met.agg(F.sum("w").alias("w")).join(parts.select("part", "tot", "stays"), "part")
        gain = F.round(F.col("w") - resolution * F.col("own") * F.col("tot") / two_m, 9)
        aim = F.min(F.when(~F.col("u_stays") & F.col("stays"), F.struct((-F.col("gain")).alias("g"), F.col("part").alias("to")))).alias("aim")
        moves = near.withColumn("gain", gain).where("gain > 0").groupBy(F.col("u").alias("node")).agg(aim).withColumn("open", F.lit(True))
        nxt = state.join(moves, "node", "left").select("node", F.coalesce("aim.to", "part").alias("part"), "c", "k", "d", "large", "open")
        nxt, sums = _written(nxt, "parts", open=F.count("open"), n=F.count_if(F.col("part") == F.col("node")))
        drop_table(state)
        path, state = nxt._weft_path, nxt.drop("open")
        state._weft_path = path
        if not sums["open"]:
            drop_table(inner)
            return state.drop("large"), sums["n"]
    raise AssertionError


class _Found(NamedTuple):
    """Members (node, c, k, d), written, and the graph of connected parts that they were left in: its links, the communities
    (node, c) of its nodes, and the part ``at`` in which a member (node) is."""

    members: DataFrame
    links: DataFrame
    label: DataFrame
    place: DataFrame


def _levels(level: _Level, start: DataFrame, n: int, two_m: float, resolution: float, best: float) -> tuple[_Found | None, float]:
    """Members of a modularity above ``best``, and that: moves, refinement and aggregation from labels (node, c, k, d) of
    the whole graph of ``n`` nodes, level by level; none if the first moves do not get above it."""
    nodes, place, members = start, start.select("node", "k", "d", F.col("node").alias("at")), None
    least = FIRST_GAIN if best < -1 else LEAST_GAIN
    while True:
        label, quality = _local_moves(level, nodes, two_m, resolution, least)
        if quality <= best + (LEVEL_GAIN if members is not None else LEAST_GAIN):
            break
        best = quality
        members = place.join(label.select(F.col("node").alias("at"), "c"), "at").select("node", "c", "k", "d")
        parts, left = _refined(level, label, two_m, resolution)
        if left == n:
            nodes = label
            break
        n, names = left, parts.select(F.col("node").alias("at"), "part")
        place = place.join(names, "at").select("node", "k", "d", F.col("part").alias("at"))
        nodes = parts.groupBy(F.col("part").alias("node")).agg(F.min("c").alias("c"), F.sum("k").alias("k"), F.least(F.sum("d"), F.lit(n)).alias("d"))
        pu, pv = names.select(F.col("at").alias("u"), F.col("part").alias("pu")), names.select(F.col("at").alias("v"), F.col("part").alias("pv"))
        merged = level.links().join(pu, "u").join(pv, "v").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w"))
        level = _level(merged.join(nodes.select(F.col("node").alias("u"), "k", "d"), "u"))
    if members is None:
        return None, best
    return _Found(write_table(members, "members"), level.links(), nodes.select("node", "c"), place.select("node", "at")), best


#: Least bytes of a partition that adaptive execution puts together here: a megabyte holds a million packed numbers, which would be one task's.
LEAST_PART = "64k"


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) for the nodes of the undirected links of ``edges`` (src, dst), by the Leiden method.

    On each level single nodes move towards modularity, communities are refined into connected parts, and the parts
    become the nodes of the next, smaller level, which begins with the communities found so far. The levels are gone
    through again from the communities of the last time until the modularity no longer grows. A community that its last
    moves have left in several pieces is split into them. It is named after its least member. All choices are
    deterministic: nodes go by their numbers in the order of their names. No links give no rows."""
    with held_setting(edges.sparkSession, "spark.sql.adaptive.coalescePartitions.minPartitionSize", LEAST_PART):
        return _leiden(edges, resolution)


def _leiden(edges: DataFrame, resolution: float) -> DataFrame:
    named, found = _written(_pairs(edges), "links", n=F.count("*"))
    two_m = 2.0 * found["n"]
    if not two_m:
        return named.select(F.col("u").alias("node"), F.col("u").alias("community"))
    numbers = _numbered(named.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("k")))
    nu, nv = numbers.select(F.col("name").alias("u"), F.col("node").alias("nu")), numbers.select(F.col("name").alias("v"), F.col("node").alias("nv"))
    plain = _both_ways(named.join(nu, "u").join(nv, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))).withColumn("w", F.lit(1).cast("long"))
    degree = numbers.select("node", "k", F.col("k").alias("d"))
    own = degree.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0).cast("long").alias("w"), "k", "d")
    level = _level(plain.join(degree.withColumnRenamed("node", "u"), "u").unionByName(own))
    drop_table(named)
    n = level.n - int(two_m)
    last, best = _levels(level, degree.withColumn("c", F.col("node")), n, two_m, resolution, float("-inf"))
    while True:
        again, best = _levels(level, last.members, n, two_m, resolution, best)
        if again is None:
            break
        last = again
    # parts are connected, so pieces of a community are those of its parts
    cu, cv = last.label.select(F.col("node").alias("u"), F.col("c").alias("cu")), last.label.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    held = last.links.where("u < v").join(cu, "u").join(cv, "v").where("cu = cv").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    pieces = connected_components(held).select(F.col("node").alias("at"), "component")
    split = last.place.join(pieces, "at", "left").select("node", F.coalesce("component", "at").alias("piece"))
    names = split.groupBy("piece").agg(F.min("node").alias("node")).join(numbers, "node").select("piece", F.col("name").alias("community"))
    return split.join(numbers, "node").join(names, "piece").select(F.col("name").alias("node"), "community")


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (node, community) over the undirected links of ``edges``."""
    links = undirected(edges)
    a, b = members.select(F.col("node").alias("u"), F.col("community").alias("cu")), members.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    met = write_table(links.join(a, "u").join(b, "v").groupBy("cu").agg(F.count("*").alias("tot"), F.count_if(F.col("cu") == F.col("cv")).alias("inside")), "modularity")
    row = met.agg(F.sum("tot").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("tot").cast("double") * F.col("tot")).alias("squares")).first()
    return row["inside"] / row["all"] - resolution * row["squares"] / row["all"] ** 2 if row["all"] else 0.0


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, cohesion): the share of its members' links that stay inside; 1 without links."""
    links = undirected(edges)
    a = members.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = members.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    seen = links.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("community")).agg(F.avg(F.when(F.col("cu") == F.col("cv"), 1.0).otherwise(0.0)).alias("inside"))
    return members.groupBy("community").agg(F.count("*").alias("size")).join(seen, "community", "left").select(
        "community", "size", F.round(F.coalesce("inside", F.lit(1.0)), 6).alias("cohesion")
    )


def folder_label(paths: Column) -> Column:
    """Parent folder of a path, null for generic ones and for files at the top."""
    folder = F.regexp_extract(paths, r"([^/]+)/[^/]+$", 1)
    return F.when((folder != "") & ~F.rlike(F.lower(folder), F.lit("^(?:" + "|".join(map(quote, GENERIC_FOLDERS)) + ")$")), folder)


def community_labels(members: DataFrame) -> DataFrame:
    """(community, label) from (community, name, path): the commonest parent folder, else the common name prefix of more
    than two characters, else ``Cluster_`` and the community. Ties go to the lesser folder."""
    folders = members.select("community", folder_label(F.col("path")).alias("folder")).where("folder is not null")
    top = folders.groupBy("community", "folder").count().groupBy("community").agg(F.min(F.struct((-F.col("count")).alias("n"), "folder"))["folder"].alias("folder"))
    ends = members.groupBy("community").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda k: F.substring("a", F.lit(1), k) == F.substring("b", F.lit(1), k)))
    prefix = F.substring("a", F.lit(1), same)
    return ends.join(top, "community", "left").select(
        "community", F.coalesce("folder", F.when(F.length(prefix) > 2, prefix), F.concat(F.lit("Cluster_"), F.col("community"))).alias("label")
    )


def merge_clusters(clusters: DataFrame, least: int = 5) -> DataFrame:
    """Clusters of one label as one: symbols summed, cohesion weighted by symbols, the id of the largest; at least ``least`` symbols."""
    big = F.struct(F.col("symbols").alias("n"), F.col("id").alias("i"))
    g = clusters.groupBy("label").agg(
        F.sum("symbols").alias("symbols"), F.round(F.sum(F.col("symbols") * F.col("cohesion")) / F.sum("symbols"), 6).alias("cohesion"), F.max(big)["i"].alias("id"), F.count("*").alias("n")
    )
    return g.where(F.col("symbols") >= least)
