"""Conversation structure repair over a suffix-shared automaton.

Each row of a conversation becomes one symbol: the class of its role and its fault. The cheapest repair of what remains
of a conversation depends on these remaining symbols and on the grammar state alone, so equal remainders of all
conversations share one automaton node. Distinct symbol strings are dealt by range over their reversed form and read in
order: a string shares the nodes of its longest common suffix with the one before it, and only the rest is new. A node
holds, for each grammar state, the cost to go and the first letter of the best audit suffix; letters D, I, K, R lead to
different nodes or states, so of equally cheap suffixes the one with the least first letter is the least.

Conversations of any length: symbol strings are cut into blocks of BLOCK rows. For conversations of several blocks the
cost from each state to each state through a block is taken first, and a stream over the blocks from the last to the
first gives every block the costs that follow it; these are part of the automaton's key. Rows themselves meet in order
only in a stream (partitioned by conversation and sorted), which holds one conversation's audit but never its texts.

Grammar of role initials: (s?(ua)+)?. Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (forced for blank rows and
duplicates), Insert an empty user or assistant row 5; a truncated row that stays costs 5 more.

Defined results: null roles and texts are one space (so a null text is blank); a null conversation id is a conversation
of its own; null turns come first; rows of equal turn go by role, then by the first 64 characters of the text, then by a
digest; roles that do not begin with s, u or a can only be reroled or deleted; an id without rows has zeros, an empty
audit and the hash of an empty text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.prefix import running
from weftgraph.storage import write_table

#: Rows of a block.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a role leads to, and what an inserted row becomes.
GOES = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEW = ["u", "u", "a", "u"]
ROLE = {"u": "user", "a": "assistant"}
#: Costs at the end of a conversation: states 0 and 3 accept, 2 lacks an assistant row, 1 lacks both.
END = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows of ``conversations`` (conv_id, turn, role, text) harmed by the remainder of a checksum of id and turn: 0 drops the row, 1 empties its text, 2 removes full stops, 3 repeats it, 4 makes its role user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(conv_col, turn_col, text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = rows.where("harm != 0").select(conv_col, turn_col, F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    return kept.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm", "copy")


def _moves(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row."""
    if symbol == "x":
        yield "D", DELETE, state
        return
    yield "D", DELETE, state
    more = TRUNCATED if symbol.isupper() else 0
    if (to := GOES[state].get(symbol.lower())) is not None:
        yield "K", KEEP + more, to
    yield "R", REROLE + more, GOES[state][NEW[state]]


MOVES = {(x, s): list(_moves(x, s)) for x in "suaoSUAOx" for s in range(4)}


def node(symbol: str, after: tuple) -> tuple[tuple, tuple]:
    """Costs to go and first letters (by grammar state) of a remainder that begins with ``symbol``, given the costs behind it."""
    best = [min((cost + after[to], letter) for letter, cost, to in MOVES[symbol, s]) for s in range(4)]
    # one inserted row, or two in turn; letters break ties, and I comes before K and R
    direct = list(best)
    for s in (2, 3, 0, 1):
        to = GOES[s][NEW[s]]
        best[s] = min(best[s], (INSERT + direct[to][0], "I"), (2 * INSERT + direct[GOES[to][NEW[to]]][0], "I"))
    return tuple(c for c, _ in best), tuple(x for _, x in best)


class Automaton:
    """The nodes of the remainders of one string; ``read`` keeps those that the next string shares with it.

    ``ends`` has one or more vectors of costs behind the last row."""

    def __init__(self, ends: list[tuple]) -> None:
        self.ends, self.symbols, self.costs, self.letters, self.made = ends, [], [list(ends)], [], 0

    def read(self, string: str) -> None:
        shared = 0
        limit = min(len(string), len(self.symbols))
        while shared < limit and string[-1 - shared] == self.symbols[shared]:
            shared += 1
        del self.symbols[shared:], self.letters[shared:], self.costs[shared + 1 :]
        for symbol in reversed(string[: len(string) - shared]):
            found = [node(symbol, after) for after in self.costs[-1]]
            self.costs.append([c for c, _ in found])
            self.letters.append([x for _, x in found])
            self.symbols.append(symbol)
            self.made += 1

    def audit(self, state: int, last: bool) -> tuple[str, int, int]:
        """(letters, their cost, state at the end) from ``state`` at the first row; ``last``: rows that the end needs are inserted."""
        out, cost, at = [], 0, len(self.symbols)
        while at:
            letter = self.letters[at - 1][0][state]
            out.append(letter)
            if letter == "I":
                cost, state = cost + INSERT, GOES[state][NEW[state]]
                continue
            paid, state = next((c, to) for x, c, to in MOVES[self.symbols[at - 1], state] if x == letter)
            cost, at = cost + paid, at - 1
        while last and END[state]:
            out.append("I")
            cost, state = cost + INSERT, GOES[state][NEW[state]]
        return "".join(out), cost, state


def _sorted_strings(strings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct strings dealt and sorted by (keys, reversed string)."""
    back = strings.distinct().withColumn("back", F.reverse("string"))
    return back.repartitionByRange(*keys, "back").sortWithinPartitions(*keys, "back")


def block_costs(strings: DataFrame) -> DataFrame:
    """(string, through): for distinct ``string``, the 16 costs from each state before to each state behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([tuple(0 if s == to else FAR for s in range(4)) for to in range(4)])
        for b in batches:
            rows = b.column(0).to_pylist()
            through = []
            for string in rows:
                automaton.read(string)
                through.append([automaton.costs[-1][to][s] for s in range(4) for to in range(4)])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(through, pa.list_(pa.int64()))], names=["string", "through"])

    return _sorted_strings(strings.select("string"), []).select("string").mapInArrow(run, "string string, through array<long>")


def best_audits(strings: DataFrame) -> DataFrame:
    """(string, behind, last, audits): for distinct (string, costs behind it, whether it ends a conversation), an audit from each state."""
    kind = "string string, behind array<long>, last boolean, audits array<struct<letters: string, cost: long, state: int>>"
    shape = pa.list_(pa.struct([("letters", pa.string()), ("cost", pa.int64()), ("state", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = automaton = None
        for b in batches:
            out = []
            for string, behind, last in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (tuple(behind), last) != key:
                    key, automaton = (tuple(behind), last), Automaton([tuple(behind)])
                automaton.read(string)
                out.append([dict(zip(("letters", "cost", "state"), automaton.audit(s, last))) for s in range(4)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, shape)], names=["string", "behind", "last", "audits"])

    return _sorted_strings(strings.select("string", "behind", "last"), ["last", "behind"]).select("string", "behind", "last").mapInArrow(run, kind)


def _behind(conv: T.DataType) -> tuple[Callable, T.StructType]:
    """A stream over (conv, block, through) from the last block of a conversation to its first: (conv, block, costs behind it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, costs = object(), END
        for b in batches:
            out = []
            for conv_id, through in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if conv_id != of:
                    of, costs = conv_id, END
                least = min(costs)
                costs = tuple(c - least for c in costs)
                out.append(list(costs))
                costs = tuple(min(through[4 * s + to] + costs[to] for to in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv", "block", "behind"])

    return run, T.StructType([T.StructField("conv", conv), T.StructField("block", T.LongType()), T.StructField("behind", T.ArrayType(T.LongType()))])


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))


ROW_ORDER = ["turn", "role", "head", "digest"]


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(conversations[conv_col].alias("conv"), conversations[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", digest)


def faults(rows: DataFrame) -> DataFrame:
    """Written table of rows without their texts: conv, turn, initial, pos (from 0), fault (blank, duplicate, truncated or null)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select(
        "conv", *ROW_ORDER, _initial(F.col("role")).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    placed = write_table(running(light, ["conv"], [F.col(c).asc() for c in ROW_ORDER], {"pos": F.lit(1)}, "conv-order").drop("head", "role"), "conv-rows")
    repeated = placed.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    seen = placed.join(repeated, placed["conv"].eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return write_table(seen.select("conv", "turn", "initial", "pos", fault.alias("fault")), "conv-faults")


def audits(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with faults: (conv, block, audits by state) and (conv, gaps, blank, duplicate, truncated)."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    cut = marked.select("conv", F.floor(F.col("pos") / BLOCK).alias("block"), F.struct("pos", symbol.alias("symbol")).alias("at"))
    blocks = cut.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x.symbol), "").alias("string"))

    def number(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    stats = write_table(marked.groupBy("conv").agg(gaps, number("blank"), number("duplicate"), number("truncated"), F.floor((F.count("*") - 1) / BLOCK).alias("final")), "conv-stats")
    ends = stats.select(F.col("conv").alias("c"), "final")
    blocks = write_table(blocks.join(ends, F.col("conv").eqNullSafe(F.col("c"))).drop("c"), "conv-blocks")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    short = blocks.where("final = 0").select("conv", "block", "string", "final", end.alias("behind"))
    long_ = blocks.where("final > 0")
    if not long_.isEmpty():
        through = block_costs(long_).withColumnRenamed("string", "s")
        chained = long_.join(through, F.col("string") == F.col("s")).select("conv", "block", "through")
        chained = chained.repartition("conv").sortWithinPartitions(F.col("conv").asc(), F.col("block").desc())
        run, schema = _behind(marked.schema["conv"].dataType)
        behind = chained.mapInArrow(run, schema).select(F.col("conv").alias("c"), F.col("block").alias("b"), "behind")
        joined = long_.join(behind, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
        short = short.unionByName(joined.select("conv", "block", "string", "final", "behind"))
    keyed = write_table(short.withColumn("last", F.col("block") == F.col("final")).drop("final"), "conv-keyed")
    found = best_audits(keyed).select(F.col("string").alias("s"), F.col("behind").alias("e"), F.col("last").alias("l"), "audits")
    met = keyed.join(found, (F.col("string") == F.col("s")) & (F.col("behind") == F.col("e")) & (F.col("last") == F.col("l")))
    return met.select("conv", "block", "audits"), stats.drop("final")


HEADER, INSTRUCTION, ROW = 0, 1, 2
ZEROS = ["gaps", "blank", "duplicate", "truncated"]


def _stream(rows: DataFrame, instructions: DataFrame, headers: DataFrame) -> DataFrame:
    """Of each conversation its header, the audits of its blocks in order, then its rows in order; all in one partition's stream."""
    every = headers.select("conv", F.lit(HEADER).alias("kind"), *ZEROS)
    every = every.unionByName(instructions.withColumn("kind", F.lit(INSTRUCTION)), allowMissingColumns=True)
    every = every.unionByName(rows.withColumn("kind", F.lit(ROW)), allowMissingColumns=True)
    return every.repartition("conv").sortWithinPartitions(*[F.col(c).asc() for c in ("conv", "kind", "block", *ROW_ORDER)]).select("conv", "kind", *ZEROS, "audits", "turn", "role", "text")


class _Conversation:
    """What the stream holds of one conversation: counts, the audit's pieces and a running hash."""

    def __init__(self, conv_id, counts: list[int]) -> None:
        self.conv, self.counts, self.pieces, self.state, self.cost, self.illegal, self.before = conv_id, counts, [], 0, 0, 0, None
        self.at = self.grammar = self.written = 0
        self.hash, self.audit = hashlib.sha256(), None

    def instruct(self, options: list[dict]) -> None:
        chosen = options[self.state]
        self.pieces.append(chosen["letters"])
        self.cost, self.state = self.cost + chosen["cost"], chosen["state"]

    def _write(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written += 1
        return self.written - 1, role, text

    def _insert(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = NEW[self.grammar]
            self.at, self.grammar = self.at + 1, GOES[self.grammar][role]
            yield (*self._write(ROLE[role], ""), "I", None)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """(position, role, text, edit, turn) of the repaired rows that this row makes."""
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if self.audit is None:
            self.audit = "".join(self.pieces)
        yield from self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            to = initial if letter == "K" else NEW[self.grammar]
            self.grammar = GOES[self.grammar][to]
            yield (*self._write(role if letter == "K" else ROLE[to], text), letter, turn)

    def end(self) -> Iterator[tuple]:
        if self.audit is not None:
            yield from self._insert()

    def summary(self) -> tuple:
        return (self.conv, *self.counts, self.illegal, self.cost, self.audit or "", self.hash.hexdigest())


def _walk(batches: Iterator[pa.RecordBatch], sink: Callable) -> Iterator[list[tuple]]:
    """Rows of ``sink``: called with a conversation and its repaired rows, and with (conversation, None) at its end."""
    now: _Conversation | None = None
    for b in batches:
        out: list[tuple] = []
        for conv_id, kind, *counts, options, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if kind == HEADER:
                if now is not None:
                    out += sink(now, now.end()) + sink(now, None)
                now = _Conversation(conv_id, counts)
            elif kind == INSTRUCTION:
                now.instruct(options)
            else:
                out += sink(now, now.row(turn, role, text))
        yield out
    if now is not None:
        yield sink(now, now.end()) + sink(now, None)


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Repair:
    """Repair of conversations; ``ids`` may name conversations beyond those that have rows.

    ``rows()``: the repaired rows (conv, position, role, text, edit, turn). ``summary()``: one row per conversation with
    gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired rows."""

    def __init__(self, conversations: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> None:
        rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
        instructions, stats = audits(faults(rows))
        named = rows.select("conv") if ids is None else rows.select("conv").union(ids.select(conv_col))
        stats = stats.withColumnRenamed("conv", "c")
        headers = named.distinct().join(stats, F.col("conv").eqNullSafe(F.col("c")), "left").select("conv", *[F.coalesce(z, F.lit(0)).cast("long").alias(z) for z in ZEROS])
        self.stream, self.conv = _stream(rows, instructions, headers), rows.schema["conv"].dataType

    def _run(self, sink: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _walk(batches, sink):
                yield from _batch(rows, arrow)

        return self.stream.mapInArrow(run, schema)

    def rows(self) -> DataFrame:
        def sink(now: _Conversation, made: Iterator[tuple] | None) -> list[tuple]:
            return [] if made is None else [(now.conv, *r) for r in made]

        return self._run(sink, [("conv", self.conv), ("position", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType()), ("turn", T.LongType())])

    def summary(self) -> DataFrame:
        def sink(now: _Conversation, made: Iterator[tuple] | None) -> list[tuple]:
            if made is None:
                return [now.summary()]
            for _ in made:
                pass
            return []

        longs = [(n, T.LongType()) for n in (*ZEROS, "illegal", "cost")]
        return self._run(sink, [("conv", self.conv), *longs, ("audit", T.StringType()), ("repaired_sha256", T.StringType())])
