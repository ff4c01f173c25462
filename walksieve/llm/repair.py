"""Conversation structure repair: the cheapest edits that give (s?(ua)+)? as role initials, by Hirschberg's division.

Four states say what the roles so far allow: S0 nothing yet, S1 after a system turn, S2 after a user turn, S3 after
an assistant turn; S0 and S3 may end. A row takes one step: inserted turns, then Keep, Rerole or Delete. Steps
over a run of rows are a 4 x 4 table of costs, and an order of the audits (edit initials) of each row of it. Two facts
make the least audit of all cheapest ones divide well: an audit determines the state it ends in, and audits
that end with a row's own edit are never proper beginnings of each other, so the first difference decides.

Hirschberg's division: a forward vector (cost, place in the order of audits, per state) and a backward vector of costs
meet in the middle; among states of least total cost that with the least forward audit is the crossing, and both
halves go on alone. Only vectors of four are held at any time beside the rows.

A conversation of any length is spread: rows are sorted by range, so a conversation may lie in many pieces, each
within one task. Every piece gives its table, the division runs over tables (one row per piece), and then within
every piece, between the states at its two ends.

Rows travel without texts, under hashes of 128 bits; texts move once, to where results are put together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
FAR = 1 << 60
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}  # the one turn that can be made in a state

Step = list[tuple[int, int, int, str]]  # from, to, cost, audit


def step_of(initial: str, fault: int) -> Step:
    """All steps over one row; of equal ends only the cheapest, of equal costs the least audit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == CUT else 0
    for start in range(4):
        state, cost, audit = start, 0, ""
        while True:
            moves = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                moves.append((_TURN[state][1], REROLE + extra, "R"))
                if initial in _NEXT[state]:
                    moves.append((_NEXT[state][initial], KEEP + extra, "K"))
            for to, paid, mark in moves:
                made = (cost + paid, audit + mark)
                if (start, to) not in best or made < best[start, to]:
                    best[start, to] = made
            if len(audit) == 2:  # a third insertion would only go round
                break
            state, cost, audit = _TURN[state][1], cost + INSERT, audit + "I"
    return [(a, b, *v) for (a, b), v in sorted(best.items())]


_STEPS: dict[tuple[str, int], Step] = {}


def steps(initial: str, fault: int) -> Step:
    key = (initial if initial in "sua" else "", fault)
    if key not in _STEPS:
        _STEPS[key] = step_of(*key)
    return _STEPS[key]


#: Inserted turns after the last row, by the state before them: cost and audit.
ENDING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}


Vector = tuple[tuple[int, int], ...]  # (cost, place) per state


def _ordered(made: list) -> Vector:
    """From the best (cost, place before, what was added) of each state, its cost and its place among the states."""
    order = {m[1:]: i for i, m in enumerate(sorted((m for m in made if m), key=lambda m: m[1:]))}
    return tuple((m[0], order[m[1:]]) if m else (FAR, 0) for m in made)


def forward(vector: Vector, step: Step) -> Vector:
    """One step on; places order the least audits of the states."""
    made: list = [None] * 4
    for a, b, cost, audit in step:
        if vector[a][0] < FAR:
            new = (vector[a][0] + cost, vector[a][1], audit)
            if made[b] is None or new < made[b]:
                made[b] = new
    return _ordered(made)


def backward(costs: tuple[int, ...], step: Step) -> tuple[int, ...]:
    out = [FAR] * 4
    for a, b, cost, _ in step:
        out[a] = min(out[a], cost + costs[b])
    return tuple(out)


_AHEAD: dict = {}
_BEHIND: dict = {}


def passed(vector: Vector, row: tuple[str, int]) -> tuple[int, Vector]:
    """`forward` over a row: what the least cost grew by, and the vector less it. There are few such vectors, so each is worked out once."""
    key = (vector, row)
    if key not in _AHEAD:
        made = forward(vector, steps(*row))
        least = min(c for c, _ in made)
        _AHEAD[key] = (least, tuple((c - least, p) if c < FAR else (FAR, 0) for c, p in made))
    return _AHEAD[key]


def passed_back(costs: tuple[int, ...], row: tuple[str, int]) -> tuple[int, ...]:
    """`backward` over a row, less the least cost."""
    key = (costs, row)
    if key not in _BEHIND:
        made = backward(costs, steps(*row))
        least = min(made)
        _BEHIND[key] = tuple(c - least if c < FAR else FAR for c in made)
    return _BEHIND[key]


def unit(state: int) -> Vector:
    return tuple((0, 0) if s == state else (FAR, 0) for s in range(4))


def crossing(front: Vector, back) -> int:
    """Of the states with the least total cost, that with the least audit before it."""
    return min(range(4), key=lambda s: (front[s][0] + back[s], front[s][1]))


def divide(many: int, start: int, end: int, ahead, behind) -> list[int]:
    """States at the 0..many bounds of a run, by Hirschberg's division. `ahead(vector, i)` and `behind(costs, i)` pass item i."""
    bounds = [start] + [0] * many
    bounds[many] = end
    todo = [(0, many)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        front, back = unit(bounds[lo]), tuple(0 if s == bounds[hi] else FAR for s in range(4))
        for i in range(lo, mid):
            front = ahead(front, i)
        for i in range(hi - 1, mid - 1, -1):
            back = behind(back, i)
        bounds[mid] = crossing(front, back)
        todo += [(lo, mid), (mid, hi)]
    return bounds


def edits_between(rows: list[tuple[str, int]], start: int, end: int) -> list[tuple[str, int]]:
    """The edit block (insertions, then the row's own) and the state before it, for every row of a run."""
    bounds = divide(len(rows), start, end, lambda v, i: passed(v, rows[i])[1], lambda c, i: passed_back(c, rows[i]))
    return [(next(x[3] for x in steps(*r) if x[:2] == ends), ends[0]) for r, ends in zip(rows, zip(bounds, bounds[1:]))]


# ---- tables of pieces ------------------------------------------------------------


class Table:
    """Costs and audit orders over a run of rows from each of the four states."""

    def __init__(self):
        self.rows = [(0, unit(s)) for s in range(4)]

    def add(self, row: tuple[str, int]) -> None:
        for s, (base, vector) in enumerate(self.rows):
            more, made = passed(vector, row)
            self.rows[s] = (base + more, made)

    def flat(self) -> list[int]:
        return [x for base, v in self.rows for cost, place in v for x in (base + cost if cost < FAR else FAR, place)]


def _table(flat) -> list[list[tuple[int, int]]]:
    return [[(flat[8 * a + 2 * b], flat[8 * a + 2 * b + 1]) for b in range(4)] for a in range(4)]


def _over(vector, table):
    """`forward` over a whole piece."""
    made: list = [None] * 4
    for a in range(4):
        for b in range(4):
            if vector[a][0] < FAR and table[a][b][0] < FAR:
                new = (vector[a][0] + table[a][b][0], vector[a][1], table[a][b][1])
                if made[b] is None or new < made[b]:
                    made[b] = new
    return _ordered(made)


def _back(costs, table):
    return [min(table[a][b][0] + costs[b] for b in range(4)) for a in range(4)]


def piece_states(tables: list[list[int]]) -> list[tuple[int, int]]:
    """State before and after each piece of a conversation. The state after the last is the one whose ending gives the least audit."""
    t = [_table(f) for f in tables]
    front = unit(0)
    for x in t:
        front = _over(front, x)
    end = crossing(front, [ENDING[s][0] for s in range(4)])
    bounds = divide(len(t), 0, end, lambda v, i: _over(v, t[i]), lambda c, i: _back(c, t[i]))
    return list(zip(bounds, bounds[1:]))


# ---- Spark -----------------------------------------------------------------------

#: Order of a conversation's rows; a row's text follows as its first characters and its hashes.
_ORDER = ["conv_id", "dated", "turn", "role", "head", "h1", "h2"]


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with what orders them beside conv_id, turn and role: dated, head, h1, h2."""
    return rows.select("conv_id", F.col("turn").isNotNull().cast("int").alias("dated"), "turn", "role", F.substring("text", 1, 16).alias("head"),
                       F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def edits(rows: DataFrame) -> DataFrame:
    """One row per row of `rows` (conv_id, turn, role, text; no nulls but in conv_id and turn): conv_id, dated, turn, role, head, h1, h2,
    seq (grows in order within a conversation), fault (0 none, 1 blank, 2 duplicate, 3 truncated), edit (inserted turns as I, then
    K, R or D) and state before it."""
    bare = F.rtrim("text", F.lit(SPACES))
    shown = {"blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "rid": F.monotonically_increasing_id()}
    narrow = staged(_placed(rows).withColumns(shown).drop("text"), "turns")
    first = narrow.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("dated", "turn", "rid")).alias("f")).select(F.col("f.rid").alias("rid"), F.lit(True).alias("first"))
    judged = narrow.join(first, "rid", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    # rid puts the first of equal rows before its copies, and lets the ranges part rows that are alike in all else
    judged = judged.select(*_ORDER, "rid", fault.alias("fault"))
    keys = [F.col(c).asc_nulls_first() for c in (*_ORDER, "rid")]
    ordered = judged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select(*_ORDER, "fault", F.monotonically_increasing_id().alias("seq"))
    ordered = staged(ordered, "ordered").withColumn("piece", F.shiftright("seq", 33))

    conv = rows.schema["conv_id"].dataType.simpleString()
    lines = ordered.select("piece", "seq", "conv_id", F.substring("role", 1, 1).alias("initial"), "fault")

    def tables(batches):
        held, table, at = None, None, None
        for piece, seq, own, initial, fault in _values(batches):
            if table is None or (piece, own) != held:
                if table is not None:
                    yield [(*held, at, table.flat())]
                held, table, at = (piece, own), Table(), seq
            table.add((initial, fault))
        if table is not None:
            yield [(*held, at, table.flat())]

    id_type = pa.table({"c": pa.array([], _arrow(rows, "conv_id"))}).schema.field("c").type
    _PIECE = pa.schema([("piece", pa.int64()), ("conv_id", id_type), ("seq", pa.int64()), ("costs", pa.list_(pa.int64()))])
    pieces = lines.repartition("piece").sortWithinPartitions("piece", "seq").mapInArrow(_rows(tables, _PIECE), f"piece long, conv_id {conv}, seq long, costs array<long>")

    _STATES = pa.schema([("piece", pa.int64()), ("seq", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def states(batches):
        own, group = None, []
        for piece, c, seq, costs in _values(batches):
            if group and c != own:
                yield _with_states(group)
                group = []
            own = c
            group.append((piece, seq, costs))
        if group:
            yield _with_states(group)

    met = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_rows(states, _STATES), "piece long, seq long, start int, end int")

    _EDITS = pa.schema([("seq", pa.int64()), ("edit", pa.string()), ("state", pa.int32())])

    def walk(batches):
        head, run = None, []
        for _, seq, kind, initial, fault, start, end in _values(batches):
            if kind == 0:
                if run:
                    yield _walked(head, run)
                head, run = (start, end), []
            else:
                run.append((seq, initial, fault))
        if run:
            yield _walked(head, run)

    nothing = F.lit(None).cast("int")
    both = met.select("piece", "seq", F.lit(0).alias("kind"), F.lit("").alias("initial"), F.lit(0).alias("fault"), "start", "end").unionByName(
        lines.select("piece", "seq", F.lit(1).alias("kind"), "initial", "fault", nothing.alias("start"), nothing.alias("end")))
    made = both.repartition("piece").sortWithinPartitions("piece", "seq", "kind").mapInArrow(_rows(walk, _EDITS), "seq long, edit string, state int")
    return staged(ordered.drop("piece").join(made, "seq"), "edits")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _values(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(fn, schema: pa.Schema, least: int = 4096):
    """`fn` turns batches into lists of rows; they leave as batches of at least `least` rows."""
    def run(batches):
        held: list[tuple] = []
        for more in fn(batches):
            held += more
            if len(held) >= least:
                yield _record(held, schema)
                held = []
        if held:
            yield _record(held, schema)
    return run


def _with_states(group):
    return [(piece, seq, a, b) for (piece, seq, _), (a, b) in zip(group, piece_states([c for *_, c in group]))]


def _walked(head, run):
    return [(seq, *e) for (seq, _, _), e in zip(run, edits_between([r[1:] for r in run], *head))]


def _met(rows: DataFrame, made: DataFrame, by: list[str], every: DataFrame | None = None) -> DataFrame:
    """Edits and texts side by side: in order, an edit (kind 1) before the texts (kind 2) that are its row's, and before all of a
    conversation its row of `every` (kind 0). Texts move once, by `by`."""
    none = lambda t: F.lit(None).cast(t)
    empty = [none(t).alias(c) for c, t in (("seq", "long"), ("fault", "int"), ("edit", "string"), ("state", "int"))]
    both = made.select(*_ORDER, F.lit(1).alias("kind"), "seq", "fault", "edit", "state", none("string").alias("text")).unionByName(
        _placed(rows).select(*_ORDER, F.lit(2).alias("kind"), *empty, "text"))
    if every is not None:
        key = {"conv_id": F.col("conv_id"), "dated": F.lit(-1)}
        both = both.unionByName(every.select(*[key.get(c, none(both.schema[c].dataType)).alias(c) for c in _ORDER], F.lit(0).alias("kind"), *empty, none("string").alias("text")))
    return both.repartition(*by).sortWithinPartitions(*by, *[c for c in _ORDER if c not in by], "kind", "seq")


class _Digest:
    """Counts, audit and hash of one conversation, fed in order. Texts are hashed as they come and never held together."""

    def __init__(self):
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.last = None
        self.turns, self.before, self.state, self.lines = 0, None, 0, 0
        self.audit, self.hash, self.waits, self.after = [], hashlib.sha256(), None, []

    def line(self, role: str, text: bytes = b"") -> None:
        self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":")
        self.hash.update(text)
        self.lines += 1

    def insert(self) -> None:
        role, self.state = _TURN[self.state]
        self.after.append(role) if self.waits else self.line(role)

    def edit(self, turn, role, fault, edit, state) -> None:
        if turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        self.before = role[:1]
        if fault:
            self.sums[("blank", "duplicate", "truncated")[fault - 1]] += 1
        self.audit.append(edit)
        inserts, own = edit.count("I"), edit[-1]
        self.sums["cost"] += INSERT * inserts + {"K": KEEP, "R": REROLE, "D": DELETE}[own] + (TRUNCATED if own != "D" and fault == CUT else 0)
        self.state = state
        for _ in range(inserts):
            self.insert()
        if own == "R":
            self.waits, self.state = _TURN[self.state]
        elif own == "K":
            self.waits, self.state = role, _NEXT[self.state][role[:1]]

    def text(self, text: bytes) -> None:
        """The text of the row that waits for one; copies of it are passed over."""
        if self.waits is not None:
            self.line(self.waits, text)
            self.waits = None
            for role in self.after:
                self.line(role)
            self.after = []

    def row(self) -> tuple:
        cost, audit = ENDING[self.state]
        for _ in audit:
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        s = self.sums
        return gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"] + cost, "".join(self.audit) + audit, self.hash.hexdigest()


def _columns(batch):
    """Rows of a batch, texts as bytes."""
    names = batch.schema.names
    return zip(*[(c.cast(pa.binary()) if n == "text" else c).to_pylist() for n, c in zip(names, batch.columns)])


def digest(rows: DataFrame, made: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conv_id of `conversations`: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the `rows` edited as `made`.

    One task reads a conversation in order, as its hash demands, and holds of it no more than a batch and its audit.
    """
    both = _met(rows, made, ["conv_id"], conversations.select("conv_id").distinct())
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def fold(batches):
        held, own = None, None
        for batch in batches:
            for conv, _, turn, role, _, _, _, kind, _, fault, edit, state, text in _columns(batch):
                if kind == 0:
                    if held is not None:
                        yield [(own, *held.row())]
                    held, own = _Digest(), conv
                elif kind == 1:
                    held.edit(turn, role, fault, edit, state)
                else:
                    held.text(text)
        if held is not None:
            yield [(own, *held.row())]

    conv = rows.schema["conv_id"].dataType.simpleString()
    longs = "".join(f"{c} long, " for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return both.mapInArrow(_rows(fold, schema), f"conv_id {conv}, {longs}audit string, repaired_sha256 string")


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, seq, part (order of turns at one seq), role, text, turn (null if inserted) and edit.

    Turns inserted after the last row have the seq of that row. A conversation's turns are spread over tasks.
    """
    from pyspark.sql import Window as W

    inner = made.where("edit not like '%D'")
    met = _met(rows, inner, ["conv_id", "role", "h1"])
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), ("seq", pa.int64()), ("turn", _arrow(rows, "turn")), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def pair(batches):
        waits = None
        for batch in batches:
            names, out = batch.schema.names, []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                r = dict(zip(names, row))
                if r["kind"] == 1:
                    state = r["state"]
                    for _ in range(r["edit"].count("I")):
                        state = _TURN[state][1]
                    role = _TURN[state][0] if r["edit"][-1] == "R" else r["role"]
                    waits = ([r[c] for c in _ORDER], (r["conv_id"], r["seq"], r["turn"], role), r["edit"][-1])
                elif waits is not None and waits[0] == [r[c] for c in _ORDER]:
                    out.append((*waits[1], r["text"], waits[2]))
                    waits = None
            if out:
                yield _record(out, schema)

    turn = rows.schema["turn"].dataType.simpleString()
    kept = met.mapInArrow(pair, f"conv_id {conv}, seq long, turn {turn}, role string, text string, edit string").withColumn("part", F.lit(2))

    def inserted(state: Column, count: Column) -> Column:
        """Roles of `count` turns made from a state."""
        first = F.when(state == 2, "assistant").otherwise("user")
        second = F.when(state == 2, "user").otherwise("assistant")
        return F.slice(F.array(first, second), F.lit(1), count)

    before = made.select("conv_id", "seq", F.posexplode(inserted(F.col("state"), F.length("edit") - 1)).alias("part", "role"))
    # the state after a conversation's last row: what its own edit makes of the state before it
    last = made.groupBy("conv_id").agg(F.max(F.struct("seq", "state", "edit", F.substring("role", 1, 1).alias("initial"))).alias("l")).select("conv_id", "l.*")
    turned = F.col("state")
    for i in (1, 2):
        turned = F.when(F.length("edit") > i, F.when(turned == 2, 3).otherwise(2)).otherwise(turned)
    own = F.substring("edit", -1, 1)
    ended = F.when(own == "D", turned).when(own == "R", F.when(turned == 2, 3).otherwise(2)).when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).otherwise(3)
    last = last.withColumn("ended", ended).withColumn("more", F.when(F.col("ended") == 1, 2).when(F.col("ended") == 2, 1).otherwise(0))
    after = last.select("conv_id", "seq", F.posexplode(inserted(F.col("ended"), F.col("more"))).alias("part", "role")).withColumn("part", F.col("part") + 3)
    new = before.unionByName(after).select("conv_id", "seq", F.lit(None).cast(turn).alias("turn"), "role", F.lit("").alias("text"), F.lit("I").alias("edit"), "part")
    return kept.unionByName(new)


# ---- damage ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage; null roles and texts are one space, as nulls are in the hashed key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, edits) of a table of conversations as it is: nulls of role and text count as one space.

    Rows of a conversation are ordered by turn, nulls first, then role and text (by its first 16 characters and hashes).
    Rows with a null conv_id are one conversation. Repeated rows are duplicates after the first. Blank rows and duplicates
    are always deleted. A role that does not start with s, u or a (an empty one too) cannot be kept. Other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows, edits(rows)
