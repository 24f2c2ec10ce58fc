"""Repair of conversation structure with the least edits, by a Viterbi search whose survivors coalesce.

A repaired conversation's role initials are `(s?(ua)+)?`, an automaton of four states. Row by row each
state keeps its cheapest way (the survivor; of equally cheap ones the one whose audit is ASCII-least).
The ways form a tree of back pointers with reference counts: a branch that no survivor uses is freed,
and once all survivors share an ancestor the edits up to it are emitted and forgotten. Ties are decided
by the whole suffixes that are not emitted yet, back to the common ancestor. A survivor that another one
can imitate for less is given up, so that the unresolved part stays short.

On Spark: equal rows of a turn become one row with a count, rows are range-sorted by conversation and
turn, and each task streams through its range. A conversation that may go on in another task, or that
is too long to hold, is settled in parts: each part gives cost and order of the ways between any two
states, these are chained over the parts (one small row each), and with entry and exit known each part is
decoded on its own. Only the text that the contract hashes as a whole passes through one task, in order and
without being held.

Defined results: null role or text is one space, a null turn comes first and is one space in the damage
key, a null conv_id is a conversation of its own; rows of equal turn are ordered by role and text;
repeated rows are duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from basketline.llm.common import written

START, S, U, A = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
CLOSING = {START: "", S: "II", U: "I", A: ""}
#: IMITATE[q][p]: what a way in state q has to add, at most, to go on as one in state p would
IMITATE = {START: {S: 0, U: 2, A: 0}, S: {START: 4, U: 2, A: 4}, U: {START: 5, S: 2, A: 2}, A: {START: 3, S: 0, U: 2}}
HELD_ROWS, HELD_CHARS = 2048, 1 << 20


def moves(initial: str, usable: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, edits) of one row."""
    out = [(p, p, DELETE, "D") for p in range(4)]
    if usable:
        late = int(truncated)
        if initial == "s":
            out.append((START, S, KEEP + late, "K"))
        for goal, letter in ((U, "u"), (A, "a")):
            cost, edit = (KEEP + late, "K") if initial == letter else (REROLE + late, "R")
            for p in range(4):
                direct = (p == U) == (goal == A)
                out.append((p, goal, cost, edit) if direct else (p, goal, cost + INSERT, "I" + edit))
    return out


class Node:
    """A step of a way: its edits, the step before, and how many steps and survivors refer to it."""

    __slots__ = ("parent", "edits", "next", "refs")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.next, self.refs = parent, edits, [], 0


class Survivors:
    """The cheapest way into each state, as a tree whose settled trunk is cut off."""

    _moves: dict[tuple, list] = {}

    def __init__(self, state: int = START):
        root = Node(None, "")
        root.refs = 1
        self.root, self.tips, self.costs, self.depth = root, {state: root}, {state: 0}, 0

    def before(self, p: int, mine: str, q: int, other: str) -> bool:
        """Whether the way through p is ASCII-less than the equally long one through q: by the first edits that differ."""
        if p == q:
            return mine < other
        x, y = self.tips[p], self.tips[q]
        while x.parent is not y.parent:
            x, y = x.parent, y.parent
        return x.edits < y.edits

    def step(self, initial: str, usable: bool, truncated: bool) -> None:
        key = (initial if initial in ("s", "u", "a") else "", usable, truncated)
        if key not in self._moves:
            self._moves[key] = moves(*key)
        best: dict[int, tuple[int, int, str]] = {}
        for p, q, cost, edits in self._moves[key]:
            if p in self.costs:
                total = self.costs[p] + cost
                now = best.get(q)
                if now is None or total < now[0] or (total == now[0] and self.before(p, edits, now[1], now[2])):
                    best[q] = (total, p, edits)
        kept = {q: b for q, b in best.items() if all(b[0] <= best[o][0] + IMITATE[o][q] for o in best if o != q)}
        tips = {}
        for q, (_, p, edits) in kept.items():
            node = Node(self.tips[p], edits)
            node.refs = 1
            self.tips[p].refs += 1
            self.tips[p].next.append(node)
            tips[q] = node
        for tip in self.tips.values():
            self.release(tip)
        self.tips, self.costs = tips, {q: b[0] for q, b in kept.items()}
        self.depth += 1

    @staticmethod
    def release(node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            if node.parent is not None:
                node.parent.next.remove(node)
            node = node.parent

    def settled(self) -> Iterator[str]:
        """The edits of each further row on which all survivors agree."""
        while len(self.root.next) == 1 and self.root.refs == 1:
            self.root = self.root.next[0]
            self.root.parent = None
            self.depth -= 1
            yield self.root.edits

    def order(self) -> list[int]:
        """The states in the order of their ways."""
        out: list[int] = []
        for q in self.tips:
            at = next((i for i, o in enumerate(out) if self.before(q, "", o, "")), len(out))
            out.insert(at, q)
        return out

    def best_end(self) -> int:
        """The state to end in: least cost with the inserts that close it, then the ASCII-least way."""
        total = {q: c + INSERT * len(CLOSING[q]) for q, c in self.costs.items()}
        return next(q for q in self.order() if total[q] == min(total.values()))

    def rest(self, state: int) -> list[str]:
        """The edits from the settled trunk to the survivor of a state."""
        out, node = [], self.tips[state]
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]


class Faults:
    """Counts over the rows of a conversation, or of a part of it, in order."""

    FIELDS = ("first", "last", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")

    def __init__(self):
        self.first = self.last = None
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, initial: str, turn: int | None, n: int, blank: bool, seen: bool, cut: bool) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # two equal initials are never legal
        self.last = initial
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - (not seen)
        self.truncated += int(cut)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def join(self, later: Faults) -> None:
        """Append the counts of the rows that follow."""
        if later.first is None:
            return
        if self.first is None:
            self.__dict__.update(later.__dict__)
            return
        self.illegal += later.illegal + (self.last + later.first not in LEGAL)
        self.last = later.last
        for c in ("blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + getattr(later, c))
        if later.first_turn is not None:
            self.turns += later.turns - (later.first_turn == self.last_turn)
            self.first_turn = later.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = later.last_turn

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


class Repair:
    """Streams rows through the search and gives edits and repaired rows as they settle."""

    def __init__(self, state: int = START):
        self.survivors, self.faults, self.waiting = Survivors(state), Faults(), deque()
        self.at, self.copies = state, 0

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        if not n:
            return
        stripped, initial = text.rstrip(SPACES), role[:1]
        blank = not stripped
        cut = not blank and not seen and stripped[-1] not in ".!?"
        self.faults.add(initial, turn, n, blank, seen, cut)
        self.survivors.step(initial, not blank and not seen, cut)
        self.copies += n - 1
        self.waiting.append((role, text, n))

    def _apply(self, edits: str) -> tuple[str, str]:
        role, text, n = self.waiting.popleft()
        rows = []
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                self.at = S
            else:
                self.at = A if self.at == U else U
            name = role if edit == "K" else ("user", "assistant")[self.at == A]
            rows.append(f"\n{name}:{'' if edit == 'I' else text}")
        return edits + "D" * (n - 1), "".join(rows)

    def settled(self) -> Iterator[tuple[str, str]]:
        """(edits, repaired rows, each after a line feed) of the rows that are decided."""
        for edits in self.survivors.settled():
            yield self._apply(edits)

    def end(self, state: int | None = None) -> Iterator[tuple[str, str]]:
        """What is left; without a state to end in, of the best end and with its closing inserts."""
        last = self.survivors.best_end() if state is None else state
        for edits in self.survivors.rest(last):
            yield self._apply(edits)
        if state is None and CLOSING[last]:
            yield CLOSING[last], {S: "\nuser:\nassistant:", U: "\nassistant:"}[last]

    def cost(self, state: int) -> int:
        return self.survivors.costs[state] + DELETE * self.copies


def result(faults: Faults, cost: int, audit: str, sha: str) -> dict:
    return {"gaps": faults.gaps(), "blank": faults.blank, "duplicate": faults.duplicate, "truncated": faults.truncated,
            "illegal": faults.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def repaired(rows: list[tuple]) -> dict:
    """The result of one whole conversation held in memory; rows (turn, role, text, n, seen) in order."""
    repair, pieces = Repair(), []
    for row in rows:
        repair.add(*row)
        pieces.extend(repair.settled())
    last = repair.survivors.best_end()
    cost = repair.cost(last) + INSERT * len(CLOSING[last])
    pieces.extend(repair.end())
    text = "".join(t for _, t in pieces)[1:]
    return result(repair.faults, cost, "".join(e for e, _ in pieces), hashlib.sha256(text.encode()).hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the damaged rows, equal ones counted; n is 0 where only dropped rows were."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    harm = F.crc32(key) % 20
    dropped = F.col("harm") == 0
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), harm.alias("harm"))
    changed = rows.select(
        "conv_id", F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(dropped, "").when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(dropped | (F.col("harm") == 1), "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(dropped, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("bigint").alias("n"))
    return counted(changed)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def with_seen(rows: DataFrame) -> DataFrame:
    """Adds `seen`: whether role and text occur in an earlier turn of the conversation."""
    digest = F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    rows = rows.withColumn("digest", digest)
    first = (rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
             .agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    seen = rows.join(first, same("conv_id", "c") & (F.col("digest") == F.col("d")), "left")
    return seen.select("conv_id", "turn", "role", "text", "n", F.coalesce(turn > F.col("first"), F.lit(False)).alias("seen"))


ROWS = "array<struct<turn:bigint,role:string,text:string,n:bigint,seen:boolean>>"
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = "first string, last string, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _schema(df: DataFrame, rest: str) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(rest).fields])
    return schema, to_arrow_schema(schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for small in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            yield from zip(*(c.to_pylist() for c in small.columns))


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += row.pop("_size", 1)
        if size >= most:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def repair(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """conv_id and RESULT for each conversation of rows (conv_id, turn, role, text, n), as damaged() or counted() gives them."""
    keys = ["conv_id", "turn", "role", "text"]
    ordered = with_seen(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema, arrow = _schema(rows, f"part int, chunk int, rows {ROWS}, {RESULT}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the conversations that lie inside this task; rows, in chunks, of the others."""
        part = TaskContext.get().partitionId()
        names = ("turn", "role", "text", "n", "seen")

        def out() -> Iterator[dict]:
            held, chars, chunk, conv, n_conv = [], 0, 0, None, 0

            def chunked() -> dict:
                return {"conv_id": conv, "part": part, "chunk": chunk, "rows": [dict(zip(names, r)) for r in held], "_size": len(held)}

            for this, *row in _streamed(batches):
                if n_conv == 0 or this != conv:
                    if n_conv > 1 and not chunk:
                        yield {"conv_id": conv, **repaired(held)}
                    elif n_conv:
                        yield chunked()
                    held, chars, chunk, conv, n_conv = [], 0, 0, this, n_conv + 1
                held.append(tuple(row))
                chars += len(row[2])
                if len(held) >= held_rows or chars >= HELD_CHARS:
                    yield chunked()
                    held, chars, chunk = [], 0, chunk + 1
            if n_conv:
                yield chunked()  # the next task may go on with it

        yield from _batched(out(), arrow)

    first = written(ordered.mapInArrow(cut, schema), "conversations")
    whole = first.where("rows is null").select("conv_id", *RESULT_COLUMNS)
    return whole.unionByName(in_parts(first.where("rows is not null").select("conv_id", "part", "chunk", "rows")))


RESULT_COLUMNS = [f.split()[0] for f in RESULT.split(", ")]


def _parts(stream: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The chunks of each (conversation, part) in turn; the first two columns of the stream are its key, the third its chunk."""
    row = next(stream, None)
    while row is not None:
        key, state = row[:2], {"row": row}

        def rows() -> Iterator[tuple]:
            while state["row"] is not None and state["row"][:2] == key:
                yield state["row"]
                state["row"] = next(stream, None)

        own = rows()
        yield key, own
        for _ in own:
            pass
        row = state["row"]


def _add_all(repairs: list[Repair], rows: list[dict]) -> None:
    for row in rows:
        for r in repairs:
            r.add(row["turn"], row["role"], row["text"], row["n"], row["seen"])
            for _ in r.settled():
                pass


def in_parts(chunks: DataFrame) -> DataFrame:
    """RESULT of conversations cut in parts: conv_id, part, chunk (ascending) and rows."""
    ordered = chunks.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "chunk")
    way_schema, way_arrow = _schema(chunks, f"part int, ways array<struct<enter:int,leave:int,cost:bigint>>, {COUNTS}")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part the cost of the best way between states, those from one state in the order of their edits."""
        def out() -> Iterator[dict]:
            for (conv, part), rows in _parts(_streamed(batches)):
                repairs = [Repair(p) for p in range(4)]
                for row in rows:
                    _add_all(repairs, row[3])
                found = [{"enter": p, "leave": q, "cost": r.cost(q)} for p, r in enumerate(repairs) for q in r.survivors.order()]
                yield {"conv_id": conv, "part": part, "ways": found, **{c: getattr(repairs[0].faults, c) for c in Faults.FIELDS}}

        yield from _batched(out(), way_arrow)

    plan_schema, plan_arrow = _schema(chunks, f"part int, enter int, leave int, closing string, {RESULT}")

    def chain(table: pa.Table) -> pa.Table:
        """Chain the parts of a conversation (a row each): the states between them, and its counts and cost."""
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        faults, now, back = Faults(), [(START, 0)], []  # states in the order of their ways
        for row in parts:
            own = Faults()
            own.__dict__.update({c: row[c] for c in Faults.FIELDS})
            faults.join(own)
            rank = {p: i for i, (p, _) in enumerate(now)}
            best: dict[int, tuple] = {}
            for i, w in enumerate(row["ways"]):
                if w["enter"] in rank:
                    option = (now[rank[w["enter"]]][1] + w["cost"], rank[w["enter"]], i, w["enter"])
                    if w["leave"] not in best or option < best[w["leave"]]:
                        best[w["leave"]] = option
            now = [(q, b[0]) for q, b in sorted(best.items(), key=lambda x: x[1][1:3])]
            back.append({q: b[3] for q, b in best.items()})
        total = {q: c + INSERT * len(CLOSING[q]) for q, c in now}
        least = min(total.values())
        leave = next(q for q, _ in now if total[q] == least)
        closing, out = CLOSING[leave], []
        for row, came in zip(parts[::-1], back[::-1]):
            out.append({"conv_id": row["conv_id"], "part": row["part"], "enter": came[leave], "leave": leave,
                        "closing": closing, **result(faults, least, "", "")})
            leave, closing = came[leave], ""
        return pa.Table.from_pylist(out, plan_arrow)

    plan = written(ordered.mapInArrow(ways, way_schema).groupBy("conv_id").applyInArrow(chain, plan_schema), "conversation-parts")
    states = plan.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enter", "leave", "closing")
    known = chunks.join(states, same("conv_id", "c") & (F.col("part") == F.col("p")))
    known = (known.select("conv_id", "part", "chunk", "rows", "enter", "leave", "closing")
             .repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "chunk"))
    piece_schema, piece_arrow = _schema(chunks, "part int, piece int, audit string, text string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edits and repaired rows of each part, piece by piece as they settle."""
        def out() -> Iterator[dict]:
            for (conv, part), rows in _parts(_streamed(batches)):
                repair, n, audit, text, size = None, 0, [], [], 0
                for _, _, _, chunk, enter, leave, closing in rows:
                    repair = repair or Repair(enter)
                    for row in chunk:
                        repair.add(row["turn"], row["role"], row["text"], row["n"], row["seen"])
                        for e, t in repair.settled():
                            audit.append(e)
                            text.append(t)
                            size += len(e) + len(t)
                        if size >= HELD_CHARS:
                            yield {"conv_id": conv, "part": part, "piece": n, "audit": "".join(audit), "text": "".join(text), "_size": 512}
                            n, audit, text, size = n + 1, [], [], 0
                for e, t in repair.end(leave):
                    audit.append(e)
                    text.append(t)
                if closing:
                    audit.append(closing)
                    text.append("\nuser:\nassistant:" if closing == "II" else "\nassistant:")
                yield {"conv_id": conv, "part": part, "piece": n, "audit": "".join(audit), "text": "".join(text), "_size": 32}

        yield from _batched(out(), piece_arrow)

    pieces = known.mapInArrow(decode, piece_schema).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    sum_schema, sum_arrow = _schema(chunks, "audit string, repaired_sha256 string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the pieces of each conversation; no text is held."""
        def out() -> Iterator[dict]:
            stream = ((r[0], None, *r[3:]) for r in _streamed(batches))
            for (conv, _), rows in _parts(stream):
                sha, audit, begun = hashlib.sha256(), [], False
                for _, _, edits, text in rows:
                    audit.append(edits)
                    sha.update((text if begun else text[1:]).encode())
                    begun = begun or bool(text)
                yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        yield from _batched(out(), sum_arrow)

    ends = pieces.mapInArrow(hashed, sum_schema).withColumnRenamed("conv_id", "c")
    counts = plan.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in RESULT_COLUMNS[:-2]])
    return counts.join(ends, same("conv_id", "c")).select("conv_id", *RESULT_COLUMNS)
