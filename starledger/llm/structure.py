"""Repair of conversations whose turns are out of order, empty, repeated or cut short.

The cheapest edits that make the roles of a conversation read system (or not), then user and
assistant in turn, are found by iterative deepening A*: a depth-first search over rows and roles
that tries the edits in ASCII order (Delete, Insert, Keep, Rerole) under a bound of cost, which
grows to the least cost that the search was stopped at. A table keeps for every state a cost
that the rest is known to need, from states that failed, so no failed state is searched twice
under the same budget. The first accepted path is the cheapest and, of those, the least by letter.

A conversation may be as long as the table. So rows are dealt by range of their place, and what
is searched at once is a block of at most ``BLOCK_ROWS`` of them: one letter and one digit a row.
A conversation of one block is searched from start to end. For others every block is searched
between all pairs of roles before and after it, in parallel; a stream over its blocks from the
last to the first adds up what the rest costs from each role, and one from the first to the
last takes the way through. Both hold four numbers. As the last role follows from the letters,
paths through a block are never each other's beginning, so ties are settled within blocks.

Texts go through one shuffle only, beside the edits of their block, in a stream with constant
state but for the audit, which is the result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import clash_free, cuts, per_batch, stored

#: Fixed by the contract: costs of the edits, of a kept row that is cut short, and the damages.
DELETE, INSERT, REROLE, KEPT_TRUNCATED, DAMAGES = 2, 5, 1, 5, 20
#: Rows searched at once.
BLOCK_ROWS = 128
#: Characters of a text that order rows of one turn and role before its hash does.
PREFIX = 32
SPACE = " \t\n\x0b\x0c\r"
NEVER = float("inf")
#: Roles seen last: none, system, user, assistant; what may follow, and what an insert adds.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Roles at which a conversation may end.
ENDS = frozenset({START, ASSISTANT})
#: Faults of a row as digits.
CLEAN, BLANK, DUPLICATE, TRUNCATED = "0123"
PLACE = ["has_turn", "turn", "role", "prefix", "digest"]
PLACE_TYPES = "has_turn boolean, turn bigint, role string, prefix string, digest binary"
COUNTS = ["blank", "duplicate", "truncated", "extra"]
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


# the search


def _needed(rows: list[str], exits: frozenset[int], trailing: bool) -> list[list[float]]:
    """A cost that is certainly needed from each row and role on.

    Rows that must go cost a deletion, cut rows too (keeping costs more), rows whose role can
    stand nowhere a rerole. Where exits lie before the first user, later roles never get there.
    """
    n = len(rows)
    need = [[0.0] * 4 for _ in range(n + 1)]
    for q in range(4):
        need[n][q] = 0.0 if q in exits else float(INSERT) if trailing else NEVER
    system = False
    for i in range(n - 1, -1, -1):
        role, fault = rows[i]
        system |= role == "s" and fault in (CLEAN, TRUNCATED)
        least = DELETE if fault != CLEAN else 0 if role in "sua" else REROLE
        ahead = 0.0 if i == n - 1 else min(x for x in need[i + 1] if x < NEVER)
        for q in range(4):
            need[i][q] = least + ahead
            if (exits == {START} and q != START) or (exits == {SYSTEM} and (q > SYSTEM or (q == START and not system))):
                need[i][q] = NEVER
    return need


def _moves(rows: list[str], i: int, q: int, trailing: bool) -> list[tuple[str, int, int, int]]:
    """(letter, cost, next row, next role) in ASCII order."""
    if i == len(rows):
        return [("I", INSERT, i, ADDED[q])] if trailing else []
    role, fault = rows[i]
    moves = [("D", DELETE, i + 1, q), ("I", INSERT, i, ADDED[q])]
    if fault in (CLEAN, TRUNCATED):
        more = KEPT_TRUNCATED if fault == TRUNCATED else 0
        if role in FOLLOWS[q]:
            moves.append(("K", more, i + 1, FOLLOWS[q][role]))
        moves.append(("R", REROLE + more, i + 1, ADDED[q]))
    return moves


def cheapest(rows: list[str], entry: int = START, exits: frozenset[int] = ENDS, trailing: bool = True) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits of ``rows`` (role letter and fault digit each) from one role to one of ``exits``.

    Of equal ones the least by letter. ``trailing``: inserts may follow the last row. None if
    there is no way.
    """
    n, need = len(rows), _needed(rows, exits, trailing)
    if n == 0 and entry in exits:
        return 0, ""
    while (bound := need[0][entry]) < NEVER:
        letters: list[str] = []
        frames = [[0, entry, 0, _moves(rows, 0, entry, trailing), 0]]
        while frames:
            i, q, spent, moves, tried = frame = frames[-1]
            if tried == len(moves):
                # failed: what the best of its moves needs is needed here too
                need[i][q] = max(need[i][q], min((c + need[to][r] for _, c, to, r in moves), default=NEVER))
                frames.pop()
                if letters:
                    letters.pop()
                continue
            frame[4] += 1
            letter, c, to, r = moves[tried]
            if spent + c + need[to][r] > bound:
                continue
            letters.append(letter)
            if to == n and r in exits:
                return spent + c, "".join(letters)
            frames.append([to, r, spent + c, _moves(rows, to, r, trailing), 0])
    return None


def _rows_of(codes: str) -> list[str]:
    return [codes[i : i + 2] for i in range(0, len(codes), 2)]


# rows and their faults


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows after the contract's damage by crc32 of conversation and turn; nulls are one space."""
    flat = clash_free(conversations, "conv_id", "turn", "role", "text")
    return _struck(flat).select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(True), "times")).alias("_")).drop("_")


def _damage() -> Column:
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % DAMAGES


def _struck(flat: DataFrame) -> DataFrame:
    """Rows that the damage leaves, with how often each stands there."""
    strike, role, said = F.col("strike"), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    left = flat.withColumn("strike", _damage()).where("strike <> 0")
    said = F.when(strike == 1, F.lit("")).when(strike == 2, F.translate(said, ".!?", "")).otherwise(said)
    return left.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(strike == 4, F.lit("user")).otherwise(role).alias("role"), said.alias("text"), F.when(strike == 3, 2).otherwise(1).alias("times"))


def _undamaged(flat: DataFrame) -> DataFrame:
    role, said = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return flat.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), said.alias("text"), F.lit(1).alias("times"))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``PLACE``, which order the rows of a conversation."""
    return rows.select("conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role", F.left("text", F.lit(PREFIX)).alias("prefix"), F.unhex(F.sha2("text", 256)).alias("digest"), "text", "times")


def _marked(placed: DataFrame) -> DataFrame:
    """Distinct rows of each conversation without texts: how often each stands there, and the fault of the first."""
    ending = F.rtrim("text", F.lit(SPACE))
    fault = F.when(ending == "", F.lit(BLANK)).when(F.substring(ending, -1, 1).isin(".", "!", "?"), F.lit(CLEAN)).otherwise(F.lit(TRUNCATED))
    distinct = placed.withColumn("fault", fault).groupBy("conv_id", *PLACE).agg(F.first("fault").alias("fault"), F.sum("times").alias("times"))
    distinct = stored(distinct, "turns")
    place = F.struct("has_turn", "turn")
    # said again at other turns: counted on the map side, and stored so that a hot one is split in the join
    first = distinct.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stored(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "again")
    met = distinct.join(again, distinct.conv_id.eqNullSafe(again.c) & (distinct.role == again.r) & (distinct.digest == again.d), "left")
    later = F.col("first").isNotNull() & (F.col("first") < place)
    return met.withColumn("fault", F.when(later, F.lit(DUPLICATE)).otherwise(F.col("fault"))).select("conv_id", *PLACE, "times", "fault")


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``most`` rows of one conversation from rows in order."""
    block: dict | None = None
    for b in cuts(batches):
        done = []
        for row in b.to_pylist():
            if block is None or block["conv_id"] != row["conv_id"] or len(block["codes"]) >= 2 * most:
                if block is not None:
                    done.append(block)
                block = {"conv_id": row["conv_id"], **{c: row[c] for c in PLACE}, "codes": "", **dict.fromkeys(COUNTS, 0)}
            fault, again = row["fault"], row["times"] - 1
            role = row["role"][:1] if row["role"][:1] in ("s", "u", "a") else "-"
            block["codes"] += role + fault
            block["blank"] += again + 1 if fault == BLANK else 0
            block["duplicate"] += again + (fault == DUPLICATE) if fault != BLANK else 0
            block["truncated"] += fault == TRUNCATED
            block["extra"] += DELETE * again  # copies at one turn go, whatever else is done
        yield _batch(done, names, b.schema)
    if block is not None:
        yield _batch([block], names, b.schema)


def _batch(rows: list[dict], names: list[str], like: pa.Schema) -> pa.RecordBatch:
    kinds = {"codes": pa.string(), "audit": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "after": pa.list_(pa.int64())}
    typed = [(n, kinds.get(n) or (like.field(n).type if n in like.names else pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in typed], names=names)


# blocks and ways through them


def _ways(codes: str) -> tuple[list[int | None], list[str | None]]:
    """Costs and letters between all roles (16), then from each role to the conversation's end (4)."""
    rows = _rows_of(codes)
    found = [cheapest(rows, p, frozenset({q}), False) for p in range(4) for q in range(4)] + [cheapest(rows, p) for p in range(4)]
    return [f and f[0] for f in found], [f and f[1] for f in found]


def _backward(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Gives every block, last first, the costs after it; null after the last."""
    conv, after = object(), None
    for b in cuts(batches):
        rows = b.to_pylist()
        for r in rows:
            if r["conv_id"] != conv:
                conv, after = r["conv_id"], None
            r["after"] = after
            costs = r["costs"]
            if after is None:
                after = costs[16:]
            else:
                after = [min((costs[4 * p + q] + after[q] for q in range(4) if costs[4 * p + q] is not None and after[q] is not None), default=None) for p in range(4)]
        yield _batch(rows, names, b.schema)


def _forward(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Takes the cheapest way through the blocks, first to last."""
    conv, role = object(), START
    for b in cuts(batches):
        rows = b.to_pylist()
        for r in rows:
            if r["conv_id"] != conv:
                conv, role = r["conv_id"], START
            r["entry"], costs, audits, after = role, r["costs"], r["audits"], r["after"]
            if after is None:
                at = 16 + role
            else:
                open_ways = [q for q in range(4) if costs[4 * role + q] is not None and after[q] is not None]
                role = min(open_ways, key=lambda q: (costs[4 * role + q] + after[q], audits[4 * role + q]))  # noqa: B023
                at = 4 * r["entry"] + role
            r["cost"], r["audit"] = costs[at], audits[at]
        yield _batch(rows, names, b.schema)


def _solved(placed: DataFrame, kind: str, block_rows: int) -> DataFrame:
    """(conv_id, place of its first row, counts, entry, cost, audit) of every block."""
    head = f"conv_id {kind}, {PLACE_TYPES}"
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    names = ["conv_id", *PLACE]
    ordered = _marked(placed).repartitionByRange("conv_id", *PLACE).sortWithinPartitions("conv_id", *PLACE)
    blocks = stored(ordered.mapInArrow(lambda it: _cut(it, [*names, "codes", *COUNTS], block_rows), f"{head}, codes string, {counts}"), "blocks")
    many = stored(blocks.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c")), "long")

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.to_pylist()
        for r in rows:
            (r["cost"], r["audit"]), r["entry"] = cheapest(_rows_of(r["codes"])), START
        return _batch(rows, [*names, *COUNTS, "entry", "cost", "audit"], b.schema)

    def between(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.to_pylist()
        for r in rows:
            r["costs"], r["audits"] = _ways(r["codes"])
        return _batch(rows, [*names, *COUNTS, "costs", "audits"], b.schema)

    same = blocks.conv_id.eqNullSafe(many.c)
    done = f"{head}, {counts}, entry bigint, cost bigint, audit string"
    short = per_batch(blocks.join(many, same, "left_anti"), whole, done)
    ways = per_batch(blocks.join(many, same, "left_semi"), between, f"{head}, {counts}, costs array<bigint>, audits array<string>")
    # blocks of one conversation stream through one task: a small row for ``block_rows`` of its rows
    falling = ways.repartition("conv_id").sortWithinPartitions("conv_id", *[F.desc(c) for c in PLACE])
    summed = falling.mapInArrow(lambda it: _backward(it, [*names, *COUNTS, "costs", "audits", "after"]), f"{head}, {counts}, costs array<bigint>, audits array<string>, after array<bigint>")
    rising = stored(summed, "ways").repartition("conv_id").sortWithinPartitions("conv_id", *PLACE)
    long = rising.mapInArrow(lambda it: _forward(it, [*names, *COUNTS, "entry", "cost", "audit"]), done)
    return stored(short.union(long), "edits")


# rows beside their edits


class _Edited:
    """Walks through the rows of one conversation with the letters of their block."""

    def __init__(self):
        self.letters, self.at, self.role, self.last = "", 0, START, None

    def head(self, entry: int, letters: str) -> None:
        self.letters, self.at, self.role = letters, 0, entry

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.role, self.at = ADDED[self.role], self.at + 1
            yield "I", NAMES[self.role], ""

    def row(self, key: tuple, role: str, text: str) -> Iterator[tuple[str, str | None, str]]:
        """(letter, role or None if deleted, text) of what becomes of a row, inserts before it included."""
        if key == self.last:
            yield "D", None, ""
            return
        self.last = key
        yield from self._inserted()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "R":
            self.role = ADDED[self.role]
            role = NAMES[self.role]
        elif letter == "K":
            self.role = FOLLOWS[self.role][role[:1]]
        yield letter, None if letter == "D" else role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class _Line(NamedTuple):
    """A line of the merged stream: a conversation's facts (rank 0), a block's edits (kind 0) or a row (kind 1)."""

    conv_id: object
    rank: int
    kind: int
    key: tuple
    role: str
    text: str
    values: list[int]
    audit: str


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[_Line]:
    for b in cuts(batches):
        columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            key = tuple(columns[c][i] for c in ("turn", "role", "digest"))
            yield _Line(columns["conv_id"][i], columns["rank"][i], columns["kind"][i], key, columns["role"][i], columns["text"][i], columns["values"][i], columns["audit"][i])


def _summaries(batches: Iterator[pa.RecordBatch], kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The report's row of each conversation."""
    for conv, lines in itertools.groupby(_lines(batches), key=lambda line: line.conv_id):
        walk, audit, total, before, first = _Edited(), [], hashlib.sha256(), None, True
        out = dict.fromkeys(names, 0)

        def take(parts: Iterator[tuple[str, str | None, str]]) -> None:
            nonlocal first
            for letter, role, text in parts:
                audit.append(letter)  # noqa: B023
                if role is not None:
                    total.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogateescape"))  # noqa: B023
                    first = False

        for line in lines:
            if line.rank == 0:
                out["gaps"] = line.values[0]
            elif line.kind == 0:
                take(walk.end())
                for name, value in zip(("blank", "duplicate", "truncated"), line.values, strict=False):
                    out[name] += value
                out["cost"] += line.values[3] + line.values[5]
                walk.head(line.values[4], line.audit)
            else:
                now = line.role[:1]
                out["illegal"] += before is not None and before + now not in ("su", "ua", "au")
                before = now
                take(walk.row(line.key, line.role, line.text))
        take(walk.end())
        out |= {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": total.hexdigest()}
        types = {"conv_id": kind, "audit": pa.string(), "repaired_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([out[n]], types.get(n, pa.int64())) for n in names], names=names)


def _repaired_rows(batches: Iterator[pa.RecordBatch], kind: pa.DataType, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """(conv_id, position, role, text) of what is kept, reroled and inserted."""
    names, types = ["conv_id", "position", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()]

    def rows() -> Iterator[tuple]:
        for conv, lines in itertools.groupby(_lines(batches), key=lambda line: line.conv_id):
            walk, position = _Edited(), 0
            for line in itertools.chain(lines, [None]):
                if line is None:
                    parts = walk.end()
                elif line.rank == 0:
                    continue
                elif line.kind == 0:
                    parts = list(walk.end())
                    walk.head(line.values[4], line.audit)
                else:
                    parts = walk.row(line.key, line.role, line.text)
                for _, role, text in parts:
                    if role is not None:
                        yield conv, position, role, text
                        position += 1

    waiting: list[tuple] = []
    size = 0
    for row in rows():
        waiting.append(row)
        size += len(row[3])
        if len(waiting) >= most or size > 1 << 21:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), types, strict=True)], names=names)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), types, strict=True)], names=names)


def _merged(conversations: DataFrame, damage: bool, block_rows: int) -> DataFrame:
    """Facts, edits and rows of every conversation in order, each conversation in one task."""
    flat = clash_free(conversations, "conv_id", "turn", "role", "text")
    placed = _placed(_struck(flat) if damage else _undamaged(flat))
    solved = _solved(placed, flat.schema["conv_id"].dataType.simpleString(), block_rows)
    left = F.when(_damage() != 0, F.col("turn").cast("bigint")) if damage else F.col("turn").cast("bigint")
    whole = "cast({} as decimal(38, 0))"
    gaps = F.expr(f"coalesce(try_cast({whole.format('high')} - {whole.format('low')} + 1 - n as bigint), 0)")
    facts = flat.select("conv_id", left.alias("t")).groupBy("conv_id").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.countDistinct("t").alias("n"))
    none = lambda *c: [F.lit(None).cast(t).alias(n) for n, t in c]
    places = [tuple(c.split()) for c in PLACE_TYPES.split(", ")]
    lines = facts.select("conv_id", F.lit(0).alias("rank"), *none(*places), F.lit(0).alias("kind"), *none(("text", "string")), F.array(gaps).alias("values"), *none(("audit", "string")))
    values = F.array(*COUNTS[:3], "extra", "entry", "cost").alias("values")
    heads = solved.select("conv_id", F.lit(1).alias("rank"), *PLACE, F.lit(0).alias("kind"), *none(("text", "string")), values, "audit")
    again = placed.withColumn("_", F.explode(F.array_repeat(F.lit(True), F.col("times"))))
    rows = again.select("conv_id", F.lit(1).alias("rank"), *PLACE, F.lit(1).alias("kind"), "text", *none(("values", "array<bigint>"), ("audit", "string")))
    return lines.union(heads).union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "rank", *PLACE, "kind")


def _arrow(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after the damage.

    Rows go by turn, nulls first; rows of one turn by role, the first characters of the text and
    its SHA-256, so repeated rows lie side by side. Rows without a conv_id are one conversation.
    A null role or text is one space. A role that begins with no letter of the pattern, the
    empty one too, can only be reroled or deleted. A conversation without rows gives zeros, an
    empty audit and the hash of nothing; an empty table gives an empty one. Texts are hashed
    whole; other columns are not looked at. ``gaps`` beyond a long is 0.
    """
    kind = clash_free(conversations, "conv_id").schema["conv_id"].dataType
    names = ["conv_id", *[c.split()[0] for c in REPORT.split(", ")]]
    arrow = _arrow(kind)
    return _merged(conversations, True, block_rows).mapInArrow(lambda it: _summaries(it, arrow, names), f"conv_id {kind.simpleString()}, {REPORT}")


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, position, role, text): the conversations as they are, repaired by the cheapest edits.

    No damage is done here. Rows and ties as in ``report``; a conversation of which nothing is
    left has no rows.
    """
    kind = clash_free(conversations, "conv_id").schema["conv_id"].dataType
    arrow = _arrow(kind)
    return _merged(conversations, False, block_rows).mapInArrow(lambda it: _repaired_rows(it, arrow), f"conv_id {kind.simpleString()}, position bigint, role string, text string")
