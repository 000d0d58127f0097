"""Conversation structure repair: cheapest edits of turns by a cost DP, ties by prefix doubling.

A conversation is right when its role initials read `(s?(ua)+)?`. Turns can be kept (K),
given the role user or assistant (R), deleted (D) or new ones inserted (I). Nodes are (turn
at hand, last role); a DP from the end gives each node's least cost. Of the arcs on cheapest
paths, nodes are ranked by the first 1, 2, 4, ... letters of their audit: the rank for twice
the length is the rank of (own rank, rank of the node behind the doubled pointer). Ranks pick
the least arc of every node, and the doubled pointers give all places of the least path.

Work is spread by range: rows are shuffled by (conversation, turn, role, text digest), so a
long conversation is cut across tasks. Conversations that lie inside one task are finished
there, many at a time. Pieces of others carry a 4 x 4 table of least costs between their
ends; these are folded backwards, one piece after the other, and a second pass walks
forwards. That pass streams a conversation's pieces through one task with bounded memory,
as the one digest over its repaired text needs them in order; only the audit grows with it.

Defined cases: null ids form one conversation; null roles and texts are one space; turns sort
with nulls first, equal turns by role and text digest; repeated rows are duplicates; a
conversation without rows (all dropped) has zeros, no audit and the digest of nothing; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storepulse.llm.common import pick, stored

BLANKS = " \t\n\x0b\x0c\r"
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_LETTERS = np.frombuffer(b" DIKR", np.uint8)
_DELETE_COST, _INSERT_COST, _REROLE_COST, _TRUNCATED_COST = 2, 5, 1, 5
# States: nothing yet, after system, after user, after assistant. Initials: s, u, a, any other.
_CODE = {"s": 0, "u": 1, "a": 2}
_KEEPS = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_NEXT = np.array([2, 2, 3, 2])
_ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 40
# Least cost from each state when no turn is left.
_CLOSED = np.array([0, 2 * _INSERT_COST, _INSERT_COST, 0], np.int64)
LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class PieceLimits:
    """Rows and bytes of text of one piece (a row more for bytes); results are the same for all limits."""

    rows: int = 1024
    bytes: int = 256 << 10


def damage(rows: DataFrame) -> DataFrame:
    """The planned faults of (conv_id, turn, role, text), by a hash of conversation and turn.

    Returns those columns and `dropped`; dropped rows stay as marks of their conversation.
    """
    base = pick(rows, "conv_id", "turn", "role", "text")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return base.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), copies.alias("copy"),
    ).drop("copy")


# --- cost DP and path ranks over a block of pieces -----------------------------------------

def least_costs(code: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost to finish from every (row, state) of pieces laid end to end.

    code, must, cut: initial, whether the row has to go, whether it is truncated. sizes: rows
    of each piece. ends: cost by state behind each piece. A piece has one node row more than
    rows, the one behind it. All pieces step back from their ends together.
    """
    tops = sizes.cumsum() + np.arange(len(sizes))
    cost = np.full((int(sizes.sum()) + len(sizes), 4), _FAR, np.int64)
    cost[tops] = ends
    rows_end = sizes.cumsum()
    order = np.argsort(-sizes, kind="stable")
    longest_first = sizes[order]
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = order[: np.searchsorted(-longest_first, -back, side="right")]
        row, node = rows_end[live] - back, tops[live] - back
        cost[node] = _insert_first(_row_costs(code[row], must[row], cut[row], cost[node + 1]).min(axis=0))
    return cost


def _row_costs(code, must, cut, after) -> np.ndarray:
    """Costs of deleting, keeping and reroling a row by state, given the costs after it: (3, rows, 4)."""
    spent = np.where(cut, _TRUNCATED_COST, 0)[:, None]
    barred = np.where(must, _FAR, 0)[:, None]
    target = _KEEPS[:, code].T
    keep = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), axis=1), _FAR) + spent + barred
    fits = target == _NEXT
    rerole = np.where(fits, _FAR, after[:, _NEXT]) + _REROLE_COST + spent + barred
    return np.minimum(np.stack([after + _DELETE_COST, keep, rerole]), _FAR)


def _insert_first(here: np.ndarray) -> np.ndarray:
    """Up to two new turns before the row; a third would only return to the same state."""
    once = here[:, _NEXT] + _INSERT_COST
    twice = here[:, _NEXT[_NEXT]] + 2 * _INSERT_COST
    return np.minimum(np.minimum(here, np.minimum(once, twice)), _FAR)


def least_paths(code, must, cut, sizes, ends, closed, entry) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ASCII-least cheapest path of each piece from its entry state.

    closed: whether nothing follows the piece, so that turns may still be inserted behind it.
    Returns (steps per piece, letter, row, state after) of all steps, and per piece the cost
    and the state at its end.
    """
    cost = least_costs(code, must, cut, sizes, ends)
    nodes = len(cost)
    top = np.zeros(nodes, bool)
    top[sizes.cumsum() + np.arange(len(sizes))] = True
    after = np.roll(cost, -1, axis=0)
    node_of_row = np.flatnonzero(~top)
    options = np.full((4, nodes, 4), _FAR, np.int64)
    rows = _row_costs(code, must, cut, after[node_of_row])
    options[0][node_of_row], options[2][node_of_row], options[3][node_of_row] = rows
    options[1] = cost[:, _NEXT] + _INSERT_COST
    options[1][np.flatnonzero(top)[~closed]] = _FAR
    optimal = (options == cost) & (cost < _FAR)
    # Nodes are numbered row by row and state by state; a path ends at a node that points to itself.
    here = np.arange(nodes)[:, None] * 4
    state = np.arange(4)
    keeps = np.zeros((nodes, 4), np.int64)
    keeps[node_of_row] = _KEEPS[:, code].T
    targets = np.stack([here + 4 + state, here + _NEXT, here + 4 + keeps, here + 4 + _NEXT]).reshape(4, -1)
    optimal = optimal.reshape(4, -1)
    letters = np.arange(1, 5)[:, None]
    letter = np.where(optimal, letters, 5).min(axis=0)
    letter[letter == 5] = 0
    own = np.arange(nodes * 4)
    step = np.where(letter > 0, targets[np.maximum(letter - 1, 0), own], own)
    rank, pointers = letter, [step]
    while True:
        pair = rank.astype(np.int64) * (nodes * 4 + 5) + rank[pointers[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        double = pointers[-1][pointers[-1]]
        if (double == pointers[-1]).all():
            break
        pointers.append(double)
    # Among its cheapest arcs a node takes the one with the least (letter, rank behind it).
    keys = np.where(optimal, letters * (nodes * 4 + 5) + rank[np.where(optimal, targets, own)], np.iinfo(np.int64).max)
    best = keys.argmin(axis=0)
    step = np.where(letter > 0, targets[best, own], own)
    letter = np.where(letter > 0, best + 1, 0)
    pointers = [step]
    while not ((double := pointers[-1][pointers[-1]]) == pointers[-1]).all():
        pointers.append(double)
    first = (sizes.cumsum() - sizes + np.arange(len(sizes))) * 4 + entry
    last, steps = first, np.zeros(len(sizes), np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        # As far as pointers go without reaching the end of the path.
        far = pointers[k][last]
        short = step[far] != far
        steps += np.where(short, 1 << k, 0)
        last = np.where(short, far, last)
    steps += step[last] != last
    at = np.repeat(first, steps)
    place = np.arange(len(at)) - np.repeat(steps.cumsum() - steps, steps)
    for k, pointer in enumerate(pointers):
        at = np.where(place >> k & 1, pointer[at], at)
    piece = np.repeat(np.arange(len(sizes)), steps)
    return steps, letter[at], at // 4 - piece, step[at] % 4, cost.ravel()[first], step[last] % 4


# --- pieces --------------------------------------------------------------------------------

@dataclass
class Piece:
    """Consecutive rows of one conversation, with what its neighbours need to know."""

    key: object
    seq: int
    open: bool = False
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    code: list = field(default_factory=list)
    must: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    held: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: object = None
    high: object = None

    def add(self, turn, role, text, blank, repeated, cut) -> None:
        initial = role[:1]
        if self.roles and self.roles[-1][:1] + initial not in LEGAL:
            self.illegal += 1
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut and not (blank or repeated)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.roles.append(role)
        self.texts.append(text)
        self.code.append(_CODE.get(initial, 3))
        self.must.append(blank or repeated)
        self.cut.append(cut and not (blank or repeated))
        self.held += len(text)

    def join(self, later: Piece) -> None:
        """Add the facts of the next piece; its rows stay out."""
        if self.roles and later.roles:
            self.illegal += later.illegal + (self.roles[-1][:1] + later.roles[0][:1] not in LEGAL)
        else:
            self.illegal += later.illegal
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        self.turns += later.turns - (later.turns > 0 and self.high == later.low)
        self.low = later.low if self.low is None else self.low
        self.high = self.high if later.high is None else later.high
        self.roles = later.roles[-1:] or self.roles[-1:]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns


def _arrays(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = lambda name, kind: np.array([x for p in pieces for x in getattr(p, name)], kind)
    return flat("code", np.int64), flat("must", bool), flat("cut", bool), np.array([len(p.roles) for p in pieces], np.int64)


def _tables(pieces: list[Piece]) -> np.ndarray:
    """Least costs from each state before a piece to each state behind it: (pieces, 4, 4)."""
    code, must, cut, sizes = _arrays(pieces)
    starts = sizes.cumsum() - sizes + np.arange(len(sizes))
    columns = []
    for state in range(4):
        ends = np.full((len(pieces), 4), _FAR, np.int64)
        ends[:, state] = 0
        columns.append(least_costs(code, must, cut, sizes, ends)[starts])
    return np.stack(columns, axis=2)


def _read_pieces(batches: Iterator[pa.RecordBatch], limits: PieceLimits) -> Iterator[Piece]:
    """Pieces of a task's sorted rows. The first and the last conversation may go on in other tasks."""
    seq, piece, last = 0, None, None
    first_key = None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "blank", "earlier", "cut")]
        for key, turn, role, text, dropped, blank, earlier, cut in zip(*columns):
            if piece is None:
                first_key = (key,)
            if piece is None or piece.key != key or len(piece.roles) >= limits.rows or piece.held >= limits.bytes:
                same = piece is not None and piece.key == key
                if piece is not None:
                    piece.open |= same or (piece.key,) == first_key
                    yield piece
                piece = Piece(key, seq, open=same)
                seq += 1
                last = last if same else None
            if not dropped:
                this = (turn, role, text)
                piece.add(turn, role, text, blank, earlier or this == last, cut)
                last = this
    if piece is not None:
        piece.open = True
        yield piece


def _blocks(pieces: Iterator[Piece]) -> Iterator[list[Piece]]:
    """Lists of pieces, all open or all complete, of a bounded number of rows and bytes."""
    held: dict[bool, list[Piece]] = {True: [], False: []}
    load: dict[bool, list[int]] = {True: [0, 0], False: [0, 0]}
    for piece in pieces:
        held[piece.open].append(piece)
        amount = load[piece.open]
        amount[0], amount[1] = amount[0] + len(piece.roles) + 1, amount[1] + piece.held
        if amount[0] >= BLOCK_ROWS or amount[1] >= BLOCK_BYTES:
            yield held[piece.open]
            held[piece.open], load[piece.open] = [], [0, 0]
    yield from filter(None, held.values())


def _repaired(piece: Piece, letters, rows, states, base: int) -> Iterator[tuple[int, str, bytes]]:
    """(letter, role, text) of the turns that a path leaves or adds."""
    for letter, row, state in zip(letters.tolist(), rows.tolist(), states.tolist()):
        if letter == KEEP:
            yield letter, piece.roles[row - base], piece.texts[row - base]
        elif letter == REROLE:
            yield letter, _ROLE[state], piece.texts[row - base]
        elif letter == INSERT:
            yield letter, _ROLE[state], b""


@dataclass
class Walk:
    """A conversation on its way: facts so far, audit, cost and running digest."""

    facts: Piece
    cost: int = 0
    state: int = 0
    audit: bytearray = field(default_factory=bytearray)
    digest: object = field(default_factory=hashlib.sha256)
    written: int = 0

    def take(self, turns: Iterator[tuple[int, str, bytes]]) -> Iterator[tuple[int, str, str, bytes]]:
        for letter, role, text in turns:
            self.digest.update(b"\n" * (self.written > 0) + role.encode() + b":" + text)
            yield self.written, "  IKR"[letter], role, text
            self.written += 1

    def row(self) -> tuple:
        f = self.facts
        return (f.key, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _walk(pieces: list[Piece], ends: np.ndarray, closed: np.ndarray, walks: list[Walk]) -> Iterator[tuple[Walk, list]]:
    """Solve pieces from their walks' states; each with the turns it leaves."""
    code, must, cut, sizes = _arrays(pieces)
    entry = np.array([w.state for w in walks])
    steps, letters, rows, states, cost, after = least_paths(code, must, cut, sizes, ends, closed, entry)
    stops, bases = steps.cumsum(), sizes.cumsum() - sizes
    for i, (piece, walk) in enumerate(zip(pieces, walks)):
        part = slice(int(stops[i] - steps[i]), int(stops[i]))
        if not walk.audit and not walk.written:
            walk.cost = int(cost[i])
        walk.audit += _LETTERS[letters[part]].tobytes()
        walk.state = int(after[i])
        yield walk, list(walk.take(_repaired(piece, letters[part], rows[part], states[part], int(bases[i]))))


# --- operator ------------------------------------------------------------------------------

_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text binary"
_PIECES = ("part int, seq int, roles array<string>, texts array<binary>, code binary, must binary, cut binary, blank long, "
           "duplicate long, truncated long, illegal long, turns long, low long, high long, costs array<long>")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their faults, ready to be walked in order.

    Duplicates of an earlier turn are found by the first turn of each (conversation, role,
    text digest); only digests that occur at more than one turn are joined back. Equal rows
    of the same turn become neighbours in the sort.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    marked = rows.withColumns({
        "turn": F.col("turn").cast("long"), "digest": digest,
        "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?"),
    })
    first = marked.filter("not dropped").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(
        F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")
    ).filter("not first.turn <=> last.turn").select("of", "same", "first")
    known = F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("same") == F.col("digest"))
    return marked.join(first, known, "left").select(
        "conv_id", "turn", "role", "text", "dropped", "digest", "blank", "cut",
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("earlier"),
    )


def _first_pass(marked: DataFrame, output: str, limits: PieceLimits) -> DataFrame:
    """One sorted pass: results of conversations that lie inside a task, open pieces of the others."""
    key = marked.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, {_TURNS if output == 'turns' else _FACTS}, open struct<{_PIECES}>"
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block in _blocks(_read_pieces(batches, limits)):
            if block[0].open:
                opened = [
                    (p.key, *[None] * (len(arrow) - 2), {
                        "part": part, "seq": p.seq, "roles": p.roles, "texts": p.texts, "code": bytes(p.code),
                        "must": bytes(p.must), "cut": bytes(p.cut), "blank": p.blank, "duplicate": p.duplicate,
                        "truncated": p.truncated, "illegal": p.illegal, "turns": p.turns, "low": p.low, "high": p.high,
                        "costs": table.ravel().tolist(),
                    }) for p, table in zip(block, _tables(block))
                ]
                yield _batch(opened, arrow)
            else:
                ends = np.tile(_CLOSED, (len(block), 1))
                walks = [Walk(p) for p in block]
                solved = list(_walk(block, ends, np.ones(len(block), bool), walks))
                yield _batch(_results(solved, output, None), arrow)

    text = F.col("text").cast("binary").alias("text")
    return (
        marked.select("conv_id", "turn", "role", text, "dropped", "digest", "blank", "cut", "earlier")
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").mapInArrow(run, schema)
    )


def _arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a schema in DDL, made on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _results(solved: list[tuple[Walk, list]], output: str, *tail) -> list[tuple]:
    if output == "turns":
        return [(walk.facts.key, *turn, *tail) for walk, turns in solved for turn in turns]
    return [(*walk.row(), *tail) for walk, _ in solved]


def _costs_behind(pieces: DataFrame) -> DataFrame:
    """(part, seq, ends, closed) of every open piece: tables folded from the last piece to the first."""
    back = [F.desc_nulls_last("conv_id"), F.desc("part"), F.desc("seq")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = object(), None
        for batch in batches:
            out = []
            for conv, part, seq, costs in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "seq", "costs"))):
                closed = conv != key
                ends, key = _CLOSED if closed else ends, conv
                out.append((part, seq, ends.tolist(), closed))
                ends = np.minimum((np.array(costs, np.int64).reshape(4, 4) + ends).min(axis=1), _FAR)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()))],
                ["part", "seq", "ends", "closed"])

    narrow = pieces.select("conv_id", "part", "seq", "costs")
    return narrow.repartition("conv_id").sortWithinPartitions(*back).mapInArrow(
        fold, "part int, seq int, ends array<long>, closed boolean")


def _second_pass(pieces: DataFrame, output: str) -> DataFrame:
    """Walk the pieces of each open conversation forwards, one piece in memory at a time."""
    key = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, {_TURNS if output == 'turns' else _FACTS}"
    types = _arrow_schema(schema)
    order = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("seq")]
    facts = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                piece = Piece(row["conv_id"], row["seq"], True, row["roles"], row["texts"], list(row["code"]), list(row["must"]),
                              list(row["cut"]), **{n: row[n] for n in facts})
                if walk is not None and walk.facts.key == piece.key:
                    walk.facts.join(piece)
                else:
                    if walk is not None and output != "turns":
                        yield _batch([walk.row()], types)
                    walk = Walk(Piece(piece.key, 0, True, piece.roles[-1:], **{n: row[n] for n in facts}))
                solved = list(_walk([piece], np.array([row["ends"]], np.int64), np.array([row["closed"]]), [walk]))
                if output == "turns":
                    yield _batch(_results(solved, output), types)
        if walk is not None and output != "turns":
            yield _batch([walk.row()], types)

    joined = pieces.join(_costs_behind(pieces), ["part", "seq"])
    columns = ["conv_id", "part", "seq", "roles", "texts", "code", "must", "cut", *facts, "ends", "closed"]
    return joined.select(*columns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _repair(rows: DataFrame, output: str, limits: PieceLimits) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    if "dropped" in rows.columns:
        rows = pick(rows, *names, "dropped")
    else:
        rows = pick(rows, *names).withColumn("dropped", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumns({"role": text("role"), "text": text("text")})
    first = stored(_first_pass(_marked(rows), output, limits), f"conversations-{output}")
    columns = [c for c in first.columns if c != "open"]
    return first.filter("open is null").select(*columns).unionByName(
        _second_pass(first.filter("open is not null").select("conv_id", "open.*"), output)
    )


def repair(rows: DataFrame, limits: PieceLimits = PieceLimits()) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text[, dropped]): the faults, cost and
    audit of the cheapest repair, and the SHA-256 of the repaired `role:text` lines."""
    return _repair(rows, "facts", limits)


def repaired_turns(rows: DataFrame, limits: PieceLimits = PieceLimits()) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, place, edit, role, text)."""
    return _repair(rows, "turns", limits).withColumn("text", F.col("text").cast("string"))
