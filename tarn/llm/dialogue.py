"""Repair of damaged conversations by a Viterbi search with coalescing survivors.

A conversation is right if the initials of its roles are ``(s?(ua)+)?``. Four
states follow that pattern; a row is kept, given another role or deleted, and
empty turns may be inserted anywhere. Each state keeps one survivor: the
cheapest edits so far, of equal ones the least in ASCII. Survivors are leaves of
a tree of back pointers. Branches without survivors are cut off by their
reference counts, and what all survivors share is handed out at once, so a
conversation is never held whole: only the rows that are still open are.

Edits of equal cost over the same rows are never one the beginning of the other
(a longer one has more insertions, each at a price). So two tied suffixes are
ordered by the first letters in which they differ, and these two letters are all
that need be kept for each pair of survivors to compare complete suffixes, how
ever long they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarn.llm.buffers import tidy

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, OPEN_END = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
OUT_ROWS = 4096

Move = tuple[int, int, str, str]


def inserted(state: int) -> Iterator[tuple[int, str, str]]:
    """(state, letters, initials) after no, one or two inserted turns; more would come back to a state."""
    yield state, "", ""
    seen, letters, initials = {state}, "", ""
    while (step := next(((r, NEXT[state, r]) for r in "ua" if (state, r) in NEXT), None)) and step[1] not in seen:
        initials, state, letters = initials + step[0], step[1], letters + "I"
        seen.add(state)
        yield state, letters, initials


def moves(initial: str, fault: int) -> list[list[Move]]:
    """For each state reached, (state before, cost, letters, initials put out): the best over one row from each."""
    best: list[dict[int, Move]] = [{} for _ in range(4)]
    for before in range(4):
        direct = [(before, DELETE, "D", "")]
        if fault not in (BLANK, DUPLICATE):
            more = OPEN_END if fault == TRUNCATED else 0
            direct += [(NEXT[before, initial], more, "K", initial)] if (before, initial) in NEXT else []
            direct += [(NEXT[before, r], REROLE + more, "R", r) for r in "ua" if (before, r) in NEXT]
        for at, cost, letter, own in direct:
            for state, letters, initials in inserted(at):
                move = (before, cost + INSERT * len(letters), letter + letters, own + initials)
                if before not in best[state] or move[1:3] < best[state][before][1:3]:
                    best[state][before] = move
    return [list(x.values()) for x in best]


MOVES = {(initial, fault): moves(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Node:
    """A piece of a survivor's edits: the letters for one row and the turns inserted after it."""

    __slots__ = ("parent", "letters", "initials", "row", "references", "children")

    def __init__(self, parent: Node | None, letters: str, initials: str, row: tuple | None) -> None:
        self.parent, self.letters, self.initials, self.row = parent, letters, initials, row
        self.references, self.children = 0, []
        if parent is not None:
            parent.children.append(self)
            parent.references += 1


class Search:
    """The survivors of one conversation, and the tree of their open edits."""

    def __init__(self) -> None:
        self.root = Node(None, "", "", None)
        self.cost: dict[int, int] = {}
        self.leaf: dict[int, Node] = {}
        for state, letters, initials in inserted(START):
            self.cost[state] = INSERT * len(letters)
            self.leaf[state] = Node(self.root, letters, initials, None) if letters else self.root
            self.leaf[state].references += 1
        self.tails = {(x, y): self.apart(self.leaf[x].letters, self.leaf[y].letters) for x in self.cost for y in self.cost}

    @staticmethod
    def apart(x: str, y: str) -> tuple[str, str]:
        """What two suffixes have beyond their common beginning; one letter is enough if both have any."""
        same = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        x, y = x[same:], y[same:]
        return (x[0], y[0]) if x and y else (x, y)

    def step(self, row: tuple, initial: str, fault: int) -> None:
        """Take one more row."""
        chosen: dict[int, tuple[int, Move]] = {}
        for state, options in enumerate(MOVES[initial if initial in ("s", "u", "a") else "", fault]):
            best: tuple[int, Move] | None = None
            for move in options:
                if move[0] not in self.cost:
                    continue
                total = self.cost[move[0]] + move[1]
                if best is None or total < best[0] or (total == best[0] and self.less(move, best[1])):
                    best = (total, move)
            if best:
                chosen[state] = best
        # Whatever follows START costs at most one deletion more after ASSISTANT, and after SYSTEM nothing more.
        least = chosen[ASSISTANT][0]
        for state, most in ((START, least + DELETE), (SYSTEM, least)):
            if state in chosen and chosen[state][0] > most:
                del chosen[state]
        leaf = {state: Node(self.leaf[move[0]], move[2], move[3], row) for state, (_, move) in chosen.items()}
        self.tails = {(x, y): self.apart(*self.suffixes(chosen[x][1], chosen[y][1])) for x in chosen for y in chosen}
        for node in leaf.values():
            node.references += 1
        for node in self.leaf.values():
            node.references -= 1
            self.cut(node)
        self.leaf, self.cost = leaf, {state: total for state, (total, _) in chosen.items()}

    def suffixes(self, x: Move, y: Move) -> tuple[str, str]:
        tail = self.tails[x[0], y[0]]
        return tail[0] + x[2], tail[1] + y[2]

    def less(self, x: Move, y: Move) -> bool:
        a, b = self.suffixes(x, y)
        return a < b

    def cut(self, node: Node) -> None:
        """Take away a branch that no survivor needs."""
        while not node.references and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.references -= 1
            node.parent, node = None, parent

    def settled(self) -> Iterator[Node]:
        """The edits that all survivors share, which leave the tree."""
        while self.root.references == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root

    def finish(self) -> Iterator[Node]:
        """The rest of the cheapest edits that end in a right conversation."""
        end = ASSISTANT
        if START in self.cost:
            x, y = self.tails[START, ASSISTANT]
            if (self.cost[START], x) < (self.cost[ASSISTANT], y):
                end = START
        for state, node in self.leaf.items():
            if state != end:
                node.references -= 1
                self.cut(node)
        yield from self.settled()


FIELDS = "edit string, cost long, turn long, was string, fault int, role string, text string"


def edits_of(node: Node) -> Iterator[tuple]:
    """(edit, cost, turn, role before, fault, role, text) of each letter."""
    initials = iter(node.initials)
    for letter in node.letters:
        if letter == "I":
            yield "I", INSERT, None, None, None, NAMES[next(initials)], ""
            continue
        turn, role, text, fault = node.row
        if letter == "D":
            yield "D", DELETE, turn, role, fault, None, None
            continue
        initial, more = next(initials), OPEN_END if fault == TRUNCATED else 0
        yield letter, more + (REROLE if letter == "R" else 0), turn, role, fault, NAMES[initial] if letter == "R" else role, text


def _repair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn become edits in that order."""
    out: list[tuple] = []
    search, current, kind = None, None, None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *(f.split()[0] for f in FIELDS.split(", "))])
        out.clear()
        return made

    def close() -> None:
        for node in search.finish():
            out.extend((current, *e) for e in edits_of(node))

    for rows in batches:
        kind = rows.schema.field(0).type
        for conv, turn, role, text, fault, lost in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if search is None or conv != current:
                if search is not None:
                    close()
                search, current = Search(), conv
                # Every conversation begins with a row without edit, so that one without rows is told too.
                out.append((conv, None, 0, None, None, None, None, None))
            if not lost:
                search.step((turn, role, text, fault), role[:1], fault)
                for node in search.settled():
                    out.extend((current, *e) for e in edits_of(node))
            if len(out) >= OUT_ROWS:
                yield batch()
    if search is not None:
        close()
        yield batch()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 loses the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it,
    4 makes its role user; 5 to 19 leave it. Nulls are one space, in the key too.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def repair(conversations: DataFrame) -> DataFrame:
    """Edits that make conversations right, in order within each: (conv_id, edit, cost, turn, was, fault, role, text).

    ``conversations`` has conv_id, turn, role, text, and may have ``lost``: rows
    that are known to be gone, but whose conversation is to be told. Edits are K
    (keep), R (another role), D (delete) and I (insert); ``was`` is the role
    before, role and text what the edit leaves (null if deleted). The fault is 1
    blank, 2 duplicate, 3 truncated, else 0. Each conversation begins with a row
    without edit, also one of which all rows are lost; its other rows follow it in
    the partition, one conversation after the other.

    Rows are taken by turn, nulls first; of equal turns by role and text. Null
    roles and texts are one space. Rows without conv_id are one conversation.
    Repeated rows are duplicates, empty tables give no rows, other columns are
    left out. One conversation is read by one task, as a stream: the rows that
    memory holds are those on which survivors still differ.
    """
    lost = F.coalesce("lost", F.lit(False)) if "lost" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost")).repartition("conv_id")
    ends = F.rtrim("text", F.lit(BLANKS))
    again = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(ends == "", BLANK).when(again, DUPLICATE).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    told = rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "fault", "lost")
    ordered = told.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)
    schema = StructType([conversations.schema["conv_id"], *StructType.fromDDL(FIELDS).fields])
    return ordered.mapInArrow(tidy(_repair_task), schema)


DIGEST = "gaps blank duplicate truncated illegal cost"


class _Digest:
    """Counts, letters and hash of one conversation's edits, which come in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.count = conv, dict.fromkeys(DIGEST.split(), 0)
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0
        self.low = self.high = self.before = None
        self.turns = 0

    def take(self, edit: str | None, cost: int, turn: int | None, was: str | None, fault: int | None, role: str | None, text: str | None) -> None:
        if edit is None:
            return
        self.count["cost"] += cost
        self.audit.append(edit)
        if edit != "I":
            if fault:
                self.count[("blank", "duplicate", "truncated")[fault - 1]] += 1
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.count["illegal"] += 1
            self.before = was[:1]
        if edit != "D":
            self.hash.update(f"{'' if not self.lines else chr(10)}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        if self.turns:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        return self.conv, *self.count.values(), "".join(self.audit), self.hash.hexdigest()


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, kind, names = None, None, ["conv_id", *DIGEST.split(), "audit", "repaired_sha256"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for edits in batches:
        kind, done = edits.schema.field(0).type, []
        for conv, *edit in zip(*(c.to_pylist() for c in edits.columns), strict=True):
            if edit[0] is None:
                if digest is not None:
                    done.append(digest.row())
                digest = _Digest(conv)
            digest.take(*edit)
        yield batch(done)
    if digest is not None:
        yield batch([digest.row()])


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows, as they stand in their partitions.

    gaps, blank, duplicate, truncated, illegal, cost; audit: the edits' letters;
    repaired_sha256: of ``role:text`` of what is left, joined by newlines.
    """
    counts = [StructField(c, LongType()) for c in DIGEST.split()]
    schema = StructType([edits.schema["conv_id"], *counts, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    return edits.mapInArrow(tidy(_digest_task), schema)
