"""Repair of conversations: the cheapest edits that make roles alternate, found by iterative-deepening A*.

A conversation is legal if it is empty, or an optional system turn followed by pairs of user and assistant turns. A
search state is a row and what the last role was; edits lead on. Depth first, edits in ASCII order, under a bound of
cost that rises to the least bound that failed: the first accepting path is then the cheapest and, of equally cheap
ones, the least. A table keeps for each state how much it is known to cost at least: first the deletions its faults
force, after a failed visit more than the visit had left, so no failed state is searched again with as little.

Long conversations are searched in stretches from the end, each towards the exact costs found at the start of
the next; depth, table and work per row stay the same at any length. Then the path is read off stretch by stretch.

Rows come twice in the order of the conversation, first as one byte each, then with their texts, which go straight into the
hash: a task holds a few bytes per row of one conversation and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What edits cost, which ones the faults allow, and the legal order of roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_LEFT = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: The spoken role that may follow each state: nothing yet, after system, after user, after assistant.
FOLLOWS = (USER, USER, ASSISTANT, USER)
SPOKEN = {USER: "user", ASSISTANT: "assistant"}
#: What it costs to end in each state, and the edits: a missing answer is inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Rows of a stretch.
STRETCH = 64
WHITE = " \t\n\x0b\f\r"


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row in ASCII order: (letter, cost, state after); an insertion stays before the row."""
    fault, initial = divmod(code, 4)
    spoken = FOLLOWS[state]
    found = [("D", DELETE, state), ("I", INSERT, spoken)]
    if fault not in (BLANK, DUPLICATE):
        left = TRUNCATED_LEFT if fault == TRUNCATED else 0
        if initial == spoken or (initial == SYSTEM and state == 0):
            found.append(("K", KEEP + left, initial))
        found.append(("R", REROLE + left, spoken))
    return found


#: Of each code and state, so that a search only looks them up.
EDITS = [[edits(code, state) for state in range(4)] for code in range(16)]


class Stretch:
    """A run of rows and the exact costs of what follows it, by state."""

    def __init__(self, codes: bytes, after: tuple[int, ...] | list[int]):
        self.codes = codes
        forced, self.least = min(after), list(after)
        for code in reversed(codes):
            forced += DELETE if code >= 4 else 0
            self.least[:0] = [forced] * 4

    def search(self, start: int, bound: int) -> tuple[str, int] | None:
        """The first path from the first row in `start` through the last row that can end within `bound`: its edits and
        the state it reaches. None if there is none; then the table knows that the start costs more."""
        least, codes, goal = self.least, self.codes, len(self.codes)
        if least[start] > bound:
            return None
        if not goal:
            return "", start
        path: list[str] = []
        frames = [(0, start, bound, iter(EDITS[codes[0]][start]))]
        while frames:
            row, state, left, ahead = frames[-1]
            for letter, cost, after in ahead:
                to = row if letter == "I" else row + 1
                if cost + least[4 * to + after] <= left:
                    path.append(letter)
                    if to == goal:
                        return "".join(path), after
                    frames.append((to, after, left - cost, iter(EDITS[codes[to]][after])))
                    break
            else:
                least[4 * row + state] = min(
                    cost + least[4 * (row if letter == "I" else row + 1) + after]
                    for letter, cost, after in EDITS[codes[row]][state]
                )
                frames.pop()
                if path:
                    path.pop()
        return None

    def deepen(self, start: int) -> tuple[int, str, int]:
        """Least cost from the first row in `start` to the end of the conversation, the edits of the stretch, the state after."""
        while True:
            bound = self.least[start]
            if found := self.search(start, bound):
                return bound, *found


def repair(codes: bytes, stretch: int = STRETCH) -> tuple[int, str]:
    """Least cost and edits of a conversation whose rows have these codes (fault * 4 + initial)."""
    starts = range(0, len(codes), stretch)
    after = [list(END)]
    for at in reversed(starts):
        run = Stretch(codes[at : at + stretch], after[-1])
        after.append([run.deepen(state)[0] for state in range(4)] if at else [run.deepen(0)[0]])
    cost, state, audit = after.pop()[0], 0, []
    for at in starts:
        run = Stretch(codes[at : at + stretch], after.pop())
        _, letters, state = run.deepen(state)
        audit.append(letters)
    return cost, "".join(audit) + "I" * (END[state] // INSERT)


class Rewritten:
    """The hash of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.letters, self.state, self.hash, self.any = iter(audit), 0, hashlib.sha256(), False

    def _turn(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _next(self) -> str:
        while (letter := next(self.letters, "")) == "I":
            self.state = FOLLOWS[self.state]
            self._turn(SPOKEN[self.state], "")
        return letter

    def row(self, role: str, text: str) -> None:
        letter = self._next()
        if letter == "K":
            self.state = INITIALS[role[:1]]
            self._turn(role, text)
        elif letter == "R":
            self.state = FOLLOWS[self.state]
            self._turn(SPOKEN[self.state], text)

    def close(self) -> str:
        self._next()
        return self.hash.hexdigest()


class Conversation:
    """What is known of the conversation whose rows are passing."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.illegal = conv_id, bytearray(), 0
        self.last, self.turns, self.first_turn, self.last_turn = None, 0, None, None
        self.cost, self.audit, self.rewritten = 0, "", None

    def glance(self, turn, initial: str, fault: int) -> None:
        if self.codes and (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.codes.append(fault * 4 + INITIALS.get(initial, OTHER))
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def text(self, role: str, text: str) -> None:
        if self.rewritten is None:
            self._solve()
        self.rewritten.row(role, text)

    def _solve(self) -> None:
        self.cost, self.audit = repair(bytes(self.codes))
        self.rewritten = Rewritten(self.audit)

    def result(self) -> tuple:
        if self.rewritten is None:
            self._solve()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        faults = [sum(code // 4 == fault for code in self.codes) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        return (self.conv_id, gaps, *faults, self.illegal, self.cost, self.audit, self.rewritten.close())


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(kind: pa.DataType):
    schema = pa.schema(
        [("conv_id", kind), *[(c, pa.int64()) for c in _COLUMNS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def rows(found: list[Conversation]) -> pa.RecordBatch:
        columns = zip(*[c.result() for c in found], strict=True) if found else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            ended = []
            for conv_id, phase, turn, role, fault, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if phase == 0:  # the first row of each conversation
                    if now is not None:
                        ended.append(now)
                    now = Conversation(conv_id)
                elif phase == 1:
                    now.glance(turn, role, fault)
                else:
                    now.text(role, text)
            yield rows(ended)
        if now is not None:
            yield rows([now])

    return run


def fault_of(text: Column, again: Column) -> Column:
    """The first fault of a row: blank, duplicate (`again`: its role and text occur earlier), truncated, or none."""
    seen = F.rtrim(text, F.lit(WHITE))
    return (
        F.when(seen == "", F.lit(BLANK))
        .when(again, F.lit(DUPLICATE))
        .when(~F.substring(seen, -1, 1).isin(".", "!", "?"), F.lit(TRUNCATED))
        .otherwise(F.lit(SOUND))
    )


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text; other columns are not read).

    Rows are taken by turn, null first; rows that share a turn by role, then by the MD5 of role and text. A null role or
    text is one space; rows without conv_id are one conversation. Repeated rows are duplicates. Texts are read
    whole and have no bound. A conversation may hold most rows: its duplicates are found by a shuffle of role and text, its
    rows pass through one task as a stream, as its one hash demands. An empty table gives no rows.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    return repair_kept(turns, turns.select("conv_id").distinct())


def repair_kept(turns: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for each conv_id of `asked` (distinct), which may have no rows left: zeros, no edits, the hash of nothing."""
    kind = dict(asked.dtypes)["conv_id"]
    whole = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).withColumn("mark", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    empty, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    seen = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("turn")) > 1
    # Only what a search needs is shuffled for the duplicates: the fault a row has by itself, decided where it is read.
    slim = whole.select("conv_id", "turn", "role", "mark", fault_of(F.col("text"), F.lit(False)).alias("fault"))
    slim = slim.withColumn("again", seen)
    fault = F.when(F.col("again") & (F.col("fault") != BLANK), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    glances = slim.select(
        "conv_id", F.lit(1).alias("phase"), "turn", "role", "mark", F.substring("role", 1, 1).alias("said"), fault.alias("fault"), empty.alias("text")
    )
    texts = whole.select("conv_id", F.lit(2).alias("phase"), "turn", "role", "mark", F.col("role").alias("said"), none.alias("fault"), "text")
    long, binary = F.lit(None).cast("long"), F.lit(None).cast("binary")
    heads = asked.select(
        "conv_id", F.lit(0).alias("phase"), long.alias("turn"), empty.alias("role"), binary.alias("mark"), empty.alias("said"), none.alias("fault"), empty.alias("text")
    )
    rows = heads.unionByName(glances).unionByName(texts)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "mark")
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in _COLUMNS)}, audit string, repaired_sha256 string"
    return ordered.select("conv_id", "phase", "turn", "said", "fault", "text").mapInArrow(_repaired(types[kind]), schema)


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` with faults planted by the crc32 of `conv_id:turn` modulo 20 (null as one space): 0 drops the row, 1 empties its
    text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    what = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).filter("what <> 0")
    once = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, F.lit(""))
        .when(F.col("what") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return once.drop("copy")


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """Every conversation of `turns`, damaged and repaired."""
    return repair_kept(damaged(turns), turns.select("conv_id").distinct())
