"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; a task reads them as one
stream of Arrow batches and carries the state of a dynamic programme from row to
row and from batch to batch.  The repaired sequence of role initials must read
``(s?(ua)+)?``, so four states suffice (nothing yet, after the system row, after
a user, after an assistant); the programme keeps for each the least cost of the
edits so far and the order of their strings.  After a row's own edit no string
is a beginning of another one's, so the order of two strings is settled by the
order of what they continue, or by the inserts and the edit of this row: ranks
are enough, no string is compared.  Costs relative to the least one and ranks
take few values, so a row is a lookup in a table of transitions that the task
builds as it goes, and the backpointers of a row are the number of its
transition.

At the end of a conversation the backpointers are followed from the last row to
the first, then the rows are read once more in order to write the repaired
sequence.  Rows and backpointers are held in chunks; beyond ``SPILL_BYTES`` a
chunk goes to a file of the task in the shared folder (deleted afterwards), so
memory is one chunk, whatever the length of a conversation.  Only the string of
edits, a cell of the result, grows with it.

A row is a duplicate if its role and text were seen earlier.  A task remembers
the 128-bit hashes of a conversation of up to ``GIANT`` rows; of larger ones
Spark marks the duplicates before, by a window over (conversation, hash).

The digest of the repaired text is sequential, so a conversation is one task's
stream; nothing else of it meets in one place.

Defined results: a null role or text is one space; null turns come first; a null
conv_id is one conversation; rows of equal turn are ordered by role and text
(UTF-8 bytes); an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.frames import bound_batches, remote_fs, shared_path

KEEP, REROLE, DELETE = 0, 1, 2
EDITS = "KRD"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
INITIALS = "sua"              # other initials have the number 3
CLEAN, GONE, TRUNCATED = 0, 1, 2
SPILL_BYTES = 64 << 20
GIANT = 500_000
OUT_ROWS = 10_000


# --------------------------------------------------------------- programme
def _after(state: int, inserts: int) -> int:
    """State after empty rows that alternate from ``state`` on."""
    for _ in range(inserts):
        state = 3 if state == 2 else 2
    return state


def _moves(state: int, initial: int, kind: int):
    """(string of the edits, cost, new state, inserts, edit) of a row."""
    for inserts in range(3 if state < 2 else 2):
        at = _after(state, inserts)
        lead, cost = "I" * inserts, INSERT_COST * inserts
        yield lead + "D", cost + DELETE_COST, at, inserts, DELETE
        if kind == GONE:
            continue
        cost += TRUNCATED_COST if kind == TRUNCATED else 0
        to = {0: 1 if at == 0 else None, 1: 2 if at != 2 else None, 2: 3 if at == 2 else None}.get(initial)
        if to is not None:
            yield lead + "K", cost, to, inserts, KEEP
        yield lead + "R", cost + REROLE_COST, 3 if at == 2 else 2, inserts, REROLE


class Transitions:
    """Table of (programme state, row class) -> transition, filled on demand.
    A programme state is (cost, rank) per state; the least cost is 0."""

    START = ((0, 0), None, None, None)

    def __init__(self):
        self.numbers = {self.START: 0}
        self.states = [self.START]
        self.rows: list[tuple] = []        # (programme state after, cost added, backpointer per state)
        self.found: dict[tuple[int, int], int] = {}

    def step(self, state: int, row_class: int) -> int:
        number = self.found.get((state, row_class))
        if number is None:
            number = self.found[(state, row_class)] = self._add(state, row_class)
        return number

    def _add(self, state: int, row_class: int) -> int:
        best: dict[int, tuple] = {}
        for old, own in enumerate(self.states[state]):
            if own is None:
                continue
            for text, cost, to, inserts, edit in _moves(old, row_class // 3, row_class % 3):
                move = (own[0] + cost, own[1], text, (old, inserts, edit))
                if to not in best or move[:3] < best[to][:3]:
                    best[to] = move
        least = min(m[0] for m in best.values())
        order = {to: i for i, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        after = tuple((best[t][0] - least, order[t]) if t in best else None for t in range(4))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        self.rows.append((self.numbers[after], least, tuple(best[t][3] if t in best else None for t in range(4))))
        return len(self.rows) - 1

    def finish(self, state: int) -> tuple[int, int, int]:
        """(cost added, last state, inserts) of the best end."""
        ends = [(own[0] + INSERT_COST * m, own[1], s, m) for s, m in ((0, 0), (1, 2), (2, 1), (3, 0))
                if (own := self.states[state][s]) is not None]
        cost, _, last, inserts = min(ends)
        return cost, last, inserts


# ------------------------------------------------------------------ chunks
class Rows:
    """Roles, texts and transitions of a conversation, in chunks; full chunks
    lie in files of the shared folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.chunks: list = []             # (batch of role and text, transitions) or path
        self.parts: list[pa.RecordBatch] = []
        self.numbers = array("I")
        self.bytes = 0

    def extend(self, batch: pa.RecordBatch, numbers: array) -> None:
        self.parts.append(batch)
        self.numbers.extend(numbers)
        self.bytes += batch.nbytes + 4 * len(numbers)
        if self.bytes > SPILL_BYTES:
            fs, root = remote_fs(self.folder)
            fs.create_dir(root, recursive=True)
            path = f"{root}/{uuid.uuid4().hex}"
            table = self._table()
            with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as sink:
                sink.write_table(table)
            self.chunks.append(path)
            self.parts, self.numbers, self.bytes = [], array("I"), 0

    def _table(self) -> pa.Table:
        return pa.Table.from_batches(self.parts).append_column("number", pa.array(np.frombuffer(self.numbers, np.uint32)))

    def close(self) -> None:
        if self.parts:
            self.chunks.append(self._table())

    def read(self, k: int) -> pa.Table:
        chunk = self.chunks[k]
        if isinstance(chunk, str):
            fs, _ = remote_fs(self.folder)
            with fs.open_input_file(chunk) as source:
                return pa.ipc.open_file(source).read_all()
        return chunk

    def write_edits(self, k: int, edits: bytes) -> None:
        if isinstance(self.chunks[k], str):
            fs, _ = remote_fs(self.folder)
            with fs.open_output_stream(self.chunks[k] + ".edits") as out:
                out.write(edits)
        else:
            self.chunks[k] = (self.chunks[k], edits)

    def replay(self, k: int) -> tuple[pa.Table, bytes]:
        if isinstance(self.chunks[k], str):
            fs, _ = remote_fs(self.folder)
            with fs.open_input_file(self.chunks[k] + ".edits") as source:
                return self.read(k), source.read()
        return self.chunks[k]

    def remove(self) -> None:
        for chunk in self.chunks:
            if isinstance(chunk, str):
                fs, _ = remote_fs(self.folder)
                fs.delete_file(chunk)
                fs.delete_file(chunk + ".edits")


class Conversation:
    """State of one conversation while its rows stream by."""

    def __init__(self, conv, folder: str):
        self.conv, self.rows = conv, Rows(folder)
        self.state = self.cost = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial, self.seen = None, set()
        self.low = self.high = self.turn = None
        self.turns = 0

    def trace(self, table: Transitions) -> int:
        """Follow the backpointers; gives the inserts at the end."""
        self.rows.close()
        more, state, tail = table.finish(self.state)
        self.cost += more
        for k in range(len(self.rows.chunks) - 1, -1, -1):
            numbers = self.rows.read(k).column("number").to_pylist()
            edits = bytearray(len(numbers))
            for i in range(len(numbers) - 1, -1, -1):
                state, inserts, edit = table.rows[numbers[i]][2][state]
                edits[i] = 3 * inserts + edit
            self.rows.write_edits(k, bytes(edits))
        return tail

    def repaired(self, tail: int):
        """(edit, role or None, text or None) of every edit, in order."""
        state = 0

        def insert():
            nonlocal state
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            return "I", role, ""
        for k in range(len(self.rows.chunks)):
            rows, edits = self.rows.replay(k)
            for code, role, text in zip(edits, rows.column("role").to_pylist(), rows.column("text").to_pylist()):
                for _ in range(code // 3):
                    yield insert()
                edit = code % 3
                if edit == DELETE:
                    yield "D", None, None
                elif edit == KEEP:
                    yield "K", role, text
                    state = 1 if role[0] == "s" else 2 if role[0] == "u" else 3
                else:
                    _, role, _ = insert()
                    yield "R", role, text
        for _ in range(tail):
            yield insert()

    def report(self) -> tuple:
        return (0 if self.low is None else self.high - self.low + 1 - self.turns,
                self.blank, self.duplicate, self.truncated, self.illegal, self.cost)


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "seq bigint, edit string, role string, text string"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _prepared(rows: DataFrame, gone) -> DataFrame:
    """conv, turn, role, text, the row's class as far as it is its own, and hashes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
                    text.alias("text"), gone.alias("gone"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return d.select(
        "conv", "turn", "role", "text", "gone", initial.cast("int").alias("initial"),
        (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
        (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("cut"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))


def _sorted(rows: DataFrame, gone) -> DataFrame:
    """The rows of a conversation in one task, by turn; ``again`` tells the
    duplicates of giant conversations, and is null for others."""
    d = _prepared(rows, gone)
    giants = d.groupBy("conv").agg(F.count("*").alias("c")).where(F.col("c") > GIANT).select(F.col("conv").alias("g"))
    again = F.lit(None).cast("boolean")
    if giants.isEmpty():
        d = d.withColumn("again", again)
    else:
        from pyspark.sql import Window
        same = F.col("conv").eqNullSafe(F.col("g"))
        order = Window.partitionBy("conv", "gone", "h1", "h2").orderBy(F.asc_nulls_first("turn"), "role", "text")
        d = d.join(giants, same, "left_anti").withColumn("again", again).unionByName(
            d.join(giants, same, "left_semi").withColumn("again", F.row_number().over(order) > 1))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "again")


def _stream(rows: DataFrame, gone, results: str, give) -> DataFrame:
    """Runs the programme; ``give(conversation, inserts at the end)`` yields lists
    of result rows (after the conversation's id) of the fields ``results``."""
    spark = rows.sparkSession
    bound_batches(spark)
    folder = shared_path(spark, "conversations")
    ordered = _sorted(rows, gone)
    out = T.StructType([T.StructField("conv_id", ordered.schema["conv"].dataType), *T._parse_datatype_string(results).fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def run(batches):
        table, talk, ready = Transitions(), None, []

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), schema)], names=schema.names)

        def finish():
            tail = talk.trace(table)
            for found in give(talk, tail):
                ready.extend((talk.conv, *row) for row in found)
                while len(ready) >= OUT_ROWS:
                    yield batch_of(ready[:OUT_ROWS])
                    del ready[:OUT_ROWS]
            talk.rows.remove()

        for batch in batches:
            conv, turn, gone_, initial, blank, cut, h1, h2, again = (
                batch.column(c).to_pylist() for c in ("conv", "turn", "gone", "initial", "blank", "cut", "h1", "h2", "again"))
            words = batch.select(["role", "text"])
            n, at = batch.num_rows, 0
            while at < n:
                own = conv[at]
                if talk is None or talk.conv != own:
                    if talk is not None:
                        yield from finish()
                    talk = Conversation(own, folder)
                numbers, start, kept = array("I"), at, []
                while at < n and conv[at] == own:
                    if gone_[at]:
                        at += 1
                        continue
                    t, mine = turn[at], initial[at]
                    if t is not None:
                        if t != talk.turn:
                            talk.turns += 1
                            talk.turn = talk.high = t
                            talk.low = t if talk.low is None else talk.low
                    if talk.initial is not None and (talk.initial, mine) not in _LEGAL:
                        talk.illegal += 1
                    talk.initial = mine
                    if blank[at]:
                        kind = GONE
                        talk.blank += 1
                    else:
                        twin = again[at]
                        if twin is None:
                            key = (h1[at], h2[at])
                            twin = key in talk.seen
                            talk.seen.add(key)
                        if twin:
                            kind = GONE
                            talk.duplicate += 1
                        elif cut[at]:
                            kind = TRUNCATED
                            talk.truncated += 1
                        else:
                            kind = CLEAN
                    number = table.step(talk.state, 3 * mine + kind)
                    numbers.append(number)
                    talk.state, more, _ = table.rows[number]
                    talk.cost += more
                    kept.append(at)
                    at += 1
                if len(numbers):
                    whole = len(kept) == at - start
                    talk.rows.extend(words.slice(start, at - start) if whole else words.take(pa.array(kept)), numbers)
        if talk is not None:
            yield from finish()
        if ready:
            yield batch_of(ready)

    return ordered.mapInArrow(run, out)


def audit(rows: DataFrame, gone=None) -> DataFrame:
    """Per conversation: faults, cost and string of the cheapest edits (ties: the
    least string), and the digest of the repaired ``role:text`` lines.  ``gone``
    is a condition on rows that only name their conversation."""
    def give(talk: Conversation, tail: int):
        digest, edits, first = hashlib.sha256(), [], True
        for edit, role, text in talk.repaired(tail):
            edits.append(edit)
            if edit != "D":
                digest.update(b"" if first else b"\n")
                digest.update(f"{role}:{text}".encode())
                first = False
        yield [(*talk.report(), "".join(edits), digest.hexdigest())]
    return _stream(rows, F.lit(False) if gone is None else gone, REPORT, give)


def repair(rows: DataFrame, gone=None) -> DataFrame:
    """The repaired rows (conv_id, seq, edit, role, text) in order of seq."""
    def give(talk: Conversation, tail: int):
        seq, found = 0, []
        for edit, role, text in talk.repaired(tail):
            if edit != "D":
                found.append((seq, edit, role, text))
                seq += 1
                if len(found) == OUT_ROWS:
                    yield found
                    found = []
        yield found
    return _stream(rows, F.lit(False) if gone is None else gone, REPAIRED, give)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row
    (it stays, with ``dropped``), 1 empties its text, 2 removes the marks of a
    sentence's end, 3 repeats it, 4 sets the role user."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    d = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), code.alias("code"))
    return d.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("dropped"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


# ------------------------------------------------------------- brute force
def brute_force(rows: list[tuple], damage: bool = True) -> dict:
    """conv_id -> report of (conv_id, turn, role, text) rows, by definition: all
    edit strings are compared (for tests)."""
    talks: dict = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20 if damage else 9
        if code != 0:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            own += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [t for given, t, _, _ in own if given]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, _, role, text in own:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        # (cost, string, repaired) per sequence of initials, reduced to its state
        states = {"": (0, "", [])}

        def inserted(states):
            for _ in range(2):
                for key, (cost, text, done) in list(states.items()):
                    to, role = ("a", "assistant") if key == "u" else ("u", "user")
                    new = (cost + 3, text + "I", [*done, (role, "")])
                    if to not in states or new[:2] < states[to][:2]:
                        states[to] = new
            return states
        for (_, _, role, text), kind in zip(own, kinds):
            # every way to insert before the row, without leaving out any
            ways = [(key, *v) for key, v in states.items()]
            for _ in range(2):
                ways += [("a" if k == "u" else "u", c + 3, s + "I", [*d, ("assistant" if k == "u" else "user", "")]) for k, c, s, d in ways]
            now: dict = {}

            def offer(key, *v):
                if key not in now or v[:2] < now[key][:2]:
                    now[key] = v
            for key, cost, s, done in ways:
                offer(key, cost + 4, s + "D", done)
                if kind in ("blank", "duplicate"):
                    continue
                extra = 3 if kind == "truncated" else 0
                if (role[:1], key) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                    offer(role[0], cost + extra, s + "K", [*done, (role, text)])
                to, new = ("a", "assistant") if key == "u" else ("u", "user")
                offer(to, cost + extra + 3, s + "R", [*done, (new, text)])
            states = now
        ends = [v for k, v in inserted(states).items() if k in ("", "a")]
        cost, text, done = min(ends, key=lambda v: v[:2])
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, text,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out
