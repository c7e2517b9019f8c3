"""Conversation structure repair: the cheapest edits that make turns alternate, by a time-major dynamic program over many conversations at once.

A repaired conversation has the role initials (s?(ua)+)?: nothing, or user and assistant in turn after at most one
system turn. A conversation is cut into segments by turn number. Tasks code each segment (a byte a row) and reduce it
to the costs between the states at its two ends, so a conversation of any length is worked on by many tasks; a walk
over these few numbers gives the costs behind each segment, then all segments of about one length are traced together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import partitions, stage

#: Costs of the edits; an open end (a truncated turn that stays) has one of its own.
DELETE, INSERT, REROLE, OPEN = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. A user or assistant turn leads to NEXT and has the role TURN.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
TURN = ("user", "user", "assistant", "user")
#: Costs from each state at the end of a conversation: what is inserted to end after an assistant turn, or empty.
ENDS = (0, 2 * INSERT, INSERT, 0)
#: A row's code: its role's initial (0 s, 1 u, 2 a, 3 other), and 4 times 0, 1 (must go) or 2 (open end). PAD stands for no row.
PAD, FAR = 12, 1 << 60
#: Bits of a turn number within a segment, rows that are coded together, and the segment of null turns, which come first.
SEGMENT_BITS, TOGETHER, NULLS = 12, 1 << 16, -(1 << 52)
#: White space (fixed values).
SPACES = " \t\n\x0b\x0c\r"


def edit_costs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code: the cost of deleting the row, and from each state those of keeping it and of giving it another role."""
    delete, keep, role = np.full(PAD + 1, DELETE), np.full((PAD + 1, 4), FAR), np.full((PAD + 1, 4), FAR)
    delete[PAD] = 0
    fits = {START: (0, 1), SYSTEM: (1,), USER: (2,), ASSISTANT: (1,)}
    for code in range(PAD):
        initial, fault = code % 4, code // 4
        if fault != 1:
            role[code] = REROLE + OPEN * (fault == 2)
            for state, initials in fits.items():
                keep[code, state] = OPEN * (fault == 2) if initial in initials else FAR
    return delete, keep, role


GO, STAY, RECAST = edit_costs()


def costs_behind(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The least cost from each row and state on: codes is (time, n), after (the costs at the end) is (n, k, 4); gives (time + 1, n, k, 4)."""
    out = np.empty((len(codes) + 1, *after.shape), np.int64)
    out[-1] = after
    for t in range(len(codes) - 1, -1, -1):
        c, later = codes[t], out[t + 1]
        turned = later[..., NEXT]
        best = np.minimum(later + GO[c][:, None, None], turned + np.minimum(STAY[c], RECAST[c])[:, None, :])
        system = c % 4 == 0  # a system turn is kept in its own state
        kept = np.where((system & (c != PAD))[:, None], STAY[c, START][:, None] + later[..., SYSTEM], FAR)
        plain = np.minimum(later[..., START] + GO[c][:, None], turned[..., START] + np.where(system, RECAST[c, START], np.minimum(STAY[c, START], RECAST[c, START]))[:, None])
        best[..., START] = np.minimum(plain, kept)
        best = np.minimum(best, np.minimum(best[..., NEXT] + INSERT, best[..., NEXT[NEXT]] + 2 * INSERT))
        out[t] = np.minimum(best, FAR)
    return out


def traces(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, entry: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The first in order of the cheapest edits (initials) of each column of codes, entered in the state `entry`, and the state at its end; costs is (time + 1, n, 4)."""
    time, n = codes.shape
    at, state, every = time - sizes, entry.copy(), np.arange(n)
    lines = []
    live = every[at < time]
    while len(live):
        t, s = at[live], state[live]
        code, here, later = codes[t, live], costs[t, live, s], costs[t + 1, live]
        row = np.arange(len(live))
        system = (s == START) & (code % 4 == 0)
        kept = np.where(system, SYSTEM, NEXT[s])
        go = GO[code] + later[row, s] == here
        add = ~go & (costs[t, live, NEXT[s]] + INSERT == here)
        stay = ~go & ~add & (STAY[code, s] + later[row, kept] == here)
        letter = np.full(len(live), ord("R"), np.uint8)
        letter[go], letter[add], letter[stay] = ord("D"), ord("I"), ord("K")
        line = np.zeros(n, np.uint8)
        line[live] = letter
        lines.append(line)
        state[live] = np.where(go, s, np.where(stay, kept, NEXT[s]))
        at[live] = t + ~add
        live = live[at[live] < time]
    letters = np.array(lines, np.uint8).reshape(len(lines), n).T
    return [x[x > 0].tobytes() for x in letters], state


def by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the rows of `sizes` in groups of about one length (within a factor of two)."""
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        yield np.flatnonzero(kind == k)


def columns_of(codes: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the chosen segments as columns that end together, padded before, and their lengths."""
    sizes = np.array([len(codes[j]) for j in chosen.tolist()])
    out = np.full((int(sizes.max()), len(chosen)), PAD, np.uint8)
    for k, j in enumerate(chosen.tolist()):
        out[len(out) - sizes[k] :, k] = np.frombuffer(codes[j], np.uint8)
    return out, sizes


def crossings(codes: list[bytes]) -> np.ndarray:
    """For each segment the least cost from each state at its start to each at its end, (n, 4, 4)."""
    out = np.empty((len(codes), 4, 4), np.int64)
    base = np.where(np.eye(4, dtype=bool), 0, FAR)
    for chosen in by_length(np.array([len(c) for c in codes])):
        grid, _ = columns_of(codes, chosen)
        out[chosen] = costs_behind(grid, np.broadcast_to(base, (len(chosen), 4, 4)))[0].transpose(0, 2, 1)
    return out


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of df after the damage told by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it the user's. Nulls in the key, roles and texts are one space."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn))).cast("binary")) % 20
    hurt = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), kind.alias("_kind"))
    return rows.where(F.col("_kind") != 0).withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with the key of their conversation, their segment, and two hashes of role and text, which also settle the order within a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.coalesce(F.shiftright(turn, SEGMENT_BITS), F.lit(NULLS)).alias("seg"), turn.alias("turn"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), role, text).alias("d2"), role.alias("role"), text.alias("text"),
    )


def _fault(text: Column) -> Column:
    """1 for a blank text, 2 for one whose last character but white space is none of `.!?`."""
    held = F.rtrim(text, F.lit(SPACES))
    return F.when(held == "", 1).when(F.right(held, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)


SEGMENT = "conv string, seg long, codes binary, crossing binary, counts array<long>"


def segments(keyed: DataFrame) -> DataFrame:
    """The codes, the crossing costs and the counts of each segment.

    Counts: blank, duplicate and truncated rows, adjacent rows that may not follow, the first and the last initial,
    the least and the greatest turn (null if all are null), distinct turns.
    """
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)) - 1
    initial = F.when(initial < 0, 3).otherwise(initial).cast("int")
    slim = stage(keyed.select("conv", "seg", "turn", "d1", "d2", initial.alias("initial"), _fault(F.col("text")).alias("fault")), "turns")
    least = F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("first")
    seen = slim.groupBy("conv", "d1", "d2").agg(least)
    marked = slim.join(seen, ["conv", "d1", "d2"]).withColumn("again", F.coalesce("turn", F.lit(-(1 << 63))) > F.col("first"))
    ordered = marked.repartition(partitions(keyed.sparkSession), "conv", "seg").sortWithinPartitions("conv", "seg", "turn", "d1", "d2")
    names = ["conv", "seg", "turn", "d1", "d2", "initial", "fault", "again"]

    def coded(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).select(names)
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= TOGETHER:
                start = _starts(held)[-1]
                if start:
                    yield from rows(held.slice(0, start))
                    held = held.slice(start)
        if held is not None and held.num_rows:
            yield from rows(held)

    def rows(t):
        import pyarrow as pa

        starts = _starts(t)
        get = lambda c, kind=np.int64: t.column(c).combine_chunks().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        n, turn, initial, fault = t.num_rows, get("turn"), get("initial"), get("fault")
        head = np.zeros(n, bool)
        head[starts] = True
        empty = np.asarray(t.column("turn").combine_chunks().is_null())
        same_turn = ~head & (turn == np.roll(turn, 1)) & (empty == np.roll(empty, 1))
        d1, d2 = get("d1"), get("d2")
        double = get("again", bool) | (same_turn & (d1 == np.roll(d1, 1)) & (d2 == np.roll(d2, 1)))
        blank, cut = fault == 1, (fault == 2) & ~double
        double &= ~blank
        codes = (initial + 4 * np.where(blank | double, 1, np.where(cut, 2, 0))).astype(np.uint8)
        before = np.roll(initial, 1)
        wrong = ~head & ~np.isin(4 * before + initial, (1, 6, 9))
        ends = np.append(starts[1:], n)
        summed = [np.add.reduceat(x.astype(np.int64), starts) for x in (blank, double, cut, wrong, ~empty & ~same_turn)]
        # null turns have a segment of their own
        counts = [[*(int(x[k]) for x in summed[:4]), int(initial[a]), int(initial[b - 1]), None if empty[a] else int(turn[a]), None if empty[a] else int(turn[b - 1]), int(summed[4][k])] for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
        parts = [codes[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        across = [x.tobytes() for x in crossings(parts)]
        place = pa.array(starts)
        columns = [t.column("conv").combine_chunks().take(place), t.column("seg").combine_chunks().take(place), pa.array(parts, pa.binary()), pa.array(across, pa.binary()), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "seg", "codes", "crossing", "counts"])

    return ordered.select(*names).mapInArrow(coded, SEGMENT)


def _starts(t) -> np.ndarray:
    """Where a segment starts in a table that is in their order."""
    import pyarrow.compute as pc

    conv, seg = t.column("conv").combine_chunks(), t.column("seg").to_numpy()
    new = np.r_[True, np.asarray(pc.not_equal(conv.slice(1), conv.slice(0, len(conv) - 1))) | (seg[1:] != seg[:-1])]
    return np.flatnonzero(new)


AUDITED = "conv string, seg long, audits array<string>, exits array<int>, cost long, counts array<long>"


def audited(segs: DataFrame) -> DataFrame:
    """For each segment and state at its start the cheapest edits and the state at its end; and the cost behind it from the start state.

    The segments of a conversation come last first, so the costs behind each are known from the one after it.
    Only the first segment of a conversation is entered in the start state alone; then other states are null.
    """
    ordered = segs.repartition(partitions(segs.sparkSession), "conv").sortWithinPartitions("conv", F.col("seg").desc())

    def trace(batches):
        import pyarrow as pa

        conv, costs, waiting = None, None, []
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    conv, costs = row["conv"], np.array(ENDS)
                    if waiting:
                        waiting[-1]["lead"] = True
                row["after"] = costs
                row["lead"] = False
                costs = np.minimum((np.frombuffer(row["crossing"], np.int64).reshape(4, 4) + costs).min(axis=1), FAR)
                row["cost"] = int(costs[START])
                ready += waiting
                waiting = [row]
            if ready:
                yield answer(ready)
        for row in waiting:
            row["lead"] = True
        if waiting:
            yield answer(waiting)

    def answer(rows: list[dict]):
        import pyarrow as pa

        codes = [r["codes"] for r in rows]
        audits, exits = [[None] * 4 for _ in rows], [[None] * 4 for _ in rows]
        for chosen in by_length(np.array([len(c) for c in codes])):
            grid, sizes = columns_of(codes, chosen)
            after = np.array([rows[j]["after"] for j in chosen.tolist()])[:, None, :]
            costs = costs_behind(grid, after)[:, :, 0]
            lead = np.array([rows[j]["lead"] for j in chosen.tolist()])
            for state in range(4):
                some = np.arange(len(chosen)) if state == START else np.flatnonzero(~lead)
                if len(some):
                    found, ends = traces(grid[:, some], sizes[some], costs[:, some], np.full(len(some), state))
                    for k, x, e in zip(chosen[some].tolist(), found, ends.tolist(), strict=True):
                        audits[k][state], exits[k][state] = x.decode(), e
        columns = [pa.array([r["conv"] for r in rows], pa.string()), pa.array([r["seg"] for r in rows], pa.int64()), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())), pa.array([r["cost"] for r in rows], pa.int64()), pa.array([r["counts"] for r in rows], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "seg", "audits", "exits", "cost", "counts"])

    return ordered.mapInArrow(trace, AUDITED)


class Walk:
    """Walks over one conversation in order: segments and rows come in, edits go out."""

    def __init__(self, conv: str) -> None:
        self.conv, self.state, self.entry, self.segments = conv, START, START, []
        self.audit, self.place, self.counts, self.cost, self.audits = "", 0, None, 0, []

    def segment(self, row: dict) -> None:
        c = row["counts"]
        if self.counts is None:
            self.counts, self.cost = list(c), row["cost"]
        else:
            held = self.counts
            for k in (0, 1, 2, 8):
                held[k] += c[k]
            held[3] += c[3] + (4 * held[5] + c[4] not in (1, 6, 9))
            held[5], held[7] = c[5], c[7]
            held[6] = c[6] if held[6] is None else held[6]
        self.audit, self.place = row["audits"][self.entry], 0
        self.audits.append(self.audit)
        self.entry = row["exits"][self.entry]

    def turned(self) -> tuple[str, str, str]:
        role, self.state = TURN[self.state], int(NEXT[self.state])
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The edits (initial, role, text) up to that of a row."""
        while True:
            edit = self.audit[self.place]
            self.place += 1
            if edit == "I":
                yield "I", self.turned(), ""
                continue
            if edit == "D":
                yield "D", role, text
            elif edit == "R":
                yield "R", self.turned(), text
            else:
                self.state = SYSTEM if self.state == START and role[:1] == "s" else int(NEXT[self.state])
                yield "K", role, text
            return

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            self.audits.append("I")
            yield "I", self.turned(), ""


def walked(rows: DataFrame, heads: DataFrame | None, collect, schema: str) -> DataFrame:
    """What `collect` (a function of an iterator of (walk, edits of a conversation)) gives for the conversations of rows and of heads (conv_id), each in its order."""
    keyed = _keyed(rows)
    segs = audited(stage(segments(keyed), "segments"))
    blank = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    wide = [("audits", "array<string>"), ("exits", "array<int>"), ("cost", "long"), ("counts", "array<long>")]
    text = [("turn", "long"), ("d1", "long"), ("d2", "long"), ("role", "string"), ("text", "string")]
    marks = segs.select("conv", "seg", F.lit(1).alias("kind"), *blank(*text), *(n for n, _ in wide))
    turns = keyed.select("conv", "seg", F.lit(2).alias("kind"), *(n for n, _ in text), *blank(*wide))
    every = marks.unionByName(turns)
    if heads is not None:
        ids = heads.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv")).distinct()
        every = every.unionByName(ids.select("conv", F.lit(NULLS - 1).alias("seg"), F.lit(0).alias("kind"), *blank(*text, *wide)))
    ordered = every.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "seg", "kind", "turn", "d1", "d2")

    def stream(batches):
        def events():
            walk = None
            for batch in batches:
                for row in batch.to_pylist():
                    if walk is None or row["conv"] != walk.conv:
                        if walk is not None:
                            for edit in walk.end():
                                yield walk, edit, False
                            yield walk, None, True
                        walk = Walk(row["conv"])
                    if row["kind"] == 1:
                        walk.segment(row)
                    elif row["kind"] == 2:
                        for edit in walk.row(row["role"], row["text"]):
                            yield walk, edit, False
            if walk is not None:
                for edit in walk.end():
                    yield walk, edit, False
                yield walk, None, True

        return collect(events())

    return ordered.mapInArrow(stream, schema)


def _number(conv: str) -> int | None:
    return None if conv == " " else int(conv)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every turn of the repaired conversations of rows (conv_id, turn, role, text)."""

    def collect(events):
        import pyarrow as pa

        held, place = [], 0
        for walk, edit, over in events:
            if over:
                place = 0
            elif edit[0] != "D":
                held.append((_number(walk.conv), place, *edit))
                place += 1
            if len(held) >= 4096:
                yield batch(held)
                held = []
        yield batch(held)

    def batch(held: list):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])

    return walked(rows, None, collect, "conv_id long, place long, edit string, role string, text string")


REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The faults of each conversation of rows (conv_id, turn, role, text), the cheapest edits and a digest of the repaired turns.

    Rows are taken by turn, null turns first; rows of one turn in the order of two hashes of role and text, so it does
    not depend on how they are stored, and equal rows stand together. A null role or text is one space. A row's first fault counts: blank
    (no text but white space), duplicate (role and text seen earlier), truncated (last character none of `.!?`).
    Keeping costs 0, another role 3, deleting 4 (blank and duplicate rows must go), an inserted empty turn 3, a
    truncated row that stays 3. Of equally cheap edits those whose initials come first in ASCII are taken. gaps are turn numbers
    missing between the least and the greatest. Conversations of `heads` (conv_id) without rows have zeros and
    no edits. Null ids are one conversation. A task holds the codes of a segment (4096 turn numbers), and the
    edits, not the texts, of one conversation.
    """

    def collect(events):
        held, digest, some = [], hashlib.sha256(), False
        for walk, edit, over in events:
            if not over:
                if edit[0] != "D":
                    digest.update((("\n" if some else "") + f"{edit[1]}:{edit[2]}").encode())
                    some = True
                continue
            blank, double, cut, wrong, _, _, low, high, turns = walk.counts or [0, 0, 0, 0, 0, 0, None, None, 0]
            held.append((_number(walk.conv), 0 if low is None else high - low + 1 - turns, blank, double, cut, wrong, walk.cost, "".join(walk.audits), digest.hexdigest()))
            digest, some = hashlib.sha256(), False
            if len(held) >= 4096:
                yield batch(held)
                held = []
        yield batch(held)

    def batch(held: list):
        import pyarrow as pa

        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in REPAIRS.split(", ")])

    return walked(rows, heads, collect, REPAIRS)
