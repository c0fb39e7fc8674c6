"""Cheapest repair of the turn structure of conversations, by divide and conquer.

The initials of the repaired roles must read ``(s?(ua)+)?``: a machine of four states (start,
after s, after u, after a).  Rows are kept (0), get the other role (2) or go (3, the only choice for
blank and repeated ones); an empty user or assistant turn may be inserted (2); a truncated
row that stays costs 1 more.  Of the cheapest repairs the one with the least audit string wins.

*Linear space.*  A range of rows between two known states is cut in the middle.  A vector of
four costs runs forward from the left state, another backward from the right one; the middle
state is one where they add up to the least.  The forward vector also ranks its four
audits.  Up to the same row none is the beginning of another, as every row adds one letter of its
own, so of several least states the one with the least rank leads to the least audit.  Then both halves
are solved alike.  Inserted turns belong to the row that follows, which puts them as late as
possible.  Vectors take few different values up to a constant, so a step is one look-up.

*Any length.*  Conversations are range partitioned in order.  One that lies within a partition is
solved there.  Of the first and the last of a partition, which may go on elsewhere, the task reports
the 4 x 4 costs and ranks between entry and exit state and the edits of each; the crossing states at the
partition borders are then chosen by the same rule from at most two rows per partition.  A task holds
one conversation's rows of its partition.  The digest of a repaired text is sequential: a
conversation over several partitions streams through one task, row by row.

Defined cases: null role or text is one space (so such a text is blank); rows with a null conv_id are
a conversation of their own, with a null conv_id; null turns come first; rows of equal turn are ordered by role,
then text; equal rows stand side by side and all but the first are repeats; a role is judged by its
first character, an empty role has none; extra columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import SPACES
from lurewatch.llm.turns import in_order, keyed_turns
from lurewatch.session import materialize

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
TAIL = ("", "ua", "a", "")                       # roles inserted at the end of a conversation in each state
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
AUDIT = {"D": "D", "K": "K", "U": "R", "A": "R", "k": "IK", "u": "IR", "a": "IR"}   # edit of a row (lower case: after an insertion)
LEAF, FLUSH = 8, 4_000_000
PIECE = ("conv_id string, part int, whole boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, "
         "last string, costs array<long>, ranks array<int>, audits array<string>, sha string")
ROW = "conv_id string, part int, seq long, role string, text string, copies long, dead boolean, edits string"


def _after(state):
    """State after the user or assistant turn that may follow, and that turn's initial."""
    return (ASSISTANT, "a") if state == USER else (USER, "u")


def _steps(initial, truncated):
    """Per state: {next state: (cost, edit)} of one row that may stay; the least audit of the cheapest."""
    out = []
    for state in range(4):
        found = [(DELETE, "D", "D", state)]
        for inserted in (0, 1):
            at = _after(state)[0] if inserted else state
            to, turn = _after(at)
            cost = INSERT * inserted + TRUNCATED * truncated
            found.append((cost + REROLE, AUDIT[turn if inserted else turn.upper()], turn if inserted else turn.upper(), to))
            if initial == turn or (initial == "s" and at == START):
                found.append((cost, "IK" if inserted else "K", "k" if inserted else "K", SYSTEM if initial == "s" else to))
        best = {}
        for cost, _, edit, to in sorted(found, reverse=True):
            best[to] = (cost, edit)
        out.append(best)
    return out


STEPS = [_steps(initial, truncated) for initial in "sua-" for truncated in (0, 1)]
_FORWARD, _BACKWARD = {}, {}


def _forward(vector, code):
    """((cost, rank) per state, cost taken out) one row further; ranks order the audits so far."""
    found = _FORWARD.get((vector, code))
    if found is None:
        best = [None] * 4
        for state, here in enumerate(vector):
            for to, (cost, edit) in STEPS[code][state].items() if here else ():
                way = (here[0] + cost, here[1], AUDIT[edit])
                best[to] = way if best[to] is None else min(way, best[to])
        low = min(b[0] for b in best if b)
        order = sorted(b[1:] for b in best if b)
        found = tuple(b and (b[0] - low, order.index(b[1:])) for b in best), low
        _FORWARD[vector, code] = found
    return found


def _backward(vector, code):
    """(cost per state, cost taken out) one row earlier."""
    found = _BACKWARD.get((vector, code))
    if found is None:
        costs = [min((cost + vector[to] for to, (cost, _) in STEPS[code][state].items() if vector[to] is not None), default=None) for state in range(4)]
        low = min((c for c in costs if c is not None), default=0)
        found = tuple(None if c is None else c - low for c in costs), low
        _BACKWARD[vector, code] = found
    return found


def from_state(codes, lo, hi, state):
    """((cost, rank) per reachable exit state, cost taken out) over codes[lo:hi]."""
    vector, cost = tuple((0, 0) if s == state else None for s in range(4)), 0
    for k in range(lo, hi):
        vector, more = _forward(vector, codes[k])
        cost += more
    return vector, cost


def edits_between(codes, state, end, lo=0, hi=None):
    """Edit of each row of codes[lo:hi] on the least way from one state to another, in linear space."""
    out, todo = bytearray(len(codes) if hi is None else hi - lo), [(lo, len(codes) if hi is None else hi, state, end)]
    while todo:
        a, b, state, end = todo.pop()
        if b - a > LEAF:
            middle = (a + b) // 2
            left, right = from_state(codes, a, middle, state)[0], tuple(0 if s == end else None for s in range(4))
            for k in range(b - 1, middle - 1, -1):
                right = _backward(right, codes[k])[0]
            crossing = min((f[0] + r, f[1], s) for s, (f, r) in enumerate(zip(left, right)) if f and r is not None)[2]
            todo += [(a, middle, state, crossing), (middle, b, crossing, end)]
            continue
        ahead = [tuple(0 if s == end else None for s in range(4))]
        for k in range(b - 1, a, -1):
            ahead.append(_backward(ahead[-1], codes[k])[0])
        for k in range(a, b):
            rest = ahead.pop()
            _, _, edit, state = min((cost + rest[to], AUDIT[edit], edit, to) for to, (cost, edit) in STEPS[codes[k]][state].items() if rest[to] is not None)
            out[k - lo] = ord(edit)
    return out.decode()


def best_end(vector, after):
    """Exit state with the least cost to go, then the least audit."""
    return min((f[0] + r, f[1], s) for s, (f, r) in enumerate(zip(vector, after)) if f and r is not None)[2]


END = tuple(INSERT * len(t) for t in TAIL)


class _Conversation:
    """Rows of one conversation in one partition."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.codes, self.size = conv_id, [], bytearray(), 0

    def add(self, role, text, copies, fault):
        dead = fault in ("blank", "duplicate")
        self.rows.append((role, text, copies, fault, dead))
        self.size += len(text)
        if not dead:
            self.codes.append(2 * "sua-".index(role[0] if role[:1] in ("s", "u", "a") else "-") + (fault == "truncated"))

    def _counts(self):
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        illegal, gone, before = 0, 0, None
        for role, _, copies, fault, dead in self.rows:
            n["blank" if fault == "blank" else "duplicate"] += copies - 1
            if fault:
                n[fault] += 1
            gone += copies - 1 + dead
            illegal += copies - 1 + (before is not None and before + role[:1] not in LEGAL)
            before = role[:1]
        return dict(n_rows=sum(r[2] for r in self.rows), **n, illegal=illegal, first=self.rows[0][0][:1], last=before), DELETE * gone

    def audit(self, edits):
        """Letters of all rows, with those that had to go."""
        live, out = iter(edits), []
        for _, _, copies, _, dead in self.rows:
            out.append("D" * copies if dead else AUDIT[next(live)] + "D" * (copies - 1))
        return "".join(out)

    def solved(self):
        """The whole conversation: (summary, edits of the rows that may stay, end state)."""
        counts, gone = self._counts()
        vector, cost = from_state(self.codes, 0, len(self.codes), START)
        end = best_end(vector, END)
        edits = edits_between(self.codes, START, end)
        digest, empty = hashlib.sha256(), True
        for role, text in repaired(((r[0], r[1], r[4]) for r in self.rows), edits, end):
            digest.update((b"" if empty else b"\n") + role.encode() + b":" + text.encode())
            empty = False
        audit = self.audit(edits) + "I" * len(TAIL[end])
        return {**counts, "costs": [cost + vector[end][0] + END[end] + gone], "ranks": [0], "audits": [audit], "sha": digest.hexdigest()}, edits, end

    def piece(self):
        """Costs, ranks and audits from each entry to each exit state, and the edits of each way."""
        counts, gone = self._counts()
        costs, ranks, ways = [], [], []
        for state in range(4):
            vector, cost = from_state(self.codes, 0, len(self.codes), state)
            for end, found in enumerate(vector):
                costs.append(cost + found[0] + gone if found else -1)
                ranks.append(found[1] if found else -1)
                ways.append(edits_between(self.codes, state, end) if found else "-" * len(self.codes))
        audits = [self.audit(w) if c >= 0 else "" for w, c in zip(ways, costs)]
        return {**counts, "costs": costs, "ranks": ranks, "audits": audits, "sha": None}, list(map("".join, zip(*ways)))


def repaired(rows, edits, end=START):
    """(role, text) of the turns that (role, text, dead) rows become."""
    live = iter(edits)
    for role, text, dead in rows:
        edit = "D" if dead else next(live)
        if edit != "D":
            now = role if edit in "Kk" else ROLES[edit.lower()]
            if edit in "kua":
                yield ROLES["a" if now[0] == "u" else "u"], ""
            yield now, text
    for turn in TAIL[end]:
        yield ROLES[turn], ""


def _judged(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and the first fault of the first of them."""
    keyed = keyed_turns(turns, " ").withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keys = ["conv_id", "dated", "at", "content"]
    rows = keyed.withColumns({"dated": F.col("turn").isNotNull(), "at": F.coalesce("turn", F.lit(0)), "content": content}).groupBy(keys).agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = materialize(rows, "turns")
    firsts = rows.groupBy("conv_id", "content").agg(F.min(F.struct("dated", "at")).alias("t")).select(
        "conv_id", "t.dated", "t.at", "content", F.lit(True).alias("fresh"))
    text = F.rtrim("text", F.lit(SPACES))
    fault = F.when(text == "", "blank").when(F.col("fresh").isNull(), "duplicate").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.join(firsts, keys, "left").select(
        "conv_id", F.when(F.col("dated"), F.col("at")).alias("turn"), "role", "text", "copies", fault.alias("fault"))


def _solved(rows: DataFrame, with_rows: bool) -> DataFrame:
    """Summaries of conversations and pieces (column piece) and rows (column row); rows of whole conversations on request."""
    pieces, lines = (pa.struct([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(),
                                                "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
                                                "array<string>": pa.list_(pa.string())}[f.split()[1]]) for f in s.split(", ")]) for s in (PIECE, ROW))

    def run(batches):
        part, at, first, seq, out, size = TaskContext.get().partitionId(), None, True, 0, [], 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pieces), pa.array([r for _, r in out], lines)], names=["piece", "row"])
            out.clear()
            return batch

        def close(whole):
            """Output of the conversation that has ended in this partition."""
            if whole:
                found, edits, end = at.solved()
                ways = list(edits)
            else:
                found, ways = at.piece()
            yield {"conv_id": at.conv_id, "part": part, "whole": whole, **found}, None
            live = iter(ways)
            for k, (role, text, copies, _, dead) in enumerate(at.rows if with_rows or not whole else ()):
                yield None, {"conv_id": at.conv_id, "part": part, "seq": seq + k, "role": role, "text": text, "copies": copies, "dead": dead,
                             "edits": "D" if dead else next(live)}

        for batch in batches:
            for conv_id, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        out += close(not first)
                        size += at.size
                        seq += len(at.rows)
                        first = False
                        if size > FLUSH:
                            yield flush()
                            size = 0
                    at = _Conversation(conv_id)
                at.add(role, text, copies, fault)
        if at is not None:
            out += close(False)
            yield flush()

    ordered = in_order(rows).select("conv_id", "role", "text", "copies", "fault")
    return ordered.mapInArrow(run, f"piece struct<{PIECE.replace(' ', ':').replace(',:', ',')}>, row struct<{ROW.replace(' ', ':').replace(',:', ',')}>")


def _joined(key, table):
    """One conversation from its pieces in order; the pieces' crossing states by cost to go, then rank."""
    parts = sorted(table.to_pylist(), key=lambda r: r["part"])
    ahead = [END]
    for p in reversed(parts):
        costs = [min((p["costs"][4 * s + t] + c for t, c in enumerate(ahead[-1]) if c is not None and p["costs"][4 * s + t] >= 0), default=None) for s in range(4)]
        ahead.append(tuple(costs))
    state, ways, audit, illegal = START, [], [], 0
    ahead.pop()
    for before, p in zip([None, *parts], parts):
        rest = ahead.pop()
        vector = [(p["costs"][4 * state + t], p["ranks"][4 * state + t]) if p["costs"][4 * state + t] >= 0 else None for t in range(4)]
        end = best_end(vector, rest)
        ways.append(4 * state + end)
        audit.append(p["audits"][ways[-1]])
        illegal += p["illegal"] + (before is not None and before["last"] + p["first"] not in LEGAL)
        state = end
    cost = sum(p["costs"][w] for p, w in zip(parts, ways)) + END[state]
    row = {"conv_id": parts[0]["conv_id"], **{c: sum(p[c] for p in parts) for c in ("n_rows", "blank", "duplicate", "truncated")}, "illegal": illegal,
           "cost": cost, "audit": "".join(audit) + "I" * len(TAIL[state]), "parts": [p["part"] for p in parts], "ways": ways, "end": state}
    return pa.Table.from_pylist([row], pa.schema([*((c, pa.string() if c in ("conv_id", "audit") else pa.list_(pa.int32()) if c in (
        "parts", "ways") else pa.int64()) for c in row)]))


def _open_conversations(solved: DataFrame):
    """(conversations over the ends of partitions, their rows with one edit each)."""
    pieces = solved.filter("piece is not null and not piece.whole").select("piece.*")
    joined = pieces.groupBy("conv_id").applyInArrow(
        _joined, "conv_id string, n_rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                 "parts array<int>, ways array<int>, end long")
    joined = materialize(joined, "joined")
    ways = joined.select("conv_id", F.inline(F.arrays_zip(F.col("parts").alias("part"), F.col("ways").alias("way"))), "end")
    rows = solved.filter("row is not null and length(row.edits) > 1 or row.dead").select("row.*")
    chosen = rows.join(F.broadcast(ways), ["conv_id", "part"])          # at most two ways per partition
    return joined, chosen.withColumn("edit", F.when(F.col("dead"), "D").otherwise(F.substring("edits", F.col("way") + 1, F.lit(1)))).drop("edits", "way")


def _digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of each conversation, row by row."""
    def run(batches):
        at, digest, empty, tail = None, None, True, START

        def out():
            nonlocal empty
            feed(repaired((), "", tail))
            return pa.RecordBatch.from_pydict({"conv_id": [at], "sha": [digest.hexdigest()]})

        def feed(turns):
            nonlocal empty
            for role, text in turns:
                digest.update((b"" if empty else b"\n") + role.encode() + b":" + text.encode())
                empty = False

        for batch in batches:
            for conv_id, role, text, edit, end in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != at:
                    if at is not None:
                        yield out()
                    at, digest, empty, tail = conv_id, hashlib.sha256(), True, end
                feed(repaired([(role, text, False)], edit))
        if at is not None:
            yield out()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "role", "text", "edit", "end").mapInArrow(
        run, "conv_id string, sha string")


def conversation_audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, faults by kind, illegal neighbours, cost, audit, digest of the repaired text."""
    judged = _judged(turns)
    solved = materialize(_solved(judged, with_rows=False), "solved")
    joined, rows = _open_conversations(solved)
    facts = ["conv_id", "n_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    whole = solved.filter("piece.whole").select("piece.*").withColumns({"cost": F.col("costs")[0], "audit": F.col("audits")[0]}).select(facts)
    found = whole.union(joined.join(_digests(rows), "conv_id").select(facts))
    return found.withColumn("conv_id", F.when(F.col("conv_id") != " ", F.col("conv_id").cast("long"))).withColumnRenamed("sha", "repaired_sha256")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """One row per turn after the repair, and per deleted one: conv_id, part, seq, step, edit, role, text, in this order.

    ``edit`` is K, R, D or I; ``part``, ``seq`` and ``step`` order the turns of a conversation.
    """
    solved = materialize(_solved(_judged(turns), with_rows=True), "solved")
    joined, opened = _open_conversations(solved)
    columns = ["conv_id", "part", "seq", "role", "text", "copies", "edit"]
    closed = solved.filter("row is not null").select("row.*").join(
        F.broadcast(solved.filter("piece is not null and not piece.whole").select("piece.conv_id", "piece.part")), ["conv_id", "part"], "left_anti")
    rows = closed.withColumn("edit", F.col("edits")).select(columns).union(opened.select(columns))
    initial = F.lower("edit")
    now = F.when(initial == "u", "user").when(initial == "a", "assistant").otherwise(F.col("role"))
    letter = F.when(F.col("edit") == "D", "D").when(initial == "k", "K").otherwise("R")
    turn = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    inserted = F.when(F.col("edit").isin("k", "u", "a"), F.array(turn(
        F.lit("I"), F.when(now.startswith("u"), "assistant").otherwise("user"), F.lit("")))).otherwise(F.array())
    gone = F.transform(F.sequence(F.lit(2).cast("long"), F.col("copies")), lambda k: turn(F.lit("D"), F.col("role"), F.col("text")))
    steps = F.concat(inserted, F.array(turn(letter, now, F.col("text"))), F.when(F.col("copies") > 1, gone).otherwise(F.array()))
    own = rows.select("conv_id", "part", "seq", F.posexplode(steps).alias("step", "t")).select("conv_id", "part", "seq", "step", "t.*")
    ends = solved.filter("piece.whole").select("piece.conv_id", F.col("piece.audits")[0].alias("audit")).union(joined.select("conv_id", "audit"))
    n = F.length(F.regexp_extract("audit", "I*$", 0))
    tail = ends.filter(n > 0).select("conv_id", F.lit(2**31 - 1).alias("part"), F.lit(0).cast("long").alias("seq"), F.posexplode(
        F.when(n == 2, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("assistant")))).alias("step", "role")).select(
        "conv_id", "part", "seq", "step", F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    return own.union(tail).withColumn("conv_id", F.when(F.col("conv_id") != " ", F.col("conv_id").cast("long")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with seeded faults: dropped, emptied, without sentence ends, repeated, or with role user."""
    turns = keyed_turns(conversations, " ")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(kind == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return turns.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                          F.explode(twice).alias("copy")).drop("copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """Repair of damaged conversations: one row per original conv_id."""
    rows = materialize(damaged(conversations), "damaged")
    audits = conversation_audits(rows)
    gaps = rows.filter("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(audits, F.col("id").eqNullSafe(audits["conv_id"]), "left").drop("conv_id").join(
        gaps, F.col("id").eqNullSafe(gaps["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_structure_repair(spark, sf_dir):
    """Every conversation, damaged by a seeded rule and repaired at least cost."""
    return damage_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
