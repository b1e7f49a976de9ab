"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A conversation should read system (at most once, first), then user and
assistant in turn, ending with the assistant.  The states are what stands so
far: nothing, system, ...user, ...assistant.  Each row is kept, given the role
that fits, or deleted (blank and repeated rows always are), and empty turns are
inserted where none fits; the cheapest sequence of edits wins, ties by the
ASCII order of their initials (``D I K R``), so the result is unique.

A forward vector holds, for each state, the least cost of the rows so far and
the *rank* of its best audit among the states: audits of two states differ
before the shorter one ends (each ends with the edit of the same row), so
ranks suffice to compare them.  A backward vector holds the least cost from
each state on.  They meet in the middle; of the crossings of least total cost
the one of the lowest rank is the audit-least path, and both halves are solved
alone.  Nothing but a few vectors is kept, so space is linear in the rows.

The same vectors make the work distributed.  Rows are sorted over all tasks by
conversation and turn; a *segment* is a run of at most ``SEGMENT`` rows of one
conversation.  A segment's cost and rank matrices compose like a product, so
the states between the segments of a long conversation come from its summaries
(32 numbers each), and every segment is then solved where it lies.

Defined cases: null ``conv_id`` is a conversation of its own; null turns come
first; a null role or text counts as one space; rows of one turn stand by the
MD5 of ``length(role):role:text`` (equal rows are interchangeable); a role counts by its
first character; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opskpi.llm.local import key_runs
from opskpi.llm.staging import Staging

C = F.col
SEGMENT = 8192
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
#: Costs of the edits; a truncated row that is not deleted costs one more.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (BEGUN, ASSISTANT)
_NEVER = 1 << 60

#: Role classes of a row, by its first character, and the flags beside them in a row's code.
CLASSES = {"s": 1, "u": 2, "a": 3}
FORCED, TRUNCATED = 4, 8
_FOLLOWS = {BEGUN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _steps() -> list[list[tuple[int, str, int, int]]]:
    """For each row code the useful steps ``(state, audit, cost, next state)``: insertions, then the row's edit."""
    out = []
    for code in range(16):
        steps = {}
        for state in range(4):
            at, audit, cost = state, "", 0
            for _ in range(3):                      # three insertions in a row are never needed
                edits = [(DELETE, at)]
                if not code & FORCED:
                    follows = _FOLLOWS[at]
                    edits.append((REROLE, follows))
                    if code & 3 == follows:
                        edits.append((KEEP, follows))
                    if code & 3 == 1 and at == BEGUN:
                        edits.append((KEEP, SYSTEM))
                for edit, to in edits:
                    c = cost + COST[edit] + (1 if code & TRUNCATED and edit != DELETE else 0)
                    best = steps.get((state, to))
                    if best is None or (c, audit + edit) < best:
                        steps[state, to] = (c, audit + edit)
                at, audit, cost = _FOLLOWS[at], audit + INSERT, cost + COST[INSERT]
        out.append(sorted((s, a, c, t) for (s, t), (c, a) in steps.items()))
    return out


STEPS = _steps()
#: Insertions after the last row: (state, audit, cost, final state).
ENDS = [(BEGUN, "", 0, BEGUN), (SYSTEM, INSERT * 2, 2 * COST[INSERT], ASSISTANT), (USER, INSERT, COST[INSERT], ASSISTANT),
        (ASSISTANT, "", 0, ASSISTANT)]


def forward(codes, start: int) -> tuple[list[int], list[int]]:
    """Least cost of the rows from ``start`` to each state, and the rank of that state's least audit."""
    cost, rank = [_NEVER] * 4, [0] * 4
    cost[start] = 0
    for code in codes:
        best: list = [None] * 4
        for s, audit, c, t in STEPS[code]:
            if cost[s] < _NEVER:
                key = (cost[s] + c, rank[s], audit)
                if best[t] is None or key < best[t]:
                    best[t] = key
        order = sorted((b[1:], t) for t, b in enumerate(best) if b is not None)
        cost = [_NEVER if b is None else b[0] for b in best]
        rank = [0] * 4
        for i, (_, t) in enumerate(order):
            rank[t] = i
    return cost, rank


def backward(codes, end: list[int]) -> list[int]:
    """Least cost of the rows from each state on, given the cost after the last row."""
    cost = end
    for code in reversed(codes):
        now = [_NEVER] * 4
        for s, _, c, t in STEPS[code]:
            if cost[t] < _NEVER:
                now[s] = min(now[s], c + cost[t])
        cost = now
    return cost


def solve(codes: bytes, start: int, stop: int | None) -> tuple[str, int]:
    """The audit-least cheapest edits of the rows from ``start`` to ``stop`` (None: to the end), and their cost."""
    after = [_NEVER] * 4
    for s, _, c, _ in ENDS:
        after[s] = c if stop is None else after[s]
    if stop is not None:
        after[stop] = 0

    out: list[str] = []
    spent = 0

    def halve(lo: int, hi: int, state: int, after: list[int]) -> int:
        """Appends the edits of rows ``lo .. hi`` and returns the state behind them."""
        nonlocal spent
        if hi - lo == 1:
            _, audit, c, t = min(((c + after[t], audit, c, t) for s, audit, c, t in STEPS[codes[lo]] if s == state))
            out.append(audit)
            spent += c
            return t
        mid = (lo + hi) // 2
        cost, rank = forward(codes[lo:mid], state)
        rest = backward(codes[mid:hi], after)
        least = min(a + b for a, b in zip(cost, rest))
        cross = min((s for s in range(4) if cost[s] + rest[s] == least), key=lambda s: rank[s])
        end = [_NEVER] * 4
        end[cross] = 0
        return halve(mid, hi, halve(lo, mid, state, end), after)

    state = halve(0, len(codes), start, after) if len(codes) else start
    if stop is None:
        _, audit, c, _ = ENDS[state]
        out.append(audit)
        spent += c
    return "".join(out), spent


def chain(costs: np.ndarray, ranks: np.ndarray) -> list[int]:
    """States at the borders of a conversation's segments from their matrices; the first is ``BEGUN``.

    The same divide and conquer over summaries: forward vectors with ranks, a
    backward vector, the crossing of least cost and rank in the middle.
    """
    end = [_NEVER] * 4
    for s, _, c, _ in ENDS:
        end[s] = c

    def ahead(lo, hi, start):
        cost, rank = [_NEVER] * 4, [0] * 4
        cost[start] = 0
        for k in range(lo, hi):
            best = [min(((cost[s] + int(costs[k, s, t]), rank[s], int(ranks[k, s, t])) for s in range(4)
                         if cost[s] < _NEVER and costs[k, s, t] < _NEVER), default=None) for t in range(4)]
            order = sorted((b[1:], t) for t, b in enumerate(best) if b is not None)
            cost, rank = [_NEVER if b is None else b[0] for b in best], [0] * 4
            for i, (_, t) in enumerate(order):
                rank[t] = i
        return cost, rank

    def back(lo, hi, after):
        for k in range(hi - 1, lo - 1, -1):
            after = [min(min(int(costs[k, s, t]) + after[t], _NEVER) for t in range(4)) for s in range(4)]
        return after

    def halve(lo, hi, state, after):
        if hi - lo == 1:
            t = min(range(4), key=lambda t: (min(int(costs[lo, state, t]) + after[t], _NEVER), int(ranks[lo, state, t])))
            return [t]
        mid = (lo + hi) // 2
        cost, rank = ahead(lo, mid, state)
        rest = back(mid, hi, after)
        least = min(a + b for a, b in zip(cost, rest))
        cross = min((s for s in range(4) if cost[s] + rest[s] == least), key=lambda s: rank[s])
        fixed = [_NEVER] * 4
        fixed[cross] = 0
        return halve(lo, mid, state, fixed) + halve(mid, hi, cross, after)

    return [BEGUN] + halve(0, len(costs), BEGUN, end)[:-1]


# --- DataFrame side -----------------------------------------------------------

def _shown(c: str) -> Column:
    return F.coalesce(C(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by ``crc32(conv_id:turn) % 20``: dropped, emptied, unpunctuated, repeated and re-roled rows."""
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    text = F.when(C("kind") == 1, "").when(C("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(C("text"))
    return (conversations.select(C("conv_id").cast("long").alias("conv_id"), C("turn").cast("long").alias("turn"),
                                 _shown("role").alias("role"), _shown("text").alias("text"))
            .withColumn("kind", kind).where("kind <> 0")
            .withColumn("text", text).withColumn("role", F.when(C("kind") == 4, "user").otherwise(C("role")))
            .withColumn("copy", F.explode(F.when(C("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("copy", "kind"))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in global order of conversation and turn; ``rid`` is the place, ``key`` names role and text."""
    plain = rows.select(C("conv_id").cast("long").alias("conv_id"), C("turn").cast("long").alias("turn"),
                        _shown("role").alias("role"), _shown("text").alias("text")) \
                .withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary"))) \
                .withColumn("tie", F.monotonically_increasing_id())     # splits a hot run of equal rows
    order = [C("conv_id").asc_nulls_first(), C("turn").asc_nulls_first(), C("key"), C("tie")]
    return (plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
            .withColumn("rid", F.monotonically_increasing_id()))


def _coded_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, rid, part, code, fault``: what the repair needs of a row, without its text."""
    blank = ~C("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~C("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    lean = rows.select("conv_id", "turn", "rid", "key", blank.alias("blank"), cut.alias("cut"),
                       F.coalesce(*(F.when(F.substring("role", 1, 1) == k, v) for k, v in CLASSES.items()), F.lit(0)).alias("class"))
    firsts = lean.where(~C("blank")).groupBy("conv_id", "key").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    known = lean.join(firsts, "rid", "left")
    fault = (F.when(C("blank"), "blank").when(C("first").isNull(), "duplicate").when(C("cut"), "truncated"))
    return known.withColumn("fault", fault).select(
        "conv_id", "turn", "rid", "fault", "class",
        (C("class") + F.when(C("fault").isin("blank", "duplicate"), FORCED).when(C("fault") == "truncated", TRUNCATED)
         .otherwise(0)).cast("int").alias("code"))


def _segments(coded: DataFrame) -> DataFrame:
    """One row per segment: ``conv_id, at`` (its first rid), ``codes``, ``rids``; at most ``SEGMENT`` rows each."""
    part = F.shiftright("rid", 33)
    chunk = F.floor((C("rid") - F.shiftleft(part, 33)) / F.lit(SEGMENT)).cast("long")
    dealt = (coded.withColumn("chunk", F.shiftleft(part, 33) + chunk).withColumn("conv", F.coalesce("conv_id", F.lit(0).cast("long")))
             .withColumn("noconv", C("conv_id").isNull())
             .select("chunk", "noconv", "conv", "rid", "code").repartition("chunk", "noconv", "conv")
             .sortWithinPartitions("chunk", "noconv", "conv", "rid"))

    def run(batches):
        out: list[tuple] = []
        for t in key_runs(batches, ["chunk", "noconv", "conv"]):
            rids = t.column("rid").to_numpy()
            codes = t.column("code").to_numpy().astype(np.uint8)
            own = codes & 3
            bad = int(((own[:-1] == 0) | (own[1:] == 0) | ~(((own[1:] == 2) & (own[:-1] != 2)) | ((own[1:] == 3) & (own[:-1] == 2)))).sum())
            out.append((None if t.column("noconv")[0].as_py() else t.column("conv")[0].as_py(), int(rids[0]), codes.tobytes(),
                        rids.tobytes(), bad, int(own[0]), int(own[-1])))
            if len(out) == 1024:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = ["conv_id", "at", "codes", "rids", "illegal", "opens", "closes"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return dealt.mapInArrow(run, "conv_id long, at long, codes binary, rids binary, illegal long, opens int, closes int")


def _borders(segments: DataFrame, staging: Staging) -> DataFrame:
    """``at, start, stop``: the states around each segment of a conversation that has several."""
    several = (segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head")).where("n > 1")
               .select(C("conv_id").alias("c"), "head"))
    parts = segments.join(several, C("conv_id").eqNullSafe(C("c"))).select("head", "at", "codes")

    def summarise(batches):
        for b in batches:
            for head, at, codes in zip(*(b.column(i).to_pylist() for i in range(3))):
                both = [forward(codes, s) for s in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head]), pa.array([at]), pa.array([np.asarray([c for c, _ in both], np.int64).tobytes()], pa.binary()),
                     pa.array([np.asarray([r for _, r in both], np.int8).tobytes()], pa.binary())],
                    names=["head", "at", "costs", "ranks"])

    matrices = staging.put(parts.mapInArrow(summarise, "head long, at long, costs binary, ranks binary"), "matrices")

    def fold(batches):
        for t in key_runs(batches, ["head"]):
            at = t.column("at").to_pylist()
            costs = np.frombuffer(b"".join(t.column("costs").to_pylist()), np.int64).reshape(-1, 4, 4)
            ranks = np.frombuffer(b"".join(t.column("ranks").to_pylist()), np.int8).reshape(-1, 4, 4)
            states = chain(costs, ranks)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(states, pa.int32()), pa.array([*states[1:], None], pa.int32())],
                                             names=["at", "start", "stop"])

    return matrices.repartition("head").sortWithinPartitions("head", "at").mapInArrow(fold, "at long, start int, stop int")


def _solved(segments: DataFrame, borders: DataFrame) -> DataFrame:
    """Segments with their ``audit`` and ``cost``, and the edits of each row: ``edits(rid, pre, edit, role, post)``."""
    at_border = borders.withColumn("inner", C("stop").isNotNull())
    joined = segments.join(at_border, "at", "left")
    schema = ("conv_id long, at long, illegal long, opens int, closes int, audit string, cost long, "
              "edits array<struct<rid:long,edit:string,role:string,before:array<string>,behind:array<string>>>")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for row in rows:
                start = BEGUN if row["start"] is None else row["start"]
                audit, cost = solve(row["codes"], start, row["stop"])
                row.update(audit=audit, cost=cost, edits=_edits(np.frombuffer(row["rids"], np.int64).tolist(), audit, start, row["codes"]))
            keep = ("conv_id", "at", "illegal", "opens", "closes", "audit", "cost", "edits")
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in keep} for r in rows], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("illegal", pa.int64()), ("opens", pa.int32()),
                       ("closes", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()),
                       ("edits", pa.list_(pa.struct([("rid", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                                                     ("before", pa.list_(pa.string())), ("behind", pa.list_(pa.string()))])))])
    return joined.select("conv_id", "at", "codes", "rids", "illegal", "opens", "closes", "start", "stop").mapInArrow(run, schema)


def _edits(rids: list[int], audit: str, start: int, codes: bytes) -> list[dict]:
    """Edits by row: the roles inserted before it, its own edit and new role, the roles inserted behind the last row."""
    names, out, state, waiting, i = {USER: "user", ASSISTANT: "assistant"}, [], start, [], 0
    for edit in audit:
        if edit == INSERT:
            state = _FOLLOWS[state]
            waiting.append(names[state])
            continue
        role = None
        if edit != DELETE:
            state = SYSTEM if edit == KEEP and codes[i] & 3 == 1 else _FOLLOWS[state]
            role = names[state] if edit == REROLE else None
        out.append({"rid": rids[i], "edit": edit, "role": role, "before": waiting, "behind": []})
        waiting, i = [], i + 1
    out[-1]["behind"] = waiting
    return out


class Repaired:
    """Results of one repair, as DataFrames over staged tables.

    ``rows`` (``conv_id, rid, place, edit, fault, role, text``): the repaired
    conversations in order of ``rid`` and ``place``, deleted rows with
    ``edit = 'D'`` and null role; ``conversations`` (``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit``): a report per conversation.
    """

    def __init__(self, rows: DataFrame, conversations: DataFrame):
        self.rows, self.conversations = rows, conversations


def repair(conversations: DataFrame) -> Repaired:
    """Repairs ``conversations(conv_id, turn, role, text)``."""
    staging = Staging(conversations.sparkSession, "turns")
    rows = staging.put(_sorted_rows(conversations), "rows")
    coded = staging.put(_coded_rows(rows), "coded")
    segments = staging.put(_segments(coded), "segments")
    solved = staging.put(_solved(segments, staging.put(_borders(segments, staging), "borders")), "solved")

    edits = solved.select(F.explode("edits").alias("e")).select("e.*").withColumnRenamed("role", "new_role")
    own = F.struct(C("edit"), C("fault"), F.when(C("edit") != DELETE, F.coalesce("new_role", "role")).alias("role"),
                   F.when(C("edit") != DELETE, C("text")).alias("text"))

    def added(c: str) -> Column:
        return F.transform(C(c), lambda r: F.struct(F.lit(INSERT).alias("edit"), F.lit(None).cast("string").alias("fault"),
                                                    r.alias("role"), F.lit("").alias("text")))

    whole = (rows.select("conv_id", "rid", "role", "text").join(coded.select("rid", "fault"), "rid").join(edits, "rid")
             .select("conv_id", "rid", F.posexplode(F.concat(added("before"), F.array(own), added("behind"))).alias("place", "x"))
             .select("conv_id", "rid", "place", "x.*"))

    faults = coded.groupBy("conv_id").agg(
        *(F.count_if(C("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    turns = coded.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    wide = "decimal(38,0)"
    gaps = F.least(C("last_turn").cast(wide) - C("first_turn").cast(wide) + 1 - C("turns"), F.lit(str((1 << 63) - 1)).cast(wide))
    found = faults.join(turns.withColumnRenamed("conv_id", "c"), C("conv_id").eqNullSafe(C("c")), "left").select(
        "conv_id", F.when(C("turns").isNull(), 0).otherwise(gaps).cast("long").alias("gaps"), "blank", "duplicate", "truncated")

    # borders between segments: a conversation has few, one a ``SEGMENT`` rows
    in_order = F.sort_array(F.collect_list(F.struct("at", "audit", "illegal", "opens", "closes")))
    paths = (solved.groupBy("conv_id").agg(in_order.alias("s"), F.sum("cost").alias("cost"))
             .select(C("conv_id").alias("c"), "cost", F.array_join(F.transform("s", lambda x: x["audit"]), "").alias("audit"),
                     F.expr("aggregate(s, 0L, (n, x) -> n + x.illegal) + if(size(s) < 2, 0L, aggregate(sequence(1, size(s) - 1), 0L, "
                            "(n, i) -> n + if(s[i - 1].closes * 10 + s[i].opens IN (12, 23, 32), 0L, 1L)))").alias("illegal")))
    report = found.join(paths, C("conv_id").eqNullSafe(C("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repaired(whole, staging.put(report, "report"))


def text_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of each conversation's ``role:text`` lines, hashed as they stream by in order."""

    def run(batches):
        held, digest, out = None, None, []
        for b in batches:
            for noconv, conv, role, text in zip(*(b.column(c).to_pylist() for c in ("noconv", "conv", "role", "text"))):
                if (noconv, conv) != held:
                    if held is not None:
                        out.append((None if held[0] else held[1], digest.hexdigest()))
                    held, digest = (noconv, conv), hashlib.sha256()
                    digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                else:
                    digest.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out])],
                                                 names=["conv_id", "repaired_sha256"])
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None if held[0] else held[1]], pa.int64()), pa.array([digest.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    keyed = (rows.where(C("edit") != DELETE).withColumn("noconv", C("conv_id").isNull())
             .withColumn("conv", F.coalesce("conv_id", F.lit(0).cast("long"))).select("noconv", "conv", "rid", "place", "role", "text"))
    return keyed.repartition("noconv", "conv").sortWithinPartitions("noconv", "conv", "rid", "place").mapInArrow(
        run, "conv_id long, repaired_sha256 string")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The registered digest: every original ``conv_id`` with the report of its repair after ``damage``."""
    done = repair(damage(conversations))
    all_ids = conversations.select(C("conv_id").cast("long").alias("conv_id")).distinct()
    report = done.conversations.withColumnRenamed("conv_id", "c")
    digests = text_digests(done.rows).withColumnRenamed("conv_id", "d")
    zero = F.lit(0).cast("long")
    return (all_ids.join(report, C("conv_id").eqNullSafe(C("c")), "left").join(digests, C("conv_id").eqNullSafe(C("d")), "left")
            .select("conv_id", *(F.coalesce(k, zero).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
