"""Repair of conversation structure by iterative-deepening A* (operator 13).

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. Rows are edited in order: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty
turn of either) 5; blank rows and rows seen before in their conversation must be deleted, and a row that breaks off and
is not deleted costs 5 more. The cheapest edits are found, of equally cheap ones those whose letters come first.

* The search goes depth first through the edits in the order of their letters (D, I, K, R) and gives up below what a
  bound allows; the first path that it accepts is the answer. The bound begins at a lower bound of the cost (rows that
  must go or cannot stay as they are, and neighbours with the same role) and rises to the least cost that it cut off.
  A table holds for every (row, state) that failed what is left to pay there at least; it stays valid between rounds.
* Long conversations are searched in segments of ``SEGMENT`` rows: for each state before and behind a segment the
  cheapest edits, of which only the cost and the rank among those from the same state go on. Paths never tie when one
  is the beginning of the other (a segment ends with an edit of its last row), so costs and ranks suffice to choose.
* Conversations of at most ``LONG`` rows are handled whole in one task. Longer ones are sorted by range over all tasks
  and cut into segments there; two passes over the segments' costs alone, streamed, choose the states between them.

Order of rows: turn (null first), then role and text. Null roles and texts are one space. Rows without a conversation
id are one conversation. Equal rows are repeats of the first of them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, stored

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
START, LED, ASKED, ANSWERED = range(4)            # nothing yet, behind s, behind u, behind a
NEXT = {(START, "s"): LED, (START, "u"): ASKED, (LED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
WANTED = {START: "u", LED: "u", ASKED: "a", ANSWERED: "u"}
TAIL = {START: "", LED: "II", ASKED: "I", ANSWERED: ""}     # what must be inserted behind the last row
ROLE = {"u": "user", "a": "assistant"}
SOUND = {"su", "ua", "au"}
NEVER = 1 << 30

SEGMENT = 16
LONG = 512
RANGE_ROWS = 50_000                   # rows of long conversations in a task


def row_marks(turns) -> tuple[str, int, int, int]:
    """(marks, blank, duplicate, truncated) of (role, text, repeated) rows. A mark is ``d`` for a row that must go,
    else the role's initial (``e`` none, ``x`` other than s, u, a), in upper case if the text breaks off."""
    marks, counts = [], [0, 0, 0]
    for role, text, repeated in turns:
        solid = text.strip(BLANK)
        if not solid or repeated:
            counts[0 if not solid else 1] += 1
            marks.append("d")
            continue
        mark = role[:1] if role[:1] in ("s", "u", "a") else "x" if role else "e"
        if solid[-1] not in ".!?":
            counts[2] += 1
            mark = mark.upper()
        marks.append(mark)
    return "".join(marks), *counts


def _bounds(marks: str) -> list[tuple[int, int]]:
    """Per row (cost of the rows from there at least, number of rows marked s): a row that must go or breaks off costs
    a deletion, one with another initial a reroling, and of two neighbours with the same role one is edited or one
    comes between them. Pairs that count share no row."""
    n = len(marks)
    pairs, forced, leads = [0] * (n + 2), [0] * (n + 1), [0] * (n + 1)
    follower = n                                   # the next row that is plainly u or a, if nothing else intervenes
    for i in range(n - 1, -1, -1):
        m = marks[i]
        forced[i] = forced[i + 1] + (DELETE if m == "d" or m.isupper() else REROLE if m == "x" else 0)
        leads[i] = leads[i + 1] + (m == "s")
        pairs[i] = pairs[i + 1]
        if m in "ua":
            if follower < n and marks[follower] == m:
                pairs[i] = max(pairs[i], 1 + pairs[follower + 1])
            follower = i
        elif m not in "de":
            follower = n
    return [(forced[i] + pairs[i], leads[i]) for i in range(n + 1)]


@lru_cache(maxsize=1 << 15)
def search(marks: str, entry: int = START, goals: tuple[int, ...] = (START, ANSWERED),
           tail: bool = True) -> tuple[int, str] | None:
    """(cost, edits) that lead from state ``entry`` through all rows to a state of ``goals``; with ``tail`` turns may be
    inserted behind the last row. None if there is no way."""
    n, bounds = len(marks), _bounds(marks)
    left: dict[tuple[int, int], int] = {}          # failed states: what they cost at least
    path: list[str] = []

    def least(i, q):
        cost, leads = bounds[i]
        return cost + max(leads - (q == START), 0)

    def go(i, q, budget):
        """-1 if a way within the budget was found, else what the rest costs at least."""
        know = left.get((i, q), -1)
        if know < 0:
            know = least(i, q)
        if know > budget:
            return know
        if i == n:
            if q in goals:
                return -1
            edits = [("I", INSERT, i, NEXT[q, WANTED[q]])] if tail else []
        else:
            mark = marks[i]
            edits = [("D", DELETE, i + 1, q), ("I", INSERT, i, NEXT[q, WANTED[q]])]
            if mark != "d":
                extra, initial = (BROKEN if mark.isupper() else 0), mark.lower()
                after = q if initial == "e" else NEXT.get((q, initial))
                if after is not None:
                    edits.append(("K", KEEP + extra, i + 1, after))
                edits.append(("R", REROLE + extra, i + 1, NEXT[q, WANTED[q]]))
        best = NEVER
        for letter, cost, i2, q2 in edits:
            got = go(i2, q2, budget - cost)
            if got < 0:
                path.append(letter)
                return -1
            best = min(best, cost + got)
        left[i, q] = best
        return best

    # what can be reached at all costs no more than to delete all rows and insert a few, or to keep one that breaks off
    bound, most = least(0, entry), DELETE * n + 4 * INSERT + BROKEN
    while bound <= most:
        got = go(0, entry, bound)
        if got < 0:
            return bound, "".join(reversed(path))
        bound = got
    return None


@lru_cache(maxsize=1 << 12)
def segment_ways(marks: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(costs, ranks) for every (state before, state behind): the rank orders the edits from one state before."""
    costs, ranks = [NEVER] * 16, [0] * 16
    for q in range(4):
        # nothing leads back to the beginning, and behind s only what was there or keeps a row marked s
        goals = [q2 for q2 in range(4) if q2 > LED or q == q2 or q2 == LED and q == START and "s" in marks.lower()]
        ways = [(w[1], q2, w[0]) for q2 in goals if (w := search(marks, q, (q2,), False))]
        for rank, (_, q2, cost) in enumerate(sorted(ways)):
            costs[4 * q + q2], ranks[4 * q + q2] = cost, rank
    return tuple(costs), tuple(ranks)


class Chain:
    """Cheapest ways through consecutive segments, four states at a time."""

    def __init__(self):
        self.cost, self.order = [0, NEVER, NEVER, NEVER], [0, 0, 0, 0]

    def step(self, costs, ranks) -> list[int]:
        """Goes through a segment; per state behind it the state before (-1: unreachable)."""
        best: list[tuple] = [(NEVER, 0, 0, -1)] * 4
        for q in range(4):
            if self.cost[q] < NEVER:
                for q2 in range(4):
                    if costs[4 * q + q2] < NEVER:
                        best[q2] = min(best[q2], (self.cost[q] + costs[4 * q + q2], self.order[q], ranks[4 * q + q2], q))
        order = sorted(range(4), key=lambda q2: best[q2][1:3])
        self.cost, self.order = [b[0] for b in best], [order.index(q2) for q2 in range(4)]
        return [b[3] for b in best]

    def last(self) -> int:
        """The state behind the last segment."""
        return min((self.cost[q] + INSERT * len(TAIL[q]), self.order[q], q) for q in range(4) if self.cost[q] < NEVER)[2]


def repair(marks: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    if len(marks) <= SEGMENT:
        return search(marks)
    parts, chain = [marks[i:i + SEGMENT] for i in range(0, len(marks), SEGMENT)], Chain()
    back = [chain.step(*segment_ways(p)) for p in parts]
    q2 = chain.last()
    edits, cost = [TAIL[q2]], INSERT * len(TAIL[q2])
    for part, states in zip(reversed(parts), reversed(back)):
        q = states[q2]
        got = search(part, q, (q2,), False)
        edits.append(got[1])
        cost, q2 = cost + got[0], q
    return cost, "".join(reversed(edits))


def apply_edits(turns, edits: str, state: int = START) -> list[dict]:
    """The repaired (role, text) rows; which role a new or changed one gets follows from those before it."""
    out, i = [], 0
    for e in edits:
        if e in "IR":
            role = ROLE[WANTED[state]]
            out.append({"role": role, "text": turns[i][1] if e == "R" else ""})
            state = NEXT[state, WANTED[state]]
        elif e == "K":
            role = turns[i][0]
            out.append({"role": role, "text": turns[i][1]})
            state = NEXT[state, role[:1]] if role else state
        i += e != "I"
    return out


def illegal_pairs(initials) -> int:
    return sum(a + b not in SOUND for a, b in zip(initials, initials[1:]))


# ------------------------------------------------------------------ as DataFrames

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
PART = ("part int, parts int, " + "".join(f"{c} long, " for c in COUNTS)
        + "audit string, repaired array<struct<role:string,text:string>>")


def _part_batch(rows, conv_type):
    names = ["conv_id", "part", "parts", *COUNTS, "audit", "repaired"]
    types = [conv_type, pa.int32(), pa.int32(), *[pa.int64()] * len(COUNTS), pa.string(), REPAIRED]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _whole(conv, rows):
    """The one part of a conversation from its sorted (turn, role, text, copies) rows; without copies a row is absent."""
    turns, seen, held = [], set(), set()
    for turn, role, text, copies in rows:
        for _ in range(copies):
            turns.append((role, text, (role, text) in seen))
            seen.add((role, text))
        if copies and turn is not None:
            held.add(turn)
    marks, *faults = row_marks(turns)
    cost, audit = repair(marks)
    gaps = max(held) - min(held) + 1 - len(held) if held else 0
    return (conv, 0, 1, gaps, *faults, illegal_pairs([t[0][:1] for t in turns]), cost, audit,
            apply_edits(turns, audit))


def _short(batches):
    """Rows sorted by conversation -> one part each."""
    now, rows, out, size = None, [], [], 0
    conv_type = None
    for b in batches:
        conv_type = b.column("conv_id").type
        for key, conv, *row in zip(*(b.column(c).to_pylist() for c in ("c", "conv_id", "turn", "role", "text", "copies"))):
            if now is None or key != now[0]:
                if now:
                    out.append(_whole(now[1], rows))
                now, rows = (key, conv), []
            rows.append(row)
            size += len(row[2])
        if size > 4 << 20 or len(out) > 5000:
            yield _part_batch(out, conv_type)
            out, size = [], 0
    if now:
        yield _part_batch([*out, _whole(now[1], rows)], conv_type)


SEGMENTS = ("c string, conv_id {conv}, pid int, idx int, marks string, blank long, duplicate long, truncated long, "
            "illegal long, first string, final string, costs array<int>, ranks array<int>, turns binary")


def _segments(batches):
    """Sorted rows of a range of long conversations -> segments with the costs of all ways through them."""
    import json

    import zstandard
    zip_ = zstandard.ZstdCompressor(level=3)
    pid, idx = TaskContext.get().partitionId(), 0
    now, turns, out, conv_type = None, [], [], None

    def segment():
        marks, *faults = row_marks(turns)
        initials = [t[0][:1] for t in turns]
        return (*now, pid, idx, marks, *faults, illegal_pairs(initials), initials[0], initials[-1], *segment_ways(marks),
                zip_.compress(json.dumps([t[:2] for t in turns]).encode("utf-8", "surrogatepass")))

    def batch():
        types = [pa.string(), conv_type, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(),
                 pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = ["c", "conv_id", "pid", "idx", "marks", "blank", "duplicate", "truncated", "illegal", "first", "final",
                 "costs", "ranks", "turns"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for b in batches:
        conv_type = b.column("conv_id").type
        for key, conv, *turn in zip(*(b.column(c).to_pylist() for c in ("c", "conv_id", "role", "text", "repeated"))):
            if now and (key != now[0] or len(turns) == SEGMENT):
                out.append(segment())
                idx, turns = idx + 1, []
            now = key, conv
            turns.append(turn)
        if len(out) > 100:
            yield batch()
            out = []
    if now:
        out.append(segment())
        yield batch()


def _forward(batches):
    """Segments of conversations in order -> per segment its number, the ways back from each state behind it, whether
    its first row does not follow the row before, and the state behind it were it the last."""
    now, chain, part, before = None, None, 0, None
    for b in batches:
        rows = []
        for c, pid, idx, first, final, costs, ranks in zip(*(b.column(x).to_pylist() for x in (
                "c", "pid", "idx", "first", "final", "costs", "ranks"))):
            if c != now:
                now, chain, part, before = c, Chain(), 0, None
            back = chain.step(costs, ranks)
            rows.append((c, pid, idx, part, back, int(before is not None and before + first not in SOUND), chain.last()))
            part, before = part + 1, final
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         names=["c", "pid", "idx", "part", "back", "border", "goal"])


def _backward(batches):
    """Segments of conversations from the last to the first -> the states before and behind each, and the number of parts."""
    now, state, parts = None, None, 0
    for b in batches:
        rows = []
        for c, pid, idx, part, back, border, goal in zip(*(b.column(x).to_pylist() for x in (
                "c", "pid", "idx", "part", "back", "border", "goal"))):
            if c != now:
                now, state, parts = c, goal, part + 1
            rows.append((c, pid, idx, part, parts, border, back[state], state))
            state = back[state]
        types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         names=["c", "pid", "idx", "part", "parts", "border", "entry", "goal"])


def _parts(batches):
    """Segments with the states before and behind them -> parts of the repaired conversations."""
    import json

    import zstandard
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for r in b.to_pylist():
            turns = json.loads(unzip.decompress(r["turns"]).decode("utf-8", "surrogatepass"))
            cost, audit = search(r["marks"], r["entry"], (r["goal"],), False)
            if r["part"] == r["parts"] - 1:
                audit, cost = audit + TAIL[r["goal"]], cost + INSERT * len(TAIL[r["goal"]])
            out.append((r["conv_id"], r["part"], r["parts"], r["gaps"] if r["part"] == 0 else 0, r["blank"], r["duplicate"],
                        r["truncated"], r["illegal"] + r["border"], cost, audit, apply_edits(turns, audit, r["entry"])))
        yield _part_batch(out, b.column("conv_id").type)


def _repair_long(spark: SparkSession, rows: DataFrame, conv: str) -> DataFrame:
    """Parts of long conversations: no task holds more than a range of their rows."""
    rows = stored(spark, rows.select("c", "conv_id", "turn", "role", "text", F.explode(F.expr("sequence(1, copies)")).alias("i"))
                  .select("c", "conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("k1"),
                          F.xxhash64(F.lit(7), "text", "role").alias("k2"), F.monotonically_increasing_id().alias("row")),
                  "long-conversations")
    total = rows.count()
    key = ["c", "k1", "k2"]
    firsts = stored(spark, rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("f"))
                    .where("n > 1").select(*key, "n", F.col("f.row").alias("first")), "repeated-turns")
    again = (join_counted(rows.select(*key, "row"), firsts, key, total).where("row <> first")
             .select("row", F.lit(True).alias("repeated")))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ranges = (rows.join(again, "row", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
              .repartitionByRange(max(-(-total // RANGE_ROWS), 1), *order).sortWithinPartitions(*order))
    segments = stored(spark, ranges.select("c", "conv_id", "role", "text", "repeated")
                      .mapInArrow(_segments, SEGMENTS.format(conv=conv)), "segments")
    steps = (segments.select("c", "pid", "idx", "first", "final", "costs", "ranks").repartition("c")
             .sortWithinPartitions("c", "pid", "idx")
             .mapInArrow(_forward, "c string, pid int, idx int, part int, back array<int>, border long, goal int"))
    states = (stored(spark, steps, "segment-steps").repartition("c").sortWithinPartitions("c", F.desc("part"))
              .mapInArrow(_backward, "c string, pid int, idx int, part int, parts int, border long, entry int, goal int"))
    gaps = rows.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
                                 .alias("gaps"))
    return (segments.drop("first", "final", "costs", "ranks").join(states, ["c", "pid", "idx"]).join(gaps, "c")
            .mapInArrow(_parts, f"conv_id {conv}, " + PART))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """conv_id, part, parts, what was found and paid (gaps, blank, duplicate, truncated, illegal, cost: they add up over
    a conversation's parts), audit (letters of the edits) and repaired (role and text of the turns after them).

    A conversation has one part, long ones several in order. ``copies_col`` says how often a row stands there; a
    conversation whose rows have no copies has one empty part. Other columns are not read. See the module on nulls, ties
    and repeated rows; an empty table gives no rows.
    """
    spark = rows.sparkSession
    src = rows.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("\0")).alias("c"), F.col(conv_col).alias("conv_id"),
                      F.col(turn_col).cast("long").alias("turn"),
                      *(F.coalesce(F.col(x), F.lit(" ")).alias(n) for x, n in ((role_col, "role"), (text_col, "text"))),
                      (F.col(copies_col).cast("int") if copies_col else F.lit(1)).alias("copies"))
    conv = src.schema["conv_id"].dataType.simpleString()
    sizes = src.groupBy("c").agg(F.sum(F.greatest("copies", F.lit(1))).alias("size"))
    long = stored(spark, sizes.where(F.col("size") > LONG).select("c"), "long-ids")
    any_long = not long.isEmpty()
    short = src.join(long, "c", "left_anti") if any_long else src
    out = (short.repartition("c").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "text")
           .mapInArrow(_short, f"conv_id {conv}, " + PART))
    if not any_long:
        return out
    held = src.where("copies > 0").join(long, "c", "left_semi")
    # a long conversation may lose all its rows; then its first absent row stands for it
    lost = (src.join(long, "c", "left_semi").groupBy("c").agg(F.max("copies").alias("copies"), F.first("conv_id").alias("conv_id"))
            .where("copies = 0").select("c", "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(" ").alias("role"),
                                        F.lit(" ").alias("text"), "copies"))
    return (out.unionByName(_repair_long(spark, held, conv))
            .unionByName(lost.mapInArrow(_short, f"conv_id {conv}, " + PART)))


def _digests(batches):
    """Parts of conversations in order -> SHA-256 of each one's ``role:text`` lines, read as a stream."""
    now, conv, sha, first = None, None, None, True
    for b in batches:
        out = []
        for c, conv_id, repaired in zip(*(b.column(x).to_pylist() for x in ("c", "conv_id", "repaired"))):
            if now is None or c != now:
                if now is not None:
                    out.append((conv, sha.hexdigest()))
                now, conv, sha, first = c, conv_id, hashlib.sha256(), True
            for t in repaired:
                sha.update(f"{'' if first else chr(10)}{t['role']}:{t['text']}".encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column("conv_id").type),
                                          pa.array([x[1] for x in out], pa.string())], names=["conv_id", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], b.column("conv_id").type), pa.array([sha.hexdigest()])],
                                         names=["conv_id", "sha"])


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation: its counts, cost and whole audit, and the SHA-256 of its repaired turns."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    one = parts.where("parts = 1").select("conv_id", *COUNTS, "audit", F.sha2(F.encode(F.array_join(lines, "\n"), "UTF-8"), 256)
                                          .alias("repaired_sha256"))
    several = parts.where("parts > 1").withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    sums = several.groupBy("c").agg(*(F.sum(x).alias(x) for x in COUNTS), F.sort_array(F.collect_list(F.struct("part", "audit")))
                                    .alias("a"))
    conv = parts.schema["conv_id"].dataType.simpleString()
    shas = (several.select("c", "conv_id", "part", "repaired").repartition("c").sortWithinPartitions("c", "part")
            .select("c", "conv_id", "repaired").mapInArrow(_digests, f"conv_id {conv}, sha string")
            .withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))))
    joined = sums.join(shas, "c").select("conv_id", *COUNTS, F.array_join("a.audit", "").alias("audit"),
                                         F.col("sha").alias("repaired_sha256"))
    return one.unionByName(joined)


def damage(rows: DataFrame) -> DataFrame:
    """Faults by a checksum of (conv_id, turn): a twentieth each is dropped, emptied, loses its sentence ends, stands
    twice, or is said by the user; ``copies`` tells how often a row stands."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":")
                     for c in ("conv_id", ":", "turn")))
    code = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
                       F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` after ``damage``: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return summaries(stored(spark, repair_conversations(rows, copies_col="copies"), "repaired-conversations"))
