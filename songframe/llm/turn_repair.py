r"""Repair of the structure of conversations at least cost.

Edits: Keep a turn (0), Rerole it to user or assistant (2), Delete it (3), Insert an
empty turn of user or assistant anywhere (2). Blank and duplicate turns must be deleted;
a truncated turn that stays adds 1. What is left has role initials (s?(ua)+)?. Of the
cheapest repairs that whose string of edits, the audit, is least in ASCII is taken.

The method is a dynamic program over turns and four states (nothing yet, system, user,
assistant last). A layer's step is a macro: a run of inserts and one edit of a turn,
written as I* and then D, K or R. No macro begins another, so strings of as many macros
compare like their macros one by one. A layer therefore keeps, in place of the audit of
each state, its rank among the four and a pointer to its parent; the audit is read back
from the pointers. A run of inserts has at most two: more lead where fewer do.

A conversation may be of any length. Turns are dealt out by ranges of (conversation, turn),
so that a long one spreads over tasks, and cut into parts of at most PART_ROWS turns or
PART_CHARS characters. A conversation that lies within one part is repaired there. For a
part of a longer one the same layers run from each of the four states; the costs and
ranks of the ways through it are all that the rest must know. One small row for each
part then goes to the task that chains the parts, by the same rule, as if each were one
turn; with its first and last state known each part is repaired on its own.

The first turn of a role and text is told from its duplicates by a mark sorted just before
it. A range may end between the two. The mark is then noted with the last part of its range,
and the turn that opens the next range is a part of its own, for which the chain decides.

Turns are taken by turn number (nulls first), those of the same number by role, then
SHA-256 of the text; rows that are alike in all of these are copies of one another. A null role
or text is one space. A turn is blank without a character other than ASCII white space, else
a duplicate if a turn before it has its role and text, else truncated if its last such
character is none of .!? . A null conversation id is an id. An empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from songframe.llm.common import SPACE, small_batches, staged, table

#: Turns and characters of text of a part; one longer turn is a part of its own.
PART_ROWS, PART_CHARS = 512, 200_000

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: State after an insert, and after a turn that takes the role that comes next.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: State that a kept turn leads to, by its role's initial and the state before.
KEEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Inserts after the last turn that lead to an end.
TAILS = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", "sound"


@functools.lru_cache(maxsize=64)
def macros(initial: str, fault: str) -> tuple[list[tuple[str, int, int]], ...]:
    """(code, state after, cost) of all macros on a turn, by the state before."""
    found = []
    for before in STATES:
        runs, at = [("", before)], before
        while len(runs) < 3 and NEXT[at] not in [state for _, state in runs]:
            at = NEXT[at]
            runs.append((runs[-1][0] + "I", at))
        ways = []
        for run, state in runs:
            cost, stays = INSERT * len(run), TRUNCATED * (fault == CUT)
            ways.append((run + "D", state, cost + DELETE))
            if fault in (CUT, SOUND):
                ways.append((run + "R", NEXT[state], cost + REROLE + stays))
                if (initial, state) in KEEPS:
                    ways.append((run + "K", KEEPS[initial, state], cost + KEEP + stays))
        found.append(ways)
    return tuple(found)


@dataclass
class Layers:
    """Costs and ranks of the states after the last layer (None: out of reach), and for
    each layer and state the macro that leads there and the state it comes from."""

    costs: list
    ranks: list
    parents: list = field(default_factory=list)

    @classmethod
    def starting(cls, state: int) -> Layers:
        return cls([0 if s == state else None for s in STATES], [0] * 4)

    def step(self, ways: Iterable) -> None:
        """ways: (mark, state after, cost) by the state before; of marks from the same
        state the lesser is the lesser string."""
        best = [None] * 4
        for before, more in enumerate(ways):
            if self.costs[before] is not None:
                for mark, after, cost in more:
                    way = (self.costs[before] + cost, self.ranks[before], mark, before)
                    if best[after] is None or way < best[after]:
                        best[after] = way
        order = sorted(b[1:3] for b in best if b)
        self.costs = [b and b[0] for b in best]
        self.ranks = [order.index(b[1:3]) if b else 0 for b in best]
        self.parents.append([b and (b[2], b[3]) for b in best])

    def end(self) -> int:
        """The state to end in."""
        return min((self.costs[s] + INSERT * len(tail), self.ranks[s], s) for s, tail in TAILS.items() if self.costs[s] is not None)[2]

    def back(self, state: int) -> list:
        """(state before, macro, state after) of every layer on the best way to a state."""
        path = []
        for parents in reversed(self.parents):
            mark, before = parents[state]
            path.append((before, mark, state))
            state = before
        return path[::-1]


def layers(turns: list, start: int) -> Layers:
    """turns: (turn, role, text, fault)."""
    found = Layers.starting(start)
    for _, role, _, fault in turns:
        found.step(macros(role[:1], fault))
    return found


def applied(turns: list, found: Layers, start: int, end: int, tail: str) -> tuple[str, list[dict]]:
    """The audit and the turns of the repair from one state to another."""
    audit, out, state = [], [], start

    def new(edit: str, text: str) -> None:
        nonlocal state
        state = NEXT[state]
        out.append({"edit": edit, "role": NAMES[state], "text": text})

    for (_, code, _), (_, role, text, _) in zip(found.back(end), turns, strict=True):
        audit.append(code)
        for _ in code[:-1]:
            new("I", "")
        if code[-1] == "R":
            new("R", text)
        elif code[-1] == "K":
            state = KEEPS[role[:1], state]
            out.append({"edit": "K", "role": role, "text": text})
    for _ in tail:
        new("I", "")
    return "".join(audit) + tail, out


def gap(before: int | None, after: int | None) -> int:
    """Turn numbers that are missing between two turns."""
    return 0 if before is None or after is None or after == before else after - before - 1


def facts(turns: list) -> dict:
    """What a part holds, without its neighbours."""
    faults = [t[3] for t in turns]
    initials = [t[1][:1] for t in turns]
    numbers = [t[0] for t in turns if t[0] is not None]
    return {
        BLANK: faults.count(BLANK), DUPLICATE: faults.count(DUPLICATE), CUT: faults.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "gaps": sum(map(gap, numbers, numbers[1:])),
        "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None, "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
    }


def whole(turns: list) -> dict:
    """The repair of a conversation that is one part."""
    found = layers(turns, NOTHING)
    end = found.end()
    audit, out = applied(turns, found, NOTHING, end, TAILS[end])
    return {"cost": found.costs[end] + INSERT * len(TAILS[end]), "audit": audit, "repaired": out}


def ways_through(turns: list) -> list[dict]:
    """Costs and ranks of all ways from a state before a part to one after it."""
    found = []
    for start in STATES:
        last = layers(turns, start)
        found += [{"before": start, "after": s, "cost": last.costs[s], "rank": last.ranks[s]} for s in STATES if last.costs[s] is not None]
    return found


SHARED = f"part long, parts long, {BLANK} long, {DUPLICATE} long, {CUT} long, illegal long, gaps long, cost long, audit string, repaired array<struct<edit: string, role: string, text: string>>"
PARTS = (
    f"pid int, no long, open boolean, marked boolean, opening string, {SHARED}, first_turn long, last_turn long, first_initial string, last_initial string, "
    "ways array<struct<before: int, after: int, cost: long, rank: int>>, turns array<struct<turn: long, role: string, text: string, fault: string>>"
)


def with_conv(conv: StructType, rest: str) -> StructType:
    return StructType([*conv.fields, *StructType.fromDDL(rest).fields])


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """All turns, dealt out and sorted by conversation and turn. A row without text goes
    just before the first of the turns that share a conversation, role and text."""
    space = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    sound = F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(sound, SOUND).otherwise(CUT)
    rows = rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))
    least = F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least")
    first = rows.where(F.col("fault") != BLANK).groupBy("conv", "role", "digest").agg(least)
    marks = first.select("conv", F.col("least.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), "digest", F.lit("").alias("fault"), F.lit(-1).cast("long").alias("row"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "row")]
    return rows.unionByName(marks).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()).drop("row")


def cut(rows: DataFrame, part_rows: int, part_chars: int) -> DataFrame:
    """The parts of all conversations: repaired where the conversation is no longer (open
    is false), else with their turns and ways through. The last of a range is marked where the
    mark of the turn after it came before the end; it may have no turns. A part of the one turn
    that opens a range has as opening the fault of that turn if it is no duplicate."""
    conv = rows.select("conv").schema
    result = with_conv(conv, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        turns, chars, no, owner, mark, pid, opening = [], 0, 0, None, None, None, None
        goes_on = True  # the first conversation of a partition may begin before it

        def part(more: bool, marked: bool = False) -> dict:
            nonlocal turns, chars, no, opening
            row = {"conv": owner, "pid": pid, "no": no, "open": more or goes_on, "marked": marked, "opening": opening, "part": 0, "parts": 1, **facts(turns)}
            row |= {"ways": ways_through(turns), "turns": [dict(zip(("turn", "role", "text", "fault"), t, strict=True)) for t in turns]} if row["open"] else whole(turns)
            turns, chars, no, opening = [], 0, no + 1, None
            return row

        for batch in batches:
            out = []
            for c, turn, role, text, digest, fault, pid in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != owner and turns:
                    out.append(part(more=False))
                    goes_on = False
                owner = c
                if text is None:
                    mark = (c, turn, role, digest)
                    continue
                if fault != BLANK:
                    if not turns and no == 0 and mark is None:
                        opening = fault
                    fault, mark = (fault, None) if mark == (c, turn, role, digest) else (DUPLICATE, mark)
                if turns and (opening or len(turns) >= part_rows or chars + len(text) > part_chars):
                    out.append(part(more=True))
                    goes_on = True
                turns.append((turn, role, text, fault))
                chars += len(text)
            yield to_batch(out, schema)
        if turns or mark:  # the last conversation may go on after the partition
            yield to_batch([part(more=True, marked=mark is not None)], schema)

    return rows.select("conv", "turn", "role", "text", "digest", "fault", "pid").mapInArrow(run, result)


def chained(open_parts: DataFrame) -> DataFrame:
    """For each part of a conversation of several: its number among them, the states before
    and after it, its cost, inserts after it, what happens at its front edge, and the fault of
    its turn where that is one which opens a range and is no duplicate."""
    conv = open_parts.select("conv").schema
    result = with_conv(conv, "pid int, no long, part long, parts long, before int, after int, tail string, cost long, edge_illegal long, edge_gaps long, opening string")

    def run(parts: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        parts = parts.sort_by([("pid", "ascending"), ("no", "ascending")]).to_pylist()
        for p, marked in zip(parts, [False, *(p["marked"] for p in parts)]):
            p["opening"] = p["opening"] if marked else None
            if p["opening"]:
                p["ways"] = ways_through([(None, p["first_initial"], None, p["opening"])])
        parts = [p for p in parts if p["first_initial"] is not None]
        found = Layers.starting(NOTHING)
        through = []
        for p in parts:
            ways = [[] for _ in STATES]
            for w in p["ways"]:
                ways[w["before"]].append((w["rank"], w["after"], w["cost"]))
            through.append({(w["before"], w["after"]): w["cost"] for w in p["ways"]})
            found.step(ways)
        end = found.end()
        rows, last_turn, last_initial = [], None, None
        for k, (p, (before, _, after), costs) in enumerate(zip(parts, found.back(end), through, strict=True)):
            tail = TAILS[end] if k == len(parts) - 1 else ""
            illegal = int(last_initial is not None and last_initial + p["first_initial"] not in LEGAL)
            rows.append({"conv": p["conv"], "pid": p["pid"], "no": p["no"], "part": k, "parts": len(parts), "before": before, "after": after, "tail": tail, "cost": costs[before, after] + INSERT * len(tail), "edge_illegal": illegal, "edge_gaps": gap(last_turn, p["first_turn"]), "opening": p["opening"]})
            last_turn, last_initial = p["last_turn"] if p["last_turn"] is not None else last_turn, p["last_initial"]
        return pa.Table.from_pylist(rows, to_arrow_schema(result))

    slim = open_parts.select("conv", "pid", "no", "marked", "opening", "ways", "first_turn", "last_turn", "first_initial", "last_initial")
    return slim.groupBy("conv").applyInArrow(run, result)


def finished(open_parts: DataFrame) -> DataFrame:
    """Repair each part of longer conversations between the states that its chain gives."""
    result = with_conv(open_parts.select("conv").schema, SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = [tuple(t.values()) for t in row.pop("turns")]
                start, end, tail, opening = row.pop("before"), row.pop("after"), row.pop("tail"), row.pop("opening")
                if opening:
                    turns = [(*turns[0][:3], opening)]
                    row |= {DUPLICATE: 0, CUT: int(opening == CUT)}
                audit, repaired = applied(turns, layers(turns, start), start, end, tail)
                out.append(row | {"audit": audit, "repaired": repaired})
            yield to_batch(out, schema)

    places = chained(open_parts).drop("conv")
    own = open_parts.select("conv", "pid", "no", BLANK, DUPLICATE, CUT, "illegal", "gaps", "turns")
    rows = own.join(places, ["pid", "no"]).withColumns({"illegal": F.col("illegal") + F.col("edge_illegal"), "gaps": F.col("gaps") + F.col("edge_gaps")})
    return rows.drop("pid", "no", "edge_illegal", "edge_gaps").mapInArrow(run, result)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row for each part of a conversation that has turns: conv, part (0 on) of parts,
    counts of its faults, illegal (neighbours whose initials are not su, ua or au), gaps (turn numbers missing),
    cost, audit and repaired (edit, role and text of its turns). Counts, gaps and costs of
    the parts add up, audits and turns follow one another."""
    small_batches(turns.sparkSession)
    parts = staged(cut(ordered(turns, conv, turn, role, text), part_rows, part_chars), "parts")
    names = ["conv", *StructType.fromDDL(SHARED).names]
    return parts.where(~F.col("open")).select(names).unionByName(staged(finished(parts.where("open")), "finished").select(names))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of `conversations` with faults, by a hash of their conversation and number."""
    space = F.lit(" ")
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(place) % 20).alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("lot") == 3, 2).when(F.col("lot") == 0, 0).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


COUNTS = ["gaps", BLANK, DUPLICATE, CUT, "illegal", "cost"]


def written(repaired: str = "repaired") -> Column:
    """role:text of the turns, a line each."""
    return F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digests(parts: DataFrame) -> DataFrame:
    """One row for each conversation: counts, audit, and the SHA-256 of its repaired turns.

    A digest reads a conversation from its first byte to its last, so one task must see all of a
    conversation; of those in several parts it does so as a stream, a part at a time."""
    one = parts.where("parts = 1").select("conv", *COUNTS, "audit", F.sha2(written(), 256).alias("repaired_sha256"))
    many = parts.where("parts > 1").select("conv", "part", "parts", *COUNTS, "audit", written().alias("text"), F.size("repaired").alias("size"))

    result = one.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    sums, audit, hashed, empty = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), True
                sums = {c: n + row[c] for c, n in sums.items()}
                audit.append(row["audit"])
                if row["size"]:
                    hashed.update(("" if empty else "\n").encode() + row["text"].encode())
                    empty = False
                if row["part"] == row["parts"] - 1:
                    out.append({"conv": row["conv"], **sums, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()})
            yield to_batch(out, schema)

    streamed = many.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, result)
    return one.unionByName(streamed)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(turns)))
    every = turns.select("conv_id").distinct()
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    none = hashlib.sha256(b"").hexdigest()
    return rows.fillna(0, COUNTS).fillna("", ["audit"]).fillna(none, ["repaired_sha256"])


OP12_SQL = r"""
WITH RECURSIVE
named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
lots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1))))) % 20 AS lot FROM named),
hurt AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
                CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE lot WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM lots),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i FROM hurt),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'sound' ELSE 'truncated' END AS fault,
                  role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
runs(x, run, z) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
edits(z, edit, initial, y) AS (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (3, 'R', NULL, 2),
                                      (2, 'R', NULL, 3), (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)),
moves AS (SELECT x, run || edit AS code, initial, y, 2 * length(run) + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END AS cost, edit FROM runs JOIN edits USING (z)),
ways AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM placed
         UNION ALL
         SELECT w.conv_id, w.i + 1, m.y, min({'cost': w.best.cost + m.cost + CASE WHEN m.edit <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || m.code})
         FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
              JOIN moves m ON m.x = w.state AND (m.initial IS NULL OR m.initial = j.initial) AND (m.edit = 'D' OR j.fault IN ('sound', 'truncated'))
         GROUP BY w.conv_id, w.i, m.y),
tails(state, tail) AS (VALUES (0, ''), (3, ''), (2, 'I'), (1, 'II')),
totals AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ends AS (SELECT t.conv_id, min({'cost': w.best.cost + 2 * length(tail), 'audit': w.best.audit || tail}) AS best
         FROM ways w JOIN tails USING (state) JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i GROUP BY t.conv_id),
steps AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS p FROM ends),
counted AS (SELECT *, count(*) FILTER (edit <> 'I') OVER o AS i, count(*) FILTER (edit <> 'D') OVER o AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS stay
            FROM steps WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
mended AS (SELECT c.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN j.role WHEN (place - stay % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY p)) AS h
           FROM counted c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i WHERE edit <> 'D' GROUP BY c.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
     LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM d.conv_id
"""
