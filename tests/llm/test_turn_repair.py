import hashlib
import itertools
import random
import re

import pytest

from songframe.llm import turn_repair as repair

ROLES = ("system", "user", "assistant", "tool", "")


def turns_of(rng, n):
    """Turns as (turn, role, text, fault), faults as a reader would mark them."""
    out, seen = [], set()
    for i in range(n):
        role, text = rng.choice(ROLES), rng.choice(["", " \n", "a.", "b.", "c", "d? ", "e "])
        fault = repair.BLANK if not re.search(r"[^\x20\x09-\x0D]", text) else repair.DUPLICATE if (role, text) in seen else repair.SOUND if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else repair.CUT
        seen.add((role, text))
        out.append((i, role, text, fault))
    return out


def every_repair(turns):
    """(cost, audit, written turns) of all repairs with at most two inserts before each turn and at the end."""
    n = len(turns)
    for runs in itertools.product(range(3), repeat=n + 1):
        for edits in itertools.product("KRD", repeat=n):
            if any(e != "D" and t[3] in (repair.BLANK, repair.DUPLICATE) for e, t in zip(edits, turns)):
                continue
            audit = "".join("I" * r + e for r, e in zip(runs, edits)) + "I" * runs[-1]
            slots = [(x, t) for x, t in zip((c for c in audit), _rows(audit, turns)) if x != "D"]
            odd = len(slots) % 2
            if len(slots) == 1:
                continue
            roles = ["system"] * odd + ["user", "assistant"] * (len(slots) // 2)
            if any((x == "K" and t[1][:1] != r[0]) or (x != "K" and r == "system") for (x, t), r in zip(slots, roles)):
                continue
            cost = 2 * sum(runs) + sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and t[3] == repair.CUT) for e, t in zip(edits, turns))
            yield cost, audit, [(t[1] if x == "K" else r, "" if x == "I" else t[2]) for (x, t), r in zip(slots, roles)]


def _rows(audit, turns):
    rest = iter(turns)
    return [None if c == "I" else next(rest) for c in audit]


def test_whole_equals_all_repairs():
    rng = random.Random(1)
    for _ in range(150):
        turns = turns_of(rng, rng.randint(0, 4))
        cost, audit, written = min(every_repair(turns), key=lambda x: x[:2])
        got = repair.whole(turns)
        assert (got["cost"], got["audit"], [(x["role"], x["text"]) for x in got["repaired"]]) == (cost, audit, written)


def strings_program(turns):
    """The same program with whole audit strings in place of ranks."""
    best = {0: (0, "")}
    for _, role, _, fault in turns:
        new = {}
        for state, (cost, audit) in best.items():
            for code, after, more in repair.macros(role[:1], fault)[state]:
                way = (cost + more, audit + code)
                new[after] = min(new.get(after, way), way)
        best = new
    return min((c + 2 * len(repair.TAILS[s]), a + repair.TAILS[s]) for s, (c, a) in best.items())


def test_ranks_equal_strings_on_long_conversations():
    rng = random.Random(2)
    for n in (1, 7, 50, 400):
        for _ in range(5):
            turns = turns_of(rng, n)
            turns = [(i, r, t, rng.choice([f, repair.SOUND])) for i, r, t, f in turns]
            got = repair.whole(turns)
            assert (got["cost"], got["audit"]) == strings_program(turns)
            assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in got["repaired"]))


@pytest.mark.parametrize("part_rows, part_chars", [(512, 200_000), (3, 200_000), (1, 200_000), (512, 5)])
def test_parts_do_not_change_results(spark, hard_dir, part_rows, part_chars):
    turns = repair.damaged(spark.read.parquet(f"{hard_dir}/conversations.parquet"))
    want = {r.conv: r for r in repair.digests(repair.repair(turns)).collect()}
    parts = repair.repair(turns, part_rows=part_rows, part_chars=part_chars)
    got = {r.conv: r for r in repair.digests(parts).collect()}
    assert got == want
    if part_rows < 512:
        assert max(r.parts for r in parts.collect()) > 10


def test_a_long_conversation_spreads_over_tasks(spark):
    """One conversation of 6,000 turns, most of all rows: no task holds its turns, and the
    result is that of the program with strings."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", ""])) for i in range(6000)] + [(c, i, "user", "x.") for c in range(50) for i in range(2) if c != 7]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    parts = repair.repair(frame)
    assert parts.where("conv = 7").count() >= 6000 / repair.PART_ROWS
    got = next(r for r in repair.digests(parts).collect() if r.conv == 7)
    turns = [(t, r, x, repair.SOUND if x[-1] == "." else repair.CUT) for c, t, r, x in rows if c == 7]
    want = repair.whole(turns)
    assert (got.cost, got.audit) == strings_program(turns)
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in want["repaired"]).encode()).hexdigest()


@pytest.fixture
def many_ranges(spark):
    """As many ranges as there are on a large table."""
    ours = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_first_turns_at_the_front_of_a_range(spark, many_ranges):
    """A range may end between a turn and the mark that tells it from its duplicates, also
    among copies of one turn; ends of ranges do not change results."""
    rng = random.Random(5)
    talks = {c: turns_of(rng, rng.randint(1, 9)) for c in range(40)}
    talks[7] = [(0, "user", "a.", repair.SOUND)] + [(0, "user", "a.", repair.DUPLICATE)] * 60 + [(1, "assistant", "b", repair.CUT)] + [(1, "assistant", "b", repair.DUPLICATE)] * 60
    rows = [(c, *t[:3]) for c, turns in talks.items() for t in turns]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repair(frame)
    assert sum(r.parts > 1 for r in found.select("parts").collect()) > 40
    got = {r.conv: r for r in repair.digests(found).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        want = repair.whole(turns) | repair.facts(turns)
        assert {k: got[c][k] for k in [*repair.COUNTS, "audit"]} == {k: want[k] for k in [*repair.COUNTS, "audit"]}
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in want["repaired"]).encode()).hexdigest()
