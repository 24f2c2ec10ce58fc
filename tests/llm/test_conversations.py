"""Conversation repair against a search over every sequence of edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketline.llm import conversations
from basketline.llm.conversations import Repair, repaired

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out[conv]
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(BLANK)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def valid(initials):
    s = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (s != "" and len(s) % 2 == 0 and s == "ua" * (len(s) // 2))


def brute(rows):
    """All ways, a row at a time; only ways that no valid ending can follow are left out."""
    faults = faults_of(rows)
    ways = [(0, "", ())]

    def fits(out):
        x = "".join(r[0][:1] or "-" for r in out)
        x = x[1:] if x[:1] == "s" else x
        return x == ("ua" * len(x))[:len(x)]

    def insertions(way):
        todo, out = [way], []
        while todo:
            cost, audit, rows_ = todo.pop()
            out.append((cost, audit, rows_))
            if not audit.endswith("II"):
                todo += [(cost + 2, audit + "I", rows_ + ((r, ""),)) for r in ("user", "assistant") if fits(rows_ + ((r, ""),))]
        return out

    for (_, role, text), fault in zip(rows, faults):
        after = []
        for way in ways:
            for cost, audit, out in insertions(way):
                after.append((cost + 3, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    after += [(cost + c + late, audit + e, out + ((r, text),))
                              for c, e, r in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant"))]
        least = min(c for c, _, _ in after)
        ways = [w for w in after if w[0] <= least + 12 and fits(w[2])]
    ends = [w for way in ways for w in insertions(way) if valid("".join(r[0][:1] or "-" for r in w[2]))]
    cost, audit, out = min(ends, key=lambda w: (w[0], w[1]))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def talk(rnd, n, roles=("user", "assistant", "system", "tool", "", "user", "assistant")):
    texts = ["Yes.", "No", "Why?", "", " \n", "So it is.", "And then", "A long answer!\n", "Ends here. ", "x?y"]
    return [(rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def as_repair_rows(rows):
    """Equal neighbours counted, with whether role and text came before, as the operator feeds them."""
    out, seen = [], set()
    for turn, role, text in rows:
        if out and out[-1][:3] == [turn, role, text]:
            out[-1][3] += 1
            continue
        out.append([turn, role, text, 1, (role, text) in seen])
        seen.add((role, text))
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_all_ways(seed):
    rnd = random.Random(seed)
    rows = [(i, r, t) for i, (r, t) in enumerate(talk(rnd, rnd.randint(0, 6)))]
    assert repaired(as_repair_rows(rows)) == brute(rows)


def test_memory_stays_bounded_on_long_conversations():
    rnd = random.Random(3)
    repair, most, letters = Repair(), 0, 0
    for i in range(5000):
        role = rnd.choice(("user", "assistant", "user", "assistant", "tool"))
        repair.add(i, role, f"{i} {rnd.choice(('ok.', 'no', 'so?'))}", 1, False)
        letters += sum(len(e) for e, _ in repair.settled())
        most = max(most, repair.survivors.depth, len(repair.waiting))
    assert most < 60 and letters > 4900


def test_blank_rows_settle_without_a_long_tree():
    repair, most = Repair(), 0
    for i in range(2000):
        repair.add(i, "user", "", 1, False)
        for _ in repair.settled():
            pass
        most = max(most, repair.survivors.depth)
    assert most <= 2 and list(repair.end()) == [] and repair.cost(0) == 6000


def rows_of(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def odd_rows():
    rnd = random.Random(11)
    rows = [(c, i, r, t) for c in range(40) for i, (r, t) in enumerate(talk(rnd, rnd.randint(1, 6)))]
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (50, None, "user", "First."), (50, 3, None, "x."), (50, 9, "assistant", None)]
    rows += [(51, 1, "user", "Same.")] * 3 + [(51, 1, "assistant", "Tie."), (51, 2, "user", "Same."), (52, 1, "user", "Gone?")]
    rows += [(conv, 7, "user", "only one") for conv in range(60, 90)]  # some lose their only row
    return rows


@pytest.mark.parametrize("held", [2, 2048])
def test_operator_equals_brute_force(spark, held):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", n string, seen int").repartition(3)
    out = conversations.repair(conversations.damaged(df), held)
    assert rows_of(out) == {c: brute(r) for c, r in damage(rows).items()}


def test_parts_of_one_conversation_give_the_same(spark):
    """A conversation spread over several tasks, with ties and runs of blank rows at the seams."""
    rnd = random.Random(4)
    rows = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(talk(rnd, 240, ("user", "assistant", "system", "tool")))]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {c: repaired(as_repair_rows(r)) for c, r in damage(rows).items()}
    damaged = conversations.damaged(df)
    assert rows_of(conversations.repair(damaged, 5)) == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert rows_of(conversations.repair(damaged, 7)) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_repeats_become_one_row(spark):
    rows = [(1, 1, "user", "Again.")] * 3000 + [(1, 2, "assistant", "Fine.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    counted = conversations.counted(df.select("conv_id", "turn", "role", "text", F.lit(1).cast("bigint").alias("n")))
    assert counted.count() == 2
    got = conversations.repair(counted).first()
    assert got["audit"] == "K" + "D" * 2999 + "K" and got["cost"] == 3 * 2999 and got["duplicate"] == 2999 and got["illegal"] == 2999


def test_empty_table(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
