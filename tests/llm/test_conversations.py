import random
from hashlib import sha256

from gridloom.llm import conversations as C
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, cost string, kind int"


def plain_solve(rows):
    """Least cost and audit by state, row after row."""

    def insert(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (9**9, "")), (c + 3, a + "I"))
        return best

    best = insert({0: (0, "")})
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    for role, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, 4, "D")]
            if fault != 1:
                more = 3 * (fault == 2)
                ways += [(3 if s == 2 else 2, 3 + more, "R")]
                ways += [(s, more, "K")] if not role else [(after[role, s], more, "K")] if (role, s) in after else []
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (9**9, "")), (c + cost, a + letter))
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


def plain_repair(rows):
    """rows of one conversation, in order, as (turn, role, text)."""
    space = " \t\n\x0b\x0c\r"
    coded, seen, count = [], set(), {1: 0, 2: 0, "dup": 0}
    for _, role, text in rows:
        bare = text.rstrip(space)
        fault = 1 if not bare else "dup" if (role, text) in seen else 2 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            count[fault] += 1
        coded.append((role[:1], 1 if fault == "dup" else fault))
    cost, audit = plain_solve(coded)
    state, lines, todo = 0, [], list(rows)
    for e in audit:
        row = todo.pop(0) if e != "I" else (None, None, "")
        if e == "D":
            continue
        if e == "K":
            role = row[1]
            state = {"s": 1, "u": 2, "a": 3}[role[:1]] if role else state
        else:
            state = 3 if state == 2 else 2
            role = "assistant" if state == 3 else "user"
        lines.append((role, row[2], e))
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = sha256("\n".join(f"{r}:{t}" for r, t, _ in lines).encode()).hexdigest()
    return (gaps, count[1], count["dup"], count[2], illegal, cost, audit, digest), lines


def test_search_from_both_ends():
    r = random.Random(1)
    for _ in range(4000):
        n = r.choice([0, 1, 2, 3, 5, 8, 13, 40])
        rows = [(r.choice(["s", "u", "a", "x", ""]) if r.random() < 0.7 else "ua"[k % 2], r.choice([0, 0, 0, 1, 2])) for k in range(n)]
        assert C.solve(rows) == plain_solve(rows), rows


def test_odd_rows(spark):
    r = random.Random(2)
    texts = ["A fine one.", "A fine one.", "cut off", "", " \n\t", None, "Really?", "long " * 3000, "ñ€😀!", "x.\n "]
    rows = [(c, None if r.random() < 0.1 else t // r.choice([1, 1, 2]), r.choice(["user", "assistant", "system", "tool", None, "", "User"]), r.choice(texts), "x", 1) for c in [1, 2, 3, None, -4, 5] for t in range(r.choice([1, 4, 9]))]
    rows += [(7, i, "ua"[i % 2], f"line {i}.", None, None) for i in range(3000)]  # one very long conversation
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = {}
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        want[c] = plain_repair([(t, " " if role is None else role, " " if text is None else text) for _, t, role, text, *_ in own])
    got = {x.conv_id: tuple(x)[1:] for x in C.repairs(df).collect()}
    assert got == {c: x[0] for c, x in want.items()}
    turns = {}
    for x in sorted(C.repaired_turns(df).collect(), key=lambda x: x.position):
        turns.setdefault(x.conv_id, []).append((x.role, x.text, x.edit))
    assert turns == {c: x[1] for c, x in want.items() if x[1]}
    assert C.repairs(df.limit(0)).count() == 0


def test_damage_drops_whole_conversations(spark):
    df = spark.range(400).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'Is it?' AS text")
    hurt = C.damage(df)
    gone = {x.conv_id for x in hurt.where(~F.col("present")).collect()}
    assert gone and {x.conv_id for x in hurt.collect()} == set(range(400))
    for x in C.repairs(hurt, F.col("present")).collect():
        empty = (x.cost, x.audit, x.repaired_sha256) == (0, "", sha256(b"").hexdigest())
        assert empty == (x.conv_id in gone) or x.audit == "D"
    nulls = C.damage(spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA))
    assert [(x.conv_id, x.turn, x.role) for x in nulls.collect()][0] == (None, None, " ")
