import functools
import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from fieldspan.llm import conversation_repair as R

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows, costs):
    """(cost, audit, final turns) by trying every edit of (role, text, must go, truncated) rows."""

    @functools.cache
    def go(i, state, left):
        best = (0, "", ()) if i == len(rows) and state in "-a" else (1 << 40, "~", ())
        options = [("I", i, who, None, costs.insert) for who in ("user", "assistant")] if left else []
        if i < len(rows):
            role, text, gone, short = rows[i]
            options.append(("D", i + 1, None, None, costs.delete))
            if not gone:
                more = costs.truncated if short else 0
                options += [("R", i + 1, who, text, costs.rerole + more) for who in ("user", "assistant")] + [("K", i + 1, role, text, more)]
        for edit, j, who, text, cost in options:
            to = state
            if who is not None:
                to = who[:1]
                if state + to not in ("-s", "-u", "su", "ua", "au"):
                    continue
            rest = go(j, to, left - 1 if edit == "I" else 2)
            turn = () if who is None else ((who, text or ""),)
            best = min(best, (cost + rest[0], edit + rest[1], turn + rest[2]), key=lambda x: x[:2])
        return best

    for i in range(len(rows), -1, -1):
        for state in "-sua":
            go(i, state, 2)
    return go(0, "-", 2)


def brute(given, costs=R.Costs(), damage=True):
    rows = []
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        rows += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv in set(r[0] for r in given):
        own = sorted(((t is not None, t or 0, r, x) for c, t, r, x in rows if c == conv))
        seen, counts, marked = set(), [0, 0, 0], []
        for _, _, role, text in own:
            rest = text.strip(SPACE)
            kind = 0 if not rest else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            marked.append((role, text, kind in (0, 1), kind == 2))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, final = cheapest(tuple(marked), costs)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, parts=4, damage=True, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gone int, cid string").repartition(parts)
    if damage:
        df = R.damaged(df)
    else:
        df = df.selectExpr("conv_id", "turn", "role", "text", "false as gone")
    return sorted((tuple(r) for r in R.repaired(df, **how).collect()), key=repr)


def made(seed, convs, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"], ["Fine.", "So?", "cut off", "cut.x", "", " \n\t", None, "Ends here! \x0b", "é.", "\x1f", "a\nb."]
    rows = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            if rng.random() < 0.6:
                rows.append((c, t, "assistant" if t % 2 else "user", f"Text {rng.randint(0, 30)}{rng.choice(['.', '.', '?', ''])}"))
            else:
                rows.append((c, rng.choice([None, t, t, t + 3]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 4)])
def test_against_brute_force(spark, seed, block):
    rows = made(seed, [None, *range(-3, 60)], 12)
    assert got(spark, rows, block_rows=block) == brute(rows)


def test_long_conversations_and_other_costs(spark):
    rows = made(5, [7], 400) + made(6, [8, None], 90) + [(9, 0, "user", "x" * 3_000_000 + "."), (9, 1, "assistant", "Yes.")] + [(10, 3, "user", "again.")] * 200
    assert got(spark, rows, block_rows=16) == brute(rows)
    costs = R.Costs(rerole=4, delete=7, insert=2, truncated=1)
    rows = made(7, [1, 2, 3], 60)
    assert got(spark, rows, damage=False, block_rows=8, costs=costs) == brute(rows, costs, damage=False)
    with pytest.raises(ValueError):
        R.Costs(insert=0)


def test_dropped_conversations_and_empty_table(spark):
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, 0, "user", "Hi.") for c in lost] + [(None, None, None, None)]
    found = got(spark, rows)
    assert found == brute(rows) and (lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    assert got(spark, rows[:1], block_rows=1) == brute(rows[:1])
    assert R.repaired(R.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(1, 9, 2, 1), R.Costs(3, 4, 1, 0)])
def test_plans_side_by_side(costs):
    rng = random.Random(3)
    runs = [[rng.choice([0, 1, 2, 3]) | rng.choice([0, 0, 0, 4, 8, 16]) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    plan = R.Plan(np.array(sum(runs, []), np.int64), np.array([len(r) for r in runs]), R.after_all(len(runs), costs), costs, ends=True)
    for run, base, (audit, _) in zip(runs, plan.base, plan.paths(4 * plan.base)):
        rows = tuple((["tool", "system", "user", "assistant"][c & 3], "", bool(c & 12), bool(c & 16)) for c in run)
        assert (int(plan.cost[base, 0]), audit) == cheapest(rows, costs)[:2]
