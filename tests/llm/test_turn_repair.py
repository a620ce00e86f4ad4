"""Conversation repair against whole-string searches, and its odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tremor.llm import turn_repair as tr

ROLES = {"s": "system", "u": "user", "a": "assistant"}


def legal(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def every_edit(rows, most_inserts=2):
    """(cost, audit, lines) of the cheapest, least repair, by trying all of them."""
    best = None
    inserts = [()] + [c for n in range(1, most_inserts + 1) for c in itertools.product("ua", repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for ops in itertools.product("KRrD", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for g, op, (role, text, must, cut) in zip(gaps, ops, rows):
                cost += 2 * len(g)
                audit += "I" * len(g)
                lines += [f"{ROLES[x]}:" for x in g]
                if must and op != "D":
                    break
                if op == "D":
                    cost += 3
                else:
                    cost += cut + (0 if op == "K" else 2)
                    lines.append({"K": role, "R": "user", "r": "assistant"}[op] + ":" + text)
                audit += op.upper()
            else:
                cost += 2 * len(gaps[-1])
                audit += "I" * len(gaps[-1])
                lines += [f"{ROLES[x]}:" for x in gaps[-1]]
                if legal("".join(x[:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def whole_strings(rows):
    """The same by states that carry whole audits."""
    table = {"": (0, "", ())}

    def states(i):
        return "" if i == "" else i

    def close(t):
        for _ in range(3):
            for st, (c, a, ls) in list(t.items()):
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[st]
                cand = (c + 2, a + "I", (*ls, ROLES[nxt] + ":"))
                if nxt not in t or cand[:2] < t[nxt][:2]:
                    t[nxt] = cand
        return t

    for role, text, must, cut in rows:
        new = {}
        for st, (c, a, ls) in close(dict(table)).items():
            options = [(st, c + 3, a + "D", ls)]
            if not must:
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[st]
                if role[:1] == nxt or (st == "" and role[:1] == "s"):
                    options.append((role[:1], c + cut, a + "K", (*ls, f"{role}:{text}")))
                options.append((nxt, c + 2 + cut, a + "R", (*ls, f"{ROLES[nxt]}:{text}")))
            for s2, *rest in options:
                if s2 not in new or rest[:2] < list(new[s2][:2]):
                    new[s2] = tuple(rest)
        table = new
    end = {k: v for k, v in close(dict(table)).items() if k == "a"}
    if "" in table:
        end[""] = table[""]
    return min(end.values(), key=lambda v: v[:2])


def run(rows):
    r = tr.Repair()
    most = 0
    for row in rows:
        r.step(*row)
        most = max(most, r.unresolved())
    return *r.finish(), most


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(rng, n, roles="suax"):
    names = {**ROLES, "x": rng.choice(["tool", "", " "])}
    out = []
    for i in range(n):
        must = rng.random() < rng.choice([0.1, 0.5])
        out.append((names[rng.choice(roles)], f"t{i}", must, not must and rng.random() < 0.4))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_every_edit_of_short_conversations(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(0, 3))
    cost, audit, lines = every_edit(rows)
    assert run(rows)[:3] == (cost, audit, digest(lines))


def test_whole_strings_of_long_conversations():
    for seed in range(1500):
        rng = random.Random(seed)
        rows = random_rows(rng, rng.randint(0, 60), rng.choice(["suax", "ua", "uuua", "x", "su", "aaau", "s"]))
        cost, audit, lines = whole_strings(rows)
        assert run(rows)[:3] == (cost, audit, digest(lines)), (seed, rows)


def test_memory_follows_the_unresolved_part():
    plain = [(ROLES["ua"[i % 2]], f"t{i}", False, False) for i in range(5000)]
    assert run(plain)[3] <= 8
    undecided = [("user", "t", False, False)] + [("user", "", True, False)] * 5000  # keep or delete the first: open to the end
    cost, audit, _, most = run(undecided)
    assert (cost, audit) == (15002, "K" + "D" * 5000 + "I") and most <= 8


def plain_table(rows):
    """The query's rows from (conv, turn, role, text), without Spark."""
    sp = lambda v: " " if v is None else v
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, steps = set(), [], []
        for _, role, text in kept:
            tail = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            steps.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in kept if t is not None]
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = whole_strings(steps)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest(lines)))
    return sorted(out, key=repr)


def test_table_with_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "One.", "Two", "three?", "One.", "Né! ", "x" * 20_000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(texts))
            for _ in range(900)]
    rows += rows[:100] + [(c, 0, "user", "Alone.") for c in range(1000, 1040)]  # some conversations lose all rows
    rows += [(7, t, ("user", "assistant")[t % 2], "Again and again.") for t in range(20, 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, audit string")
    got = sorted((tuple(r) for r in tr.repair_conversations(df, damaged=True).collect()), key=repr)
    want = plain_table(rows)
    assert got == want
    assert any(w[7] == "" and w[8] == digest([]) for w in want)


def test_empty_table_and_text_keys(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tr.repair_conversations(empty, damaged=True).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "user", "So?")], "c string, t int, role string, text string")
    got = tr.repair_conversations(named, conv_col="c", turn_col="t").collect()
    assert [(r.conv_id, r.illegal, r.cost, r.audit) for r in got] == [("a", 1, 2, "KR")]
