"""Prefix trie and structure repair of conversations against plain versions over the whole table."""

import hashlib
import functools
import random
import re
import zlib

from sedge.llm import prefix_trie, turn_repair
from sedge.session import table

SCHEMA = "conv_id long, turn long, role string, text string, own string"


def plain_trie(rows):
    def code(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08x}"

    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, code(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(first, [])[:h] + turns[h:]
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in members if tuple(built[c]) == path)))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(nodes)


def found_trie(df):
    rows = [tuple(r) for r in df.select(prefix_trie.RESULT).collect()]
    return set(rows), len(rows)


def odd_conversations(seed=3):
    r = random.Random(seed)
    words = ["", "a", "bb.", "ça va?", "x" * 5000, "🙂 ok"]
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, -5, -100, 7_000_000_000]:
        for t in range(r.choice([0, 1, 2, 3, 9])):
            rows.append((c, r.choice([None, t, t, t, 2]), r.choice(["user", "assistant", None, "system", ""]), r.choice(words)))
    rows += [(c, t, "user", "same") for c in range(1000, 1090) for t in range(7)]  # a large group of copies
    rows += [(None, 1, "user", "lost"), (42, 3, None, None), (42, 3, None, None)]
    return rows


def test_trie_is_that_of_brute_force(spark, sf):
    conversations = table(spark, sf, "conversations")
    want = plain_trie([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])
    assert found_trie(prefix_trie.report(conversations)) == want


def test_trie_of_odd_rows_over_one_and_many_ranges(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = plain_trie(rows)
    keyed = prefix_trie.rebuilt(frame)
    for size in (1 << 20, 500):
        assert found_trie(prefix_trie.trie(keyed, size)) == want
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nodes_take_all_layouts():
    root = prefix_trie.Node(b"", 0)
    keys = [bytes([k]) + bytes(19) for k in range(256)]
    rooms = set()
    for row, key in enumerate(keys):
        prefix_trie.insert(root, key, row)
        rooms.add(root.room)
        assert all(root.slots[root.place(k[0])].sample == k for k in keys[: row + 1])
        assert row == 255 or root.place(keys[row + 1][0]) < 0
    assert rooms == set(prefix_trie.LAYOUTS)


def plain_repair(rows):
    """Every conversation by itself, with whole audits compared as strings."""
    blanks, out = "\x20\x09\x0a\x0b\x0c\x0d", set()
    groups: dict = {}
    for c, turn, role, text in rows:
        mine = groups.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for c, mine in groups.items():
        told = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, told(x)))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.strip(blanks)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in mine]

        @functools.lru_cache(None)
        def best(k, state, added=0):
            """state: what the role initials so far allow next. Gives cost, audit and repaired roles (None: deleted)."""
            ways = []
            if k == len(mine) and state in ("start", "a"):
                ways.append((0, "", ()))
            made = "a" if state == "u" else "u"
            if added < 3:
                cost, audit, roles = best(k, made, added + 1)
                ways.append((cost + 3, "I" + audit, (("+", made), *roles)))
            if k < len(mine):
                cost, audit, roles = best(k + 1, state)
                ways.append((cost + 4, "D" + audit, roles))
                if faults[k] not in ("blank", "duplicate"):
                    torn = 3 * (faults[k] == "truncated")
                    i = initials[k]
                    if i == "s" and state == "start" or i == "u" and state in ("start", "s", "a") or i == "a" and state == "u":
                        cost, audit, roles = best(k + 1, i)
                        ways.append((cost + torn, "K" + audit, ((k, None), *roles)))
                    cost, audit, roles = best(k + 1, made)
                    ways.append((cost + 3 + torn, "R" + audit, ((k, made), *roles)))
            return min(ways, key=lambda w: w[:2], default=(10**9, "~", ()))

        cost, audit, roles = best(0, "start")
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[to] if to else mine[k][1]}:{'' if k == '+' else mine[k][2]}" for k, to in roles]
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_repair_is_that_of_brute_force(spark, sf):
    for rows in ([tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()], odd_conversations(), [(c, t, random.Random(c * 31 + t).choice("suat"), random.Random(c + t * 17).choice(["a.", "b", ""])) for c in range(300) for t in range(c % 9)]):
        frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
        found = [tuple(r) for r in turn_repair.report(frame).collect()]
        assert len(found) == len(set(found)) == len({r[0] for r in rows})
        assert set(found) == plain_repair(rows)
    assert turn_repair.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_ends_are_one_node():
    automaton = turn_repair.Automaton()
    automaton.enter("EIEI")
    before = len(automaton.costs)
    automaton.enter("AEIEI")
    assert len(automaton.costs) == before + 1
    assert automaton.enter("EI") < before == len(automaton.costs) - 1
