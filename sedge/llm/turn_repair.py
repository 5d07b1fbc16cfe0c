"""Conversation structure repair over a suffix-shared automaton of turn signatures.

A conversation's signature has one letter per turn: its role's class and its first fault. Distinct signatures, sorted by
their ends, build one automaton per range in which equal ends are one node, from the last turn to the first. Every node
holds, for each state of the grammar `(s?(ua)+)?`, the least cost of repairing what follows and the first letter of the best
audit, which goes on at another node: both are worked out once, however many conversations end that way.

Edits: keep (K) 0, change the role (R) 3, delete (D) 4, which blank and repeated turns need, insert a turn without text (I) 3;
a truncated turn that stays costs 3 more. Of equally cheap edits those with the least letters are taken.

Defined results: a null role or text is one space, a null turn or conv_id stands as one space in the hashed key; rows without
conv_id are one conversation; turns of equal number go by the digest of role and text; a conversation all of whose rows are
dropped has zeros, no audit and the digest of nothing; roles count by their first letter alone, so an empty role fits
nowhere; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: White space of the contract, and the marks that end a sentence.
BLANKS, MARKS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Classes of roles (by initial; the last stands for all others) and faults; a signature's letters count them off from A.
ROLES, FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
#: Costs of edits, and of keeping a truncated turn.
COSTS, TORN = {"K": 0, "R": 3, "D": 4, "I": 3}, 3
#: Grammar: states are start, after s, after u, after a. What a role leads to, and what an edit that makes a turn leads to.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {}}
MADE = {0: 2, 1: 2, 2: 3, 3: 2}
FINAL = (0, 3)
NEVER = 1 << 60
#: Signature bytes of one range, about, and the size up to which the repairs of all signatures are broadcast.
RANGE_BYTES, BROADCAST_BYTES = 1 << 20, 8 << 20

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with dropped ones as markers: conv (id as text), known, turn, role, text, dropped and digest."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), or_blank("role").alias("role"), or_blank("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", "".join(MARKS), "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")), "text": text, "copies": F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))})
    rows = rows.withColumn("digest", F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    return rows.select("conv", "known", "turn", "role", "text", (F.col("fate") == 0).alias("dropped"), "digest", F.explode("copies").alias("copy")).drop("copy")


def letters(rows: DataFrame) -> DataFrame:
    """conv, known, turn and letter of every row, those of a conversation together and in order; dropped rows have no letter.

    Texts stay behind. A repeated turn is one that is not the first of its digest, found by sorting, not by remembering.
    """
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ended == "", 1).when(~F.substring(ended, -1, 1).isin(*MARKS), 3).otherwise(0)
    kind = F.greatest(F.instr(F.lit(ROLES[:3]), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when((F.col("role") == "") | (kind == 0), 3).otherwise(kind - 1)
    narrow = rows.select("conv", "known", "turn", "digest", "dropped", kind.alias("kind"), fault.alias("fault")).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "digest", "dropped").orderBy("known", "turn")) > 1
    fault = F.when(F.col("again") & (F.col("fault") != 1), 2).otherwise(F.col("fault"))
    letter = F.when(F.col("dropped"), "").otherwise(F.char(F.lit(65) + 4 * F.col("kind") + fault))
    return narrow.withColumn("again", again).withColumn("letter", letter).sortWithinPartitions("conv", "known", "turn", "digest", "again").select("conv", "known", "turn", "letter", "dropped")


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted letters to one row per conversation: its signature, and the numbers that its turns skip."""
    none = object()
    now, word, low, high, seen = none, [], 0, 0, 0

    def row():
        return (now, "".join(word), high - low + 1 - seen if seen else 0)

    for batch in batches:
        out = []
        for conv, known, turn, letter, dropped in zip(*(batch[c].tolist() for c in ("conv", "known", "turn", "letter", "dropped")), strict=True):
            if conv != now:
                if now is not none:
                    out.append(row())
                now, word, seen = conv, [], 0
            if dropped:
                continue
            word.append(letter)
            if known:
                if not seen:
                    low = turn
                seen += not seen or turn != high
                high = turn
        yield pd.DataFrame(out, columns=["conv", "signature", "gaps"])
    if now is not none:
        yield pd.DataFrame([row()], columns=["conv", "signature", "gaps"])


class Automaton:
    """Ends of signatures: a node is a letter and the node of what follows it; node 0 is the empty end.

    costs[node][state] is the cost-to-go; audits[node][state] is the first letter of the best audit with the node and state
    where it goes on, so that equal ends of audits are shared as well.
    """

    def __init__(self) -> None:
        self.register: dict[tuple[str, int], int] = {}
        self.costs: list[list[int]] = []
        self.audits: list[list[tuple | None]] = []
        self._add([(0, None) if s in FINAL else (NEVER, None) for s in range(4)])

    def _add(self, best: list[tuple]) -> int:
        """A new node from what each state costs before inserting; inserted turns lead on within the node."""
        node = len(self.costs)
        costs, audits = [c for c, _ in best], [a for _, a in best]
        plain = list(zip(costs, audits, strict=True))
        for state in (3, 2, 1, 0):  # from 2 to 3 and back costs twice an insertion, so either starts from the other's plain cost
            to = MADE[state]
            base = plain[to][0] if state in (2, 3) else costs[to]
            cost = base + COSTS["I"]
            if cost < costs[state] or cost == costs[state] < NEVER and audits[state] and "I" < audits[state][0]:
                costs[state], audits[state] = cost, ("I", node, to)
        self.costs.append(costs)
        self.audits.append(audits)
        return node

    def node(self, letter: str, rest: int) -> int:
        """The node of a letter before a node, made where it is new."""
        if (letter, rest) in self.register:
            return self.register[letter, rest]
        kind, fault = divmod(ord(letter) - 65, 4)
        torn = TORN if FAULTS[fault] == "truncated" else 0
        best = []
        for state in range(4):
            ways = [(self.costs[rest][state] + COSTS["D"], ("D", rest, state))]
            if FAULTS[fault] in ("", "truncated"):
                to = STEPS[ROLES[kind]].get(state)
                if to is not None:
                    ways.append((self.costs[rest][to] + COSTS["K"] + torn, ("K", rest, to)))
                ways.append((self.costs[rest][MADE[state]] + COSTS["R"] + torn, ("R", rest, MADE[state])))
            best.append(min(ways, key=lambda w: (w[0], w[1][0])))
        found = self.register[letter, rest] = self._add(best)
        return found

    def enter(self, signature: str) -> int:
        node = 0
        for letter in reversed(signature):
            node = self.node(letter, node)
        return node

    def audit(self, node: int) -> str:
        out, state = [], 0
        while step := self.audits[node][state]:
            letter, node, state = step
            out.append(letter)
        return "".join(out)


#: Neighbours that a conversation may have, as pairs of classes.
LEGAL = ("su", "ua", "au")


def count_faults(signature: str) -> list[int]:
    """Numbers of blank, repeated and truncated turns, and of neighbours that don't follow each other."""
    kinds = "".join(ROLES[(ord(x) - 65) // 4] for x in signature)
    faults = [(ord(x) - 65) % 4 for x in signature]
    return [faults.count(1), faults.count(2), faults.count(3), sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))]


def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = Automaton()
    for batch in batches:
        out = []
        for signature in batch["signature"]:
            node = automaton.enter(signature)
            out.append((signature, *count_faults(signature), automaton.costs[node][0], automaton.audit(node)))
        yield pd.DataFrame(out, columns=["signature", *COUNTS[1:], "audit"])


def repairs(signatures: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """blank, duplicate, truncated, illegal, cost and audit of every distinct signature; equal ends are near each other."""
    few = cut(signatures.select("signature").distinct())
    total = few.agg(F.sum(F.length("signature") + 20).alias("n")).first()["n"] or 0
    ends = F.reverse("signature")
    ranged = few.repartitionByRange(max(1, -(-int(total) // range_bytes)), ends).sortWithinPartitions(ends)
    return cut(ranged.mapInPandas(solve, "signature string, " + ", ".join(f"{c} long" for c in COUNTS[1:]) + ", audit string"))


#: Roles of turns that edits make, by the state that they lead to.
MADE_ROLES = {2: "user", 3: "assistant"}


class Rewriter:
    """Writes a conversation as its audit says, turn by turn, into a digest."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.digest = audit, 0, 0, True, hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = MADE[self.state]
            self.write(MADE_ROLES[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[0]][self.state]
            self.write(role, text)
        elif edit == "R":
            self.state = MADE[self.state]
            self.write(MADE_ROLES[self.state], text)

    def close(self) -> str:
        self.insert()
        return self.digest.hexdigest()


RESULT = "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, each conversation's repair before its turns, to the repair with the digest of the repaired turns."""
    columns = ["conv", *COUNTS, "audit", "repaired_sha256"]
    head, writer = None, None
    for batch in batches:
        out = []
        for r in batch[["first", "conv", *COUNTS, "audit", "role", "text"]].itertuples(index=False, name=None):
            if r[0]:
                if writer:
                    out.append((*head, writer.close()))
                head, writer = r[1:9], Rewriter(r[8])
            else:
                writer.turn(r[9], r[10])
        yield pd.DataFrame(out, columns=columns)
    if writer:
        yield pd.DataFrame([(*head, writer.close())], columns=columns)


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Turns of a conversation pass in order through one task, as a digest wants them, but are never held together.
    """
    rows = damaged(conversations)
    signed = cut(letters(rows).mapInPandas(sign, "conv string, signature string, gaps long"))
    fixed = repairs(signed)
    size = fixed.agg(F.sum(F.length("signature") + F.length("audit") + 80).alias("n")).first()["n"] or 0
    heads = signed.join(F.broadcast(fixed) if size <= BROADCAST_BYTES else fixed, "signature")
    heads = heads.select("conv", F.lit(True).alias("first"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit("").alias("role"), F.lit("").alias("text"), *COUNTS, "audit")
    turns = rows.where(~F.col("dropped")).select("conv", F.lit(False).alias("first"), "known", "turn", "digest", "role", "text", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"))
    together = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", F.desc("first"), "known", "turn", "digest")
    return together.mapInPandas(rewrite, RESULT).select(F.col("conv").cast("long").alias("conv_id"), *COUNTS, "audit", "repaired_sha256")
