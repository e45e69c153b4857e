r"""Conversation structure repair with an automaton of suffixes that all conversations share.

A conversation's rows, in order, become a signature: one letter per row for its role (its initial: system, user, assistant, other) and its
first fault (blank or repeated rows must go; truncated ones cost extra). Edits keep, rerole, delete a row or insert an empty one, and must
lead to roles `(s?(ua)+)?`. Minimised from the end, signatures form an automaton whose nodes are the different suffixes: the cheapest
way from a node and a grammar state to the end, ties by the least audit letters, is worked out once for all conversations that
end alike. It is built as automata of sorted words are: the different signatures are sorted by their reversed letters, so a task holds the
nodes of one path only and goes back to the longest suffix shared with the word before. A node keeps a cost and an edit for each of
the four states; the edits' letters differ, so comparing them compares whole audits.

Plan: signatures need no texts (their digests, once), so the first shuffle carries a few dozen bytes per row; repeated rows are found by counts
per (conversation, role, digest), combined before the shuffle. The different signatures are solved and joined back, and each conversation's audit is
sent ahead of its rows in the second shuffle, where the rows stream past it. No task holds more of a conversation than a letter per row and
one Arrow batch, and the output has a letter per row as well.

Defined results: null ids are one conversation; null roles and texts are one blank; rows are ordered by turn, nulls first, equal
turns by role and digest of the text; a conversation without rows gives zeros and an empty audit; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import SPACE
from prosopon.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: start, after a system row, after a user row, after an assistant row; the conversation may end in the first and last.
ENDS = (0, 3)
#: What comes next in a state: an inserted or reroled row's role, and the state after it.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: A kept row's initial and the states it leads to.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: A signature's letter: the role's initial (o for any other), in capitals if truncated; x if the row must go.
MUST_GO = "x"
Node = tuple[tuple[int, str], ...]  # per state: cost to the end, first edit


def with_inserts(direct: list[tuple[int, str] | None]) -> Node:
    """A node's states, once an inserted row may come first."""
    best = list(direct)
    for _ in range(3):  # a path of inserts visits a state once at most
        for state, (_, to) in enumerate(NEXT):
            if best[to] is not None:
                found = (best[to][0] + INSERT, "I")
                best[state] = found if best[state] is None else min(best[state], found)
    return tuple(best)


END: Node = with_inserts([(0, "") if s in ENDS else None for s in range(4)])


def node(letter: str, after: Node) -> Node:
    """The node of a suffix from its first letter and the node of the rest."""
    direct = []
    initial, more = letter.lower(), TRUNCATED if letter.isupper() else 0
    for state in range(4):
        found = (after[state][0] + DELETE, "D")
        if letter != MUST_GO:
            found = min(found, (after[NEXT[state][1]][0] + REROLE + more, "R"))
            if initial in KEPT[state]:
                found = min(found, (after[KEPT[state][initial]][0] + KEEP + more, "K"))
        direct.append(found)
    return with_inserts(direct)


def audit_of(signature: str, path: list[Node]) -> str:
    """The edits along a signature; path[k] is the node of its last k letters."""
    state, at, edits = 0, 0, []
    while True:
        edit = path[len(signature) - at][state][1]
        if not edit:
            return "".join(edits)
        edits.append(edit)
        if edit in "IR":
            state = NEXT[state][1]
        elif edit == "K":
            state = KEPT[state][signature[at].lower()]
        at += edit != "I"


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, nodes) of the different `signatures`; nodes: those that this one adds to the automaton."""

    def work(batches):
        path, before = [END], ""
        for batch in batches:
            rows = []
            for backwards in batch.column("backwards").to_pylist():
                shared = 0
                while shared < min(len(backwards), len(before)) and backwards[shared] == before[shared]:
                    shared += 1
                del path[shared + 1 :]
                for letter in backwards[shared:]:
                    path.append(node(letter, path[-1]))
                signature, before = backwards[::-1], backwards
                rows.append((signature, path[-1][0][0], audit_of(signature, path), len(backwards) - shared))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["signature", "cost", "audit", "nodes"])

    different = cut_lineage(signatures.select(F.reverse("signature").alias("backwards")).distinct(), "signatures")
    return different.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(work, "signature string, cost long, audit string, nodes long")


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): the rows as a faulty export leaves them, by crc32(`conv:turn`) modulo 20; null fields are one blank.

    0 drops the row (`gone`), 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    made = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank(role)).alias("role"),
        said.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return made.drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, letter, first_turn): rows of (conv, turn, role, text, gone) without their texts.

    `letter` is the signature's letter unless the row is repeated; `first_turn` is where a role and text that occur again came first.
    """
    last = F.regexp_extract(F.regexp_replace("text", f"[{SPACE}]++$", ""), r"(?s)(.)\z", 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("gone"), "").when(last == "", MUST_GO).when(last.isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    bare = rows.select("conv", "turn", "role", initial.alias("initial"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), letter.alias("letter"))
    again = bare.where(~F.col("letter").isin("", MUST_GO)).groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first_turn"))
    again = again.where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_turn")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return bare.join(again, same, "left").select("conv", "turn", "role", "initial", "digest", "letter", "first_turn")


def streamed(rows: DataFrame, *before: str) -> DataFrame:
    """`rows` with each conversation whole in one partition, in order."""
    return rows.repartition("conv").sortWithinPartitions("conv", *before, F.col("turn").asc_nulls_first(), "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of every conversation in the rows of `judged`."""
    legal = {"su", "ua", "au"}
    conv = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def work(batches):
        def closed():
            gaps = high - low + 1 - turns if turns else 0
            return (at, "".join(letters), gaps, blank, duplicate, truncated, illegal)

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=names)

        began, at, found = False, None, []
        for batch in batches:
            types = [batch.column("conv").type, pa.string(), *[pa.int64()] * 5]
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "letter", "first_turn", "initial")]
            for c, turn, role, digest, letter, first, initial in zip(*columns, strict=True):
                if not began or c != at:
                    if began:
                        found.append(closed())
                    began, at, letters = True, c, []
                    low = high = seen = previous = None
                    turns = illegal = blank = duplicate = truncated = 0
                if not letter:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if seen is not None:
                    illegal += seen + initial not in legal
                repeated = letter != MUST_GO and first is not None and (first["turn"] != turn or previous == (turn, role, digest))
                if letter == MUST_GO:
                    blank += 1
                elif repeated:
                    duplicate += 1
                elif letter.isupper():
                    truncated += 1
                letters.append(MUST_GO if repeated else letter)
                seen, previous = initial, (turn, role, digest)
            if found:
                yield table(found)
                found = []
        if began:
            yield table([closed()])

    return streamed(rows).mapInArrow(work, f"conv {conv}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def plans(rows: DataFrame) -> DataFrame:
    """`signatures` of rows (conv, turn, role, text, gone), with cost and audit."""
    found = cut_lineage(signatures(judged(rows)), "conversations")
    ways = cut_lineage(solved(found), "ways").select(F.col("signature").alias("s"), "cost", "audit")
    return found.join(ways, F.col("signature") == F.col("s")).drop("s")


def edited(rows: DataFrame, planned: DataFrame, digests: bool) -> DataFrame:
    """The conversations of `plans`, repaired: (conv, place, edit, role, text) per row, or with `digests` (conv, repaired_sha256) each."""
    kind = rows.schema["conv"].dataType.simpleString()
    text = rows.where("not gone").select("conv", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text", F.lit(1).alias("part"))
    nothing = F.lit(None)
    ahead = planned.select("conv", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("part"))

    def work(batches):
        sha, out = None, []

        def say(edit, role, said):
            nonlocal place, sha
            if digests:
                sha.update(("\n" if place else "").encode() + role.encode() + b":" + said.encode())
            else:
                out.append((at, place, edit, role, said))
            place += 1

        def inserts():
            nonlocal edit, state
            while edit < len(audit) and audit[edit] == "I":
                role, state = NEXT[state]
                say("I", role, "")
                edit += 1

        def table():
            types = [key, pa.string()] if digests else [key, pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["conv", "repaired_sha256"] if digests else ["conv", "place", "edit", "role", "text"]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

        at = place = edit = state = audit = None
        for batch in batches:
            key = batch.column("conv").type
            for conv, role, said, part in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "part")), strict=True):
                if not part:
                    if sha is not None:
                        out.append((at, sha.hexdigest()))
                    at, audit, edit, place, state, sha = conv, said, 0, 0, 0, hashlib.sha256() if digests else None
                    inserts()
                    continue
                way = audit[edit]
                edit += 1
                if way == "K":
                    state = KEPT[state][role[0]]
                    say("K", role, said)
                elif way == "R":
                    role, state = NEXT[state]
                    say("R", role, said)
                inserts()
            if out:
                yield table()
                out = []
        if sha is not None:
            out.append((at, sha.hexdigest()))
            yield table()

    ddl = f"conv {kind}, repaired_sha256 string" if digests else f"conv {kind}, place long, edit string, role string, text string"
    return streamed(ahead.unionByName(text), "part").mapInArrow(work, ddl)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations of rows (conv, turn, role, text, gone), edit K, R or I."""
    return edited(rows, plans(rows), False)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the hash of the repaired rows."""
    planned = cut_lineage(plans(rows), "plans")
    hashes = edited(rows, planned, True).withColumnRenamed("conv", "c")
    return planned.join(hashes.hint("merge"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
