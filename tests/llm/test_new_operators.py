"""Quality, conversation repair and tokenizer alignment against brute-force versions and odd rows."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosopon.llm import alignment, langid, quality, repair

SPACES = " \t\n\x0b\x0c\r"


# Quality


def clean(rng):
    return ". ".join(" ".join(rng.choice(["tree", "house", "river", "old", "stands", "near", "a", "the"]) for _ in range(8)).capitalize() for _ in range(6)) + "."


def junk(rng):
    kind = rng.randrange(3)
    words = [rng.choice(["tree", "house", "river", "old"]) for _ in range(40)]
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(w + "$$$" for w in words)


@pytest.fixture(scope="module")
def judged_texts():
    rng = random.Random(4)
    truth = [int(rng.random() < 0.8) for _ in range(1500)]
    return [(i, clean(rng) if t else junk(rng), "x", 7) for i, t in enumerate(truth)], truth


def test_quality_from_positives_alone(spark, judged_texts):
    rows, truth = judged_texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, features int")
    part = langid.fold(F.col("doc_id"), 4)
    positives = spark.createDataFrame([(i, 1) for i, t in enumerate(truth) if t and i % 2], "doc_id long, quality int")
    everything = positives.union(spark.createDataFrame([(i, 0) for i, t in enumerate(truth) if not t], positives.schema))
    found = {r.doc_id: r for r in quality.score(docs, positives, part == 2).collect()}
    held = [i for i in found if found[i].held_out]
    assert set(held) == {i for i in range(len(truth)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    everything = everything.union(spark.createDataFrame([(i, 1) for i in held], positives.schema))
    same = {r.doc_id: r.score for r in quality.score(docs, everything, part == 2).collect()}
    assert all(abs(same[i] - found[i].score) < 1e-6 for i in found), "neither labels of 0 nor held-out ones are learned from"


def test_quality_risk_and_prior(spark, judged_texts):
    """The sums over tasks equal the risks worked out in one place, and the prior is near the truth."""
    rows, truth = judged_texts
    x = np.array([quality.features(t.encode()) for _, t, _, _ in rows], np.float64)
    frame = spark.createDataFrame([(v.tolist(), bool(t and i % 2), i % 5) for i, (v, t) in enumerate(zip(x, truth, strict=True))], "features array<float>, positive boolean, fold int")
    frame = frame.union(frame.where("positive").selectExpr("features", "false", "fold")).repartition(7)
    own = np.array([t and i % 2 for i, t in enumerate(truth)], bool)
    u, p = np.concatenate([x[~own], x[own]]), x[own]
    mean, deviation, counts = quality.spread(frame)
    assert counts.tolist() == [len(u), len(p)] and np.allclose(mean[:-1], u.mean(0)[:-1], atol=1e-4)
    w = np.random.default_rng(3).normal(size=quality.FEATURES) * 0.1
    value, gradient, curvature = quality.non_negative(0.8, counts)(quality.sums(frame, w, mean, deviation))
    z = lambda rows: ((rows - mean) / deviation) @ w
    loss = lambda v: np.logaddexp(0, -v).mean()
    rest = loss(-z(u)) - 0.8 * loss(-z(p))
    assert value == pytest.approx(0.8 * loss(z(p)) + max(0, rest), rel=1e-4)
    negative = quality.non_negative(0.99, counts)(quality.sums(frame, w + np.eye(quality.FEATURES)[-1] * 20, mean, deviation))
    assert negative[0] >= 0
    model = quality.learn(frame)
    assert abs(model["prior"] - np.mean(truth)) < 0.08


def test_quality_odd_rows(spark):
    rows = [(None, "a b."), (1, None), (2, ""), (3, " \n"), (4, "word " * 50_000), (5, "x"), (5, "x"), (6, "Ein Satz.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, quality int")
    never = F.lit(False)
    assert quality.score(docs, labels, never).count() == len(rows)
    assert {r.score for r in quality.score(docs, labels.limit(0), never).collect()} == {0.0}
    assert quality.score(docs.limit(0), labels, never).count() == 0


# Conversations


def damage(rows):
    """Rows (conv, turn, role, text) as the contract damages them, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def cheapest(rows, faults):
    """(cost, audit, repaired) by trying every edit in every state, longest first, without sharing."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {}

    def go(at, last, run):
        key = at, last, run
        if key not in best:
            ways = [(0, "", ())] if at == len(rows) and last in ("", "a") else []
            if run < 3:
                for c in follow[last].replace("s", ""):
                    cost, audit, out = go(at, c, run + 1)
                    ways.append((cost + 3, "I" + audit, (name[c] + ":", *out)))
            if at < len(rows):
                _, role, text = rows[at]
                cost, audit, out = go(at + 1, last, 0)
                ways.append((cost + 4, "D" + audit, out))
                if faults[at] not in ("blank", "duplicate"):
                    more = 3 * (faults[at] == "truncated")
                    if role[:1] and role[0] in follow[last]:
                        cost, audit, out = go(at + 1, role[0], 0)
                        ways.append((cost + more, "K" + audit, (f"{role}:{text}", *out)))
                    for c in follow[last].replace("s", ""):
                        cost, audit, out = go(at + 1, c, 0)
                        ways.append((cost + more + 3, "R" + audit, (f"{name[c]}:{text}", *out)))
            best[key] = min(ways) if ways else (10**9, "", ())
        return best[key]

    return go(0, "", 0)


def repaired_by_hand(rows):
    rows = damage(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, out = cheapest(rows, faults)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            said = rng.choice(["Yes.", "No!", "Why?", "well", "", None, " \t", "Yes. ", "a\nb."]) if rng.random() < 0.5 else f"It is {rng.randrange(9)}."
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), said))
    return rows


def test_repair_brute_force(spark):
    rng = random.Random(8)
    rows = conversations(rng, 400) + [(None, t, r, f"{t}.") for t, r in enumerate(["system", "user", "assistant"])]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    found = {r.conv: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.repair(repair.damaged(frame)).collect()}
    assert found == {conv: repaired_by_hand(own) for conv, own in by.items()}


def test_repair_shares_suffixes(spark):
    """Each different suffix is one node, and the repaired rows obey the grammar."""
    words = ["uaua", "sua", "xua", "ua", "Uaxu", "o" * 3000 + "ua"]
    frame = spark.createDataFrame([(w,) for w in words * 3], "signature string")
    ways = repair.solved(frame).collect()
    assert sorted(w.signature for w in ways) == sorted(words)
    assert sum(w.nodes for w in ways) >= len({w[k:] for w in words for k in range(len(w))})
    rows = repair.damaged(spark.createDataFrame(conversations(random.Random(2), 60), "conv_id long, turn long, role string, text string"))
    out = {}
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (r.conv, r.place)):
        out.setdefault(r.conv, []).append(r)
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own)) and [r.place for r in own] == list(range(len(own))) for own in out.values())


def test_repair_one_long_conversation(spark):
    """A conversation of many rows, most of them repeated, streams through."""
    rows = [(1, t, "user" if t % 2 else "assistant", "Again." if t % 3 else f"{t}.") for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    (found,) = repair.repair(repair.damaged(frame)).collect()
    after = damage(rows)
    assert found.duplicate + found.blank + found.truncated <= len(after) and len(found.audit.replace("I", "")) == len(after)
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0
    gone = spark.createDataFrame([(0, t, "user", "x.") for t in range(400) if zlib.crc32(f"0:{t}".encode()) % 20 == 0], frame.schema)
    (found,) = repair.repair(repair.damaged(gone)).collect()
    assert found.audit == "" and found.cost == found.gaps == found.illegal == 0 and found.repaired_sha256 == hashlib.sha256(b"").hexdigest()


# Tokenizers


def test_byte_bpe_is_the_file(spark):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    whole = Tokenizer.from_file(alignment.BYTE_BPE)
    whole.encode_special_tokens = True
    with open(alignment.BYTE_BPE, "rb") as f:
        model = alignment.ByteBPE(f.read())
    letters = [chr(c) for c in (*range(1, 0x500), 0x2581, 0x3042, 0x1F600, 0xFEFF, 0x85, 0xA0)]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice([" ", "\n", "the", "<|endoftext|>", "'s", "19"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["x" * 5000, " " * 5000 + "a", "ab" * 3000 + " c"]
    assert all(list(model.encode(t)) == whole.encode(t, add_special_tokens=False).ids for t in texts)
    assert all(b"".join(model.bytes[i] for i in model.encode(t)) == t.encode() for t in texts)


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(alignment.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    whole.encode_special_tokens = True
    with open(alignment.BYTE_BPE) as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    letters = alignment.byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in names[i])
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        one, other, want = [a_bytes(i) for i in a], [b_bytes(i) for i in b], f" {t or ''}".encode()
        if not t or b"".join(one) != want or b"".join(other) != want:
            found.append(None)
            continue
        ends, stops = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (one, other))
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ends[i] - len(one[i]), stops[j] - len(other[j])) < min(ends[i], stops[j])]
        groups, p, q = [], 0, 0
        for e in sorted(set(ends) & set(stops)):
            i, j = ends.index(e) + 1, stops.index(e) + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        found.append((len(a), len(b), groups, links))
    held = [p for f in found if f for p in set(f[3])]
    count = {p: held.count(p) for p in set(held)}
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]


@pytest.mark.parametrize("held", [alignment.PAIRS, 40])
def test_alignment_brute_force(spark, held):
    rng = random.Random(5)
    words = ["the", "The", "naïve", "日本語", "</s>", "<|endoftext|>", "<0x41>", "tab\t", "  ", "\n\n", "résumé", "x1234", "🙂", "don't", "U+", "​", "ﬁ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [None, "", " ", "  a", "▁a", "a▁ b", "same text", "same text", "word " * 30, "z" * 300]
    frame = spark.createDataFrame([(None if i == 3 else i % 50, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(4)
    rows = alignment.align(frame, held=held).collect()
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    want = aligned_by_hand(texts)
    assert want[texts.index("▁a")][0] == 0 and want[texts.index("  a")][0] > 0
    assert got == sorted((str(None if i == 3 else i % 50), *w) for i, w in enumerate(want))


def test_alignment_odd_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.n_a, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(frame).collect()} == {(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, "")}
    assert alignment.align(frame.limit(0)).count() == 0
    (row,) = alignment.align(spark.createDataFrame([(1, "The old house. " * 60_000)], frame.schema)).collect()
    assert row.n_a > 200_000 and row.n_links >= row.n_groups > 100_000


def test_equal_hashes_are_compared(monkeypatch):
    """Windows whose hashes collide are told apart by their ids."""
    with open(alignment.BYTE_BPE, "rb") as f, open(alignment.PIECE_BPE, "rb") as g:
        a_model, b_model = alignment.ByteBPE(f.read()), alignment.PieceBPE(g.read())
    one, other = alignment.Side(a_model.bytes), alignment.Side(b_model.bytes)
    texts = ["the old house and the old tree", "an old house", ""]
    args = [a_model.encode(" " + t) if t else [] for t in texts], b_model.encode(texts), [f" {t}".encode() if t else b"" for t in texts], one, other, alignment.Spelled(one, other)
    want = [x.tolist() if hasattr(x, "tolist") else x for x in alignment.documents(*args)]
    monkeypatch.setattr(alignment, "hashes", lambda ids, starts, sizes, side: np.zeros(len(starts), np.uint64))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in alignment.documents(*args)] == want
