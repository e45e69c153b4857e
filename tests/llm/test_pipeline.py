"""Every stage of the corpus pipeline against plain Python, with nulls, repeated rows and ties; learned models against plain loops."""

import math
import random
import re
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from prosopon.llm import decontaminate, langid, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def sentence(rng, lang, n):
    pool = {"en": ["the", "with", "water", "house", "this", "thing"], "de": ["und", "schön", "straße", "über", "nicht", "zwölf"], "fr": ["être", "où", "quelque", "français", "garçon", "déjà"]}[lang]
    return " ".join(rng.choice(pool) + (str(rng.randrange(60)) if rng.random() < 0.3 else "") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    place = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, sentence(rng, ("en", "de", "fr")[i % 3], rng.randrange(25, 60)), ("en", "de", "fr")[i % 3], ("a", "b", None)[i % 5 % 3], 0) for i in range(150)]
    rows += [(i + 200, rows[i][1], rows[i][2], "c", 0) for i in range(20)] + rows[:5]
    rows += [(300 + i, sentence(rng, "en", 40) + " " + " ".join(item.split()[i : i + 13 + i]), "en", "a", 0) for i in range(10)]
    rows += [(None, sentence(rng, "de", 40), "de", "a", None), (None, sentence(rng, "fr", 40), None, None, None), (None, None, None, None, None), (400, "", "en", "a", 0), (401, "12 34 !", None, "b", 5)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def stage(spark, name, docs, folder):
    out = STAGES[name](spark, docs, folder)
    return out, sorted(map(tuple, out.collect()), key=repr)


def plain(docs):
    return [tuple(r) for r in docs.collect()]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, rows = stage(spark, "language ID", docs, folder)
    assert out.columns == docs.columns
    lettered = [r for r in plain(docs) if langid.has_letter(r[1])]
    assert set(rows) <= set(lettered) and len(rows) >= 0.98 * len(lettered)
    model = langid.train(docs, langid.fold(F.col("doc_id"), 3) != 1)
    want = [r for r in lettered if model.predict(r[1])[1] >= corpus_pipeline.LEAST_SCORE]
    assert rows == sorted(want, key=repr)


def test_near_duplicate_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, rows = stage(spark, "near duplicates", docs, folder)
    assert out.columns == docs.columns
    all_rows = plain(docs)
    prints = [fingerprint(r[1]) for r in all_rows]
    group = list(range(len(all_rows)))
    for _ in range(10):
        group = [min(group[j] for j in range(len(group)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(group))]
    groups = {}
    for g, r in zip(group, all_rows, strict=True):
        groups.setdefault(g, []).append(r)
    assert len(rows) == len(groups)
    for members in groups.values():
        lowest = min((r[0] for r in members if r[0] is not None), default=None)
        (kept,) = [r for r in rows if r in members]
        assert kept[0] == lowest


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, rows = stage(spark, "decontamination", docs, folder)
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        own, hit = words_of(text), set()
        for gram in grams:
            for p in range(len(own) - len(gram) + 1):
                if tuple(own[p : p + len(gram)]) == gram:
                    hit |= set(range(p, p + len(gram)))
        return bool(hit) and 20 * len(hit) >= len(own)

    want = [r for r in plain(docs) if not contaminated(r[1])]
    assert out.columns == docs.columns and rows == sorted(want, key=repr) and len(want) < docs.count()


def test_mixing_and_sharding_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, rows = stage(spark, "mixing", docs, folder)
    assert out.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for r in plain(docs):
        sources[r[3]] = sources.get(r[3], 0) + size(r[1])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(sources.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sources[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sources[s]
            left -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    for s in order:
        assert sum(size(r[1]) for r in rows if r[3] == s) == math.floor(target[s] + 1e-9)
    shards, placed = stage(spark, "sharding", out, folder)
    assert len(placed) == len(rows) and {"shard", "slot", "size", "text_crc32"} <= set(shards.columns)
    slots = {}
    for r in shards.collect():
        slots.setdefault(r.shard, []).append((r.slot, r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    bytes_ = [sum(b for _, b in x) for x in slots.values()]
    assert max(bytes_) <= 2.5 * sum(bytes_) / 16


def test_run_goes_through_all_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, work in corpus_pipeline.STAGES[:3]:
        docs = work(spark, docs, folder)
    assert {r.text for r in found.select("text").collect()} - {None} and found.where("text is null").count() == 0
    total = docs.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert found.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] <= 1.5 * total + 1


# Models


def test_ftrl_and_features_by_plain_loops():
    rng = random.Random(4)
    texts = [(sentence(rng, lang, 6), i) for i, lang in enumerate(("en", "de", "fr")) for _ in range(8)]
    bits = 6

    def features(text):
        line = re.sub(r"[\x00-`{-\x7f]+", " ", f" {text.lower()} ")
        seen = {}
        for n in langid.LENGTHS:
            for i in range(len(line) - n + 1):
                code = n
                for k in range(n):
                    code = ((code ^ ord(line[i + k])) * langid.MULTIPLIERS[k]) & 0xFFFFFFFF
                seen[code >> (32 - bits)] = seen.get(code >> (32 - bits), 0) + 1
        return dict(sorted(seen.items()))

    for text, _ in texts:
        at, counts = langid.frequencies(text, bits)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == features(text)
    rows = [(np.array(list(f)), np.array(list(f.values()), float) / 50, y) for f, y in ((features(t), y) for t, y in texts)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(i, c):
        v = z.get((i, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            at, x, y = [*rows[r][0].tolist(), 1 << bits], [*rows[r][1].tolist(), 1.0], rows[r][2]
            scores = [sum(weight(i, c) * v for i, v in zip(at, x, strict=True)) for c in range(3)]
            total = sum(math.exp(s) for s in scores)
            steps = {}
            for c in range(3):
                for i, v in zip(at, x, strict=True):
                    g = v * (math.exp(scores[c]) / total - (c == y))
                    more = math.sqrt(n.get((i, c), 0.0) + g * g) - math.sqrt(n.get((i, c), 0.0))
                    steps[i, c] = (g - more / alpha * weight(i, c), g * g)
            for key, (dz, dn) in steps.items():
                z[key], n[key] = z.get(key, 0.0) + dz, n.get(key, 0.0) + dn
    got = langid.ftrl(rows, 1 << bits, 3)
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range((1 << bits) + 1)], atol=1e-9)


def test_toxicity_by_plain_loops(spark):
    """Counts, likelihood ratios, weights and matches, entry by entry and word by word; and any number of blocks gives the same."""
    rng = random.Random(6)
    kind = ["tree", "house", "river", "stone", "fellow", "night"]
    texts = [" ".join(rng.choices(kind, k=12)) for _ in range(300)]
    truth = [int(rng.random() < 0.3) for _ in texts]
    bad = ["1d10t", "Idiôt", "scumbag", "SCUMBAGS", "vermin"]
    texts = [t + (f" {rng.choice(bad)} {rng.choice(kind)}" if y else "") for t, y in zip(texts, truth, strict=True)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(truth)), "doc_id long, toxic int")
    lexicon = toxicity.learn_entries(docs, labels)
    a, b, positive = {}, {}, sum(truth)
    negative = len(truth) - positive
    for t, y in zip(texts, truth, strict=False):
        for e in {e for w in toxicity.words_of(toxicity.fold(t)) for e in toxicity.entries_of(w)}:
            (a if y else b)[e] = (a if y else b).get(e, 0) + 1
    tried = [e for e in a if a[e] >= toxicity.LEAST_TEXTS]

    def ratio(x, y):
        total, both = positive + negative, x + y
        part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
        g = part(x, both * positive / total) + part(y, both * negative / total) + part(positive - x, (total - both) * positive / total) + part(negative - y, (total - both) * negative / total)
        return 2 * g if x * negative > y * positive else -2 * g

    bar = 2 * math.log(max(1, len(tried))) + toxicity.MARGIN
    want = {}
    for e in tried:
        x, y = a[e], b.get(e, 0)
        if ratio(x, y) >= bar and x >= toxicity.PRECISION * (x + y):
            doubt = math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
            want[e] = math.log((x + 0.5) / (positive - x + 0.5)) - math.log((y + 0.5) / (negative - y + 0.5)) - 1.64 * doubt
    assert want and lexicon.weights.keys() == want.keys() and all(lexicon.weights[e] == pytest.approx(want[e]) for e in want)

    def by_hand(text):
        words = ["", *toxicity.words_of(toxicity.fold(text)), ""]
        found = [(words[i - 1], w, words[i + 1], max(want[e] for e in toxicity.entries_of(w) if e in want)) for i, w in enumerate(words) if w and any(e in want for e in toxicity.entries_of(w))]
        return len(words) - 2, sorted(found)

    for block in (toxicity.BLOCK, 1):
        got = {r.doc_id: (r.n_words, sorted((m.before, m.word, m.after, pytest.approx(m.weight)) for m in r.matches)) for r in toxicity.match(docs, lexicon, block=block).collect()}
        assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert len(lexicon.blocks(1)) > 1 and sum(len(x.weights) for x in lexicon.blocks(1)) == len(want)


def test_models_travel_without_the_package(tmp_path):
    """A worker that lacks the package can use what is broadcast."""
    model = langid.Model(["en"], np.zeros(((1 << langid.BITS) + 1, 1)), np.ones(1 << langid.BITS))
    lexicon = toxicity.Lexicon({"abcd": 1.0})
    (tmp_path / "sent").write_bytes(cloudpickle.dumps((model, lexicon)))
    code = "import sys, pickle; assert not any('repo' in p for p in sys.path); m, x = pickle.load(open('sent', 'rb')); print(m.predict('hello'), x.matches(x.automaton(), 'abcdef')[0])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "('en', 1.0) 1", done.stderr


def test_repetitive_texts_do_not_multiply(spark):
    """A text of one repeated word against items of the same word: a row per place at most, whatever the item's length."""
    tests = decontaminate.Suffixes([("a", b"w " * 112), ("b", b"w " * 500 + b"end"), ("c", b"x")], 13)
    assert len(tests.item) <= 2 + 14 + 1
    docs = spark.createDataFrame([(1, "w " * 600_000), (2, "y " + "w " * 13 + "end"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w " * 112), (2, "w " * 500 + "end"), (3, "x")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.search(docs, items).collect()}
    assert got == {1: (600_000, 600_000, ["1", "2"]), 2: (15, 14, ["1", "2"]), 3: (1, 1, ["3"])}


def test_repeated_vectors_find_each_other(spark):
    from prosopon.llm import ann

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(0, None)]
    rows += [rows[0], rows[0], rows[40], (7, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, F.col("id") % 20 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[0]) == sorted([(1, 0), (2, 0), (3, 7)] * 3)
    assert sorted(got[40])[0:2] == [(1, 40), (1, 40)]
