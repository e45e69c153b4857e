"""Edge cases of the training-data operators, and brute-force versions where SQL cannot say them."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosopon.llm import ann, chat, components, decontaminate, langid, mixing, passages, pii, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, found string, score string, n_words string"


def docs_of(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or ""), "r", 7, "f", "s", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties and a repeated row, and columns named like results."""
    words = " ".join(f"w{i % 997}" for i in range(30_000))
    frame = docs_of(spark, ["the cat sat on the mat today", None, "", "  \t\n", words, "the cat sat on the mat today"], ["a", None, "b", "b", "a", None])
    nothing = spark.createDataFrame([(None,) * 10], DOCS)
    return frame.union(nothing).union(frame.where("doc_id = 0"))


def test_simhash_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") + str(rng.randrange(40)) for _ in range(60)) for _ in range(60)]
    texts += [t.replace("a1 ", "b1 ", 1) for t in texts[:30]] + texts[:5] + ["", None, "One", "one", "ÄB c"]

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [fingerprint(t) for t in texts]
    component = list(range(len(texts)))
    for _ in texts:
        component = [min(component[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(texts))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in range(len(texts))}


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3, None}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_survivors(spark):
    """One row per component, also where ids are null or repeated."""
    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (None, d), (9, c), (8, e), (5, e), (2, f), (None, "")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (5, e), (2, f), (None, "")], kept.schema).collect()))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}


def hit_words(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        them = words(t)
        n = min(window, len(them))
        grams = {tuple(them[j : j + n]) for j in range(len(them) - n + 1)} if n else set()
        for p in range(len(own) - n + 1):
            if n and tuple(own[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                found.add(item)
    return len(own), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_decontamination_brute_force(spark, odd, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "d3", "eps"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 13, 5, 1, 40])] + [(9, None), (10, "--"), (None, "zz zz")]
    texts = [" ".join(word() for _ in range(50)) + ", " + (items[i % 5][1] if i % 2 else "") + " tail" for i in range(30)] + [None, "", "zz, ZZ"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.search(docs_of(spark, texts), benchmark, block_bytes=block_bytes).collect()}
    want = {i: hit_words(t, items) for i, t in enumerate(texts)}
    assert got == {i: (n, h, [x for x in f if x != "None"]) for i, (n, h, f) in want.items()}
    kept = decontaminate.decontaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontaminate.search(odd, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.search(odd.limit(0), benchmark).count() == 0


def test_mixing(spark, odd):
    texts = ["x " * (i % 9) for i in range(300)] + [None]
    docs = docs_of(spark, texts, [["a", "b", "c", None][i % 4] if i < 200 else "a" for i in range(301)])
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs, (3.0, 1.0, 2.0)))
    rows = mixed.collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.source_size, r.target])[0] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(taken == int(target) and target <= 2 * size for taken, size, target in by.values())
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * total)
    free = {s: t / w for (s, (_, size, t)), w in zip(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")), (3, 1, 2, 3), strict=True) if t < 2 * size - 1e-9}
    assert max(free.values()) == pytest.approx(min(free.values()))
    written = mixing.write_out(mixed)
    assert sum(len(r.text.split()) for r in written.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(odd, mixing.cyclic_weights(odd, (3.0, 1.0))).count() == odd.count()
    assert mixing.mix(odd.limit(0), mixing.cyclic_weights(odd, (1.0,))).count() == 0


def test_sharding(spark, odd):
    rng = random.Random(5)
    texts = ["t" * rng.randrange(1, 400) + str(i) for i in range(3000)] + ["same text " * 9] * 150 + [None, ""]
    rows = sharding.shard(docs_of(spark, texts), 16).collect()
    loads, slots, owner = [0] * 16, {}, {}
    for r in rows:
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        owner.setdefault(r.text, set()).add(r.shard)
    assert max(loads) < 1.05 * min(loads)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in owner.values())
    hot = sharding.shard(docs_of(spark, ["copy " * 20] * 2000 + texts[:1000]), 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(hot) == 8 and max(r.s for r in hot) < 1.1 * min(r.s for r in hot)
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(odd.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1500 + i, vectors[7].tolist()) for i in range(60)]
    rows += [(None, vectors[3].tolist()), (2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2040, [1.0, 2.0]), (2041, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got[2040] == {1: (2041, 6.0)}
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hit = asked = 0
    for i, v in good:
        if i is None or i % 20:
            continue
        best = sorted(((-(v * w).sum(), j is None, j or 0) for j, w in good if j != i))[:20]
        hit += len({(None if n else j) for _, n, j in best} & {x for x, _ in got[i].values()})
        asked += 20
        scores = [got[i][k] for k in sorted(got[i])]
        assert scores == sorted(scores, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    assert hit / asked >= 0.9
    assert ann.search(frame.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_chat_layouts_and_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\n", "\\l<|", "a\\", "<<SYS>>\n<</SYS>>", "", "é|>", "<|end|>\n"]
    for text in nasty:
        out, spans = chat.render([("user", text), ("as\nk", text), ("assistant", text)])
        assert chat.read_back(out) == [("user", text), ("as\nk", text), ("assistant", text)]
        (a, b), = spans
        assert chat.unescape(out[a:b]) == text and not any(c in out[a:b] for c in chat.CONTROL)
    records = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}],"id":3}', [("user", "hi"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"instruction":"do","input":"it","output":"done"}', [("user", "do\n\nit"), ("assistant", "done")]),
        ('{"system":"s","prompt":"p","completion":"c"}', [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ('{"messages":[]}', []), ('{"other":1}', None), ("[1]", None), ("nope", None), (None, None),
    ]
    frame = spark.createDataFrame([(i, r, "x") for i, (r, _) in enumerate(records)], "i int, record string, mapping string")
    got = {r.i: r.formatted for r in chat.formatted(frame).collect()}
    assert [None if got[i] is None else chat.read_back(got[i]) for i in range(len(records))] == [t for _, t in records]
    assert chat.digests(chat.formatted(frame)).count() == len(records)
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (None, None, "user", "y")], "conv_id long, turn long, role string, text string")
    assert {r.n_turns for r in chat.digests(chat.formatted(chat.records_of(rows))).collect()} == {1, 2}
    assert chat.formatted(chat.records_of(rows.limit(0))).count() == 0


def test_language(spark, odd):
    rng = random.Random(4)
    english, german = "the of and to that with for this".split(), "der die und nicht mit sich auf für".split()
    texts = [" ".join(rng.choice(p) for _ in range(20)) for _ in range(150) for p in (english, german)] + [None, "", "123 ²!", "日本"]
    found = langid.identify(docs_of(spark, texts, langs=["en", "de"] * 150 + ["en", None, "en", None])).collect()
    right = [r.lang_pred == r.lang for r in found if r.doc_id < 300 and r.held_out]
    assert len(right) > 60 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found)
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)][300:303] == ["und"] * 3
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert langid.identify(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    assert toxicity.fold("1d10t сlown, l0ser pathétic $tupid") == toxicity.fold("idiot clown, loser pathetic stupid")
    rng = random.Random(6)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(rng.choices(plain, k=30) + (["m0ron"] if i % 4 == 0 else [])) for i in range(600)] + ["a MORON speaks", None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (600, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    assert all(found[i].predicted == int(i % 4 == 0) for i in range(600)) and found[600].predicted == 1
    assert found[601].predicted == found[602].predicted == 0
    entries = toxicity.Lexicon({"moron ": 5.0}, frozenset({"butter moron"}))
    assert [entries.weight(*(lambda n, ms: (n, [dict(zip(("before", "word", "after", "weight"), m)) for m in ms]))(*entries.matches(entries.automaton(), t))) > 0 for t in ("moron", "butter moron", "morons")] == [True, False, False]
    assert toxicity.score(odd, labels.limit(0), F.lit(True)).count() == odd.count()
    assert toxicity.score(odd.limit(0), labels, F.lit(True)).count() == 0


def test_pseudonyms(spark, odd):
    def feistel(values, moduli, kind, key):
        values, half = list(values), len(values) - len(values) // 2
        for r in range(pii.ROUNDS):
            own = [(i < half) == (r % 2 == 0) for i in range(len(values))]
            other = ",".join(str(x) for x, o in zip(values, own) if not o)
            stream = "".join(hashlib.sha512("|".join([key, kind, str(len(values)), str(r), str(b), other]).encode()).hexdigest() for b in range((len(values) - 1) // 32 + 1))
            values = [(x + int(stream[4 * i : 4 * i + 4], 16)) % m if o else x for i, (x, m, o) in enumerate(zip(values, moduli, own))]
        return values

    text = "card 4111 1111 1111 1111, 4111111111111111! not 4111111111111112; 123-45-6789 10.0.0.255 300.1.1.1 1984-02-29 1985-02-29 a.b@c.org DE89370400440532013000 +1 (743) 555-3824 (743) 555-3824"
    frame = odd.union(docs_of(spark, [text, text]))
    rows = pii.pseudonymised(frame, "k").where("n_replaced > 0").collect()
    assert len(rows) == 2 and rows[0].text == rows[1].text and rows[0].n_replaced == 9
    new = re.sub(r"[ ,;!]+", " ", rows[0].text)
    body = "".join(map(str, feistel([int(c) for c in "411111111111111"], [10] * 15, "card", "k")))
    cards = re.findall(r"\d{16}", rows[0].text.replace(" ", "", 8))
    assert body in rows[0].text and all(c.startswith(body) for c in cards[:1])
    ssn = "".join(map(str, feistel([int(c) for c in "123456789"], [10] * 9, "ssn", "k")))
    assert f"{ssn[:3]}-{ssn[3:5]}-{ssn[5:]}" in new
    assert ".".join(map(str, feistel([10, 0, 0, 255], [256] * 4, "ip", "k"))) in new
    assert all(x in new for x in ("4111111111111112", "300.1.1.1", "1985-02-29", "@c.org"))
    same = pii.pseudonymised(odd, "k")
    assert sorted(same.columns) == sorted([*odd.columns, "n_replaced"]) and same.where("n_replaced <> 0").count() == 0
    assert same.where("text is null").count() == 2 and pii.pseudonymised(odd.limit(0), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    frame = spark.range(1000).select(F.transform(F.split(F.lpad("id", 3, "0"), ""), lambda c: c.cast("int")).alias("v"))
    moved = frame.select(pii.feistel(F.filter("v", lambda x: x.isNotNull()), F.array(*[F.lit(10)] * 3), "t", "k").alias("v"))
    assert moved.distinct().count() == 1000


def test_passages(spark, odd):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(60)]
    near = passage[:30] + ["changed"] + passage[31:]
    long = lambda: [word() for _ in range(120)]
    texts = [
        " ".join(long()) + "\n" + " ".join(passage), " ".join(passage).upper() + "\nshort line", " ".join(near), " ".join([*long(), *passage, *long()]),
        " ".join(long()), None, "", " ".join(passage[:10]),
    ]
    rows = passages.repeated(docs_of(spark, texts)).collect()
    lines = {(r.doc_id, r.words, r.component_id, r.kept) for r in rows if r.kind == "paragraph"}
    assert lines == {(0, 60, 0, True), (1, 60, 0, False), (2, 60, 0, False)}
    assert any(r.doc_id == 3 and r.kind == "passage" and r.component_id == 0 and 120 <= r.first_word and r.first_word + r.words <= 180 for r in rows)
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}
    assert passages.repeated(odd).where("kind = 'paragraph'").count() == 0 and passages.repeated(odd.limit(0)).count() == 0


def grams(words):
    return {tuple(words[i : i + passages.WINDOW]) for i in range(len(words) - passages.WINDOW + 1)}


def test_passages_over_lines(spark):
    """Shared runs of LONG words or more, wrapped anyhow, against brute force; no word of a row lies outside a shared window."""
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    shared = [some(n) for n in [50, 51, 60, 80, 200] * 20] + [["la", "li", "lu"] * 20, ["la"] * 60]
    texts = [None, ""]
    for k, passage in enumerate(shared):
        texts += [wrapped(some(k % 9) + passage + some(k % 7), 3 + k % 20), wrapped(some(k % 40) + passage, 30)]
    rows = passages.repeated(docs_of(spark, texts)).where("kind = 'passage'").collect()
    words = [(t or "").split() for t in texts]
    for i, text in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        common = grams(words[i]) & set().union(*(grams(w) for j, w in enumerate(words) if j != i))
        inside = {p + q for p in range(len(words[i])) if tuple(words[i][p : p + passages.WINDOW]) in common for q in range(passages.WINDOW)}
        found = {p for r in own for p in range(r.first_word, r.first_word + r.words)}
        assert found <= inside
        assert all((text.encode()[r.start : r.end].decode()).split() == words[i][r.first_word : r.first_word + r.words] for r in own)
        run = 0
        for p in range(len(words[i])):
            run = run + 1 if p in inside else 0
            assert run < passages.LONG or found & set(range(p - passages.LONG + 1, p + 1)), (i, p)


def test_passages_of_several_owners(spark):
    """X P Y in documents 10 and 20, P in 3: no shared stretch is marked for removal in its smallest document."""
    rng = random.Random(13)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    sizes = [(60, 60, 60), (40, 20, 80), (50, 30, 50), (100, 200, 100)]
    texts = {}
    for k, (x, p, y) in enumerate(sizes):
        x, p, y = some(x), some(p), some(y)
        texts |= {100 * k + 3: [*some(30), *p, *some(30)], 100 * k + 10: [*some(7), *x, *p, *y], 100 * k + 20: [*x, *p, *y, *some(9)]}
    frame = spark.createDataFrame([(i, "\n".join([" ".join(w[:90]), " ".join(w[90:])])) for i, w in texts.items()], "doc_id long, text string")
    rows = passages.repeated(frame).where("kind = 'passage'").collect()
    assert all(r.kept == (r.doc_id == r.component_id) and r.words > 0 for r in rows)
    owners = {r.doc_id % 100: {s.component_id % 100 for s in rows if s.doc_id % 100 == r.doc_id % 100} for r in rows}
    assert owners == {3: {3}, 10: {3, 10}, 20: {3, 10}}
    covered = {(i, kept): {p for r in rows if (r.doc_id, r.kept) == (i, kept) for p in range(r.first_word, r.first_word + r.words)} for i in texts for kept in (True, False)}
    for i, words in texts.items():
        assert not covered[i, True] & covered[i, False]
        text = "\n".join([" ".join(words[:90]), " ".join(words[90:])])
        assert all(text[r.start : r.end].split() == words[r.first_word : r.first_word + r.words] for r in rows if r.doc_id == i)
    for k, (x, p, y) in enumerate(sizes):
        first, second, third = ({kept: covered[100 * k + i, kept] for kept in (True, False)} for i in (3, 10, 20))
        alone = {*range(7, 7 + x), *range(7 + x + p, 7 + x + p + y)}
        assert first[True] and not first[False] and not third[True]
        assert second[True] & set(range(7, 7 + x)) and second[True] & set(range(7 + x + p, 7 + x + p + y)) and not second[False] & alone


def test_rare_languages_are_learned(spark):
    """Every language of the learnable rows is in the model and learned from, however small its share of the rows."""
    rng = random.Random(4)
    said = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(20))
    rows = [("xx", "abcdefgh")] * 1500 + [("yy", "ijklmnop")] * 1500 + [("el", "αβγδεζηθ")] * 30 + [(f"z{k}", chr(0x400 + k) + chr(0x500 + k)) for k in range(8)]
    frame = spark.createDataFrame([(i, said(letters), lang) for i, (lang, letters) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(frame, F.lit(True), sample_rows=40)
    assert model.languages == sorted({lang for lang, _ in rows})
    assert all((model.weights[:-1, k] > 0).any() for k in range(len(model.languages)))
    assert [model.predict(said(letters))[0] for letters in ("abcdefgh", "ijklmnop", "αβγδεζηθ")] == ["xx", "yy", "el"]
