"""Listing, ordering, joins, versioning, sinks and geometry."""

import json
import math

import pytest
from pyspark.sql import functions as F

from prosopon.functions import nationality
from prosopon.operators import enrich, listing, ordering, portraits, versioning
from prosopon.plans.synth import PROFILE
from prosopon.sinks import exports
from prosopon.sources import keyvalue, schemas


def test_runs_and_positions_with_a_hot_key(spark):
    """A third of all rows share one key; the result is that of a single ordered pass."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{(i * 7) % 11 // 4}", (i * 37) % 101) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, key string, v int").repartition(5)
    got = ordering.with_runs(df, [F.col("v").desc(), F.col("i")], "key").orderBy("position").collect()
    want, run, previous = [], 0, None
    for position, (i, key, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        run += key != previous
        want.append((position, i, run, key == previous))
        previous = key
    assert [(r.position, r.i, r.run, r.continuation) for r in got] == want
    positions = ordering.with_position(df, [F.col("key"), F.col("i")]).orderBy("position").collect()
    assert [(r.key, r.i) for r in positions] == sorted((r[1], r[0]) for r in rows)
    assert [r.position for r in positions] == list(range(1, 901))


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, n int, v string")
    assert {(r.id, r.v, r.copies) for r in ordering.keep_last(df, "id", "n").collect()} == {("a", "z", 3), ("b", "q", 1)}


@pytest.mark.parametrize("limit", [0, -1, 1.5, True, None])
def test_limit_is_checked(spark, limit):
    with pytest.raises(ValueError):
        ordering.limit_rows(spark.range(3), [F.col("id")], limit)


@pytest.fixture(scope="module")
def people(spark):
    data = [
        ("p1", "Ana", "Zé", None, None, "Kenyan", [("first", "Director", "Sea Office", "SO", 1990, 1995), (None, "Head-Clerk", "Air Office", None, 2000, 2001)]),
        ("p2", "Bo", "Ålund", "Bo", None, "", []),
        ("p3", "Cy", "M’Bow", None, "Roy", None, [(None, "Envoy", None, "UN", None, 1980)]),
    ]
    return spark.createDataFrame(
        data, f"doc_id string, first_name string, last_name string, known_as string, nee string, nationality string, roles array<{schemas.ROLE}>"
    )


def test_listing(people):
    rows = listing.query_listing(people).collect()
    assert [(r.name, r.role_index) for r in rows] == [("ÅLUND Bo", -1), ("M’BOW Cy (née Roy)", 0), ("ZÉ Ana", 0), ("ZÉ Ana", 1)]
    assert [(r.organisation, r.years, r.nationality) for r in rows] == [
        ("", "", "Unspecified"), ("UN", "–1980", "Unspecified"), ("Sea Office (SO)", "1990–1995", "Kenyan"), ("Air Office", "2000–2001", "Kenyan"),
    ]
    assert [r.slug for r in listing.query_listing(people, q="mbow").collect()] == ["p3"]
    assert [r.slug for r in listing.query_listing(people, q="zzz").collect()] == []
    assert [r.slug for r in listing.query_listing(people, q="office", sort="year:desc").collect()] == ["p1", "p1"]
    assert [(r.slug, r.role) for r in listing.query_listing(people, sort="organisation:asc", view="grid").collect()] == [("p2", ""), ("p1", "Head-Clerk"), ("p3", "Envoy")]
    flat = listing.listing(people)
    assert {(r.slug, r.role) for r in listing.first_rows(flat, "organisation", True).collect()} == {("p2", ""), ("p1", "Director"), ("p3", "Envoy")}
    for bad in ({"view": "tiles"}, {"sort": "age:asc"}):
        with pytest.raises(ValueError):
            listing.query_listing(people, **bad)


def test_batch_search(people):
    queries = ["z", "lund", "bow", "q", "m"]
    assert listing.batch_search(people, "doc_id", "last_name", queries, 2).count() == 4


def test_batch_search_beyond_a_thousand(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("s"))
    got = listing.batch_search(rows, "id", "s", ["word", "4999"], 2000).collect()
    assert sorted((r.place, r.id) for r in got if r.query == "word") == [(i + 1, i) for i in range(2000)]
    assert [(r.place, r.s) for r in got if r.query == "4999"] == [(1, "word 4999")]


def test_earliest_mention_matches_brute_force(spark):
    texts = ["the German and Germany", "Dutch Germanic", "none", "", "xGer man", "Éa Ger Ge"]
    words = ["German", "Germany", "Dutch", "Ger", "man", "Ge", "Ger"]
    got = enrich.earliest_mention(
        spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", "s", spark.createDataFrame(list(enumerate(words)), "ordinal int, term string")
    )
    want = {}
    for i, s in enumerate(texts):
        hits = [(s.index(w), -len(w), n, w) for n, w in enumerate(words) if w in s]
        if hits:
            want[i] = (min(hits)[3], min(hits)[0] + 1)
    assert {r.id: (r.term, r["at"]) for r in got.collect()} == want
    empty = spark.createDataFrame([], "ordinal int, term string")
    assert enrich.earliest_mention(spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), "id", "s", empty).count() == 0


def test_a_dictionary_table_gives_what_a_list_gives(spark):
    texts = ["the German and Germany", "Dutch Germanic", "none", None, "xGer man Dutch", "Éa Ger Ge", "", "🙂German", "a\nGerm\nGermany"]
    words = ["German", "Germany", "Dutch", "Ger", "man", "Ge", "Ger", "É", "🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    forms = [(w, w.upper()) for w in words]
    demonyms = spark.createDataFrame([(i, w.upper(), "f", w, True) for i, w in enumerate(words)] + [(99, "X", "f", "none", False), (98, "Y", "m", "", True), (97, "Z", "m", None, True)], schemas.DEMONYMS)
    by_list = sorted(enrich.nationalities(docs, "id", "s", forms).collect())
    assert by_list == sorted(enrich.nationalities_by_join(docs, "id", "s", demonyms).collect()) and by_list[0].country == "GERMAN"
    assert {r.nationality for r in enrich.nationalities_by_join(docs, "id", "s", demonyms.limit(0)).collect()} == {None}


def test_terms_that_begin_alike(spark):
    """Many terms below one beginning, short and long ones, against a search for each."""
    import random

    rng = random.Random(3)
    words = sorted({"ab" * rng.randrange(1, 4) + "".join(rng.choices("abc ", k=rng.randrange(0, 9))) for _ in range(300)})
    texts = ["".join(rng.choices("abc ", k=rng.randrange(0, 60))) for _ in range(80)]
    got = enrich.earliest_mention(spark.createDataFrame(list(enumerate(texts)), "id int, s string"), "id", "s", spark.createDataFrame(list(enumerate(words)), "ordinal int, term string"))
    want = {i: min((s.index(w), -len(w), n, w) for n, w in enumerate(words) if w in s) for i, s in enumerate(texts) if any(w in s for w in words)}
    assert {r.id: (r["at"] - 1, -len(r.term), r.ordinal, r.term) for r in got.collect()} == want


def tree_by_hand(files, fanout):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    levels = [[sha(f"{p}\0{c}\0") for p, c in sorted(files)]]
    while len(levels) == 1 or len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return {(n, i): d for n, level in enumerate(levels) for i, d in enumerate(level)}


def test_fingerprint_tree(spark):
    """Equals the definition, depends on the order of paths, and one changed file changes one node of each level."""
    groups = {"a": [(f"p{i:03}", f"text {i}") for i in range(30)], "b": [("x", "y")], None: [("q", ""), ("r", "s")]}

    def tree(contents):
        rows = [(g, p, c) for g, files in contents.items() for p, c in files]
        return versioning.fingerprint_tree(spark.createDataFrame(rows, "g string, path string, content string").repartition(3), ["g"], F.col("path"), F.col("content"), fanout=3)

    before = tree(groups)
    got = {}
    for r in before.collect():
        got.setdefault(r.g, {})[r.level, r.node] = r.digest
    assert got == {g: tree_by_hand(files, 3) for g, files in groups.items()}
    edited = groups | {"a": [(p, c + "!" if p == "p011" else c) for p, c in groups["a"]]}
    assert sorted(map(tuple, versioning.changed_nodes(before, tree(edited), ["g"]).collect())) == [("a", 0, 11), ("a", 1, 3), ("a", 2, 1), ("a", 3, 0), ("a", 4, 0)]
    swapped = groups | {"a": [(p, dict(groups["a"])[{"p001": "p002", "p002": "p001"}.get(p, p)]) for p, _ in groups["a"]]}
    roots = [{r.g: r.fingerprint for r in versioning.ordered_fingerprint(t, ["g"]).collect()} for t in (before, tree(swapped))]
    assert roots[0]["a"] != roots[1]["a"] and roots[0]["b"] == roots[1]["b"]
    assert versioning.fingerprint_tree(spark.createDataFrame([], "path string, content string"), [], F.col("path"), F.col("content")).count() == 0


def test_nth_row_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", (i * 7919) % 5000, 100 if i % 3 else 1) for i in range(5000)]
    got = ordering.nth_per_key(spark.createDataFrame(rows, "k string, v int, wanted int"), "k", [F.col("v")], "wanted").collect()
    hot = sorted(v for k, v, _ in rows if k == "hot")
    assert {r.k: r.v for r in got} == {"hot": hot[99]} | {k: v for k, v, _ in rows if k != "hot"}


def test_many_equal_headings(spark):
    from prosopon.sources import corpus

    html = "".join("<h2>Same</h2>" for _ in range(1600)) + "<h2>Same 1</h2><h2>Same</h2>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    found = [r.anchor for r in corpus.heading_anchors(corpus.from_html(pages, "page_id", "html", 2)).orderBy("idx").collect()]
    assert found == ["same", *(f"same-{i}" for i in range(1, 1600)), "same-1-1", "same-1600"]


def test_sandbox_never_reaches_production(spark):
    entries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string")
    ids = spark.createDataFrame(
        [("a", "10.5072/v", "10.1/c", None), ("b", "10.1/v", None, "production"), ("c", "10.1/v", "10.1/c", "sandbox")],
        "slug string, version_doi string, concept_doi string, env string",
    )
    records = spark.createDataFrame([("a", 7, 8), ("d", 9, None)], "slug string, record_id bigint, concept_rec_id bigint")
    out = {r.slug: r for r in enrich.with_identifiers(entries, ids, records, "production", PROFILE).collect()}
    assert out["a"].version_doi is None and out["a"].cite_url == PROFILE.sandbox_record_base + "8" and out["a"].cite_sandbox
    assert out["b"].cite_url == "https://doi.org/10.1/v" and not out["b"].cite_sandbox
    assert out["c"].cite_url is None and out["d"].cite_url.endswith("/9")
    with pytest.raises(PermissionError):
        versioning.check_environment("production", False)


def test_plan_is_idempotent_after_merge(spark):
    feed = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "slug string, content_hash string")
    state = spark.createDataFrame([], schemas.STATE)
    plan = versioning.version_plan(feed, state, PROFILE)
    assert versioning.tally(plan).first().asDict() == {"create": 3, "newversion": 0, "skip": 0}
    outcomes = plan.select(
        "slug", (F.col("slug") != "c").alias("ok"), F.lit(1).cast("long").alias("record_id"), F.lit(1).cast("long").alias("concept_rec_id"),
        F.lit("10.1/c").alias("concept_doi"), F.lit("10.1/v").alias("version_doi"), F.col("state_hash").alias("content_hash"),
        F.lit("1").alias("version"), F.current_timestamp().alias("minted_at"), F.lit(None).cast("string").alias("error"),
    )
    merged = versioning.merge_outcomes(state, outcomes, "sandbox")
    again = {r.slug: r.action for r in versioning.version_plan(feed, merged, PROFILE).collect()}
    assert again == {"a": "skip", "b": "skip", "c": "create"}
    assert versioning.outcome_totals(outcomes).first().exit_status == 1
    assert versioning.version_plan(feed, merged, PROFILE, only=["a", "zz"]).count() == 1
    assert [r.slug for r in versioning.not_found(feed, ["a", "zz", "zz"]).collect()] == ["zz"]
    assert versioning.not_found(feed, []).count() == 0
    assert [r.slug for r in versioning.version_plan(feed, merged, PROFILE, limit=2).orderBy("slug").collect()] == ["a", "b"]


def test_set_fingerprint_ignores_row_order(spark):
    rows = [("g", f"f{i}", "x" * i) for i in range(50)]
    def run(r):
        df = spark.createDataFrame(r, "g string, path string, content string").repartition(7)
        return versioning.set_fingerprint(df, ["g"], F.col("path"), F.col("content")).first().fingerprint
    assert run(rows) == run(rows[::-1]) != run(rows[:-1] + [("g", "f49", "y")])


def test_feed_and_csv_and_state_sinks(spark, tmp_path):
    feed = spark.createDataFrame([("b", "h", "Ö"), ("a", "h", 'x "q"')], "slug string, content_hash string, summary string")
    exports.write_feed(feed, str(tmp_path / "feed"))
    assert [r.slug for r in keyvalue.read_feed(spark, str(tmp_path / "feed")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        keyvalue.read_feed(spark, str(tmp_path / "none"))

    rows = spark.createDataFrame([("b", 'say "hi"', "", "no link"), ("a", "é", "http://x", "OK")], "entry string, `full text` string, link string, status string")
    exports.write_csv_audit(rows.coalesce(1), str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode()
    assert '"b","say ""hi""","","no link"\r\n' in text and text.startswith('"entry","full text","link","status"\r\n"a"')
    exports.write_csv_audit_with_bom(rows, str(tmp_path / "bom"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "bom").glob("part-*"))).decode()
    assert text == '﻿"entry","full text","link","status"\r\n"a","é","http://x","OK"\r\n"b","say ""hi""","","no link"\r\n'

    place = str(tmp_path / "state")
    assert exports.current_state_folder(spark, place) is None
    state = spark.createDataFrame([("z", 1, "h"), ("y", 2, "h")], "slug string, record_id bigint, content_hash string")
    exports.publish_state(state, place, 1)
    exports.publish_state(state.where("slug = 'y'"), place, 2)
    assert exports.current_state_folder(spark, place) == f"{place}/version=000000000002"
    assert [r.slug for r in keyvalue.read_state(spark, exports.current_state_folder(spark, place)).collect()] == ["y"]
    assert keyvalue.read_state(spark, f"{place}/none").count() == 0


def test_key_value_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"_comment": "x", "a": "2", "b": 3, "c": "0.5", "d": "no"}))
    bad.write_text("{broken")
    assert {(r.slug, r.value) for r in keyvalue.read_map(spark, str(good)).collect()} == {("a", "2"), ("b", "3"), ("c", "0.5"), ("d", "no")}
    assert keyvalue.read_map(spark, str(bad)).count() == 0 and keyvalue.read_map(spark, str(tmp_path / "none")).count() == 0
    text = spark.read.text(str(good), wholetext=True)
    assert text.select(keyvalue.numbers(F.col("value")).alias("m")).first().m == {"a": 2.0, "b": 3.0}


def crop_by_hand(face, w, h):
    x, y, fw, fh = face
    cw = min(fw * 1.5 / 0.7, w)
    ch = cw / 0.8
    if ch > h:
        ch, cw = h, h * 0.8
    cw, ch = math.floor(cw), math.floor(ch)
    left = max(0, min(w - cw, math.floor(((x - fw * 0.25) + (x + fw + fw * 0.25)) / 2 - cw / 2 + 0.5)))
    top = max(0, min(h - ch, math.floor(y - fh * 0.4 - ch * 0.08 + 0.5)))
    return left, top, cw, ch


def test_portraits(spark):
    boxes = spark.createDataFrame(
        [("i", 0, 300.0, 40.0, 50.0, 50.0), ("i", 1, 10.0, 20.0, 40.0, 40.0), ("j", 0, 5.0, 5.0, 10.0, 10.0), ("j", 1, 50.0, 5.0, 10.0, 10.0)],
        "image_id string, pos int, x double, y double, width double, height double",
    )
    overrides = spark.createDataFrame([("i", 1), ("j", 9)], "image_id string, subject int")
    faces = portraits.subject_faces(boxes, overrides)
    assert {(r.image_id, r.pos, r.by_override) for r in faces.collect()} == {("i", 1, True), ("j", 0, False)}
    sources = faces.withColumn("src_w", F.lit(640)).withColumn("src_h", F.lit(480))
    for r in portraits.crop_rectangles(sources).collect():
        assert (r.crop_left, r.crop_top, r.crop_w, r.crop_h) == crop_by_hand((r.x, r.y, r.width, r.height), 640, 480)
        assert r.out_w <= r.crop_w and r.out_h == math.floor(r.out_w / 0.8 + 0.5)


def test_a_bucketed_state_is_not_shuffled(spark, tmp_path):
    from prosopon.plans import versions

    sf, place = "/root/testdata/sf0.001", str(tmp_path / "state")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = versions.keyed_state(spark, sf, place)
        plan = versioning.version_plan(versions.document_feed(spark, sf), state, versions.PROFILE)
        merged = versioning.merge_outcomes(state, versions._outcomes(spark, sf), "sandbox")
        for df in (plan, merged):
            lines = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(i for i, line in enumerate(lines[1]) if "Bucketed: true" in line)
            depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
            above, level = [], depth(lines[1][at])
            for line in reversed(lines[1][:at]):
                if depth(line) < level:
                    above.append(line)
                    level = depth(line)
            assert any("Join" in x for x in above) and not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "Join" in x)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exports.publish_keyed(state.limit(3), place, 2, 2)
    assert keyvalue.read_keyed(spark, exports.current_state_folder(spark, place)).count() == 3
    assert keyvalue.read_keyed(spark, None).count() == 0


def test_only_likely_terms_are_shuffled(spark):
    """With every broadcast by size switched off, neither stretches nor cuts that are no term are shuffled, and the mentions are the same; with full bits and short beginnings too."""
    words = [f"{c} part {n}" for c in ("red", "old", "cold") for n in range(0, 3000, 3)]
    texts = [f"got {words[n]}-{n}; got old part {n}1; {'none ' * (n % 3)}" if n % 4 else "nothing of it" for n in range(400)]
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    docs = own.createDataFrame(list(enumerate(texts)), "id int, s string")
    terms = own.createDataFrame(list(enumerate(words)), "ordinal int, term string")
    want = {i: min((s.index(w), -len(w), n, w) for n, w in enumerate(words) if w in s)[3] for i, s in enumerate(texts) if any(w in s for w in words)}

    def shuffled():
        found = enrich.first_mentions(docs, "id", "s", terms)
        assert {r.id: r.term for r in found.collect()} == want
        joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        return sum("strategy=broadcast" in line for line in joins), sum("strategy=broadcast" not in line for line in joins)

    assert shuffled() == (2, 1)


def test_mentions_do_not_depend_on_the_bounds(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abé ", k=rng.randrange(1, 9))) for _ in range(400)})
    texts = ["".join(rng.choices("abéc ", k=rng.randrange(0, 50))) for _ in range(60)]
    want = {i: min((s.index(w), -len(w), n, w) for n, w in enumerate(words) if w in s)[3] for i, s in enumerate(texts) if any(w in s for w in words)}
    docs, terms = spark.createDataFrame(list(enumerate(texts)), "id int, s string"), spark.createDataFrame(list(enumerate(words)), "ordinal int, term string")
    for heads, bits in ((1, 1 << 16), (20, 1 << 17)):
        monkeypatch.setattr(enrich, "MOST_HEADS", heads)
        monkeypatch.setattr(enrich, "MOST_BITS", bits)
        monkeypatch.setattr(enrich, "TERM_BITS", 1 << 12)
        assert {r.id: r.term for r in enrich.first_mentions(docs, "id", "s", terms).collect()} == want
