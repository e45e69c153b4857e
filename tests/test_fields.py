"""Field functions on literal strings."""

from pyspark.sql import functions as F

from prosopon.functions import citations, names, nationality, roles, search
from prosopon.functions import text as t
from prosopon.plans.synth import FORMS


def role(title, organisation=None, abbreviation=None, start=None, end=None, ordinal=None):
    return {"ordinal_text": ordinal, "title": title, "organisation": organisation, "abbreviation": abbreviation, "start_year": start, "end_year": end}


def test_roles(apply):
    cases = {
        "Danish engineer and third Secretary-General of the Harbour Union (HBU) 1951-1957": [
            role("Secretary-General", "Harbour Union", "HBU", 1951, 1957, "third")
        ],
        "Chilean jurist and second Director of the River Board (RB) 1960-1964 and first President of the Lake Fund 1970–1975": [
            role("Director", "River Board", "RB", 1960, 1964, "second"),
            role("President", "Lake Fund", None, 1970, 1975, "first"),
        ],
        "first Director-General of the Office for Grain and Seed (OGS) 1933-1938": [
            role("Director-General", "Office for Grain and Seed", "OGS", 1933, 1938, "first")
        ],
        "Swiss lawyer and tenth United Nations High Commissioner for Refugees 1990-2000": [
            role("United Nations High Commissioner for Refugees", "Office of the United Nations High Commissioner for Refugees", "UNHCR", 1990, 2000, "tenth")
        ],
        "second High Commissioner for Human Rights 1997-2002": [
            role("High Commissioner for Human Rights", "Office of the United Nations High Commissioner for Human Rights", "OHCHR", 1997, 2002, "second")
        ],
        # An organisation of its own keeps the institution's name out.
        "first High Commissioner for Refugees Coming from Afar of the Old League 1933-1935": [
            role("High Commissioner for Refugees Coming from Afar", "Old League", None, 1933, 1935, "first")
        ],
        "Irish economist and Delegate to the Market Council 1971-1973": [role("Delegate", "Market Council", None, 1971, 1973)],
        "fourth Secretary-General of the Northern Pact (NP), 1961-1964": [role("Secretary-General", "Northern Pact", "NP", 1961, 1964, "fourth")],
        "first Executive Secretary of the Basin Commission (UN BCA) 1947-1957": [
            role("Executive Secretary", "Basin Commission", "UN BCA", 1947, 1957, "first")
        ],
        "third Executive Secretary of the Weather Accord (WACC) Secretariat 2002-2006": [
            role("Executive Secretary", "Weather Accord Secretariat", "WACC", 2002, 2006, "third")
        ],
        "first Head of the Bank of Floods (BofF) 1920-1924": [role("Head", "Bank of Floods", "BofF", 1920, 1924, "first")],
        "Acting Director of the Salt Office (acting) in 1946": [role("Acting Director", "Salt Office (acting)", None, 1946, 1946)],
        "second Director of the Salt Office March-May 1950, third Head of the Tin Office 1952": [
            role("Director", "Salt Office", None, 1950, 1950, "second"),
            role("Head", "Tin Office", None, 1952, 1952, "third"),
        ],
        "Director-General (DG) 1965-1968": [role("Director-General", None, "DG", 1965, 1968)],
        "Mexican poet and teacher": [],
        "": [],
        "first Director of the Tin Office (TO) 1950 – 1952": [role("Director", "Tin Office", "TO", 1950, 1952, "first")],
    }
    assert apply(roles.parse_roles, list(cases)) == list(cases.values())


def test_names(apply):
    cases = {
        "DA SILVA, Ana (known as Nita), Brazilian lawyer, was born": ("da Silva", "Ana", "Nita", None),
        "NIELSEN, Jens, Danish engineer, was born": ("Nielsen", "Jens", None, None),
        "LUND, Eva (née Holm), Danish": ("Lund", "Eva", None, "Holm"),
        "LUND, Eva (NÉE Holm), Danish": ("Lund", "Eva", None, "Holm"),
        "VOS, Rudolf (Ruud), Dutch": ("Vos", "Rudolf", "Ruud", None),
        "VOS, Rudolf (called Ruud) , Dutch": ("Vos", "Rudolf", "Ruud", None),
        "[VAN HEEL] VOS-McKAY, Jan, Dutch": ("van Heel Vos-McKay", "Jan", None, None),
        "M’BAYE, Ali, Senegalese": ("M’Baye", "Ali", None, None),
    }
    got = apply(names.parse_name, list(cases))
    assert [tuple(g.values()) for g in got] == list(cases.values())
    assert apply(names.parse_name, ["no commas here", ""]) == [None, None]


def test_summary_and_life(apply):
    text = "VOS, Jan, Dutch poet and first Head of the Sea Office 1920-1925, was born 2 May 1880 in Delft and died there"
    assert apply(names.summary, [text, "VOS, Jan, Dutch poet"]) == ["Dutch poet and first Head of the Sea Office 1920-1925", None]
    assert apply(names.life, [text, "nothing"]) == ["Was born 2 May 1880 in Delft and died there", None]


def test_alias_suffix(spark):
    cases = [
        ("Bob", "Emile Lenn", None, " (Bob)"), (None, "Gro Brun", "Harl", " (née Harl)"), ("Bob", "Gro Brun", "Harl", " (Bob)"),
        ("louis", "Charles Louis Roy", None, ""), ("Louis", "Louise Roy", None, " (Louis)"), (" ", "A B", " ", ""), (None, "Ana  Maria Lu", "ana maria", ""),
    ]
    df = spark.createDataFrame(cases, "k string, n string, m string, want string")
    rows = df.select(names.alias_suffix(F.col("k"), F.col("n"), F.col("m")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_nationality(apply):
    cases = {
        "Kenyan lawyer": ("Kenyan", "Kenya"),
        "American head of the Office for Refugees Coming from Germany": ("American", "United States"),
        "Argentinean economist": ("Argentinean", "Argentina"),
        "Argentine economist": ("Argentine", "Argentina"),
        "preGerman thing": ("German", "Germany"),
        "Martian": (None, None),
        "": (None, None),
        "german in lower case": (None, None),
    }
    got = apply(lambda c: nationality.nationality(c, FORMS), list(cases))
    assert [tuple(g.values()) for g in got] == list(cases.values())


def test_citation_lists(apply):
    got = apply(
        citations.citation_list,
        ["A, 1; B 2.; C;", "X http://a.example/;find?q=1; Y (all websites accessed 3 June 2021).", "", ";; ; .", None],
    )
    items = [[i["raw"] for i in g["items"]] for g in got]
    assert items == [["A, 1", "B 2", "C"], ["X http://a.example/;find?q=1", "Y"], [], [], []]
    assert [g["websites_accessed_on"] for g in got] == [None, "3 June 2021", None, None, None]


def test_authors(apply):
    marker = "in Lives Register, Biographical Dictionary"
    texts = [
        f"Ann Lee, Jr. and Bo Ray, ‘LIE, Tom’ {marker} of", f"Ann Lee ‘M’BAYE, Ali’ {marker}", f"‘Ann Lee, ‘LIE, Tom’ {marker}", f"‘LIE, Tom’ {marker}",
    ]
    assert apply(lambda c: citations.citation_authors(c, marker), texts) == ["Ann Lee, Jr. and Bo Ray", "Ann Lee", "‘Ann Lee", None]
    assert apply(lambda c: citations.author_list(c, "House"), ["A, B and C & D", " ", None, "and"]) == [["A, B", "C", "D"], ["House"], ["House"], ["and"]]


def test_dates(apply):
    cases = {
        "Version 23 September 2019": "2019-09-23", "version 1 MAY 2020 (rev)": "2020-05-01", "Version 31 February 2019": "2019-02-31",
        "Version 2018": "2018-01-01", "Version 3 Foo 2017": "2017-01-01", "Version": None, "": None, "12345": None,
    }
    assert apply(citations.publication_date, list(cases)) == list(cases.values())
    assert apply(lambda c: citations.checked_date(c).isNull(), ["Version 31 February 2019", "Version 1 May 2020"]) == [True, False]


def test_image_credits(apply):
    got = apply(citations.image_credit, ["Photo by X – https://www.pics.example/a?b=1).", "UN archive", "see WWW.foo.example/x, y", None])
    assert got[0] == {"text": "Photo by X", "href": "https://www.pics.example/a?b=1", "label": "pics.example"}
    assert got[1] == {"text": "UN archive", "href": None, "label": None}
    assert got[2]["href"] == "https://WWW.foo.example/x" and got[2]["label"] == "foo.example"
    assert got[3] == {"text": "", "href": None, "label": None}


def test_credit_lines_and_links(apply):
    got = apply(citations.credit_line, ["* Ann Lee :muted[(LIE, VAN DEN BERG)]", "Ann Lee (LIE)"])
    assert got == [{"name": "Ann Lee", "entries": ["LIE", "VAN DEN BERG"]}, None]
    links = apply(citations.file_links, ["[a](/x.pdf) [b](/y.html) [c](z.DOCX)"])
    assert [x["file"] for x in links[0]] == ["/x.pdf", "z.DOCX"]


def test_text(apply):
    assert apply(t.strip, [" ﻿ a b \t"]) == ["a b"]
    assert apply(t.path_id, ["Lie-T 2013.docx", "Sub Dir/M’Bow-A. 2012.docx", "a/index.md"]) == ["lie-t-2013", "sub-dir/mbow-a-2012", "a"]
    assert apply(t.image_key, ["M’Bow A.x"]) == ["m’bow-a.x"]
    assert apply(t.path_stem, ["/a/b/Lie T 2013.v2.docx"]) == ["Lie T 2013.v2"]


def test_rank_ladder(apply):
    def rank(q):
        return lambda c: search.rank(c, q)

    values = ["Élan", "elan", "elan vital", "grand elan", "mélange", "e-la-n", "every lazy ant naps", "eel and an", "none", ""]
    assert apply(rank("elan"), values) == [6, 7, 5, 4, 3, 1, 2, 1, 0, 0]
    assert apply(rank("ELAN"), ["elan"]) == [6]
    assert apply(rank("a.c"), ["xa.cx", "abc", "a..c"]) == [3, 0, 1]


def test_locale_order(spark):
    from prosopon.functions.text import locale_key

    words = ["Mbox", "M’Bow", "Mbaz", "de Lamérie", "Delaware", "Änne", "anna", "ann b"]
    df = spark.createDataFrame([(w,) for w in words], "w string").orderBy(locale_key(F.col("w")))
    assert [r.w for r in df.collect()] == ["anna", "ann b", "Änne", "de Lamérie", "Delaware", "Mbaz", "M’Bow", "Mbox"]
