"""Records, personal data and other inputs that operators once failed on or left as they were."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from prosopon.llm import chat, pii

# Chat records


def test_no_record_fails_the_job(spark):
    nested = lambda n: "[" * n + "]" * n
    deep, deeper = (f'{{"messages":[{{"role":"user","content":{nested(n)}}}]}}' for n in (3000, 300_000))
    mild = {"messages": [{"role": "user", "content": "x"}], "meta": None}
    for _ in range(200):
        mild["meta"] = {"a": [mild["meta"]]}
    records = [
        ('{"messages[].role":"u","messages[].content":"x"}', None), (deep, [("user", nested(3000))]), (deeper, None), (json.dumps(mild), [("user", "x")]),
        ('{"messages":[{"role":"user","content":"a\\ud800b \\ud83d\\ude42"}]}', [("user", "a�b 🙂")]), ('{"messages":[{"role":"\\udfff","content":"c"}]}', [("�", "c")]),
        ('{"messages":{"role":"user","content":"x"}}', None), ("{}", None), ("null", None), ('{"messages":[1,[2],"x"]}', []), ('{"messages":[null]}', []),
    ]
    check_records(spark, records)


def check_records(spark, records):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "i int, record string")
    got = {r.i: r for r in chat.formatted(frame).collect()}
    for i, (record, turns) in enumerate(records):
        assert (None if got[i].formatted is None else chat.read_back(got[i].formatted)) == turns, record[:200]
        assert turns is None or [(s.start, s.end) for s in got[i].loss_spans] == chat.render(turns)[1]


def test_usual_layouts(spark):
    qa = [("user", "q"), ("assistant", "a")]
    messages = '"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]'
    check_records(spark, [
        (f'{{"system":"s",{messages}}}', [("system", "s"), *qa]), (f'{{"answer":"no","prompt":"p","completion":"c",{messages}}}', qa), (f'{{"text":"t",{messages},"x":{{"y":[1]}}}}', qa),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"text","text":"r"}]},null,7,{"role":"assistant","content":"a"}]}', [("user", "q\nr"), ("assistant", "a")]),
        ('{"messages":[{"role":"user","content":[{"type":"image","url":"u"}]}]}', [("user", '[{"type": "image", "url": "u"}]')]),
        ('{"instruction":"q","response":"a"}', qa), ('{"instruction":"q","context":"c","response":"a","category":"x"}', [("user", "q\n\nc"), ("assistant", "a")]),
        ('{"instruction":"q","input":"","output":"a"}', [("user", "q\n\n"), ("assistant", "a")]), ('{"text":"t"}', [("assistant", "t")]),
        ('{"conversations":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', qa), ('{"messages":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', qa),
        ('{"question":"q","answer":"a","id":"7"}', qa), ('{"messages":[],"system":"s"}', [("system", "s")]), ('{"messages":[{"role":"user"},{"content":"a"},{}]}', [("user", ""), ("", "a")]),
    ])


# Personal data


def feistel(values, moduli, kind, key="k"):
    values, half = list(values), len(values) - len(values) // 2
    for r in range(pii.ROUNDS):
        own = [(i < half) == (r % 2 == 0) for i in range(len(values))]
        other = ",".join(str(x) for x, o in zip(values, own, strict=True) if not o)
        stream = "".join(hashlib.sha512("|".join([key, kind, str(len(values)), str(r), str(b), other]).encode()).hexdigest() for b in range((len(values) - 1) // 32 + 1))
        values = [(x + int(stream[4 * i : 4 * i + 4], 16)) % m if o else x for i, (x, m, o) in enumerate(zip(values, moduli, own, strict=True))]
    return values


def letters(text, kind):
    values = [int(c) if c.isdigit() else ord(c.upper()) - 65 for c in text]
    new = feistel(values, [10 if c.isdigit() else 26 for c in text], kind)
    return "".join(str(v) if c.isdigit() else chr((97 if c.islower() else 65) + v) for v, c in zip(new, text, strict=True))


def refilled(like, new):
    it = iter(new)
    return "".join((lambda n: n.lower() if c.islower() else n)(next(it)) if c.isalnum() else c for c in like)


def pseudonym(kind, value):
    number = "".join(c for c in value if c.isdigit())
    if kind == "card":
        body = letters(number[:-1], "card")
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return refilled(value, body + str(-total % 10))
    if kind == "iban":
        plain = value.replace(" ", "").upper()
        body = letters(plain[4:], "iban")
        rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return refilled(value, f"{plain[:2]}{98 - rest:02}{body}")
    if kind == "ssn":
        return refilled(value, letters(number, "ssn"))
    if kind == "phone":
        if value[0] != "+" or (value.startswith("+1") and len(number) == 11):
            return refilled(value, number[:-10] + letters(number[-10:], "phone"))
        return refilled(value, letters(number, "phone abroad"))
    if kind == "ip":
        return ".".join(map(str, feistel([int(x) for x in value.split(".")], [256] * 4, "ip")))
    if kind == "email":
        local, domain = value.split("@")
        return refilled(local.lower(), letters("".join(c for c in local.lower() if c.isalnum()), "email")) + "@" + domain
    form = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if value[2] == "." else "%m/%d/%Y"
    try:
        day = datetime.datetime.strptime(value, form).date()
    except ValueError:
        form = "%d/%m/%Y"
        day = datetime.datetime.strptime(value, form).date()
    days = (day - datetime.date(1700, 1, 1)).days
    major, minor = pii.CYCLE_PARTS
    a, b = feistel([days % pii.CYCLE_DAYS // minor, days % pii.CYCLE_DAYS % minor], [major, minor], "date")
    moved = datetime.date(1700, 1, 1) + datetime.timedelta(days - days % pii.CYCLE_DAYS + a * minor + b)
    return moved.strftime(form).zfill(10)


KINDS = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782-822463-10005", "3782 822463 10005", "378282246310005"],
    "iban": ["BE68539007547034", "BE68 5390 0754 7034", "ES9121000418450200051332", "de89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "gb82west12345698765432", "NO9386011117947"],
    "phone": ["+49 30 123456", "+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "+442071838750"],
    "ssn": ["123-45-6789"], "ip": ["10.0.0.255", "192.168.1.1"], "date": ["2024-05-01", "29.02.1984", "12/31/1999", "31/12/1999"], "email": ["a.B7@c.org", "x_y-z@mail.example.com"],
}
#: What may stand before and after a value.
AROUND = [("", ""), ("", " I paid"), ("", " PAID 77"), ("(", ")"), ("x ", ", y"), ("- ", "-"), ("no ", "- then"), (": ", "; 2024"), ("", " 2024-05-01 ok")]


def test_every_kind_whatever_stands_beside_it(spark):
    texts, wanted = [], []
    for kind, values in KINDS.items():
        for value in values:
            for before, after in AROUND:
                if (kind in ("email",) and before == "- ") or (kind in ("date", "phone") and after.startswith("-")) or (kind == "email" and after.startswith("-")):
                    continue
                new = pseudonym(kind, value)
                assert new != value and len(new) >= 7
                texts.append(before + value + after)
                wanted.append(before + new + after.replace("2024-05-01", pseudonym("date", "2024-05-01")))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymised(frame, "k").collect()}
    assert [(t, got[i], w) for i, (t, w) in enumerate(zip(texts, wanted, strict=True)) if got[i] != w] == []


def test_equal_values_stay_linked(spark):
    frame = spark.createDataFrame([(0, "be68539007547034"), (1, "BE68 5390 0754 7034"), (2, "743-555-3824"), (3, "+1 (743) 555-3824")], "doc_id int, text string")
    a, b, c, d = (r.text for r in pii.pseudonymised(frame, "k").orderBy("doc_id").collect())
    assert a.upper() == b.replace(" ", "") and c.replace("-", "") == "".join(x for x in d if x.isdigit())[1:]


@pytest.mark.parametrize("text", ["BE68539007547035", "DE8937040044053201300", "be68peopleinallofit", "at20 people were in the hall", "4111111111111112", "1234-5678", "300.1.1.1", "31.02.2024", "1.743.555.3824", "ZZ68539007547034"])
def test_invalid_values_stay(spark, text):
    (row,) = pii.pseudonymised(spark.createDataFrame([(text,)], "text string"), "k").select("text", F.col("n_replaced")).collect()
    assert (row.text, row.n_replaced) == (text, 0)
