import datetime as dt
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import pseudonyms as m
from tidemill.llm import queries


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 400))
def test_permutation(size):
    f = m.Feistel(b"k")
    out = [f.permute(x, size, "t") for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [f.permute(x, size, "t", back=True) for x in out] == list(range(size))


def test_formats():
    p = m.Pseudonyms(b"key")
    text = "Mail re.46@mail8.example.com, card 4111 1111 1111 1111 or 4111-1111-1111-1111, call +1 (942) 555-3818 or 942-555-3818, on 2024-02-29 and 29/02/2024, ip 10.0.0.1, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32."
    new, counts = p.replace(text)
    assert counts == [1, 1, 2, 1, 1, 2, 2]
    assert re.sub("[A-Za-z]", "a", re.sub("[0-9]+", "0", new)) == re.sub("[A-Za-z]", "a", re.sub("[0-9]+", "0", text))
    cards = [m._digits(c) for c in re.findall(r"[0-9]{4}(?:[ -][0-9]{4}){3}", new)]
    assert cards[0] == cards[1] != "4111111111111111" and m.luhn(cards[0][:-1]) == int(cards[0][-1])
    a, b = re.search(r"on ([0-9-]+) and ([0-9/]+),", new).groups()
    assert a.split("-") == b.split("/")[::-1] and a != "2024-02-29"
    phones = re.search(r"call (.*) or ([0-9-]+), on", new).groups()
    assert m._digits(phones[0])[1:] == m._digits(phones[1]) != "9425553818"
    iban = re.search(r"iban (\S\S.*)\.", new)[1].replace(" ", "")
    assert m._mod97(iban[4:] + iban[:4]) == 1
    clean = "In 2024 we saw 300 of 1,000 items; version 1.2.3.400 and 99/99/2024 and 4111111111111112."
    assert p.replace(clean) == (clean, [0] * 7)
    assert m.Pseudonyms(b"other").replace(text)[0] != new


def test_numbers_followed_by_digits_and_capitals():
    p = m.Pseudonyms(b"key")
    for kind, value, after in [
        ("card", "4111 1111 1111 1111", " 12/27"), ("card", "4111111111111111", " 20"), ("card", "4111 1111 1111 1111", " CVC"),
        ("iban", "ES91 2100 0418 4502 0005 1332", " BIC"), ("iban", "ES91 2100 0418 4502 0005 1332", " 2024"),
        ("phone", "+49 30 1234567", " AB"), ("phone", "+33 6 12 34 56 78", " 12"), ("phone", "942-555-3818", " 12"), ("phone", "942-555-3818", " 123"), ("phone", "+1 (942) 555-3818", " 12"),
    ]:
        alone, counts = p.replace(value)
        assert alone != value and counts == [int(k == kind) for k in m.KINDS], value
        assert p.replace(value + after) == (alone + after, counts), value + after
        assert p.replace("1234 " + value + after)[0].endswith(alone + after) or kind == "phone"


def test_numbers_without_a_phone_mark_stay():
    clean = "In 1914-1918 and 1990-1995, at 12.50 13.75 or 12 34 56 78, pages 100-150 200-250, 1.234.567 of 12 345 678, 2020 2021 2022."
    assert m.Pseudonyms(b"key").replace(clean) == (clean, [0] * 7)


def test_what_fails_validation_stays():
    p = m.Pseudonyms(b"key")
    for clean in ("(2019) 2020-2021", "pages (12) 345-678", "01 02 03 04 05", "05 06 20241", "order 00 12 34 56 78", "200 300 4000", "+0 123 456 789", "+999", "+1 555 123", "0012345678", "+210 1"):
        assert p.replace(clean) == (clean, [0] * 7), clean
    stamps = " ".join(str(1_700_000_000_000 + 86_399_977 * i) for i in range(2000))
    assert p.replace(stamps) == (stamps, [0] * 7)
    assert p.replace("tel:+4930123456")[0].startswith("tel:+49") and p.replace("tel:+4930123456")[1][-1] == 1
    assert p.replace("+351 21 123 4567")[0].startswith("+351 ") and p.replace("0033 612345678")[0].startswith("0033 ")


def test_pseudonyms_are_valid_and_distinct():
    """Checked with arithmetic of its own: dates, IBANs, cards and phones in sentences."""
    p, rng = m.Pseudonyms(b"key"), random.Random(5)
    seen: dict[str, str] = {}
    for _ in range(300):
        day = dt.date(1900, 1, 1) + dt.timedelta(rng.randrange(73_049))
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        card = rng.choice(["4", "51", "2221", "6011"])
        card += "".join(rng.choice("0123456789") for _ in range(15 - len(card)))
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card))
        card += str(-total % 10)
        phone = f"+49 {rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
        values = [day.isoformat(), f"DE{check:02}{body}", card, phone]
        new, counts = p.replace("On {}, account {}, card {}, call {}.".format(*values))
        assert counts == [0, 0, 1, 0, 1, 1, 1]
        made = list(re.fullmatch(r"On (\S+), account (\S+), card (\S+), call (.+)\.", new).groups())
        assert 1900 <= dt.date.fromisoformat(made[0]).year <= 2099
        assert made[1][:2] == "DE" and int(made[1][4:] + "1314" + made[1][2:4]) % 97 == 1
        assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(made[2]))) % 10 == 0 and len(made[2]) == 16 and made[2][0] in "23456"
        assert made[3].startswith("+49 ") and len(made[3]) == len(phone)
        for value, other in zip(values, made, strict=True):
            assert value != other and seen.setdefault(other, value) == value


def test_inverses():
    p = m.Pseudonyms(b"key")
    values = {
        "email": ["re.46@mail8.example.com", "A" * 200 + "@x.org", "ab1-" * 1250 + "@long.example.net"], "ip": ["10.0.0.1", "255.255.255.255"],
        "date": ["2024-02-29", "29/02/2024", "02/29/2024", "1900.01.01", "31-12-2099"], "ssn": ["123-45-6789"], "iban": ["GB82 WEST 1234 5698 7654 32", "ES9121000418450200051332"],
        "card": ["4111 1111 1111 1111", "378282246310005"], "phone": ["+1 (942) 555-3818", "942-555-3818", "+49 30 1234567"],
    }
    for kind, each in values.items():
        for value in each:
            new = getattr(p, kind)(value)
            assert new != value and getattr(p, kind)(new, back=True) == value, value


def test_long_addresses_are_permuted_throughout():
    p, rng = m.Pseudonyms(b"key"), random.Random(1)
    for n in (100, 200, 300, 5000):
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        new = p.replace(f"to {value}@x.com now")[0][3 : 3 + n]
        assert all(sum(a == b for a, b in zip(value[i : i + 50], new[i : i + 50])) < 15 for i in range(0, n, 50))
    assert p.replace("a" * 1_000_000 + "@x.com")[1][0] == 1


def test_dates_of_one_layout_get_different_strings():
    p, days = m.Pseudonyms(b"key"), [dt.date(1990, 1, 1) + dt.timedelta(i) for i in range(3000)]
    strings = {f"{d.day:02}/{d.month:02}/{d.year}" for d in days} | {f"{d.month:02}/{d.day:02}/{d.year}" for d in days}
    assert len({p.date(s) for s in strings}) == len(strings)


def _plain(text):
    """Spans of what the documents hold, by patterns of its own: addresses, IPv4, US phones, SSN, cards."""
    found = [(x.start(), x.end(), "email") for x in re.finditer(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", text, re.A)]
    for x in re.finditer(r"\d+\.\d+\.\d+\.\d+", text, re.A):
        if all(len(o) < 4 and int(o) < 256 for o in x[0].split(".")):
            found.append((x.start(), x.end(), "ip"))
    found += [(x.start(), x.end(), "phone") for x in re.finditer(r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}", text, re.A)]
    found += [(x.start(), x.end(), "ssn") for x in re.finditer(r"\d{3}-\d\d-\d{4}", text, re.A)]
    for x in re.finditer(r"(?<!\w)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)", text, re.A):
        digits = [int(c) for c in x[0] if c.isdigit()]
        if sum(d if i % 2 else sum(map(int, str(2 * d))) for i, d in enumerate(digits)) % 10 == 0 and re.match(r"4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|35|6[245]|6011", re.sub(r"\D", "", x[0])):
            found.append((x.start(), x.end(), "card"))
    return sorted(found)


def test_query_against_plain_version(spark):
    sf, back = "/root/testdata/sf0.01", {}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pseudonyms(spark, sf).collect()
    p, seen = m.Pseudonyms(queries.PSEUDONYM_KEY), 0
    assert len(rows) == len(docs)
    for r in rows:
        old, at, spans = docs[r.doc_id], 0, _plain(docs[r.doc_id])
        assert len(spans) == sum(r[f"n_{k}"] for k in m.KINDS), r.doc_id
        if not any(k == "ip" for *_, k in spans):
            assert len(old) == len(r.text)
        new, done = r.text, 0
        for start, end, kind in spans:  # what lies between stays, and the pseudonym stands where the value was
            gap = old[done:start]
            assert new[at : at + len(gap)] == gap
            at += len(gap)
            value = old[start:end]
            size = len(re.match(r"[\d.]+\d", new[at:], re.A)[0]) if kind == "ip" else len(value)
            other = new[at : at + size]
            assert getattr(p, kind)(other, back=True) == value and back.setdefault((kind, other), value) == value
            at, done, seen = at + size, end, seen + 1
        assert new[at:] == old[done:]
    assert seen > 20


def test_query_and_cases(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pseudonyms(spark, sf).collect()
    assert len(rows) == len(docs)
    p = m.Pseudonyms(queries.PSEUDONYM_KEY)
    for r in rows:
        text, counts = p.replace(docs[r.doc_id])
        assert r.text == text and [r[f"n_{k}"] for k in m.KINDS] == counts
        assert not set(re.findall(r"\S+@\S+\.com", docs[r.doc_id])) & set(re.findall(r"\S+@\S+\.com", r.text))
    df = spark.createDataFrame([(1, None), (1, ""), (None, "1.2.3.4"), (2, "x" * 200_000)], "doc_id int, text string").selectExpr("*", "1 AS new__", "2 AS n_ip")
    got = m.pseudonymize(df, b"k").collect()
    assert [r.text for r in got[:2]] == [None, ""] and got[2].n_ip == 1 and got[3].text == "x" * 200_000
    assert m.pseudonymize(df.limit(0), b"k").count() == 0
