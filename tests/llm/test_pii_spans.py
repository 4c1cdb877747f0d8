"""Spaced IBANs directly before another capital or digit token."""

from corpuscope.llm import pii


def test_spaced_iban_ends_at_its_country_length(spark):
    ibans = ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "BE68539007547034"]
    rows = [(10 * i + j, f"pay {x}{after}") for i, x in enumerate(ibans) for j, after in enumerate(["", " EUR 100", " 2024", " BIC", " " + ibans[0]])]
    for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect():
        x = ibans[r["doc_id"] // 10]
        assert r["n_iban"] == (2 if r["doc_id"] % 10 == 4 else 1), r
        assert x not in r["text"] and len(r["text"]) == len(dict(rows)[r["doc_id"]])


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


def images(spark, values):
    """The pseudonym of each value, alone in its text."""
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return [r["text"] for r in sorted(pii.pseudonymise(rows, "k").collect(), key=lambda r: r["doc_id"])]


def test_every_kind_is_found_and_one_to_one(spark):
    from datetime import date, timedelta

    days = [date(1999, 1, 1) + timedelta(n) for n in range(800)]
    kinds = {
        "month first": [d.strftime("%m/%d/%Y") for d in days], "day first": [d.strftime("%d/%m/%Y") for d in days if d.day > 12],
        "iso": [d.isoformat() for d in days], "phone": [f"+44 20 71{n:02d} {n:04d}" for n in range(100)], "national": [f"555-1{n:02d}-{n:04d}" for n in range(100)],
        "email": [f"{a}{b}@example.com" for a in "漢ßüéя" for b in "字あΩ한üö"], "ssn": [f"123-45-{n:04d}" for n in range(1, 300)], "ip": [f"10.20.{n}.7" for n in range(10, 100)],
        "card": [x for x in (f"41111111111{n:05d}" for n in range(400)) if luhn(x)],
    }
    for kind, values in kinds.items():
        got = images(spark, values)
        assert len(set(got)) == len(set(values)), kind
        assert all(len(a) == len(b) for a, b in zip(values, got)) and sum(a != b for a, b in zip(values, got)) >= 0.9 * len(values), kind
    # Dates that can only have the month first aren't confused with others.
    both = [d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y") if f[1] == "d" or d.day > 12]
    assert len(set(images(spark, both))) == len(both)


def test_numbers_are_linked_across_layouts(spark):
    digits = lambda x: "".join(c for c in x if c.isdigit())
    a, b, c, d, e = images(spark, ["+442071838750", "+44 20 7183 8750", "555-123-4567", "(555) 123-4567", "+1 555-123-4567"])
    assert digits(a) == digits(b) and digits(a).startswith("44") and a != "+442071838750" and b.count(" ") == 3
    assert digits(c) == digits(d) == digits(e)[1:] and digits(c) != "5551234567"
    plain = ["漢字@example", "12-34-56", "555-123-45678", "99/99/2020", "a+b", "999.1.1.1"]
    assert images(spark, plain) == plain
