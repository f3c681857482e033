from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import surrogates as sg
from tests.llm.helpers import documents, ordered, table


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def replaced(spark, *texts, key="k"):
    docs = documents(spark, enumerate(texts))
    rows = sg.replace_entities(docs, key, "entities").select("doc_id", "text", "entities").collect()
    return [(r["text"], r["entities"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


PLAIN = [
    "", None, "No entity at all, 12 apples and 3.14 and v1.2.3", "4111111111111112 fails its check",
    "256.1.1.1 and 1.2.3.4.5 are no addresses", "an@ and @b and a@b", "12345678 and 123456789012",
    "Mr lower case", "deadbeef is short", "00000000000000000000000000000000",
]


def test_plain_texts_stay(spark):
    assert replaced(spark, *PLAIN) == [(t, 0) for t in PLAIN]


FORMATS = [
    ("Mail Jo.Doe.42@mail4.example.com now", r"Mail [a-z]+\.\d\d@[a-z]{8}\.com now"),
    ("(jörg@mail.example.de)", r"\([a-z]+@[a-z]{8}\.de\)"),
    ("call +1 (482) 555-7163.", r"call \+1 \([2-9]\d\d\) \d{3}-\d{4}\."),
    ("call +49 30 1234 5678", r"call \+49 \d\d \d{4} \d{4}"),
    ("ip 9.122.68.47, net 10.0.0.7 and 192.168.1.9", r"ip \d+\.\d+\.\d+\.\d+, net 10\.\d+\.\d+\.\d+ and 192\.168\.\d+\.\d+"),
    ("card 4111 1111 1111 1111 end", r"card 4\d{3} \d{4} \d{4} \d{4} end"),
    ("card 4111111111111111", r"card 4\d{15}"),
    ("ssn 123-45-6789", r"ssn 9\d\d-\d\d-\d{4}"),
    ('token = "b7852d4e73166f43a80132626729b5fa5141a7a6"', r'token = "[0-9a-f]{40}"'),
    ("KEY " + "AB12" * 8, r"KEY [0-9A-F]{32}"),
    ("Dear Mrs. Anna Smith,", r"Dear Mrs\. [A-Z][a-z]+na [A-Z][a-z]+r,"),
    ("Herr Müller kam", r"Herr [A-Z][a-z]+r kam"),
    ("г-н нет, Г-жа Анна Петрова да", r"г-н нет, Г-жа [А-Я][а-я]+на [А-Я][а-я]+р да"),
    ("Κύριος Νίκος Παππάς", r"Κύριος [Α-Ω][α-ω]+ν [Α-Ω][α-ω]+ρ"),
    ("MR JOHN DOE", "MR JOHN DOE"),
]


def test_type_format_gender_and_script_are_kept(spark):
    got = replaced(spark, *(t for t, _ in FORMATS))
    for (text, pattern), (new, n) in zip(FORMATS, got, strict=True):
        assert re.fullmatch(pattern, new), (text, new)
        assert (new != text) == (n > 0)
    cards = [re.sub(r"\D", "", new) for (t, _), (new, _) in zip(FORMATS, got, strict=True) if t.startswith("card")]
    assert all(map(luhn, cards)) and cards[0] == cards[1]  # one card, written in two ways


WIDER = [
    ("Dr. Juan Carlos Lopez left", r"Dr\. [A-Z][a-z]+s [A-Z][a-z]+s [A-Z][a-z]+r left"),
    ("Mr. J. Smith and Mr. J.R. Smith, mrs. Anna Smith", r"Mr\. [A-Z]\. ([A-Z][a-z]+r) and Mr\. [A-Z]\.[A-Z]\. \1, mrs\. [A-Z][a-z]+na \1"),
    ("MR. JOHN DOE", r"MR\. [A-Z]+N [A-Z]+R"),
    ("415-555-2671 or 415.555.2671", r"(\d{3})-(\d{3})-(\d{4}) or \1\.\2\.\3"),
    ("dial 1-800-555-0199.", r"dial 1-\d{3}-\d{3}-\d{4}\."),
    ("dial 020 7946 0958", r"dial 0\d\d \d{4} \d{4}"),
    ("card 3782 822463 10005", r"card 3\d{3} \d{6} \d{5}"),
    ("key " + "0a" * 500, "key [0-9a-f]{1000}"),
]


def test_wider_forms(spark):
    got = replaced(spark, *(t for t, _ in WIDER))
    for (text, pattern), (new, _) in zip(WIDER, got, strict=True):
        assert re.fullmatch(pattern, new), (text, new)
        old_words = re.findall(r"[A-Z][a-z]{3,}|\d{3,}|[0-9a-f]{32,}", text)
        assert new != text and not [w for w in old_words if w in new], (text, new)


def test_bare_mentions_of_a_documents_own_names(spark):
    (one, n), (other, m) = replaced(
        spark, "Mrs. Anna Smith came. Smith's car; Anna sat, SMITH not, Smithson stood, smith works.", "Smith alone"
    )
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. (\w+)'s car; (\w+) sat, (\w+) not, Smithson stood, smith works\.", one)
    assert names[3] == names[2] != "Smith" and names[4] == names[1] != "Anna" and names[5] == names[2].upper()
    assert (n, other, m) == (4, "Smith alone", 0)


def test_coreference_within_and_across_documents(spark):
    got = replaced(
        spark,
        "Mr John Smith wrote to a.b@c.org. Mr Smith paid; Mrs Jane Smith did not.",
        "From A.B@C.org: +1 482 555 7163 or +1 (482) 555-7163",
    )
    (first, _), (second, n) = got
    names = re.fullmatch(r"Mr (\w+) (\w+) wrote to (\S+@\S+)\. Mr (\w+) paid; Mrs (\w+) (\w+) did not\.", first)
    assert names[2] == names[4] == names[6] and names[1] != names[5]
    found = re.fullmatch(r"From (\S+): (.+) or (.+)", second)
    assert found[1] == names[3] and n == 3
    assert re.sub(r"\D", "", found[2]) == re.sub(r"\D", "", found[3])


def test_one_person_under_several_titles(spark):
    got = replaced(
        spark,
        "Dr. Anna Smith wrote; Anna Smith agreed; Mrs. Anna Smith signed. Anna left.",
        "Prof. Anna Smith and Mr. Robin Smith",
        "Mrs. Robin Jones met Dr. Robin Jones",
        "Mr. Robin Hill and Mrs. Robin Hill met Dr. Robin Hill",
        "Dr. Robin Hill alone",
    )
    one = re.fullmatch(r"Dr\. (\w+) (\w+) wrote; (\w+) (\w+) agreed; Mrs\. (\w+) (\w+) signed\. (\w+) left\.", got[0][0])
    assert one[1] == one[3] == one[5] == one[7] != "Anna" and one[1].endswith("na")
    assert one[2] == one[4] == one[6] != "Smith"
    two = re.fullmatch(r"Prof\. (\w+) (\w+) and Mr\. (\w+) (\w+)", got[1][0])
    assert two[1] == one[1] and two[2] == two[4] == one[2]  # the table tells Anna's gender
    three = re.fullmatch(r"Mrs\. (\w+) \w+ met Dr\. (\w+) \w+", got[2][0])
    assert three[1] == three[2] == two[3][:-1] + "na"  # Robin by the document's own title
    four = re.fullmatch(r"Mr\. (\w+) \w+ and Mrs\. (\w+) \w+ met Dr\. (\w+) \w+", got[3][0])
    assert (four[1], four[2], four[3]) == (two[3], three[1], two[3][:-1] + "s")
    assert got[4][0].split()[1] == four[3]


def test_one_phone_with_and_without_its_country_code(spark):
    (new, n), = replaced(spark, "+14155552671, +1 (415) 555-2671, 415-555-2671, 1-415-555-2671, +44 415 555 2671")
    found = re.fullmatch(r"\+1(\d{10}), \+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3}-\d{3}-\d{4}), 1-(\S+), \+44 (\d{3} \d{3} \d{4})", new)
    ten = found[2] + found[3] + found[4]
    assert n == 5 and found[1] == ten != "4155552671"
    assert found[5] == found[6] == f"{found[2]}-{found[3]}-{found[4]}"
    assert found[7].replace(" ", "") != ten


def test_small_formats_are_filled_by_rank(spark):
    """Almost all of 192.168 and of a short phone format occur; private addresses go on in 172.16."""
    entities = spark.range(60_000).select(
        F.lit("address").alias("kind"),
        F.format_string("192.168.%d.%d", (F.col("id") / 254).cast("int"), F.col("id") % 254 + 1).alias("canon"),
    ).unionByName(
        spark.range(39_000).select(
            F.lit("phone").alias("kind"), F.concat(F.lit("+"), (F.col("id") + 20_000).cast("string")).alias("canon")
        )
    )
    got = sg.distinct_surrogates(entities, "k").toPandas()
    assert len(got) == 99_000 and not got.duplicated(["kind", "surrogate"]).any()
    assert not got.duplicated(["kind", "canon"]).any()
    addresses, phones = (got[got["kind"] == k] for k in ("address", "phone"))
    for part in (addresses, phones):
        assert not set(part["surrogate"]) & set(part["canon"])
    assert addresses["surrogate"].str.fullmatch(r"192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+").all()
    assert addresses["surrogate"].str.startswith("192.168.").sum() == 256 * 254 - 60_000
    assert phones["surrogate"].str.fullmatch(r"\+[2-9]\d{4}").all()


def test_a_full_format_is_an_error(spark):
    entities = spark.range(50_000).select(
        F.lit("phone").alias("kind"), F.concat(F.lit("+"), (F.col("id") + 20_000).cast("string")).alias("canon")
    )
    with pytest.raises(ValueError, match="phone"):
        sg.distinct_surrogates(entities, "k")


def test_texts_between_entities_stay_and_the_mapping_is_one_to_one(spark):
    """Found anew in Python: old and new texts differ in the entities alone."""
    finder = re.compile(
        r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+(?!\d)"
        r"|\b[0-9a-f]{40}\b|(?<!\d)\d{16}(?!\d)"
    )
    docs = table(spark, "documents", "0.01")
    old = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    to, back, n = {}, {}, 0
    for r in sg.replace_entities(docs, "k").collect():
        before, after = old[r["doc_id"]], r["text"] or ""
        assert finder.split(before) == finder.split(after)
        for a, b in zip(finder.findall(before), finder.findall(after), strict=True):
            if a.isdigit() and not luhn(a):
                assert a == b
                continue
            n += 1
            assert to.setdefault(a.lower(), b) == b and back.setdefault(b, a.lower()) == a.lower() and a != b
    assert n > 50


def test_depends_on_the_key_alone(spark):
    text = "a.b@c.org and 9.8.7.6"
    assert replaced(spark, text) == replaced(spark, text) != replaced(spark, text, key="other")


def test_distinct_entities_stay_distinct(spark):
    rng = random.Random(1)
    phones = sorted({f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}" for _ in range(3000)})
    docs = documents(spark, [(i, f"x {p} y") for i, p in enumerate(phones)])
    new = {r["text"] for r in sg.replace_entities(docs, "k").collect()}
    assert len(new) == len(phones) and not new & {f"x {p} y" for p in phones}


def test_collisions_are_resolved(spark, monkeypatch):
    """With room for few surrogates in the first attempts, all still get one of their own."""
    real = sg.candidate

    def narrow(key, kind, canon, attempt):
        if attempt < 3:
            return F.concat(F.lit("s"), F.pmod(F.xxhash64(canon), F.lit(4 ** (attempt + 1))).cast("string"))
        return real(key, kind, canon, attempt)

    monkeypatch.setattr(sg, "candidate", narrow)
    entities = spark.createDataFrame(
        [("secret", f"{i:032x}") for i in range(100)] + [("secret", "s0"), ("secret", "s1")],
        "kind string, canon string",
    )
    given = sg.distinct_surrogates(entities, "k").collect()
    assert {r["canon"] for r in given} == {r["canon"] for r in entities.collect()}
    assert len({r["surrogate"] for r in given}) == len(given) == 102
    assert not {r["surrogate"] for r in given} & {"s0", "s1"}


def test_repeats_missing_ids_long_texts_and_nothing(spark):
    long = "word " * 40_000 + "mail a@b.org " + "x" * 100_000 + "@"
    rows = [(1, "a@b.org"), (1, "a@b.org"), (None, "a@b.org"), (2, long), (3, None)]
    docs = documents(spark, rows)
    got = sg.replace_entities(docs, "k")
    assert got.columns == docs.columns
    texts = [t for _, t, _ in ordered(got, "doc_id", "text", "row")]
    assert texts[0] == texts[1] == texts[2] != "a@b.org" and texts[4] is None
    assert texts[3] == long.replace("a@b.org", texts[0])
    assert sg.replace_entities(documents(spark, []), "k", "entities").count() == 0


def test_whole_documents(spark):
    docs = table(spark, "documents", "0.01")
    old = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    new = {r["doc_id"]: r["text"] or "" for r in sg.replace_entities(docs, "k").collect()}
    finders = {
        "mail": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}",
        "address": r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d])", "secret": r"\b[0-9a-f]{40}\b",
    }
    for pattern in finders.values():
        before = {m for t in old.values() for m in re.findall(pattern, t)}
        after = {m for t in new.values() for m in re.findall(pattern, t)}
        assert before and len(before) == len(after) and not before & after
    cards = {m for t in old.values() for m in re.findall(r"(?<!\d)\d{16}(?!\d)", t)}
    after = {m for t in new.values() for m in re.findall(r"(?<!\d)\d{16}(?!\d)", t)}
    assert {c for c in cards if not luhn(c)} <= after
    assert not {c for c in cards if luhn(c)} & after
    anything = re.compile("|".join(finders.values()) + r"|(?<!\d)\d{16}(?!\d)")
    assert all(new[i] == t for i, t in old.items() if not anything.search(t))


def test_no_python_runs(spark):
    got = sg.replace_entities(table(spark, "documents"), "k")
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("digits, kind", [("4111111111111111", "card"), ("4111111111111112", None)])
def test_card_numbers_need_their_check_digit(spark, digits, kind):
    df = spark.createDataFrame([(digits,)], "s string")
    assert df.select(sg.kind_of(F.col("s"))).first()[0] == kind
