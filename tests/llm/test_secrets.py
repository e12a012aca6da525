"""Secrets, accounts, dates and addresses: found in any case, changed within their format, and given back by inversion."""

import datetime
import re

from quillmap.llm import pii

CASES = {
    "token=abcdefghijklmnop1234": "password",
    "TOKEN=deadbeefcafe0123": "secret",
    "api_key: sk-proj9_Abcd.efgh123X": "password",
    '"API-Key": "zzTop12345"': "password",
    "Password: hunter2": "password",
    "pwd='abc123'": "password",
    "secret=" + "0123456789abcdef" * 6: "password",
    "123-45-6789": "ssn",
    "DE89 3704 0044 0532 0130 00": "iban",
    "GB82WEST12345698765432": "iban",
    "BE68 5390 0754 7034 MORE": "iban",
    "03/04/1985": "day",
    "12.05.1990": "day",
    "31-12-2024": "day",
    "2001:db8:85a3:0:0:8a2e:370:7334": "ipv6",
    "fe80::1ff:FE23": "ipv6",
}
PLAIN = [
    "the token was lost: a secret: nothing here", "password: letmein", "31/02/1999", "12/25/1990", "DE89 3704 0044 0532 0130 01", "GB00 WEST 1234 5698 7654 32",
    "std::vector and Foo::Bar at 12:30:45", "1234-56-789", "0123-45-67890", "my tokens=5", "version 1.2.3", "no secrets", "",
]


def run(spark, texts, **options):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k", **options).collect()
    return [r for _, r in sorted((r["doc_id"], r) for r in rows)]


def mod97(account):
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def test_found_changed_and_inverted(spark):
    texts = [f"see {c} there" for c in CASES] + [" | ".join(CASES)]
    done = run(spark, texts)
    for text, kind, r in zip(CASES, CASES.values(), done, strict=False):
        assert [f["kind"] for f in r["found"]] == [kind], text
        f = r["found"][0]
        assert f["value"] != f["pseudonym"] and f["value"] in text and f["value"] not in r["text"], text
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", s)))
        assert shape(f["value"]) == shape(f["pseudonym"]) and r["text"] == f"see {text} there".replace(f["value"], f["pseudonym"])
        if kind == "iban":
            assert mod97(f["pseudonym"].replace(" ", "")) == 1 and f["pseudonym"][:2] == f["value"][:2]
        if kind == "day":
            datetime.datetime.strptime(f["pseudonym"], "%d{0}%m{0}%Y".format(f["value"][2]))
    assert [f["kind"] for f in done[-1]["found"]] == list(CASES.values())
    back = run(spark, [r["text"] for r in done], back=True)
    assert [r["text"] for r in back] == texts


def test_a_date_is_linked_in_both_forms(spark):
    one, two = run(spark, ["born 1990-05-12", "born 12.05.1990"])
    year, month, day = one["found"][0]["pseudonym"].split("-")
    assert two["found"][0]["pseudonym"] == f"{day}.{month}.{year}"


def test_other_texts_stay(spark):
    for text, r in zip(PLAIN, run(spark, PLAIN), strict=True):
        assert r["text"] == text and not r["found"], text


def test_many_secrets_invert(spark):
    import random

    rng = random.Random(4)
    abc = "0123456789abcdefABCDEFghXYZ-_."
    texts = []
    for _ in range(300):
        body = rng.choice(abc[:20]) + "".join(rng.choice(abc) for _ in range(rng.randint(4, 30))) + str(rng.randint(0, 9))
        texts.append(f"x token={body} y")
    done = run(spark, texts)
    assert [r["text"] for r in run(spark, [r["text"] for r in done], back=True)] == texts
    assert len({r["text"] for r in done}) == len(set(texts))
    assert sum(a != r["text"] for a, r in zip(texts, done, strict=True)) > 290


def test_very_long_text_and_nulls(spark):
    text = "word " * 200_000 + "Password: hunter2 " + "03/04/1985 " * 3
    r = run(spark, [text, None])
    assert [f["kind"] for f in r[0]["found"]] == ["password", "day", "day", "day"] and len(r[0]["text"]) == len(text)
    assert r[1]["text"] is None and not r[1]["found"]
