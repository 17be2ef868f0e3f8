"""Identifiers behind cues and street addresses of four languages."""

import pytest

from tessera.llm import pii

_ANCHORS = pii.automaton()


def found(text, kind):
    return [text[s:e] for s, e, k in pii.spans_of(text, _ANCHORS) if k == kind]


@pytest.mark.parametrize(
    ("text", "account"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 bitte", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE89370400440532013000.", "DE89370400440532013000"),
        ("iban gb82 west 1234 5698 7654 32 and more", "gb82 west 1234 5698 7654 32"),
        ("IBAN no. NO93 8601 1117 947 a", "NO93 8601 1117 947"),
        ("account number 12345678", "12345678"),
        ("Account 12345678, please", "12345678"),
        ("passport no. X1234567", "X1234567"),
        ("ssn 123-45-6789", "123-45-6789"),
        ("iban: AB12345678", "AB12345678"),
    ],
)
def test_accounts(text, account):
    assert found(text, "account") == [account]


@pytest.mark.parametrize("text", ["IBAN DE88 3704 0044 0532 0130 00", "IBAN DE88370400440532013000", "IBAN DE89 3704 0044 0532 0130 001", "IBAN DE89 37040 044 0532 0130 00", "IBAN XX89 3704 0044 0532 0130 00"])
def test_ibans_need_length_groups_and_remainder(text):
    assert found(text, "account") == []


@pytest.mark.parametrize(
    ("text", "address"),
    [
        ("Er wohnt Hauptstrasse 12 in Bonn", "Hauptstrasse 12"),
        ("in der Bahnhofstraße 7a, hinten", "Bahnhofstraße 7a"),
        ("Bahnhofstr. 5", "Bahnhofstr. 5"),
        ("an der Berliner Straße 110.", "Berliner Straße 110"),
        ("Lindenallee 3 und Rosenweg 9", "Lindenallee 3|Rosenweg 9"),
        ("au 12 rue de la Paix, Paris", "12 rue de la Paix"),
        ("5 bis, avenue Victor Hugo", "5 bis, avenue Victor Hugo"),
        ("vive en la calle de Alcalá, 45 desde ayer", "calle de Alcalá, 45"),
        ("Avenida de América 3", "Avenida de América 3"),
        ("Plaza Mayor nº 1", "Plaza Mayor nº 1"),
        ("12 Baker Street and 4 Mill Road", "12 Baker Street|4 Mill Road"),
    ],
)
def test_addresses(text, address):
    assert found(text, "address") == address.split("|")


@pytest.mark.parametrize(
    "text",
    [
        "The account of 2019-2020 and the account 2019-2020 were closed; a token 3rd-party, a secret 20th-century plan.",
        "Password protected pages and passport control; account managers wait, token economics, account no longer used.",
        "Sie ging auf dem Arbeitsplatz 3 Schritte, die Straße 12 Meter entlang, ein Umweg 5 lang, und die Hauptstrasse 12% hinab.",
        "Il y a 3 rue et 12 places dans la ville, une rue de la Paix sans rien.",
        "La calle Mayor es larga y la plaza tiene 3 bancos, camino de casa.",
        "It is true, a cruel place; 12 roads, the long lane, drive 5 miles and route 66.",
    ],
)
def test_clean_prose_stays_alone(text):
    assert pii.spans_of(text, _ANCHORS) == []


def test_long_runs_stay_linear():
    for text in ("account " * 20_000, "IBAN DE89 " * 20_000, "rue de la " * 20_000, "Astr. " * 20_000, "iban " + "DE89" * 50_000):
        assert found(text, "email") == []
