import pytest

from docloom.llm import pii

TEXT = "born 1987-03-14, 31/12/1999, IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789 card 4111-1111-1111-1111 tel (212) 555-0187 at jo.doe7@mail.example.com from 10.20.30.40, token = \"00ff00ff00ff00ff00ff00ff00ff00ff00ff00ff\""


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(size):
    out = [pii.permute(i, size, b"k", b"t") for i in range(size)]
    assert sorted(out) == list(range(size))
    assert [pii.permute(x, size, b"k", b"t", False) for x in out] == list(range(size))


def test_round_trip_and_formats():
    forward, back = pii.Cipher(b"secret"), pii.Cipher(b"secret", False)
    new, spans = pii.replace(TEXT, forward)
    assert [k for _, _, k in spans] == ["day", "day", "iban", "ssn", "card", "phone", "email", "ip", "secret"]
    assert len(new) >= len(TEXT) - 12
    for a, b, kind in spans:
        value = TEXT[a:b]
        assert value not in new
        other = forward.done(kind, value)
        assert dict(card=pii.good_card, iban=pii.good_iban, phone=pii.good_phone, ssn=pii.good_ssn, ip=pii.good_ip).get(kind, lambda t: True)(other)
        assert back.done(kind, other) == value
    assert pii.replace(new, back)[0] == TEXT
    assert pii.replace(TEXT, pii.Cipher(b"another"))[0] != new


def test_a_card_beside_another_number():
    for text in ("4111 1111 1111 1111 123", "77 4111 1111 1111 1111", "12-4111-1111-1111-1111-9"):
        (a, b, kind), = pii.find(text)
        assert kind == "card" and text[a:b].replace(" ", "").replace("-", "") == "4" + "1" * 15


def test_a_phone_is_linked_however_it_is_written():
    cipher = pii.Cipher(b"k")
    out = [cipher.done("phone", t) for t in ("(212) 555-0187", "212-555-0187", "+1 212.555.0187")]
    assert len({"".join(c for c in t if c.isdigit())[-10:] for t in out}) == 1 and out[1][3] == out[1][7] == "-"


def test_the_key_of_the_session(make, spark):
    docs = make([(1, "x 10.20.30.40")])
    one = pii.pseudonymise(docs).first().text
    spark.conf.set("spark.docloom.pii.key", "another")
    try:
        assert pii.pseudonymise(docs).first().text == pii.pseudonymise(docs, b"another").first().text != one
    finally:
        spark.conf.unset("spark.docloom.pii.key")


def test_invalid_values_stay():
    text = "card 4111-1111-1111-1112, 2023-02-30, 300.1.1.1, 000-12-3456, version 1.2.3.4.5, CC BY-NC 4.0"
    assert pii.replace(text, pii.Cipher())[0] == text


def test_equal_values_stay_linked(make, odd):
    out = {r.doc_id: r for r in pii.pseudonymise(make([(1, "x 10.20.30.40"), (2, "10.20.30.40 y"), (3, "clean"), (4, None), (5, "")])).collect()}
    assert out[1].text.split()[1] == out[2].text.split()[0] != "10.20.30.40"
    assert out[3].text == "clean" and out[4].text is None and out[5].text == "" and out[1].kinds == ["ip"]
    assert pii.pseudonymise(odd).count() == odd.count() and pii.pseudonymise(odd.limit(0)).count() == 0
