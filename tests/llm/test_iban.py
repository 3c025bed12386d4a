"""IBANs before other capitals and other IBANs."""

from edgeframe.llm import pii

AT, BE, ES, DE = ("AT61 1904 3002 3457 3201", "BE71 0961 2345 6769",
                  "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00")


def found(text):
    return [text[a:b] for a, b in pii.ibans(text)]


def test_ibans_end_at_the_length_of_their_country():
    assert found(f"{AT} BIC") == [AT]
    assert found(f"{BE} KBC") == [BE]
    assert found(f"{ES} {DE}") == [ES, DE]
    assert found(f"{DE} {AT} {BE};{ES}.") == [DE, AT, BE, ES]
    assert found(f"AB12 CD34 {AT} X") == [AT]
    assert found("NO93 8601 1117 947 and MT84MALT011000012345MTLCAST001S") == [
        "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"]
    assert found(f"{AT}5") == found(AT[:-1] + "2") == found("x" + AT) == []


def test_unknown_countries_try_every_length():
    digits = next(f"{k:02}" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}190430023457"))
    code = f"ZZ{digits} 1904 3002 3457"
    assert found(f"{code} BIC") == [code]
