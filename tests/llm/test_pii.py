import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirework.llm import pii

NAMES = [("given", g + e) for g in ("Bro", "Kal", "Vel", "Nim") for e in ("dan", "mira", "nia")] + [("given", "Will"), ("given", None)]
NAMES += [("family", f + e) for f in ("Halv", "Tev", "Quil", "Murk") for e in ("ard", "sen", "wick", "mann") if f + e != "Tevwick"] + [("family", "Stone"), (None, "Loose")]
FIND = pii.Finder(NAMES)


def found(text):
    return [(k, text[a:b]) for k, a, b in FIND.spans(text)]


def test_each_type():
    assert found("Mail kara.h@post.example.org now") == [("email", "kara.h@post.example.org")]
    assert found("Mail kara.h (at) example.org or kara dot h at example dot org") == [("email", "kara.h (at) example.org"), ("email", "kara dot h at example dot org")]
    assert found("call +44 (0)20 7946 0209 or (615) 555-0101 ext. 12") == [("phone", "+44 (0)20 7946 0209"), ("phone", "(615) 555-0101 ext. 12")]
    assert found("SSN 929 68 8119; passport C19515538") == [("id_number", "929 68 8119"), ("id_number", "C19515538")]
    assert found("to 12 North Oxley Boulevard, Suite 3\nOlstedt 18951.") == [("address", "12 North Oxley Boulevard, Suite 3\nOlstedt 18951")]
    assert found("an Fennelweg 9, 54073 Kestring") == [("address", "Fennelweg 9, 54073 Kestring")]
    assert found("Dr. Brodan M. Halvard, Kalnia, V. Tevsen-Quilard and Murksen, Velmira") == [
        ("name", "Brodan M. Halvard"), ("name", "Kalnia"), ("name", "V. Tevsen-Quilard"), ("name", "Murksen, Velmira")
    ]


def test_unlisted_name_by_its_parts_and_monsieur():
    assert found("NIMDAN TEVWICK left.") == [("name", "NIMDAN TEVWICK")]
    assert found("M. Tevsen a relu.") == [("name", "Tevsen")] and found("M. Tevsen said") == [("name", "M. Tevsen")]
    assert found("M. Tevsen, Kalnia a relu.") == [("name", "Tevsen, Kalnia")] and found("M. V. Tevsen a relu.") == [("name", "V. Tevsen")]
    assert found("555 | Will we go? > Will we stay?") == []


def test_what_is_none():
    for text in ("Will we go? The Stone manual, page 7.", "logo@2x.png and deploy@v3.1", "Row count was 740764994.", "order 4500-78-76816", "Invoice 974484536 covers", "69 avenues", "Lat/long 526.95481, 140.95481", "", "  "):
        assert found(text) == []
    assert FIND.spans(None) == [] and FIND.redact(None) is None


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert found("Her social security number is 922435693") == [("id_number", "922435693")] and found("build 922435693") == []


def test_positions_count_code_points_and_long_texts():
    text = "📎 " * 40_000 + "Kalnia Tevsen"
    assert FIND.spans(text) == [("name", 80_000, 80_013)]


@given(st.text(max_size=200))
def test_spans_are_ordered_apart_and_redaction_keeps_the_rest(text):
    spans = FIND.spans(text + " Kalnia Tevsen 615-555-0101 a@b.org")
    assert all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:]))
    assert FIND.redact(text + " a@b.org").endswith("[EMAIL]") or not spans


def test_frames(spark):
    names = spark.createDataFrame(NAMES, "kind string, name string")
    rows = [(1, "Hi Kalnia, mail a@b.org", "x"), (1, "Hi Kalnia, mail a@b.org", "x"), (2, None, None), (3, "", None), (4, "nothing", "y")]
    df = spark.createDataFrame(rows, "record_id long, body string, pii_type string")
    got = sorted(tuple(r) for r in pii.spans(df, "record_id", "body", names).collect())
    assert got == [(1, "email", 16, 23), (1, "email", 16, 23), (1, "name", 3, 9), (1, "name", 3, 9)]
    out = pii.redact(df.withColumn("redacted", df.body), "body", names)
    assert out.columns == ["record_id", "body", "pii_type", "redacted"]
    assert [r.redacted for r in out.orderBy("record_id").collect()] == ["Hi [NAME], mail [EMAIL]"] * 2 + [None, "", "nothing"]
    assert pii.spans(df.limit(0), "record_id", "body", names).count() == 0
    assert [r.pii_type for r in pii.spans(df.limit(1), "record_id", "body", names.limit(0)).collect()] == ["email"]


def test_numbers_by_kind():
    assert pii.french_number("269054958815780") and not pii.french_number("269054958815781") and not pii.french_number("2690549588157")
    key = 97 - int("1910319001123") % 97
    assert pii.french_number(f"191032A001123{key:02d}") and not pii.french_number(f"191032A001123{key - 1:02d}")
    assert pii.german_tax("86095742719") and not pii.german_tax("86095742718") and not pii.german_tax("06095742719")
    assert found("Dossier 2 69 05 49 588 157 80, clos") == [("id_number", "2 69 05 49 588 157 80")]
    assert found("Dossier 269054958815780, clos") == [("id_number", "269054958815780")] and found("Dossier 269054958815781, clos") == []
    assert found("noted 86095742719 there") == [("id_number", "86095742719")] and found("noted 86095742718 there") == []
    for text in ("SSN 000-12-3456", "SSN 666-12-3456", "SSN 123-00-3456", "SSN 123-45-0000"):
        assert found(text) == []
    assert found("SSN 123-45-6789") == [("id_number", "123-45-6789")]


def test_ordinary_words_by_what_people_do():
    """A word of the name list that is an ordinary word too, in sentences of no table."""
    for text in ("Stone promised a second round.", "Stone never left the office", "Stone hat sich gestern gemeldet", "Stone erklärte den Plan", "Stone a bien reçu la lettre", "Stone est arrivé hier", "Kind regards, Stone"):
        assert ("name", "Stone") in found(text), text
    for text in ("Stone islands are rare", "The Stone curve rises", "Stone reports are due", "a Stone wall", "Stone is grey", "Will anyone come?", "Latitude 123456789", "checksum 123456789", "receipt 123-456-789"):
        assert found(text) == [], text


def test_name_list_is_bounded(spark):
    names = spark.createDataFrame([("given", "Ada"), ("given", "Ada"), ("family", None)], "kind string, name string")
    assert sorted(pii.listed(names, 2), key=str) == [("family", None), ("given", "Ada")]
    with pytest.raises(ValueError):
        pii.listed(names, 1)
    assert pii.listed(names.limit(0)) == []
