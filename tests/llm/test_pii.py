"""Personal data: plain spans by the patterns as given, disguises, offsets and masking."""

import hashlib
import random
import re
import time

import pytest

from manchete.llm import pii

from .helpers import by_id, clashing, documents


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def brute(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1.2-3 @+()4%x5_6789é０＠а") for _ in range(rng.randint(0, 60)))
        plain, every = pii.spans(text)
        assert plain == brute(text)
        assert set(plain) <= set(every)
        assert all(0 <= a < b <= len(text) for _, a, b in every)
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("to john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("to john.doe [at] mail [dot] example [dot] org", "email", "john.doe [at] mail [dot] example [dot] org"),
        ("write john at example dot com", "email", "john at example dot com"),
        ("ask jоhn@ехаmple.com", "email", "jоhn@ехаmple.com"),
        ("ask ｊｏｈｎ＠example．com", "email", "ｊｏｈｎ＠example．com"),
        ("ask jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("card 4111 1111 1111 one one one one!", "card", "4111 1111 1111 one one one one"),
        ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("at 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    plain, every = pii.spans(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in every and plain == []
    assert pii.masked(text) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "kind, part",
    [
        ("email", "𝗷𝗼𝗵𝗻@𝗲𝘅𝗮𝗺𝗽𝗹𝗲.𝗰𝗼𝗺"),
        ("email", "ⓙⓞⓗⓝ@example.com"),
        ("email", "𝒥ohn＠ｅxample．com"),
        ("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨"),
        ("phone", "+𝟏 𝟓𝟓𝟓 𝟏𝟐𝟑 𝟒𝟓𝟔𝟕"),
        ("phone", "+४४ २० ७९४६ ०९५८"),
        ("ip", "１９２.𝟭𝟲𝟴.٠.١"),
        ("email", "john punto smith arroba example punto com"),
        ("email", "john arroba example.com"),
        ("email", "john punkt smith at example punkt com"),
        ("email", "john point smith arobase example point com"),
        ("email", "john_at_example_dot_com"),
        ("email", "john_smith_AT_mail_dot_example_DOT_com"),
    ],
)
def test_disguises_of_unicode_and_of_four_languages(kind, part):
    text = f"é, write to: {part} (soon)"
    plain, every = pii.spans(text)
    assert plain == [] and [s for s in every if s[0] == kind] == [(kind, text.index(part), text.index(part) + len(part))]


def test_every_decimal_digit_and_no_usual_sign_is_taken_for_ascii():
    import sys
    import unicodedata

    table = pii._homoglyphs()
    for code in range(0x250, sys.maxunicode + 1):
        digit = unicodedata.decimal(chr(code), None)
        assert digit is None or table[code] == str(digit)
    assert not any(chr(c) in "ªº²³¹éñßÀ" for c in table) and all(len(v) == 1 and v.isascii() for v in table.values())


@pytest.mark.parametrize(
    "text",
    ["en este punto com mucho, a un punto del centro", "à ce point de vue, un point com", "Punkt für Punkt at", "look_at_me and dot_com_at_all",
     "1º de mayo, 10² m, nº 5 punto 3", "una arroba de trigo punto", "the man at work is dot. at night dot com", "one two three go", "uno de dos", "", "see section 1 dot 2", "plus one more"],
)
def test_prose_is_left_alone(text):
    assert pii.spans(text) == ([], []) and pii.masked(text) == text


def test_offsets_through_every_rewrite():
    rng = random.Random(9)
    for _ in range(2_000):
        copy = pii.Copy("".join(rng.choice("abc") for _ in range(30)))
        origin = [(k, k + 1) for k in range(30)]
        for _ in range(3):
            edits, at = [], 0
            while (start := at + rng.randint(0, 6)) < len(copy.text) - 3:
                at = start + rng.randint(1, 3)
                edits.append((start, at, "xyz"[: rng.randint(0, 3)]))
            new, done = [], 0
            for a, b, put in edits:
                new += origin[done:a] + [(origin[a][0], origin[b - 1][1])] * len(put)
                done = b
            origin = new + origin[done:]
            copy.rewrite(edits)
            assert [(copy.start(k), copy.end(k + 1)) for k in range(len(copy.text))] == origin


def test_long_texts_take_linear_time():
    texts = ["1" * 200_000, "a" * 200_000, "a@" * 100_000, "+1 " * 70_000, "1.1.1." * 30_000, "one two " * 40_000]
    texts += ["a_" * 100_000 + "at_b", "_at_" * 50_000, "a_at_b_dot_" * 20_000, " punto x arroba y" * 20_000, "é point " * 30_000]
    texts += ["a.b" * 70_000 + "@x.y", " at x dot " * 20_000, "1-" * 100_000, "0" * 200_000 + ".1.1.1"]
    started = time.time()
    for text in texts:
        pii.spans(text)
    assert time.time() - started < 20


def test_table_of_documents(spark):
    rows = [(1, "a@b.cd, a at b dot cd"), (2, None), (3, ""), (None, "10.0.0.1"), (1, "a@b.cd, a at b dot cd")]
    found = pii.find_pii(clashing(documents(spark, rows)))
    assert found.count() == 5
    got = by_id(found)
    assert got[1].spans == "email:0:6,email:8:21" and got[1].n_email == 2 and got[1].n_added == 1
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert got[None].n_ip == 1
    masked = pii.mask_pii(clashing(documents(spark, rows)), keep=("doc_id", "text", "fp"))
    assert by_id(masked)[1].text == "[EMAIL], [EMAIL]" and by_id(masked)[2].text is None
    assert pii.find_pii(documents(spark, [])).collect() == []


def test_a_longer_disguised_span_is_added_to_the_plain_part_of_it():
    for kind, text in (("phone", "+44 20 7946 0 nine five eight"), ("email", "anna@mail.example [dot] com"), ("email", "john [dot] smith@x.com")):
        plain, every = pii.spans(f"see {text}, please")
        assert len(plain) == 1 and set(plain) < set(every) and (kind, 4, 4 + len(text)) in every
        assert pii.masked(f"see {text}, please") == f"see [{kind.upper()}], please"
