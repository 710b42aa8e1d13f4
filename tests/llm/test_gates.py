"""The cheap tests before the detectors of personal information let through whatever the detectors take."""

import itertools

from terrawing.llm import pii

CASES = (str, str.upper, str.title)


def labels():
    part, gap = ("", "s"), (" ", "_", "-", "")
    yield from ("ssn", "sin", "nino", "dni", "nie", "nif", "cpf", "pesel", "bsn", "curp", "rut", "aadhaar", "aadhar", "passport", "personnummer", "steuer-id", "steuerid", "insurance")
    yield from (f"{a}{g}{b}" for a, b in (("social", "security"), ("national", "insurance")) for g in gap)
    yield from (f"ni{g}{w}" for g in gap for w in ("no", "nr", "number"))
    yield from (f"{a}{g}{w}" for a in ("tax", "taxpayer") for g in gap for w in ("id", "no", "number", "identification"))
    yield from (f"{a}{g}{w}" for a in ("personal", "national", "citizen", "identity", "id") for g in gap for w in ("id", "identity", "identification", "card", "code", "number", "no"))
    yield from (f"{a}{g}{w}" for a in ("driver", "drivers", "driver's", "driving") for g in gap for w in ("license", "licence"))


def test_labelled_numbers_with_and_without_their_gate():
    n = 0
    for label, case, tail, head in itertools.product(labels(), CASES, (": ", " number: ", "_no=", " = \"", " # "), ("", "sin id ", "x_", "using ")):
        t = f"{head}{case(label)}{tail}123-45-6789, end"
        want = [m.span(1) for m in pii._LABELLED.finditer(t)]
        assert list(pii.labelled_numbers(t)) == want, t
        n += bool(want)
    assert n > 2000
    for t in ("SIN: 123-45-6789", "RUT: 12345678", "ID number: 12345678", "id_no=12345678", "driving licence: AB123456", "drivers license: 12345678", "driver_license: 12345678", "\u017f\u0131n: 12345678", "\u0130D no: 12345678"):
        assert len(list(pii.labelled_numbers(t))) == 1, t


def disguises():
    shut = {"[": "]", "(": ")", "{": "}", "<": ">"}
    for (a, b), pad, word in itertools.product(shut.items(), ("", " ", "\t", "   "), ("at", "@", "dot", "punkt", "point", ".", "plus")):
        yield f"jo{a}{pad}{word}{pad}{b}ex.org"
    yield from (f"jo{x}ex.org" for x in ("%40", "&#64;", "&#x40;", "&#064;", "&commat;", "\\u0040", "\\x40", "%2e", "&period;", "&#46;", "&plus;"))
    yield from (f"jo{g}{a}{h}ex{g}dot{h}org" for g in (" ", "\t", "  ") for h in (" ", "\t") for a in ("at", "AT", "At"))
    yield from (f"jo{g}AT{g}ex.org" for g in (" ", "\t", "   "))
    yield from (f"jo@ex{g}dot{g}org" for g in (" ", "\t", "   "))
    yield from (f"a{c}b" for c in [*pii.INVISIBLE, *pii.LOOKALIKES, *(x.swapcase() for x in pii.LOOKALIKES), "\uff01", "\uff5e", "\u00b5"])
    for sep in (" ", ", ", "-", "\n"):
        yield from (sep.join(words) for words in (["one"] * 7, ["nine", "oh"] * 5, list(pii.DIGITS)[:8], ["\u017feven"] * 8, ["zero"] * 15, ["415", "one", "two", "one", "0151"], ["double", "one", "triple", "two", "nine"] * 2, ["plus", "four", "four", "two", "oh", "7946", "0018"]))


def test_normal_text_with_and_without_its_gate(monkeypatch):
    texts = [case(t) for t in disguises() for case in CASES]
    gated = [pii.normalise(t) for t in texts]
    monkeypatch.setattr(pii, "_disguised", lambda text: True)
    assert [(n.text, [n.back(i) for i in range(len(n.text))]) for n in gated] == [(n.text, [n.back(i) for i in range(len(n.text))]) for n in map(pii.normalise, texts)]
    assert sum(n.text != t for n, t in zip(gated, texts)) > 300


def test_disguises_that_were_passed_over():
    for t in ("jo( at )ex.org", "jo[ at ]ex.org", "jo{AT}ex.org", "jo<AT>ex.org", "jo[plus]x@ex.org"):
        assert [x[0] for x in pii.find(t)] == ["email"], t
    assert pii.normalise("ONE TWO ONE TWO ONE TWO ONE").text == "1212121"
