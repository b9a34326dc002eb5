import pytest

from heliodor.functions.values import DataType, Number, from_wire, shown, to_wire


@pytest.mark.parametrize("text,units,scale", [("12.20", 1220, 2), ("-0.5", -5, 1), (".50", 50, 2), ("+7", 7, 0), ("0." + "0" * 37 + "1", 1, 38)])
def test_parse(text, units, scale):
    n = Number.parse(text)
    assert (n.units, n.scale) == (units, scale)


@pytest.mark.parametrize("text", ["", ".", "1.", "1e5", "१", "1" * 39, "0." + "1" * 39, "- 1", "1.2.3"])
def test_refused(text):
    with pytest.raises(ValueError):
        Number.parse(text)


@pytest.mark.parametrize(
    "text,p,s,fits",
    [("12.20", 3, 1, True), ("12.25", 3, 1, False), ("12.20", 2, 1, False), ("99", 2, 0, True), ("100", 2, 0, False), ("1.00", 1, 0, True), ("0.00", 1, 1, True), ("5", 2, 2, False), ("9" * 38, 38, 0, True), ("-9.9", 2, 1, True)],
)
def test_fits(text, p, s, fits):
    assert Number.parse(text).fits(p, s) is fits


def test_order_and_text():
    assert Number.parse("1.50") == Number.parse("1.5") and hash(Number.parse("1.50")) == hash(Number.parse("1.5"))
    assert Number.parse("-2.5") < Number.parse("-2.49") < Number.parse("0.0") < Number.parse("1" * 38)
    assert Number.parse("0." + "0" * 37 + "1") > Number.parse("0")
    for text in ("12.20", "-0.05", "7", "0.0", "1" * 38):
        assert str(Number.parse(text)) == text
    assert shown(None) == "NULL" and shown(True) == "true" and shown("") == ""


@pytest.mark.parametrize("text", ["FLOAT", "DECIMAL", "DECIMAL(0,0)", "DECIMAL(39,0)", "DECIMAL(3,4)", "DECIMAL(-1,0)", "VARCHAR(3)"])
def test_types_refused(text):
    with pytest.raises(ValueError):
        DataType.parse(text)


def test_wire():
    for value in (None, 1, -(2**63), "é\n", True, Number.parse("12.20")):
        assert from_wire(to_wire(value)) == value
    for bad in ({"Decimal": 1.5}, {"Integer": True}, {"Integer": "1"}, 5, {}, {"Float": 1}):
        with pytest.raises(ValueError):
            from_wire(bad)
