"""Field configuration (H28, H29) against plain-Python definitions."""

from lakeshore.operators.config import config_frame, entity_columns, trimmed

CFG = {
    " SRC-A ": {"processing": {"split_columns": [" trading_partner_code ", "period"]},
                "column": {"flow": {"type": " String ", "is_true": True}, "year": {"type": "Int8", "is_true": False}}},
    "SRC-B": ["year", " reporter_code"],
    "SRC-C": {"distinct_fields": ["x"]},
}


def test_trimmed():
    assert trimmed({" a ": [" x ", {"b\n": "\t y z "}], "": "  ", "q": ' say "hi" ', "n": 1}) == {
        "a": ["x", {"b": "y z"}], "": "", "q": 'say "hi"', "n": 1}


def test_config_frame(spark):
    rows = {r.entity: r for r in config_frame(spark, CFG).collect()}
    assert rows["SRC-A"].split_columns == ["trading_partner_code", "period"]
    assert rows["SRC-B"].distinct_fields == ["year", "reporter_code"]
    assert [tuple(c) for c in rows["SRC-A"].contract] == [("flow", "String", True), ("year", "Int8", False)]


def test_entity_columns(spark):
    ents = spark.createDataFrame(
        [("orders", [{"id": "Int64"}, {"sku": "String"}, {"qty": "Int8"}], ["id", "sku"]),
         ("empty", [], None)],
        "entity string, columns array<map<string,string>>, uniqueTogether array<string>")
    got = sorted(tuple(r) for r in entity_columns(ents).collect())
    assert got == [("orders", "id", "Int64", True), ("orders", "qty", "Int8", False), ("orders", "sku", "String", True)]
