"""Parts of an index grow with the table, not their number; what a task holds of a part is bounded."""

from stratagraph.operators import trigrams
from stratagraph.plans import indexed
from stratagraph.plans.project import Tables

DATA = "/root/testdata/sf0.001"


def test_parts_grow_in_place_of_their_number(spark, monkeypatch):
    monkeypatch.setattr(indexed, "PART_ROWS", 8)
    monkeypatch.setattr(indexed, "PARTS", 8)
    monkeypatch.setattr(trigrams, "HELD_GRAMS", 50)
    index = indexed._texts(Tables(spark, DATA))
    texts = index.texts()
    parts = texts.select("part").distinct().count()
    assert parts <= 8 + texts.selectExpr("shiftright(part, 20) as task").distinct().count() and texts.count() == parts_rows(spark)
    found = index.search_name("customer#%0042", 12)
    assert [r["name"] for r in found.collect()] == ["Customer#000000042"]


def parts_rows(spark):
    t = Tables(spark, DATA)
    return t.symbols().count() + t.documents().count()
