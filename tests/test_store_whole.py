"""u1_store stores all phrases, not the first few."""

from mnemolake import catalog

from .conftest import DATA


def test_later_phrases_are_stored(spark):
    ids = [r.id for r in catalog.QUERIES["u1_store"](spark, f"{DATA}/sf0.001").select("id").collect()]
    assert len(ids) == len(set(ids)) and any(i.startswith("n") and int(i[1:]) >= 240 for i in ids)
