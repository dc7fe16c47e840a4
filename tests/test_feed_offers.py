from valora.sources import evidence as ev


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feed_items_are_read_once(spark):
    """one reading of an item, no join to find the first of a name; feeds are dealt out."""
    payload = """[{"id_producto": 1, "nombre": " a ", "precioEspecial": 0, "precioLista": 2.5},
      {"id_producto": 2, "nombre": "a", "precioEspecial": "9", "precioLista": 1}, 7, "{", {"nombre": "b", "precioLista": 5},
      {"id_producto": null, "nombre": "c", "precioEspecial": "x", "precioLista": 3}, {"id_producto": 3, "nombre": 4, "precioLista": 5},
      {"id_producto": 4, "nombre": "d", "precioEspecial": "", "precioLista": 6}, {"id_producto": 5, "nombre": null, "precioLista": 5}]"""
    feeds = spark.createDataFrame([(1, payload), (2, "broken"), (None, payload)], "feed_id int, payload string")
    found = ev.feed_offers(feeds)
    assert "Join" not in plan(found) and "RepartitionByExpression" in plan(found)
    rows = sorted((r.feed_id or 0, r.position, r.service_raw, r.price_raw, r.price) for r in found.collect())
    want = [(0, "a", "2.5", 2), (7, "d", "6", 6)]
    assert rows == [(f, *w) for f in (0, 1) for w in want]
