"""Orders are put down once for all portals, and the pages are those rendered from the plan itself."""

import os

from bidweave.plans import portals


def test_orders_are_put_down_once(spark):
    wanted, sf = ("hands_hi", "peoplesoft_ca"), "/root/testdata/sf0.001"
    pages, path = portals.landed_pages(spark, sf, wanted)
    assert sorted(d for d in os.listdir(f"{path}/orders") if "=" in d) == [f"source={s}" for s in wanted]
    orders, names = portals._orders(spark, sf), ["source", "page", "reported", "body"]
    assert sorted(map(tuple, pages.select(*names).collect())) == sorted(tuple(r) for s in wanted for r in portals._rendered(orders, s).select(*names).collect())
