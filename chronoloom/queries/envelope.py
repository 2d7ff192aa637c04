"""The robust envelope over every line item."""

from __future__ import annotations

from chronoloom.operators import envelope
from chronoloom.queries.base import query, table


@query("elliptic_envelope", "l_orderkey:l l_linenumber:i distance:d is_anomaly")
def elliptic_envelope(spark, d):
    return envelope.elliptic_envelope(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.05)
