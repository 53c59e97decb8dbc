"""Amounts that add up exactly, in whatever order they arrive.

No decimal holds both 1e25 and twenty places.  An amount is therefore a decimal of six places, which Spark keeps
through every sum and addition, and apart from it the places seven to twenty as a whole number of 10^-20, which is
NULL for the many amounts that have none.  Each is summed on its own.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.attributes import number_text

AMOUNT_TYPE, SPEND_TYPE, FINE_TYPE = "decimal(32,6)", "decimal(38,6)", "decimal(38,0)"
LARGEST = 10 ** 26 - 1
PARTS = 10 ** 20
_SIXTH = Decimal("0.000001")
# No sum of places beyond the sixth reaches this, as long as there are fewer than 10^14 rows.
_REACH = 10 ** 8


def with_amount(rows: DataFrame, text: Column, amount: str = "_amount", fine: str = "_fine") -> DataFrame:
    """Add the two parts of a number; anything missing or malformed is 0.

    Exact to twenty places below 1e18 and to six above; what has more than 26 digits counts as the largest amount.
    The steps are projections of their own, so each text is matched and parsed once.
    """
    number, exact, beyond = F.col("_number"), F.col("_exact"), F.col("_beyond")
    # Six places need no second look, and neither do texts too short for seven.
    more = (F.length(number) > 7) & F.rlike(number, F.lit("[.][0-9]{7}|[eE]"))
    parsed = (rows.withColumn("_number", number_text(text))
              .withColumn("_exact", F.when(more, number.try_cast("decimal(38,20)")))
              .withColumn("_beyond", F.nullif(exact % F.lit(_SIXTH), F.lit(Decimal(0)))))
    largest = F.lit(Decimal(LARGEST))
    plain = F.coalesce(number.try_cast(AMOUNT_TYPE),
                       F.when(number.try_cast("double") > 0, largest).when(number.isNotNull(), -largest).otherwise(0))
    return parsed.withColumns({
        amount: F.when(beyond.isNotNull(), exact - beyond).otherwise(plain).cast(AMOUNT_TYPE),
        fine: (beyond * F.lit(Decimal(PARTS))).cast("decimal(14,0)")}).drop("_number", "_exact", "_beyond")


def at_least(amount: str, fine: str, value: float) -> str:
    """SQL text: do the sums in columns ``amount`` and ``fine`` make ``value`` or more?

    A difference beyond what further places can make up is cut off there, which keeps the comparison exact.  A NULL
    amount, the sum of no rows, makes nothing; ``least`` alone would pass over it.
    """
    wanted = Decimal(repr(value))
    rest = wanted % _SIXTH
    excess = f"greatest(least({amount} - CAST('{wanted - rest}' AS {SPEND_TYPE}), {_REACH}), -{_REACH})"
    return (f"{amount} IS NOT NULL AND CAST({excess} AS decimal(15,6)) * {PARTS} + coalesce({fine}, 0) "
            f">= CAST('{int(rest * PARTS)}' AS {FINE_TYPE})")
