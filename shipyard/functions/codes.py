"""Column functions that normalise codes (message, command, phase, machine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_type(c: str | Column) -> Column:
    """Upper-cased known message type; anything else (and NULL) is UNKNOWN."""
    up = F.upper(_c(c))
    return F.when(up.isin(*S.MESSAGE_TYPES, S.UNKNOWN), up).otherwise(F.lit(S.UNKNOWN))


def phase_type(c: str | Column) -> Column:
    up = F.upper(_c(c))
    return F.when(up.isin(*S.PHASE_TYPES, S.UNKNOWN), up).otherwise(F.lit(S.UNKNOWN))


def command(c: str | Column) -> Column:
    """Exact (case-sensitive) command text to its code; anything else is UNKNOWN."""
    expr = F.lit(S.UNKNOWN)
    for text, code in reversed(list(S.COMMANDS.items())):
        expr = F.when(_c(c) == F.lit(text), F.lit(code)).otherwise(expr)
    return expr


def machine_type(c: str | Column) -> Column:
    """LINUX when the text is "linux" in any case, else WINDOWS; NULL stays NULL."""
    return (F.when(_c(c).isNull(), F.lit(None).cast("string"))
            .when(F.lower(_c(c)) == "linux", F.lit(S.MACHINE_LINUX))
            .otherwise(F.lit(S.MACHINE_WINDOWS)))


def is_balancer_recipe(c: str | Column) -> Column:
    return F.coalesce(_c(c).isin(*S.BALANCER_RECIPES), F.lit(False))


def is_database_action(status_complete: str | Column) -> Column:
    return F.coalesce(_c(status_complete).isin(*S.DATABASE_ACTIONS), F.lit(False))
