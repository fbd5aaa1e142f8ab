"""Block revisions: a number, an id, or a keyword."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a node understands besides numbers and ids.
KEYWORDS = ("best", "finalized", "justified")
_ID = r"^0x[0-9a-fA-F]{64}$"


@dataclass(frozen=True)
class Revision:
    kind: str  # number, id or keyword
    value: str

    @classmethod
    def parse(cls, raw: str | int) -> Revision:
        """Trims, and lowers keywords and ids; anything else is an error that names the keywords."""
        x = str(raw).strip()
        if x.lower() in KEYWORDS:
            return cls("keyword", x.lower())
        if re.match(_ID, x):
            return cls("id", x.lower())
        if re.match(r"^\d+$", x) and int(x) < 1 << 63:
            return cls("number", str(int(x)))
        raise ValueError(f"{raw!r} is no block number, block id, or one of: {', '.join(KEYWORDS)}")

    def __str__(self) -> str:
        return self.value


def kind(raw: Column) -> Column:
    """number, id or keyword; null for what isn't a revision."""
    x = F.trim(raw)
    return F.when(F.lower(x).isin(*KEYWORDS), F.lit("keyword")).when(x.rlike(_ID), F.lit("id")).when(x.rlike(r"^\d+$") & x.try_cast("bigint").isNotNull(), F.lit("number"))


def canonical(raw: Column) -> Column:
    x = F.trim(raw)
    return F.when(kind(raw) == "number", x.try_cast("bigint").cast("string")).when(kind(raw).isNotNull(), F.lower(x))
