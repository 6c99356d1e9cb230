"""Tables that are sent to all tasks only if they are small."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks; larger ones are joined by a shuffle.
SMALL = 1_000_000


def sized(table: DataFrame, small: int = SMALL) -> DataFrame:
    """The table with a broadcast hint if it has at most ``small`` rows.

    It is kept, so that counting it does not make it twice. The count is one of
    all rows: a limit would move up to ``small`` rows of every partition to one task.
    """
    kept = table if table.is_cached else table.persist()
    return F.broadcast(kept) if kept.count() <= small else kept


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` has not."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
