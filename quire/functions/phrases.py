"""Column functions that phrase numbers and name lists for people."""

from pyspark.sql import Column, functions as F


def human(n: Column) -> Column:
    """Bytes as a person says them: one decimal under ten of a unit past bytes."""
    n = n.cast("double")

    def said(unit, power):
        v = n / float(1024**power)
        whole = F.format_string("%d " + unit, F.floor(v + 0.5).cast("long"))
        if power == 0:
            return whole
        tenth = F.format_string("%.1f " + unit, F.floor(v * 10 + 0.5) / 10)
        return F.when(v < 10, tenth).otherwise(whole)

    return (
        F.when(n < 1024, said("B", 0))
        .when(n < 1024.0**2, said("KB", 1))
        .when(n < 1024.0**3, said("MB", 2))
        .otherwise(said("GB", 3))
    )


def few(names: Column, most: int = 3) -> Column:
    """'a, b, c and 4 more'."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    extra = F.size(names) - most
    return F.when(extra > 0, F.concat(shown, F.lit(" and "), extra.cast("string"), F.lit(" more"))).otherwise(shown)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
