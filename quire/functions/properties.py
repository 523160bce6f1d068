"""Column functions over a document's own description and its outline."""

from pyspark.sql import Column, functions as F

from quire.functions import text as T

# Fixed value: how a document writes a date.
DATE_RE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Z+-])?(\d{2})?'?(\d{2})?"


def said(value: Column) -> Column:
    """Trimmed, NULL when blank."""
    return F.nullif(T.ws_trim(value), F.lit(""))


def pdf_date(value: Column) -> Column:
    """A date as documents write it, as a timestamp in UTC; NULL when it is none."""

    def part(k, default):
        return F.coalesce(F.nullif(F.regexp_extract(value, DATE_RE, k), F.lit("")), F.lit(default))

    stamp = F.concat(
        part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"),
        part(5, "00"), F.lit(":"), part(6, "00"),
    )
    away = part(8, "0").cast("int") * 3600 + part(9, "0").cast("int") * 60
    sign = F.when(part(7, "Z") == "+", -1).when(part(7, "Z") == "-", 1).otherwise(0)
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(value.rlike(DATE_RE), F.timestamp_seconds(F.unix_timestamp(local) + sign * away))


def doc_properties(info: Column, xmp_title: Column) -> Column:
    """struct of what a document says of itself: info is a map of its fields. The
    title the authoring tool wrote last wins over the info field."""

    def field(name):
        return said(F.element_at(info, name))

    return F.struct(
        F.coalesce(said(xmp_title), field("Title")).alias("title"),
        field("Author").alias("author"),
        field("Subject").alias("subject"),
        field("Keywords").alias("keywords"),
        pdf_date(field("CreationDate")).alias("created"),
        pdf_date(field("ModDate")).alias("modified"),
        field("Creator").alias("application"),
        field("Producer").alias("producer"),
        field("PDFFormatVersion").alias("version"),
    )


def outline_target(index: Column, kind: Column, args: Column, n_pages: Column) -> Column:
    """struct(page, left, top) of an explicit destination, NULL when its page is
    not one of the document's."""

    def arg(k):
        return F.get(args, F.lit(k))

    left = F.when(kind.isin("XYZ", "FitV", "FitBV", "FitR"), arg(0))
    top = F.when(kind == "XYZ", arg(1)).when(kind.isin("FitH", "FitBH"), arg(0)).when(kind == "FitR", arg(3))
    target = F.struct((index + 1).alias("page"), left.alias("left"), top.alias("top"))
    return F.when((index >= 0) & (index < n_pages), target)
