"""Column functions over raw text pieces and pictures as an extractor gives them."""

from pyspark.sql import Column, functions as F

from quire import constants as K
from quire.functions import geometry as G, text as T

# What a font's name says.
BOLD_NAME = r"(?i)bold|black|heavy|-bd"
ITALIC_NAME = r"(?i)italic|oblique|-it"
SYMBOLIC_NAME = r"(?i)wingding|dingbat|symbol|webding"
PICTURE_NAME = r"(?i)wingding|webding"
SYMBOL_BULLET = "\uf0b7"

# Characters that reach above the x-height, below the baseline,
# or stay between the two.
TALL = r"""[A-Z0-9bdfhklt|/\\()\[\]{}!?"'*#$&@£€%]"""
DESCENDING = r"[gjpqy()\[\]{}/|\\,;_@JQ]"
XHEIGHT_ONLY = r"[acemnorsuvwxz]"


def font_facts(name: Column, bold_flag: Column, italic_flag: Column) -> Column:
    """struct(font, bold, italic) of a face: the subset prefix is not its name."""
    font = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[^+]*\+", "")
    return F.struct(
        font.alias("font"),
        (F.coalesce(bold_flag, F.lit(False)) | font.rlike(BOLD_NAME)).alias("bold"),
        (F.coalesce(italic_flag, F.lit(False)) | font.rlike(ITALIC_NAME)).alias("italic"),
    )


def clean_text(raw: Column, font: Column) -> Column:
    """struct(text, lead, trail): spaces collapsed, lone picture glyphs as bullets,
    characters no font names as U+FFFD. text is '' for a blank piece."""
    flat = T.ws_collapse(raw)
    text = T.ws_trim(flat)
    lone = (F.length(text) == 1) & ~T.bullet_only(text)
    glyph = F.when(lone & (font.rlike(PICTURE_NAME) | (text == SYMBOL_BULLET)), F.lit("•")).otherwise(text)
    return F.struct(
        F.regexp_replace(glyph, r"\p{Cc}", "\ufffd").alias("text"),
        F.startswith(flat, F.lit(" ")).alias("lead"),
        F.endswith(flat, F.lit(" ")).alias("trail"),
    )


def clean_runs(raw):
    """Raw pieces to runs: blank ones and ones with no size go."""
    facts = font_facts(F.col("font"), F.col("bold"), F.col("italic"))
    return (
        raw.withColumn("_f", facts)
        .withColumn("_t", clean_text(F.col("text"), F.col("_f.font")))
        .where((F.col("_t.text") != "") & (F.col("size") > 0))
        .withColumns(
            {
                "text": F.col("_t.text"),
                "lead": F.col("_t.lead"),
                "trail": F.col("_t.trail"),
                "font": F.col("_f.font"),
                "bold": F.col("_f.bold"),
                "italic": F.col("_f.italic"),
            }
        )
        .drop("_t", "_f")
    )


def ink(text: Column, font: Column, size: Column, ascent: Column, descent: Column) -> Column:
    """struct(low, high): where the ink reaches about the baseline, up positive."""
    up = F.when(ascent > 0, ascent).otherwise(K.DEFAULT_ASCENT)
    down = F.when(descent < 0, descent).otherwise(K.DEFAULT_DESCENT)
    tall = text.rlike(TALL)
    unknown = font.rlike(SYMBOLIC_NAME) | ~(tall | text.rlike(XHEIGHT_ONLY))
    middle, reach = (up + down) / 2 * size, (up - down) * size / 4
    return F.struct(
        F.when(unknown, middle - reach)
        .when(text.rlike(DESCENDING), size * K.DESCENDER)
        .otherwise(F.lit(0.0))
        .alias("low"),
        F.when(unknown, middle + reach)
        .otherwise(F.when(tall, K.CAP_HEIGHT).otherwise(K.X_HEIGHT) * size)
        .alias("high"),
    )


def run_box(text, font, matrix: Column, width, height, vertical, ascent, descent, page_height) -> Column:
    """struct(box, base, size) from a piece's matrix [a,b,c,d,e,f] in page space, y up.

    A vertical face reports its two lengths the other way round: its width is
    the size and its height how far it runs down.
    """
    a, b, c, d, e, f = [matrix[i] for i in range(6)]
    size = F.when(vertical, width).otherwise(height)
    tall_axis = F.hypot(c, d)
    tall_axis = F.when(tall_axis == 0, size).otherwise(tall_axis)
    wide_axis = F.hypot(a, b)
    wide_axis = F.when(wide_axis == 0, tall_axis).otherwise(wide_axis)
    reach = ink(text, font, size, ascent, descent)
    t0 = F.when(vertical, -size / 2).otherwise(F.lit(0.0))
    t1 = F.when(vertical, size / 2).otherwise(width)
    y0 = F.when(vertical, -height).otherwise(reach["low"])
    y1 = F.when(vertical, F.lit(0.0)).otherwise(reach["high"])

    def at(t, y):
        return (
            e + t * a / wide_axis + y * c / tall_axis,
            page_height - (f + t * b / wide_axis + y * d / tall_axis),
        )

    corners = [at(t, y) for t in (t0, t1) for y in (y0, y1)]
    return F.struct(
        G.around(F.array(*[p[0] for p in corners]), F.array(*[p[1] for p in corners])).alias("box"),
        (page_height - f).alias("base"),
        size.cast("double").alias("size"),
    )


def keep_pictures(pictures):
    """Pictures clipped to their page (page_w, page_h), decoration left out."""
    b = F.col("box")
    x, y = F.greatest(b["x"], F.lit(0.0)), F.greatest(b["y"], F.lit(0.0))
    clipped = G.box(
        x, y, F.least(G.right(b), F.col("page_w")) - x, F.least(G.bottom(b), F.col("page_h")) - y
    )
    w, h = F.col("box.w"), F.col("box.h")
    known = F.col("px_w").isNotNull()
    few = (F.col("px_w") < K.MIN_PICTURE_PX) | (F.col("px_h") < K.MIN_PICTURE_PX)
    small = (w < K.BIG_ENOUGH_PT) | (h < K.BIG_ENOUGH_PT)
    decoration = known & ((F.col("px_w") * F.col("px_h") <= 1) | (few & small))
    return (
        pictures.withColumn("box", clipped)
        .where((w >= K.MIN_PICTURE_PT) & (h >= K.MIN_PICTURE_PT) & ~F.coalesce(decoration, F.lit(False)))
        .withColumn("box", G.rounded(F.col("box")))
    )
