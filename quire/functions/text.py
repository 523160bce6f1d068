"""Column functions over text: markers, labels, markdown escapes, letters."""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quire import constants as K

# The glyphs a bullet is set in, and the ones that need a space after.
BULLETS = "■□▪▫●○◦•‣⁃◆◇❏❑❒❘❙❚❖➥"
DASHES = r"\-–—·*"

# The marker grammars.
BULLET_RE = rf"^(?:[{BULLETS}]{K.WS}*|[{DASHES}]{K.WS}+)"
NUMBER_RE = rf"^\(?(\d{{1,3}})[.)]{K.WS}+"
ROMAN_RE = rf"(?i)^\(?(x{{0,3}}(?:ix|iv|v?i{{0,3}}))[.)]{K.WS}+"
ALPHA_RE = rf"^\(?([a-zA-Z])[.)]{K.WS}+"
# What every head above starts with, all in one: a numeral of x{0,3} and ix, iv or v?i{0,3}
# has seven letters at most.
HEAD_RE = rf"^(?:[{BULLETS}{DASHES}]|\(?(?:\d{{1,3}}|[a-zA-Z]|[ivxIVX]{{2,7}})[.)]{K.WS})"
BULLET_ONLY_RE = rf"^[{BULLETS}{DASHES}]+$"
MARKER_ONLY_RE = r"(?i)^\(?(?:\d{1,3}|[ivxlcdm]{1,5}|[a-z])[.)]$"

# What a page number looks like.
LABEL_ROMAN = r"(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_LABEL_EDGE = rf"[{K.WS_IN_CLASS}\-–—|·.]*"
LABEL_RE = (
    rf"(?i)^{_LABEL_EDGE}(?:page{K.WS}+|p\.{K.WS}*)?(\d{{1,4}}|{LABEL_ROMAN})"
    rf"(?:{K.WS}*(?:of|/){K.WS}*(?:\d{{1,4}}|{LABEL_ROMAN}))?{_LABEL_EDGE}$"
)


def ws_trim(text: Column) -> Column:
    """Trim every Unicode space, not only blanks. Only text with a space at an edge is
    searched; $ may lie before a last line break, so three characters tell the end."""
    edge = F.left(text, F.lit(1)).rlike(K.WS) | F.right(text, F.lit(3)).rlike(f"{K.WS}$")
    return F.when(edge, F.regexp_replace(text, rf"^{K.WS}+|{K.WS}+$", "")).otherwise(text)


def ws_collapse(text: Column) -> Column:
    """Each stretch of Unicode spaces to one blank; a lone blank is not touched. Only text
    with two blanks together or a space that is no blank is searched, ASCII text for few."""
    ascii_only = F.octet_length(text) == F.length(text)
    odd = F.when(ascii_only, text.rlike(r"[\t-\r]")).otherwise(text.rlike(rf"[{K.WS_IN_CLASS}&&[^ ]]"))
    collapsed = F.regexp_replace(text, rf"{K.WS}{{2,}}|(?! ){K.WS}", " ")
    return F.when(F.contains(text, F.lit("  ")) | odd, collapsed).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character past U+FFFF counts twice. ASCII text, as many
    bytes as characters, is not encoded for it."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def bind(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def half_up(value: Column) -> Column:
    """Round half toward plus infinity."""
    return F.floor(value + 0.5)


# ---- list markers -----------------------------------------------------------


def marker_head(text: Column) -> Column:
    """struct(role, head): the first grammar that matches and what it took."""
    bullet = F.regexp_extract(text, BULLET_RE, 0)
    number = F.regexp_extract(text, NUMBER_RE, 0)
    roman = F.regexp_extract(text, ROMAN_RE, 0)
    alpha = F.regexp_extract(text, ALPHA_RE, 0)

    def found(role, head):
        return F.struct(F.lit(role).alias("role"), head.alias("head"))

    return (
        F.when((bullet != "") & (F.length(bullet) < F.length(text)), found("bullet", bullet))
        .when(number != "", found("numbered", number))
        .when(F.regexp_extract(text, ROMAN_RE, 1) != "", found("roman", roman))
        .when(alpha != "", found("alpha", alpha))
        .otherwise(found("", F.lit("")))
    )


def marker_role(text: Column) -> Column:
    """Only the role. One cheap test rules out most lines of prose. The grammars are bound,
    which keeps them out of the generated code: a method over 8,000 bytes isn't compiled."""
    return F.when(text.rlike(HEAD_RE), bind(text, lambda t: marker_head(t)["role"])).otherwise(F.lit(""))


def marker_of(text: Column) -> Column:
    """struct(role, marker, rest): the list marker a line starts with."""
    none = F.struct(F.lit("").alias("role"), F.lit("").alias("head"))
    return bind(
        F.when(text.rlike(HEAD_RE), marker_head(text)).otherwise(none),
        lambda head: F.struct(
            head["role"].alias("role"),
            ws_trim(head["head"]).alias("marker"),
            F.when(head["role"] == "", text)
            .otherwise(ws_trim(text.substr(F.length(head["head"]) + 1, F.length(text))))
            .alias("rest"),
        ),
    )


def bullet_only(text: Column) -> Column:
    return text.rlike(BULLET_ONLY_RE)


def marker_only(text: Column) -> Column:
    return text.rlike(MARKER_ONLY_RE)


def roman_value(numeral: Column) -> Column:
    """Subtractive sum of a lower or upper case numeral over i, v, x, l, c.

    A digit standing before a larger one counts against the sum; folding from
    the right needs only the digit seen last.
    """
    letters = F.split(F.reverse(F.lower(numeral)), "")
    digit = F.create_map(
        *[F.lit(v) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)) for v in pair]
    )
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("right"))

    def add(acc, ch):
        v = digit[ch]
        return F.struct(
            (acc["sum"] + F.when(v < acc["right"], -v).otherwise(v)).alias("sum"),
            v.alias("right"),
        )

    return F.aggregate(F.filter(letters, lambda c: c != ""), start, add)["sum"]


def printed_value(role: Column, marker: Column) -> Column:
    """The number an item's marker says, by its role; NULL when it says none."""
    inside = F.regexp_extract(ws_trim(marker), r"^\(?([^().]+)[.)]$", 1)
    return (
        F.when((role == "numbered") & inside.rlike(r"^\d{1,3}$"), inside.try_cast("int"))
        .when((role == "alpha") & inside.rlike("^[a-zA-Z]$"), F.ascii(F.lower(inside)) - 96)
        .when((role == "roman") & inside.rlike("(?i)^[ivxlc]+$"), roman_value(inside))
    )


# ---- furniture text ---------------------------------------------------------


def printed(marker: Column, text: Column) -> Column:
    """The block as the page prints it: its marker put back."""
    return F.when(F.coalesce(marker, F.lit("")) != "", F.concat(marker, F.lit(" "), text)).otherwise(text)


def page_label(text: Column) -> Column:
    """The page number a line prints, lower case, or NULL."""
    return F.lower(F.nullif(F.regexp_extract(ws_trim(text), LABEL_RE, 1), F.lit("")))


def has_letter(text: Column) -> Column:
    """Whether a text has a wording: cheaper to ask than the wording itself."""
    return text.rlike(r"\p{L}")


def wording(text: Column) -> Column:
    """A line with its numbers wildcarded; '' when it holds no letter."""
    key = F.trim(bind(F.regexp_replace(F.lower(text), r"\d+", "#"), ws_collapse))
    return F.when(has_letter(text), key).otherwise(F.lit(""))


# ---- markdown ---------------------------------------------------------------


def escape_md(text: Column) -> Column:
    """Escape what would read as markup: everywhere, or only opening a line."""
    out = F.regexp_replace(text, r"[\\`*_\[\]<&~]", r"\\$0")
    out = F.regexp_replace(out, r"^([#>+-])", r"\\$1")
    return F.regexp_replace(out, r"^(\d{1,9})([.)])", r"$1\\$2")


def link_target(url: Column) -> Column:
    """A URL as a markdown destination: unsafe characters as %XX by code."""
    chars = F.split(url, "")
    safe = F.transform(
        chars,
        lambda c: F.when(
            c.rlike(rf"^[{K.WS_IN_CLASS}<>()\\]$"),
            F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0")),
        ).otherwise(c),
    )
    needs = url.rlike(rf"[{K.WS_IN_CLASS}<>()\\]")
    return F.when(needs, F.array_join(safe, "")).otherwise(url)


def inline_md(role: Column, text: Column, href: Column, bold: Column, italic: Column) -> Column:
    """A block's words as markdown: escaped, linked, and emphasised whole."""
    trimmed = ws_trim(text)
    esc = escape_md(trimmed)
    heading = role == "heading"
    esc = F.when(heading, F.regexp_replace(esc, rf"({K.WS})(#+)$", r"$1\\$2")).otherwise(esc)
    linked = F.when(
        F.coalesce(href, F.lit("")) != "",
        F.concat(F.lit("["), esc, F.lit("]("), link_target(href), F.lit(")")),
    ).otherwise(esc)
    strong = F.when(bold & ~heading, F.concat(F.lit("**"), linked, F.lit("**"))).otherwise(linked)
    both = F.when(italic & ~heading, F.concat(F.lit("*"), strong, F.lit("*"))).otherwise(strong)
    return F.when(trimmed == "", F.lit("")).otherwise(both)


def heading_md(level: Column, text: Column) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.when(F.coalesce(level, F.lit(0)) == 0, 2).otherwise(level)))
    return F.concat(F.repeat(F.lit("#"), n.cast("int")), F.lit(" "), text)


def comment_md(text: Column) -> Column:
    return F.concat(F.lit("<!-- "), F.replace(text, F.lit("-->"), F.lit("-- >")), F.lit(" -->"))


def figure_name(page: Column, index: Column) -> Column:
    return F.format_string("p%d-i%d.png", page, index)


def figure_md(page: Column, index: Column, assets: Column, path: Column) -> Column:
    """A picture's markdown, NULL when the picture was not kept."""
    return F.when(
        path.isNotNull(),
        F.concat(
            F.format_string("![page %d figure %d](", page, index + 1),
            link_target(F.concat(assets, path)),
            F.lit(")"),
        ),
    )


# ---- letters, words, plain --------------------------------------------------


def letters_of(text: Column) -> Column:
    """Every letter and digit, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]"), F.lit(0))


_COUNTS = ArrayType(StructType().add("ch", StringType()).add("n", IntegerType()))
LOW = 0x250  # characters below are counted in a table, others by sorting


def count_characters(texts: pa.Array) -> pa.Array:
    """Of each text every character in it and how often it comes; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, ends = len(texts), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends - ends[0]]
    which, found = np.repeat(np.arange(n), np.diff(begins)), []
    step = 4096  # texts whose tables are held at a time
    for a in range(0, n, step):
        b = min(n, a + step)
        own = slice(begins[a], begins[b])
        p, w = points[own], which[own]
        common = p < LOW
        table = np.bincount((w[common] - a) * LOW + p[common], minlength=(b - a) * LOW)
        at = np.flatnonzero(table)
        key, count = np.unique(w[~common] << 21 | p[~common], return_counts=True)
        found.append((np.concatenate([at // LOW + a, key >> 21]), np.concatenate([at % LOW, key & 0x1FFFFF]), np.concatenate([table[at], count])))
    w, p, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(w, kind="stable")
    letters = pa.array(list(p[order].astype("<u4").tobytes().decode("utf-32-le")), pa.string())
    edges = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([letters, pa.array(c[order].astype(np.int32))], ["ch", "n"]))


@F.arrow_udf(_COUNTS)
def _characters(text: pa.Array) -> pa.Array:
    return count_characters(text)


def letter_histogram(text: Column) -> Column:
    """(ch, n) of every letter and digit of a text, lower case. Characters are counted
    in arrays; which of them are letters is asked once for each, not at each place."""
    return F.filter(_characters(F.lower(text)), lambda c: c["ch"].rlike(r"^[\p{L}\p{N}]$"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words_marked(text: Column) -> Column:
    """Lower case, each character past ASCII that is no letter or digit a blank: what
    ``cut_words`` takes. ASCII text, as many bytes as characters, is not searched."""
    odd = r"[^\x00-\x7f\p{L}\p{N}]"
    return bind(
        F.lower(text), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, odd, " "))
    )


_IN_WORD = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word of ``words_of``, told from marked texts: its text, its place in it, and
    itself. All texts are cut at once; no word reaches into the next text."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    inside = _IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    at, upto = np.flatnonzero(begins), np.concatenate([[0], np.cumsum(inside)])
    edges = pa.py_buffer(np.append(upto[at], upto[-1]).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, edges, pa.py_buffer(raw[inside])])
    which = np.searchsorted(ends, at, "right") - 1
    n = np.bincount(which, minlength=len(texts))
    return which, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), words


@F.pandas_udf(StringType())
def _strip_marks(text: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M"))

    return text.map(one)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


_NOT_ASCII = r"[^\x00-\x7f]"


def nfc(text: Column) -> Column:
    """NFC. Only text that is not ASCII crosses to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_NOT_ASCII), text)), text)


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        apart = unicodedata.normalize("NFD", "".join(c.lower()[0] for c in s))
        return unicodedata.normalize("NFC", "".join(c for c in apart if not unicodedata.category(c).startswith("M")))

    return text.map(one)


def folded(text: Column) -> Column:
    """Lower case and without accents, all else as it stands. Only text that is not
    ASCII crosses to Python."""
    return F.coalesce(_fold(F.when(text.rlike(_NOT_ASCII), text)), F.lower(text))


def plain(text: Column) -> Column:
    """Letters and digits only, lower case, accents off.

    ASCII text never leaves the JVM; what does crosses after its punctuation
    and spaces are gone.
    """
    bare = F.coalesce(_strip_marks(F.when(text.rlike(_NOT_ASCII), text)), text)
    return F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]", "")


# ---- links and comments -----------------------------------------------------


def safe_url(url: Column) -> Column:
    """Keep a relative URL or one of a safe scheme; '' otherwise."""
    colon = F.instr(url, ":")

    def before_colon(mark):
        at = F.instr(url, mark)
        return (at > 0) & (at < colon)

    scheme = url.substr(F.lit(1), colon - 1)
    keep = (
        (colon == 0)
        | before_colon("/")
        | before_colon("?")
        | before_colon("#")
        | scheme.rlike(r"(?i)^(https?|ircs?|mailto|xmpp)$")
    )
    return F.when(keep, url).otherwise(F.lit(""))


def is_comment(html: Column) -> Column:
    """One comment and nothing else."""
    t = ws_trim(html)
    inner = t.substr(F.lit(5), F.length(t) - 7)
    return (F.length(t) >= 7) & F.startswith(t, F.lit("<!--")) & F.endswith(t, F.lit("-->")) & ~F.contains(
        inner, F.lit("-->")
    )


def rendered_text(md: Column) -> Column:
    """Markdown as its reader sees it, by line rules rather than a parser.

    Comments and HTML tags go, an image and a link's target go, a link's words
    stay, markers other than an ordered item's number go, emphasis and escapes
    are undone. Each ordered item shows the number written for it. Text is searched
    for signs of markup first; what has none is shown as it is.
    """
    opened = lambda t: F.when(t.rlike(r"(?m)^ *(?:[>#+-]|\d)"), _without_markers(t)).otherwise(t)
    return bind(md, lambda t: F.when(t.rlike(r"[\\<\[\]*_`~\ue000]"), _without_markup(t)).otherwise(opened(t)))


def _without_markers(md: Column) -> Column:
    out = F.regexp_replace(md, r"(?m)^[ ]*(?:>[ ]?)*[ ]*(?:#{1,6}|[-+*])[ ]+", "")
    out = F.regexp_replace(out, r"(?m)^[ ]*(?:>[ ]?)*[ ]*(\d{1,9})[.)][ ]+", "$1 ")
    return F.regexp_replace(out, r"(?m)^[ ]*(?:>[ ]?)+", "")


def _without_markup(md: Column) -> Column:
    # What stands before a sign is looked at where the sign is, not at every character.
    esc = "\ue000"  # private use: stands for an escaped character's backslash
    out = F.regexp_replace(md, r"(?s)<(?<!\\<)!--.*?-->", " ")
    out = F.regexp_replace(out, r"\\([!-/:-@\[-`{-~])", esc + "$1" + esc)
    out = F.regexp_replace(out, rf"!(?<!{esc}!)\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, rf"\](?<!{esc}\])\([^)]*\)", " ")
    out = F.regexp_replace(out, rf"<(?<!{esc}<)[^>]*>", " ")
    out = F.regexp_replace(_without_markers(out), rf"[*_`~\[](?<!{esc}.)", "")
    return F.regexp_replace(out, esc, "")
