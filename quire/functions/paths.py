"""Column functions over upload paths, document ids and workspace names."""

from pyspark.sql import Column, functions as F

from quire import constants as K
from quire.functions import text as T

_SAFE = r"[^\p{L}\p{M}\p{N}._ -]+"
_OWN_SUFFIX = r"(?i)\.(pdf|md|assets)$"
_ZW_JOINERS = "\u200c\u200d"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_pdf(path: Column) -> Column:
    return path.rlike(r"(?i)\.pdf$")


def is_zip(path: Column) -> Column:
    return path.rlike(r"(?i)\.zip$")


def is_manifest(path: Column, name: str = K.MANIFEST_NAME) -> Column:
    return basename(path) == name


def is_junk(path: Column) -> Column:
    """Metadata no one put there on purpose."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (
        F.array_contains(parts, "__MACOSX")
        | F.exists(folders, lambda p: F.startswith(p, F.lit(".")))
        | F.startswith(base, F.lit("._"))
        | base.isin(".DS_Store", "Thumbs.db")
    )


def names(path: Column) -> Column:
    """The names in a path: one slash, no empty, '.' or '..' name."""
    return F.filter(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")
    )


def normalize_path(path: Column) -> Column:
    return F.array_join(names(path), "/")


def _safe_chars(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.ws_trim(name), _SAFE, "-"), "-{2,}", "-")


def _trim_dots(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""), r"^\z", "untitled")


def clean_segment(name: Column) -> Column:
    """One name made safe as a file or folder: composed, cleaned, cut, trimmed."""
    return _trim_dots(_cut_graphemes(_safe_chars(T.nfc(name))))


def clean_folder(name: Column) -> Column:
    """A segment that does not end the way a document's own paths do."""
    return _no_suffix(clean_segment(name))


def _no_suffix(safe: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(safe, _OWN_SUFFIX, "-$1"), "-{2,}", "-")


def _clean_names(parts: Column, folders: bool) -> Column:
    """Names cleaned inside the array: composed beforehand, so all of it stays in the JVM."""

    def clean(p):
        safe = _trim_dots(_cut_graphemes(_safe_chars(p)))
        return _no_suffix(safe) if folders else safe

    return F.transform(parts, clean)


def _cut_graphemes(s: Column) -> Column:
    """The longest prefix of whole graphemes within the byte limit."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("used"))

    def take(acc, u):
        used = acc["used"] + F.octet_length(u)
        return F.struct(
            F.when(used <= K.MAX_SEGMENT_BYTES, F.concat(acc["kept"], u)).otherwise(acc["kept"]).alias("kept"),
            used.alias("used"),
        )

    def cut(t):
        units = F.regexp_extract_all(t, F.lit(r"\X"), F.lit(0))
        long = F.octet_length(t) > K.MAX_SEGMENT_BYTES
        return F.when(long, F.aggregate(units, start, take)["kept"]).otherwise(t)

    return T.bind(s, cut)


def clean_path(path: Column) -> Column:
    return F.array_join(_clean_names(names(T.nfc(path)), folders=True), "/")


def clean_id(path: Column) -> Column:
    """A document id: folders cleaned as folders, the last name as the document's."""
    return clean_composed_id(T.nfc(path))


def clean_composed_id(path: Column) -> Column:
    """clean_id of a path already in composed form: no Python, so usable in lambdas."""

    def clean(parts):
        n = F.size(parts)
        folders = _clean_names(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), folders=True)
        last = _clean_names(F.slice(parts, F.greatest(n, F.lit(1)), F.lit(1)), folders=False)
        return F.array_join(F.concat(folders, last), "/")

    return T.bind(names(path), clean)


def is_doc_id(value: Column) -> Column:
    return (value != "") & (clean_id(value) == value)


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(T.nfc(name)), r"[^\p{L}\p{M}\p{N}]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "^-+|-+$", ""), r"^\z", "doc")


def stem(filename: Column) -> Column:
    """A file name without its extension; a lone '.pdf' has an empty one."""
    return F.regexp_replace(basename(filename), r"(?i)^\.pdf$|(?<=.)\.[^.]*$", "")


def doc_id_for(filename: Column, folder: Column | None = None) -> Column:
    """The id an uploaded file takes: its folders kept, its stem slugged."""
    folder = F.lit("") if folder is None else folder
    path = normalize_path(filename)
    inside = F.regexp_replace(path, "[^/]*$", "")
    where = clean_path(F.concat(folder, F.lit("/"), inside))
    name = clean_segment(slug(stem(F.regexp_extract(path, "[^/]*$", 0))))
    return F.array_join(F.filter(F.array(where, name), lambda p: p != ""), "/")


def renamed_id(doc_id: Column, typed: Column) -> Column:
    """The id a typed name makes for a document, '' when it makes none."""
    name = T.ws_trim(F.regexp_replace(T.ws_trim(F.regexp_replace(typed, r"[/\\]", "-")), r"(?i)\.pdf$", ""))
    folder = F.regexp_extract(doc_id, r"^(.*)/[^/]*$", 1)
    made = doc_id_for(F.concat(name, F.lit(".pdf")), folder)
    return F.when(name.rlike(r"[\p{L}\p{N}]"), made).otherwise(F.lit(""))


def clean_name(name: Column) -> Column:
    """A workspace's name as it is kept, NULL when nothing is left."""
    hidden = rf"(?:(?![{_ZW_JOINERS}])[\p{{Cc}}\p{{Cf}}{K.WS_IN_CLASS}])+"
    flat = T.ws_trim(F.regexp_replace(T.nfc(name), hidden, " "))
    graphemes = F.slice(F.regexp_extract_all(flat, F.lit(r"\X"), F.lit(0)), 1, K.MAX_NAME)
    cut = F.when(F.length(flat) > K.MAX_NAME, F.array_join(graphemes, "")).otherwise(flat)
    ws = K.WS_IN_CLASS
    stray = rf"(?<![^{ws}])[{_ZW_JOINERS}]+|[{_ZW_JOINERS}]+(?![^{ws}])"
    kept = T.ws_trim(F.regexp_replace(F.regexp_replace(cut, stray, ""), " {2,}", " "))
    return F.nullif(kept, F.lit(""))


def export_name(name: Column, markdown_only: Column, day: Column, unnamed: str = "workspace") -> Column:
    """An export's file name: what it is of, what it holds, and the day."""
    label = F.when(F.coalesce(name, F.lit("")) != "", clean_segment(name)).otherwise(F.lit(unnamed))
    kind = F.when(markdown_only, F.lit("markdown")).otherwise(F.lit("project"))
    return F.concat(label, F.lit("-"), kind, F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".zip"))


def exported_name(stem_: Column, unnamed: str = "workspace") -> Column:
    """The name an export's stem stands for: the inverse of export_name."""
    named = F.regexp_extract(stem_, r"^(.*)-(?:project|markdown)-\d{4}-\d{2}-\d{2}$", 1)
    hit = stem_.rlike(r"^(.*)-(?:project|markdown)-\d{4}-\d{2}-\d{2}$")
    return F.when(~hit, stem_).when(named == unnamed, F.lit("")).otherwise(named)
