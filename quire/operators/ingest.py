"""Taking in document sets: what arrives, whose bytes they are, what changes."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire import constants as K
from quire.functions import paths as P, text as T
from quire.operators import ordered as O


def drop_caps(
    files: DataFrame, max_files: int = K.MAX_ENTRIES, max_file: int = K.MAX_FILE, max_drop: int = K.MAX_DROP
) -> DataFrame:
    """files(drop_id, arrival, name, bytes) with `verdict`, one row out for each in.

    Junk is passed over and counts for nothing. ``max_file`` is the most bytes a file
    may have (a bigger one is only skipped), ``max_files`` the most files of a drop and
    ``max_drop`` the most bytes it may hold together; the first file past one of these
    stops the drop, and all after it are `after the stop`. `arrival` tells a drop's
    files apart. Ranks and bytes are running totals over ranges of arrival, so a drop
    of any size is many tasks.
    """
    junk = P.is_junk(F.col("name"))
    big = F.col("bytes") > max_file
    counted = O.running(
        files, ["drop_id"], ["arrival"], rank=F.when(junk, 0).otherwise(1),
        upto=F.when(junk | big, 0).otherwise(F.col("bytes")),
    )
    many = F.col("rank") > max_files
    over = ~junk & (many | (~big & (F.col("upto") > max_drop)))
    stops = counted.where(over).groupBy(F.col("drop_id").alias("_drop")).agg(F.min("rank").alias("stop"))
    return counted.join(stops, F.col("drop_id").eqNullSafe(F.col("_drop")), "left").select(
        "drop_id",
        "arrival",
        "name",
        "bytes",
        F.when(junk, "junk")
        .when(F.col("rank") > F.col("stop"), "after the stop")
        .when(many, "too many files")
        .when(big, "too large")
        .when(F.col("rank") == F.col("stop"), "drop too large")
        .otherwise("taken")
        .alias("verdict"),
    )


def workspace_roots(files: DataFrame, manifest: str = K.MANIFEST_NAME) -> DataFrame:
    """(drop_id, root): folders holding a manifest, at depth 0 or 1. The root
    workspace's own sources and markdown folders are not roots."""
    parts = F.split("path", "/")
    held = files.where(P.is_manifest(F.col("path"), manifest))
    top = held.where(F.size(parts) == 1).select("drop_id", F.lit("").alias("root")).distinct()
    one = (
        held.where((F.size(parts) == 2) & (F.element_at(parts, 1) != ""))
        .select("drop_id", F.element_at(parts, 1).alias("root"))
        .distinct()
    )
    own = one.where(F.col("root").isin(K.SOURCES_DIR, K.MARKDOWN_DIR)).join(
        top.select("drop_id"), "drop_id", "left_semi"
    )
    return top.unionByName(one.join(own, ["drop_id", "root"], "left_anti"))


def workspace_root_of(files: DataFrame, manifest: str = K.MANIFEST_NAME) -> DataFrame:
    """files(drop_id, path) with root (NULL when loose), doc_id, and why a PDF
    was turned away. A root is one folder deep, so finding a file's nearest is an
    equality on its first folder, and on '' for the root workspace."""
    roots = workspace_roots(files, manifest)
    first = F.when(F.size(F.split("path", "/")) > 1, F.element_at(F.split("path", "/"), 1))
    top = roots.where("root = ''").select("drop_id", F.lit(True).alias("_top"))
    inner = roots.where("root != ''").select("drop_id", F.col("root").alias("_first"))
    df = (
        files.withColumn("_first", first)
        .join(inner.withColumn("_hit", F.lit(True)), ["drop_id", "_first"], "left")
        .join(top, "drop_id", "left")
    )
    root = F.when(F.col("_hit"), F.col("_first")).when(F.col("_top"), F.lit(""))
    df = df.withColumn("root", root).drop("_hit", "_top", "_first")
    sources = F.when(F.col("root") == "", F.lit(K.SOURCES_DIR)).otherwise(
        F.concat("root", F.lit("/" + K.SOURCES_DIR))
    )
    inside = F.startswith(F.col("path"), F.concat(sources, F.lit("/")))
    rest = F.col("path").substr(F.length(sources) + 2, F.length("path"))
    rest = rest.substr(F.lit(1), F.length(rest) - 4)
    pdf = P.is_pdf(F.col("path"))
    held = F.when(pdf & F.col("root").isNotNull() & inside, P.clean_id(rest))
    return df.withColumn("_held", held).select(
        "drop_id",
        "path",
        "root",
        F.when(pdf & F.col("root").isNull(), P.doc_id_for(F.col("path")))
        .when(F.col("_held") != "", F.col("_held"))
        .alias("doc_id"),
        F.when(pdf & F.col("root").isNotNull() & ~inside, "outside sources")
        .when(F.col("_held") == "", "no name")
        .alias("rejected"),
    )


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """The same bytes under one id are one copy: the first to arrive is kept,
    with how many more there were. A grouping, so copies collapse before the
    shuffle."""
    first = F.min_by(F.struct("name", "bytes", "origin", "arrival"), "arrival")
    return (
        candidates.groupBy("doc_id", "sha256")
        .agg(first.alias("f"), (F.count("*") - 1).alias("repeats"))
        .select("doc_id", "sha256", "f.*", "repeats")
    )


def repeats_said(candidates: DataFrame) -> DataFrame:
    """(said, n): repeated copies, by where the kept copy already was."""
    return (
        dedupe_candidates(candidates)
        .where("repeats > 0")
        .groupBy(
            F.when(F.col("origin") == "browser", "already uploaded").otherwise("already staged").alias("said")
        )
        .agg(F.sum("repeats").alias("n"))
    )


def _ids(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, listed, listed_sha, arrival, copies, sha256, origin): every id once."""
    listed = manifest.select(
        "doc_id", F.lit(True).alias("listed"), F.col("sha256").alias("listed_sha"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("arrival", "long"), ("sha256", "string"), ("origin", "string"))],
    )
    came = dedupe_candidates(candidates).select(
        "doc_id", F.lit(False).alias("listed"), F.lit(None).cast("string").alias("listed_sha"),
        F.col("arrival").cast("long").alias("arrival"), "sha256", "origin",
    )
    both = listed.unionByName(came)
    return both.groupBy("doc_id").agg(
        F.bool_or("listed").alias("listed"), F.max("listed_sha").alias("listed_sha"),
        F.coalesce(F.min("arrival"), F.lit(0)).alias("arrival"), F.count_if(~F.col("listed")).alias("copies"),
        F.min("sha256").alias("sha256"), F.min("origin").alias("origin"),
    )


def _owners(ids: DataFrame) -> DataFrame:
    rank = F.struct((~F.col("listed")).cast("int"), "arrival", "doc_id")
    single = ids.where("copies = 1 and sha256 is not null")
    return single.groupBy("sha256").agg(F.min_by("doc_id", rank).alias("owner"))


def owner_of_bytes(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sha256, owner): the first id, listed before arrived, holding the bytes
    as its only copy."""
    return _owners(_ids(manifest, candidates))


def reconcile(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, status, copies, sha256): every id listed or arrived, and what it is."""
    ids = _ids(manifest, candidates)
    owner = _owners(ids).withColumnRenamed("sha256", "_bytes")
    # An id without bytes meets no owner; its own name spreads such rows over tasks.
    df = ids.join(owner, F.coalesce("sha256", F.concat(F.lit(":"), F.col("doc_id"))) == F.col("_bytes"), "left")
    copies = F.col("copies")
    same = F.col("listed_sha") == F.col("sha256")
    status = (
        F.when(copies == 0, "missing")
        .when(copies > 1, "conflict")
        .when(
            F.col("listed") & F.col("listed_sha").isNull(),
            F.when(F.col("origin") == "workspace", "unchanged").otherwise("revised"),
        )
        .when(F.col("listed"), F.when(same, "unchanged").otherwise("revised"))
        .when(F.col("owner") != F.col("doc_id"), "duplicate")
        .otherwise("new")
    )
    return df.select("doc_id", status.alias("status"), "copies", F.when(copies == 1, F.col("sha256")).alias("sha256"))


def settle_conflict(candidates: DataFrame, choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside): choice(doc_id, sha256) keeps one copy of its id and sets
    the others aside, from where they come back when the kept one is taken out."""
    pick = choice.select("doc_id", F.col("sha256").alias("_keep"))
    df = candidates.join(pick, "doc_id", "left")
    aside = F.col("_keep").isNotNull() & (F.col("_keep") != F.col("sha256"))
    return df.where(~aside).drop("_keep"), df.where(aside).drop("_keep")


def unstage(candidates: DataFrame, aside: DataFrame, gone: DataFrame) -> DataFrame:
    """candidates without the documents in gone(doc_id), their set-aside copies back."""
    back = aside.join(gone, "doc_id", "left_semi")
    return candidates.join(gone, "doc_id", "left_anti").unionByName(back)


def rename_staged(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """candidates under the ids that names(doc_id, typed) make; a name that makes
    none, or an id already staged, leaves its document where it is."""
    made = names.withColumn("new_id", P.renamed_id(F.col("doc_id"), F.col("typed"))).where("new_id != ''")
    taken = candidates.select(F.col("doc_id").alias("new_id")).distinct()
    free = made.join(taken, "new_id", "left_anti").select("doc_id", "new_id")
    out = candidates.join(free, "doc_id", "left")
    return out.withColumn("doc_id", F.coalesce("new_id", "doc_id")).drop("new_id")


def space_check(reconciled: DataFrame, candidates: DataFrame, free: int) -> DataFrame:
    """Bytes to write, and whether twice that fits. No known room is no refusal."""
    single = reconciled.where("copies = 1").select("doc_id")
    new = dedupe_candidates(candidates).where("origin != 'browser'").join(single, "doc_id", "left_semi")
    return new.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("writing")).withColumn(
        "fits", (F.lit(free) <= 0) | (F.col("writing") * K.RESERVE <= F.lit(free))
    )


def shed_decisions(manifest: DataFrame, reconciled: DataFrame) -> DataFrame:
    """manifest(doc_id, sha256, extra MAP) with the decisions of revised sources
    taken out of their entries; every other field travels on."""
    status = reconciled.select("doc_id", "status")
    kept = F.map_filter("extra", lambda k, v: ~k.isin("edits", "done", "reader", "check"))
    return (
        manifest.join(status, "doc_id", "left")
        .withColumn("extra", F.when(F.col("status") == "revised", kept).otherwise(F.col("extra")))
        .drop("status")
    )


def archive_gate(
    entries: DataFrame, manifest: str = K.MANIFEST_NAME, max_entries: int = K.MAX_ENTRIES, max_inflated: int = K.MAX_INFLATED
) -> DataFrame:
    """(archive, entries, inflated, refused): the first reason to refuse one.

    entries(archive, entry_no, path, size, original_size, method, encrypted).
    Only PDFs and manifests count, and junk and folders never do.
    """
    path = P.normalize_path(F.col("path"))
    wanted = (
        entries.where(~F.endswith(F.col("path"), F.lit("/")))
        .withColumn("path", path)
        .where(~P.is_junk(F.col("path")) & (P.is_pdf(F.col("path")) | P.is_manifest(F.col("path"), manifest)))
    )
    bad = F.when(F.col("encrypted"), "encrypted").when(~F.col("method").isin(0, 8), "method")
    per_path = wanted.groupBy("archive", "path").agg(
        F.min(F.when(bad.isNotNull(), F.struct(F.col("entry_no").alias("no"), bad.alias("why")))).alias("bad"),
        F.max(F.greatest("size", "original_size")).alias("cost"),
    )
    # The second entry under a name is where an archive is refused for it. The
    # rank is limited to two, which Spark applies before the shuffle.
    nth = Window.partitionBy("archive", "path").orderBy("entry_no")
    again = (
        wanted.select("archive", "path", "entry_no", F.row_number().over(nth).alias("nth"))
        .where("nth <= 2")
        .where("nth = 2")
        .groupBy("archive")
        .agg(F.min(F.struct(F.col("entry_no").alias("no"), F.lit("twice").alias("why"))).alias("dup"))
    )
    sums = per_path.groupBy("archive").agg(
        F.count("*").alias("entries"), F.sum("cost").alias("inflated"), F.min("bad").alias("bad")
    )
    first = F.least("bad", "dup")
    return (
        sums.join(again, "archive", "left")
        .select(
            "archive",
            "entries",
            "inflated",
            F.coalesce(
                F.coalesce(first, F.coalesce("bad", "dup"))["why"],
                F.when(F.col("entries") > max_entries, "too many"),
                F.when(F.col("inflated") > max_inflated, "too large"),
            ).alias("refused"),
        )
    )


def folder_rollup(paths: DataFrame) -> DataFrame:
    """(folder, files): each folder and the files under it; a path counts once."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    depth = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    return (
        paths.select("path")
        .distinct()
        .where(depth > 1)
        .select(F.explode(prefixes).alias("folder"))
        .groupBy("folder")
        .agg(F.count("*").alias("files"))
    )


def tree_order(nodes: DataFrame) -> DataFrame:
    """nodes(parent, name, is_file) in a listing's order: folders first, then by
    name without case or accents, then by the name itself, character by character;
    what is null comes last. `place` counts within a parent."""
    order = [F.col(c).asc_nulls_last() for c in ("is_file", "_folded", "name")]
    nodes = nodes.withColumn("_folded", T.folded(F.col("name")))
    return O.running(nodes, ["parent"], order, place=F.lit(1)).drop("_folded")


def union_ids(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, listed): every id once, a listed one as listed."""
    return (
        manifest.select("doc_id", F.lit(0).alias("r"))
        .unionByName(candidates.select("doc_id", F.lit(1).alias("r")))
        .groupBy("doc_id")
        .agg((F.min("r") == 0).alias("listed"))
    )


def backfill_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, sha256, bytes): documents listed without a hash get one from their
    bytes. files(doc_id, length, content); a listed hash never reads content."""
    need = manifest.where("sha256 is null").select("doc_id")
    listed = manifest.where("sha256 is not null").join(files.select("doc_id", "length"), "doc_id")
    filled = need.join(files, "doc_id").select(
        "doc_id", F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("bytes")
    )
    return listed.select("doc_id", "sha256", F.col("length").alias("bytes")).unionByName(filled)


def drop_derived(derived: DataFrame, reconciled: DataFrame) -> DataFrame:
    """A derived table without what came from sources now revised."""
    return derived.join(reconciled.where("status = 'revised'").select("doc_id"), "doc_id", "left_anti")
