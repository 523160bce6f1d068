"""The registered query of each operator, over the whole of its table, and its SQL."""

from pyspark.sql import functions as F

from quire.llm import (
    chat_format as CF, chunk_dedup as CD, decontamination as DC, exact_dedup as ED, language_id as LI, lm_scoring as LM, mixing as MX, near_dedup as ND, periodic_runs as PR, resharding as RS, suffix_dedup as SD, token_records as TR, whitening as WH,
)


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark, sf_dir):
    out = ED.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_language_id(spark, sf_dir):
    return LI.languages(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_records(spark, sf_dir):
    out = TR.tokenized(spark, _documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_chunk_dedup(spark, sf_dir):
    out = CD.repeated_spans(_documents(spark, sf_dir))
    return out.select("doc_id", "first_id", "start", "end", "first_start", "n_chunks")


def op5_decontamination(spark, sf_dir):
    return DC.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OLD_SHARDS, SHARDS = 32, 40


def lies_in(doc_id):
    """Where the corpus is taken to lie before: hashed by id over 32 shards."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))


def op6_resharding(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    plan = RS.reshard(docs, lies_in(F.col("doc_id")), OLD_SHARDS, SHARDS)
    files = RS.rewrite(docs, plan)
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(text) + 16).cast("long")
    narrow = files.select("doc_id", RS.FILE, RS.ROW, "old_shard", "shard", size.alias("size"), F.crc32(text).alias("text_crc32"))
    return RS.with_slots(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op7_mixing(spark, sf_dir):
    out = MX.mix(_documents(spark, sf_dir), MX.cycle((5.0, 2.0, 1.0)), epochs=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "extra_words")


def op8_suffix_dedup(spark, sf_dir):
    out = SD.repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_lm_scoring(spark, sf_dir):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return LM.score(_documents(spark, sf_dir), F.coalesce(F.pmod(crc, F.lit(7)) == 2, F.lit(False)))


def op10_near_dedup(spark, sf_dir):
    out = ND.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def with_periods(docs):
    """docs as op11 takes them: of every tenth document by hash, the words from one on
    are replaced by repetitions of those that begin there."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    g, n = F.floor(crc / 10), F.size("_words")
    cut = docs.select("doc_id", "text", words.alias("_words"), g.alias("_g"), F.pmod(g, F.greatest(n, F.lit(1))).cast("int").alias("_a"))
    a, rest = F.col("_a"), n - F.col("_a")
    p = (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    new = F.array_join(F.concat(F.slice("_words", F.lit(1), a), again), " ")
    return cut.select("doc_id", F.when(n > 0, new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    out = PR.periodic_runs(with_periods(_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.array_join(lines, "").alias("_l"), "collapsed")
    start, length, period = -F.col("_b.s"), F.col("_b.n"), -F.col("_b.p")
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("_l").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op12_whitening(spark, sf_dir):
    return WH.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4, 256)


def op13_chat_format(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    more = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    out = CF.read_chats(CF.format_chats(rows, path), path)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = f"""WITH d AS (SELECT doc_id, {LOW} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

OP5_SQL = f"""WITH dw AS (SELECT doc_id, {SPLIT.format(LOW)} AS w FROM documents),
iw AS (SELECT item_id, {SPLIT.format(LOW)} AS w FROM benchmark WHERE len({SPLIT.format(LOW)}) > 0),
ds AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM dw WHERE len(w) >= 5),
its AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS ss FROM iw WHERE len(w) >= 5),
one AS (SELECT item_id, len(ss) AS n_item, unnest(ss) AS s FROM its)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN one USING (s) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item"""

ESCAPED = r"replace(replace(replace(replace(coalesce({0}, ''), '\', '\\'), '<turn>', '\o'), '<text>', '\m'), '</turn>', '\c')"
OP13_SQL = rf"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
length('<turn><text></turn>') + length({ESCAPED.format("role")}) + length({ESCAPED.format("text")}) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

OP9_SQL = None

QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_language_id": (op2_language_id, None),
    "op3_token_records": (op3_token_records, None),
    "op4_chunk_dedup": (op4_chunk_dedup, None),
    "op5_decontamination": (op5_decontamination, OP5_SQL),
    "op6_resharding": (op6_resharding, None),
    "op7_mixing": (op7_mixing, None),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op9_lm_scoring": (op9_lm_scoring, OP9_SQL),
    "op10_near_dedup": (op10_near_dedup, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_whitening": (op12_whitening, None),
    "op13_chat_format": (op13_chat_format, OP13_SQL),
}
