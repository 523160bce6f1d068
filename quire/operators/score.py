"""Scoring converters: quotes against text layers, tallies, history, verdicts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire import constants as K
from quire.functions import geometry as G, text as T
from quire.operators import ordered as O, quotes as quote_index
from quire.operators.quotes import nearest_edits  # noqa: F401

# ---- quotes -----------------------------------------------------------------


def quotes_found(layers: DataFrame, quotes: DataFrame) -> DataFrame:
    """(input, quote_no, exact, found): each quote with a letter in it, held
    against its input's layer. layers(input, text); quotes(input, quote_no, text, slack)."""
    hays = layers.select("input", T.plain(F.col("text")).alias("hay"))
    needles = quotes.select(
        "input", "quote_no", T.plain(F.col("text")).alias("needle"), F.coalesce("slack", F.lit(0)).alias("slack")
    ).where("needle != ''")
    limit = F.greatest(F.col("slack"), F.floor(T.utf16_length(F.col("needle")) / K.SLACK_EVERY)).cast("int")
    return quote_index.look_up(hays, needles.withColumn("limit", limit)).select(
        "input", "quote_no", (F.col("edits") == 0).alias("exact"), (F.col("edits") <= F.col("limit")).alias("found")
    )


def text_layer_split(layers: DataFrame, quotes: DataFrame) -> DataFrame:
    """(input, share, in_split): inputs a reader can get right without OCR."""
    held = quotes_found(layers, quotes).groupBy("input").agg(
        (F.count_if("found") / F.count("*")).alias("share")
    )
    letters = layers.select("input", T.utf16_length(T.plain(F.col("text"))).alias("letters"))
    return letters.join(held, "input", "left").select(
        "input",
        "share",
        F.when(F.col("share").isNull(), F.col("letters") >= K.UNQUOTED_MIN)
        .otherwise(F.col("share") >= K.TEXT_LAYER_CUTOFF)
        .alias("in_split"),
    )


def stretches(text: Column, length: int = K.STRETCH_LETTERS) -> Column:
    """Quotes of `length` letters and digits each, cut wherever that many have
    gone by; a tail too short to tell anything is left off."""
    piece = rf"(?s)(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{{length}}}"
    whole = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    used = F.aggregate(whole, F.lit(0), lambda n, s: n + F.length(s))
    tail = text.substr(used + 1, F.length(text))
    letters = F.regexp_count(tail, F.lit(r"[\p{L}\p{N}]"))
    keep = (letters >= length / 2) | ((letters > 0) & (F.size(whole) == 0))
    return F.when(keep, F.concat(whole, F.array(tail))).otherwise(whole)


def prose_quotes(markdown: DataFrame) -> DataFrame:
    """(input, quote_no, text): a ground truth's prose eight words at a time, never
    across a formula or a paragraph. All of them; `spread_sample` thins."""
    flat = F.regexp_replace(F.col("text"), r"(?s)\\begin\{(\w+\*?)\}.*?\\end\{\1\}", "\n\n")
    flat = F.regexp_replace(flat, r"(?s)\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$", "\n\n")
    flat = F.regexp_replace(flat, r"!\[[^\]]*\]\([^)]*\)", " ")
    flat = F.regexp_replace(flat, r"\]\([^)]*\)", "] ")
    flat = F.regexp_replace(flat, r"<[^>]+>", " ")
    # Split once per stretch of prose, before anything looks at its words.
    runs = F.transform(
        F.split(flat, rf"\n{K.WS}*\n"), lambda run: F.filter(F.split(run, rf"{K.WS}+"), lambda w: w != "")
    )
    n = K.WORDS_PER_QUOTE

    def cut(words):
        whole = F.floor(F.size(words) / n).cast("int")
        every = F.transform(
            F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.array_join(F.slice(words, k * n + 1, n), " "),
        )
        return F.filter(
            every,
            lambda q: ~q.rlike(r"[\\$]")
            & (F.length(F.regexp_replace(q, r"[^\p{L}\p{N}]", "")) >= K.MIN_QUOTE_LETTERS),
        )

    picked = F.flatten(F.transform(runs, cut))
    return markdown.select("input", F.posexplode(picked).alias("quote_no", "text"))


_SIDES = ("up", "down", "left", "right", "top_heading", "left_heading")


def quotes_of_tests(tests: DataFrame, formulas_out: bool = True) -> DataFrame:
    """(input, quote_no, text, slack): what an input's tests quote from its page."""
    by_type = (
        F.when(F.col("type").isin("present", "absent"), F.array("text"))
        .when(F.col("type") == "order", F.array("before", "after"))
        .when(F.col("type") == "table", F.array("cell", *_SIDES))
    )
    every = F.array("text", "before", "after", "cell", *_SIDES)
    listed = by_type if formulas_out else every
    return (
        tests.select("input", "id", F.posexplode(listed).alias("part", "text"), F.col("max_diffs").alias("slack"))
        .where(F.coalesce("text", F.lit("")) != "")
        .select("input", F.concat_ws("#", "id", "part").alias("quote_no"), "text", "slack")
    )


def wants(tests: DataFrame) -> DataFrame:
    """tests with `wants`: what each looks for, in a line."""

    def said(c):
        return F.to_json(F.array(F.coalesce(F.col(c), F.lit("")))).substr(F.lit(2), F.length(
            F.to_json(F.array(F.coalesce(F.col(c), F.lit(""))))) - 2)

    names = dict(zip(_SIDES, ("up", "down", "left", "right", "under", "beside")))
    near = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(s), F.lit("")) != "", F.concat(F.lit(names[s] + " "), said(s)))
                for s in _SIDES
            ]
        )
    )
    cell = F.concat(F.lit("cell "), said("cell"), F.when(F.size(near) > 0, F.concat(F.lit(", "), F.array_join(near, ", "))).otherwise(F.lit("")))
    line = (
        F.when(F.col("type") == "present", F.concat(said("text"), F.lit(" present")))
        .when(F.col("type") == "absent", F.concat(said("text"), F.lit(" absent")))
        .when(F.col("type") == "order", F.concat(said("before"), F.lit(" before "), said("after")))
        .when(F.col("type") == "table", cell)
        .when(F.col("type") == "math", F.concat(F.lit("formula "), F.coalesce("math", F.lit(""))))
        .otherwise("text, and not the same thing over and over")
    )
    return tests.withColumn("wants", line)


# ---- tallies ----------------------------------------------------------------


def category_tallies(verdicts: DataFrame, *also: str) -> DataFrame:
    return verdicts.groupBy(*also, "category").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def macro_score(tallies: DataFrame) -> DataFrame:
    """The mean of the categories' pass rates."""
    return tallies.agg(F.avg(F.col("passed") / F.col("total")).alias("score"), F.sum("total").alias("tests"))


def micro_score(tallies: DataFrame) -> DataFrame:
    """Tests passed over tests, the baseline checks left out of the score."""
    real = F.col("category") != "baseline"
    return tallies.agg(
        (F.sum(F.when(real, F.col("passed"))) / F.sum(F.when(real, F.col("total")))).alias("score"),
        F.sum(F.when(real, F.col("total"))).alias("tests"),
    )


def tabled_average(measures: DataFrame, listed: list[str]) -> DataFrame:
    """measures(subset, measure, value): the mean of the listed ones present."""
    return measures.where(F.col("measure").isin(*listed)).groupBy("subset").agg(F.avg("value").alias("average"))


def score_consistency(tallies: DataFrame, reported: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Categories whose own counts disagree with those reported:
    reported(category, passed, total, mean)."""
    a, b = tallies.alias("a"), reported.alias("b")
    mean = F.col("a.passed") / F.col("a.total")
    agree = (
        F.col("a.passed").eqNullSafe(F.col("b.passed"))
        & F.col("a.total").eqNullSafe(F.col("b.total"))
        & (F.col("b.mean").isNull() | (F.abs(mean - F.col("b.mean")) <= tolerance))
    )
    return a.join(b, "category", "full_outer").where(~F.coalesce(agree, F.lit(False))).select(
        "category",
        F.col("a.passed").alias("passed"),
        F.col("a.total").alias("total"),
        F.col("b.passed").alias("reported_passed"),
        F.col("b.total").alias("reported_total"),
    )


def score_on(inputs: DataFrame, split: DataFrame, inside: bool = True) -> DataFrame:
    """Inputs with a text layer, or the ones that need OCR."""
    return inputs.join(split.select("input"), "input", "left_semi" if inside else "left_anti")


def pending(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files not yet converted under this revision, version and pins."""
    return files.join(kept, ["input", "revision", "version", "pins"], "left_anti")


def still_to_fetch(asked: DataFrame, verified: DataFrame) -> DataFrame:
    return asked.select("name", "sha256").exceptAll(verified.select("name", "sha256"))


# ---- runs -------------------------------------------------------------------


def run_summary(file_runs: DataFrame) -> DataFrame:
    """file_runs(input, pages, ms, error, gave_up) summed over a run."""
    seconds = F.sum("ms") / 1000
    return file_runs.agg(
        F.sum("pages").alias("pages"),
        seconds.alias("seconds"),
        F.when(seconds > 0, G.round_to(F.sum("pages") / seconds, 10)).otherwise(F.lit(0.0)).alias("pages_per_second"),
        F.count_if(F.col("error").isNotNull()).alias("unread"),
        F.count_if("gave_up").alias("gave_up"),
    )


def scored_text(text: Column) -> Column:
    """Markdown as a scorer is given it: white space alone is nothing."""
    return F.when(T.ws_trim(text) == "", F.lit("")).otherwise(text)


def markdown_hashes(markdown: DataFrame) -> DataFrame:
    return markdown.select("input", F.sha2(scored_text(F.col("text")), 256).alias("hash"))


def corpus_hash(hashes: DataFrame) -> DataFrame:
    """One hash over (input, hash), whatever order they come in.

    A tree of fixed width: inputs fall in leaves by the head of their own hash,
    leaves in branches, branches in the root, each ordered inside. No task sees
    more than one leaf's rows, or 256 hashes.
    """
    key = F.sha2(F.col("input").cast("string"), 256)
    leaf = hashes.select(
        key.substr(1, 4).alias("leaf"), F.concat(F.col("input").cast("string"), F.lit(":"), "hash").alias("row")
    )
    leaves = leaf.groupBy("leaf").agg(
        F.sha2(F.expr("listagg(row, ',') WITHIN GROUP (ORDER BY row)"), 256).alias("hash"), F.count("*").alias("n")
    )
    branches = leaves.groupBy(F.col("leaf").substr(1, 2).alias("branch")).agg(
        F.sha2(F.expr("listagg(hash, ',') WITHIN GROUP (ORDER BY leaf)"), 256).alias("hash"), F.sum("n").alias("n")
    )
    return branches.agg(
        F.sha2(F.expr("listagg(hash, ',') WITHIN GROUP (ORDER BY branch)"), 256).alias("hash"), F.sum("n").alias("inputs")
    )


def latest_run(history: DataFrame) -> DataFrame:
    """The last run of each benchmark and tool (of runs on one date, that of the higher
    score), and its fields of the run before its date that can be compared: same
    revision, scorer and browsers. Groupings only, so a long history is summed up
    before it is moved."""
    tool, alike = ["benchmark", "tool"], ["benchmark", "tool", "revision", "scorer", "browsers"]
    every = F.struct(*history.columns)
    last = history.groupBy(*tool).agg(F.max_by(every, F.struct("date", "score")).alias("_r")).select("_r.*")
    than = last.select(*[F.col(c).alias(f"_{c}") for c in alike], F.col("date").alias("_date"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike])
    before = history.join(than, same & (F.col("date") < F.col("_date"))).groupBy(*[f"_{c}" for c in tool])
    before = before.agg(F.max_by("score", F.struct("date", "score")).alias("previous_score"))
    mine = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in tool])
    return last.join(before, mine, "left").select(*history.columns, "previous_score")


def spread_sample(inputs: DataFrame, k: int, order: str = "input") -> DataFrame:
    """Every floor(i*n/k)th input of the sorted list, i from 0 to k - 1."""
    ranked = O.running(inputs, [], [order], totals=True, _nth=F.lit(1))
    r, n = "(_nth - 1)", "_nth_all"
    # rank r is picked when some i has floor(i*n/k) = r
    i = f"(({r} * {k} + {n} - 1) div {n})"
    return ranked.where(f"({i} * {n}) div {k} = {r} and {i} < {k}").select(*inputs.columns)


def verdict_diff(run: DataFrame, before: DataFrame) -> DataFrame:
    """Tests whose verdict changed since the run before."""
    b = before.select("id", F.col("passed").alias("_was"))
    return (
        run.join(b, "id")
        .where(F.col("passed") != F.col("_was"))
        .withColumn("change", F.when(F.col("passed"), "now passes").otherwise("now fails"))
        .drop("_was")
    )


def report_failures(verdicts: DataFrame, markdown: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per failed test: its page's tallies, and whether the page is
    written differently now than when it was scored."""
    per_file = verdicts.groupBy("input").agg(F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("tests"))
    now = markdown_hashes(markdown).select("input", F.col("hash").alias("_now"))
    was = scored.select("input", F.col("hash").alias("_was"))
    return (
        verdicts.where(~F.col("passed"))
        .join(per_file, "input")
        .join(now, "input", "left")
        .join(was, "input", "left")
        .withColumn("stale", ~F.col("_now").eqNullSafe(F.col("_was")))
        .drop("_now", "_was")
    )


def box_percent(box: Column, width: Column, height: Column) -> Column:
    """A box as percentages of its page, two decimals."""
    parts = (("x", width), ("y", height), ("w", width), ("h", height))
    return F.struct(*[G.round_to(box[k] / whole * 100).alias(k) for k, whole in parts])


def history_gate(run: DataFrame) -> DataFrame:
    """run(…, began_dirty, now_dirty, began_commit, now_commit, inputs, all_inputs,
    gave_up) with `refused`: why it is not for the history, or NULL."""
    return run.withColumn(
        "refused",
        F.when(F.col("inputs") != F.col("all_inputs"), "a slice")
        .when(F.col("began_dirty"), "the tree has changes")
        .when((F.col("now_commit") != F.col("began_commit")) | F.col("now_dirty"), "the tree changed during the run")
        .when(F.col("gave_up") > 0, "given up on at the time limit"),
    )


def run_table(scores: DataFrame) -> DataFrame:
    """scores(inputs_of, category, passed, total) with a column per set of inputs."""
    said = F.format_string(
        "%.1f%%  %d/%d", F.first("passed") / F.first("total") * 100, F.first("passed"), F.first("total")
    )
    share = F.when(F.count("total") > 0, said)
    return scores.groupBy("category").pivot("inputs_of", ["all", "text_layer"]).agg(share)


class Registry:
    """Named plug-ins: benchmark adapters (inputs, quotes, scores tables) and
    tools (a table of markdown), looked up by name."""

    def __init__(self, *fields: str):
        self._fields, self._items = fields, {}

    def add(self, name: str, **tables) -> None:
        lacking = [f for f in self._fields if f not in tables]
        if lacking:
            raise ValueError(f"{name} lacks {', '.join(lacking)}")
        self._items[name] = tables

    def __getitem__(self, name: str) -> dict:
        if name not in self._items:
            raise KeyError(f"no {name}: there is {', '.join(sorted(self._items))}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


adapters = Registry("inputs", "quotes", "scores")
tools = Registry("markdown")
