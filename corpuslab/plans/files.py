"""Sources and sinks over whole tables, the dataset build, batch scoring, waits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.functions import values as V
from corpuslab.operators import scoring, similarity, splits
from corpuslab.plans.registry import Tables, query, repaired_folds_sql
from corpuslab.plans.scalars import PROB, WORDS, prob
from corpuslab.sources import collections, files, paged, shared
from corpuslab.streaming import progress


@query("src01_metadata_samples", "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def metadata_samples(t: Tables):
    at = shared.folder(t.spark, "metadata")
    sample = F.struct("conv_id", "turn", "role", "text")
    t.conversations.groupBy("conv_id").agg(F.collect_list(sample).alias("samples")).select("samples").write.json(at)
    rows = files.metadata_samples(t.spark, at, "conv_id: bigint, turn: bigint, role: string, text: string", lines=True)
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@query("src03_safe_path", r"SELECT page_id, NOT regexp_matches(path, '^/|(^|/)\.\.(/|$)') AS safe FROM (SELECT page_id, unnest([url, '/' || url, replace(url, '//', '/../')]) AS path FROM pages)")
def safe_path(t: Tables):
    paths = F.explode(F.array("url", F.concat(F.lit("/"), "url"), F.replace("url", F.lit("//"), F.lit("/../"))))
    return t.pages.select("page_id", paths.alias("path")).select("page_id", files.safe_path(F.col("path")).alias("safe"))


@query("src04_jsonl", "SELECT doc_id, lang, source, n_chars, sha256(text) AS digest FROM documents")
def jsonl(t: Tables):
    at = shared.folder(t.spark, "jsonl")
    t.documents.write.json(at)
    rows = files.jsonl(t.spark, at, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))


@query(
    "src05_notes",
    f"""WITH r AS (SELECT doc_id, {WORDS}::BIGINT AS words, n_chars, 1 + row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS n FROM documents)
 SELECT doc_id::VARCHAR AS id, words, n::BIGINT AS "row", CASE WHEN words = 0 THEN 'row ' || n || ': Text cannot be empty' WHEN n_chars % 150 > 100 THEN 'row ' || n || ': AI percent is not a percentage of 0 to 100' END AS problem FROM r""",
)
def notes(t: Tables):
    """A file for each 500 ids, in their order; texts keep their line ends."""
    at = shared.folder(t.spark, "notes")
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("Text"), F.concat((F.col("n_chars") % 150).cast("string"), F.lit("%")).alias("AI percent"))
    plain = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = rows.withColumn("part", F.floor(F.col("id") / 500)).repartition("part").sortWithinPartitions("part", "id")
    rows.write.partitionBy("part").options(**plain).csv(at)
    return files.notes(t.spark, at).select("id", X.word_count(F.col("Text")).cast("long").alias("words"), F.col("_row").alias("row"), "problem")


@query(
    "snk02_progress_log",
    """SELECT user_id, count(*)::BIGINT AS attempts, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS failures,
 max_by(CASE WHEN event_type = 'click' THEN 'failed at ' || event_id END, CASE WHEN event_type = 'click' THEN event_id END) AS last_error, max(event_type = 'purchase') AS done FROM events GROUP BY user_id""",
)
def progress_log(t: Tables):
    """Events as a log of attempts: a stream reads half of it in several triggers, is started anew, and goes on with the rest."""
    log, out, checkpoint = (shared.folder(t.spark, n) for n in ("log", "progress", "progress-at"))
    failed = F.when(F.col("event_type") == "click", F.concat(F.lit("failed at "), F.col("event_id").cast("string")))
    rows = t.events.select("user_id", "event_id", failed.alias("error"), (F.col("event_type") == "purchase").alias("done"))
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).repartition(4, "event_id").write.mode("append").json(log)
        stream = t.spark.readStream.schema("user_id long, event_id long, error string, done boolean").option("maxFilesPerTrigger", 2).json(log)
        progress.merge(stream, out, checkpoint, key="user_id", at="event_id", error="error", done="done").awaitTermination()
    return progress.progress_table(t.spark, out, "user_id")


@query("src13_paged_collection", "SELECT page_id, url, sha256(html) AS digest FROM pages")
def paged_collection(t: Tables):
    """All pages written as a collection of cursor chains, then collected from it."""
    at, starts = collections.write(t.pages, id_col="page_id", columns=["page_id", "url", "html"])
    t.spark.dataSource.register(paged.PagedSource)
    rows = t.spark.read.format("paged").options(path=at, starts=json.dumps(starts)).load()
    return _collected(rows)


@query("src13_paged_stream", "SELECT page_id, url, sha256(html) AS digest FROM pages")
def paged_stream(t: Tables):
    """The same by a stream that is started anew for what has come meanwhile: first a third of the chains' pages, then the rest."""
    t.spark.dataSource.register(paged.PagedSource)
    out, checkpoint = shared.folder(t.spark, "collected"), shared.folder(t.spark, "collected-at")
    at, starts = None, None
    for share in (F.col("page") % 3 == 0, F.col("page") % 3 != 0):
        at, starts = collections.write(t.pages, id_col="page_id", columns=["page_id", "url", "html"], at=at, only=share)
        stream = t.spark.readStream.format("paged").options(path=at, starts=json.dumps(starts), tries="1").load()
        progress.append(stream, out, checkpoint).awaitTermination()
    return _collected(t.spark.read.parquet(out))


def _collected(rows):
    item = F.from_json("item", "page_id long, url string, html string")
    return rows.select(item.alias("i")).select("i.page_id", "i.url", F.sha2("i.html", 256).alias("digest"))


SPLIT = "CASE h WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
BUILT = f"SELECT *, {SPLIT} AS split FROM (SELECT doc_id, text, quality, ('0x' || substr(sha256(lang || ':' || (doc_id // 5)), 1, 8))::BIGINT % 10 AS h FROM documents JOIN labels USING (doc_id) WHERE {WORDS} >= 50)"


def built(t: Tables):
    """The dataset build: texts of at least 50 words joined to their labels; whole groups go to a split."""
    rows = t.documents.where(X.word_count(F.col("text")) >= 50).join(t.labels, "doc_id")
    group = F.concat_ws(":", "lang", F.floor(F.col("doc_id") / 5).cast("string"))
    seat = V.hash_int(group) % 10
    return rows.select("doc_id", "text", "quality", F.when(seat == 0, "test").when(seat == 1, "validation").otherwise("train").alias("split"))


@query("snk03_verified_splits", f"SELECT split, count(*)::BIGINT AS written, count(*)::BIGINT AS \"read\", TRUE AS same FROM ({BUILT}) GROUP BY split")
def verified_splits(t: Tables):
    return files.verified_splits(built(t), shared.folder(t.spark, "splits"))


@query("snk04_reloaded_split", f"SELECT doc_id, quality, sha256(text) AS digest FROM ({BUILT}) WHERE split = 'train'")
def reloaded_split(t: Tables):
    at = shared.folder(t.spark, "splits")
    built(t).write.partitionBy("split").mode("errorifexists").parquet(at)
    return files.splits(t.spark, at, "train").select("doc_id", "quality", F.sha2("text", 256).alias("digest"))


@query("snk06_card", f"SELECT split, count(*)::BIGINT AS examples, sum(octet_length(encode(text)))::BIGINT AS bytes FROM ({BUILT}) GROUP BY split")
def card(t: Tables):
    return files.card_rows(built(t))


@query("snk10_snapshot", "SELECT doc_id, quality, toxic FROM labels")
def snapshot(t: Tables):
    at = shared.folder(t.spark, "snapshot")
    digest = F.concat_ws("|", "doc_id", "quality", "toxic")
    files.snapshot(t.labels, at, digest)
    return files.snapshot(t.labels, at, digest)  # the second call reads the frozen rows


# The dataset build of SURVEY 3.1 with its gates on the folds of whole groups.
BUILD = f"""WITH r AS (SELECT d.doc_id, d.source || ':' || (d.doc_id // 3) AS grp, l.quality::VARCHAR AS kind_, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {WORDS.replace('text', 'd.text')} >= 50 AND l.toxic = 0),
 {repaired_folds_sql('r', 'kind_')}"""


@query("bld01_dataset", f"{BUILD} SELECT doc_id, quality, split FROM r JOIN f ON r.grp = f.grp")
def dataset(t: Tables):
    """Labelled texts of at least 50 words without toxic ones, dealt to splits by whole groups, repaired, written and read back; raises if a gate fails."""
    rows = t.documents.where(X.word_count(F.col("text")) >= 50).join(t.labels.where("toxic = 0"), "doc_id")
    rows = rows.select("doc_id", "quality", F.col("quality").cast("string").alias("kind_"), F.concat_ws(":", "source", F.floor(F.col("doc_id") / 3).cast("string")).alias("grp"))
    folds = splits.assign_folds(rows, group="grp", stratum="kind_", seed=17)
    folds = splits.repair_folds(rows, folds, group="grp", stratum="kind_", seed=17)
    at = shared.folder(t.spark, "dataset")
    built = shared.stage(rows.join(folds.select("grp", "split"), "grp"), "built")
    if bad := files.save_splits(built, at).collect():  # a row a split
        raise ValueError(f"splits were not read back as written: {bad}")
    saved = splits.check_splits(t.spark.read.parquet(at).withColumn("good", F.col("quality") == 1), group="grp", stratum="kind_", positive="good")
    return saved.select("doc_id", "quality", "split")


def _length_scorer():
    # A stand-in for a model: a formula on the text that SQL can repeat.
    return lambda texts: [((len(x) * 7) % 101) / 100 for x in texts]


@query("ml06_batch_scores", "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN ((length(text) * 7) % 101)::DOUBLE / 100 END AS p, CASE WHEN regexp_matches(text, '\\S') THEN (((length(text) * 7) % 101)::DOUBLE / 100 >= 0.5)::INT END AS label FROM documents")
def batch_scores(t: Tables):
    return scoring.score_many(t.documents, _length_scorer, id_col="doc_id", text_col="text")


@query("mth11_backoff", "SELECT event_id, round(least(pow(2, event_id % 9), 60) + ('0x' || substr(sha256(user_id || ':' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 6) AS seconds FROM events")
def backoff(t: Tables):
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return t.events.select("event_id", F.round(V.backoff(F.col("event_id") % 9, 60.0, key), 6).alias("seconds"))


def turn_pairs(t: Tables):
    """Each turn of a conversation beside the next one."""
    left = t.conversations.select("conv_id", "turn", F.col("text").alias("original"))
    right = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("edited"))
    return left.join(right, ["conv_id", "turn"])


@query("mth09_edit_magnitude")
def edit_magnitude(t: Tables):
    """No SQL: the sequence ratio is tested against its definition."""
    ratio = similarity.character_ratio(F.col("original"), F.col("edited"))
    return turn_pairs(t).select("conv_id", "turn", F.round(1 - ratio, 6).alias("magnitude"))


@query("flt14_turn_edits")
def turn_edits(t: Tables):
    """No SQL, as above."""
    level = F.when(F.col("turn") % 2 == 0, "light").otherwise("moderate")
    return turn_pairs(t).select("conv_id", "turn", similarity.validate_edit(F.col("original"), F.col("edited"), level).alias("reason"))


@query("ml12_judged", f"SELECT lang, count(*)::BIGINT AS calls, count(*) FILTER (WHERE n_chars % 7 = 0)::BIGINT AS failures, round(avg(CASE WHEN n_chars % 7 <> 0 THEN floor({PROB} * 100) END), 6) AS mean_score FROM documents GROUP BY lang")
def judged(t: Tables):
    """Replies of a judging model, some broken, to scores and failures."""
    reply = F.when(F.col("n_chars") % 7 == 0, F.lit('{"ai_score": ')).otherwise(F.format_string('{"ai_score": %d}', F.floor(prob() * 100)))
    rows = t.documents.select("lang", V.json_score(reply).alias("score"))
    return rows.groupBy("lang").agg(F.count("*").alias("calls"), F.count_if(F.col("score").isNull()).alias("failures"), F.round(F.avg("score"), 6).alias("mean_score"))
