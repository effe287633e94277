"""Markup sources, model features, calibration and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import logistic, model, terms
from corpuslab.plans.registry import Rows, Tables, query
from corpuslab.plans.relational import MODEL_NAMES, PREDICTED, predicted
from corpuslab.plans.scalars import PROB
from corpuslab.sources import collections, files, markup, shared


@query("src06_split_scan", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def split_scan(t: Tables):
    return t.events.where("event_type = 'purchase'").select("event_id", "event_type")


JATS = Rows(
    "id int, xml string",
    [
        (
            1,
            "<article xmlns='urn:x'><front><abstract><p>An abstract with five words here.</p></abstract></front><body><sec><title>Methods</title><p>One paragraph of the body text.</p><table-wrap><p>not this one at all please</p></table-wrap></sec>"
            "<sec><title>References</title><p>never this one in the output</p></sec></body></article>",
        ),
        (2, "<broken"),
    ],
)


@query("src07_article_xml", f"SELECT id, CASE id WHEN 1 THEN 'An abstract with five words here.' || chr(10) || chr(10) || 'One paragraph of the body text.' END AS text FROM {JATS.sql}")
def article_xml(t: Tables):
    return JATS.frame(t.spark).select("id", markup.jats(F.col("xml")).alias("text"))


MODULES = Rows(
    "id int, xml string",
    [(1, f"<doc xmlns='urn:c'><title>Cells</title><content><para>{'word ' * 50}</para><figure><para>left out of the module text</para></figure></content></doc>"), (2, "<doc><title>Short</title><para>too few words in here</para></doc>")],
)


@query("src08_course_module", f"SELECT id, CASE id WHEN 1 THEN 'Cells' END AS title, CASE id WHEN 1 THEN 50 END AS words FROM {MODULES.sql}")
def course_module(t: Tables):
    rows = MODULES.frame(t.spark).select("id", markup.course_module(F.col("xml")).alias("m"))
    return rows.select("id", F.col("m.title").alias("title"), F.when(F.col("m").isNotNull(), F.size(F.split("m.text", " "))).alias("words"))


@query("src09_html_paragraphs")
def html_paragraphs(t: Tables):
    return t.pages.select("page_id", markup.html_paragraphs(F.col("html")).alias("text"))


OAI = Rows(
    "page int, xml string",
    [
        (
            1,
            "<OAI xmlns='urn:o'><ListRecords><record><metadata><arXiv><id>1</id><created>2020-01-02</created><title>A  b</title><license>l</license><authors><author><keyname>Doe</keyname><forenames>Jo</forenames></author></authors></arXiv></metadata></record>"
            "<record><header/></record><resumptionToken>next</resumptionToken></ListRecords></OAI>",
        )
    ],
)


@query("src10_harvest", f"SELECT page, '1' AS id, '2020-01-02' AS created, 'A b' AS title, 'Jo Doe' AS authors, 'next' AS token FROM {OAI.sql}")
def harvest(t: Tables):
    rows = OAI.frame(t.spark).select("page", markup.oai_page(F.col("xml")).alias("o"))
    rows = rows.select("page", "o.token", F.explode("o.records").alias("r"))
    return rows.select("page", "r.id", "r.created", "r.title", F.array_join("r.authors", "|").alias("authors"), "token")


@query("src11_tex_source", "SELECT conv_id, turn, CASE WHEN text LIKE '%PDF%' THEN NULL ELSE text END AS source FROM conversations")
def tex_source(t: Tables):
    return t.conversations.select("conv_id", "turn", markup.tex(F.encode("text", "utf-8")).alias("source"))


@query("src11_archive_members", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 3000000")
def archive_members(t: Tables):
    """All documents written into gzipped tar archives and read back member by member."""
    at = collections.write_archives(t.documents, id_col="doc_id", text_col="text")
    members = markup.archive_members(files.binary_files(t.spark, at))
    return members.select(F.regexp_extract("member", r"(\d+)\.tex$", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("digest"))


@query("src14_revision_before", "SELECT l_orderkey, max_by(l_linenumber, (l_shipdate, l_linenumber)) AS revision FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-12-31' GROUP BY l_orderkey")
def revision_before(t: Tables):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1997-12-31").cast("timestamp_ntz"))
    return rows.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("revision"))


@query("snk05_wide_predictions", f"SELECT id, p * 100 AS a_score, CASE WHEN p >= 0.5 THEN 'AI' ELSE 'human' END AS a_label, (1 - p) * 100 AS b_score, CASE WHEN 1 - p >= 0.5 THEN 'AI' ELSE 'human' END AS b_label FROM ({PREDICTED})")
def wide_predictions(t: Tables):
    both = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("p").alias("q")), F.struct(F.lit("b").alias("model"), (1 - F.col("p")).alias("q"))))
    rows = predicted(t).select("id", both.alias("x")).select("id", "x.model", (F.col("x.q") * 100).alias("score"), F.when(F.col("x.q") >= 0.5, "AI").otherwise("human").alias("label"))
    return files.wide_predictions(rows, id_col="id", models=["a", "b"])


@query("snk08_export", "SELECT d.doc_id AS prompt_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE trim(d.text) <> ''")
def export(t: Tables):
    manifest = t.documents.select(F.col("doc_id").alias("prompt_id"), F.col("doc_id").alias("position"), F.col("text").alias("question"))
    progress = t.labels.withColumnRenamed("doc_id", "prompt_id")
    return files.export_prompts(manifest.drop("question"), progress.join(manifest.select("prompt_id", "question"), "prompt_id")).select("prompt_id", "quality")


@query("snk09_upsert", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 9, toxic FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT page_id + 10000000, 9, 0 FROM pages WHERE page_id % 50 = 0")
def upsert(t: Tables):
    changed = t.labels.where("doc_id % 5 = 0").withColumn("quality", F.lit(9))
    new = t.pages.where("page_id % 50 = 0").select((F.col("page_id") + 10000000).alias("doc_id"), F.lit(9).alias("quality"), F.lit(0).alias("toxic"))
    return files.upsert(t.labels, changed.unionByName(new), ["doc_id"])


TERM_LIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+')"


@query(
    "ml01_document_frequency",
    f"""WITH w AS (SELECT doc_id, {TERM_LIST} AS a FROM documents), t AS (SELECT doc_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM w),
 c AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
 SELECT term, df::BIGINT AS df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf FROM c, n WHERE df >= 2 AND df <= floor(n * 0.98::DOUBLE)""",
)
def document_frequency(t: Tables):
    out = model.document_frequency(t.documents, id_col="doc_id", text_col="text", row_each=True)
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "ml01_tfidf",
    f"""WITH w AS (SELECT conv_id, {TERM_LIST} AS a FROM conversations), t AS (SELECT conv_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM w),
 n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), d AS (SELECT term, count(DISTINCT conv_id) AS df FROM t GROUP BY term), i AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM d, n WHERE df >= 2 AND df <= floor(n * 0.98::DOUBLE)),
 c AS (SELECT conv_id, term, count(*) AS tf FROM t GROUP BY ALL), x AS (SELECT conv_id, c.term, (1 + ln(tf)) * idf AS w FROM c JOIN i ON c.term = i.term)
 SELECT conv_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id)), 6) AS weight FROM x""",
)
def tfidf(t: Tables):
    """A document is a conversation with all its turns, in both counts."""
    frequency = model.document_frequency(t.conversations, id_col="conv_id", text_col="text")
    return model.tfidf(t.conversations.select("conv_id", "text"), frequency, id_col="conv_id", text_col="text").select("conv_id", "term", F.round("weight", 6).alias("weight"))


#: Terms that a dictionary keeps.
TERMS = 200_000


def _labelled(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return terms.spread(rows, "doc_id")


@query("ml02_logistic")
def logistic_fit(t: Tables):
    rows = _labelled(t)
    seen = terms.vectors(rows, terms.dictionary(rows, text_col="text"), text_col="text", keep=["doc_id", "label"])
    scored = logistic.fit(seen, size=TERMS).score(seen, "doc_id", "label")
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("ml03_platt")
def platt(t: Tables):
    rows = predicted(t).select("id", F.col("label").cast("double").alias("label"), (F.col("p") * 4 - 2).alias("margin"))
    fitted = model.platt(rows, margin_col="margin")
    return t.spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double")


@query("ml04_class_column", f"SELECT id, p >= 0.5 AS ai FROM ({PREDICTED})")
def class_column(t: Tables):
    return predicted(t).select("id", (F.get(F.array(1 - F.col("p"), F.col("p")), 1) >= 0.5).alias("ai"))


@query(
    "ml05_temperature_grid",
    f"""WITH g AS (SELECT round(0.05::DOUBLE + i * (4.95::DOUBLE / 99), 6) AS temperature FROM range(100) AS r(i)), z AS (SELECT temperature, CASE WHEN label = 1 THEN -(p * 4 - 2) ELSE p * 4 - 2 END / temperature AS z FROM ({PREDICTED}), g)
 SELECT temperature, round(avg(greatest(z, 0) + ln(1 + exp(-abs(z)))), 6) AS loss FROM z GROUP BY temperature""",
)
def temperature_grid(t: Tables):
    rows = predicted(t).select("label", (F.col("p") * 4 - 2).alias("margin"))
    return model.temperature_grid(rows, margin="margin", label="label").select("temperature", F.round("loss", 6).alias("loss"))


# Kinds of models and the files that each needs.
REGISTRY = Rows("name string, kind string", [(n, "sklearn" if n == "logreg" else "peft" if n in ("distilbert-lora", "distilbert-mica") else "encoder" if "bert" in n else "causal") for n in MODEL_NAMES])
LISTING = Rows("name string, file string", [("logreg", "model.joblib"), ("logreg", "meta.json"), ("distilbert", "model.safetensors"), ("gpt2-fixed", "detector-config.json")])
NEEDED = Rows("kind string, file string", [("sklearn", "model.joblib"), ("encoder", "model.safetensors"), ("peft", "adapter.safetensors"), ("causal", "detector-config.json")])


@query("ml07_readiness", f"WITH r AS (SELECT * FROM {REGISTRY.sql}), l AS (SELECT * FROM {LISTING.sql}), n AS (SELECT * FROM {NEEDED.sql}) SELECT r.name, r.kind, l.file IS NOT NULL AS ready FROM r JOIN n ON r.kind = n.kind LEFT JOIN l ON l.name = r.name AND l.file = n.file")
def readiness(t: Tables):
    need = REGISTRY.frame(t.spark).join(F.broadcast(NEEDED.frame(t.spark)), "kind")
    there = LISTING.frame(t.spark).withColumn("ready", F.lit(True))
    return need.join(F.broadcast(there), ["name", "file"], "left").select("name", "kind", F.coalesce("ready", F.lit(False)).alias("ready"))


@query("ml09_encodings", "SELECT conv_id, turn, length(text) + 1 <= 512 AS fits, least(length(text), 511) + 1 AS used FROM conversations")
def encodings(t: Tables):
    return t.conversations.select("conv_id", "turn", (F.length("text") + 1 <= 512).alias("fits"), (F.least(F.length("text"), F.lit(511)) + 1).cast("long").alias("used"))


@query("ml10_learning_curve")
def learning_curve(t: Tables):
    from corpuslab.operators.sampling import nested_order, subset_sizes

    rows = _labelled(t).withColumn("name", F.col("label").cast("string"))
    held = rows.where("doc_id % 5 = 0")
    train = shared.stage(nested_order(rows.where("doc_id % 5 <> 0"), stratum="name", id_col="doc_id", seed=17), "train")
    points = model.learning_curve(train, held, subset_sizes(train.count(), (0.25, 1.0)), text_col="text")
    return t.spark.createDataFrame(points, "training_samples long, training_accuracy double, validation_accuracy double, generalization_gap double")


@query("ml11_rewards", f"SELECT lang, round(avg((1 - {PROB}) * least(n_chars, 1000)::DOUBLE / greatest(n_chars, 1000)), 6) AS reward, count(*) FILTER (WHERE {PROB} = 0)::BIGINT AS zeros FROM documents GROUP BY lang")
def rewards(t: Tables):
    from corpuslab.functions.values import reward
    from corpuslab.plans.scalars import prob

    return t.documents.groupBy("lang").agg(F.round(F.avg(reward(prob(), F.col("n_chars"), F.lit(1000))), 6).alias("reward"), F.count_if(prob() == 0).alias("zeros"))


@query("flagship_bias", f"SELECT bin, label, count(*)::BIGINT AS n, round(avg(p), 6) AS mean FROM ({PREDICTED}) GROUP BY bin, label")
def flagship(t: Tables):
    return predicted(t).groupBy("bin", "label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"))
