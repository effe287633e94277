"""Filters, joins, aggregates, windows, quotas, splits, sets, similarity, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.functions import values as V
from corpuslab.operators import chunking, evaluate, sampling, similarity, splits
from corpuslab.operators.ordering import numbered, numbered_in
from corpuslab.plans.registry import Rows, Tables, query, repaired_folds_sql
from corpuslab.plans.scalars import DOC_WORDS, MODELS, NEAREST, PROB, WORDS, prob, sized

# Filters

CUTOFF = "TIMESTAMP '1995-06-30 00:00:00'"


@query("flt01_cutoff", f"SELECT o_orderkey, (o_orderdate IS NULL OR o_orderdate <= {CUTOFF}) AS null_passes, coalesce(o_orderdate <= {CUTOFF}, FALSE) AS null_fails FROM orders")
def cutoff(t: Tables):
    early = F.col("o_orderdate") <= F.lit("1995-06-30").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.coalesce(early, F.lit(True)).alias("null_passes"), F.coalesce(early, F.lit(False)).alias("null_fails"))


LICENSES = Rows("license string", [("CC0",), ("cc-zero",), ("CC BY",), ("cc by-nc",), ("",), (None,)])


def pmc_license(name):
    bare = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(bare.isin("cc0", "cc zero"), "CC0 1.0").when(bare == "cc by", "CC BY 4.0")


@query("flt02_license_whitelist", f"SELECT license, CASE WHEN trim(regexp_replace(lower(license), '[^a-z0-9]+', ' ', 'g')) IN ('cc0', 'cc zero') THEN 'CC0 1.0' WHEN trim(regexp_replace(lower(license), '[^a-z0-9]+', ' ', 'g')) = 'cc by' THEN 'CC BY 4.0' END AS name FROM {LICENSES.sql}")
def license_whitelist(t: Tables):
    return LICENSES.frame(t.spark).select("license", pmc_license(F.col("license")).alias("name"))


# Licence links and names.
LINKS = Rows(
    "url string, name string",
    [(f"{scheme}://creativecommons.org/{path}/", name) for scheme in ("http", "https") for path, name in (("licenses/by/4.0", "CC BY 4.0"), ("licenses/by-sa/4.0", "CC BY-SA 4.0"), ("publicdomain/zero/1.0", "CC0 1.0"))],
)
ASKED = Rows("id int, url string", [(1, "http://creativecommons.org/licenses/by/4.0/"), (2, "https://creativecommons.org/licenses/by-nc/4.0/"), (3, "https://creativecommons.org/publicdomain/zero/1.0/"), (4, None)])


@query("flt03_license_lookup", f"WITH links AS (SELECT * FROM {LINKS.sql}), asked AS (SELECT * FROM {ASKED.sql}) SELECT id, links.name AS name FROM asked JOIN links ON asked.url = links.url")
def license_lookup(t: Tables):
    return ASKED.frame(t.spark).join(F.broadcast(LINKS.frame(t.spark)), "url").select("id", "name")


TERMS = Rows(
    "id int, terms string",
    [(1, "Creative Commons  Attribution 4.0 International"), (2, "creative commons attribution license, NonCommercial"), (3, "see creativecommons.org/licenses/by/4.0"), (4, "by-nc creativecommons.org/licenses/by/4.0"), (5, "all rights")],
)
# Terms that close and terms that open a licence.
DENY, ALLOW = "noncommercial|no derivatives|noderivatives|by-nc|by-nd", r"creativecommons\.org/licenses/by/4\.0|creative commons attribution 4\.0 international|creative commons attribution license"


@query("flt04_license_terms", rf"WITH n AS (SELECT id, lower(regexp_replace(terms, '\s+', ' ', 'g')) AS v FROM {TERMS.sql}) SELECT id, NOT regexp_matches(v, '{DENY}') AND regexp_matches(v, '{ALLOW}') AS open FROM n")
def license_terms(t: Tables):
    v = F.lower(F.regexp_replace("terms", r"\s+", " "))
    return TERMS.frame(t.spark).select("id", (~v.rlike(DENY) & v.rlike(ALLOW)).alias("open"))


@query(
    "flt05_license_era",
    "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1994-04-08' THEN 'CC BY-SA 2.5' WHEN o_orderdate < TIMESTAMP '1997-05-02' THEN 'CC BY-SA 3.0' ELSE 'CC BY-SA 4.0' END AS era FROM orders",
)
def license_era(t: Tables):
    before = lambda d: F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.when(before("1994-04-08"), "CC BY-SA 2.5").when(before("1997-05-02"), "CC BY-SA 3.0").otherwise("CC BY-SA 4.0").alias("era"))


RECORDS = Rows("id int, doi string, journal string", [(1, "10.1371/JOURNAL.1", None), (2, "10.1/x", "PLoS ONE"), (3, "10.1/x", "Nature"), (4, None, None)])


@query("flt06_journal_prefix", f"SELECT id, coalesce(starts_with(lower(doi), '10.1371/'), FALSE) OR coalesce(starts_with(lower(journal), 'plos'), FALSE) AS plos FROM {RECORDS.sql}")
def journal_prefix(t: Tables):
    starts = lambda c, p: F.coalesce(F.lower(c).startswith(p), F.lit(False))
    return RECORDS.frame(t.spark).select("id", (starts("doi", "10.1371/") | starts("journal", "plos")).alias("plos"))


@query("flt07_skip_seen", "SELECT min(page_id) AS page_id, url FROM pages WHERE NOT lower(url) LIKE '%list-of-%' GROUP BY url")
def skip_seen(t: Tables):
    return sampling.dedup_first(t.pages.where(~F.lower("url").like("%list-of-%")), "url", "page_id")


@query("flt08_minimum_bytes", "SELECT page_id, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE octet_length(encode(html)) >= 8000")
def minimum_bytes(t: Tables):
    return t.pages.select("page_id", F.octet_length("html").cast("long").alias("bytes")).where("bytes >= 8000")


@query(
    "flt09_eligibility",
    "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'None' WHEN l.toxic = 1 THEN l.quality || '-not-public' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def eligibility(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "None").when(F.col("toxic") == 1, F.concat(F.col("quality").cast("string"), F.lit("-not-public")))
    return rows.select("doc_id", reason.alias("reason"))


ASKS = Rows(
    "id int, q string",
    [(1, "What background should a careful reader have before starting?"), (2, "Too short?"), (3, "This one has enough words but no mark at all"), (4, "Does the provided passage explain why this happens so often?"), (5, "Is it one? Or is it two questions in a row?"), (6, "")],
)
QW = r"len(regexp_extract_all(q, '\S+'))"


@query("flt10_question_valid", f"SELECT id, CASE WHEN NOT q LIKE '%?' THEN 'does not end with a question mark' WHEN {QW} NOT BETWEEN 8 AND 80 THEN 'has ' || {QW} || ' words; expected 8 to 80' ELSE '' END AS reason FROM {ASKS.sql}")
def question_valid(t: Tables):
    n = X.word_count(F.col("q"))
    reason = F.when(~F.col("q").endswith("?"), "does not end with a question mark").when(~n.between(8, 80), F.format_string("has %d words; expected 8 to 80", n)).otherwise("")
    return ASKS.frame(t.spark).select("id", reason.alias("reason"))


@query(
    "flt11_prompt_question_valid",
    f"SELECT id, q LIKE '%?' AND length(q) - length(replace(q, '?', '')) = 1 AND {QW} BETWEEN 6 AND 60 AND NOT regexp_matches(lower(q), 'source material|provided passage|writing dataset') AS valid FROM {ASKS.sql}",
)
def prompt_question_valid(t: Tables):
    one = F.length("q") - F.length(F.replace("q", F.lit("?"), F.lit(""))) == 1
    clean = ~F.lower("q").rlike("source material|provided passage|writing dataset")
    return ASKS.frame(t.spark).select("id", (F.col("q").endswith("?") & one & X.word_count(F.col("q")).between(6, 60) & clean).alias("valid"))


NAMES = Rows("topic string", [("software upgrade safety",), ("one",), ("well-known facts",), ("Upper Case",), ("a b c d e f g h i j k",), ("with 2 digits",)])


@query("flt12_topic_valid", rf"SELECT topic, len(regexp_extract_all(topic, '\S+')) BETWEEN 2 AND 10 AND regexp_full_match(topic, '[a-z]+(?:[ -][a-z]+)*') AS valid FROM {NAMES.sql}")
def topic_valid(t: Tables):
    return NAMES.frame(t.spark).select("topic", (X.word_count(F.col("topic")).between(2, 10) & F.col("topic").rlike("^[a-z]+(?:[ -][a-z]+)*$")).alias("valid"))


@query(
    "flt13_response_valid",
    f"""SELECT doc_id, CASE WHEN text = '' THEN 'is empty' WHEN w NOT BETWEEN greatest(1, floor(250 * 0.8::DOUBLE)) AND ceil(250 * 1.2::DOUBLE) THEN 'has ' || w || ' words; expected 200 to 300'
 WHEN regexp_matches(lower(text), 'as a language model|requested word count') THEN 'mentions the generation process' ELSE '' END AS reason FROM ({DOC_WORDS})""",
)
def response_valid(t: Tables):
    low, high = X.response_bounds(F.lit(250), 0.2)
    reason = F.when(F.col("text") == "", "is empty").when(~F.col("w").between(low, high), F.format_string("has %d words; expected %d to %d", "w", low, high))
    reason = reason.when(F.lower("text").rlike("as a language model|requested word count"), "mentions the generation process").otherwise("")
    return sized(t).select("doc_id", reason.alias("reason"))


EDITS = [
    (1, "Her three letter were left unread upon a dusty shelf.", "Her three letters were left unread upon a dusty shelf.", "light"),
    (2, "nothing new here", " nothing new here", "light"),
    (3, "Rain fell on the harbour while two boats came home.", "Under grey clouds a pair of vessels reached their port.", "light"),
    (4, " ".join(f"n{i}" for i in range(80)), " ".join("other" if i == 7 else f"n{i}" for i in range(80)), "moderate"),
    (5, "p q r", "", "moderate"),
    (6, "alpha beta gamma", "as a language model I rewrote it", "light"),
]


@query("flt14_edit_valid")
def edit_valid(t: Tables):
    rows = t.spark.createDataFrame(EDITS, "id int, original string, edited string, level string")
    return rows.select("id", similarity.validate_edit(F.col("original"), F.col("edited"), F.col("level")).alias("reason"))


@query("flt15_stored_prompt", "SELECT conv_id, turn, trim(text) <> '' AS valid FROM conversations")
def stored_prompt(t: Tables):
    return t.conversations.select("conv_id", "turn", (X.strip(F.col("text")) != "").alias("valid"))


# Words of the sensitive-topic filter.
SENSITIVE = (
    "biolog(?:y|ical)|biochem(?:istry|ical)|biomed(?:ical|icine)|biotech(?:nology|nological)?|genom(?:e|es|ic|ics)|genetic(?:s|ally)?|protein(?:s)?|enzyme(?:s)?|dna|rna|"
    "virus(?:es)?|viral|pathogen(?:s|ic)?|bacteri(?:a|al|um)|fung(?:us|i|al)|vaccine(?:s|ation)?|disease(?:s)?|clinical|medical|medicine|health(?:care)?|patient(?:s)?|"
    "therapy|treatment(?:s)?|pharmaceutical(?:s)?|drug(?:s)?|cancer|oncolog(?:y|ical)"
)


@query("flt16_sensitive_topic", rf"SELECT lang, count(*) FILTER (WHERE regexp_matches(text || ' ' || CASE WHEN doc_id % 7 = 0 THEN 'Viral Patients' ELSE '' END, '(?i)\b(?:{SENSITIVE})\b'))::BIGINT AS hits FROM documents GROUP BY lang")
def sensitive_topic(t: Tables):
    text = F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 7 == 0, "Viral Patients").otherwise(""))
    return t.documents.groupBy("lang").agg(F.count_if(text.rlike(rf"(?i)\b(?:{SENSITIVE})\b")).alias("hits"))


@query("flt17_blank_texts", r"SELECT doc_id FROM documents WHERE text IS NULL OR regexp_full_match(text, '\s*')")
def blank_texts(t: Tables):
    return t.documents.where(F.col("text").isNull() | (X.strip(F.col("text")) == "")).select("doc_id")


P = Rows("p double", [(0.0,), (1.0,), (0.123456,), (1.5,), (-0.1,), (None,)])


@query("flt18_probability_gate", f"SELECT p, p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1 AS valid FROM {P.sql}")
def probability_gate(t: Tables):
    return P.frame(t.spark).select("p", (F.col("p").isNotNull() & ~F.isnan("p") & F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("valid"))


SCORES = Rows("id int, raw string", [(1, '{"ai_score": 73}'), (2, '{"ai_score": 101}'), (3, '{"ai_score": 50.0}'), (4, '{"ai_score": true}'), (5, '{"ai_score": "7"}'), (6, "{broken"), (7, '{"x": 1, "ai_score": 0}')])


@query("flt19_structured_score", f"SELECT id, CASE WHEN json_valid(raw) AND json_type(raw, '$.ai_score') IN ('UBIGINT', 'BIGINT') AND (raw->>'$.ai_score')::INT BETWEEN 0 AND 100 THEN (raw->>'$.ai_score')::INT END AS score FROM {SCORES.sql}")
def structured_score(t: Tables):
    return SCORES.frame(t.spark).select("id", V.json_score(F.col("raw")).alias("score"))


PERCENTS = Rows("raw string", [(" 37% ",), ("100",), ("101%",), ("abc",), ("-1",), ("12.5%",)])


@query("flt20_percentage", f"SELECT raw, CASE WHEN try_cast(regexp_replace(trim(raw), '%$', '') AS DOUBLE) BETWEEN 0 AND 100 THEN try_cast(regexp_replace(trim(raw), '%$', '') AS DOUBLE) END AS value FROM {PERCENTS.sql}")
def percent(t: Tables):
    return PERCENTS.frame(t.spark).select("raw", V.percentage(F.col("raw")).alias("value"))


@query("flt21_minimum_words", f"SELECT doc_id, w FROM ({DOC_WORDS}) WHERE w >= 50")
def minimum_words(t: Tables):
    return sized(t).where("w >= 50").select("doc_id", "w")


def _declared(t: Tables):
    rows = sized(t)
    wrong = F.col("doc_id") % 11
    rows = rows.withColumn("sha", F.when(wrong == 1, F.lit("0")).when(wrong == 2, F.sha2(F.concat("text", F.lit("\n")), 256)).otherwise(F.sha2("text", 256)))
    return rows.withColumn("declared", F.when(wrong == 3, F.col("w") + 1).otherwise(F.col("w")))


@query(
    "flt22_integrity",
    f"""WITH d AS (SELECT doc_id, text, w, CASE doc_id % 11 WHEN 1 THEN '0' WHEN 2 THEN sha256(text || chr(10)) ELSE sha256(text) END AS sha, CASE WHEN doc_id % 11 = 3 THEN w + 1 ELSE w END AS declared FROM ({DOC_WORDS}))
 SELECT doc_id, 'hash' AS rule FROM d WHERE sha NOT IN (sha256(text), sha256(text || chr(10))) UNION ALL SELECT doc_id, 'word-count' FROM d WHERE declared <> w""",
)
def integrity(t: Tables):
    rows = _declared(t)
    rules = F.array(
        F.when(~F.col("sha").isin(F.sha2("text", 256), F.sha2(F.concat("text", F.lit("\n")), 256)), "hash"),
        F.when(F.col("declared") != F.col("w"), "word-count"),
    )
    return rows.select("doc_id", F.explode(F.array_compact(rules)).alias("rule"))


@query("flt23_prompt_integrity", f"SELECT doc_id FROM ({DOC_WORDS}) WHERE CASE WHEN doc_id % 11 = 3 THEN w + 1 ELSE w END <> w")
def prompt_integrity(t: Tables):
    return _declared(t).where("declared <> w").select("doc_id")


@query(
    "flt24_key_mismatch",
    "SELECT doc_id, 'missing' AS side FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'extra' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)",
)
def key_mismatch(t: Tables):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("extra")))


@query(
    "flt25_generator_match",
    f"SELECT id, coalesce(provider = 'openai' AND (requested_model IN ('m2', 'luna-high') OR model IN ('m2', 'luna-high') OR model_selection IN ('m2', 'luna-high')) AND effort = 'high', FALSE) AS matches FROM {MODELS.sql}",
)
def generator_match(t: Tables):
    named = F.coalesce(F.arrays_overlap(F.array_compact(F.array("requested_model", "model", "model_selection")), F.array(F.lit("m2"), F.lit("luna-high"))), F.lit(False))
    same = (F.col("provider") == "openai") & named & F.col("effort").eqNullSafe("high")
    return MODELS.frame(t.spark).select("id", same.alias("matches"))


CONFIGS = Rows("run string, k string, v string", [("a", "model", "m"), ("a", "seed", "17"), ("b", "model", "m"), ("b", "seed", "18"), ("c", "model", "m")])
WANT = Rows("k string, v string", [("model", "m"), ("seed", "17")])


@query(
    "flt26_config_match",
    f"WITH c AS (SELECT * FROM {CONFIGS.sql}), w AS (SELECT * FROM {WANT.sql}) SELECT run, count(w.k) = (SELECT count(*) FROM w) AS reusable FROM c LEFT JOIN w ON c.k = w.k AND c.v = w.v GROUP BY run",
)
def config_match(t: Tables):
    want = WANT.frame(t.spark).withColumn("hit", F.lit(1))
    return CONFIGS.frame(t.spark).join(F.broadcast(want), ["k", "v"], "left").groupBy("run").agg((F.count("hit") == len(WANT.rows)).alias("reusable"))


LISTS = Rows("raw string", [("pmc, ArXiv ,",), ("all",), ("pmc,unknown,zzz",)])
# Names of the sources.
SOURCES = ("pmc", "plos", "wikimedia", "stackexchange", "gutenberg", "openstax", "arxiv")


@query(
    "flt27_source_list",
    f"""WITH s AS (SELECT raw, CASE WHEN lower(trim(raw)) = 'all' THEN {list(SOURCES)} ELSE list_filter(list_transform(string_split(raw, ','), lambda x: lower(trim(x))), lambda x: x <> '') END AS a FROM {LISTS.sql})
 SELECT raw, array_to_string(a, ',') AS sources, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains({list(SOURCES)}, x))), ',') AS invalid FROM s""",
)
def source_list(t: Tables):
    known = F.array(*map(F.lit, SOURCES))
    given = F.filter(F.transform(F.split("raw", ","), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    a = F.when(F.lower(F.btrim("raw")) == "all", known).otherwise(given)
    return LISTS.frame(t.spark).select("raw", F.array_join(a, ",").alias("sources"), F.array_join(F.array_sort(F.array_except(a, known)), ",").alias("invalid"))


# Joins


@query(
    "join01_seed_records",
    """SELECT a.conv_id, a.turn, s.turn AS seed_turn, CASE WHEN s.turn IS NULL THEN 'missing seed' WHEN length(s.text) > length(a.text) THEN 'longer seed' ELSE '' END AS problem
 FROM conversations a LEFT JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = a.turn - 1 AND s.role = 'user' WHERE a.role = 'assistant'""",
)
def seed_records(t: Tables):
    seeds = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("seed_turn"), F.col("text").alias("seed_text"))
    rows = t.conversations.where("role = 'assistant'").withColumn("seed_turn", F.col("turn") - 1)
    out = rows.join(seeds.withColumn("found", F.lit(True)), ["conv_id", "seed_turn"], "left")
    problem = F.when(F.col("found").isNull(), "missing seed").when(F.length("seed_text") > F.length("text"), "longer seed").otherwise("")
    return out.select("conv_id", "turn", F.when(F.col("found"), F.col("seed_turn")).alias("seed_turn"), problem.alias("problem"))


@query("join02_missing_seeds", "SELECT DISTINCT doc_id * 3 AS seed FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)")
def missing_seeds(t: Tables):
    return t.labels.select((F.col("doc_id") * 3).alias("seed")).distinct().join(t.documents.select(F.col("doc_id").alias("seed")), "seed", "left_anti")


@query("join03_unreserved", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id + 1 FROM labels WHERE toxic = 1)")
def unreserved(t: Tables):
    reserved = t.labels.where("quality = 1").select("doc_id").union(t.labels.where("toxic = 1").select(F.col("doc_id") + 1))
    return t.documents.select("doc_id").join(reserved, "doc_id", "left_anti")


@query("join04_existing_files", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_files(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_semi")


@query("join05_results", "SELECT d.doc_id, d.source, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def results(t: Tables):
    return t.labels.join(t.documents, "doc_id").select("doc_id", "source", "quality")


PASSES = f"""SELECT d.doc_id AS id, k AS pass, l.quality AS label, (n_chars * 7919 + d.doc_id * 104729 + k * 7907) % 101 AS score,
 ((n_chars * 7919 + d.doc_id * 104729 + k * 7907) % 101 >= 50)::INT AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id, range(1, 6) AS p(k)"""


def passes(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    score = (F.col("n_chars") * 7919 + F.col("doc_id") * 104729 + F.col("pass") * 7907) % 101
    return rows.select(F.col("doc_id").alias("id"), "pass", F.col("quality").alias("label"), score.alias("score"), (score >= 50).cast("int").alias("prediction"))


@query("join06_aligned_passes", f"SELECT id, count(*)::BIGINT AS passes, string_agg(score::VARCHAR, ',' ORDER BY pass) AS scores FROM ({PASSES}) GROUP BY id")
def aligned_passes(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pass", "score"))), lambda x: x["score"].cast("string"))
    return passes(t).groupBy("id").agg(F.count("*").alias("passes"), F.array_join(ordered, ",").alias("scores"))


@query("join07_unique_keys", "SELECT url, count(*)::BIGINT AS n FROM pages GROUP BY url HAVING count(*) > 1")
def unique_keys(t: Tables):
    return t.pages.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "join08_positional_equality",
    "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM labels) SELECT count(*)::BIGINT AS differing FROM a FULL JOIN b ON a.pos = b.pos WHERE a.doc_id IS DISTINCT FROM b.doc_id",
)
def positional_equality(t: Tables):
    place = lambda d, name: numbered(d.select(F.col("doc_id").alias(name)), [name], "pos")
    both = place(t.documents, "a").join(place(t.labels, "b"), "pos", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count("*").alias("differing"))


CATALOG = Rows("lang string, name string", [("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")])


@query("join09_dimension", f"SELECT doc_id, name FROM documents JOIN (SELECT * FROM {CATALOG.sql}) c ON documents.lang = c.lang")
def dimension(t: Tables):
    return t.documents.join(F.broadcast(CATALOG.frame(t.spark)), "lang").select("doc_id", "name")


BINS = Rows("bin int, lo bigint, hi bigint", [(i, lo, hi if hi else 1 << 40) for i, (_, lo, hi) in enumerate(evaluate.CORPUS_BINS)])


@query("join10_range_lookup", f"SELECT d.doc_id, b.bin FROM ({DOC_WORDS}) d JOIN (SELECT * FROM {BINS.sql}) b ON d.w BETWEEN b.lo AND b.hi")
def range_lookup(t: Tables):
    return sized(t).join(F.broadcast(BINS.frame(t.spark)), F.col("w").between(F.col("lo"), F.col("hi"))).select("doc_id", "bin")


@query("join11_as_of", f"SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= {CUTOFF} GROUP BY o_custkey")
def as_of(t: Tables):
    rows = t.orders.where(F.col("o_orderdate") <= F.lit("1995-06-30").cast("timestamp_ntz"))
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


# Names of the models.
MODEL_NAMES = ("logreg", "distilbert", "distilbert-lora", "distilbert-mica", "modernbert", "gpt2-variable", "gpt2-fixed", "qwen3-variable", "qwen3-fixed")


@query("join12_models_by_samples", f"SELECT m.name AS model, count(*)::BIGINT AS n, round(avg((n_chars * (7919 + m.i) + doc_id * 104729) % 10001), 6) AS mean FROM documents, (SELECT unnest({list(MODEL_NAMES)}) AS name, generate_subscripts({list(MODEL_NAMES)}, 1) AS i) m GROUP BY m.name")
def models_by_samples(t: Tables):
    # Nine models a sample: a generator in the row, no join.
    rows = t.documents.select("doc_id", "n_chars", F.posexplode(F.array(*map(F.lit, MODEL_NAMES))).alias("i", "model"))
    p = (F.col("n_chars") * (7920 + F.col("i")) + F.col("doc_id") * 104729) % 10001
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean"))


# Aggregates

CORPUS_BIN = "CASE WHEN w <= 50 THEN 0 WHEN w <= 100 THEN 1 WHEN w <= 250 THEN 2 WHEN w <= 500 THEN 3 WHEN w <= 1000 THEN 4 WHEN w <= 2000 THEN 5 ELSE 6 END"
BIAS_BIN = "CASE WHEN w <= 60 THEN 0 WHEN w <= 120 THEN 1 WHEN w <= 300 THEN 2 WHEN w <= 600 THEN 3 ELSE 4 END"
PREDICTED = f"SELECT d.doc_id AS id, d.w, d.lang, l.quality AS label, l.toxic, {PROB.replace('doc_id', 'd.doc_id')} AS p, ({PROB.replace('doc_id', 'd.doc_id')} >= 0.5)::INT AS prediction, {BIAS_BIN} AS bin FROM ({DOC_WORDS}) d JOIN labels l ON d.doc_id = l.doc_id"


def predicted(t: Tables):
    rows = sized(t).join(t.labels, "doc_id").withColumn("p", prob())
    return rows.select(F.col("doc_id").alias("id"), "w", "lang", F.col("quality").alias("label"), "toxic", "p", (F.col("p") >= 0.5).cast("int").alias("prediction"), evaluate.bias_bin(F.col("w")).alias("bin"))


@query("agg01_length_histogram", f"WITH c AS (SELECT lang, {CORPUS_BIN} AS bin, count(*) AS n FROM ({DOC_WORDS}) GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents), range(7) AS b(bin)) SELECT g.lang, g.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(100 * coalesce(n, 0) / sum(n) OVER (PARTITION BY g.lang), 6) AS share FROM g LEFT JOIN c ON g.lang = c.lang AND g.bin = c.bin")
def length_histogram(t: Tables):
    rows = sized(t).withColumn("bin", evaluate.corpus_bin(F.col("w")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("total"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(7)])
    counts = counts.select("lang", "total", F.posexplode(F.array(*[f"b{i}" for i in range(7)])).alias("bin", "n"))
    return counts.select("lang", "bin", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share"))


@query("agg02_length_summary", f"SELECT lang, count(*)::BIGINT AS n, median(w) AS median, round(avg(w), 6) AS mean, min(w) AS low, max(w) AS high FROM ({DOC_WORDS}) GROUP BY lang")
def length_summary(t: Tables):
    return sized(t).groupBy("lang").agg(F.count("*").alias("n"), F.median("w").alias("median"), F.round(F.avg("w"), 6).alias("mean"), F.min("w").alias("low"), F.max("w").alias("high"))


@query("agg03_label_counts", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE quality = 0)::BIGINT AS human, count(*) FILTER (WHERE quality = 1)::BIGINT AS ai FROM labels")
def label_counts(t: Tables):
    return t.labels.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 0).alias("human"), F.count_if(F.col("quality") == 1).alias("ai"))


@query("agg04_exclusions", "SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l.quality IS NULL THEN 'None' WHEN l.toxic = 1 THEN l.quality || '-not-public' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE reason IS NOT NULL GROUP BY reason")
def exclusions(t: Tables):
    return eligibility(t).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


SPLIT_SQL = "(SELECT *, CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM events)"


def with_split(t: Tables):
    seat = F.col("event_id") % 10
    return t.events.withColumn("split", F.when(seat == 0, "test").when(seat == 1, "validation").otherwise("train"))


@query("agg05_split_summary", f"SELECT split, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS groups FROM {SPLIT_SQL} GROUP BY GROUPING SETS ((split), (split, event_type))")
def split_summary(t: Tables):
    rows = with_split(t)
    return rows.groupingSets([["split"], ["split", "event_type"]], "split", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("groups"))


@query("agg06_split_overlap", f"WITH g AS (SELECT DISTINCT split, user_id FROM {SPLIT_SQL}) SELECT a.split AS one, b.split AS other, count(*)::BIGINT AS shared FROM g a JOIN g b ON a.user_id = b.user_id AND a.split < b.split GROUP BY ALL")
def split_overlap(t: Tables):
    # At most three splits a group: pairs come from the group's own short list.
    own = with_split(t).groupBy("user_id").agg(F.collect_set("split").alias("s"))
    one = own.select("s", F.explode("s").alias("one")).select("one", F.explode("s").alias("other"))
    return one.where("one < other").groupBy("one", "other").agg(F.count("*").alias("shared"))


@query("agg07_bin_crosstab", f"SELECT bin, count(*) FILTER (WHERE label = 0)::BIGINT AS human, count(*) FILTER (WHERE label = 1)::BIGINT AS ai FROM ({PREDICTED}) GROUP BY bin")
def bin_crosstab(t: Tables):
    return predicted(t).groupBy("bin").agg(F.count_if(F.col("label") == 0).alias("human"), F.count_if(F.col("label") == 1).alias("ai"))


CELLS = "count(*) FILTER (WHERE label = 0 AND prediction = 0)::BIGINT AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1)::BIGINT AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0)::BIGINT AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1)::BIGINT AS tp"
METRICS = f"""SELECT bin, count(*)::BIGINT AS samples, {CELLS}, avg((label = prediction)::INT) AS accuracy, 100 * avg(p) FILTER (WHERE label = 0) AS mean_human_score, 100 * avg(p) FILTER (WHERE label = 1) AS mean_ai_score,
 avg((p - label) * (p - label)) AS brier FROM ({PREDICTED}) GROUP BY bin"""
RATES = f"SELECT *, mean_ai_score - mean_human_score AS separation, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr FROM ({METRICS})"
MEASURES = ("accuracy", "mean_human_score", "mean_ai_score", "brier", "separation", "fpr", "fnr")


@query("agg08_bias_by_bin", f"SELECT bin, samples, tn, fp, fn, tp, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM ({RATES})")
def bias_by_bin(t: Tables):
    return evaluate.group_metrics(predicted(t), ["bin"]).select("bin", "samples", "tn", "fp", "fn", "tp", *[F.round(m, 6).alias(m) for m in MEASURES])


@query("agg09_bias_shift", f"SELECT round(arg_max_null(mean_human_score, bin) - arg_min_null(mean_human_score, bin), 6) AS human_shift, round(arg_max_null(mean_ai_score, bin) - arg_min_null(mean_ai_score, bin), 6) AS ai_shift, round(arg_max_null(separation, bin) - arg_min_null(separation, bin), 6) AS separation_change, round(max(accuracy) - min(accuracy), 6) AS accuracy_range, round(max(fpr) - min(fpr), 6) AS fpr_range, round(max(fnr) - min(fnr), 6) AS fnr_range FROM ({RATES})")
def bias_shift(t: Tables):
    by = evaluate.group_metrics(predicted(t), ["bin"])
    shift = lambda m: F.round(F.max_by(m, "bin") - F.min_by(m, "bin"), 6)
    spread = lambda m: F.round(F.max(m) - F.min(m), 6)
    return by.agg(
        shift("mean_human_score").alias("human_shift"),
        shift("mean_ai_score").alias("ai_shift"),
        shift("separation").alias("separation_change"),
        *[spread(m).alias(f"{m}_range") for m in ("accuracy", "fpr", "fnr")],
    )


@query(
    "agg10_spearman",
    f"WITH r AS (SELECT label, w, rank() OVER (PARTITION BY label ORDER BY w) + (count(*) OVER (PARTITION BY label, w) - 1) / 2 AS a, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2 AS b FROM ({PREDICTED})) SELECT label, round(CASE WHEN min(w) < max(w) THEN corr(a, b) END, 6) AS spearman FROM r GROUP BY label",
)
def spearman(t: Tables):
    return evaluate.spearman(predicted(t), ["label"], "w", "p").select("label", F.round("spearman", 6).alias("spearman"))


@query("agg11_pass_summary", f"SELECT pass, count(*)::BIGINT AS samples, round(avg((label = prediction)::INT), 6) AS accuracy, {CELLS}, round(avg(score), 6) AS mean_latency, round(coalesce(stddev_samp(score), 0), 6) AS std_latency, sum(greatest(id % 3 - 1, 0))::BIGINT AS retries FROM ({PASSES}) GROUP BY pass")
def pass_summary(t: Tables):
    return passes(t).groupBy("pass").agg(
        F.count("*").alias("samples"),
        F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"),
        *evaluate.confusion(),
        F.round(F.avg("score"), 6).alias("mean_latency"),
        F.round(evaluate.std0("score"), 6).alias("std_latency"),
        F.sum(F.greatest(F.col("id") % 3 - 1, F.lit(0))).alias("retries"),
    )


@query(
    "agg12_agreement",
    f"""WITH s AS (SELECT id, count(*) AS n, sum(prediction) AS votes, min(label) AS label, coalesce(stddev_samp(score), 0) AS spread, avg(score) AS mean FROM ({PASSES}) WHERE pass <= 4 GROUP BY id),
 v AS (SELECT *, CASE WHEN votes * 2 = n THEN (mean >= 50)::INT ELSE (votes * 2 > n)::INT END AS prediction FROM s)
 SELECT sum(n)::BIGINT AS classifications, round(avg((votes = 0 OR votes = n)::INT), 6) AS unanimous, round(avg(spread), 6) AS mean_spread, round(avg((label = prediction)::INT), 6) AS majority_accuracy, {CELLS} FROM v""",
)
def agreement(t: Tables):
    out = evaluate.agreement(passes(t).where("pass <= 4"), 50)
    return out.select("classifications", *[F.round(c, 6).alias(c) for c in ("unanimous", "mean_spread", "majority_accuracy")], "tn", "fp", "fn", "tp")


ELAPSED = "SELECT event_id % 5 AS device, value + 1 AS s FROM events"


def elapsed(t: Tables):
    return t.events.select((F.col("event_id") % 5).alias("device"), (F.col("value") + 1).alias("s"))


LAT = ("mean_seconds", "std_seconds", "ms_per_text", "texts_per_second", "std_texts_per_second")


@query("agg13_latency", f"SELECT device, round(avg(s), 6) AS mean_seconds, round(coalesce(stddev_samp(s), 0), 6) AS std_seconds, round(avg(s) / 100 * 1000, 6) AS ms_per_text, round(avg(100 / s), 6) AS texts_per_second, round(coalesce(stddev_samp(100 / s), 0), 6) AS std_texts_per_second FROM ({ELAPSED}) GROUP BY device")
def latency(t: Tables):
    return evaluate.latency(elapsed(t), ["device"], "s", F.lit(100)).select("device", *[F.round(c, 6).alias(c) for c in LAT])


@query("agg14_throughput_of_mean", f"SELECT device, round(100 / avg(s), 6) AS texts_over_mean_time FROM ({ELAPSED}) GROUP BY device")
def throughput_of_mean(t: Tables):
    return evaluate.latency(elapsed(t), ["device"], "s", F.lit(100)).select("device", F.round("texts_over_mean_time", 6).alias("texts_over_mean_time"))


VERDICT = "SELECT quality AS truth, CASE WHEN toxic = 1 THEN 'Mixed' WHEN doc_id % 9 = 0 THEN 'AI' WHEN quality = 1 THEN 'AI' ELSE 'Human' END AS verdict FROM labels"


def verdicts(t: Tables):
    verdict = F.when(F.col("toxic") == 1, "Mixed").when(F.col("doc_id") % 9 == 0, "AI").when(F.col("quality") == 1, "AI").otherwise("Human")
    return t.labels.select(F.col("quality").alias("truth"), verdict.alias("verdict"))


@query("agg15_external_matrix", f"SELECT truth, verdict, count(*)::BIGINT AS n, verdict NOT IN ('AI', 'Human') AS unresolved FROM ({VERDICT}) GROUP BY truth, verdict")
def external_matrix(t: Tables):
    return verdicts(t).groupBy("truth", "verdict").agg(F.count("*").alias("n")).withColumn("unresolved", ~F.col("verdict").isin("AI", "Human"))


@query("agg16_mixed_as_ai", f"SELECT truth, CASE verdict WHEN 'Mixed' THEN 'AI' ELSE verdict END AS verdict, count(*)::BIGINT AS n FROM ({VERDICT}) GROUP BY ALL")
def mixed_as_ai(t: Tables):
    return verdicts(t).withColumn("verdict", F.when(F.col("verdict") == "Mixed", "AI").otherwise(F.col("verdict"))).groupBy("truth", "verdict").agg(F.count("*").alias("n"))


@query("agg17_usage_totals", "SELECT event_type, sum(coalesce(json_extract_string(props, '$.k')::BIGINT, 0))::BIGINT AS input_tokens, sum(coalesce(json_extract_string(props, '$.cached')::BIGINT, 0))::BIGINT AS cached FROM events GROUP BY event_type")
def usage_totals(t: Tables):
    usage = F.from_json("props", "k bigint, cached bigint")
    rows = t.events.select("event_type", usage.alias("usage"))
    return rows.groupBy("event_type").agg(F.sum(F.coalesce("usage.k", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("usage.cached", F.lit(0))).alias("cached"))


@query("agg18_step_means", "SELECT event_id // 1000 AS step, round(avg(value), 6) AS mean_value, round(sum(value) / (max(event_id) - min(event_id) + 1), 6) AS rate FROM events GROUP BY 1")
def step_means(t: Tables):
    return t.events.groupBy(F.floor(F.col("event_id") / 1000).alias("step")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value") / (F.max("event_id") - F.min("event_id") + 1), 6).alias("rate"))


@query("agg19_uniqueness", "SELECT count(*) = count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT text) AS texts, count(*) = count(DISTINCT source) AS sources FROM documents")
def uniqueness(t: Tables):
    # One pass a column over hashes keeps wide texts out of the shuffle.
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "source")
    return rows.agg((F.count("*") == F.count_distinct("doc_id")).alias("ids"), (F.count("*") == F.count_distinct("h")).alias("texts"), (F.count("*") == F.count_distinct("source")).alias("sources"))


@query("agg20_group_leaks", f"SELECT user_id, count(DISTINCT split)::BIGINT AS splits FROM {SPLIT_SQL} GROUP BY user_id HAVING count(DISTINCT split) > 1")
def group_leaks(t: Tables):
    return splits.leaking_groups(with_split(t), group="user_id")


FOLDS = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, max_by(event_type, (n, event_type)) AS main, sum(n) AS size FROM c GROUP BY user_id),
 o AS (SELECT user_id, row_number() OVER (ORDER BY main, size DESC, sha256('17:fold:' || user_id), user_id) - 1 AS k FROM g), f AS (SELECT user_id, CASE WHEN (k // 10) % 2 = 0 THEN k % 10 ELSE 9 - k % 10 END::INT AS fold FROM o)"""
FOLD_ROWS = "SELECT e.*, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM events e JOIN f ON e.user_id = f.user_id"


def with_fold(t: Tables):
    """Events with the split of their group, as SPL-01 assigns it."""
    return t.events.join(splits.assign_folds(t.events, group="user_id", stratum="event_type", seed=17), "user_id")


@query("agg20_fold_leaks", "SELECT count(DISTINCT user_id)::BIGINT AS groups, 0::BIGINT AS leaking FROM events")
def fold_leaks(t: Tables):
    each = with_fold(t).groupBy("user_id").agg(F.count_distinct("split").alias("s"))
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("s") > 1).alias("leaking"))


@query(
    "agg21_fold_shares",
    f"""{FOLDS}, x AS ({FOLD_ROWS}), b AS (SELECT split, count(*) AS n, sum((event_type = 'purchase')::INT) AS p FROM x GROUP BY split), s AS (SELECT split, n, n / sum(n) OVER () AS share, p / n - sum(p) OVER () / sum(n) OVER () AS gap FROM b)
 SELECT split, n::BIGINT AS n, round(share, 6) AS share, round(gap, 6) AS gap, abs(share - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) <= 0.015 AND abs(gap) <= 0.02 AS passes FROM s""",
)
def fold_shares(t: Tables):
    rows = with_fold(t).withColumn("bought", F.col("event_type") == "purchase")
    return splits.split_shares(rows, positive="bought", targets={"train": 0.8, "test": 0.1, "validation": 0.1})


@query(
    "agg21_tolerances",
    f"""{FOLDS}, x AS ({FOLD_ROWS}), b AS (SELECT split, count(*) AS n, sum((event_type = 'purchase')::INT) AS p FROM x GROUP BY split), s AS (SELECT split, n / sum(n) OVER () AS share, p / n - sum(p) OVER () / sum(n) OVER () AS gap FROM b)
 SELECT split, 'share' AS rule, round(share, 6) AS value FROM s WHERE abs(share - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) > 0.001 UNION ALL SELECT split, 'balance', round(gap, 6) FROM s WHERE abs(gap) > 0.001""",
)
def tolerances(t: Tables):
    """On the assigned folds, with bounds so close that some are passed."""
    rows = with_fold(t).withColumn("bought", F.col("event_type") == "purchase")
    return splits.tolerance_violations(rows, positive="bought", targets={"train": 0.8, "test": 0.1, "validation": 0.1}, share=0.001, balance=0.001)


@query("evl01_agreement_percent", f"SELECT lang, tp, fn, fp, tn, round(100 * (tp + tn) / (tp + tn + fp + fn), 6) AS agreement FROM (SELECT lang, {CELLS} FROM ({PREDICTED}) GROUP BY lang)")
def agreement_percent(t: Tables):
    by = predicted(t).groupBy("lang").agg(*evaluate.confusion())
    return by.select("lang", "tp", "fn", "fp", "tn", F.round(100 * (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6).alias("agreement"))


Q = "least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"


@query("evl02_log_loss", f"SELECT lang, round(avg(-CASE WHEN label = 1 THEN ln({Q}) ELSE ln(1 - {Q}) END), 6) AS log_loss, round(avg((p - label) * (p - label)), 6) AS brier, round(avg((label = prediction)::INT), 6) AS accuracy FROM ({PREDICTED}) GROUP BY lang")
def log_loss(t: Tables):
    rows = predicted(t)
    brier = (F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))
    return rows.groupBy("lang").agg(
        F.round(F.avg(evaluate.log_loss(F.col("p"), F.col("label"))), 6).alias("log_loss"),
        F.round(F.avg(brier), 6).alias("brier"),
        F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"),
    )


@query("evl03_confident_errors", f"SELECT id, label, prediction, CASE WHEN prediction = 1 THEN p ELSE 1 - p END AS confidence FROM ({PREDICTED}) WHERE label <> prediction ORDER BY confidence DESC, id LIMIT 20")
def confident_errors(t: Tables):
    rows = predicted(t).where("label <> prediction")
    return rows.select("id", "label", "prediction", F.when(F.col("prediction") == 1, F.col("p")).otherwise(1 - F.col("p")).alias("confidence")).orderBy(F.desc("confidence"), "id").limit(20)


@query("evl04_thresholds", f"SELECT id, (p >= 0.5)::INT AS half, (p * 100 >= 70)::INT AS seventy FROM ({PREDICTED})")
def thresholds(t: Tables):
    return predicted(t).select("id", (F.col("p") >= 0.5).cast("int").alias("half"), (F.col("p") * 100 >= 70).cast("int").alias("seventy"))


# Windows, top-k, quotas, splits


@query("win01_dedup_hash", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_hash(t: Tables):
    return sampling.dedup_first(t.documents.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("win02_hash_sample", "SELECT quality, doc_id, n AS position FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('20260804:' || quality || ':' || doc_id), doc_id)::INT AS n FROM labels) WHERE n <= 20")
def hash_sample(t: Tables):
    return sampling.hash_sample(t.labels, label="quality", id_col="doc_id", seed=20260804, count=20).select("quality", "doc_id", "position")


@query("win03_source_cap", "SELECT lang, doc_id, n AS position FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS n FROM documents) WHERE n <= 25")
def source_cap(t: Tables):
    return sampling.capped(t.documents, group="lang", order="doc_id", cap=25).select("lang", "doc_id", "position")


@query(
    "win04_year_quotas",
    """WITH RECURSIVE c AS (SELECT year(o_orderdate)::BIGINT AS yr, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT yr, n, row_number() OVER (ORDER BY yr DESC) AS i, count(*) OVER () AS years FROM c),
 f AS (SELECT yr, least(n, ceil(5000 / years)::BIGINT)::BIGINT AS taken, (5000 - least(n, ceil(5000 / years)::BIGINT))::BIGINT AS rest, i FROM y WHERE i = 1
 UNION ALL SELECT y.yr, least(y.n, ceil(f.rest / (y.years - f.i))::BIGINT)::BIGINT, (f.rest - least(y.n, ceil(f.rest / (y.years - f.i))::BIGINT))::BIGINT, y.i FROM f JOIN y ON y.i = f.i + 1)
 SELECT yr, taken FROM f""",
)
def year_quotas(t: Tables):
    counts = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return sampling.year_quotas(counts, year="yr", available="n", total=5000)


@query(
    "win05_even_pick",
    "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda k: round_even(k * (n - 1) / 11.0::DOUBLE, 0)::BIGINT), i)",
)
def even_pick(t: Tables):
    rows = numbered_in(t.documents.select("lang", "doc_id"), "lang", ["doc_id"], "i")
    return rows.where(V.even_index(F.col("i"), F.col("i_of"), 12)).select("lang", "doc_id")


@query("win06_next_id", "SELECT page_id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY page_id) AS new_id FROM pages")
def next_id(t: Tables):
    top = t.documents.agg(F.max("doc_id").alias("top"))
    rows = numbered(t.pages.select("page_id"), ["page_id"], "n")
    return rows.join(F.broadcast(top)).select("page_id", (F.col("top") + F.col("n") + 1).alias("new_id"))


@query("win07_advantage", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 0.0001::DOUBLE), 6) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey) QUALIFY count(*) OVER w >= 2")
def advantage(t: Tables):
    own = Window.partitionBy("l_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - F.avg("l_quantity").over(own)) / (F.stddev_pop("l_quantity").over(own) + 0.0001)).alias("a"), F.count("*").over(own).alias("n"))
    return rows.where("n >= 2").select("l_orderkey", "l_linenumber", F.round("a", 6).alias("advantage"))


# A topic's first twelve rows take the twelve templates, so the recursion ends there.
FREE = "list_filter(list_transform(range(0, 12), lambda k: (r.start + k) % 12), lambda c: NOT list_contains(f.used, c))[1]"


@query(
    "win08_template_rotation",
    f"""WITH RECURSIVE r AS (SELECT doc_id, source AS topic, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 12 AS start, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
 f AS (SELECT doc_id, topic, n, start AS template, [start] AS used FROM r WHERE n = 1 UNION ALL SELECT r.doc_id, r.topic, r.n, {FREE}, list_append(f.used, {FREE}) FROM f JOIN r ON r.topic IS NOT DISTINCT FROM f.topic AND r.n = f.n + 1 WHERE r.n <= 12)
 SELECT r.doc_id, r.topic, f.template FROM r LEFT JOIN f ON r.doc_id = f.doc_id""",
)
def template_rotation(t: Tables):
    from corpuslab.operators.rotation import rotate

    rows = t.documents.select("doc_id", F.col("source").alias("topic"), (F.pmod(V.hash_int(F.col("doc_id").cast("string")), F.lit(12))).alias("start"))
    return rotate(rows, id_col="doc_id", topic_col="topic", start_col="start", templates=12)


@query("win09_round_robin", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 3 AS endpoint, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def round_robin(t: Tables):
    rows = numbered(t.documents.select("doc_id"), ["doc_id"])
    return rows.select("doc_id", (F.col("position") % 3).alias("endpoint"), F.floor(F.col("position") / 16).alias("batch"))


STEPS = Rows("name string", [("step-00001-final",), ("step-00050",), ("step-00500",), ("step-01000",), ("step-01550",), ("step-05000",), ("step-0",), ("other",)])


@query("top01_checkpoints", rf"SELECT name, regexp_extract(name, '^step-(\d+)$', 1)::INT AS step FROM {STEPS.sql} WHERE regexp_full_match(name, 'step-\d+') AND regexp_extract(name, '^step-(\d+)$', 1)::INT > 0 AND regexp_extract(name, '^step-(\d+)$', 1)::INT % 500 = 0")
def checkpoints(t: Tables):
    step = F.regexp_extract("name", r"^step-(\d+)$", 1).try_cast("int")
    return STEPS.frame(t.spark).select("name", step.alias("step")).where("step > 0 and step % 500 = 0").orderBy("step")


@query("top02_pending", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 100")
def pending(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("top03_balanced_subset", "SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('17:' || quality || ':' || doc_id), doc_id) AS n FROM labels) WHERE n <= CASE quality WHEN 0 THEN 13 ELSE 12 END")
def balanced_subset(t: Tables):
    human, ai = sampling.half_counts(25)
    return sampling.hash_sample(t.labels, label="quality", id_col="doc_id", seed=17, count=F.when(F.col("quality") == 0, human).otherwise(ai)).select("quality", "doc_id")


QUOTAS = """WITH s AS (SELECT {0} AS stratum, count(*) AS available FROM documents GROUP BY 1), e AS (SELECT *, ({1} * available) // sum(available) OVER () AS base, ({1} * available) % sum(available) OVER () AS remainder FROM s),
 q AS (SELECT stratum, available, base + (row_number() OVER (ORDER BY remainder DESC, available DESC, stratum DESC) <= {1} - sum(base) OVER ())::INT AS quota FROM e)"""


@query("qta01_quotas", f"{QUOTAS.format('lang', 100)} SELECT stratum AS lang, available, quota::BIGINT AS quota FROM q")
def quotas(t: Tables):
    return sampling.quotas(t.documents, stratum="lang", count=100)


@query(
    "qta02_stratified_pick",
    f"""{QUOTAS.format("lang || '|' || source", 120)}, r AS (SELECT doc_id, lang || '|' || source AS stratum, row_number() OVER (PARTITION BY lang || '|' || source ORDER BY sha256('17:train:' || lang || '|' || source || ':' || doc_id), doc_id) AS n FROM documents)
 SELECT doc_id, row_number() OVER (ORDER BY sha256('17:train:final-order:' || doc_id), doc_id) AS position FROM r JOIN q ON r.stratum = q.stratum WHERE n <= quota""",
)
def stratified_pick(t: Tables):
    rows = t.documents.select("doc_id", F.concat_ws("|", "lang", "source").alias("stratum"))
    return sampling.stratified_pick(rows, stratum="stratum", id_col="doc_id", count=120, seed=17, split="train").select("doc_id", "position")


@query(
    "qta03_nested_order",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('17:' || lang || ':' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
 SELECT doc_id, lang, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n), lang DESC, k) - 1 AS position FROM r""",
)
def nested_order(t: Tables):
    return sampling.nested_order(t.documents.select("doc_id", "lang"), stratum="lang", id_col="doc_id", seed=17)


@query("qta04_subset_sizes", "SELECT DISTINCT least(greatest(2, round_even(f * n, 0)), n)::BIGINT AS size FROM (SELECT count(*) AS n FROM labels), (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS f)")
def subset_sizes(t: Tables):
    n = t.labels.agg(F.count("*").alias("n"))
    fractions = F.array(*[F.lit(f) for f in (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)])
    size = F.least(F.greatest(F.lit(2), F.bround(F.col("f") * F.col("n"), 0)), F.col("n")).cast("long")
    return n.select("n", F.explode(fractions).alias("f")).select(size.alias("size")).distinct()


@query("spl01_assign_folds", f"{FOLDS} SELECT user_id, fold, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM f")
def assign_folds(t: Tables):
    return splits.assign_folds(t.events, group="user_id", stratum="event_type", seed=17)


# Users, but for one group that holds 8 % of all rows: no deal of whole groups is even then.
SKEWED = "SELECT CASE WHEN event_id % 25 < 2 THEN 'hot' ELSE user_id::VARCHAR END AS grp, event_type FROM events"


def skewed(t: Tables):
    return t.events.select(F.when(F.col("event_id") % 25 < 2, "hot").otherwise(F.col("user_id").cast("string")).alias("grp"), "event_type")


def repaired(t: Tables, search: bool):
    rows = skewed(t)
    folds = splits.assign_folds(rows, group="grp", stratum="event_type", seed=17)
    return splits.repair_folds(rows, folds, group="grp", stratum="event_type", seed=17, search=search)


@query("spl01_exchanged_folds", f"WITH r AS ({SKEWED}), {repaired_folds_sql('r', 'event_type')} SELECT grp, fold, split FROM f")
def exchanged_folds(t: Tables):
    """The repair without its last search, which SQL can't express."""
    return repaired(t, search=False)


@query("agg21_repaired_shares")
def repaired_shares(t: Tables):
    """No SQL: the gates on the folds of the whole repair; ``tests/test_splits.py`` asserts that they hold."""
    rows = skewed(t).join(repaired(t, search=True), "grp").withColumn("bought", F.col("event_type") == "purchase")
    return splits.split_shares(rows, positive="bought", targets={"train": 0.8, "test": 0.1, "validation": 0.1})


@query("spl02_group_ids", "SELECT doc_id, lang || ':' || (doc_id // 5) AS group_id FROM documents")
def group_ids(t: Tables):
    return t.documents.select("doc_id", F.concat_ws(":", "lang", F.floor(F.col("doc_id") / 5).cast("string")).alias("group_id"))


@query("grp01_claims", "SELECT CASE WHEN n <= 30 THEN 'openai' WHEN n <= 50 THEN 'gemini' ELSE 'ollama' END AS job, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('17:claim:' || doc_id), doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE n <= 60")
def claims(t: Tables):
    free = t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")
    return sampling.claims(free, id_col="doc_id", jobs=[("openai", 30), ("gemini", 20), ("ollama", 10)], seed=17)


# Sets


@query("set01_union", "SELECT doc_id AS id, 'human' AS label FROM documents WHERE lang = 'en' UNION ALL SELECT page_id, 'ai' FROM pages")
def union(t: Tables):
    return t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("human").alias("label")).unionByName(t.pages.select(F.col("page_id").alias("id"), F.lit("ai").alias("label")))


@query("set02_union_predictions", f"SELECT id, 'a' AS model, p FROM ({PREDICTED}) UNION ALL SELECT id, 'b', 1 - p FROM ({PREDICTED})")
def union_predictions(t: Tables):
    rows = predicted(t)
    return rows.select("id", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("p").alias("p")), F.struct(F.lit("b").alias("model"), (1 - F.col("p")).alias("p")))).alias("x")).select("id", "x.model", "x.p")


@query("set03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(t: Tables):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("set04_intersection", f"SELECT user_id FROM {SPLIT_SQL} WHERE split = 'test' INTERSECT SELECT user_id FROM {SPLIT_SQL} WHERE split = 'validation'")
def intersection(t: Tables):
    rows = with_split(t)
    return rows.where("split = 'test'").select("user_id").intersect(rows.where("split = 'validation'").select("user_id"))


@query("set05_nestedness", "SELECT doc_id FROM labels WHERE FALSE")
def nestedness(t: Tables):
    sample = lambda k: sampling.hash_sample(t.labels, label="quality", id_col="doc_id", seed=17, count=k).select("doc_id")
    return sample(10).join(sample(30), "doc_id", "left_anti")


# Similarity, chunks

TOKENS_A = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*')"


@query(
    "sim01_overlap",
    f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS l, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 t AS (SELECT conv_id, turn, unnest({TOKENS_A.replace('text', 'l')}) AS w, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest({TOKENS_A.replace('text', 'r')}), 0, 1 FROM p),
 c AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL)
 SELECT p.conv_id, p.turn, round(coalesce(x.o, 0), 6) AS overlap FROM p LEFT JOIN (SELECT conv_id, turn, 2 * sum(least(a, b)) / sum(a + b) AS o FROM c GROUP BY ALL) x ON p.conv_id = x.conv_id AND p.turn = x.turn""",
)
def overlap(t: Tables):
    left = t.conversations.select("conv_id", "turn", F.col("text").alias("l"))
    right = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    out = similarity.overlap_ratio(left.join(right, ["conv_id", "turn"]), ["conv_id", "turn"], "l", "r")
    return out.select("conv_id", "turn", F.round("overlap", 6).alias("overlap"))


@query("sim02_character_ratio")
def character_ratio(t: Tables):
    rows = t.spark.createDataFrame(EDITS, "id int, original string, edited string, level string")
    ratio = similarity.character_ratio(F.col("original"), F.col("edited"))
    return rows.select("id", F.round(ratio, 6).alias("ratio"), F.round(1 - ratio, 6).alias("magnitude"), F.round(similarity.similarity(F.col("original"), F.col("edited")), 6).alias("similarity"))


@query(
    "chk01_chunks",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS a, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS s FROM documents WHERE len(regexp_extract_all(text, '\S+')) >= 50),
 c AS (SELECT doc_id, s, len(a) AS n, 1 AS k, 0 AS lo, CASE WHEN len(a) - least([50, 100, 250, 500, 1000][s + 1], len(a)) BETWEEN 1 AND 49 THEN len(a) ELSE least([50, 100, 250, 500, 1000][s + 1], len(a)) END AS hi FROM d
  UNION ALL SELECT doc_id, s, n, k + 1, hi, CASE WHEN n - least(hi + [50, 100, 250, 500, 1000][(s + k) % 5 + 1], n) BETWEEN 1 AND 49 THEN n ELSE least(hi + [50, 100, 250, 500, 1000][(s + k) % 5 + 1], n) END FROM c WHERE n - hi >= 50),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM c)
 SELECT r.doc_id, k::BIGINT AS chunk, [50, 100, 250, 500, 1000][(r.s + k - 1) % 5 + 1]::INT AS target, sha256(array_to_string(d.a[lo + 1 : hi], ' ')) AS digest FROM r JOIN d ON r.doc_id = d.doc_id
 WHERE m <= 12 OR list_contains(list_transform(range(0, 12), lambda x: round_even(x * (m - 1) / 11.0::DOUBLE, 0)::BIGINT), i)""",
)
def chunks(t: Tables):
    # Documents hold no character references, so cleaning leaves their words as they are.
    out = chunking.chunk_documents(t.documents, id_col="doc_id", text_col="text", key=F.col("doc_id").cast("string"))
    return out.select("doc_id", "chunk", "target", F.sha2("piece", 256).alias("digest"))
