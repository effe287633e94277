"""Passes that are taken up again, score caches, a policy trained step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import passes, policy
from corpuslab.plans.registry import Tables, query
from corpuslab.plans.scalars import PROB, prob
from corpuslab.sources import shared

FAILS = "('0x' || substr(sha256(doc_id || ':' || k), 1, 8))::BIGINT % 4 = 0"


def _judge(rows):
    """Replies of a judge that fails by a hash of row and attempt."""
    lost = passes.failing(F.col("doc_id"), F.col("attempt"))
    return rows.select("doc_id", "attempt", F.when(~lost, F.floor(prob() * 100).cast("double")).alias("score"))


@query(
    "ml12_resumed_passes",
    f"""WITH RECURSIVE a AS (SELECT doc_id, 1 AS k, {FAILS.replace('k)', '1)')} AS failed FROM documents UNION ALL SELECT doc_id, k + 1, {FAILS.replace('k)', '(k + 1))')} FROM a WHERE failed AND k < 3)
 SELECT a.doc_id, max(k)::INT AS tries, max(CASE WHEN NOT failed THEN floor({PROB.replace('n_chars', 'd.n_chars').replace('doc_id', 'd.doc_id')} * 100)::DOUBLE END) AS score FROM a JOIN documents d ON a.doc_id = d.doc_id GROUP BY a.doc_id""",
)
def resumed_passes(t: Tables):
    """A pass that ended after one round over part of the rows, and attempts under another configuration; the next run goes on."""
    at = shared.folder(t.spark, "passes")
    docs = t.documents.select("doc_id", "n_chars")
    passes.judge_all(docs, id_col="doc_id", call=lambda r: r.select("doc_id", "attempt", F.lit(1.0).alias("score")), at=at, config="other", most=1)
    passes.judge_all(docs.where("doc_id < 100000 or n_chars < 500"), id_col="doc_id", call=_judge, at=at, config="this", most=1)
    return passes.judge_all(docs, id_col="doc_id", call=_judge, at=at, config="this")


MODELS_RUN = "(VALUES (1, 'a', TRUE), (1, 'b', TRUE), (2, 'a', FALSE), (2, 'b', FALSE), (3, 'a', FALSE), (3, 'b', TRUE))"


@query(
    "join12_score_cache",
    f"""SELECT run, model, count(*)::BIGINT AS scores, (CASE WHEN fresh THEN count(*) ELSE 0 END)::BIGINT AS scored, round(sum(CASE model WHEN 'a' THEN {PROB} ELSE 1 - {PROB} END), 4) AS total
 FROM documents, {MODELS_RUN} AS v(run, model, fresh) GROUP BY run, model, fresh""",
)
def score_cache(t: Tables):
    """Three runs over one cache: all is scored, nothing is, and then only what the changed signature of one model asks for."""
    at, out = shared.folder(t.spark, "scores"), None
    docs = t.documents.select("doc_id", "n_chars")
    score = lambda rows, model: rows.select("doc_id", (prob() if model == "a" else 1 - prob()).alias("score"))
    for run, models in enumerate(({"a": "a1", "b": "b1"}, {"a": "a1", "b": "b1"}, {"a": "a1", "b": "b2"}), 1):
        found = passes.cached_scores(docs, id_col="doc_id", models=models, score=score, at=at)
        found = found.groupBy("model").agg(F.count("*").alias("scores"), F.count_if("fresh").alias("scored"), F.round(F.sum("score"), 4).alias("total"))
        found = shared.stage(found.select(F.lit(run).alias("run"), "model", "scores", "scored", "total"), "run")
        out = found if out is None else out.unionByName(found)
    return out


TEMPLATES, STEPS = 5, 10
REWARD = "((doc_id * 31 + {t} * 17) % 101)::DOUBLE / 200 + {t}::DOUBLE / 10"


def _policy_sql() -> str:
    steps = [f"l0 AS MATERIALIZED (SELECT t, 0::DOUBLE AS x FROM range({TEMPLATES}) AS r(t))"]
    for k in range(STEPS):
        steps += [
            f"p{k} AS MATERIALIZED (SELECT t, e / sum(e) OVER () AS p, coalesce(sum(e / z) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, CASE WHEN t = {TEMPLATES - 1} THEN 2 ELSE sum(e / z) OVER (ORDER BY t) END AS hi FROM (SELECT t, exp(x) AS e, sum(exp(x)) OVER () AS z FROM l{k}))",
            f"d{k} AS (SELECT doc_id, ('0x' || substr(sha256('{k}:' || doc_id || ':' || g), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents, range(4) AS r(g))",
            f"r{k} AS MATERIALIZED (SELECT doc_id, t, {REWARD.format(t='t')} AS r FROM d{k} JOIN p{k} ON u >= lo AND u < hi)",
            f"a{k} AS MATERIALIZED (SELECT t, (r - avg(r) OVER w) / (stddev_pop(r) OVER w + 0.0001::DOUBLE) AS a FROM r{k} WINDOW w AS (PARTITION BY doc_id) QUALIFY min(r) OVER w < max(r) OVER w)",
            f"s{k} AS MATERIALIZED (SELECT p.t, p.p, coalesce(sum(a), 0) AS a, count(a) AS n FROM p{k} p LEFT JOIN a{k} a ON a.t = p.t GROUP BY ALL)",
            f"l{k + 1} AS MATERIALIZED (SELECT l.t, x + (a - p * sum(a) OVER ()) / sum(n) OVER () AS x, -sum(a * ln(p)) OVER () / sum(n) OVER () AS loss FROM l{k} l JOIN s{k} s ON l.t = s.t)",
        ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {k} AS step, t::INT AS template, round(x, 6) AS logit, round(loss, 6) + 0 AS loss FROM l{k + 1}" for k in range(STEPS))


@query("ml11_policy", _policy_sql())
def policy_steps(t: Tables):
    reward = lambda k: ((F.col("doc_id") * 31 + k * 17) % 101).cast("double") / 200 + k.cast("double") / 10
    out = policy.train(t.documents.select("doc_id"), id_col="doc_id", reward=reward, templates=TEMPLATES, steps=STEPS)
    return out.select("step", "template", F.round("logit", 6).alias("logit"), (F.round("loss", 6) + 0.0).alias("loss"))  # no negative zero
