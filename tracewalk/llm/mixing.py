"""Mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token totals are raked:
scaled in turn so that they add up to the target totals by source, by language and by
topic. A document's sampling probability is its cell's multiplier, scaled so that the
expected tokens are the budget, and a hash of its id decides. All of it is
DataFrame work: one aggregation of the documents, windows over cells, and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, release

DIMENSIONS = ("source", "lang", "topic")
MISSING = "(none)"
DIGITS = "0123456789"
SYMBOLS = "#$%&*+=<>/|@^~{}[]_"
ROUNDS = 12
#: What ``mix`` adds.
COLUMNS = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_prob", "mix_sampled")
#: Rounds of raking in one plan, after which the cells are written.
ROUNDS_A_PLAN = 4


def token_count(text: Column) -> Column:
    """Runs of characters other than space, TAB, LF, FF and CR, over the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\f\r]+")), F.lit(0)).cast("long")


def register_topic(text: Column, tokens: Column) -> Column:
    """A coarse topic where documents bring none: the register of the whole text."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, DIGITS, ""))
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return (
        F.when(text.isNull() | (tokens == 0), F.lit("empty"))
        .when(symbols * 25 > n, F.lit("markup"))
        .when(digits * 25 > n, F.lit("numeric"))
        .when(tokens < 100, F.lit("brief"))
        .when(tokens < 1000, F.lit("article"))
        .otherwise(F.lit("long"))
    )


def uniform(doc_id: Column, salt: str) -> Column:
    """In [0, 1), from 52 bits of an md5: the same wherever and whenever it is computed."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the columns mix_source, mix_lang, mix_topic and mix_tokens."""
    text = F.col("text").cast("string")
    tokens = token_count(text)
    own = register_topic(text, tokens) if topic is None else F.coalesce(topic.cast("string"), F.lit(MISSING))
    return docs.withColumns({"mix_source": F.coalesce(F.col("source").cast("string"), F.lit(MISSING)), "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)), "mix_tokens": tokens, "mix_topic": own})


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with the column ``multiplier``: raked tokens over tokens.

    ``targets`` gives shares by dimension and value (in any unit; a value that is not
    named has none and gets no weight); a dimension that it does not name takes its own
    token shares to the power ``temper``. Every ROUNDS_A_PLAN rounds are written to the shared folder.
    """
    spark = cells.sparkSession
    cells = cells.where("tokens > 0")
    for d in DIMENSIONS:
        total = cells.groupBy(d).agg(F.sum("tokens").alias("own"))
        if targets and d in targets:
            asked = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, share double")
            total = total.join(asked, d, "left").select(d, F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            total = total.select(d, F.pow("own", F.lit(temper)).alias("share"))
        all_shares = total.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("s")).first().s
        total = total.select(d, (F.col("share") / F.lit(all_shares or 1.0)).alias(f"{d}_share"))
        cells = cells.join(total, d)
    cells = materialize(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    all_tokens = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
    for done in range(0, rounds, ROUNDS_A_PLAN):
        before = cells
        for _ in range(min(ROUNDS_A_PLAN, rounds - done)):
            for d in DIMENSIONS:
                here = F.sum("w").over(Window.partitionBy(d))
                cells = cells.withColumn("w", F.when(here > 0, F.col("w") * (F.col(f"{d}_share") * F.lit(float(all_tokens))) / here).otherwise(F.lit(0.0)))
        cells = materialize(cells, "raked")
        discard(before)
    out = cells.withColumn("multiplier", F.col("w") / F.col("tokens"))
    out._scratch_path = cells._scratch_path
    return out


def _scale(cells: DataFrame, budget: float) -> float:
    """c such that the sum of tokens * min(1, c * multiplier) is the budget, or all that have weight where that is less."""
    c, capped = 0.0, -1
    while True:
        full = F.col("multiplier") * F.lit(c) >= 1
        row = cells.where("multiplier > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens")).otherwise(F.lit(0))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("multiplier"))), F.lit(0.0)).alias("rest"),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)).alias("capped"),
            F.count("*").alias("n"),
            F.min("multiplier").alias("least"),
        ).first()
        if not row.n:
            return 0.0
        if row.rest <= 0 or budget <= row.kept:
            return max(c, 1 / row.least) if row.rest <= 0 else c
        if row.capped == capped:
            return c
        c, capped = (budget - row.kept) / row.rest, row.capped


def mix(docs: DataFrame, rate: float = 0.5, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.5, topic: Column | None = None, rounds: int = ROUNDS, salt: str = "mix:") -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` with mix_source, mix_lang, mix_topic, mix_tokens, mix_prob and mix_sampled.

    The expected tokens of the sampled documents are ``rate`` of all. Null sources,
    languages and topics are a value of their own; null and empty texts have no
    tokens, probability 0, and are not sampled. Rows with one doc_id and one cell are sampled alike, with a
    null doc_id too. Columns of the input are kept, unless they clash with these names. An empty table stays empty.
    """
    docs = docs.drop(*COLUMNS)
    rows = described(docs, topic)
    cells = rows.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix_tokens").alias("tokens"))
    totals = materialize(cells, "totals")
    cells = rake(totals, targets, temper, rounds)
    discard(totals)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    c = _scale(cells, rate * total.t)
    probs = materialize(cells.select(*(F.col(d).alias(f"__cell_{d}") for d in DIMENSIONS), F.least(F.lit(1.0), F.col("multiplier") * F.lit(c)).alias("__cell_prob")), "probabilities")
    discard(cells)
    release(docs.sparkSession)
    if total.n <= 50_000:  # some 5 MB at most; more cells than that are a skewed join that AQE splits
        probs = F.broadcast(probs)
    out = rows.join(probs, [F.col(f"mix_{d}") == F.col(f"__cell_{d}") for d in DIMENSIONS], "left")
    prob = F.when(F.col("mix_tokens") > 0, F.coalesce("__cell_prob", F.lit(0.0))).otherwise(F.lit(0.0))
    out = out.withColumn("mix_prob", prob).withColumn("mix_sampled", uniform(F.col("doc_id"), salt) < F.col("mix_prob"))
    return out.drop(*(f"__cell_{d}" for d in DIMENSIONS), "__cell_prob")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all columns as they are, those with the names of its own among them."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in COLUMNS}
    kept = mix(docs.withColumnsRenamed(own), **options).where("mix_sampled").drop(*COLUMNS)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def mix_sql(rate: float = 0.5, temper: float = 0.5, rounds: int = ROUNDS, salt: str = "mix:", steps: int = 12) -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    q = lambda s: s.replace("'", "''")
    out = f"""WITH a AS (
  SELECT doc_id, text, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')), 0) AS BIGINT) AS tokens FROM documents
), d AS (
  SELECT doc_id, source, lang, tokens, CASE
    WHEN text IS NULL OR tokens = 0 THEN 'empty'
    WHEN (length(text) - length(translate(text, '{q(SYMBOLS)}', ''))) * 25 > length(text) THEN 'markup'
    WHEN (length(text) - length(translate(text, '{DIGITS}', ''))) * 25 > length(text) THEN 'numeric'
    WHEN tokens < 100 THEN 'brief' WHEN tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM a
), cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)
"""
    for dim in DIMENSIONS:
        out += f", s_{dim} AS (SELECT {dim}, pow(sum(tokens), {temper}) AS x FROM cells GROUP BY 1), t_{dim} AS (SELECT {dim}, x / (SELECT sum(x) FROM s_{dim}) * (SELECT sum(tokens) FROM cells) AS total FROM s_{dim})\n"
    out += ", w0 AS (SELECT cells.*, tokens AS w, t_source.total AS ts, t_lang.total AS tl, t_topic.total AS tt FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))\n"
    n = 0
    for _ in range(rounds):
        for dim, t in zip(DIMENSIONS, ("ts", "tl", "tt"), strict=True):
            out += f", w{n + 1} AS (SELECT * REPLACE (w * {t} / sum(w) OVER (PARTITION BY {dim}) AS w) FROM w{n})\n"
            n += 1
    out += f", r AS (SELECT source, lang, topic, tokens, w / tokens AS m FROM w{n}), b AS (SELECT {rate} * sum(tokens) AS budget FROM r)\n, c0 AS (SELECT 0.0::DOUBLE AS c)\n"
    for i in range(steps):
        out += f", c{i + 1} AS (SELECT CASE WHEN sum(CASE WHEN m * c < 1 THEN tokens * m ELSE 0 END) > 0 THEN (any_value(budget) - sum(CASE WHEN m * c >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN m * c < 1 THEN tokens * m ELSE 0 END) ELSE any_value(c) END AS c FROM r, b, c{i})\n"
    out += f""", p AS (SELECT source, lang, topic, least(1.0, m * c) AS prob FROM r, c{steps})
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(CASE WHEN tokens > 0 THEN coalesce(prob, 0.0) ELSE 0.0 END, 9) AS prob,
       (('0x' || substr(md5('{q(salt)}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) < CASE WHEN tokens > 0 THEN coalesce(prob, 0.0) ELSE 0.0 END AS sampled
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    return out
