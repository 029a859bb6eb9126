"""Queries over the ticket corpus, each with its check."""

from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import scalars as S
from queuemill.functions import text as X
from queuemill.operators import features as FE
from queuemill.operators import screening as SC
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.runtime import materialise, rounded, table


def _q(text):
    return text.replace("'", "''")


def clean_sql(expr: str) -> str:
    """The cleaning chain for an engine whose word edges know ASCII only: accented letters become
    an underscore first, which is a word character there and is blanked like them at the end."""
    out = f"regexp_replace(lower({expr}), '[\\x{{C0}}-\\x{{24F}}]', '_', 'g')"
    for pattern in fixed.ARTEFACTS:
        out = f"regexp_replace({out}, '{_q(pattern)}', ' ', 'g')"
    for pattern, replacement in fixed.ABBREVIATIONS:
        out = f"regexp_replace({out}, '{_q(pattern)}', '{_q(replacement)}', 'g')"
    out = f"regexp_replace({out}, '[^a-z\\s]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def tokens_sql(expr: str) -> str:
    squeezed = f"trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {squeezed} = '' THEN 0 ELSE len(string_split({squeezed}, ' ')) END"


def strip_sql(expr):
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


RAW_SQL = f"trim(regexp_replace({strip_sql('subject')} || '. ' || {strip_sql('description')}, '\\s+', ' ', 'g'))"
_test = _q(fixed.TEST_TICKET)
_junk = _q(fixed.JUNK_DESCRIPTION)
IS_TEST = f"(regexp_matches(subject, '(?i){_test}') OR regexp_matches(description, '(?i){_test}'))"
NO_TEXT = f"(regexp_matches(description, '(?i){_junk}') AND length(subject) < 12)"

TAGGED = ("tg", f"""
SELECT *, CASE WHEN is_test THEN 1 WHEN rk > 1 THEN 2 WHEN {NO_TEXT} THEN 3 WHEN trim(category) = '' THEN 4
  WHEN trim(team) = '' THEN 5 ELSE 6 END AS fate
FROM (SELECT *, row_number() OVER (PARTITION BY is_test, subject, description, category, created ORDER BY ord) AS rk
      FROM (SELECT *, {IS_TEST} AS is_test FROM tk))""")
CLEANED = ("cl", f"""
SELECT *, trim(concat_ws(' ', subject_clean, subject_clean, desc_clean)) AS text FROM (
  SELECT *, {clean_sql('subject')} AS subject_clean, {clean_sql('description')} AS desc_clean FROM tg WHERE fate = 6)""")
PREPARED = ("pr", f"SELECT * FROM (SELECT *, {tokens_sql('text')} AS tokens FROM cl) WHERE tokens >= 3")
CORPUS = [V.TICKETS, TAGGED, CLEANED, PREPARED]


def _prepared(spark, sf):
    return SC.prepare(V.tickets(spark, sf))


@query("clean_text", with_ctes([V.TICKETS], f"""
SELECT ord, {clean_sql('subject')} AS subject_clean, {clean_sql('description')} AS desc_clean FROM tk"""))
def clean_text(spark, sf):
    return V.tickets(spark, sf).select("ord", X.clean_text(F.col("subject")).alias("subject_clean"),
                                       X.clean_text(F.col("description")).alias("desc_clean"))


@query("build_text", with_ctes([V.TICKETS], f"""
SELECT ord, trim(concat_ws(' ', {clean_sql('subject')}, {clean_sql('subject')}, {clean_sql('description')})) AS text FROM tk"""))
def build_text(spark, sf):
    return V.tickets(spark, sf).select("ord", X.build_text(F.col("subject"), F.col("description")).alias("text"))


@query("raw_text", with_ctes([V.TICKETS], f"SELECT ord, {RAW_SQL} AS raw FROM tk"))
def raw_text(spark, sf):
    return V.tickets(spark, sf).select("ord", X.raw_text(F.col("subject"), F.col("description")).alias("raw"))


@query("token_count", with_ctes([V.TICKETS], f"SELECT ord, CAST({tokens_sql('description')} AS BIGINT) AS tokens FROM tk"))
def token_count(spark, sf):
    return V.tickets(spark, sf).select("ord", X.token_count(F.col("description")).alias("tokens"))


SHAPE_SQL = f"""[ln(1 + CAST({tokens_sql(RAW_SQL)} AS DOUBLE)), ln(1 + CAST(length({RAW_SQL}) AS DOUBLE)),
  ln(1 + CAST({tokens_sql('subject')} AS DOUBLE)), CAST(contains({RAW_SQL}, '?') AS DOUBLE),
  CAST(regexp_matches({RAW_SQL}, '[0-9]') AS DOUBLE), CAST(regexp_matches({RAW_SQL}, '(?i)urgent|asap|immediately') AS DOUBLE)]"""
_PARSED = "try_strptime(created, '%Y-%m-%d %H:%M')"
_HOUR = f"CAST(coalesce(hour({_PARSED}), 12) AS DOUBLE)"
_DAY = f"CAST(coalesce(isodow({_PARSED}) - 1, 2) AS DOUBLE)"
TIME_SQL = f"""[sin(2 * pi() * {_HOUR} / 24), cos(2 * pi() * {_HOUR} / 24), sin(2 * pi() * {_DAY} / 7), cos(2 * pi() * {_DAY} / 7),
  CAST({_DAY} >= 5 AS DOUBLE), CAST({_HOUR} >= 8 AND {_HOUR} < 17 AS DOUBLE)]"""


def long_array(df, key, array, digits=6):
    """(key, dim, value) rows of an array column."""
    return df.select(key, F.posexplode(array).alias("dim", "value")).select(
        key, F.col("dim").cast("long").alias("dim"), rounded(F.col("value"), digits).alias("value"))


def long_array_sql(source, key, array):
    return f"""SELECT {key}, CAST(i - 1 AS BIGINT) AS dim, round(v[i], 6) + 0.0 AS value
FROM (SELECT {key}, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key}, {array} AS v FROM {source}))"""


@query("text_shape", with_ctes([V.TICKETS], long_array_sql("tk", "ord", SHAPE_SQL)))
def text_shape(spark, sf):
    return long_array(V.tickets(spark, sf), "ord", S.text_shape(F.col("subject"), F.col("description")))


@query("time_features", with_ctes([V.TICKETS], long_array_sql("tk", "ord", TIME_SQL)))
def time_features(spark, sf):
    return long_array(V.tickets(spark, sf), "ord", S.time_features(F.col("created")))


@query("dept_onehot", with_ctes([V.TICKETS, ("voc", """
SELECT list(department ORDER BY department) AS voc FROM (SELECT DISTINCT department FROM tk WHERE category <> 'de')""")],
    long_array_sql("(SELECT * FROM tk, voc)", "ord",
                   "list_transform(voc, lambda x: CAST(x = department AS DOUBLE))")))
def dept_onehot(spark, sf):
    tickets = V.tickets(spark, sf)
    vocabulary = FE.fit_vocabulary(tickets.where("category <> 'de'"), "department")
    return long_array(tickets, "ord", S.one_hot(F.col("department"), FE.literal_array(vocabulary)))


@query("label_codes", with_ctes(CORPUS, """
SELECT ord, CAST(dense_rank() OVER (ORDER BY category) - 1 AS BIGINT) AS y_category_id,
  CAST(dense_rank() OVER (ORDER BY team) - 1 AS BIGINT) AS y_team_id FROM pr"""))
def label_codes(spark, sf):
    # Three values a ticket, read three times: the screening runs once.
    prepared = materialise(_prepared(spark, sf).select("ord", "category", "team"), "labels")
    cats = SC.label_codes(prepared, "category").toDF("category", "y_category_id")
    teams = SC.label_codes(prepared, "team").toDF("team", "y_team_id")
    return prepared.join(cats, "category").join(teams, "team").select("ord", "y_category_id", "y_team_id")


@query("percent_of", """
SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 1) AS pct FROM documents GROUP BY source""")
def percent_of(spark, sf):
    from pyspark.sql import Window as W
    counted = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", SC.percent_of(F.col("n"), F.sum("n").over(W.partitionBy())))


@query("round_report", """
SELECT event_type, round(avg(value), 4) AS r4, round(avg(value), 3) AS r3, round(avg(value), 2) AS r2, round(avg(value), 1) AS r1
FROM events GROUP BY event_type""")
def round_report(spark, sf):
    mean = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return mean.select("event_type", *[rounded(F.col("m"), n).alias(f"r{n}") for n in (4, 3, 2, 1)])


def _filter_query(name, condition, run):
    query(name, with_ctes([V.TICKETS], f"SELECT ord, ticket_id FROM tk WHERE {condition}"))(
        lambda spark, sf: run(V.tickets(spark, sf)).select("ord", "ticket_id"))


_filter_query("drop_test_tickets", f"NOT {IS_TEST}", SC.drop_test_tickets)
_filter_query("drop_no_text", f"NOT {NO_TEXT}", SC.drop_no_text)
_filter_query("drop_unlabelled", "trim(category) <> ''", lambda t: SC.drop_blank(t, "category"))
_filter_query("drop_unassigned", "trim(team) <> ''", lambda t: SC.drop_blank(t, "team"))
_filter_query("resolved_corpus", "trim(resolution) <> ''", SC.resolved_corpus)


_FIRST = with_ctes([V.TICKETS], """
SELECT ord, ticket_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, description, category, created ORDER BY ord) AS rk
FROM tk) WHERE rk = 1""")


@query("drop_exact_duplicates", _FIRST)
def drop_exact_duplicates(spark, sf):
    return SC.drop_exact_duplicates(V.tickets(spark, sf)).select("ord", "ticket_id")


@query("first_occurrence", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_occurrence(spark, sf):
    return SC.first_occurrence(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "text")


@query("min_tokens", with_ctes(CORPUS, "SELECT ord, text FROM pr"))
def min_tokens(spark, sf):
    return _prepared(spark, sf).select("ord", "text")


@query("join_truth", with_ctes([V.TICKETS, V.TRUTH], """
SELECT tk.ord, ticket_id, latent_problem_id, had_context, true_category FROM tk LEFT JOIN truth USING (ticket_id)"""))
def join_truth(spark, sf):
    return SC.join_truth(V.tickets(spark, sf), V.truth(spark, sf)).select(
        "ord", "ticket_id", "latent_problem_id", "had_context", "true_category")


@query("screening_audit", with_ctes([V.TICKETS, TAGGED, ("steps", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}')" for i, name in enumerate(fixed.SCREENING_STEPS)) + ") s(no, step)")], """
SELECT CAST(no AS BIGINT) AS step_no, step, (SELECT count(*) FROM tg WHERE fate = no) AS removed,
  (SELECT count(*) FROM tg WHERE fate > no) AS remaining,
  round(100.0::DOUBLE * (SELECT count(*) FROM tg WHERE fate > no) / (SELECT count(*) FROM tg), 1) AS retention FROM steps"""))
def screening_audit(spark, sf):
    return SC.screening_audit(V.tickets(spark, sf))


DISTRIBUTION = """
SELECT 'Category' AS label_type, category AS class, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM pr), 1) AS pct FROM pr GROUP BY category
UNION ALL SELECT 'Resolver team', team, count(*), round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM pr), 1) FROM pr GROUP BY team"""


@query("class_distribution", with_ctes(CORPUS, DISTRIBUTION))
def class_distribution(spark, sf):
    return SC.class_distribution(_prepared(spark, sf))


@query("imbalance_ratio", with_ctes(CORPUS, f"""
SELECT label_type, round(CAST(max(n) AS DOUBLE) / min(n), 2) AS imbalance FROM ({DISTRIBUTION}) GROUP BY label_type"""))
def imbalance_ratio(spark, sf):
    return SC.imbalance_ratio(SC.class_distribution(_prepared(spark, sf)))


@query("corpus_profile", with_ctes(CORPUS, """
SELECT count(*) AS n_clean, string_agg(DISTINCT category, '|' ORDER BY category) AS categories,
  string_agg(DISTINCT team, '|' ORDER BY team) AS teams, round(avg(tokens), 1) AS mean_tokens,
  CAST(floor(median(tokens)) AS BIGINT) AS median_tokens FROM pr"""))
def corpus_profile(spark, sf):
    profile = SC.corpus_profile(_prepared(spark, sf))
    return profile.withColumns({c: F.concat_ws("|", c) for c in ("categories", "teams")})


@query("class_list", with_ctes([V.VECTORS, V.SPLIT], "SELECT DISTINCT category AS label FROM sp"))
def class_list(spark, sf):
    from queuemill.plans.shared_frames import split
    both = split(spark, sf)
    return SC.class_list(both.where("split = 'train'"), both.where("split = 'test'"), "category")


@query("ticket_frame", with_ctes([V.TICKETS], """
SELECT ord, coalesce(department, '') AS department, coalesce(created, '2024-06-01 12:00') AS created FROM (
  SELECT ord, CASE WHEN ord % 5 = 0 THEN NULL ELSE department END AS department,
    CASE WHEN ord % 7 = 0 THEN NULL ELSE created END AS created FROM tk)"""))
def ticket_frame(spark, sf):
    gaps = V.tickets(spark, sf).withColumns({
        "department": F.when(F.col("ord") % 5 != 0, F.col("department")),
        "created": F.when(F.col("ord") % 7 != 0, F.col("created"))})
    return FE.ticket_frame(gaps, as_of=F.lit("2024-06-01 12:00")).select("ord", "department", "created")


# ---------------------------------------------------------------- context blocks

_RAW_BLOCKS = f"""SELECT ord, split, 'dept' AS block, list_transform(voc, lambda x: CAST(x = department AS DOUBLE)) AS v FROM tks, voc
UNION ALL SELECT ord, split, 'time', {TIME_SQL} FROM tks UNION ALL SELECT ord, split, 'shape', {SHAPE_SQL} FROM tks"""
BLOCKS = [V.TICKETS,
          ("tks", "SELECT *, CASE WHEN substring(md5('42|' || ord), 1, 1) IN ('0','1','2') THEN 'test' ELSE 'train' END AS split FROM tk"),
          ("voc", "SELECT list(department ORDER BY department) AS voc FROM (SELECT DISTINCT department FROM tks WHERE split = 'train')"),
          ("rb", f"SELECT ord, split, block, i AS dim, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ({_RAW_BLOCKS}))"),
          ("fit", """SELECT block, dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-12 THEN 1 ELSE stddev_pop(x) END AS std
            FROM rb WHERE split = 'train' GROUP BY block, dim"""),
          ("sx", "SELECT ord, block, dim, (x - mean) / std AS x FROM rb JOIN fit USING (block, dim)")]


def split_tickets(spark, sf):
    first = F.substring(F.md5(F.concat(F.lit("42|"), F.col("ord").cast("string")).cast("binary")), 1, 1)
    return V.tickets(spark, sf).withColumn("split", F.when(first.isin("0", "1", "2"), "test").otherwise("train"))


def _fitter(tickets):
    return FE.ContextBlocks.fit(tickets.where("split = 'train'"))


@query("standardise_fit", with_ctes(BLOCKS, """
SELECT block, CAST(dim - 1 AS BIGINT) AS dim, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM fit"""))
def standardise_fit(spark, sf):
    tickets = split_tickets(spark, sf).where("split = 'train'")
    vocabulary = FE.fit_vocabulary(tickets, "department")
    raw = FE.raw_blocks(tickets, vocabulary)
    return FE.standardise_fit(raw, list(FE.BLOCKS)).select(
        "block", "dim", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("standardise_apply", with_ctes(BLOCKS, """
SELECT ord, block, CAST(dim - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM sx"""))
def standardise_apply(spark, sf):
    tickets = split_tickets(spark, sf)
    return FE.long_blocks(_fitter(tickets).transform(tickets, unitise=False), list(FE.BLOCKS))


UNIT = """SELECT ord, block, CAST(dim - 1 AS BIGINT) AS dim,
  round({scale} * x / greatest(sqrt(sum(x * x) OVER (PARTITION BY ord, block)), 1e-9), 6) + 0.0 AS value FROM sx"""


@query("context_blocks", with_ctes(BLOCKS, UNIT.format(scale="1.0")))
def context_blocks(spark, sf):
    tickets = split_tickets(spark, sf)
    return FE.long_blocks(_fitter(tickets).transform(tickets), list(FE.BLOCKS))


@query("assemble_blocks", with_ctes(BLOCKS, f"""
SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY CASE block WHEN 'dept' THEN 0 WHEN 'time' THEN 1 ELSE 2 END, dim) - 1 AS dim, value
FROM ({UNIT.format(scale="0.3")})"""))
def assemble_blocks(spark, sf):
    tickets = split_tickets(spark, sf)
    blocks = _fitter(tickets).transform(tickets)
    return long_array(blocks, "ord", FE.assemble(["dept", "time", "shape"], 0.3))


@query("features_for", with_ctes(BLOCKS, f"""
SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY CASE block WHEN 'dept' THEN 0 ELSE 1 END, dim) - 1 AS dim, value
FROM ({UNIT.format(scale="0.1")}) JOIN tks USING (ord) WHERE split = 'test' AND block IN ('dept', 'shape')"""))
def features_for(spark, sf):
    tickets = split_tickets(spark, sf)
    new = tickets.where("split = 'test'")
    return long_array(FE.features_for(new, _fitter(tickets), ["dept", "shape"], 0.1), "ord", F.col("features"))
