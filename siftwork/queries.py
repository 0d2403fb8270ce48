"""Queries over the given tables, one or more for each operator, and the SQL that their results are held against.

The tables speak another vocabulary than the classifiers, so signals and notices are derived from the star schema
by one SQL text that Spark and the oracle both read: `SIGNALS` (every order a signal, every customer a project) and
`NOTICES` (every order a notice, put together from phrases).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab as V
from .functions import relevance, rules, similarity, urls
from .functions import text as T
from .operators import cluster, merge, order
from .sources import crawl, discovery, html_chunks, paged_text
from .storage import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Keyword packs whose words occur in documents.
PACKS = {"licensing": ("license", "licensed", "released", "apache license", "copyright"), "function": ("that", "with", "this", "from"), "romance": ("que", "para", "pour", "dans", "les")}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _pick(key: str, values) -> str:
    values = list(values)
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_STAGES = [*V.STAGES, "", ""]
SIGNALS = f"""
SELECT o_orderkey AS seq, o_custkey AS project_no,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Works' ELSE concat(c_mktsegment, ' works ', o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN ' | annex' ELSE '' END) END AS signal_title,
  concat('Office of ', n_name) AS agency,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN n_name ELSE concat(n_name, ' (Zone ', CAST(o_orderkey % 6 AS VARCHAR(9)), ')') END AS geography,
  c_mktsegment AS sector,
  CASE o_orderkey % 6 WHEN 0 THEN concat('$', CAST(o_orderkey % 90 + 1 AS VARCHAR(9)), '.5 million') WHEN 1 THEN '' WHEN 2 THEN 'not stated' WHEN 3 THEN concat('$', CAST(o_orderkey % 9 AS VARCHAR(9)), ' B')
    ELSE concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR(20)), ',', substr(CAST(1000 + o_orderkey % 1000 AS VARCHAR(9)), 2, 3)) END AS estimated_value,
  {_pick('o_orderkey', ['0-3 months', '6-12 months', ''])} AS expected_timeline,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS meeting_date,
  {_pick('o_orderkey', [*V.SIGNAL_TYPES, ''])} AS signal_type,
  {_pick('o_orderkey * 7 + o_custkey', _STAGES)} AS procurement_stage,
  '' AS lifecycle_stage,
  {_pick('o_orderkey * 5 + o_custkey', ['High', 'Medium', 'Low', 'Low', ''])} AS signal_strength,
  {_pick('o_orderkey', ['Strong Fit', 'Moderate Fit', 'Monitor', 'No Fit'])} AS strategic_fit,
  CASE WHEN o_orderkey % 41 = 0 THEN 'High' WHEN o_orderkey % 13 = 0 THEN 'Moderate' ELSE 'Low' END AS friction_level,
  'Unclear' AS momentum,
  {_pick('o_orderkey', ['bid opening set for the pump house', '', 'commission approved the design', 'award of the pipe works to the lowest bidder', 'study of the canal', 'report filed'])} AS trigger_event,
  '' AS strategic_notes,
  concat('https://city.example.org/', lower(o_orderpriority), '/', CAST(o_custkey % 50 AS VARCHAR(9))) AS source_link,
  {_pick('o_orderkey * 3 + o_custkey', ['the item was read', 'the item was deferred to a later date', 'staff reported', 'pending review by the board', 'no change', 'the vote passed', 'plans were shown',
                                        'funds were set', 'a bidder filed a protest', 'the board met', 'bids were read', 'crews were sent', 'pipes were laid', 'the well was dug', 'the site was seen', 'maps were drawn'])} AS evidence_snippet,
  CAST(o_orderkey % 97 AS DOUBLE) / 97 AS confidence_score, CAST(o_orderkey % 89 AS DOUBLE) / 89 AS relevance_score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

_OPENINGS = ["The board met.", "Agenda item: resolution 2025-114 to approve", "Public hearing on an ordinance for", "Staff will present plans for", "City of Fairview Water Department reports on", "Notice:",
             "The commission approved", "Department of Public Works: update on", "Meeting of March 4, 2025 to discuss", "Harbor County Sewer division asks for"]
_MIDDLES = ["the award construction contract for pump house 7", "an RFQ 2025-031 for engineering services", "the ITB #2024-118-WW for pipe repair", "a grant award of state funds", "a change order 14-2 approved for the canal",
            "the referral to the finance committee", "a feasibility study", "a notice to proceed", "the capital budget in FY 2026 with a CIP plan", "design services at 60% complete", "a vendor pool", "nothing in particular", "the upcoming request for proposals"]
_AMOUNTS = ["", "for $1,250,000", "at $3.5 million", "of $900", "with a total of $12,400.50 and a fee of $2,000", "with $7,000 or $9,100", "costing $2 billion"]
_ENDS = ["Work will begin in spring 2026.", "Responses due June 12, 2025.", "Bids close in 30 days; deadline by 45 days.", "The item was deferred.", "It depends on permitting.", "A protest led to litigation.", "Completion date: May 2027.",
         "Held 3/14/2025 in District 4.", "It applies city-wide.", "Due in the next 90 days in Ward 2.", "Dated June 1, 2025.", ""]
NOTICES = f"""
SELECT o_orderkey AS id, {_pick('o_orderkey', ['meetings', 'procurement', 'budget', 'cip', '', '', ''])} AS category, {_pick('o_orderkey', ['Fairview', 'Ward 2, Fairview', ''])} AS place,
  concat({_pick('o_orderkey', _OPENINGS)}, ' ', {_pick('o_orderkey * 3 + o_custkey', _MIDDLES)}, ' ', {_pick('o_orderkey * 5 + o_custkey', _AMOUNTS)}, '. ', {_pick('o_orderkey * 7 + o_custkey', _ENDS)}) AS text
FROM orders
"""


def _shared(sql: str):
    """The rows of a shared SQL text."""
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [n for n in ("orders", "customer", "nation", "supplier") if f" {n}" in sql]
        text = sql
        for n in names:
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    return read


signals, notices = _shared(SIGNALS), _shared(NOTICES)


# --- relevance -------------------------------------------------------------------------------------------------------

def _times(words: str, zone: str, w: str) -> str:
    """Occurrences of a keyword; the oracle's \\b knows ASCII only, so single words are counted among Unicode words."""
    return f"len(regexp_extract_all({zone}, '\\b{w}\\b'))" if " " in w else f"len(list_filter({words}, lambda x: x = '{w}'))"


def _relevance_sql(words) -> str:
    count = [_times("ws", "t", w) for w in words]
    title = [f"CAST({_times('ts', 'substr(t, 1, 200)', w)} > 0 AS INT)" for w in words]
    hits, unique = " + ".join(count), " + ".join(f"CAST({c} > 0 AS INT)" for c in count)
    return (f"CASE WHEN {hits} = 0 THEN 0.0 ELSE round(least(0.4::DOUBLE * least(({hits}) / (n / 50.0::DOUBLE), 1) + 0.35::DOUBLE * least(({unique}) / {max(len(words) * 0.3, 1.0)!r}::DOUBLE, 1) "
            f"+ 0.25::DOUBLE * least(({' + '.join(title)}) * 0.15::DOUBLE, 0.3), 1), 3) END")


_SCORED = ("WITH d AS (SELECT *, regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}_]+') AS ws, regexp_extract_all(substr(t, 1, 200), '[\\p{L}\\p{M}\\p{N}_]+') AS ts FROM (SELECT doc_id, lower(coalesce(text, '')) AS t, greatest(len(regexp_extract_all(coalesce(text, ''), '\\S+')), 1) AS n FROM documents)), "
           f"s AS (SELECT doc_id, {', '.join(f'{_relevance_sql(w)} AS {name}' for name, w in PACKS.items())} FROM d), "
           f"b AS (SELECT doc_id, greatest({', '.join(PACKS)}) AS relevance_score, CASE WHEN greatest({', '.join(PACKS)}) <= 0 THEN '' "
           + " ".join(f"WHEN {n} = greatest({', '.join(PACKS)}) THEN '{n}'" for n in PACKS) + " END AS sector FROM s) ")
_FIT = "CASE WHEN relevance_score >= 0.3 AND {0} = 'High' THEN 'Strong Fit' WHEN relevance_score >= 0.15 AND {0} IN ('High', 'Medium') THEN 'Moderate Fit' WHEN relevance_score >= 0.05 THEN 'Monitor' ELSE 'No Fit' END"


@query("relevance_rank", _SCORED + f"SELECT doc_id, sector, CAST(relevance_score AS DOUBLE) AS relevance_score, {_FIT.format(chr(39) + 'Medium' + chr(39))} AS strategic_fit FROM b WHERE relevance_score >= 0.05")
def relevance_rank(spark, sf_dir):
    """R1-R3, C10, O1 over documents."""
    kept = relevance.relevant(table(spark, sf_dir, "documents").select("doc_id", "text"), PACKS)
    rows = kept.select("doc_id", "sector", "relevance_score", rules.fit(F.col("relevance_score"), F.lit("Medium")).alias("strategic_fit"))
    # a sort samples its input first; the scores are narrow rows, so they are written and not computed again
    return materialize(rows, "scores").orderBy(F.desc("relevance_score"), "doc_id")


@query("sector_argmax", _SCORED + "SELECT sector, count(*) AS documents, CAST(max(relevance_score) AS DOUBLE) AS best FROM b GROUP BY sector")
def sector_argmax(spark, sf_dir):
    """Documents of each best sector."""
    scored = relevance.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), PACKS)
    return scored.groupBy("sector").agg(F.count("*").alias("documents"), F.max("relevance_score").alias("best"))


# --- row-wise rules over notices -------------------------------------------------------------------------------------

def _case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def _match(text: str, p: str, fold: bool = False) -> str:
    return f"regexp_matches({text}, '{'(?i)' if fold else ''}{p}')"


def _found(text: str, p: str, group: int = 0, fold: bool = False) -> str:
    p = f"{'(?i)' if fold else ''}{p}"
    return f"CASE WHEN regexp_matches({text}, '{p}') THEN regexp_extract({text}, '{p}', {group}) END"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _stage_sql() -> str:
    each = []
    for rank, (stage, patterns) in enumerate(V.STAGES.items()):
        hit = _case(((_match("l", p), f"regexp_extract(l, '{p}', 0)") for p in patterns), "NULL")
        each.append(f"SELECT id, text, l, {rank} AS rank, '{stage}' AS stage, {hit} AS hit FROM n")
    around = _STRIP.format("substr(text, greatest(strpos(l, hit) - 61, 0) + 1, strpos(l, hit) - 1 + length(hit) + 60 - greatest(strpos(l, hit) - 61, 0))")
    return (f"WITH n AS (SELECT id, text, lower(text) AS l FROM ({NOTICES})), s AS ({' UNION ALL '.join(each)}), e AS (SELECT id, rank, stage, {around} AS evidence FROM s WHERE hit IS NOT NULL), "
            f"f AS (SELECT *, CAST(regexp_matches(lower(evidence), '{V.FUTURE}') AS INT) AS future FROM e), "
            f"o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY future, CASE WHEN future = 0 AND stage = '{V.CONCEPT}' THEN 1 ELSE 0 END, rank) AS r FROM f) "
            "SELECT n.id AS id, coalesce(stage, '') AS stage, coalesce(evidence, '') AS evidence FROM n LEFT JOIN o ON n.id = o.id AND r = 1")


@query("stage_classify", _stage_sql())
def stage_classify(spark, sf_dir):
    """C1."""
    return notices(spark, sf_dir).withColumn("s", rules.stage_evidence(F.col("text"))).select("id", "s.stage", "s.evidence")


def _type_sql() -> str:
    by_words = _case(((" OR ".join(_match("l", p) for p in ps), f"'{label}'") for label, ps in V.SIGNAL_TYPES.items()), "''")
    meeting = _case([(_match("l", V.MEETING_POLICY), "'Policy Direction'"), (_match("l", V.MEETING_FUNDING), "'Funding Allocation'")], "'Commission Agenda'")
    return _case([("category = 'meetings'", meeting), ("category = 'procurement'", "'Procurement (ITB/RFQ)'"), ("category IN ('budget', 'cip')", "'Capital Budget'")], by_words)


def _over_notices(columns: str) -> str:
    return f"SELECT id, {columns} FROM (SELECT *, lower(text) AS l, substr(text, 1, 1000) AS k, regexp_replace(substr(text, 1, 2000), '\\s+', ' ', 'g') AS o FROM ({NOTICES}))"


_LIFE = _case(((f"stage = '{s}'", f"'{v}'") for s, v in V.LIFECYCLE.items()), _case(((f"kind = '{s}'", f"'{v}'") for s, v in V.LIFECYCLE_OF_TYPE.items()), "''"))


@query("signal_type", _over_notices(f"{_type_sql()} AS kind"))
def signal_type(spark, sf_dir):
    """C2."""
    return notices(spark, sf_dir).select("id", rules.signal_type(F.col("text"), F.col("category")).alias("kind"))


@query("lifecycle", f"SELECT seq, {_LIFE} AS lifecycle FROM (SELECT seq, procurement_stage AS stage, signal_type AS kind FROM ({SIGNALS}))")
def lifecycle(spark, sf_dir):
    """C3."""
    return signals(spark, sf_dir).select("seq", rules.lifecycle(F.col("procurement_stage"), F.col("signal_type")).alias("lifecycle"))


def _timeline_sql() -> str:
    phrases = []
    for p, form, groups in V.TIMELINE_PHRASES:
        parts = form.split("%s")
        made = " || ".join(x for k, part in enumerate(parts) for x in (f"'{part}'", *([f"regexp_extract(l, '{p}', {groups[k]})"] if k < len(groups) else [])))
        phrases.append((_match("l", p), _STRIP.format(f"({made})")))
    return _case(phrases, "''")


@query("timeline", _over_notices(f"{_timeline_sql()} AS timeline"))
def timeline(spark, sf_dir):
    """C4, without a stage."""
    return notices(spark, sf_dir).select("id", rules.timeline(F.col("text"), F.lit("")).alias("timeline"))


def _amount_sql(raw: str) -> str:
    bare = _STRIP.format(f"regexp_replace({raw}, '[$,]', '', 'g')")
    units = ((f"ends_with(lower({bare}), '{u}')", f"try_cast({_STRIP.format(f'left({bare}, length({bare}) - {len(u)})')} AS DOUBLE) * {x!r}::DOUBLE") for u, x in V.AMOUNT_UNITS)
    return _case(units, f"try_cast({bare} AS DOUBLE)")


@query("amount_parse", f"SELECT seq, estimated_value, {_amount_sql('estimated_value')} AS value FROM ({SIGNALS})")
def amount_parse(spark, sf_dir):
    """C6."""
    return signals(spark, sf_dir).select("seq", "estimated_value", rules.parse_amount(F.col("estimated_value")).alias("value"))


_RAWS = f"SELECT id, text, regexp_extract_all(text, '(?i){V.AMOUNT}') AS raws FROM ({NOTICES})"
_EACH = f"SELECT id, text, i, raws[i] AS raw, {_amount_sql('raws[i]')} AS value FROM (SELECT id, text, raws, unnest(range(1, len(raws) + 1)) AS i FROM r)"


@query("amounts", f"WITH r AS ({_RAWS}), e AS ({_EACH}) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INT) AS n, raw, value FROM e WHERE value >= 1000")
def amounts(spark, sf_dir):
    """C5."""
    return notices(spark, sf_dir).select("id", F.posexplode(rules.amounts(F.col("text"))).alias("at", "a")).select("id", (F.col("at") + 1).alias("n"), "a.raw", "a.value")


_AROUND = "lower(substr(text, greatest(strpos(text, raw) - 61, 0) + 1, strpos(text, raw) - 1 + length(raw) + 60 - greatest(strpos(text, raw) - 61, 0)))"


@query("best_amount", f"WITH r AS ({_RAWS}), e AS ({_EACH}), k AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, regexp_matches({_AROUND}, '{'|'.join(V.AMOUNT_WORDS)}') AS preferred FROM e WHERE value >= 1000), "
       "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY preferred DESC, CASE WHEN preferred THEN 0 ELSE -value END, i) AS r FROM k) "
       "SELECT r.id AS id, coalesce(raw, '') AS amount FROM r LEFT JOIN o ON r.id = o.id AND o.r = 1")
def best_amount(spark, sf_dir):
    """C7."""
    return notices(spark, sf_dir).select("id", rules.best_amount(rules.amounts(F.col("text"))).alias("amount"))


def _any(text: str, patterns) -> str:
    return " OR ".join(_match(text, p) for p in patterns)


@query("friction_rule", _over_notices(_case([(_any("l", V.FRICTION_HIGH), "'High'"), (_any("l", V.FRICTION_MODERATE), "'Moderate'")], "'Low'") + " AS friction"))
def friction_rule(spark, sf_dir):
    """C8."""
    return notices(spark, sf_dir).select("id", rules.friction(F.col("text")).alias("friction"))


_POINTS = (f"CASE WHEN {_match('text', V.STRENGTH_CODE, True)} THEN 3 ELSE 0 END + CASE WHEN {_match('text', V.STRENGTH_PROJECT, True)} THEN 2 ELSE 0 END + CASE category WHEN 'meetings' THEN 1 WHEN '' THEN 0 ELSE 2 END "
           f"+ CASE WHEN contains(text, '$') THEN 2 ELSE 0 END + CASE WHEN contains(text, '2025') THEN 1 ELSE 0 END + CASE WHEN {_match('text', V.STRENGTH_VERB, True)} THEN 1 ELSE 0 END")


@query("strength", _over_notices(f"CASE WHEN {_POINTS} >= 6 THEN 'High' WHEN {_POINTS} >= 3 THEN 'Medium' ELSE 'Low' END AS strength"))
def strength(spark, sf_dir):
    """C9, with stages that stand for categories."""
    stage = F.when(F.col("category") == "meetings", V.CONCEPT).when(F.col("category") == "", "").otherwise("Active Contract")
    return notices(spark, sf_dir).select("id", rules.strength(F.col("text"), stage, F.contains("text", F.lit("$")), F.contains("text", F.lit("2025"))).alias("strength"))


@query("fit_bucket", f"SELECT seq, {_FIT.format('signal_strength')} AS fit FROM ({SIGNALS})")
def fit_bucket(spark, sf_dir):
    """C10."""
    return signals(spark, sf_dir).select("seq", rules.fit(F.col("relevance_score"), F.col("signal_strength")).alias("fit"))


@query("trigger", _over_notices("coalesce(" + ", ".join(f"left({_STRIP.format(_found('o', p, 1, True))}, 200)" for p in V.TRIGGERS) + ", '') AS trigger_event"))
def trigger(spark, sf_dir):
    """C11."""
    return notices(spark, sf_dir).select("id", rules.trigger(F.col("text")).alias("trigger_event"))


def _agency_sql() -> str:
    # the oracle's patterns have no look-ahead: what follows is matched and cut off again
    out = []
    for p in V.AGENCIES:
        head, _, tail = p.partition("(?=")
        out.append(_STRIP.format(_found("k", f"({head}){tail[:-1]}" if tail else f"({p})", 1, True)))
    return f"coalesce({', '.join(out)}, 'none')"


@query("agency", _over_notices(f"{_agency_sql()} AS agency"))
def agency(spark, sf_dir):
    """C12."""
    return notices(spark, sf_dir).select("id", rules.agency(F.col("text"), F.lit("none")).alias("agency"))


_PLACE = f"coalesce({', '.join(_found('text', p, 0, True) for p in V.PLACES)})"
_TITLED = "array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query("geography", f"WITH a AS (SELECT id, place, {_PLACE} AS p FROM ({NOTICES})), b AS (SELECT id, place, {_TITLED} AS found FROM a) "
       "SELECT id, CASE WHEN found IS NULL OR contains(lower(place), lower(found)) THEN place ELSE place || ' (' || found || ')' END AS geography FROM b")
def geography(spark, sf_dir):
    """C13."""
    return notices(spark, sf_dir).select("id", rules.geography(F.col("text"), F.col("place")).alias("geography"))


@query("meeting_date", _over_notices("coalesce(" + ", ".join(_STRIP.format(_found("text", p, 1, True)) for p in V.MEETING_DATES) + ", '') AS meeting_date"))
def meeting_date(spark, sf_dir):
    """C14."""
    return notices(spark, sf_dir).select("id", rules.meeting_date(F.col("text"), F.lit("")).alias("meeting_date"))


@query("first_date", _over_notices("coalesce(" + ", ".join(_found("k", p, 1, True) for p in V.DATES) + ", '') AS first_date"))
def first_date(spark, sf_dir):
    """T0, T9."""
    return notices(spark, sf_dir).select("id", rules.first_date(F.col("text")).alias("first_date"))


@query("project_ids", f"WITH a AS (SELECT id, unnest(flatten([{', '.join(f'regexp_extract_all(text, {chr(39)}(?i){p}{chr(39)}, 1)' for p in V.PROJECT_IDS)}])) AS x FROM ({NOTICES})) "
       f"SELECT DISTINCT id, upper(regexp_replace({_STRIP.format('x')}, '\\s+', '-', 'g')) AS project_id FROM a")
def project_ids(spark, sf_dir):
    """M1."""
    return notices(spark, sf_dir).select("id", F.explode(similarity.project_ids(F.col("text"))).alias("project_id"))


_LINE = "left(split_part(trim(text), chr(10), 1), 100)"


@query("fallback_texts", f"SELECT id, left(CASE WHEN place <> '' THEN place || ' — ' || {_LINE} ELSE {_LINE} END, 120) AS title, left('Signal detected in ' || category || '-related content.' || "
       f"CASE WHEN place <> '' THEN ' Currently at ' || place || ' stage.' ELSE '' END, 500) AS notes FROM ({NOTICES})")
def fallback_texts(spark, sf_dir):
    """L2."""
    return notices(spark, sf_dir).select("id", rules.fallback_title(F.col("text"), F.col("place")).alias("title"), rules.fallback_notes(F.col("category"), F.col("place")).alias("notes"))


# --- projects --------------------------------------------------------------------------------------------------------

_RANKED = f"SELECT *, {_case(((f'procurement_stage = {chr(39)}{s}{chr(39)}', str(k)) for k, s in enumerate(V.STAGES)), str(V.NO_STAGE))} AS rank, CASE signal_strength WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS level, " \
    f"concat(trigger_event, ' ', evidence_snippet, ' ', strategic_notes) AS told, concat(evidence_snippet, ' ', trigger_event, ' ', strategic_notes) AS shown, {_amount_sql('estimated_value')} AS value FROM ({SIGNALS})"
_PROFILES = f"""
s AS ({_RANKED}),
g AS (SELECT project_no, count(*) AS signals, list(rank ORDER BY seq) FILTER (procurement_stage <> '') AS ranks, list(procurement_stage ORDER BY seq) FILTER (procurement_stage <> '') AS stages,
  bool_or(regexp_matches(told, '(?i){V.STALLED}')) AS stalled,
  bool_or(friction_level = 'High') OR bool_or(regexp_matches(shown, '(?i){V.PROJECT_FRICTION_HIGH}')) AS high,
  bool_or(friction_level = 'Moderate') OR bool_or(regexp_matches(shown, '(?i){V.PROJECT_FRICTION_MODERATE}')) AS moderate,
  arg_min(seq, row(rank, level, -confidence_score, seq)) AS primary_seq,
  coalesce(arg_min(signal_title, row(length(signal_title) + CASE WHEN contains(signal_title, '|') THEN 100 ELSE 0 END, signal_title)) FILTER (length(signal_title) > 10), arg_min(signal_title, seq)) AS best_title,
  coalesce(arg_min(geography, seq) FILTER (contains(geography, '(')), arg_min(geography, seq) FILTER (geography <> ''), '') AS best_geography,
  coalesce(arg_max(estimated_value, row(value, -seq)) FILTER (value > 0), '') AS best_value,
  arg_min(signal_strength, row(level, seq)) AS best_strength, coalesce(arg_max(trigger_event, row(length(trigger_event), -seq)) FILTER (trigger_event <> ''), '') AS best_trigger,
  coalesce(max(meeting_date) FILTER (meeting_date <> ''), '') AS latest_date, coalesce(min(meeting_date) FILTER (meeting_date <> ''), '') AS earliest_date,
  max(confidence_score) AS best_confidence, max(relevance_score) AS best_relevance
  FROM s GROUP BY project_no),
u AS (SELECT project_no, list(stage ORDER BY first) AS seen, list(rank ORDER BY first) AS distinct_ranks, arg_min(stage, rank) AS latest_stage
  FROM (SELECT project_no, procurement_stage AS stage, rank, min(seq) AS first FROM s WHERE procurement_stage <> '' GROUP BY ALL) GROUP BY project_no),
p AS (SELECT g.*, coalesce(array_to_string(seen, ' > '), '') AS stages_seen, coalesce(latest_stage, '') AS latest_stage,
  CASE WHEN stalled THEN 'Stalled' WHEN coalesce(len(stages), 0) <= 1 THEN 'Unclear' WHEN distinct_ranks[-1] < distinct_ranks[1] THEN 'Accelerating' ELSE 'Stable' END AS momentum,
  CASE WHEN high THEN 'High' WHEN moderate THEN 'Moderate' ELSE 'Low' END AS friction, seen FROM g LEFT JOIN u ON g.project_no = u.project_no),
q AS (SELECT *, left(array_to_string(list_filter([CASE WHEN signals > 1 THEN 'Project appears in ' || signals || ' sources.' END,
  CASE WHEN len(seen) > 1 THEN 'Progressed through: ' || array_to_string(seen, ' → ') || '.' WHEN len(seen) = 1 THEN 'Current stage: ' || seen[1] || '.' END,
  CASE WHEN momentum <> 'Unclear' THEN 'Momentum: ' || momentum || '.' END], lambda x: x IS NOT NULL), ' '), 500) AS notes FROM p)
"""


@query("momentum_by_project", f"WITH {_PROFILES} SELECT project_no, signals, momentum, stages_seen, latest_stage FROM p")
def momentum_by_project(spark, sf_dir):
    """G1, G11, G12."""
    return merge.profiles(signals(spark, sf_dir)).select("project_no", "signals", "momentum", F.array_join("stages_seen", " > ").alias("stages_seen"), "latest_stage")


@query("friction_by_project", f"WITH {_PROFILES} SELECT project_no, friction FROM p")
def friction_by_project(spark, sf_dir):
    """G2."""
    return merge.profiles(signals(spark, sf_dir)).select("project_no", F.col("friction_level").alias("friction"))


_BEST = "best_title, best_geography, best_value, best_strength, best_trigger, latest_date, earliest_date, best_confidence, best_relevance"


@query("primary_row", f"WITH {_PROFILES} SELECT project_no, primary_seq FROM p")
def primary_row(spark, sf_dir):
    """G3."""
    return merge.profiles(signals(spark, sf_dir)).select("project_no", "primary_seq")


@query("best_values", f"WITH {_PROFILES} SELECT project_no, {_BEST} FROM p")
def best_values(spark, sf_dir):
    """G4-G10, G13."""
    return merge.profiles(signals(spark, sf_dir)).select("project_no", *_BEST.split(", "))


@query("project_notes", f"WITH {_PROFILES} SELECT project_no, notes FROM q")
def project_notes(spark, sf_dir):
    """G14."""
    return merge.profiles(signals(spark, sf_dir)).select("project_no", "notes")


_MERGED = {"signal_title": "best_title", "geography": "best_geography", "estimated_value": "best_value", "signal_strength": "best_strength", "trigger_event": "best_trigger", "meeting_date": "latest_date",
           "confidence_score": "best_confidence", "relevance_score": "best_relevance", "procurement_stage": "q.latest_stage", "strategic_notes": "notes"}


@query("merged_project", f"WITH {_PROFILES} SELECT s.project_no AS project_no, s.seq AS seq, s.agency AS agency, s.sector AS sector, s.source_link AS source_link, s.expected_timeline AS expected_timeline, momentum AS momentum, friction AS friction_level, ".replace("momentum AS momentum", "q.momentum AS momentum")
       + ", ".join(f"CASE WHEN signals > 1 THEN {b} ELSE s.{c} END AS {c}" for c, b in _MERGED.items()) + " FROM q JOIN s ON s.seq = q.primary_seq AND s.project_no = q.project_no")
def merged_project(spark, sf_dir):
    """G15, G16."""
    return merge.merged(signals(spark, sf_dir)).select("project_no", "seq", "agency", "sector", "source_link", "expected_timeline", "momentum", "friction_level", *_MERGED)


@query("keep_all_broadcast", f"WITH {_PROFILES} SELECT s.seq AS seq, s.project_no AS project_no, p.momentum AS momentum, friction AS friction_level FROM s JOIN p ON s.project_no = p.project_no")
def keep_all_broadcast(spark, sf_dir):
    """G16."""
    return merge.kept_all(signals(spark, sf_dir)).select("seq", "project_no", "momentum", "friction_level")


_CHOSEN = "signal_strength IN ('High', 'Medium', 'Low') AND strategic_fit IN ('Strong Fit', 'Moderate Fit', 'Monitor')"


@query("ui_filter_metrics", f"SELECT count(*) AS signals, count(*) FILTER (signal_strength = 'High') AS high, count(*) FILTER (strategic_fit = 'Strong Fit') AS strong_fit, count(DISTINCT sector) AS sectors FROM ({SIGNALS}) WHERE {_CHOSEN}")
def ui_filter_metrics(spark, sf_dir):
    """O7, G17."""
    return merge.metrics(order.chosen(signals(spark, sf_dir)))


@query("final_order", "SELECT seq, signal_strength, relevance_score, row_number() OVER (ORDER BY CASE signal_strength WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, relevance_score DESC, seq) - 1 AS place "
       f"FROM ({SIGNALS})")
def final_order(spark, sf_dir):
    """O1: strength, then relevance, then arrival, with the place of each row in the order.

    The order is written in range partitions; a row's place is its place in its partition after the rows of those before.
    """
    ranked = order.ranked(signals(spark, sf_dir)).select("seq", "signal_strength", "relevance_score")
    rows = materialize(ranked.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "part").select("seq", "signal_strength", "relevance_score", (F.col("start") + inside).alias("place"))


@query("signal_dedupe", f"SELECT seq, source_link FROM (SELECT *, row_number() OVER (PARTITION BY source_link || '::' || lower(left(signal_title, 60)) ORDER BY confidence_score DESC, seq) AS r FROM ({SIGNALS})) WHERE r = 1")
def signal_dedupe(spark, sf_dir):
    """O4."""
    return order.dedupe(signals(spark, sf_dir)).select("seq", "source_link")


@query("edit_apply", f"SELECT seq, CASE WHEN seq % 3 = 0 THEN 'Edited ' || seq ELSE signal_title END AS signal_title, CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'High' ELSE signal_strength END AS signal_strength FROM ({SIGNALS})")
def edit_apply(spark, sf_dir):
    """Every third row is edited, every sixth in two columns."""
    rows = signals(spark, sf_dir)
    edits = rows.where("seq % 3 = 0").select("seq", F.concat(F.lit("Edited "), F.col("seq").cast("string")).alias("signal_title"), F.when(F.col("seq") % 2 == 0, "High").alias("signal_strength"))
    return order.edited(rows, edits).select("seq", "signal_title", "signal_strength")


@query("display_marks", f"SELECT seq, CASE signal_strength WHEN 'High' THEN '🟢 High' WHEN 'Medium' THEN '🟡 Medium' WHEN 'Low' THEN '🔴 Low' ELSE signal_strength END AS shown, signal_strength AS plain FROM ({SIGNALS})")
def display_marks(spark, sf_dir):
    """K4, there and back."""
    return signals(spark, sf_dir).withColumn("shown", order.marked("signal_strength")).select("seq", "shown", order.unmarked("shown").alias("plain"))


# --- similarity ------------------------------------------------------------------------------------------------------

SUPPLIERS = """
SELECT s_suppkey AS seq, concat('Supplier ', CAST(s_suppkey % 40 AS VARCHAR(9)), ' repair of ', n_name) AS signal_title, concat('bid by ', n_name, ' house ', CAST(s_suppkey % 7 AS VARCHAR(9))) AS trigger_event,
  CASE WHEN s_suppkey % 19 = 0 THEN concat('see RFP 2025-', CAST(100 + s_suppkey % 38 AS VARCHAR(9))) ELSE '' END AS evidence_snippet,
  CASE WHEN s_acctbal > 0 THEN concat('$', CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR(20))) ELSE '' END AS estimated_value,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END AS geography, CASE WHEN s_suppkey % 3 = 0 THEN 'water' ELSE 'sewer' END AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
suppliers = _shared(SUPPLIERS)


def _pairs_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in V.STOPWORDS)
    def tokens(t: str) -> str:
        return f"list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+')), lambda x: x NOT IN ({stop}))"
    def jaccard(c: str) -> str:
        return (f"CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.{c}, b.{c})) / (len(a.{c}) + len(b.{c}) - len(list_intersect(a.{c}, b.{c})))::DOUBLE END")
    ids = ", ".join(f"regexp_extract_all(whole, '(?i){p}', 1)" for p in V.PROJECT_IDS)
    low, high = "least(a.value, b.value)", "greatest(a.value, b.value)"
    ratio = f"(CASE WHEN {high} > 0 THEN {low} / {high} ELSE 0 END)"
    amount = f"CASE WHEN a.value IS NULL OR b.value IS NULL THEN 0.0 WHEN a.value = 0 AND b.value = 0 THEN 1.0 WHEN {ratio} >= 0.8 THEN 1.0 WHEN {ratio} >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE"
    total = (f"0.4::DOUBLE * {jaccard('title')} + 0.2::DOUBLE * {jaccard('evidence')} + 0.15::DOUBLE * ({amount}) + 0.1::DOUBLE * (CASE WHEN a.geography <> '' AND lower(a.geography) = lower(b.geography) THEN 1.0 ELSE 0.3 END)::DOUBLE "
             "+ 0.15::DOUBLE * (CASE WHEN a.sector = b.sector THEN 1.0 ELSE 0.0 END)::DOUBLE")
    return (f"WITH w AS (SELECT *, concat(signal_title, ' ', trigger_event, ' ', evidence_snippet) AS whole FROM ({SUPPLIERS})), "
            f"k AS (SELECT seq, geography, sector, {tokens('signal_title')} AS title, {tokens(chr(39).join(['concat(trigger_event, ', ' ', ', evidence_snippet)']))} AS evidence, {_amount_sql('estimated_value')} AS value, "
            f"list_distinct(list_transform(flatten([{ids}]), lambda x: upper(regexp_replace({_STRIP.format('x')}, '\\s+', '-', 'g')))) AS ids FROM w), "
            f"m AS (SELECT a.seq AS a, b.seq AS b, CASE WHEN list_has_any(a.ids, b.ids) THEN 1.0::DOUBLE ELSE round({total}, 3) END AS score, list_has_any(a.ids, b.ids) AS id_hit FROM k a JOIN k b ON a.seq < b.seq) "
            "SELECT a, b, score, id_hit FROM m WHERE score >= 0.45")


@query("pair_similarity", _pairs_sql())
def pair_similarity(spark, sf_dir):
    """All pairs over the threshold, from blocked candidates."""
    return cluster.pairs(materialize(similarity.keyed(suppliers(spark, sf_dir)), "keyed-signals"))


@query("cluster_projects")
def cluster_projects(spark, sf_dir):
    """Greedy projects in arrival order."""
    return cluster.assign(suppliers(spark, sf_dir)).select("seq", "founder", "project_no", "project_id")


# --- URLs ------------------------------------------------------------------------------------------------------------

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Page URLs with a section by page number, and a doubled segment in some.
LINKS = f"SELECT page_id, regexp_replace(url, '/(en|fr|de|es)/', {_pick('page_id', ['/agenda/', '/clerk/clerk/clerk/', '/bids/', '/capital/improvement/', '/finance/budget/', '/news/', '/projects/projects/'])}) AS url FROM pages"


def links(spark, sf_dir):
    return spark.sql(LINKS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


_PARTS = f"SELECT page_id, url, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS authority, string_split(regexp_extract(url, '{_URL}', 3), '/') AS segments, regexp_extract(url, '{_URL}', 4) || regexp_extract(url, '{_URL}', 5) AS rest FROM ({LINKS})"
_COLLAPSED = "array_to_string(list_filter(segments, lambda x, i: i = 1 OR x = '' OR x <> segments[i - 1]), '/')"


@query("url_normalize", f"WITH p AS ({_PARTS}), c AS (SELECT page_id, scheme || '://' || authority || {_COLLAPSED} || rest AS canonical FROM p) SELECT page_id, canonical, lower(rtrim(canonical, '/')) AS normal FROM c")
def url_normalize(spark, sf_dir):
    """U1-U3."""
    return links(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.normal(F.col("url")).alias("normal"))


@query("url_category", f"SELECT page_id, {_case(((' OR '.join(f'contains(lower(url), {chr(39)}{m}{chr(39)})' for m in ms), chr(39) + n + chr(39)) for n, ms in V.CATEGORY_URLS), chr(39) + 'parent' + chr(39))} AS category, "
       f"ends_with(lower(regexp_extract(url, '{_URL}', 2)), 'example.org') AS allowed, {' OR '.join(f'contains(lower(url), {chr(39)}{m}{chr(39)})' for m in urls.PRIORITY)} AS priority FROM ({LINKS})")
def url_category(spark, sf_dir):
    """U4-U6, U18."""
    u = F.col("url")
    return links(spark, sf_dir).select("page_id", urls.category(u, F.lit("parent")).alias("category"), urls.allowed(u, ["example.org"]).alias("allowed"), urls.mentions(u, urls.PRIORITY).alias("priority"))


_KIND = _pick("page_id", [*V.EXTENSIONS, "text/plain"])
_TAIL = f"list_last(string_split(regexp_extract(url, '{_URL}', 3), '/'))"


@query("file_names", f"SELECT page_id, CASE WHEN contains({_TAIL}, '.') THEN left(md5(url), 10) || '_' || {_TAIL} ELSE left(md5(url), 10) || CASE {_KIND} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in V.EXTENSIONS.items())} ELSE '.bin' END END AS name FROM ({LINKS})")
def file_names(spark, sf_dir):
    """U10, U11."""
    return links(spark, sf_dir).select("page_id", urls.safe_name(F.col("url"), urls.extension(F.expr(_KIND))).alias("name"))


_BARE = f"regexp_replace(lower(regexp_extract(url, '{_URL}', 2)), '^www\\.', '')"


@query("site_names", f"SELECT DISTINCT {_BARE} AS bare, regexp_replace(split_part({_BARE}, '.', 1), '-+', '_', 'g') AS name, array_to_string(list_distinct([{_BARE}, 'www.' || {_BARE}, 'files.' || {_BARE}]).list_sort(), ' ') AS domains FROM pages")
def site_names(spark, sf_dir):
    """U12, U13."""
    at = urls.part(F.col("url"), 2)
    return table(spark, sf_dir, "pages").select(F.regexp_replace(F.lower(at), r"^www\.", "").alias("bare"), urls.site_name(at).alias("name"), F.array_join(F.array_sort(urls.site_domains(at)), " ").alias("domains")).distinct()


_TITLES = f"SELECT page_id, {_pick('page_id', ['City of Fairview, FL | Home', 'Village of Key Largo Welcome', 'Harbor News · Today', '', 'Town of Lake Park is open'])} AS title FROM pages"
_KINDS = "(?:City|Village|Town|County|Borough|Municipality)"
_AG = rf"({_KINDS}\s+of\s+(?:[A-Z][\w\.]*\s+){{0,3}}[A-Z][\w\.]*)(?:,\s*([A-Z]{{2}}))?"
_AGENCY = _STRIP.format(f"regexp_replace({_STRIP.format(f'regexp_extract(title, {chr(39)}{_AG}{chr(39)}, 1)')}, '(?i)\\s+(?:Home|Welcome|Site|Government|Official|Main|Page)$', '')")


@query("agency_of_title", f"WITH t AS ({_TITLES}), a AS (SELECT page_id, title, {_AGENCY} AS agency, regexp_extract(title, '{_AG}', 2) AS state FROM t) SELECT page_id, "
       f"CASE WHEN title = '' THEN 'host' WHEN regexp_matches(title, '{_AG}') THEN agency ELSE trim(regexp_split_to_array(title, '[|·\\-–]')[1]) END AS agency, "
       f"CASE WHEN regexp_matches(title, '{_AG}') THEN regexp_replace(agency, '(?i)^{_KINDS}\\s+of\\s+', '') || CASE WHEN state <> '' THEN ', ' || state ELSE '' END ELSE '' END AS geography FROM a")
def agency_of_title(spark, sf_dir):
    """U14."""
    titles = spark.sql(_TITLES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    return titles.withColumn("a", urls.agency_place(F.col("title"), F.lit("host"))).select("page_id", "a.agency", "a.geography")


_MARK = _pick("page_id", ["https://Fair.primegov.com/x", "via granicus.com", "legistar.com", "civicengage", "none", "primegov.com"])


@query("cms_detect", f"SELECT page_id, CASE WHEN contains(h, 'primegov.com') THEN 'primegov' {' '.join(f'WHEN {chr(32).join([])}' + ' OR '.join(f'contains(h, {chr(39)}{m}{chr(39)})' for m in ms) + f' THEN {chr(39)}{n}{chr(39)}' for n, ms in V.CMS)} ELSE 'default' END AS mode, "
       f"CASE WHEN contains(h, 'fair.primegov.com') THEN 'https://fair.primegov.com' ELSE '' END AS api_base FROM (SELECT page_id, lower(coalesce(html, '') || {_MARK}) AS h FROM pages)")
def cms_detect(spark, sf_dir):
    """U15 over pages that carry a mark."""
    html = F.concat(F.coalesce("html", F.lit("")), F.expr(_MARK))
    return table(spark, sf_dir, "pages").select("page_id", urls.cms(html).alias("c")).select("page_id", "c.mode", "c.api_base")


def _seeds_sql() -> str:
    points = [(k, n, " + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ws)) for k, (n, ws) in enumerate(V.SEEDS.items())]
    each = " UNION ALL ".join(f"SELECT host, url, text, {k} AS category_no, '{n}' AS category, {p} AS points FROM l" for k, n, p in points)
    path = f"regexp_extract(url, '{_URL}', 3)"
    return (f"WITH l AS (SELECT lower(regexp_extract(url, '{_URL}', 2)) AS host, url, {_pick('page_id', ['Council minutes', 'Bids', '', 'Fiscal plan'])} AS text FROM ({LINKS})), e AS ({each}), "
            f"f AS (SELECT *, points * 10 - greatest(length({path}) - length(replace({path}, '/', '')) - 1, 0) + CASE WHEN regexp_matches({path}, '(/|/index\\.(php|html|aspx))$') THEN 2 ELSE 0 END AS final FROM e WHERE points > 0), "
            "t AS (SELECT *, row_number() OVER (PARTITION BY host, category ORDER BY final DESC, url DESC, text DESC) AS rank FROM f), "
            "u AS (SELECT *, row_number() OVER (PARTITION BY host, url ORDER BY category_no, rank) AS turn FROM t WHERE rank <= 2) "
            "SELECT host, category, CAST(final AS DOUBLE) AS final, url, left(CASE WHEN text <> '' THEN text ELSE upper(category[1]) || category[2:] END, 80) AS label FROM u WHERE turn = 1")


@query("host_seed_top2", _seeds_sql())
def host_seed_top2(spark, sf_dir):
    """The best two links of each category of each host."""
    rows = links(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), "url", F.expr(_pick("page_id", ["Council minutes", "Bids", "", "Fiscal plan"])).alias("text"))
    return urls.seeds(rows, ("host",)).select("host", "category", "final", "url", "label")


@query("distinct_urls", f"SELECT url, min(page_id) AS pos FROM (SELECT url, page_id FROM pages UNION ALL SELECT url, page_id FROM ({LINKS})) GROUP BY url")
def distinct_urls(spark, sf_dir):
    """O5, O6."""
    one = table(spark, sf_dir, "pages").select("url", F.lit("").alias("text"), F.col("page_id").alias("pos"))
    return order.distinct_urls(one, links(spark, sf_dir).select("url", F.lit("").alias("text"), F.col("page_id").alias("pos"))).select("url", "pos")


# --- pages, meetings, paged texts ------------------------------------------------------------------------------------

_LIST = "SELECT l_orderkey AS id, concat('Meeting ', CAST(l_orderkey AS VARCHAR(20))) AS title, list(row(l_partkey, l_linenumber % 4) ORDER BY l_linenumber) AS documents FROM lineitem GROUP BY l_orderkey"


@query("meeting_agendas", "SELECT l_orderkey AS id, arg_max(l_partkey, row(l_linenumber, l_partkey, l_suppkey)) AS document_id FROM lineitem WHERE l_linenumber % 4 = 3 GROUP BY l_orderkey")
def meeting_agendas(spark, sf_dir):
    """Every order a meeting, every line a document; the last agenda document of each."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("d"))
    listing = rows.select(F.col("l_orderkey").alias("id"), F.lit("Meeting").alias("title"), F.lit("").alias("date"), F.col("l_orderkey").alias("pos"),
                          F.transform("d", lambda d: F.struct(d["l_partkey"].alias("id"), (d["l_linenumber"] % 4).alias("compileOutputType"), F.lit("").alias("templateName"))).alias("documentList"))
    return crawl.meetings(listing, "https://fair.example.org", max_pages=2**31 - 1).select("id", "document_id")


@query("approx_page", "SELECT conv_id, turn, CAST(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_offset FROM conversations")
def approx_page(spark, sf_dir):
    """Running page ends, every conversation a document, every turn a page."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page_no"), "text")
    return paged_text.running_pages(rows).select(F.col("document").alias("conv_id"), F.col("page_no").alias("turn"), "end_offset")


@query("paged_chunks")
def paged_chunks(spark, sf_dir):
    """Conversations as paged documents."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page_no"), "text")
    return paged_text.parsed(paged_text.pages_of(rows).withColumn("category", F.lit("")))


@query("link_extract", "WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages) "
       "SELECT page_id, site || split_part(replace(replace(replace(href, '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '#', 1) AS link FROM h")
def link_extract(spark, sf_dir):
    """U7."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_chunks.extracted_links(pages).select("page_id", "link")


_VISIBLE = r"regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<(nav|header|footer|script|style|noscript)\b.*?</(nav|header|footer|script|style|noscript)>', '<x>', 'gs')"
_DECODED = """replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


@query("content_hash_dedupe", f"WITH p AS (SELECT page_id, url, CASE WHEN coalesce(html, '') = '' THEN '' ELSE md5(array_to_string(list_filter(list_transform(string_split_regex({_VISIBLE}, '<[^>]*>'), "
       f"lambda x: regexp_replace({_DECODED}, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')) END AS content_hash FROM pages) "
       "SELECT page_id, url, content_hash FROM p WHERE content_hash = '' OR page_id IN (SELECT min(page_id) FROM p GROUP BY content_hash)")
def content_hash_dedupe(spark, sf_dir):
    """The first page of each visible text; as in its SQL, a reference counts only with its semicolon."""
    pages = html_chunks.hashed(table(spark, sf_dir, "pages").select("page_id", "url", "html"), whole=True)
    return urls.keep_first_content(pages, "content_hash", "page_id").select("page_id", "url", "content_hash")


@query("html_chunks")
def page_chunks(spark, sf_dir):
    """T0-T4."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit("").alias("category"))
    return html_chunks.parsed(pages).select("page_id", "url", "chunk_no", "title", "date", "chunk_type", "category", "text")


@query("crawl_pages")
def crawl_pages(spark, sf_dir):
    """A crawl of the pages table; its page limit is the crawler's own."""
    pages = table(spark, sf_dir, "pages")
    web = pages.select("url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), "html")
    seeds = pages.select("url", F.lit("").alias("category"), F.col("page_id").alias("pos"))
    return crawl.crawl(seeds, web, ["example.com", "example.net", "example.org"]).select("seq", "url", "category", "depth")


_BARE = "concat('city', CAST(s_suppkey AS VARCHAR(20)), '.example.org')"
#: Links of a made-up home page: href as SQL, and the anchor.
_HREFS = [("'/agenda/1'", "Council agenda"), (f"concat('https://files.', {_BARE}, '/x')", "Files"), (f"concat('http://', {_BARE}, '/bids#top')", "Open bids"),
          (f"concat('http://', {_BARE}, '/bids')", "again"), ("'https://other.example.com/'", "Elsewhere"), ("'/logo.PNG'", "Logo"), ("'mailto:a@b.org'", "Mail"),
          (f"concat('https://not', {_BARE}, '/')", "Not ours"), ("'/more?page=2#x'", "More")]
_ANCHORS = ", ".join(f"""'<a href="', {h}, '"> {t} </a>'""" for h, t in _HREFS)
_HOMES = (f"SELECT s_suppkey, concat('https://www.', {_BARE}) AS url, concat('<html><head><title>Home</title><meta name=\"description\" content=\"City of ', n_name, ', FL and more\"></head><body>', "
          f"{_ANCHORS}, '</body></html>') AS html FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_CANDIDATES = (
    "WITH h AS (" + " UNION ALL ".join(f"SELECT s_suppkey, {_BARE} AS bare, {k} AS pos, '{t}' AS anchor, {h} AS href FROM supplier" for k, (h, t) in enumerate(_HREFS)) + "), "
    "r AS (SELECT s_suppkey, bare, pos, anchor, split_part(CASE WHEN starts_with(href, '/') THEN concat('https://www.', bare, href) ELSE href END, '#', 1) AS link FROM h), "
    "k AS (SELECT *, regexp_extract(link, '^https?://([^/?]*)', 1) AS host FROM r WHERE NOT regexp_matches(lower(link), '\\.(jpg|jpeg|png|gif|css|js|ico|woff|woff2)$')), "
    "c AS (SELECT s_suppkey, link, arg_min(anchor, pos) AS anchor FROM k WHERE host = bare OR ends_with(host, '.' || bare) GROUP BY s_suppkey, link) ")


def homes(spark, sf_dir):
    """A home page for every supplier."""
    return spark.sql(_HOMES.replace("FROM supplier JOIN nation", "FROM {supplier} JOIN {nation}"), supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))


@query("candidate_links", _CANDIDATES + "SELECT s_suppkey, link, anchor FROM c")
def candidate_links(spark, sf_dir):
    """U16."""
    return discovery.candidate_links(homes(spark, sf_dir)).select("s_suppkey", "link", "anchor")


@query("site_discovery", "SELECT concat('https://www.city', CAST(s_suppkey AS VARCHAR(20)), '.example.org') AS base_url, concat('city', CAST(s_suppkey AS VARCHAR(20))) AS name, "
       "'City of ' || n_name AS default_agency, n_name || ', FL' AS default_geography, CASE WHEN s_suppkey % 2 = 0 THEN 'primegov' ELSE 'default' END AS crawler_mode, "
       "CASE WHEN s_suppkey % 2 = 0 THEN 'https://fair.primegov.com' ELSE '' END AS primegov_api_base, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 3 END AS INT) AS domains, "
       "CAST(CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 4 END AS INT) AS candidates FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def site_discovery(spark, sf_dir):
    """The meta description names the place, every second meetings page the content system; every third site has a sitemap."""
    rows = homes(spark, sf_dir)
    web = rows.select(F.concat("url", F.lit("/agenda/1")).alias("url"), F.lit(200).alias("status_code"), F.when(F.col("s_suppkey") % 2 == 0, "at https://Fair.primegov.com/x").otherwise("none").alias("html"))
    listed = F.array(*[F.concat("url", F.lit(x)) for x in ("/agenda/1", "/m1", "/m2")])
    maps = rows.where("s_suppkey % 3 = 0").select(F.col("url").alias("base_url"), F.posexplode(listed).alias("pos", "url"))
    found = discovery.discover(rows.select("url", "html"), maps, web)
    told = F.regexp_extract(F.array_join("notes", "\n"), r"Discovered (\d+) candidate", 1).cast("int")
    return found.select("base_url", "name", "default_agency", "default_geography", "crawler_mode", "primegov_api_base", F.size("allowed_domains").alias("domains"), told.alias("candidates"))


@query("equal_documents", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY md5(text)")
def equal_documents(spark, sf_dir):
    """The first of each equal text and its copies; an extra, no operator of its own."""
    rows = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("seed_lines", f"SELECT page_id, url, 'meetings' AS category, 'Page ' || page_id AS label FROM ({LINKS})")
def seed_lines(spark, sf_dir):
    """K5: the seed text of every link, read back."""
    lines = links(spark, sf_dir).select("page_id", F.concat(F.lit("\n "), F.col("url"), F.lit(" | meetings | Page "), F.col("page_id").cast("string"), F.lit(" \n\n")).alias("t"))
    return lines.select("page_id", F.explode(order.seed_rows(F.col("t"))).alias("s")).select("page_id", "s.url", "s.category", "s.label")
