"""Mentions and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.common import DIALOGUES_SQL, REPORTS_SQL, dialogues, nested_replace_sql, r6, reports
from medloom.operators import findings as found
from medloom.operators import mentions as op
from medloom.operators import terms
from medloom.rules import colon, liver, negation

_COUNTED = [*liver.PROXIMITY, "one_inflammation", "more_inflammations"]
PLACE = ["report_id", "sent_no", "segment_no", "ent_no"]


def normalised_sentences(spark, sf_dir):
    out = op.sentences(reports(spark, sf_dir), "report_id", "Report_Text", liver)
    return out.select("report_id", "sent_no", F.md5("sentence").alias("sentence_md5"))


def _spans(df, rules, is_colon):
    rows = op.sentences(df, "report_id", "Report_Text", rules)
    return op.flip_leading(op.spans(rows, rules, is_colon))


def sentence_mentions(spark, sf_dir):
    return _spans(reports(spark, sf_dir), liver, False).select(*PLACE, "text", "negated")


def negated_mentions(spark, sf_dir):
    return _spans(dialogues(spark, sf_dir), colon, True).select(*PLACE, "text", "negated")


def proximity_hits(spark, sf_dir):
    rows = op.sentences(reports(spark, sf_dir), "report_id", "Report_Text", liver)
    counts = [F.count_if(col).alias(name) for name, col in op.features(liver).items() if name in _COUNTED]
    return rows.groupBy("report_id").agg(*counts)


def carry_forward(spark, sf_dir):
    rows = op.sentences(reports(spark, sf_dir), "report_id", "Report_Text", colon)
    return rows.filter(F.col("sentence").rlike("^(this|inflammation) was")).select(
        "report_id", "sent_no", F.md5("sentence").alias("sentence_md5")
    )


def _liver(spark, sf_dir):
    return op.mentions(reports(spark, sf_dir), "report_id", "Report_Text", liver)


def _colon(spark, sf_dir):
    return op.mentions(reports(spark, sf_dir), "report_id", "Report_Text", colon)


def enriched_mentions(spark, sf_dir):
    return _colon(spark, sf_dir).select(*PLACE, "text", "affirmed")


def mention_table(spark, sf_dir):
    return _liver(spark, sf_dir)


def _liver_findings(spark, sf_dir):
    return found.add_liver_findings(reports(spark, sf_dir), only_liver_biopsy=False, update=False)


def _colon_findings(spark, sf_dir):
    return found.add_colon_findings(reports(spark, sf_dir))


def finding_tristate(spark, sf_dir):
    return _liver_findings(spark, sf_dir).select("report_id", *liver.FINDINGS)


def finding_list(spark, sf_dir):
    return _liver_findings(spark, sf_dir).select(
        "report_id", F.coalesce(F.array_join("disease_list", "|"), F.lit("")).alias("disease_list")
    )


def stage_first(spark, sf_dir):
    return _liver_findings(spark, sf_dir).select("report_id", "fibrosis_stage_4", "fibrosis_stage_6")


def colon_findings(spark, sf_dir):
    return _colon_findings(spark, sf_dir).select(
        "report_id", *colon.FINDINGS, "mayo_score",
        F.coalesce(F.array_join("disease_list", "|"), F.lit("")).alias("disease_list"),
    )


def score_max(spark, sf_dir):
    return op.scores(reports(spark, sf_dir), "report_id", "Report_Text", colon)


LEAST_TERM = 20
TERMS_KEPT = 300


def _term_values(spark, sf_dir):
    rows = op.sentences(reports(spark, sf_dir), "report_id", "Report_Text", liver)
    return terms.c_values(rows, least=LEAST_TERM)


def learned_terms(spark, sf_dir):
    """C-values of the frequent phrases of all sentences."""
    return _term_values(spark, sf_dir).select(
        "phrase", "n", "longer", "within", r6(F.col("c_value"), 4).alias("c_value"))


def term_mentions(spark, sf_dir):
    """Mentions of the best phrases that end in a head word, in place of the fixed vocabulary."""
    learned = terms.lexicon(_term_values(spark, sf_dir), liver.HEADS, TERMS_KEPT)
    rows = op.sentences(reports(spark, sf_dir), "report_id", "Report_Text", liver)
    return op.flip_leading(op.spans(rows, liver, terms=learned)).select(*PLACE, "text", "negated")


# SQL forms: sentences are unnested first, every context rule is a step of its own, and a mention's scope is the text
# before and after it. Patterns are put together here from the rule tables alone.


def _words_sql(terms: list[str]) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


def _triggers_sql(is_colon: bool) -> dict[str, str]:
    n = negation
    return {
        "pseudo": _words_sql(n.PSEUDO + n.PSEUDO_ADDED + n.PSEUDO_COLON * is_colon),
        "preceding": _words_sql(n.PRECEDING + n.PRECEDING_ADDED + n.PRECEDING_COLON * is_colon),
        "following": _words_sql(n.FOLLOWING + n.FOLLOWING_ADDED + n.FOLLOWING_COLON * is_colon),
        "termination": "|".join([_words_sql(n.TERMINATION), *n.TERMINATION_ADDED]),
    }


def _mention_sql(rules) -> str:
    modifier = rf"(?:\b(?:{'|'.join(rules.MODIFIERS)})[\w&-]*[ ]+)"
    return rf"(?:\b(?:no |non-|non ))?{modifier}{{0,4}}\b[\w&'-]*(?:{'|'.join(rules.HEADS)})[\w&'-]*"


def _near_sql(pairs) -> str:
    return r"\b(?:" + "|".join(rf"{a}\W+(?:\w+\W+){{0,{n}}}?{b}" for a, b, n in pairs) + r")\b"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _occurs_sql(column: str, part: str) -> str:
    return f"regexp_matches({column}, {_q(part)})" if r"\b" in part else f"contains({column}, {_q(part)})"


def _holds_sql(column: str, rule) -> str:
    terms = ["(" + " OR ".join(_occurs_sql(column, p) for p in group) + ")" for group in rule.groups]
    terms += ["NOT (" + " AND ".join(_occurs_sql(column, p) for p in combo) + ")" for combo in rule.unless]
    return " AND ".join(terms) or "true"


def _sentences_sql(rules, source: str = REPORTS_SQL) -> str:
    report = nested_replace_sql("txt", rules.REPORT_REWRITES)
    if rules is colon:
        report = f"replace(regexp_replace({report}, ' UC$', ' UlcerativeColitis'), '  - ', '.')"
    report = nested_replace_sql(f"lower({report})", rules.LOWER_REWRITES)
    line = "s0"
    for word, other in rules.WORD_REWRITES:
        line = rf"regexp_replace({line}, '\b{word}\b', '{other}', 'g')"
    line = rf"trim(regexp_replace({line}, '[ \t\n\v\f\r]+', ' ', 'g'), ' ')"
    line = nested_replace_sql(line, rules.SENTENCE_REWRITES)
    sql = f"""WITH {source},
    prep AS MATERIALIZED (SELECT report_id, {report} AS report FROM reports),
    raw AS (SELECT report_id, report, unnest(string_split(report, '.')) AS s0,
      generate_subscripts(string_split(report, '.'), 1) - 1 AS sent_no FROM prep),
    n0 AS MATERIALIZED (SELECT report_id, report, CAST(sent_no AS INT) AS sent_no, {line} AS sentence FROM raw)"""
    if rules is liver:
        bridged = nested_replace_sql("sentence", rules.BRIDGING_REWRITES)
        return sql + f""", sents AS MATERIALIZED (SELECT * REPLACE (
          CASE WHEN contains(sentence, 'bridging') THEN {bridged} ELSE sentence END AS sentence) FROM n0)"""
    carried = nested_replace_sql("sentence", rules.CARRIED)
    normal = nested_replace_sql("sentence", rules.NORMAL_REWRITES)
    return sql + f""", n1 AS (SELECT *, max(CASE WHEN contains(sentence, 'inflam') THEN sent_no END) OVER (
        PARTITION BY report_id ORDER BY sent_no) AS named FROM n0),
    n2 AS MATERIALIZED (SELECT report_id, report, sent_no, CASE WHEN starts_with(sentence, 'this was')
        AND sent_no - named <= 2 THEN {carried} ELSE sentence END AS sentence FROM n1),
    sents AS MATERIALIZED (SELECT report_id, report, sent_no,
        CASE WHEN {_holds_sql('sentence', rules.NORMAL)} THEN {normal} ELSE sentence END AS sentence FROM n2)"""


def _spans_sql(rules, is_colon: bool, source: str = REPORTS_SQL) -> str:
    t = _triggers_sql(is_colon)

    def has(column: str, kind: str) -> str:
        return f"regexp_matches(regexp_replace({column}, {_q(t['pseudo'])}, ' ', 'g'), {_q(t[kind])})"

    return _sentences_sql(rules, source) + f""",
    seg AS (SELECT *, string_split(regexp_replace(sentence, {_q('(' + t['termination'] + ')')}, chr(3) || '\\1', 'g'),
        chr(3)) AS segs FROM sents),
    seg1 AS (SELECT * EXCLUDE (segs), unnest(segs) AS segment, generate_subscripts(segs, 1) - 1 AS segment_no FROM seg),
    pt AS (SELECT *, string_split(regexp_replace(segment, {_q('(' + _mention_sql(rules) + ')')},
        chr(2) || '\\1' || chr(1), 'g'), chr(2)) AS parts FROM seg1),
    pt1 AS (SELECT *, unnest(range(1, len(parts))) AS ent_no FROM pt),
    pt2 AS (SELECT *, string_split(parts[ent_no + 1], chr(1))[1] AS t0,
        replace(array_to_string(parts[1:ent_no], ''), chr(1), '') AS bef,
        string_split(parts[ent_no + 1], chr(1))[2]
          || replace(coalesce(array_to_string(parts[ent_no + 2:], ''), ''), chr(1), '') AS aft FROM pt1),
    sp AS MATERIALIZED (SELECT report_id, report, sentence, sent_no, CAST(segment_no AS INT) AS segment_no,
        CAST(ent_no AS INT) AS ent_no, regexp_replace(t0, '^(?:no |non-|non )', '') AS text,
        ({has('bef', 'preceding')} OR {has('aft', 'following')}) <> regexp_matches(t0, '^(?:no |non-|non )') AS negated
      FROM pt2)"""


def _feature_sql(rules) -> dict[str, str]:
    out = {n: f"regexp_matches(sentence, {_q(_near_sql(p))})" for n, p in rules.PROXIMITY.items()}
    out |= {n: f"regexp_matches(report, {_q(_near_sql(p))})" for n, p in getattr(rules, "REPORT_PROXIMITY", {}).items()}
    out |= {
        "one_inflammation": "len(string_split(sentence, 'inflammation')) <= 2",
        "more_inflammations": "len(string_split(sentence, 'inflammation')) > 2",
        "surveillance": "contains(sentence, 'surveillance')",
        "no_biopsies_taken":
            "NOT ((contains(sentence, 'biops') OR contains(sentence, ' bx ')) AND contains(sentence, 'taken'))",
    }
    return out


def _mentions_sql(rules, is_colon: bool) -> str:
    sql = _spans_sql(rules, is_colon)
    feature = _feature_sql(rules)
    last = "sp"
    for i, rule in enumerate(rules.ENRICHMENT):
        terms = [_holds_sql("text", rule.mention), _holds_sql("sentence", rule.sentence)]
        terms += ["(" + " OR ".join(feature[n] for n in group) + ")" for group in rule.where]
        terms += ["NOT " + feature[n] for n in rule.where_not]
        new = f"{_q(rule.text + ' ')} || text" if rule.side == "prepend" else f"text || {_q(' ' + rule.text)}"
        sql += f""", e{i} AS MATERIALIZED (SELECT * REPLACE (
          CASE WHEN {' AND '.join(terms)} THEN {new} ELSE text END AS text) FROM {last})"""
        last = f"e{i}"
    text = nested_replace_sql("text", rules.MENTION_REWRITES)
    if rules is colon:
        return sql + rf""", m AS MATERIALIZED (SELECT report_id, sent_no, segment_no, ent_no,
          trim(regexp_replace({text}, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS text, NOT negated AS affirmed FROM {last})"""
    line = nested_replace_sql("sentence", rules.STAGE_REWRITES)
    return sql + rf""",
    st0 AS (SELECT * REPLACE ({text} AS text), CASE WHEN contains(sentence, 'stage') THEN {line} END AS l FROM {last}),
    st1 AS (SELECT *, regexp_extract(l, 'stage.*?(\d+(?:\.\d+)?)', 1) AS one,
        regexp_extract_all(l, 'stage.*?(\d+(?:\.\d+)?).*?(\d+(?:\.\d+)?)', 1) AS sv,
        regexp_extract_all(l, 'stage.*?(\d+(?:\.\d+)?).*?(\d+(?:\.\d+)?)', 2) AS sr,
        regexp_extract_all(l, 'ishak.*?(\d+(?:\.\d+)?).*?(\d+(?:\.\d+)?)', 1) AS iv,
        regexp_extract_all(l, 'ishak.*?(\d+(?:\.\d+)?).*?(\d+(?:\.\d+)?)', 2) AS ir FROM st0),
    st2 AS (SELECT *, len(sv) = 1 AND (NOT contains(one, '.') OR contains(sv[1], '.')) AS paired,
        coalesce(one <> '' AND (NOT contains(l, 'pbc') OR abs(instr(l, 'pbc') - instr(l, 'stage'))
          >= abs(instr(l, 'fibrosis') - instr(l, 'stage'))), false)
          AND regexp_matches(text, 'fibrosis|bridging|cirrhosis') AS ok FROM st1),
    st3 AS (SELECT *, CASE WHEN ok THEN CAST(CASE WHEN len(iv) = 1 THEN iv[1] WHEN paired THEN sv[1] ELSE one END
          AS DOUBLE) END AS v,
        CASE WHEN ok THEN CAST(CASE WHEN len(iv) = 1 THEN ir[1] WHEN paired THEN sr[1] ELSE '4' END AS DOUBLE) END AS r0
      FROM st2),
    st4 AS (SELECT *, CASE WHEN v >= 5 THEN 6.0 ELSE r0 END AS r FROM st3),
    st5 AS (SELECT *, coalesce(r IN (4.0, 6.0) AND v <= r, false) AS fits FROM st4),
    m AS MATERIALIZED (SELECT report_id, sent_no, segment_no, ent_no,
        trim(regexp_replace(text || CASE WHEN fits AND contains(l, 'ishak') THEN ' ishak' ELSE '' END, '[ \t\n\v\f\r]+', ' ', 'g'), ' ')
          AS text,
        CASE WHEN ok THEN v <> 0 ELSE NOT negated END AS affirmed,
        CAST(CASE WHEN fits THEN v END AS DOUBLE) AS stage,
        CAST(CASE WHEN fits THEN CASE WHEN contains(l, 'ishak') THEN 6 ELSE r END END AS INT) AS stage_scale FROM st5)"""


def _any_sql(needs) -> str:
    return "(" + " OR ".join("(" + _holds_sql("text", n) + ")" for n in needs) + ")"


def _tri_sql(rules) -> str:
    return ", ".join(
        f"bool_or(CASE WHEN {_any_sql(needs)} THEN affirmed END) AS {name}" for name, needs in rules.FINDINGS.items()
    )


def _stated_sql(rules) -> str:
    return _any_sql([n for needs in rules.FINDINGS.values() for n in needs])


_SCORE_LINE = nested_replace_sql("sentence", colon.SCORE_RANGES)
_SCORES = rf""", sc AS (SELECT report_id, max(v) AS score FROM (
    SELECT report_id, unnest(list_filter(list_transform(
      list_concat(regexp_extract_all({_SCORE_LINE}, 'mayo.*?(\d+(?:,\d+)*(?:\.\d+)?)', 1),
        regexp_extract_all({_SCORE_LINE}, 'grade.*?(\d+(?:,\d+)*(?:\.\d+)?)', 1)),
      lambda z: try_cast(z AS DOUBLE)), lambda z: z BETWEEN 0 AND 4)) AS v
    FROM sents WHERE contains(sentence, 'mayo')) GROUP BY report_id)"""

_LIVER_M, _COLON_M = _mentions_sql(liver, False), _mentions_sql(colon, True)
_LIVER_IDS = "(SELECT report_id FROM reports WHERE site <> 'OTHER') k"

QUERIES = {
    "normalised_sentences": normalised_sentences,
    "sentence_mentions": sentence_mentions,
    "negated_mentions": negated_mentions,
    "proximity_hits": proximity_hits,
    "carry_forward": carry_forward,
    "enriched_mentions": enriched_mentions,
    "mention_table": mention_table,
    "finding_tristate": finding_tristate,
    "finding_list": finding_list,
    "stage_first": stage_first,
    "colon_findings": colon_findings,
    "score_max": score_max,
    "learned_terms": learned_terms,
    "term_mentions": term_mentions,
}

ORACLES = {
    "normalised_sentences": _sentences_sql(liver) + " SELECT report_id, sent_no, md5(sentence) AS sentence_md5 FROM sents",
    "sentence_mentions": _spans_sql(liver, False)
    + " SELECT report_id, sent_no, segment_no, ent_no, text, negated FROM sp",
    "negated_mentions": _spans_sql(colon, True, DIALOGUES_SQL)
    + " SELECT report_id, sent_no, segment_no, ent_no, text, negated FROM sp",
    "proximity_hits": _sentences_sql(liver) + " SELECT report_id, "
    + ", ".join(f"count(*) FILTER ({sql}) AS {name}" for name, sql in _feature_sql(liver).items() if name in _COUNTED)
    + " FROM sents GROUP BY report_id",
    "carry_forward": _sentences_sql(colon) + """ SELECT report_id, sent_no, md5(sentence) AS sentence_md5 FROM sents
        WHERE regexp_matches(sentence, '^(this|inflammation) was')""",
    "enriched_mentions": _COLON_M + " SELECT * FROM m",
    "mention_table": _LIVER_M + " SELECT * FROM m",
    "finding_tristate": _LIVER_M + f""", f AS (SELECT report_id, {_tri_sql(liver)} FROM m GROUP BY report_id)
        SELECT k.report_id, f.* EXCLUDE (report_id) FROM {_LIVER_IDS} LEFT JOIN f ON f.report_id = k.report_id""",
    "finding_list": _LIVER_M + f""", f AS (SELECT report_id, string_agg(text, '|' ORDER BY sent_no, segment_no, ent_no)
          AS d FROM m WHERE (affirmed AND {_stated_sql(liver)}) OR stage IS NOT NULL GROUP BY report_id)
        SELECT k.report_id, coalesce(d, '') AS disease_list FROM {_LIVER_IDS} LEFT JOIN f ON f.report_id = k.report_id""",
    "stage_first": _LIVER_M + f""", f AS (
          SELECT report_id, stage, stage_scale, row_number() OVER (PARTITION BY report_id, stage_scale
            ORDER BY sent_no, segment_no, ent_no) AS rn FROM m WHERE stage IS NOT NULL)
        SELECT k.report_id, max(stage) FILTER (stage_scale = 4) AS fibrosis_stage_4,
          max(stage) FILTER (stage_scale = 6) AS fibrosis_stage_6
        FROM {_LIVER_IDS} LEFT JOIN f ON f.report_id = k.report_id AND rn = 1 GROUP BY k.report_id""",
    "colon_findings": _COLON_M + _SCORES + f""",
        am AS (SELECT * FROM m UNION ALL
          SELECT report_id, 2147483647, 0, 0, 'colitis mayo-' || score, true FROM sc),
        f AS (SELECT report_id, {_tri_sql(colon)}, coalesce(string_agg(text, '|' ORDER BY sent_no, segment_no, ent_no)
            FILTER (affirmed AND {_stated_sql(colon)}), '') AS dl FROM am GROUP BY report_id)
        SELECT r.report_id, f.* EXCLUDE (report_id, dl), CASE WHEN score > 3 THEN 3.0 ELSE score END AS mayo_score, coalesce(dl, '') AS disease_list
        FROM reports r LEFT JOIN f ON f.report_id = r.report_id AND r.site <> 'OTHER'
        LEFT JOIN sc ON sc.report_id = r.report_id AND r.site <> 'OTHER'""",
    "learned_terms": _sentences_sql(liver) + f""",
        parts AS (SELECT unnest(regexp_split_to_array(sentence, '{terms.PART}')) AS part FROM sents),
        w AS (SELECT list_filter(string_split(part, ' '), lambda x: x <> '') AS w FROM parts),
        g AS (SELECT array_to_string(w[i + 1 : i + k], ' ') AS phrase, k, count(*) AS n
          FROM (SELECT w, k, unnest(range(len(w) - k + 1)) AS i FROM w, range(1, 5) r(k) WHERE len(w) >= k) GROUP BY ALL
          HAVING count(*) >= {LEAST_TERM}),
        inside AS (SELECT DISTINCT phrase AS holder, n AS held_n, array_to_string(string_split(phrase, ' ')[i + 1 : i + j], ' ') AS part
          FROM g, range(1, 4) r(j), range(0, 4) q(i) WHERE j < k AND i + j <= k),
        h AS (SELECT part, count(*) AS longer, sum(held_n) AS within FROM inside GROUP BY part)
        SELECT phrase, n, coalesce(longer, 0) AS longer, CAST(coalesce(within, 0) AS BIGINT) AS within,
          round(log2(k + 1) * (n - coalesce(within / longer, 0)), 4) + 0.0 AS c_value
        FROM g LEFT JOIN h ON h.part = g.phrase""",
    "score_max": _sentences_sql(colon) + _SCORES + " SELECT report_id, score FROM sc",
}
