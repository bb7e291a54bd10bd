"""Mentions of findings in reports: sentences, rewrites, spans, negation, context and stages.

Everything up to the mention table is narrow: a report's sentences and mentions are exploded in place and no
step moves rows between tasks. What depends on the sentence is computed once per sentence or segment, as flags and
counts; no text but its own goes along with a mention. ``rules`` is one of the rule modules ``medloom.rules.liver``
and ``.colon``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.rewriting import Rewriter, rewritten
from medloom.functions.text import are_near, ascii_bounds, bound, collapse_whitespace, occurrences, rewrite
from medloom.operators.terms import mark_terms
from medloom.rules import negation
from medloom.rules.need import Enrich, holds, holds_in

# Marks put around triggers and mentions while a sentence is taken apart; report texts do not hold them.
OPEN, CLOSE, BREAK = "\u0002", "\u0001", "\u0003"

PAIRED_NUMBER = r".*?(\d+(?:\.\d+)?)"
SENTENCES_AT_ONCE = 20_000


def _any(terms: Sequence[str]) -> str:
    """One pattern for all terms: those of one first letter together, in their order, behind looks at the letter.

    Terms of different letters can't match at one place, so this is the plain list of alternatives, only faster: the
    letters are halved at each look, and only terms of the letter that stands there are tried.
    """
    groups: dict[str, list[str]] = {}
    for term in terms:
        groups.setdefault(re.sub(r"^\\b", "", term)[0], []).append(term)

    def behind(letters: list[str]) -> str:
        return f"(?=[{''.join(re.escape(c) for c in letters)}])"

    def tree(letters: list[str]) -> str:
        if len(letters) == 1:
            return "(?:" + "|".join(groups[letters[0]]) + ")"
        half = len(letters) // 2
        return f"(?:{behind(letters[:half])}{tree(letters[:half])}|{behind(letters[half:])}{tree(letters[half:])})"

    return behind(list(groups)) + tree(sorted(groups))


def mention_pattern(rules) -> str:
    """A head word with up to four modifiers before it, and a leading negation if there is one."""
    heads, modifiers = _any(rules.HEADS), _any(rules.MODIFIERS)
    # A word begins here: within one, the match would have begun earlier.
    return ascii_bounds(
        rf"(?:\b(?:no |non-|non ))?(?:\b{modifiers}[\w&-]*[ ]+){{0,4}}(?<!\w)(?=\w)[\w&'-]*{heads}[\w&'-]*"
    )


def _word_pattern(terms: list[str], between: str = " ") -> str:
    return ascii_bounds(r"\b(?:" + _any([t.replace(" ", between) for t in terms]) + r")\b")


def _shortest(terms: list[str]) -> list[str]:
    """Without terms that hold another one: where they occur, that one does too."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o != t and re.search(_word_pattern([re.escape(o)]), t) for o in terms)]


def trigger_patterns(colon: bool = False) -> dict[str, str]:
    """Patterns of the pseudo, preceding, following and termination triggers, in a segment with marked mentions."""
    pseudo = negation.PSEUDO + negation.PSEUDO_ADDED + (negation.PSEUDO_COLON if colon else [])
    before = negation.PRECEDING + negation.PRECEDING_ADDED + (negation.PRECEDING_COLON if colon else [])
    after = negation.FOLLOWING + negation.FOLLOWING_ADDED + (negation.FOLLOWING_COLON if colon else [])
    marked = f"{CLOSE}?[ ]{OPEN}?"
    return {
        "pseudo": _word_pattern(pseudo, marked),
        "preceding": _word_pattern(_shortest(before), marked),
        "following": _word_pattern(_shortest(after), marked),
        "termination": _word_pattern(negation.TERMINATION) + "|" + "|".join(negation.TERMINATION_ADDED),
    }


def prepare_report(text: Column, rules) -> Column:
    """Report-level rewrites and lower case."""
    text = rewritten(text, rules.REPORT_REWRITES)
    if hasattr(rules, "REPORT_END_REWRITE"):
        text = F.regexp_replace(text, *rules.REPORT_END_REWRITE)
        text = F.replace(text, F.lit(rules.LIST_DASH[0]), F.lit(rules.LIST_DASH[1]))
    return rewrite(F.lower(text), rules.LOWER_REWRITES)


@lru_cache(maxsize=16)
def _rewriter(rules: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(rules)


class SentenceRules:
    """The rewrites of a rule module, for the sentences of a report in order."""

    def __init__(self, rules):
        self.words = list(rules.WORD_REWRITES)
        self.sentence = tuple(rules.SENTENCE_REWRITES)
        self.bridging = tuple(getattr(rules, "BRIDGING_REWRITES", ()))
        self.carried = tuple(getattr(rules, "CARRIED", ()))
        self.carried_term = getattr(rules, "CARRIED_TERM", "")
        self.carried_sentences = getattr(rules, "CARRIED_SENTENCES", 0)
        self.normal = getattr(rules, "NORMAL", None)
        self.normal_rewrites = tuple(getattr(rules, "NORMAL_REWRITES", ()))

    def split(self) -> Callable[[str], list[str]]:
        """Sentences of a report, with whole words and spaces put right; neither reaches over the end of a sentence."""
        words = [(word, re.compile(rf"\b{word}\b", re.ASCII), other) for word, other in self.words]
        space = re.compile(r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+")

        def parts(report: str) -> list[str]:
            for word, pattern, other in words:
                if word in report:
                    report = pattern.sub(other, report)
            return [s.strip(" ") for s in space.sub(" ", report).split(".")]

        return parts

    def normalised(self) -> Callable[[str], str]:
        rewriter, bridging = _rewriter(self.sentence), _rewriter(self.bridging)

        def one(sentence: str) -> str:
            sentence = rewriter(sentence)
            return bridging(sentence) if self.bridging and "bridging" in sentence else sentence

        return one

    def report(self, sentences: list[str], normalised: Callable[[str], str]) -> list[str]:
        """A sentence that grades "this" takes its subject from one of the sentences just before it."""
        lines = [normalised(s) for s in sentences]
        out = list(lines)
        if self.carried:
            carried = _rewriter(self.carried)
            for k, line in enumerate(lines):
                if line.startswith("this was"):
                    recent = lines[max(0, k - self.carried_sentences) : k + 1]
                    if any(self.carried_term in s for s in recent):
                        out[k] = carried(line)
        if self.normal is not None:
            normal = _rewriter(self.normal_rewrites)
            out = [normal(s) if holds_in(s, self.normal) else s for s in out]
        return out


def _normalise(batches, rules: SentenceRules) -> Iterator[pa.RecordBatch]:
    """Rows of a report to one row per normalised sentence; the last column has the report."""
    split, normalised = rules.split(), rules.normalised()
    for batch in batches:
        rows, places, lines = [], [], []

        def emit():
            kept = [batch.column(n).take(pa.array(rows, pa.int32())) for n in batch.schema.names[:-1]]
            columns = [kept[0], pa.array(places, pa.int32()), pa.array(lines, pa.string()), *kept[1:]]
            return pa.record_batch(columns, names=[batch.schema.names[0], "sent_no", "sentence", *batch.schema.names[1:-1]])

        for k in range(batch.num_rows):
            raw = batch.column(batch.num_columns - 1)[k].as_py()
            found = [None] if raw is None else rules.report(split(raw), normalised)
            rows += [k] * len(found)
            places += [None] if raw is None else range(len(found))
            lines += found
            if len(rows) >= SENTENCES_AT_ONCE:
                yield emit()
                rows, places, lines = [], [], []
        if rows:
            yield emit()


def sentences(df: DataFrame, key: str, text: str, rules) -> DataFrame:
    """(key, sent_no, sentence, report-level facts): normalised sentences; a report without text has one null row.

    Facts of the whole report are computed before the split, so that no sentence carries the report along. The
    rewrites of sentences run in Python workers, where an automaton finds the few that apply to a sentence.
    """
    prepared = df.select(key, prepare_report(F.col(text), rules).alias("report"))
    facts = {name: are_near(F.col("report"), pairs) for name, pairs in getattr(rules, "REPORT_PROXIMITY", {}).items()}
    whole = prepared.select(key, *[c.alias(n) for n, c in facts.items()], "report")
    kind = whole.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "sent_no int", "sentence string", *[f"{name} boolean" for name in facts]])
    own = SentenceRules(rules)
    return whole.mapInArrow(lambda batches: _normalise(batches, own), schema)


def features(rules) -> dict[str, Column]:
    """Named facts of a sentence that the context rules ask for."""
    sentence = F.col("sentence")
    out = {name: are_near(sentence, pairs) for name, pairs in rules.PROXIMITY.items()}
    out |= {name: F.col(name) for name in getattr(rules, "REPORT_PROXIMITY", {})}
    count = occurrences(sentence, "inflammation")
    taken = (sentence.contains("biops") | sentence.contains(" bx ")) & sentence.contains("taken")
    out |= {
        "one_inflammation": count <= 1,
        "more_inflammations": count > 1,
        "surveillance": sentence.contains("surveillance"),
        "no_biopsies_taken": ~taken,
    }
    used = {name for rule in rules.ENRICHMENT for group in rule.where for name in group}
    used |= {name for rule in rules.ENRICHMENT for name in rule.where_not}
    return {name: col for name, col in out.items() if name in used}


def with_context(df: DataFrame, rules) -> DataFrame:
    """Add ``context``: one bit per context rule that the sentence allows."""
    facts = {n: c for n, c in features(rules).items() if n not in df.columns}
    stepped = df.select("*", *[c.alias(n) for n, c in facts.items()])

    def allowed(rule: Enrich) -> Column:
        when = holds(F.col("sentence"), rule.sentence)
        for group in rule.where:
            when = when & reduce(lambda a, b: a | b, [F.col(name) for name in group])
        for name in rule.where_not:
            when = when & ~F.col(name)
        return when

    bits = [F.when(allowed(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules.ENRICHMENT)]
    return stepped.select(*df.columns, reduce(lambda a, b: a + b, bits).alias("context"))


def parse_stages(df: DataFrame, rules) -> DataFrame:
    """Add ``stage_seen`` (value as written) and ``stage``, ``stage_scale`` where the value fits a known scale."""
    staged = df.withColumn(
        "_line", F.when(F.col("sentence").contains("stage"), rewrite(F.col("sentence"), rules.STAGE_REWRITES))
    )
    line = F.col("_line")
    pair, ishak = "stage" + PAIRED_NUMBER + PAIRED_NUMBER, "ishak" + PAIRED_NUMBER + PAIRED_NUMBER
    staged = staged.withColumns(
        {
            "_one": F.regexp_extract(line, "stage" + PAIRED_NUMBER, 1),
            "_values": F.regexp_extract_all(line, F.lit(pair), F.lit(1)),
            "_refs": F.regexp_extract_all(line, F.lit(pair), F.lit(2)),
            "_ivalues": F.regexp_extract_all(line, F.lit(ishak), F.lit(1)),
            "_irefs": F.regexp_extract_all(line, F.lit(ishak), F.lit(2)),
        }
    )
    one, first = F.col("_one"), F.get("_values", F.lit(0))
    paired = (F.size("_values") == 1) & (~one.contains(".") | first.contains("."))
    by_ishak = F.size("_ivalues") == 1
    far_pbc = F.abs(F.locate("pbc", line) - F.locate("stage", line)) >= F.abs(
        F.locate("fibrosis", line) - F.locate("stage", line)
    )
    found = (one != "") & (~line.contains("pbc") | far_pbc)
    value = F.when(by_ishak, F.get("_ivalues", F.lit(0))).when(paired, first).otherwise(one).try_cast("double")
    scale = F.when(by_ishak, F.get("_irefs", F.lit(0))).when(paired, F.get("_refs", F.lit(0))).otherwise("4")
    staged = staged.withColumn("stage_seen", F.when(found, value)).withColumn("_scale", scale.try_cast("double"))
    scale = F.when(F.col("stage_seen") >= 5, F.lit(6.0)).otherwise(F.col("_scale"))
    fits = scale.isin([float(s) for s in rules.STAGE_SCALES]) & (F.col("stage_seen") <= scale)
    named = F.coalesce(line.contains("ishak"), F.lit(False))
    return staged.select(
        *df.columns,
        "stage_seen",
        F.when(fits, F.col("stage_seen")).alias("stage"),
        F.when(fits, F.when(named, F.lit(6)).otherwise(scale.cast("int"))).alias("stage_scale"),
        (F.coalesce(fits, F.lit(False)) & named).alias("_ishak"),
    )


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def spans(
    df: DataFrame, rules, colon: bool = False, score: str | None = None, terms: Sequence[str] | None = None
) -> DataFrame:
    """One row per mention of each sentence: text, negated, and its place (segment_no, ent_no), without the sentence.

    A sentence is cut before every termination trigger. A mention is negated when a preceding trigger stands
    before it, or a following trigger after it, in the same segment; pseudo triggers do not count. So two counts per
    segment tell the negated ones: how many mentions begin before the first preceding trigger ends, and how many end
    before the last following trigger begins. The work is in proportion to the length of the segment.

    ``score`` names a column that gets one more row per sentence that has it, with null text; other rows have null.
    ``terms`` are learned phrases that stand in the place of the vocabulary (see ``terms.lexicon``).
    """
    triggers = trigger_patterns(colon)
    kept = [c for c in df.columns if c != "sentence"]
    cut = F.split(F.regexp_replace("sentence", f"({triggers['termination']})", BREAK + "$1"), BREAK)
    if score is not None:
        cut = F.when(F.col(score).isNull(), cut).otherwise(F.array_append(cut, F.lit(None).cast("string")))
    rows = df.select(*kept, F.posexplode_outer(cut).alias("segment_no", "_segment"))
    if terms is None:
        marked = F.regexp_replace("_segment", f"({mention_pattern(rules)})", OPEN + "$1" + CLOSE)
        rows = rows.select(*kept, "segment_no", marked.alias("_marked"))
    else:
        rows = mark_terms(rows.withColumnRenamed("_segment", "_marked"), "_marked", terms, OPEN, CLOSE)
    if score is None:
        rows = rows.filter(F.col("_marked").contains(OPEN))
    else:
        rows = rows.filter(F.col("_marked").isNull() | F.col("_marked").contains(OPEN))
    # Pseudo triggers become blanks; marks within them stay.
    blanks = F.zip_with(
        F.split("_marked", triggers["pseudo"]), F.regexp_extract_all("_marked", F.lit(triggers["pseudo"]), F.lit(0)),
        lambda part, pseudo: F.concat(part, F.coalesce(F.regexp_replace(pseudo, f"[^{OPEN}{CLOSE}]", " "), F.lit(""))))
    blanked = F.when(F.col("_marked").rlike(triggers["pseudo"]), F.array_join(blanks, "")).otherwise(F.col("_marked"))
    rows = rows.select(*kept, "segment_no", "_marked", blanked.alias("_scope"))
    until = F.regexp_extract("_scope", f"(?s)^(.*?{triggers['preceding']})", 1)
    rows = rows.select(
        *kept, "segment_no", "_marked",
        F.when(until == "", F.lit(2**31 - 1)).otherwise(_count(until, OPEN)).alias("_after"),
        _count(F.regexp_extract("_scope", f"(?s)^(.*){triggers['following']}", 1), CLOSE).alias("_before"))
    parts = F.split("_marked", OPEN)
    parts = F.when(parts.isNotNull(), F.slice(parts, F.lit(2), F.lit(2**31 - 1))).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select(*kept, "segment_no", "_after", "_before", F.posexplode_outer(parts).alias("_place", "_part"))
    number = F.col("_place") + 1
    return rows.select(
        *[F.when(F.col("_part").isNull(), F.col(c)).alias(c) if c == score else c for c in kept],
        "segment_no", number.alias("ent_no"),
        F.substring_index("_part", CLOSE, 1).alias("text"),
        ((number > F.col("_after")) | (number <= F.col("_before"))).alias("negated"),
    )


def flip_leading(df: DataFrame) -> DataFrame:
    """A mention that itself begins with a negation loses it and changes polarity."""
    text = F.col("text")
    lead = reduce(lambda a, b: a | b, [text.startswith(p) for p in negation.LEADING])
    stripped = F.regexp_replace(text, "^(?:" + "|".join(negation.LEADING) + ")", "")
    return df.withColumns(
        {"negated": F.when(lead, ~F.col("negated")).otherwise(F.col("negated")), "text": stripped}
    )


def enriched(text: Column, rules) -> Column:
    """Apply the context rules that the sentence allows in order, each to the mention as the rule before left it."""
    new = text
    for k, rule in enumerate(rules.ENRICHMENT):
        new = bound(new, _context_rule(rule, 1 << k))
    # Most sentences allow none.
    return rewrite(F.when(F.col("context") == 0, text).otherwise(new), rules.MENTION_REWRITES)


def _context_rule(rule: Enrich, bit: int) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        when = (F.col("context").bitwiseAND(F.lit(bit)) != 0) & holds(text, rule.mention)
        parts = [F.lit(rule.text), text] if rule.side == "prepend" else [text, F.lit(rule.text)]
        return F.when(when, F.concat_ws(" ", *parts)).otherwise(text)

    return apply


Extractor = Callable[[DataFrame], DataFrame]


def mentions(
    df: DataFrame, key: str, text: str, rules, extractor: Extractor | None = None, scored: bool = False,
    terms: Sequence[str] | None = None,
) -> DataFrame:
    """(key, sent_no, segment_no, ent_no, text, affirmed, stage, stage_scale) of every mention.

    ``extractor`` replaces the lexicon: it gets the sentence rows and returns them with ``segment_no``,
    ``ent_no``, ``text`` and ``negated`` (for example through mapInPandas with a model of the user's own).
    ``terms`` replaces only the vocabulary by learned phrases; scopes stay as they are. ``scored`` adds a column ``score`` and one row, with null text, for each sentence that names a score.
    """
    colon = hasattr(rules, "SCORE_WORDS")
    found = sentences(df, key, text, rules)
    if extractor is None:
        wanted = F.col("sentence").rlike(mention_pattern(rules)) if terms is None else F.col("sentence").isNotNull()
        if scored:
            found = found.withColumn("score", sentence_score(F.col("sentence"), rules))
            wanted = wanted | F.col("score").isNotNull()
        found = found.filter(wanted)
    if hasattr(rules, "STAGE_REWRITES"):
        found = parse_stages(found, rules)
    found = with_context(found, rules)
    if extractor is None:
        found = found.drop(*getattr(rules, "REPORT_PROXIMITY", {}))
        found = spans(found, rules, colon, "score" if scored else None, terms)
    else:
        found = extractor(found)
    # One row in, one row out: the explode keeps later filters from being written in terms of the whole chain.
    found = flip_leading(found).select(
        *[c for c in found.columns if c != "text"], F.explode(F.array(enriched(F.col("text"), rules))).alias("text")
    )
    place = [key, "sent_no", "segment_no", "ent_no"]
    more = ["score"] if scored and extractor is None else []
    if not hasattr(rules, "STAGE_REWRITES"):
        out = found.select(
            *place, collapse_whitespace(F.col("text")).alias("text"), (~F.col("negated")).alias("affirmed"),
            F.lit(None).cast("double").alias("stage"), F.lit(None).cast("int").alias("stage_scale"), *more,
        )
        if scored and extractor is not None:
            out = out.unionByName(scores(df, key, text, rules), allowMissingColumns=True)
        return out
    staged = reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in rules.STAGED])
    staged = staged & F.col("stage_seen").isNotNull()
    named = F.when(staged & F.col("_ishak"), F.concat("text", F.lit(" ishak"))).otherwise(F.col("text"))
    return found.select(
        *place,
        collapse_whitespace(named).alias("text"),
        F.when(staged, F.col("stage_seen") != 0).otherwise(~F.col("negated")).alias("affirmed"),
        F.when(staged, F.col("stage")).alias("stage"),
        F.when(staged, F.col("stage_scale")).alias("stage_scale"),
    )


def sentence_score(sentence: Column, rules) -> Column:
    """Greatest score named in a sentence that mentions the first score word, or null."""
    line = rewrite(sentence, rules.SCORE_RANGES)
    number = r".*?(\d+(?:,\d+)*(?:\.\d+)?)"
    found = F.concat(*[F.regexp_extract_all(line, F.lit(w + number), F.lit(1)) for w in rules.SCORE_WORDS])
    values = F.filter(F.transform(found, lambda s: s.try_cast("double")), lambda v: (v >= 0) & (v <= rules.SCORE_LIMIT))
    return F.when(sentence.contains(rules.SCORE_WORDS[0]), F.array_max(values))


def scores(df: DataFrame, key: str, text: str, rules) -> DataFrame:
    """(key, score): greatest score of each report that has one, not capped."""
    rows = sentences(df, key, text, rules).filter(F.col("sentence").contains(rules.SCORE_WORDS[0]))
    rows = rows.select(key, sentence_score(F.col("sentence"), rules).alias("_score"))
    return rows.filter(F.col("_score").isNotNull()).groupBy(key).agg(F.max("_score").alias("score"))
