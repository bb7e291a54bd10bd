"""Rewrites, negation scopes, learned terms and one pass over reports, against plain versions."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from medloom.functions.rewriting import Rewriter, rewritten
from medloom.functions.text import _plain_parts, ascii_bounds, rewrite
from medloom.operators import findings, mentions, terms
from medloom.rules import colon, liver, negation


def plain_rewrite(text, rules):
    for old, new in rules:
        text = text.replace(old, new)
    return text


def test_rewriter_is_the_whole_list():
    rnd = random.Random(3)
    some = lambda letters, low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    for _ in range(1500):
        rules = [(some("ab ", 1, 4), some("ab c", 0, 4)) for _ in range(rnd.randint(0, 12))]
        rewriter = Rewriter(rules)
        for _ in range(5):
            text = some("ab c", 0, 30)
            assert rewriter(text) == plain_rewrite(text, rules)
    for rules in (liver.SENTENCE_REWRITES, colon.SENTENCE_REWRITES, liver.STAGE_REWRITES):
        rewriter, parts = Rewriter(rules), [x for rule in rules for x in rule] + [" ", "-", "é", "mild "]
        for _ in range(2000):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
            assert rewriter(text) == plain_rewrite(text, rules)


def test_bounds_count_ascii_letters(spark):
    rows = spark.createDataFrame([("é no",), ("éno",), ("no é",), ("noé",), ("xno",), ("no",)], "t string")
    got = rows.select(F.col("t").rlike(ascii_bounds(r"\bno\b")).alias("hit")).collect()
    assert [r.hit for r in got] == [bool(re.search(r"\bno\b", t, re.ASCII)) for t in ("é no", "éno", "no é", "noé", "xno", "no")]
    assert _plain_parts(r"vascul\w*") == ["vascul"] and _plain_parts("(?:ulcer|ulcers)") == ["ulcer", "ulcers"]
    assert _plain_parts(r"[ab]c") is None


def plain_spans(segment, rules, is_colon):
    """Mentions of a segment and whether a trigger stands before or after them, by the texts around each."""
    modifiers, heads = "|".join(rules.MODIFIERS), "|".join(rules.HEADS)
    mention = rf"(?:\b(?:no |non-|non ))?(?:\b(?:{modifiers})[\w&-]*[ ]+){{0,4}}\b[\w&'-]*(?:{heads})[\w&'-]*"
    words = lambda *lists: r"\b(?:" + "|".join(t for part in lists for t in part) + r")\b"
    more = is_colon * 1
    pseudo = words(negation.PSEUDO, negation.PSEUDO_ADDED, negation.PSEUDO_COLON * more)
    before = words(negation.PRECEDING, negation.PRECEDING_ADDED, negation.PRECEDING_COLON * more)
    after = words(negation.FOLLOWING, negation.FOLLOWING_ADDED, negation.FOLLOWING_COLON * more)
    has = lambda text, pattern: bool(re.search(pattern, re.sub(pseudo, " ", text, flags=re.A), re.A))
    return [(m.group(), has(segment[: m.start()], before) or has(segment[m.end() :], after)) for m in re.finditer(mention, segment, re.A)]


@pytest.mark.parametrize("rules, is_colon", [(liver, False), (colon, True)])
def test_scopes_against_the_texts_around_each_mention(spark, rules, is_colon):
    rnd = random.Random(5)
    pool = [
        *negation.PRECEDING, *negation.FOLLOWING, *negation.FOLLOWING_ADDED, *negation.PSEUDO, *negation.PSEUDO_ADDED,
        "with absent", "history", "no longer present", "é", "no", "non-", "mild", "portal", "seen", "a,", "absent", "was"]
    heads = ["fibrosis", "inflammation", "mild inflammation", "no ulcer", "absent vascular", "colitis", "bridging fibrosis"]
    lines = [" ".join(rnd.choice(heads if rnd.random() < 0.35 else pool) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    cut = re.compile("(" + mentions.trigger_patterns(is_colon)["termination"].replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b") + ")", re.A)
    lines = [line for line in lines if not cut.search(line)]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, sentence string")
    got: dict[int, list] = {}
    for r in mentions.spans(df, rules, is_colon).orderBy("k", "ent_no").collect():
        got.setdefault(r.k, []).append((r.text, r.negated))
    want = {k: found for k, line in enumerate(lines) if (found := plain_spans(line, rules, is_colon))}
    assert got == want and len(lines) > 700


def test_scope_takes_time_in_proportion(spark):
    def took(n):
        rows = spark.createDataFrame([("mild inflammation and portal fibrosis without necrosis, " * (n // 3),)], "Report_Text string")
        df = rows.withColumn("report_id", F.lit(1))
        start = time.perf_counter()
        assert mentions.mentions(df, "report_id", "Report_Text", liver).count() == n // 3 * 3
        return time.perf_counter() - start

    took(300)
    small, large = min(took(3000) for _ in range(2)), min(took(6000) for _ in range(2))
    assert large < 2.5 * small + 0.5


def test_scores_and_mentions_from_one_scan(spark, tmp_path):
    texts = ["Mayo 2 colitis. Mayo 1-2 noted", "mild inflammation", "mayo 3. nothing", "no ulcer", None, ""]
    rows = [(i, "MGH", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "report_id int, MRN_Type string, Report_Text string").write.parquet(str(tmp_path / "r"))
    found = findings.add_colon_findings(spark.read.parquet(str(tmp_path / "r")), update=False).select("report_id", "colitis", "mayo_score", "disease_list")
    grouped = findings.colon_findings(mentions.mentions(spark.read.parquet(str(tmp_path / "r")), "report_id", "Report_Text", colon, scored=True), "report_id")
    assert grouped._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.report_id: r for r in found.collect()}
    assert got[0].mayo_score == 2.0 and got[0].disease_list[-1] == "colitis mayo-2.0" and got[0].colitis
    assert got[2].mayo_score == 3.0 and got[2].colitis and got[2].disease_list == ["colitis mayo-3.0"]
    assert got[1].mayo_score is None and got[3].colitis is None and got[4].disease_list is None


def plain_c_values(lines, longest, least):
    counts = Counter()
    for line in lines:
        for part in re.split(terms.PART, line):
            words = [w for w in part.split(" ") if w]
            counts.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    counts = {p: n for p, n in counts.items() if n >= least}
    out = {}
    for p, n in counts.items():
        holders = [m for q, m in counts.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        out[" ".join(p)] = (n, len(holders), sum(holders), log2(len(p) + 1) * (n - (sum(holders) / len(holders) if holders else 0)))
    return out


def test_learned_terms(spark):
    rnd = random.Random(8)
    phrases = ["mild portal fibrosis", "portal fibrosis", "bile duct injury", "chronic active hepatitis", "x y"]
    lines = [rnd.choice([", ", " "]).join(rnd.choice(phrases) for _ in range(rnd.randint(1, 5))) for _ in range(200)] + ["", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, None])], "k int, sentence string").repartition(3)
    values = terms.c_values(df, longest=4, least=6)
    want = plain_c_values(lines, 4, 6)
    got = {r.phrase: (r.n, r.longer, r.within, r.c_value) for r in values.collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    learned = terms.lexicon(values, liver.HEADS, 50, 1.0)
    assert "mild portal fibrosis" in learned and "bile duct injury" not in learned
    assert terms.c_values(df.limit(0)).count() == 0 and terms.lexicon(values, top=0) == []


def plain_terms(text, lexicon):
    found, at = [], 0
    word = lambda c: c.isalnum() or c in "_&'-"
    while at < len(text):
        here = [t for t in lexicon if text.startswith(t, at) and (at == 0 or not word(text[at - 1]))
                and (at + len(t) == len(text) or not word(text[at + len(t)]))]
        if here:
            found.append((at, at + len(max(here, key=len))))
            at = found[-1][1]
        else:
            at += 1
    return found


def test_terms_are_marked_leftmost_longest():
    rnd = random.Random(9)
    for _ in range(500):
        lexicon = list({" ".join(rnd.choice(["a", "b", "ab", "é"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 6))})
        marker = terms.Marker(lexicon, "<", ">")
        text = "".join(rnd.choice(["a", "b", " ", "é", "-", ","]) for _ in range(rnd.randint(0, 30)))
        assert marker.spans(text) == plain_terms(text, lexicon)
        assert marker(text).replace("<", "").replace(">", "") == text


def test_mentions_of_learned_terms_find_the_vocabulary(spark):
    """Recall against the fixed vocabulary on texts in which its phrases are frequent."""
    rnd = random.Random(10)
    phrases = ["mild portal inflammation", "bridging fibrosis", "mild steatosis", "focal necrosis", "viral hepatitis"]
    texts = ["; ".join(rnd.choice(["no ", "", ""]) + rnd.choice(phrases) + rnd.choice([" is seen", " was noted", " in the core"]) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "report_id int, Report_Text string")
    rows = mentions.sentences(df, "report_id", "Report_Text", liver)
    learned = terms.lexicon(terms.c_values(rows, least=4), liver.HEADS, 200, 1.0)
    by_terms = mentions.mentions(df, "report_id", "Report_Text", liver, terms=learned).collect()
    by_words = mentions.mentions(df, "report_id", "Report_Text", liver).collect()
    held = Counter((r.report_id, r.segment_no) for r in by_terms)
    hit = sum(held[(r.report_id, r.segment_no)] > 0 for r in by_words)
    assert hit >= 0.8 * len(by_words) and {r.affirmed for r in by_terms} == {True, False}


def test_phrases_are_counted_as_by_hand(spark):
    """Counted in two scans, the first by hash: words end at plain spaces, parts at breaks, and case is kept."""
    rows = ["a b  a b, A b", None, "", "x\ty a b;a b", "ü a b (ü a) b!", " , "] * 3
    counts = Counter()
    for part in (p for r in rows if r for p in re.split(r"[,;:()!?]+", r)):
        w = [x for x in part.split(" ") if x]
        counts.update((" ".join(w[i : i + k]), k) for k in range(1, 4) for i in range(len(w) - k + 1))
    df = spark.createDataFrame([(r,) for r in rows], "sentence string").repartition(3)
    for least in (1, 4, 7):
        got = terms._phrase_counts(df, "sentence", 3, least).collect()
        assert sorted(map(tuple, got)) == sorted((p, k, n) for (p, k), n in counts.items() if n >= least)


def test_rewritten_is_the_chain_of_replacements(spark):
    rules = [("a ", "b ä "), ("", "z"), ("ä", "."), ("b . b", ""), ("\n", "日")]
    rows = [None, "", "a a a \n", "ä" * 5, "x" * 50, "日 a\na "]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(rewritten(df.t, rules).alias("a"), rewrite(df.t, rules).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] is None


def test_letters_are_tried_by_halves():
    """The pattern matches what the plain list of alternatives does and tries no list of terms beyond one letter's."""
    words = [w for w in liver.HEADS if re.fullmatch(r"[\w &-]+", w)]
    plain, halved = re.compile("|".join(words)), re.compile(mentions._any(words))
    line = " ".join(words[::-1]) + " fibrosi steato x inflammationinflammation"
    assert [m.span() for m in halved.finditer(line)] == [m.span() for m in plain.finditer(line)]
    assert mentions._any(words).count("(?=") >= 2 * len({w[0] for w in words}) - 1
