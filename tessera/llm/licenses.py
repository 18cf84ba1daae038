"""License scans with ordered signature rules (DataFrame functions only).

Texts are brought to lower-case words with one blank between them; a rule is a regex over words with a keyword that
any match must contain, a priority, a confidence and a label.  Rules are written as names of licenses and wordings
around a name, so every license gets one rule for each wording.

1. Gates.  A text without any of the stems in ``STEMS`` meets no rule; other texts meet the rules whose keyword they hold.
2. Matches.  The pieces between the matches and the matches themselves give each match's first and last word.
3. Suppression.  Per document, matches are swept in order of (first word, longest, priority, rule): a match that lies
   inside an earlier one of the same or a higher priority is suppressed.  Running maxima of the last word, one for each
   priority, decide this in one sort, however many matches a document has.

The three base phrases are rules outside of the suppression; all their places count.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ALNUM_SEPARATORS, parallelism, text_or_empty

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keyword of the gate, SPDX identifier in words, name of the license in words.
LICENSES = [
    ("mit", "mit", "mit", "(?:expat |x11 )?mit(?: style| x11)? licen[cs]e"),
    ("mit-0", "mit no", "mit 0", "mit no attribution licen[cs]e"),
    ("isc", "isc", "isc", "isc licen[cs]e"),
    ("apache-2", "apache", "apache 2 0", "apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    ("apache-1.1", "apache", "apache 1 1", "apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache", "apache", "apache", "apache (?:software )?licen[cs]e"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "(?:bsd (?:2|two) clause|(?:simplified|freebsd) bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:bsd (?:4|four) clause|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("0bsd", "bsd", "0bsd", "(?:zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("gpl-1", "general public", "gpl 1 0", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v )1(?: 0)?"),
    ("gpl-2", "general public", "gpl 2 0", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v )2(?: 0)?"),
    ("gpl-3", "general public", "gpl 3 0", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:version |v )3(?: 0)?"),
    ("gpl", "general public", "gpl", "(?:gnu )?general public licen[cs]e"),
    ("gpl-2", "gpl", "gpl 2 0 only", "(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?"),
    ("gpl-3", "gpl", "gpl 3 0 only", "(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?"),
    ("lgpl-2", "general public", "lgpl 2 0", "(?:gnu )?(?:lesser|library) general public licen[cs]e (?:version |v )2(?: 0)?"),
    ("lgpl-2.1", "lesser", "lgpl 2 1", "(?:gnu )?lesser general public licen[cs]e (?:version |v )2 1"),
    ("lgpl-3", "lesser", "lgpl 3 0", "(?:gnu )?lesser general public licen[cs]e (?:version |v )3(?: 0)?"),
    ("lgpl", "lesser", "lgpl", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "lgpl", "lgpl 2 1 only", "(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("agpl-3", "affero", "agpl 3 0", "(?:gnu )?affero general public licen[cs]e (?:version |v )3(?: 0)?"),
    ("agpl", "affero", "agpl", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3", "agpl", "agpl 3 0 only", "(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?"),
    ("gfdl", "free documentation", "gfdl 1 3", "(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", "mpl 1 1", "mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2", "mozilla", "mpl 2 0", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", "mpl", "mozilla public licen[cs]e"),
    ("epl-1", "eclipse", "epl 1 0", "eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("epl-2", "eclipse", "epl 2 0", "eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("cddl-1", "common development", "cddl 1 0", "common development and distribution licen[cs]e"),
    ("eupl-1.2", "european union", "eupl 1 2", "european union public licen[cs]e"),
    ("artistic-2", "artistic", "artistic 2 0", "artistic licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("bsl-1", "boost", "bsl 1 0", "boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    ("psf-2", "python software", "psf 2 0", "python software foundation licen[cs]e"),
    ("ofl-1.1", "open font", "ofl 1 1", "(?:sil )?open font licen[cs]e"),
    ("odbl-1", "open database", "odbl 1 0", "open database licen[cs]e"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl(?: licen[cs]e)?"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense"),
    ("cc0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", " cc by", "cc by 4 0", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", " cc by sa", "cc by sa 4 0", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by nd", "cc by nd 4 0", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", " cc by nc", "cc by nc 4 0", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " cc by nc sa", "cc by nc sa 4 0", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", " cc by nc nd", "cc by nc nd 4 0", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "cc by 3 0", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative commons", "cc by sa 3 0", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative commons", "cc by nc 3 0", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    ("public-domain", "public domain", "public domain", "(?:in(?:to)? the )?public domain"),
    ("all-rights-reserved", "all rights", "proprietary", "all rights (?:are )?reserved"),
]

# Wording (NAME and SPDX stand for the license), priority, confidence, ending of the label (None: no label).
WORDINGS = [
    ("(?:not|never|no longer) (?:licensed |released |distributed |available )?under (?:the )?NAME", 5, 0.0, None),
    ("spdx license identifier SPDX", 4, 1.0, ""),
    ("NAME (?:only )?or (?:at your option )?(?:any )?later(?: version)?", 4, 1.0, "-or-later"),
    ("(?:licensed|released|distributed|published|provided|available|covered)(?: only)? (?:under|by)(?: the)?(?: terms(?: and "
     "conditions)? of)?(?: the| a)? NAME", 3, 0.95, ""),
    ("(?:subject to|governed by|in accordance with|pursuant to)(?: the)?(?: terms of)?(?: the)? NAME", 3, 0.9, ""),
    ("NAME", 2, 0.7, ""),
    ("(?:see|read|copy of|refer to)(?: the)? NAME(?: for (?:more )?details)?", 1, 0.5, ""),
]

# Every match of every rule holds one of these.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEMS = ["licen", " cc ", " cc0", "commons", "gpl", "public domain", "rights ", "bsd", "wtfpl"]
BASE_CONFIDENCE = 0.9
TOP = 5


def build_rules() -> list[dict]:
    """All rules in order: the base phrases (priority 0), then every wording of every license."""
    rules = [{"keyword": f" {p} ", "regex": p, "label": label, "priority": 0, "confidence": BASE_CONFIDENCE} for p, label in BASE.items()]
    for wording, priority, confidence, ending in WORDINGS:
        for label, keyword, spdx, name in LICENSES:
            holds = "spdx" if "SPDX" in wording else keyword
            rules.append({"keyword": holds, "regex": wording.replace("NAME", f"(?:{name})").replace("SPDX", f"(?:{spdx})"),
                          "label": None if ending is None else label + ending, "priority": priority, "confidence": confidence})
    return [{**r, "rule": k, "regex": f"(?<![^ ])(?:{r['regex']})(?![^ ])"} for k, r in enumerate(rules)]


RULE_TYPE = "array<struct<rule:int,keyword:string,regex:string,label:string,priority:int,confidence:double>>"


def _blanks(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, counted from 0.  ``n_base`` counts the places of
    base phrases, first_word and last_word are their smallest and largest start (null without any).  ``labels`` joins the
    base labels and those of the matches left after suppression; ``score`` is the largest confidence among them, 0 without
    any.  ``detections`` has the matches left (first_word, n_words, label, confidence) in order.  Null or empty texts have
    no words and no labels; rows that repeat an id are scanned each for itself.
    """
    table = F.from_json(F.lit(json.dumps(rules or build_rules())), RULE_TYPE)
    text = text_or_empty(text_col)
    # A-Z only: of all other characters, these two become ASCII letters in lower case
    lowered = F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    words = F.trim(F.regexp_replace(lowered, ALNUM_SEPARATORS, " "))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    gate = " or ".join(f"contains(norm, '{s}')" for s in STEMS)
    met = rows.withColumn("rules", table).select(
        "row", "id", F.expr(f"if(norm = '  ', 0, {_blanks('norm')} - 1)").cast("bigint").alias("n_words"),
        F.posexplode_outer(F.expr(f"""
            if({gate}, flatten(transform(filter(rules, r -> contains(norm, r.keyword)), r -> filter(
                zip_with(regexp_extract_all(norm, r.regex, 0), split(norm, r.regex), (m, s) -> struct(
                    r.rule as rule, r.label as label, r.priority as priority, r.confidence as confidence,
                    {_blanks('s')} as before, {_blanks('m')} as inside)), x -> x.inside is not null))), null)""")).alias("nth", "m"))
    met = met.select("row", "id", "n_words", "nth", "m.*").repartition(parallelism(docs.sparkSession), "row")
    # blanks before a match: those of all pieces and matches of its rule up to it; the text starts with one
    up_to = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.col("before") + F.col("inside")).over(up_to) - F.col("inside") - 1
    placed = met.withColumn("first", first.cast("bigint")).withColumn("last", F.col("first") + F.col("inside"))
    order = [F.col("first"), F.col("last").desc(), F.col("priority").desc(), F.col("rule")]
    earlier = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("last"))).over(earlier) for p in range(1, TOP + 1)}
    inside = F.lit(False)
    for p, furthest in reach.items():
        inside = F.when(F.col("priority") == p, F.coalesce(furthest >= F.col("last"), F.lit(False))).otherwise(inside)
    left = placed.withColumn("base", F.col("priority") == 0).withColumn("kept", F.col("rule").isNotNull() & ~inside)
    shown = F.when(F.col("kept") & F.col("label").isNotNull(), F.col("label"))
    out = left.groupBy("row").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(shown)), ",").alias("labels"),
        F.coalesce(F.max(F.when(shown.isNotNull(), F.col("confidence"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(shown.isNotNull() & ~F.col("base"), F.struct(
            F.col("first").alias("first_word"), (F.col("inside") + 1).cast("bigint").alias("n_words"), "label", "confidence")))).alias("detections"))
    return out.drop("row")
