r"""Quality rules (5) [native]: every rule is evaluated once into a ledger of
measurements and failure bits; versioned policies are bit masks over it, and
ablations are bitwise sums. DataFrame functions only.

Words are ``[^\x20\x09-\x0D]+``; a line holds a word to count. Repeated words
are those in 5-word windows that the text holds twice or more; windows are
compared by a 64-bit hash.

Nulls, empty texts, repeats: a null or empty text has no words, fails
``too_short`` and isn't kept; null ids and repeated rows give a row each; very
long texts are measured whole; limits are met or not, so there are no ties; extra
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import WORD, let, pick

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Rules in order of their bit: name and failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > 0.2 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND n_dup_lines > 0.3 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("no_lower_case", "n_words > 0 AND NOT has_lower"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_windows"]
#: Versioned policies: the rules that reject a document.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"], 3: sum(BIT.values())}
POLICY = 3


def repeat_words(words: Column) -> Column:
    """Number of words in windows that occur more than once."""
    n = F.size(words)

    def covered(h: Column) -> Column:
        # positions of the repeated windows from neighbours in the order of hashes
        def cover(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, b: a + b))
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, cover))

    starts = F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of all rules."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = (pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
         .select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"), lines.alias("lines"),
                 F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 text.rlike(r"\p{Ll}").alias("has_lower")))
    m = d.select("doc_id", F.size("words").cast("long").alias("n_words"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 repeat_words(F.col("words")).alias("n_repeat_words"), "has_lower")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("fail_bits", total.cast("long"))


def judge(rows: DataFrame, policy: int = POLICY) -> DataFrame:
    """``base_failed`` and ``kept`` under a policy, from the ledger alone."""
    fails = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(POLICIES[policy]))


def ablation(rows: DataFrame, policy: int = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it
    rejects, which dropping the rule would keep. Documents are first counted
    by their failure bits: at most 2^rules groups."""
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    each = counts.select("bits", "count", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"))


LEDGER_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, generate_subscripts(words, 1) AS i, words FROM w WHERE len(words) > 5),
h AS (SELECT doc_id, i, words[i:i + 4] AS win FROM g WHERE i + 4 <= len(words)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM h),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM r WHERE n > 1),
q AS (SELECT doc_id, sum(c) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, regexp_matches(text, '\p{Ll}') AS has_lower
      FROM w LEFT JOIN q USING (doc_id)),
l AS (SELECT *, (""" + " | ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES) + r""")::BIGINT AS fail_bits FROM m)
"""
RULES_SQL = f"""WITH {LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {BASE} <> 0 AS base_failed,
       fail_bits & {POLICIES[POLICY]} = 0 AS kept, fail_bits FROM l"""
ABLATION_SQL = f"""WITH {LEDGER_SQL},
u AS (SELECT unnest([{", ".join(f"{{'rule': '{n}', 'bit': {b}}}" for n, b in BIT.items() if b & POLICIES[POLICY])}], recursive := true))
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed,
       count(*) FILTER (WHERE fail_bits & {POLICIES[POLICY]} = bit) AS n_only FROM l, u GROUP BY rule"""
