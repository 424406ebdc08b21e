"""Text functions as Spark Column expressions (JVM side, whole-stage codegen).

Every function takes and returns ``Column``; none runs Python per row.
Regular expressions are written so that the Java engine and RE2 (used by
the SQL oracle) read them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versewise.schema import (EMOTION_HIT_SCALE, EMOTION_RULES, INSTRUMENTAL_MARKERS,
                              MIN_LYRICS_LEN, MISSING_TOKENS, RATE_LIMIT_PHRASE, THEMES)

# Unicode white space as Python's str.isspace() sees it; Java's and RE2's
# ``\s`` are ASCII-only, so the class is spelled out.
WS_CLASS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
STRIP_RE = rf"\A{WS}+|{WS}+\z"
# The same set as characters: ASCII white space and the rest (which
# ``translate`` maps to spaces before a fast ASCII ``\s`` pass).
ASCII_WS = "\t\n\x0b\x0c\r "
EXOTIC_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")
WS_CHARS = ASCII_WS + EXOTIC_WS
# ``(?d)``: only \n ends a line for ``.``, as in Python and RE2.
SECTION_MARK_RE = r"(?d)\[.*?\]"
TOKEN_RE = r"([a-z']+)"
WORD_RUN_RE = r"[\p{L}\p{N}_]+"
NON_KEY_RE = r"[^a-z0-9]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim Unicode white space at both ends (Python ``str.strip()``); a
    native ``btrim`` over the explicit character set, no regex."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def is_missing(c) -> Column:
    """F8 predicate: NULL, NaN, blank or the text "nan" (any case)."""
    c = _col(c)
    return c.isNull() | F.lower(strip(c.cast("string"))).isin(*MISSING_TOKENS)


def nullify_missing(c, tokens: list[str] | None = None) -> Column:
    """F8: map the missing spellings of a string column to NULL."""
    c = _col(c)
    toks = MISSING_TOKENS if tokens is None else tokens
    return F.when(c.isNull() | F.lower(strip(c)).isin(*toks), F.lit(None).cast("string")).otherwise(c)


def clean_lyrics(c) -> Column:
    """Drop ``[section]`` marks, collapse white space, trim.

    Same result as one pass with the Unicode white-space class, but faster:
    non-ASCII white space is first mapped to spaces with ``translate`` (it is
    matched by ``.`` in the mark pattern either way), runs of ASCII white
    space are then collapsed with ``\\s+``, and the single spaces left at
    the ends are trimmed."""
    ascii_ws = F.translate(_col(c), EXOTIC_WS, " " * len(EXOTIC_WS))
    no_marks = F.regexp_replace(ascii_ws, SECTION_MARK_RE, " ")
    return F.trim(F.regexp_replace(no_marks, r"\s+", " "))


def tokens(c) -> Column:
    """Lower-case ``[a-z']+`` tokens."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_RE), 1)


def word_runs(c) -> Column:
    """Maximal runs of Unicode word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_RUN_RE), 0)


TOKEN_CLASS = "[a-z']"
WORD_CLASS = r"[\p{L}\p{N}_]"


def word_pattern(words, cls: str) -> str:
    """Whole-word alternation: a match is a maximal run of ``cls`` characters
    equal to one of the words, so counting matches equals counting tokens
    in the word set (duplicates counted)."""
    import re as _re
    alts = "|".join(_re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return f"(?<!{cls})(?:{alts})(?!{cls})"


def words_pattern(words) -> str:
    """A regex for any of the words that shares their beginnings, so that a
    text position costs a step a letter and not one a word."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        # the longer word first; the boundary after it decides
        ways = [("" if ch.isalnum() else "\\") + ch + pattern(sub) for ch, sub in sorted(node.items()) if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else "|".join(ways)
        return f"(?:{body})?" if "" in node else f"(?:{body})" if len(ways) > 1 else body

    return pattern(tree)


def first_letters(words) -> str:
    """A look-ahead for the words' first letters: most places of a text are
    passed by one look, before the look-behind and the words are tried."""
    return "(?=[" + "".join(sorted({("" if w[0].isalnum() else "\\") + w[0] for w in words})) + "])"


def lexicon_hits(lower_text: Column, groups, cls: str = TOKEN_CLASS) -> Column:
    """All whole-word occurrences of any word of any group, in one regex scan
    (a short array: only the hits); per-group counts are then taken from it."""
    words = sorted({w for _, ws in groups for w in ws})
    return F.regexp_extract_all(lower_text, F.lit(f"{first_letters(words)}(?<!{cls})(?:{words_pattern(words)})(?!{cls})"), 0)


def token_chars(lower_text: Column) -> Column:
    """Total length of the ``[a-z']+`` tokens (their characters, joined)."""
    return F.length(F.regexp_replace(lower_text, "[^a-z']", ""))


def word_count(toks: Column) -> Column:
    return F.size(toks).cast("double")


def unique_word_ratio(toks: Column) -> Column:
    """Distinct tokens over tokens (0 when there are none)."""
    return F.size(F.array_distinct(toks)) / F.greatest(F.size(toks), F.lit(1))


def avg_word_len(toks: Column, lower_text: Column | None = None) -> Column:
    """Mean token length, 0.0 without tokens. With the lower-cased text
    the total length comes from the joined tokens instead of a lambda."""
    if lower_text is not None:
        total = F.length(F.array_join(toks, ""))
    else:
        total = F.aggregate(toks, F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t))
    return F.when(F.size(toks) > 0, total / F.size(toks)).otherwise(F.lit(0.0))


def char_ratio(c, ch: str) -> Column:
    """Occurrences of one character per character of the text."""
    c = _col(c)
    hits = F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return hits / F.greatest(F.length(c), F.lit(1))


def count_in(toks: Column, words: list[str]) -> Column:
    """Tokens that belong to a word set, duplicates counted."""
    return F.size(F.filter(toks, lambda t: t.isin(*words)))


def theme_scores(toks: Column, themes=THEMES, lower_text: Column | None = None,
                 hits: Column | None = None) -> dict[str, Column]:
    """Share of tokens in each theme lexicon. ``hits`` (a column made by
    ``lexicon_hits``, computed once) or the lower-cased text make the counts
    come from the short hit array; else a filter over the token array."""
    total = F.greatest(F.size(toks), F.lit(1))
    if hits is None and lower_text is not None:
        hits = lexicon_hits(lower_text, themes)
    if hits is not None:
        return {f"kw_{name}": count_in(hits, words) / total for name, words in themes}
    return {f"kw_{name}": count_in(toks, words) / total for name, words in themes}


def emotion_rule_scores(text: Column | None, rules=EMOTION_RULES, lowered: bool = False,
                        hits: Column | None = None) -> dict[str, Column]:
    """min(hits / 10, 1) per label on whole words; neutral takes the rest.
    Pass ``hits`` (``lexicon_hits`` with ``WORD_CLASS``, as a column) to scan
    the text once for all labels."""
    if hits is None:
        low = text if lowered else F.lower(text)
        hits = lexicon_hits(low, rules, WORD_CLASS)
    out: dict[str, Column] = {}
    total = None
    for label, words in rules:
        s = F.least(count_in(hits, words) / F.lit(EMOTION_HIT_SCALE), F.lit(1.0))
        out[f"emo_{label}"] = s
        total = s if total is None else total + s
    out["emo_neutral"] = F.greatest(F.lit(0.0), F.lit(1.0) - total)
    return out


def has_usable_lyrics(c) -> Column:
    """stripped text of at least 40 characters that is not an instrumental marker."""
    s = strip(_col(c))
    return (F.coalesce(F.length(s), F.lit(0)) >= MIN_LYRICS_LEN) & \
        ~F.coalesce(F.lower(s).isin(*INSTRUMENTAL_MARKERS), F.lit(False))


def valid_name(c) -> Column:
    """not NULL, not blank, not "nan"."""
    return ~is_missing(c)


def normalize_key(c) -> Column:
    """``[a-z0-9]`` of the lower-cased text; missing -> ""."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), NON_KEY_RE, "")


def merge_key(artist, title) -> Column:
    """``artist|title`` of normalised parts."""
    return F.concat_ws("|", normalize_key(artist), normalize_key(title))


def track_key(artist, title) -> Column:
    """(trimmed lower artist, trimmed lower title)."""
    return F.struct(F.lower(strip(artist)).alias("artist_key"), F.lower(strip(title)).alias("title_key"))


def strip_scraped_header(text, title) -> Column:
    """X11: drop a leading "<title> Lyrics" line and an "N Contributors" line."""
    t = strip(_col(text))
    ttl = F.lower(_col(title))
    after_title = F.substring(t, F.length(ttl) + 1, 1 << 30)
    header = F.regexp_extract(after_title, rf"(?i)\A{WS}*Lyrics{WS}*\n", 0)
    no_header = F.when(F.startswith(F.lower(t), ttl) & (F.length(header) > 0),
                       F.substring(after_title, F.length(header) + 1, 1 << 30)).otherwise(t)
    no_contrib = F.regexp_replace(no_header, rf"(?i)(?d)\A\d+{WS}*Contributors?.*?\n", "")
    return strip(no_contrib)


def genre_key(c) -> Column:
    """Trim, lower, drop ``genre:``."""
    return F.replace(F.lower(strip(c)), F.lit("genre:"), F.lit(""))


def error_text(old_errors, new_errors: Column, matched: Column) -> Column:
    """New errors win; else a match clears the rate-limit note."""
    old = F.coalesce(_col(old_errors), F.lit(""))
    cleared = F.btrim(F.replace(old, F.lit(RATE_LIMIT_PHRASE), F.lit("")), F.lit(" ;"))
    return (F.when(F.size(new_errors) > 0, F.array_join(new_errors, "; "))
            .when(matched, cleared).otherwise(old))


def safe_file_name(artist, title) -> Column:
    """``artist_title`` with '/' -> '-' and ' ' -> '_'."""
    return F.translate(F.concat_ws("_", _col(artist), _col(title)), "/ ", "-_")


def search_query(title, artist) -> Column:
    """Strict field search text."""
    return F.format_string("track:%s artist:%s", _col(title), _col(artist))


def loose_query(title, artist) -> Column:
    return F.format_string("%s %s", _col(title), _col(artist))


def pipe_list(c) -> Column:
    """A ``|``-joined string as an array without empty parts."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\|"), lambda s: s != "")


def provenance_union(old, new_sources: Column) -> Column:
    """Old list as is, then new sources not already present, ``|``-joined."""
    old_list = pipe_list(old)
    return F.array_join(F.concat(old_list, F.array_except(new_sources, old_list)), "|")
