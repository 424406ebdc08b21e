"""SQL spellings (DuckDB dialect) of the Column functions, for the oracle
queries. Each helper mirrors one function in ``versewise.functions``."""

from __future__ import annotations

from versewise.functions.text import WS_CLASS
from versewise.schema import EMOTION_RULES, THEMES, VIBE_ANCHORS

WS = f"[{WS_CLASS}]"
STRIP_RE = rf"\A{WS}+|{WS}+\z"
MARK_RE = r"\[.*?\]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_RE)}, '', 'g')"


def clean(x: str) -> str:
    marks = f"regexp_replace({x}, {q(MARK_RE)}, ' ', 'g')"
    return strip(f"regexp_replace({marks}, {q(WS + '+')}, ' ', 'g')")


TOKEN_RE = r"([a-z']+)"
WORD_RUN_RE = r"[\p{L}\p{N}_]+"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(TOKEN_RE)}, 1)"


def word_runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(WORD_RUN_RE)}, 0)"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def count_in(toks: str, words) -> str:
    return f"len(list_filter({toks}, lambda w: w IN {in_list(words)}))"


def usable(x: str) -> str:
    s = strip(x)
    return (f"(coalesce(length({s}), 0) >= 40 AND NOT coalesce(lower({s}) IN "
            f"('instrumental', '[instrumental]', '(instrumental)'), false))")


def missing(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(f'CAST({x} AS VARCHAR)')}) IN ('', 'nan'))"


def norm_key(x: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^a-z0-9]', '', 'g')"


def merge_key(a: str, t: str) -> str:
    return f"({norm_key(a)} || '|' || {norm_key(t)})"


def nearest_vibe(v: str, e: str) -> str:
    """Argmin over the anchors, first wins ties, as a CASE chain of strict
    comparisons against all later and earlier anchors."""
    d = [f"(({v}) - {av}::DOUBLE) * (({v}) - {av}::DOUBLE) + (({e}) - {ae}::DOUBLE) * (({e}) - {ae}::DOUBLE)"
         for _, av, ae in VIBE_ANCHORS]
    parts = []
    for i, (name, _, _) in enumerate(VIBE_ANCHORS):
        conds = [f"{d[i]} <= {d[j]}" for j in range(i + 1, len(d))] + \
                [f"{d[i]} < {d[j]}" for j in range(i)]
        parts.append(f"WHEN {' AND '.join(conds) if conds else 'true'} THEN {q(name)}")
    bad = f"({v}) IS NULL OR ({e}) IS NULL OR isnan(({v})::DOUBLE) OR isnan(({e})::DOUBLE)"
    return f"(CASE WHEN {bad} THEN NULL {' '.join(parts)} END)"


def theme_cols(toks: str) -> str:
    tot = f"greatest(len({toks}), 1)"
    return ", ".join(f"{count_in(toks, words)} / {tot} AS kw_{name}" for name, words in THEMES)


def emotion_cols(runs: str) -> str:
    parts, exprs = [], []
    for label, words in EMOTION_RULES:
        e = f"least({count_in(runs, words)} / 10.0, 1.0)"
        exprs.append(e)
        parts.append(f"{e} AS emo_{label}")
    total = exprs[0]
    for e in exprs[1:]:
        total = f"({total} + {e})"
    parts.append(f"greatest(0.0, 1.0 - {total}) AS emo_neutral")
    return ", ".join(parts)


def bucket(x: str, names) -> str:
    return (f"(CASE WHEN {x} < 0.35 THEN {q(names[0])} WHEN {x} < 0.65 THEN {q(names[1])} "
            f"WHEN {x} IS NOT NULL THEN {q(names[2])} END)")


def clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x})::DOUBLE, 0.0), 1.0) END)"
