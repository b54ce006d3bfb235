"""Pieces of the oracle's SQL, made from the same rule tables as the operators."""

from __future__ import annotations

from ..functions import rules as R


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    blank = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)}, 'i')"


def tag(d: str) -> str:
    return f"CASE WHEN {has(d, R.ELECTRONICS)} THEN 'electronics' WHEN {has(d, R.KITSCH)} THEN 'kitsch' WHEN {has(d, R.COLLECTIBLE)} THEN 'collectible' ELSE 'furniture' END"


def score(d: str, c: str) -> str:
    part = lambda t, n: f"CASE WHEN {t} THEN {n} ELSE 0 END"
    s = " + ".join(["1", part(has(d, R.BRAND), 4), part(has(d, R.PERIOD), 2), part(has(d, R.ELECTRONICS), 3), part(has(d, R.KITSCH), 3), part(f"length({d}) > 50", 1)])
    return f"CAST(({s}) * CASE {c} WHEN 'high' THEN 1.3 WHEN 'low' THEN 0.6 ELSE 1.0 END AS DOUBLE)"


def junk(x: str, trimmed: bool = True) -> str:
    t = f"upper({trim(x) if trimmed else x})"
    return "(" + " OR ".join(f"ends_with({t}, {lit(e)})" for e in R.JUNK_ENDINGS) + ")"


def lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r?\n')"


def findings(x: str, limit: int = 1400, trimmed: bool = True) -> str:
    t = trim(x)
    some = f"len(list_filter({lines(f'upper({t})')}, lambda y: {trim('y')} <> '' AND NOT {junk('y', trimmed)})) > 0"
    return f"({t} <> '' AND upper({t}) <> 'NOTHING' AND length({t}) <= {limit} AND NOT {has(t, f'^({R.NO_ANSWER})')} AND {some})"


def confidence(x: str) -> str:
    return rf"nullif(lower(regexp_extract({x}, '(?i)\[(high|medium|low)\]\s*$', 1)), '')"


def top_confidence(x: str) -> str:
    tags = f"list_transform({lines(x)}, lambda y: {confidence('y')})"
    return f"CASE WHEN list_contains({tags}, 'high') THEN 'high' WHEN list_contains({tags}, 'medium') THEN 'medium' WHEN list_contains({tags}, 'low') THEN 'low' END"


def strip_tags(x: str) -> str:
    cut = r"regexp_replace(regexp_replace(y, '\s*\[(high|medium|low)\]\s*$', '', 'i'), '\s+$', '')"
    return trim(f"array_to_string(list_transform({lines(x)}, lambda y: {cut}), chr(10))")


def response_score(x: str) -> str:
    full = f"list_filter({lines(trim(x))}, lambda y: {trim('y')} <> '' AND NOT {junk('y')})"
    points = f"CASE {confidence('y')} WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.15 ELSE 0.5 END"
    return f"CASE WHEN {findings(x)} THEN CAST(coalesce(list_sum(list_transform({full}, lambda y: {points})), 0) AS DOUBLE) ELSE 0.0 END"


def makers(x: str, raw: bool = False) -> str:
    """Makers (or spellings) in the line, longest spelling first; makers may repeat."""
    each = ", ".join(f"CASE WHEN regexp_matches(lower({x}), {lit(f'(^|[^a-z0-9])({R.quoted(a)})([^a-z0-9]|$)')}) THEN {lit(a if raw else m)} END" for a, m in R.aliases())
    return f"list_filter([{each}], lambda y: y IS NOT NULL)"


def category(x: str) -> str:
    whens = " ".join(rf"WHEN regexp_matches(lower({x}), {lit(chr(92) + 'b(' + '|'.join(R.quoted(k) for k in ks) + ')' + chr(92) + 'b')}) THEN {lit(c)}" for c, ks in R.CATEGORIES.items())
    return f"CASE {whens} ELSE 'other' END"


def era(x: str) -> str:
    low = f"lower({x})"
    named = " ".join(f"WHEN regexp_matches({low}, {lit(chr(92) + 'b' + p + chr(92) + 'b')}) THEN {lit(label)}" for p, label in R.ERAS)
    return (
        rf"coalesce(nullif(regexp_extract({low}, '\b((18|19|20)\d0s)\b', 1), ''), nullif(regexp_extract({low}, '(?:^|\s)[''’](\d0s)\b', 1), ''), "
        rf"'circa ' || nullif(regexp_extract({low}, '\bcirca\s+(1[89]\d\d|20\d\d)\b', 1), ''), CASE {named} END)"
    )


def desirability(makers_sql: str, era_sql: str) -> str:
    return f"CASE WHEN len({makers_sql}) > 0 OR coalesce({era_sql} IN ({', '.join(map(lit, R.PREMIUM_ERAS))}), false) THEN 'high' ELSE 'med' END"


def specific(x: str) -> str:
    words = ", ".join(lit(w) for w in sorted({*R.COLOURS, *R.MATERIALS}))
    return rf"(list_has_any(string_split_regex(lower({x}), '\W+'), [{words}]) OR regexp_matches(lower({x}), {lit('|'.join(R.quoted(p) for p in R.PHRASES))}))"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


def synonyms() -> tuple[str, str]:
    """Rows (alias, term) and (alias, category) as VALUES."""
    owner: dict[str, str] = {}
    for name, (_, words) in R.SYNONYMS.items():
        for w in words:
            owner.setdefault(w, name)
    terms = sorted({(w, t) for w, n in owner.items() for t in [R.SYNONYMS[n][0], *R.SYNONYMS[n][1]]})
    cats = sorted({(w, n) for n, (_, words) in R.SYNONYMS.items() for w in words})
    return tuple(", ".join(f"({lit(a)}, {lit(b)})" for a, b in rows) for rows in (terms, cats))
