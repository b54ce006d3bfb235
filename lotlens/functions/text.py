"""Columns over the text of findings and model responses."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

WORD_START, WORD_END = r"(?<!\w)", r"(?!\w)"  # not \b, which takes accented letters for word characters here


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out a single time for a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space, as \s of a pattern has it; and with it the Unicode separators and the byte-order mark.
SPACE = " \t\n\x0b\f\r"
BLANK = SPACE + "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, tabs, line breaks and no-break spaces included."""
    return F.btrim(col(c), F.lit(BLANK))


def lines(c: Column | str) -> Column:
    return F.split(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\n")  # a split at one character needs no pattern


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def matches(c: Column | str, pattern: str) -> Column:
    """Whether a pattern of lower-case text occurs in any case; lowering once is cheaper than a pattern that ignores case."""
    return F.lower(col(c)).rlike(pattern)


#: One place of a pattern with its repeats.
ATOM = re.compile(r"(?:\\.|\[[^\]]*\]|\([^()]*\)|.)[?*+]*", re.DOTALL)


def core(pattern: str) -> str:
    """The longest stretch of plain characters that every match of a pattern without alternatives holds."""
    plain = "".join(a if len(a) == 1 and a not in ".^$" else "\0" for a in ATOM.findall(pattern))
    return max(plain.split("\0"), key=len)


def occurs(low: Column, alternatives: list[str]) -> Column:
    """Whether any of the patterns occurs in a lower-case text.  A plain search is cheaper than a pattern and settles most of them."""
    found = lambda p: F.contains(low, F.lit(core(p)))
    return any_of([found(p) if core(p) == p else found(p) & low.rlike(p) for p in alternatives])


def factored(alternatives: list[str]) -> str:
    """One pattern for many, first come first tried, in which those that begin alike share their beginning."""

    def build(rows: list[list[str]]) -> str:
        if len(rows) == 1:
            return "".join(rows[0])
        if not all(rows):
            return f"(?:{'|'.join(map(''.join, rows))})"
        heads: dict[str, list[list[str]]] = {}
        for first, *rest in rows:
            heads.setdefault(first, []).append(rest)
        shared = [h + build(rest) for h, rest in heads.items()]
        return shared[0] if len(shared) == 1 else f"(?:{'|'.join(shared)})"

    return build([ATOM.findall(p) for p in alternatives])


def finding_tag(description: Column | str) -> Column:
    """electronics, kitsch, collectible or furniture: the first whose pattern occurs."""
    tags = {"electronics": R.ELECTRONICS, "kitsch": R.KITSCH, "collectible": R.COLLECTIBLE}
    named = lambda low: F.coalesce(*(F.when(occurs(low, p.split("|")), tag) for tag, p in tags.items()), F.lit("furniture"))
    return once(F.lower(col(description)), named)


def finding_score(description: Column | str, confidence: Column | str) -> Column:
    """1, more for brand, period, electronics, kitsch and length, times the confidence's multiplier."""
    d, c = col(description), col(confidence)
    part = lambda test, points: F.when(test, points).otherwise(0)
    points = {R.BRAND: 4, R.PERIOD: 2, R.ELECTRONICS: 3, R.KITSCH: 3}
    named = once(F.lower(d), lambda low: reduce(lambda a, b: a + b, (part(occurs(low, p.split("|")), n) for p, n in points.items())))
    score = 1 + named + part(F.length(d) > 50, 1)
    times = F.coalesce(reduce(lambda a, kv: a.when(c == kv[0], kv[1]), R.MULTIPLIER.items(), F.when(c.isNull(), 1.0)), F.lit(1.0))
    return score * times


def is_junk(line: Column | str, trim: bool = True) -> Column:
    """A line that reports a category as empty."""
    return once(F.upper(strip(line) if trim else col(line)), lambda t: any_of([F.endswith(t, F.lit(e)) for e in R.JUNK_ENDINGS]))


def has_findings(response: Column | str, limit: int = 1400, trim_lines: bool = True, strict_nothing: bool = False) -> Column:
    """Whether a response names anything.  ``strict_nothing`` also rejects NOTHING with a full stop or tag after it."""
    return F.coalesce(once(strip(response), lambda t: names_something(t, limit, trim_lines, strict_nothing)), F.lit(False))


def names_something(t: Column, limit: int = 1400, trim_lines: bool = True, strict_nothing: bool = False) -> Column:
    """``has_findings`` of a stripped response, null for none."""
    return answers(t, limit, strict_nothing) & F.exists(lines(t), lambda x: (strip(x) != "") & ~is_junk(x, trim_lines))


def answers(t: Column, limit: int = 1400, strict_nothing: bool = False) -> Column:
    """Whether a stripped response is an answer, whatever its lines say."""
    nothing = F.upper(t).rlike(r"^NOTHING\b[.\s]*(\[\w+\])?$") if strict_nothing else F.upper(t) == "NOTHING"
    # the length comes first: a text that is too long is read no further
    return (F.length(t) <= limit) & (t != "") & ~nothing & ~matches(t, f"^({R.NO_ANSWER.lower()})")


def line_confidence(line: Column | str) -> Column:
    """high, medium, low, or null without a tag at the end."""
    found = F.regexp_extract(col(line), r"(?i)\[(high|medium|low)\]\s*$", 1)
    return F.when(F.contains(col(line), F.lit("[")), F.nullif(F.lower(found), F.lit("")))


def top_confidence(response: Column | str) -> Column:
    """The best tag of a response's lines."""
    best = lambda tags: F.coalesce(*(F.when(F.array_contains(tags, c), c) for c in ("high", "medium", "low")))
    return once(F.transform(lines(response), line_confidence), best)


def strip_tags(response: Column | str) -> Column:
    untagged = lambda x: F.when(F.contains(x, F.lit("[")), F.regexp_replace(x, r"(?i)\s*\[(high|medium|low)\]\s*$", "")).otherwise(x)
    return strip(F.array_join(F.transform(lines(response), lambda x: F.rtrim(untagged(x), F.lit(SPACE))), "\n"))


def response_score(response: Column | str) -> Column:
    """Sum over the lines that are not junk, by their tag; 0 without findings."""

    def by_tag(tag: Column) -> Column:
        return reduce(lambda a, kv: a.when(tag == kv[0], kv[1]), R.LINE_SCORE.items(), F.when(F.lit(False), 0.0)).otherwise(R.UNTAGGED_SCORE)

    def points(x: Column) -> Column:
        return F.when((strip(x) != "") & ~is_junk(x), once(line_confidence(x), by_tag)).otherwise(0.0)

    # an answer without a line that counts sums to 0
    total = lambda t: F.when(answers(t), F.aggregate(lines(t), F.lit(0.0), lambda a, x: a + points(x))).otherwise(0.0)
    return once(strip(response), total)


def keyword_match(description: Column | str, keywords: Column | str) -> Column:
    """Whether any keyword occurs, in any case."""
    d = F.lower(col(description))
    return F.coalesce(F.exists(col(keywords), lambda k: F.contains(d, F.lower(k))), F.lit(False))


def escape_like(term: Column | str) -> Column:
    """A term whose LIKE wildcards are literal."""
    return F.regexp_replace(col(term), r"([\\%_])", r"\\$1")


def keyword_list(text: Column | str) -> Column:
    """A comma-separated list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(col(text), ","), strip), lambda x: x != "")


def clean_response(response: Column | str) -> Column:
    """Without lines that say NOTHING."""
    return strip(F.array_join(F.filter(F.split(col(response), "\n"), lambda x: F.upper(strip(x)) != "NOTHING"), "\n"))


def gate_passes(answer: Column | str) -> Column:
    """Whether the last word, reasoning blocks aside, is anything but SKIP."""
    said = strip(F.regexp_replace(F.coalesce(col(answer), F.lit("")), r"(?is)<think>.*?</think>", ""))
    return F.upper(F.element_at(F.split(said, r"\s+"), -1)) != "SKIP"


def structured_flatten(content: Column | str) -> Column:
    """{items: [{description}]} as lines; NOTHING if empty; other text as it is."""
    schema = "items array<struct<description string>>, _broken string"

    def flat(c: Column, parsed: Column) -> Column:
        items = F.filter(F.transform(parsed["items"], lambda i: strip(F.coalesce(i["description"], F.lit("")))), lambda x: x != "")
        # what is no object, array or string is JSON only as one word; text that cannot be JSON is not parsed to learn so
        is_json = parsed["_broken"].isNull() | F.try_parse_json(c).isNotNull()
        return F.when(~is_json, c).when(F.coalesce(F.size(parsed["items"]), F.lit(0)) <= 0, "NOTHING").otherwise(F.array_join(items, "\n"))

    def one(c: Column) -> Column:
        parsed = F.from_json(c, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        return F.when(c.rlike(r'^(?:[\[{"]|\S+$)'), once(parsed, lambda p: flat(c, p))).otherwise(c)

    return once(strip(content), one)


def verdict(text: Column | str) -> Column:
    """struct(score, top_items, should_attend, reasoning) from prose around a JSON object; null if there is none or the score is not in 1..5."""
    t = col(text)
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    block = F.when((first > 0) & (F.instr(t, "}") > 0) & (last >= first), F.substring(t, first, last - first + 1))

    def made(score: Column, v: Column) -> Column:
        truth = F.coalesce(~F.lower(v["shouldAttend"]).isin("", "false", "0", "null"), F.lit(False))
        items = F.coalesce(v["topItems"], F.array().cast("array<string>"))
        made = F.struct(score.alias("score"), items.alias("top_items"), truth.alias("should_attend"), F.coalesce(v["reasoning"], F.lit("")).alias("reasoning"))
        return F.when((score >= 1) & (score <= 5), made)

    number = lambda v: F.try_to_number(v["score"], F.lit("999999999.999999")).cast("double")
    parsed = F.from_json(block, "score string, topItems array<string>, shouldAttend string, reasoning string")
    return once(parsed, lambda v: once(number(v), lambda score: made(score, v)))


def specific(raw: Column | str) -> Column:
    """Whether an answer names a colour, a material, a period, a brand, a condition or a kind."""
    named = F.array(*(F.lit(w) for w in sorted({*R.COLOURS, *R.MATERIALS})))
    return once(F.lower(col(raw)), lambda low: occurs(low, [R.quoted(p) for p in R.PHRASES]) | F.arrays_overlap(F.split(low, r"\W+"), named))


def clean_title(title: Column | str) -> Column:
    """Without a number in brackets at the start."""
    return strip(F.regexp_replace(col(title), r"^\(\d+\)\s*", ""))


def date_badge(start: Column | str, today: Column) -> Column:
    s = col(start)
    day = F.dayofweek(s)
    return F.when(s == today, "Today").when(s == F.date_add(today, 1), "Tomorrow").when(day == 7, "Sat").when(day == 1, "Sun").otherwise(F.date_format(s, "MMM d"))


def days_left(end: Column | str, today: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(col(end), today))


def distance_text(miles: Column | str) -> Column:
    return F.concat(F.format_string("%.1f", F.round(col(miles), 1)), F.lit(" mi"))


def thumb_url(image_id: Column | str) -> Column:
    """/thumbs/<id>, null without an id."""
    return F.concat(F.lit("/thumbs/"), col(image_id).cast("string"))


def local_date(ts: Column | str, zone: str = "America/New_York") -> Column:
    """The calendar date at a place of an instant in UTC."""
    return F.to_date(F.from_utc_timestamp(col(ts), zone))
