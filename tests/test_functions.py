"""Boundaries of the scalar rules, as tables of input and result."""

import math

import pytest
from pyspark.sql import functions as F

from lotlens.functions import items as I
from lotlens.functions import numbers as N
from lotlens.functions import text as X
from lotlens.operators import search


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_has_findings(spark):
    cases = {
        "": False, "   ": False, "NOTHING": False, "nothing": False, " NOTHING \n": False, "NOTHING. [high]": True, "Stickley sofa [high]": True,
        "The image shows a sofa": False, "I can see a chair": False, "this image has": False, "In this image": False, "The photo is": False,
        "TOYS: 0": False, "TOYS: NONE\nSILVER: none visible": False, "TOYS: NONE\nold clock": True, "TOYS: 0  ": False, "x" * 1400: True, "x" * 1401: False, None: False,
    }
    assert column(spark, list(cases), X.has_findings) == list(cases.values())
    assert column(spark, ["NOTHING. [high]", "NOTHING", "Nothing but a lamp"], lambda c: X.has_findings(c, strict_nothing=True)) == [False, False, True]


def test_confidence_and_tags(spark):
    texts = ["a [high]\nb [low]", "a [LOW] ", "a [medium]\nb", "a", "[high] a"]
    assert column(spark, texts, X.top_confidence) == ["high", "low", "medium", None, None]
    assert column(spark, texts, X.strip_tags) == ["a\nb", "a", "a\nb", "a", "[high] a"]
    assert column(spark, ["a [high]\nb [medium]\nc [low]\nd\nTOYS: NONE", "NOTHING", "TOYS: 0"], X.response_score) == pytest.approx([2.15, 0, 0])


def test_score_and_tag(spark):
    texts = ["Atari 2600 console", "velvet painting", "brass lamp", "sofa", "Stickley antique chair"]
    assert column(spark, texts, X.finding_tag) == ["electronics", "kitsch", "collectible", "furniture", "furniture"]
    assert column(spark, texts, lambda c: X.finding_score(c, F.lit("high"))) == pytest.approx([1.3 * 8, 1.3 * 4, 1.3, 1.3, 1.3 * 7])
    assert column(spark, ["sofa"], lambda c: X.finding_score(c, F.lit(None).cast("string"))) == [1.0]


def test_items(spark):
    lines = ["box spring", "gold ring", "café table", "campy sign", "a camp chair", "four-poster", "Planer, lane furniture", "bakery", "reed & barton spoon", "atari 2600 and atari", "SNES and Sega Genesis"]
    assert column(spark, lines, I.category)[:6] == ["other", "jewelry_watches", "tables", "other", "kitsch", "beds"]
    got = column(spark, lines, lambda c: F.transform(I.makers(c), lambda m: F.concat(m["maker"], F.lit("="), m["raw"])))
    assert got[6:] == [["Lane=lane furniture"], [], ["Reed & Barton=reed & barton"], ["Atari=atari 2600"], ["Sega=sega genesis", "Nintendo=snes"]]
    assert got[0] == []
    eras = {"1950s mid-century sofa": "1950s", "a '50s lamp": "50s", "circa 1920 desk": "circa 1920", "Mid Century": "mid-century", "arts and crafts": "Arts & Crafts", "vintage antique": "antique", "new": None}
    assert column(spark, list(eras), I.era) == list(eras.values())
    df = spark.createDataFrame([("f", " Stickley chair \nTOYS: NONE\n\nantique vase\nlamp", "medium")], "finding_id string, description string, confidence string")
    rows = I.extract_items(df).orderBy("line_no").collect()
    assert [(r.maker, r.category, r.era, r.desirability, r.source, r.id_confidence) for r in rows] == [
        ("Stickley", "seating", None, "high", "lexicon", "med"), (None, "ceramics_glass", "antique", "high", "vlm", "med"), (None, "lighting", None, "med", "vlm", "med"),
    ]


def test_text_helpers(spark):
    assert column(spark, ["50%", "a_b", "c\\d"], X.escape_like) == ["50\\%", "a\\_b", "c\\\\d"]
    assert column(spark, [" a, ,b ,", ""], X.keyword_list) == [["a", "b"], []]
    assert column(spark, ["<think>SKIP\nno</think> PASS", "well, skip", "", None, "maybe"], X.gate_passes) == [True, False, True, True, True]
    assert column(spark, ['{"items":[{"description":" a "},{"description":"b"}]}', '{"items":[]}', " plain ", "{}"], X.structured_flatten) == ["a\nb", "NOTHING", "plain", "NOTHING"]
    said = ['ok {"score": 4, "topItems": ["x"], "shouldAttend": true, "reasoning": "r"} end', '{"score": 6}', "none", '{"score": "2"}', "} {"]
    got = column(spark, said, X.verdict)
    assert got[0].score == 4 and got[0].top_items == ["x"] and got[0].should_attend and got[1] is None and got[2] is None and got[3].score == 2 and got[4] is None
    assert column(spark, ["(12) Big sale", "Sale (2)"], X.clean_title) == ["Big sale", "Sale (2)"]


def test_vectors_and_hashes(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(N.cosine("a", "b")).collect()] == pytest.approx([1, 0, -1, 0, 0, 0])
    h = spark.createDataFrame([(0, -1), (5, 6), (-1, -1)], "a long, b long")
    assert [r[0] for r in h.select(N.hamming("a", "b")).collect()] == [64, 2, 0]
    assert [r[0] for r in h.select(N.hash_hex("b")).collect()] == ["f" * 16, "0" * 15 + "6", "f" * 16]
    assert [r[0] for r in h.select(N.hex_hash(N.hash_hex("b"))).collect()] == [-1, 6, -1]
    grey = spark.createDataFrame([(list(range(72)),), ([9] * 72,), (None,), ([0, 250] * 36,)], "g array<int>")
    assert [r[0] for r in grey.where("g IS NOT NULL").select(N.dhash("g")).collect()][:2] == [-1, 0]
    assert [r[0] for r in grey.select(N.quality_gate("g")).collect()] == [True, False, True, True]
    miles = spark.range(1).select(N.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0]
    assert math.isclose(miles, 3958.8 * math.pi / 2)


def test_rules_by_what_is_expected_of_them(spark):
    """Expectations written out, not drawn from the rule tables that the oracles share with the operators."""
    categories = {
        "leather loveseat": "seating", "oak dresser with drawers": "case_goods", "dining table for eight": "tables", "four-poster bed": "beds", "brass floor lamp": "lighting",
        "ceramic rooster": "kitsch", "velvet painting over an armchair": "kitsch", "mantel clock": "clocks", "oil on canvas of a ship": "art", "pottery vase": "ceramics_glass",
        "sterling flatware": "silver", "gold pocket watch": "jewelry_watches", "reel-to-reel deck": "electronics", "nintendo cartridges": "games_toys", "acoustic guitar": "instruments", "garden hose": "other",
    }
    assert dict(zip(categories, column(spark, list(categories), I.category))) == categories
    eras = {"a radio of the 1960s, vintage": "1960s", "art deco mirror": "Art Deco", "a victorian couch": "Victorian", "antique desk": "antique", "mid-century lamp": "mid-century", "circa 1920 clock": "circa 1920", "plain chair": None}
    assert dict(zip(eras, column(spark, list(eras), I.era))) == eras
    makers = {"oak chair by Stickley": ["Stickley"], "an Atari 2600": ["Atari"], "Reed & Barton spoons": ["Reed & Barton"], "Wedgwood and wedgewood": ["Wedgwood"], "planer from a bakery": []}
    got = column(spark, list(makers), lambda c: F.transform(I.makers(c), lambda m: m["maker"]))
    assert dict(zip(makers, got)) == makers
    high = [F.lit("Victorian"), F.lit("vintage"), F.lit(None).cast("string")]
    assert list(spark.range(1).select(*(I.desirability(F.lit(n), e) for n in (0, 1) for e in high)).first()) == ["high", "med", "med", "high", "high", "high"]


def test_searches_by_what_is_expected_of_them(spark):
    queries = {"couch": ({"sofa", "loveseat", "sectional"}, {"seating"}), "settee": (set(), {"seating"}), "record player": ({"turntable", "stereo"}, {"electronics"}), "zzz": (set(), set()), "  ": (set(), set())}
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id int, query string")
    got = {r.query_id: r for r in search.expand(df, search.synonyms(spark)).collect()}
    for i, (q, (terms, categories)) in enumerate(queries.items()):
        assert set(q.split()) | terms <= set(got[i].expanded) and categories <= set(got[i].categories)
    assert got[3].expanded == ["zzz"] and got[3].categories == [] and got[4].expanded == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([("a", "b")], "t string, c string")
    assert plan_of(df.select(X.structured_flatten("t").alias("v"))).count("from_json") == 1
    found = df.select(F.inline_outer(F.array(X.verdict("t")))).where("score IS NOT NULL")
    assert plan_of(found.select("score", "reasoning", "top_items")).count("from_json") == 1
    assert plan_of(df.select(X.response_score("t").alias("v"))).count("trim(t") == 1
    assert plan_of(df.select(X.has_findings("t").alias("v"))).count("trim(t") == 1
    assert plan_of(df.select(X.specific("t").alias("v"))).count("lower(t") == 1


def test_text_that_only_begins_like_json_stays(spark):
    texts = ["12 chairs", "true story", "12", '{"items": [{"description": " a "}]}', '{"items": {"description": "x"}}', "[1, 2", "nul"]
    assert column(spark, texts, X.structured_flatten) == ["12 chairs", "true story", "NOTHING", "a", "NOTHING", "[1, 2", "nul"]


def test_lines_are_taken_apart_once(spark):
    df = spark.createDataFrame([(1, "TOYS: NONE\r\nlamp \n\nold clock", "high"), (2, None, "low"), (3, " \n", None)], "finding_id int, description string, confidence string")
    out = I.extract_items(df)
    assert plan_of(out).count("split(") == 1
    assert sorted((r.finding_id, r.line_no, r.item_desc) for r in out.collect()) == [(1, 0, "lamp"), (1, 1, "old clock")]


def test_words_that_overlap(spark):
    names = [a for a, _ in I.R.aliases()]
    owner = dict(I.R.aliases())
    assert all(owner[a] == owner[b] for a in names for b in names if b.startswith(a))
    got = column(spark, ["a sega genesis console", "Atari, atari 2600", "snes-nes", "estates b&o", None], I.makers)
    assert [[(m.maker, m.raw) for m in ms] for ms in got] == [[("Sega", "genesis console")], [("Atari", "atari 2600")], [("Nintendo", "snes")], [("Bang & Olufsen", "b&o")], []]
    assert plan_of(spark.createDataFrame([("a",)], "v string").select(I.makers("v").alias("m"))).count("lower(") == 1
    assert column(spark, ["console table", "coffee table lamp", "bedding", "a bed", "", None], lambda c: I.category(c)) == ["games_toys", "lighting", "other", "beds", "other", "other"]
    assert column(spark, ["reel to reel", "a rooster on a lamp", "artscrafts", "art x deco"], lambda c: X.occurs(F.lower(c), ["reel.to.reel", "rooster.*lamp", "arts.?&?.?crafts", "art.deco"])) == [True, True, True, False]
    assert X.core("arts.?&?.?crafts") == "crafts" and X.core("mid[- ]century") == "century"
