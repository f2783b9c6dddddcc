import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stelae.functions import names as N
from stelae.functions import normalize as Z


@pytest.mark.parametrize(
    ("raw", "text", "spans", "warned"),
    [
        ("[abc] d", "abc d", [("supplied", 0, 3, "[abc]")], 0),
        ("m(arce)", "marce", [("expansion", 1, 5, "(arce)")], 0),
        ("a[..]b", "ab", [("gap", 1, 1, "[..]")], 1),
        ("[- - -] x", " x", [("gap", 0, 0, "[- - -]")], 1),
        ("a---b", "ab", [("gap", 1, 1, "---")], 1),
        ("a[…]", "a", [("gap", 1, 1, "[…]")], 1),
        ("⸢la⸣r", "lar", [("unclear", 0, 2, "⸢la⸣")], 0),
        ("θ̣a", "θa", [("unclear", 0, 1, "θ̣")], 0),
        ("ḍa", "da", [("unclear", 0, 1, "ḍ")], 0),
        ("̣a", "a", [], 1),
        ("a]b", "ab", [], 1),
        ("[ab", "ab", [], 1),
        ("[]", "", [("supplied", 0, 0, "[]")], 0),
        ("a--b", "a--b", [], 0),
        ("[a(b)c]", "abc", [("supplied", 0, 3, "[a(b)c]"), ("expansion", 1, 2, "(b)")], 0),
    ],
)
def test_editors_marks(raw, text, spans, warned):
    got = Z.leiden(raw)
    assert got[0] == text
    assert got[1] == spans
    assert len(got[2]) == warned


@pytest.mark.parametrize(
    ("raw", "canonical", "system", "phonetic"),
    [
        ("LARTHAL", "larθal", "cie", "/lartʰal/"),
        ("MI AVILES", "mi aviles", "cie", "/mi.aviles/"),
        ("larθal", "larθal", "philological", "/lartʰal/"),
        ("s2uthi", "śuθi", "web_safe", "/ʃutʰi/"),
        (r"su\theta i", "suθ i", "latex", "/sutʰ.i/"),
        ("𐌌𐌉", "mi", "unicode", "/mi/"),
        ("", "", "web_safe", "//"),
    ],
)
def test_normal_forms(raw, canonical, system, phonetic):
    n = Z.normalize(raw)
    assert (n["canonical"], n["source_system"], n["phonetic"]) == (canonical, system, phonetic)


def test_span_inside_a_digraph_is_widened():
    n = Z.normalize("[T]HANA")
    assert n["canonical"] == "θana"
    assert [(a["start"], a["end"]) for a in n["apparatus"]] == [(0, 1)]
    assert "span boundary crossed a digraph; widened" in n["warnings"]
    assert n["confidence"] == pytest.approx(0.85)


def test_phonotactics_warn():
    assert len(Z.normalize("ram")["warnings"]) == 1
    assert len(Z.normalize("akta")["warnings"]) == 1


def test_segments_join_and_drop():
    spans = [{"kind": "supplied", "start": 0, "end": 2}, {"kind": "supplied", "start": 2, "end": 3}, {"kind": "unclear", "start": 1, "end": 2}, {"kind": "gap", "start": 4, "end": 4}]
    assert Z.segments("larθal", spans) == [{"kind": "supplied", "text": "lar"}, {"kind": "plain", "text": "θ"}, {"kind": "gap", "text": ""}, {"kind": "plain", "text": "al"}]
    assert Z.tei_text("a<b", [{"kind": "supplied", "start": 0, "end": 3}]) == '<supplied reason="lost">a&lt;b</supplied>'


def test_sound_distance():
    assert N.sound_distance("larθ", "lart") == 0.5
    assert N.sound_distance("s", "ś") == pytest.approx(0.3)
    assert N.sound_distance("", "abc") == 3
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("larθtsśe", k=rng.randint(0, 6))) for _ in range(2))
        assert N.sound_distance(a, b) == pytest.approx(N.sound_distance(b, a))


def test_name_parts():
    kinds = [N.component(t, i)["type"] for i, t in enumerate(["larθ", "arnθal", "spurinas"])]
    assert kinds == ["praenomen", "patronymic", "gentilicium"]
    assert N.component("ramθas", 2)["type"] == "metronymic"
    assert N.component("lart", 0)["match_method"] == "fuzzy"
    assert N.component("xxxxxxa", 0)["gender"] == "female"


def test_udfs_agree_with_functions(spark):
    df = spark.createDataFrame([("LARTHAL",), ("[lar]th",), (None,)], "t string")
    got = df.select(Z.normalize_udf()("t").alias("n")).select("n.canonical").collect()
    assert [r.canonical for r in got] == ["larθal", "larθ", ""]
    r = spark.createDataFrame([("clusium", "clusii")], "a string, b string").select(N.ratio_udf("a", "b").alias("r")).first().r
    assert r == SequenceMatcher(None, "clusium", "clusii").ratio()
    s = spark.createDataFrame([("Clusium cum agro",)], "a string").select(N.place_key(Z.unmarked(F.col("a"))).alias("k")).first().k
    assert s == "clusium"
    assert spark.createDataFrame([("clusium",), ("clusii",)], "a string").select(N.place_stem(F.col("a")).alias("k")).distinct().count() == 1
