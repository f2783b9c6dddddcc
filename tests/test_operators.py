import itertools
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stelae.functions import markup, text
from stelae.operators import aggregates, cells, cover, curation, edits, evaluation, graph, joins, restoration, search, similar, spatial, stats, vectors


def test_keyword_in_context_finds_overlaps(spark, rows):
    df = spark.createDataFrame([(1, "AnanaN"), (2, "xyz"), (3, None), (4, "")], "id int, text string")
    got = rows(search.keyword_in_context(df, "ana", 2))
    assert got == [(1, 1, "", "Ana", "na"), (1, 3, "An", "ana", "N")]


def test_contains_takes_wildcards_plainly(spark):
    df = spark.createDataFrame([("50%",), ("500",), (None,)], "t string")
    assert df.where(search.contains_ci("t", "0%")).count() == 1


def test_merge_preserves(spark, rows):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, w string")
    assert rows(joins.merge(old, new, "k", ["w"])) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z")]
    assert rows(joins.insert_new(old, new, "k")) == [(1, "a", "x"), (2, "b", "y"), (3, "d", "z")]


def test_intervals(spark, rows):
    pts = spark.createDataFrame([(1, -500), (2, 0), (3, None)], "id int, y int")
    iv = spark.createDataFrame([("a", -720, -90), ("b", -500, -500)], "p string, lo int, hi int")
    assert rows(joins.containing_intervals(pts, "y", iv, "lo", "hi", 50), "id", "p") == [(1, "a"), (1, "b")]
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 20, 22), (1, 1, 2)], "k int, s int, e int")
    assert rows(aggregates.merged_intervals(df, "k", F.col("s"), F.col("e"))) == [(1, 0, 9, 3), (1, 20, 22, 1)]


def test_century_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-599,), (-1,), (99,), (150,), (None,)], "y int")
    assert [r[0] for r in df.select(aggregates.century(F.col("y"))).collect()] == [-500, 0, 0, 100, None]


def test_closure_ends_on_cycles(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 4)], "p int, c int")
    s = spark.createDataFrame([(1,)], "root int")
    assert rows(graph.descendants(s, e, "p", "c")) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_numbering(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(50)], "id int")
    got = dict(rows(graph.numbered(df, "id"), "id", "person_id"))
    assert got == {i: f"P{i:05d}" for i in range(50)}


def test_spatial_join_equals_all_pairs(spark, rows):
    rng = random.Random(3)
    pts = [(i, 40 + rng.random() * 3, 9 + rng.random() * 3) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(b[1] - a[1]) / 2, math.radians(b[2] - a[2]) / 2
        return 2 * 6371 * math.asin(math.sqrt(math.sin(p) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(q) ** 2))

    want = sorted((a[0], b[0]) for a, b in itertools.product(pts, pts) if km(a, b) <= 15)
    assert sorted(rows(spatial.spatial_join(df, df, 15.0), "id", "r_id")) == want


def test_alpha_is_one_where_all_agree(spark):
    df = spark.createDataFrame([(i, r, "ab"[i % 2]) for i in range(6) for r in range(3)], "item int, rater int, v string")
    assert evaluation.krippendorff_alpha(df, "item", "v").first().alpha == pytest.approx(1.0)
    one = spark.createDataFrame([(1, "a"), (1, "a")], "item int, v string")
    assert evaluation.krippendorff_alpha(one, "item", "v").first().alpha is None


def test_split_shares_no_text(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "ab"[i % 2], f"t{rng.randint(0, 60)}") for i in range(200)], "id int, label string, key string")
    out = curation.text_disjoint_split(df, "id", "label", "key", 0.2)
    test, train = (out.where(F.col("split") == s).select("key").distinct() for s in ("test", "train"))
    assert test.intersect(train).count() == 0
    assert out.count() == 200
    folds = curation.group_folds(df, "key", "label", 5)
    assert folds.groupBy("key").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_posterior_sums_to_one(spark):
    df = spark.createDataFrame([(1, "mi larθal"), (2, ""), (3, "kaviesi qutun")], "id int, c string")
    out = stats.dating_posterior(df, "id", F.col("c")).groupBy("id").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in out)
    tags = {r.id: r.period for r in stats.dating_tags(df, "id", F.col("c")).collect()}
    assert tags[2] == "indeterminate"


def test_prefix_filter_loses_no_pair(spark, rows):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcde ", k=30)) for _ in range(12)]
    docs = [(i, base[i % 12] + ("x" if i > 11 else "")) for i in range(24)]
    w = vectors.ngram_weights(spark.createDataFrame(docs, "id int, t string"), "id", "t").collect()
    by = {}
    for r in w:
        by.setdefault(r.id, {})[r.gram] = r.w
    want = sorted((a, b) for a in by for b in by if a < b and sum(x * by[b].get(g, 0) for g, x in by[a].items()) >= 0.6)
    df = spark.createDataFrame(w)
    assert sorted(rows(vectors.cosine_pairs(df, "id", 0.6), "a", "b")) == want


def test_directions_are_removed(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(1, 6)], "id int, v array<double>")
    d = vectors.principal_directions(df, "v", 1)
    left = df.select(vectors.dot(vectors.without_directions(F.col("v"), d), F.array(*[F.lit(x) for x in d[0]])).alias("x")).collect()
    assert all(abs(r.x) < 1e-9 for r in left)


def test_texts(spark):
    one = lambda v, c: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one("ЭÆþ∂x", text.unscanned) == "eaeθx"
    assert one("larθ [..]al : mi", text.intact_tokens).text == "larθ mi"
    assert one("XXIX", text.latin_spelling) is False
    assert one("HASTI", text.latin_spelling) is True
    assert one("ab[cde]f", text.lacunae).width == 3
    assert one("[..]", text.lacunae) is None
    assert one("..-", text.gap_width) == 3
    assert one(".…", text.gap_width) is None
    assert one("perusiae", lambda c: text.stem(c, ["ae", "a", "e"])) == "perusi"
    assert one("<a>&\"", markup.xml_escape) == "&lt;a&gt;&amp;&quot;"
    assert one("<p>a</p><script>x<y</script> b&amp;lt;", markup.html_text) == "a b&lt;"


def test_gates():
    assert evaluation.fail_below({"p": 0.5}, "p=0.4,q=0.1") == ["q"]


def test_random_baseline(spark):
    v = spark.range(1).select(evaluation.random_precision(F.lit(10), F.lit(2), 3).alias("p")).first().p
    assert v == pytest.approx(1 - math.comb(8, 3) / math.comb(10, 3))


def test_structured_query(spark):
    q = spark.createDataFrame([("tular Archaic, late TM",), ("",), (None,)], "q string")
    r = search.structured_query(q, "q", {"archaic": (-700, -500), "late": (-300, -50)}, {"tm": "has_tm"}).collect()
    assert (r[0].residual, r[0].year_from, r[0].year_to, r[0].has_tm) == ("tular", -700, -50, True)
    assert r[1].year_from is None


def test_roles_and_hypervectors(spark):
    from stelae.operators import roles

    df = spark.createDataFrame([(1, "mi larθ arnθal spurina turce"), (2, ""), (3, None)], "id int, t string")
    r = df.select("id", roles.parse(roles.tokens(F.col("t"))).alias("r"))
    assert [(x.role, x.filler) for x in r.where("id = 1").first().r] == [("EGO", "mi"), ("VERB", "turce"), ("PRAENOMEN", "larθ"), ("PATRONYMIC", "arnθal"), ("GENTILICIUM", "spurina")]
    v = roles.bundle(r.where("id = 1"), "id", "r")
    got = v.select(*[vectors.cosine(roles.unbound(F.col("content"), "GENTILICIUM"), roles.atom(F.lit(f"word {w}"))).alias(w) for w in ("spurina", "larθ", "mi")]).first()
    assert got.spurina > max(got.larθ, got.mi) + 0.2


def test_windows_and_patterns(spark):
    from stelae.operators import routing

    df = spark.createDataFrame([("aaaa KEY bbbb key cccc",), ("no such word here at all, truly",), ("abcd",)], "t string")
    got = [r.w for r in df.select(routing.keyword_windows(F.col("t"), "key", 2).alias("w")).collect()]
    assert got == ["a KEY b [...] b key c", "no [...] ly", "abcd"]
    assert routing_json(spark, '```json\n[{"a": "x"}]\n```') == ["x"]
    assert routing_json(spark, '{"items": [{"a": "y"}]}') == ["y"]
    assert routing_json(spark, "none") is None


def routing_json(spark, text):
    from stelae.operators import routing

    r = spark.createDataFrame([(text,)], "t string").select(routing.unfenced_json(F.col("t"), "a: string").alias("j")).first().j
    return None if r is None else [x.a for x in r]


def test_neighbours_of_more_queries_than_a_block(spark, monkeypatch):
    from stelae.operators import vectors

    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(20)], "id bigint, v array<double>")
    whole = sorted(tuple(r) for r in vectors.neighbours(v, v, "id", "v", 2).collect())
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    assert sorted(tuple(r) for r in vectors.neighbours(v, v, "id", "v", 2).collect()) == whole
    assert len(whole) == 40


def test_descendants_deeper_than_64_rounds(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 68)], "p bigint, c bigint").coalesce(1)
    s = spark.createDataFrame([(1,)], "root bigint")
    assert graph.descendants(s, e, "p", "c").agg({"depth": "max"}).first()[0] == 67
    with pytest.raises(ValueError):
        graph.descendants(s, e, "p", "c", most_depth=2)


def test_best_match_among_more_than_1000_names(spark, tmp_path):
    from stelae.plans.transcription import fuzzy_best_match_levenshtein

    spark.createDataFrame([(i, f"name{i:04d}", f"name{i:04d}") for i in range(1200)], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert fuzzy_best_match_levenshtein(spark, str(tmp_path)).where("score = 1").count() == 1200


def test_confidence_ladder():
    from stelae.functions.names import fuzzy_confidence

    at = (0.0, 0.3, 0.5, 0.8, 1.0, 1.3, 1.5, 1.8, 2.0, 2.1)
    assert [fuzzy_confidence(d) for d in at] == [1.0, 0.9, 0.9, 0.8, 0.8, 0.7, 0.7, 0.6, 0.6, 0.4]


def test_spatial_join_on_the_whole_sphere(spark):
    import math
    import random

    from stelae.operators import spatial

    rng = random.Random(1)
    points = [(0, 80.0, 10.0), (1, 80.0, 10.9), (2, 0.0, 179.999), (3, 0.0, -179.999), (4, 90.0, 0.0), (5, 89.99, 120.0), (6, -90.0, 5.0), (7, -89.95, -170.0), (8, None, 1.0)]
    points += [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(10, 200)]

    def far(a, b):
        (_, p, q), (_, r, s) = a, b
        h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, h)))

    df = spark.createDataFrame(points, "id int, lat double, lon double")
    known = [p for p in points if p[1] is not None]
    for km in (20.0, 900.0, 25_000.0):
        got = {(r.id, r.r_id) for r in spatial.spatial_join(df, df, km).select("id", "r_id").collect()}
        assert got == {(a[0], b[0]) for a in known for b in known if far(a, b) <= km}
    assert spatial.spatial_join(df, df, 20.0).count() == spatial.spatial_join(df, df, 20.0).distinct().count()


def test_chi_square_tail_and_softmax(spark):
    from stelae.operators import stats

    rows = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.070498, 5, 0.05), (6.634897, 1, 0.01), (124.342113, 100, 0.05), (0.0, 3, 1.0), (5.0, 0, 1.0), (2000.0, 4, 0.0)]
    df = spark.createDataFrame(rows, "x double, d int, p double")
    assert all(abs(r.got - r.p) < 1e-6 for r in df.select("p", stats.chi_square_tail(F.col("x"), F.col("d")).alias("got")).collect())
    table = spark.createDataFrame([("a", "x", 30), ("a", "y", 10), ("b", "x", 10), ("b", "y", 30)], "r string, c string, n int")
    (one,) = stats.chi_squared(table, "r", "c", "n").collect()
    assert one.significant and abs(one.p_value - 1.7e-5) < 5e-6
    (same,) = stats.chi_squared(table.withColumn("n", F.lit(7)), "r", "c", "n").collect()
    assert not same.significant and same.p_value == 1.0
    (s,) = spark.createDataFrame([([1.0, 2.0, 1002.0],)], "s array<double>").select(stats.softmax(F.col("s")).alias("s")).collect()
    assert abs(sum(s.s) - 1) < 1e-12 and s.s[2] > 0.99


def test_keyword_places_are_those_of_the_text(spark):
    from stelae.operators import search

    df = spark.createDataFrame([(1, "\u0130\u0130 abc KEY xyz key"), (2, "keyKey"), (3, "none"), (4, None)], "id int, text string")
    got = sorted(tuple(r) for r in search.keyword_in_context(df, "key", 3).collect())
    assert got == [(1, 8, "bc ", "KEY", " xy"), (1, 16, "yz ", "key", ""), (2, 1, "", "key", "Key"), (2, 4, "key", "Key", "")]


def test_malformed_tei_keeps_its_row(spark):
    from stelae.sources.readers import tei

    good = "<TEI xmlns='http://x'><idno type='filename'>g</idno><origPlace>here</origPlace><div type='edition'>mi</div></TEI>"
    df = spark.createDataFrame([(1, good), (2, "<a><b></a>"), (3, "no xml"), (4, None), (5, "<a>&bad;</a>")], "n int, xml string")
    got = {r.n: r for r in tei(df).collect()}
    assert (got[1].id, got[1].place, got[1].text, got[1].problem) == ("g", "here", "mi", None)
    assert [got[n].problem for n in (2, 3)] == ["not XML"] * 2 and len(got) == 5


def test_reranked_hybrid_and_timestamps(spark):
    from stelae.engine import Corpus
    from stelae.functions.text import iso_timestamp

    rows = [(f"r{i}", "mi " * (i + 1) + "larthal", "Caere", [1.0, i / 10]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, canonical string, findspot string, emb_combined array<double>")
    got = Corpus(df).hybrid(["larthal"], [1.0, 0.0], limit=3, rerank=lambda found: F.length("canonical")).collect()
    assert [r.id for r in got] == ["r11", "r10", "r9"]
    (t,) = spark.sql("SELECT timestamp'2024-03-01 12:00:00+02:00' AS t").select(iso_timestamp(F.col("t")).alias("t")).collect()
    assert t.t == "2024-03-01T10:00:00Z"


def test_running_sums_of_a_key_over_many_tasks(spark):
    from stelae.operators.ranks import running_sum

    made = [("hot" if i % 3 else None, (i * 37) % 1000, i) for i in range(1000)] + [("rare", 5, 2000)]
    df = spark.createDataFrame(made, "k string, o int, id int").repartition(7)
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], ["o", "id"], F.lit(1), "s").collect()}
    want, seen = {}, {}
    for k, o, i in sorted(made, key=lambda x: x[1:]):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want
    assert running_sum(df.where("false"), ["k"], ["o", "id"], F.lit(1), "s").count() == 0


def test_join_on_either_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, 1), (2, None), (None, 2), (3, 1)], "a int, b int")
    got = [(r["k"], r["a"], r["b"]) for r in joins.join_on_either(left, right, "k", ["a", "b"]).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 1), (1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 2, None), (2, None, 2)], key=repr)


def test_hard_negatives_behind_many_of_one_label(spark):
    """59 nearer rows of the query's own label do not hide the five of another."""
    rows_ = [(i, [1.0, i / 1000], "own") for i in range(60)] + [(100 + i, [1.0, 1.0 + i], "other") for i in range(5)] + [(200, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows_, "id int, v array<double>, label string")
    got = vectors.hard_negatives(df.where("id = 0"), df, "id", "v", "label", 3)
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(100, 1), (101, 2), (102, 3)]


def slow_covers(words, clauses):
    """Brute force: all least intervals of positions that hold all terms of a clause."""
    terms = {t for c in clauses for t in c}
    at = [i for i, (w, _) in enumerate(words) if w in terms]
    good = [(a, b) for a in at for b in at if a <= b and any(set(c) <= {w for w, _ in words[a : b + 1]} for c in clauses)]
    return [(a, b) for a, b in good if not any((x, y) != (a, b) and a <= x and y <= b for x, y in good)]


def test_cover_rank_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, [rng.choice("abcdx") for _ in range(rng.randrange(25))], [rng.choice("abx") for _ in range(rng.randrange(4))]) for i in range(80)] + [(80, None, ["a", "b"])]
    df = spark.createDataFrame(docs, "id int, t array<string>, s array<string>")
    for query in ("a b", "a b or c d", 'a or "b c" -x', "a"):
        clauses = cover.clauses_of(query)
        got = {r.id: (r.rank, r.n_covers) for r in cover.cover_rank(df, "id", [(F.col("t"), "A"), (F.col("s"), "D")], clauses).collect()}
        for i, t, s in docs:
            words = [(w, 1.0) for w in t or []] + [(w, 0.1) for w in s]
            found, terms = slow_covers(words, clauses), {x for c in clauses for x in c}
            rank = 0.0
            for a, b in found:
                held = [1 / v for w, v in words[a : b + 1] if w in terms]
                rank += len(held) / sum(held) / (1 + b - a - (len(held) - 1))
            assert (i in got) == bool(found)
            if found:
                assert got[i] == (pytest.approx(rank), len(found))


def test_web_queries_as_clauses():
    assert cover.clauses_of('The "of the" -not or x') == [["the", "of"], ["x"]]
    assert cover.clauses_of("or or -a") == []


def test_cells_reach_recall_and_all_probes_are_exact(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    e = e.unionByName(spark.createDataFrame([(-1, [0.0] * 64), (-2, None), (-3, [1.0])], e.schema))
    asked = e.where("vec_id % 50 = 0")
    exact = vectors.neighbours(asked, e.where("vec_id >= 0"), "vec_id", "embedding", 10)
    centroids, probes = cells.fit(e, "vec_id", "embedding", 24)
    assert centroids.shape[0] == 24 and 0 < probes < 24
    index = cells.in_cells(e, "embedding", centroids)
    assert cells.recall(cells.cell_neighbours(asked, index, centroids, "vec_id", "embedding", 10, probes), exact, "vec_id").first().recall >= 0.9
    every = cells.cell_neighbours(asked, index, centroids, "vec_id", "embedding", 10, 24)
    view = lambda df: {(r["query"], r["rank"]): r.vec_id for r in df.collect()}
    assert view(every) == view(exact)


@pytest.mark.parametrize("least", [0.82, 0.85, 0.95])
def test_near_equal_equals_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 24))) for _ in range(40)]

    def edited(s):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s = s[:i] + rng.choice(["", "a", "zq"]) + s[i + rng.randrange(2) :]
        return s

    left, right = [(i, edited(rng.choice(base))) for i in range(150)] + [(150, None), (151, " ")], [(i, edited(rng.choice(base))) for i in range(150)]
    a, b = spark.createDataFrame(left, "i int, s string"), spark.createDataFrame(right, "j int, t string")
    got = {r.i: (r.j, r.ratio) for r in similar.near_equal(a, b, "i", "s", "j", "t", least).collect()}
    for i, s in left:
        scored = [(-SequenceMatcher(None, s, t).ratio(), t, j) for j, t in right if t.strip()] if s and s.strip() else []
        best = min((x for x in scored if -x[0] >= least), default=None)
        assert got.get(i) == (None if best is None else (best[2], -best[0]))


def test_near_equal_refuses_ratios_that_the_filter_would_lose():
    with pytest.raises(ValueError):
        similar._filters(0.8)


def test_principal_directions(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 5)) * [5, 1, 3, 0.1, 0.5]
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(5)
    want = np.linalg.eigh(x.T @ x)[1].T[::-1][:2]
    for got, line in zip(vectors.principal_directions(df, "v", 2), want):
        assert abs(float(np.dot(got, line))) == pytest.approx(1.0)


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def some_strings(rng, n):
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(10))) for _ in range(12)] + ["xyz", "Brand#1"]
    return [(lambda s, i: s[:i] + rng.choice(["", "a", "qz", "bbbb"]) + s[i + rng.randrange(3) :])(s, rng.randrange(len(s) + 1)) for s in rng.choices(base, k=n)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_strings_within_edits(spark, k):
    rng = random.Random(k)
    left, right = sorted(set(some_strings(rng, 70))), sorted(set(some_strings(rng, 70)))
    make = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {(r.a, r.b): r.edits for r in edits.within_edits(make(left, "a"), make(right, "b"), k).collect()}
    assert got == {(a, b): d for a in left for b in right if (d := slow_edits(a, b)) <= k}


def test_nearest_by_edits(spark):
    rng = random.Random(9)
    left, right = [*some_strings(rng, 120), None, "", "ωψ"], [*some_strings(rng, 60), None]
    df = lambda values: spark.createDataFrame([(v,) for v in values], "s string")
    plan = edits.nearest_by_edits(df(left), df(right), "s", "s")
    want = {}
    for a in {x for x in left if x is not None}:
        score, b = min((-(1 - slow_edits(a, b) / max(len(a), len(b))) if a or b else -1.0, b) for b in right if b is not None)
        want[a] = (b, pytest.approx(-score))
    assert {r.a: (r.b, r.score) for r in plan.collect()} == want
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().toString()
    assert edits.nearest_by_edits(df(left), df([None]), "s", "s").count() == 0


def test_restoration_equals_all_fillings(spark):
    """One to three gaps, beside each other and apart, against every filling scored by hand."""
    rng = random.Random(2)
    corpus = ["".join(rng.choices("aab c", k=rng.randrange(30))) for _ in range(40)] + [None]
    known = restoration.model(spark.createDataFrame([(t,) for t in corpus], "t string"), "t", 2)
    count = [{}, {}, {}]
    for t in filter(None, corpus):
        for o in range(3):
            for i in range(len(t) - o):
                at = count[o].setdefault(t[i : i + o], {})
                at[t[i + o]] = at.get(t[i + o], 0) + 1

    def chance(before, c):
        for o in range(min(2, len(before)), -1, -1):
            at = count[o].get(before[len(before) - o :], {})
            if c in at:
                return at[c] / sum(at.values()) * 0.4 ** (2 - o)
        return 1e-9

    g = restoration.GAP
    texts = [(1, f"ab{g}ca"), (2, f"{g}b"), (3, f"a{g}{g}c"), (4, f"a{g}bbbb{g}{g}"), (5, "abc"), (6, None), (7, f"{g}{g}{g}"), (8, f"zz{g}zz")]
    got = {}
    for r in restoration.restore(spark.createDataFrame(texts, "id int, t string"), "id", "t", known, 2, list("abc"), best=4, width=27).collect():
        got[r.id, r["rank"]] = (r.fills, pytest.approx(r.score))
    want = {}
    for i, t in texts:
        if t is None or g not in t:
            continue
        at, made = [k for k, c in enumerate(t) if c == g], []
        reach = sorted({k for p in at for k in range(p, p + 3) if k < len(t)})
        for fill in itertools.product("abc", repeat=len(at)):
            full = list(t)
            for k, c in zip(at, fill):
                full[k] = c
            made.append((-round(sum(math.log(chance("".join(full[max(0, k - 2) : k]), full[k])) for k in reach), 9), "".join(fill)))
        want |= {(i, n + 1): (f, -s) for n, (s, f) in enumerate(sorted(made)[:4])}
    assert got == want


def test_first_in_hash_order_equals_ranks(spark):
    import hashlib

    rows_ = [(i, "hot" if i % 4 else f"k{i % 12}", i) for i in range(2000)] + [(5000 + i, "two", i) for i in range(2)] + [(6000, None, 1)]
    df = spark.createDataFrame(rows_, "id int, k string, v int").repartition(5)
    got = {(r.k, r.id) for r in curation.first_in_hash_order(df, "k", "id", F.greatest(F.lit(3), F.floor(F.col("_n") * 0.1))).collect()}
    want = set()
    for k in {k for _, k, _ in rows_ if k}:
        ids = sorted((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i, x, _ in rows_ if x == k)
        want |= {(k, i) for _, i in ids[: max(3, len(ids) // 10)]}
    assert got == want


@pytest.mark.parametrize("n, links", [(60, 30), (200, 190), (64, 63)])
def test_classes_equal_union_find(spark, n, links):
    rng = random.Random(n)
    made = [(i, i + 1) for i in range(links)] if links == 63 else [(rng.randrange(n), rng.randrange(n)) for _ in range(links)]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in made:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*made, (None, 3)], "a int, b int").repartition(3)
    assert {r.node: r["class"] for r in graph.classes(df, "a", "b").collect()} == {x: root(x) for link in made for x in link}
    assert graph.classes(df.where("false"), "a", "b").count() == 0


def test_identifier_classes(spark, rows):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", ""), (3, "q", "p"), (4, None, "z"), (5, " ", None)], "id int, a string, b string")
    assert rows(joins.identifier_classes(df, "id", ["a", "b"])) == [(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 0)]
