"""Operators that grew with the square of their rows, or were dealt or sent wrongly, where tables are large."""

import random

from pyspark.sql import functions as F

from stelae.operators import aggregates, evaluation, graph, joins, roles, spatial, vectors


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def brute(asked, rows, k, fits=lambda a, b: True):
    """The k best as a plain loop has them."""

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    out = []
    for q, v, *a in asked:
        score = [(-dot(w, v) / (dot(w, w) ** 0.5 * dot(v, v) ** 0.5), i) for i, w, *b in rows if w and any(w) and len(w) == len(v) and None not in w and i is not None and i != q and fits(a, b)]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(out)


def test_neighbours_are_products_and_equal_a_plain_loop(spark, monkeypatch):
    from stelae.operators import nearest

    rng = random.Random(5)
    kinds = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(12)]
    rows = [(i, kinds[i % 12] if i % 3 else [rng.gauss(0, 1) for _ in range(6)], i % 4 if i % 11 else None) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 6, 1), (1002, [1.0, 2.0], 2), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (1004, [1e-160] * 6, 1), (None, kinds[0], 1)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, g int").repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 7 == 0 and r[0] < 1000 and any(r[1])]
    queries = df.where("id % 7 = 0 and id < 1000")
    whole = [r for r in rows if r[0] != 1004]  # its length is lost in doubles
    differ = lambda a, b: a[0] is not None and b[0] is not None and a[0] != b[0]
    same = lambda a, b: a[0] is not None and a[0] == b[0]
    for size in (1024, 16):
        monkeypatch.setattr(nearest, "SLICE", size)
        for args, fits in (({}, lambda a, b: True), ({"differ": ["g"]}, differ), ({"same": ["g"]}, same)):
            found = vectors.neighbours(queries, df.where("id is null or id <> 1004"), "id", "v", 5, **args)
            assert "NestedLoop" not in plan(found)
            assert sorted((r["query"], r["id"], r["score"], r["rank"]) for r in found.collect()) == brute(asked, whole, 5, fits)


def test_margins_and_calibration_read_their_rows_once(spark):
    hits = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.5, 2), (2, 7, 0.4, 1), (2, 9, 0.39, 2), (3, 4, 0.2, 1)], "query int, id int, score double, rank int")
    got = vectors.margin_gate(hits, "query", 0.1)
    assert sorted((r["query"], r["id"], round(r.margin, 6) if r.margin is not None else None) for r in got.collect()) == [(1, 7, 0.4), (1, 8, 0.4), (3, 4, None)]
    assert plan(got).count("Scan") == 1
    curve = evaluation.calibration(hits, "score", F.col("id") == 7, [0.3, 0.45, 0.95])
    assert sorted((r.cut, r.n, round(r.share, 6), round(r.accuracy, 6)) for r in curve.collect()) == [(0.3, 4, 0.8, 0.5), (0.45, 2, 0.4, 0.5)]
    assert plan(curve).count("Scan") == 1


def test_bundles_have_the_atoms_that_expressions_give(spark):
    for key in ("role EGO", "word larθ", ""):
        assert spark.range(1).select(roles.atom(F.lit(key))).first()[0] == roles.signs_of(key).tolist()
    r = spark.createDataFrame([(1, [("EGO", "mi"), ("GENTILICIUM", "spurinas")]), (2, [])], f"id int, r array<{roles.ROLE}>")
    (row,) = roles.bundle(r, "id", "r").collect()
    atoms = {k: roles.signs_of(k) for k in ("role EGO", "role GENTILICIUM", "word mi", "word spurinas", "place 0", "place 1")}
    assert row.content == (atoms["role EGO"] * atoms["word mi"] + atoms["role GENTILICIUM"] * atoms["word spurinas"]).tolist()
    assert row.structure == (atoms["role EGO"] * atoms["place 0"] + atoms["role GENTILICIUM"] * atoms["place 1"]).tolist()


def test_numbers_of_more_digits_are_whole_or_cut_as_sql_has_them(spark):
    df = spark.range(101)
    got = {r.id: r.person_id for r in graph.numbered(df, "id", digits=2, cut=True).collect()}
    assert got[7] == "P07" and got[99] == "P99" and got[100] == "P10"
    assert {r.id: r.person_id for r in graph.numbered(df, "id", digits=2).collect()}[100] == "P100"


def test_numbered_persons_equal_sql_beyond_five_digits(spark, tmp_path):
    import duckdb

    from stelae.plans import catalogue

    spark.range(100_200).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = dict(con.execute(catalogue.ORACLE_SQL["numbered_persons"]).fetchall())
    assert {r.c_custkey: r.person_id for r in catalogue.QUERIES["numbered_persons"](spark, str(tmp_path)).collect()} == want


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_entity_pairs_equal_all_pairs_without_making_them(spark):
    rng = random.Random(2)
    for sizes, least, meet in (((4, 4), 0.65, True), ((0, 4), 0.65, True), ((1, 9), 0.65, True), ((4, 4), 0.79, True), ((2, 3), 0.3, False)):
        rows = [(i, i % 2, "".join(rng.choice("ab") for _ in range(rng.randint(*sizes))) if i % 17 else None, rng.choice(["m", "f", None])) for i in range(90)]
        got = graph.entity_pairs(spark.createDataFrame(rows, "id int, k int, n string, g string"), "k", "id", "n", "g", least)
        want = []
        for i, k, n, g in rows:
            for j, m, o, h in rows:
                if k == m and i < j:
                    veto = None not in (g, h) and g != h
                    alike = 0.0 if veto else None if None in (n, o) else 1 - slow_edits(n, o) / max(len(n), len(o), 1)
                    if alike is not None and 0.4 * alike + 0.4 > least:
                        want.append((i, j, round(0.4 * alike + 0.4, 9)))
        assert sorted((r.a, r.b, round(r.score, 9)) for r in got.collect()) == sorted(want) and want
        assert ("levenshtein" not in plan(got)) or sizes == (1, 9) or not meet


def test_rows_of_a_place_share_its_distances(spark):
    rng = random.Random(4)
    spots = [(40 + rng.random(), 9 + rng.random()) for _ in range(12)]
    left = spark.createDataFrame([(i, *spots[i % 12]) for i in range(30)], "s int, lat double, lon double")
    right = spark.createDataFrame([(i, *spots[i % 7]) for i in range(40)] + [(99, None, 1.0)], "c int, lat double, lon double")
    pairs = spatial.place_pairs(left, right, 40.0)
    assert "Broadcast" not in plan(pairs) and pairs.count() <= 84
    joined = spatial.spatial_join(left, right, 40.0)
    assert "Broadcast" not in plan(joined)
    rows = joined.select("s", F.col("r_c").alias("c"), "distance_km").collect()
    want = []
    for s in range(30):
        want += [(s, c, d) for d, c in sorted((r.distance_km, r.c) for r in rows if r.s == s)[:3]]
    got = spatial.nearest_within(left, right, "c", 40.0, 3)
    assert sorted((r.s, r.c, r.distance_km) for r in got.collect()) == sorted(want)


def test_near_copies_send_no_table_that_grows(spark):
    from stelae.llm import components, simhash

    docs = spark.createDataFrame([(i, f"some words that are here {i // 2} and more") for i in range(40)], "doc_id bigint, text string")
    marked = simhash.fingerprints(docs)
    assert "Broadcast" not in plan(simhash.links(marked.select("fp").distinct()))
    assert "Broadcast" not in plan(simhash.near_duplicates(docs))
    assert "Broadcast" not in plan(simhash.component_of(marked))
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u bigint, v bigint")
    assert sorted(tuple(r) for r in components.components(links).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]


def test_first_word_matches_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["abc", "abcd", "bcde", "cdef", "defg", "efghi", "longer", "longest", "dcba"]
    rows = [(i, [rng.choice(words[: 5 + i % 5]) for _ in range(rng.randint(0, 5))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    left, right = df.where("id % 5 = 0").withColumnRenamed("id", "a"), df.where("id % 5 <> 0").withColumnRenamed("id", "b")
    for least in (1, 2, 3):
        want = []
        for a, v in rows:
            for b, w in rows if a % 5 == 0 else []:
                both = {x for x in set(v) & set(w) if len(x) > 3}
                if b % 5 and (len(both) >= least or any(len(x) >= 6 for x in both)):
                    want.append((a, b, len(both)))
                    break
        found = joins.word_overlap(left, right, "a", "b", "w", least)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want
        assert least > 2 or "Window" not in plan(found)


def test_pairs_of_shared_identifiers_are_made_once(spark):
    rng = random.Random(7)
    rows = [(i % 50, *[rng.choice(["x", "y", "z", "", " ", None, str(i % 6)]) for _ in range(3)]) for i in range(60)]
    found = joins.shared_identifiers(spark.createDataFrame(rows, "id int, a string, b string, c string"), "id", ["a", "b", "c"])
    held = {}
    for i, *vs in rows:
        held.setdefault(i, set()).update(v for v in vs if v and v.strip())
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, j) for i in held for j in held if i != j and held[i] & held[j])
    last = plan(found).split("SortMergeJoin")[0]
    assert "Aggregate" not in last and "Broadcast" not in plan(found)


def test_ngrams_equal_sets_of_substrings(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé\U0001f600 \n\x0b") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    wide = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "".join(chr(rng.randint(0x20000, 0x2A6DF)) for _ in range(3000))]
    for some in (texts, wide, [], ["ab"]):
        want = {}
        for t in some:
            for g in {t[i : i + 5] for i in range(len(t) - 4)}:
                if not any(c in " \t\n\f\r" for c in g):
                    want[g] = want.get(g, 0) + 1
        grams, documents = aggregates.ngram_counts(some, 5)
        assert dict(zip(grams, documents.tolist())) == want and len(grams) == len(want)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    got = aggregates.ngram_gold(df, "id", "t", (2, 4), (3, 6), 12, 4)
    want = {}
    for i, t in enumerate(texts):
        for n in (2, 3, 4):
            for g in {t[j : j + n] for j in range(len(t) - n + 1)} if len(t) >= 4 else ():
                if not any(c in " \t\n\f\r" for c in g):
                    want.setdefault(g, []).append(i)
    best = sorted((-len(g), len(ids), g.encode(), g) for g, ids in want.items() if 3 <= len(ids) <= 6)[:12]
    assert {(r.gram, r.documents, tuple(r.ids)) for r in got.collect()} == {(g, n, tuple(want[g][:4])) for _, n, _, g in best} and best


def test_overlaps_of_groups_are_counted_by_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randint(0, 40), rng.choice(["a", "b", "c", "d", "e", None])) for _ in range(120)] + [(None, "a")]
    held = {}
    for g, m in rows:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    want = sorted((a, b, len(held[a] & held[b])) for a in held for b in held if a < b and held[a] & held[b])
    df = spark.createDataFrame(rows, "g bigint, m string")
    for block, pairs in ((65_536, 1 << 22), (7, 30), (1, 1)):
        monkeypatch.setattr(aggregates, "GROUP_BLOCK", block)
        monkeypatch.setattr(aggregates, "PAIRS", pairs)
        found = aggregates.overlap_of_groups(df, "g", "m")
        assert sorted(tuple(r) for r in found.collect()) == want
        assert "Join" not in plan(found)
