"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from stelae.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_equal_names_equal_all_pairs(spark, con):
    from difflib import SequenceMatcher

    pages = con.sql("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1), regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM pages").fetchall()
    others = sorted((h, i) for i, s, h in pages if s == "https" and h.strip())
    want = {}
    for i, s, h in pages:
        if s == "http" and h.strip():
            best = min(((-SequenceMatcher(None, h, o).ratio() if h != o else -1.0), o, k) for o, k in others)
            if -best[0] >= 0.85:
                want[i] = (best[2], round(-best[0], 6))
    assert {r.page_id: (r.other_page, r.ratio) for r in catalogue.QUERIES["near_equal_names"](spark, SF).collect()} == want and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_gazetteer_links_equal_all_pairs_of_a_block(spark, con):
    from difflib import SequenceMatcher

    from stelae.functions import names

    stem = lambda t: " ".join(next((w.removesuffix(e) for e in names.ENDINGS.split() if w.endswith(e) and len(w) - len(e) >= 3), w) for w in t.split(" "))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    key = lambda t: " ".join(w for w in t.lower().split() if w not in names.PLACE_WORDS.split())
    nations = [(k, key(n)) for k, n in con.sql("SELECT n_nationkey, n_name FROM nation").fetchall()]
    got, whole = {}, set()
    for r in catalogue.QUERIES["gazetteer_links"](spark, SF).collect():
        whole.add(r.c_custkey)
        if r.n_nationkey is not None:
            got.setdefault(r.a, set()).add((r.n_nationkey, round(r.score, 6)))
    assert whole == {k for (k,) in con.sql("SELECT c_custkey FROM customer").fetchall()}
    for (segment,) in con.sql("SELECT DISTINCT c_mktsegment FROM customer").fetchall():
        a = key(segment)
        scored = [(-max(ratio(a, b), ratio(stem(a), stem(b))) if a != b else -1.0, k) for k, b in nations if a[:1] == b[:1]]
        assert got.get(a, set()) == {(k, round(-s, 6)) for s, k in sorted(x for x in scored if -x[0] >= 0.2)[:2]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tiles_of_the_query_hold_all_points(spark, con):
    from test_streams_and_io import decoded

    keys = set()
    for r in catalogue.QUERIES["map_vector_tiles"](spark, SF).collect():
        for features in decoded(bytes(r.tile)).values():
            assert len(features) == r.n
            keys |= {i for i, _, _ in features}
    assert keys == {k for (k,) in con.sql("SELECT c_custkey FROM customer").fetchall()}
