import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stelae.engine import Corpus, People
from stelae.functions import tables as functions
from stelae.functions import text
from stelae.operators import models
from stelae.sources import readers, tables, tiles, writers
from stelae.streaming import stateful, windows

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_twin(spark, rows, tmp_path):
    events = windows.event_time(spark.read.parquet(f"{SF}/events.parquet"))
    far = events.limit(1).withColumn("ts", F.lit(dt.datetime(2030, 1, 1)).cast("timestamp")).withColumn("event_type", F.lit("end"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), events.schema, 1)
    out = str(tmp_path / "out")
    counted = windows.tumbling_counts(stream, ["event_type"], "1 hour", late="1 hour")
    windows.run_available(counted, windows.append_once(out), str(tmp_path / "ck"))
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counted = windows.tumbling_counts(windows.read_events(spark, str(tmp_path / "in"), events.schema, 1), ["event_type"], "1 hour", late="1 hour")
    windows.run_available(counted, windows.append_once(out), str(tmp_path / "ck"))
    got = spark.read.parquet(out).drop("batch")
    assert rows(got) == rows(windows.tumbling_counts(events, ["event_type"], "1 hour"))


def test_terminal_states_stay(spark, rows):
    e = spark.createDataFrame([(1, 1, 1, "ok"), (1, 2, 2, "no"), (2, 3, 1, "bad")], "k int, id int, t int, e string")
    moves = [("pending", "ok", "approved"), ("pending", "no", "rejected")]
    assert rows(stateful.last_state(e, "k", moves, "pending", "e", "t", "id")) == [(1, "approved", 1, 1), (2, "pending", 0, 1)]


MOVES = [("pending", "ok", "approved"), ("pending", "no", "rejected"), ("approved", "undo", "pending"), ("rejected", "undo", "pending")]


def slow_states(events):
    """Brute force: key -> (state, accepted, refused)."""
    out, moves = {}, {(a, e): b for a, e, b in MOVES}
    for k, _, _, e in sorted(events, key=lambda x: (repr(x[0]), x[1], x[2])):
        state, ok, no = out.get(k, ("pending", 0, 0))
        to = moves.get((state, e))
        out[k] = (to or state, ok + (to is not None), no + (to is None))
    return out


def some_events(n, hot):
    rng = random.Random(n)
    return [("hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.randrange(n), i, rng.choice(["ok", "no", "undo", "other", None])) for i in range(n)]


def test_states_compose_over_ranges(spark):
    events = some_events(3000, 0.6)
    df = spark.createDataFrame(events, "k string, t int, id int, e string").repartition(7)
    plan = stateful.last_state(df, "k", MOVES, "pending", "e", "t", "id")
    assert {r.k: (r.state, r.accepted, r.refused) for r in plan.collect()} == slow_states(events)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    assert stateful.last_state(df.where("false"), "k", MOVES, "pending", "e", "t", "id").count() == 0


def test_composed_maps_in_any_grouping():
    rng = np.random.default_rng(0)
    group = np.sort(rng.integers(0, 9, 200))
    maps = rng.integers(0, 3, (200, 3)), rng.integers(0, 2, (200, 3)), rng.integers(0, 2, (200, 3))
    got, (to, ok, no) = stateful.composed(group, maps)
    for g, a, b, c in zip(got, to, ok, no):
        for s in range(3):
            now, x, y = s, 0, 0
            for i in np.flatnonzero(group == g):
                now, x, y = maps[0][i, now], x + maps[1][i, now], y + maps[2][i, now]
            assert (now, x, y) == (a[s], b[s], c[s])


@pytest.fixture
def state_store(spark):
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.unset(stateful.STATE_STORE[0])


def test_state_stream_goes_on_from_its_checkpoint(spark, state_store, tmp_path):
    """Killed between two runs, the stream ends where the batch does."""
    events = some_events(300, 0.5)
    schema = "k string, t int, id int, e string"
    df = spark.createDataFrame(events, schema)
    latest = {}

    def keep(batch, _):
        latest.update({r.k: (r.state, r.accepted, r.refused) for r in batch.collect()})

    for low, high in ((0, 100), (100, 200), (200, 300)):
        df.where(f"t >= {low} and t < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.read_events(spark, str(tmp_path / "in"), df.schema, 1)
        windows.run_available(stateful.state_stream(stream, "k", MOVES, "pending", "e", "t", "id"), keep, str(tmp_path / "ck"), "update")
    assert latest == slow_states(events) == {r.k: (r.state, r.accepted, r.refused) for r in stateful.last_state(df, "k", MOVES, "pending", "e", "t", "id").collect()}


def slow_answers(rows_, lifetime, most):
    """Brute force: id -> (answer, replayed), one store."""
    kept, out = {}, {}
    for i, request, t, said in sorted(rows_, key=lambda r: (r[2], r[0])):
        if request in kept and t <= kept[request][0]:
            out[i] = (kept[request][1], True)
            continue
        kept[request] = (t + lifetime, said)
        if len(kept) > most:
            for gone in sorted(kept, key=lambda k: (kept[k][0], k))[: len(kept) // 4]:
                del kept[gone]
        out[i] = (said, False)
    return out


@pytest.mark.parametrize("most", [8, 10_000])
def test_answers_stream_and_batch(spark, state_store, tmp_path, most):
    rng = random.Random(most)
    made = [(i, f"r{rng.randrange(30)}", rng.randrange(400) * 3600, f"said {i}") for i in range(400)]
    want = slow_answers(made, 86_400, most)
    df = spark.createDataFrame([(i, "s", r, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=t), a) for i, r, t, a in made], "id int, store string, request string, ts timestamp, response string")
    view = lambda out: {r.id: (r.answer, r.replayed) for r in out.collect()}
    assert view(stateful.answers(df, "store", "request", "response", "ts", "id", most=most)) == want
    if most > 400:
        assert view(stateful.first_answers(df, ["store", "request"], "response", "ts", "id")) == want
    got = {}
    for part in (df.where("ts < '2024-01-08'"), df.where("ts >= '2024-01-08'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.read_events(spark, str(tmp_path / "in"), df.schema, 1)
        windows.run_available(stateful.answer_stream(stream, "store", "request", "response", "ts", "id", most=most), lambda b, _: got.update(view(b)), str(tmp_path / "ck"))
    assert got == want


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('id,text,findspot_lat,date_approx,provenance_flags\na,"mi, ""x""",43.5,-500.0,"f1, f2"\n,larθ,bad,,\nb,,1,1,\n')
    got = {r.raw_text: r for r in readers.corpus_csv(spark, str(p)).collect()}
    assert set(got) == {'mi, "x"', "larθ"}
    assert got['mi, "x"'].date_approx == -500
    assert got["larθ"].findspot_lat is None
    assert got["larθ"].id.startswith("import_")


def test_csv_fields_over_lines(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('id,text,findspot\n1,"line one\nline ""two"",",Cere\n2,plain,Roma\n')
    assert readers.fields_over_lines(spark, str(p))
    got = {r.id: (r.raw_text, r.findspot) for r in readers.corpus_csv(spark, str(p)).collect()}
    assert got == {"1": ('line one\nline "two",', "Cere"), "2": ("plain", "Roma")}
    shape = readers.corpora(spark, [str(p)], "id string, text string, source string, language string")
    assert {r.id: r.text for r in shape.collect()} == {"1": 'line one\nline "two",', "2": "plain"}
    n = tmp_path / "n.csv"
    n.write_text('id,type,quote,comments\n1,PLACE,Clusium,"first\n\nthird, ""quoted"""\n2,PLACE,Roma,\n')
    assert {r.id: r.comment for r in readers.annotations(spark, str(n)).collect()} == {"1": 'first\n\nthird, "quoted"', "2": None}
    flat = tmp_path / "f.csv"
    flat.write_text('id,text\n1,"a ""b"" c"\n')
    assert not readers.fields_over_lines(spark, str(flat))


def test_annotations_by_alias(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("ID,Type,Quote,Tags,URL,Status\n1,PLACE,Clusium,a|b,http://x/places/413096,VERIFIED\n2,PLACE,Roma,,http://x/places/1,REJECTED\n3,PERSON,Vel,,,\n")
    a = readers.annotations(spark, str(p))
    assert a.where("quote = 'Clusium'").first().tags == ["a", "b"]
    assert [tuple(r) for r in readers.place_links(a).collect()] == [("Clusium", "413096")]


def test_tei_fields(spark):
    doc = '<TEI xmlns="u"><origDate notBefore-custom="-0500" notAfter-custom="-0401"/><origPlace><placeName>Cortona</placeName></origPlace><geo>43.2 11.9</geo><supportDesc><objectType>stela</objectType></supportDesc><div type="edition"><ab>mi</ab></div><div type="bibliography"><bibl>CIE 1</bibl></div></TEI>'
    r = readers.tei(spark.createDataFrame([(doc,), ("no",)], "xml string")).collect()
    assert (r[0].place, r[0].year, r[0].uncertainty, r[0].lat, r[0].text) == ("Cortona", -451, 49, 43.2, "mi")
    assert (r[0].object_type, r[0].bibliography) == ("stela", "CIE 1")
    assert r[1].problem == "not XML"


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n\nmi aviles\n")
    assert [r.text for r in readers.lines(spark, str(tmp_path / "t.txt")).collect()] == ["mi aviles"]
    (tmp_path / "j.jsonl").write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "j.jsonl"), "id string").count() == 2


def test_audit_appends(spark, tmp_path):
    ch = spark.createDataFrame([("a", "unknown", "verified")], "id string, old_status string, new_status string")
    for _ in range(2):
        writers.audit(ch, str(tmp_path / "audit"), "me")
    assert writers.history(spark.read.parquet(str(tmp_path / "audit")), "a").count() == 2


def test_engine(spark):
    df = spark.createDataFrame(
        [("a", "mi larθal", "Cortona", -500, 43.2, 11.9, 100.0, "t1", "etruscan", "funerary"), ("b", "mi", "Roma", None, None, None, None, "t1", "latin", "unknown")],
        "id string, canonical string, findspot string, date_approx int, findspot_lat double, findspot_lon double, findspot_uncertainty_m double, trismegistos_id string, language string, classification string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("eagle_id", "pleiades_id", "geonames_id")})
    c = Corpus(df)
    page, total = c.search(text="MI", findspot="cort")
    assert [r.id for r in page.collect()] == ["a"]
    assert total.first().total == 1
    assert c.near(43.2, 11.9, 10).first().distance_m == 0
    assert c.mates("a").first().id == "b"
    assert c.summary().first().classified == 1
    assert c.timeline().first().century == -500
    assert c.concordance("larθ").count() == 1


def test_ward_parts_two_groups():
    import numpy as np

    x = np.array([[1, 0.0], [0.9, 0.1], [0, 1.0], [0.1, 0.9]])
    y = models.ward(x, 2)
    assert y[0] == y[1] != y[2] == y[3]


def test_keyed_table_commits_whole(spark, rows, tmp_path, monkeypatch):
    """Only touched buckets are rewritten; a crash before the manifest and a lost race leave the table as it was."""
    at = str(tmp_path / "t")
    t = tables.KeyedTable(spark, at, "k", buckets=8)
    make = lambda values: spark.createDataFrame(values, "k int, v string, w string")
    assert t.version() == 0 and t.upsert(make([(i, f"v{i}", "w") for i in range(40)])) == 1
    before = t.read()
    first = t._manifest(1)
    assert t.upsert(make([(3, "new", None), (99, "added", "x")]), preserve=["w"]) == 2
    second = t._manifest(2)
    assert sum(first[b] != second[b] for b in first) <= 2
    want = sorted([(i, f"v{i}", "w") for i in range(40) if i != 3] + [(3, "new", "w"), (99, "added", "x")], key=repr)
    assert rows(t.read()) == want
    assert len(before.collect()) == 40 and rows(t.read(1)) == rows(before)
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            t.upsert(make([(4, "lost", "y")]))
    assert rows(t.read()) == want and t.version() == 2
    seen = t.version()
    assert t.upsert(make([(5, "winner", "z")]), base=seen) == 3
    with pytest.raises(tables.Conflict):
        t.upsert(make([(6, "loser", "z")]), base=seen)
    assert {r.v for r in t.read().where("k in (5, 6)").collect()} == {"winner", "v6"}
    assert t.vacuum(keep=1) and len(t.read().collect()) == 41


def decoded(body):
    """A plain decoder of tiles: layer name -> [(id, points, attributes)]."""

    def fields(b):
        i = 0

        def varint():
            nonlocal i
            n = shift = 0
            while True:
                n |= (b[i] & 0x7F) << shift
                i += 1
                if not b[i - 1] & 0x80:
                    return n
                shift += 7

        while i < len(b):
            tag = varint()
            if tag & 7 == 2:
                size = varint()
                yield tag >> 3, b[i : i + size]
                i += size
            else:
                yield tag >> 3, varint()

    def numbers(b):
        out, n, shift = [], 0, 0
        for x in b:
            n, shift = n | (x & 0x7F) << shift, shift + 7
            if not x & 0x80:
                out.append(n)
                n = shift = 0
        return out

    signed = lambda n: n >> 1 if n % 2 == 0 else -(n >> 1) - 1
    layers = {}
    for _, body_ in fields(body):
        found = list(fields(body_))
        name = next(v for k, v in found if k == 1).decode()
        keys = [v.decode() for k, v in found if k == 3]
        values = [{1: lambda v: v.decode(), 6: signed, 7: bool}[f](v) for k, b in found if k == 4 for f, v in fields(b)]
        assert (5, 4096) in found and (15, 2) in found
        out = []
        for k, b in found:
            if k == 2:
                f = dict(fields(b))
                tags, shape = numbers(f.get(2, b"")), numbers(f[4])
                places, x, y = [], 0, 0
                assert f[3] == 1 and shape[0] == 1 | (len(shape) - 1) // 2 << 3
                for dx, dy in zip(shape[1::2], shape[2::2]):
                    x, y = x + signed(dx), y + signed(dy)
                    places.append((x, y))
                out.append((f.get(1), places, {keys[a]: values[c] for a, c in zip(tags[::2], tags[1::2])}))
        assert name not in layers
        layers[name] = out
    return layers


def test_tiles_decode_to_their_points(spark):
    rng = random.Random(1)
    points = [(i, 40 + rng.random(), 9 + rng.random(), f"näme {i % 7}" if i % 5 else None, i % 3) for i in range(300)] + [(300, None, 9.0, "x", 1)]
    df = spark.createDataFrame(points, "id int, lat double, lon double, name string, kind int").repartition(4)
    got, n = {}, 2**6
    for r in tiles.vector_tiles(df, 6, "places", "id", ["name", "kind"], most=50).collect():
        for name, features in decoded(bytes(r.tile)).items():
            assert name == ("places" if r.part == 0 else f"places-{r.part}") and len(features) == r.n
            for i, [(px, py)], attributes in features:
                got[i] = ((r.x + px / 4096) / n, (r.y + py / 4096) / n, attributes)
    assert set(got) == set(range(300))
    for i, lat, lon, name, kind in points[:300]:
        x, y = (lon + 180) / 360, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2
        assert 0 <= x - got[i][0] < 1 / 4096 / n + 1e-12 and 0 <= y - got[i][1] < 1 / 4096 / n + 1e-12
        assert got[i][2] == {k: v for k, v in (("name", name), ("kind", kind)) if v is not None}
    assert decoded(tiles.layer("a", [(7, [(5, 5), (2, 9), (4096, 0)], {"n": -3, "ok": True})])) == {"a": [(7, [(5, 5), (2, 9), (4096, 0)], {"n": -3, "ok": True})]}


def test_rows_are_counted_while_written(spark, tmp_path):
    lines = [("ett", "a", [1.0]), ("lat", "b", [1.0]), ("xx", "c", [1.0]), ("ett", None, [1.0]), (None, "d", [1.0]), ("ett", "e", [2.0])]
    df = spark.createDataFrame(lines, "lang string, word string, vector array<double>")
    found = writers.counted(df, F.col("lang").isNotNull() & F.col("word").isNotNull(), F.col("lang"), ["ett", "lat", "grc"], str(tmp_path / "out"))
    assert found == {"ett": 2, "lat": 1, "grc": 0, "other": 1, "skipped": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_table_functions_equal_expressions(spark, rows):
    functions.register(spark)
    ids = spark.createDataFrame([("3-6",), ("a et b",), ("1, 2,x",), ("Cr 2.20",), ("6-3",), (None,), ("",)], "r string")
    got = spark.sql("SELECT listed AS r, id FROM expand_ids(TABLE({ids}), 'r')", ids=ids)
    assert rows(got) == rows(text.expand_ids(ids, "r"), "r", "id")
    docs = spark.createDataFrame([(1, "x", "aa"), (2, "x", "bbb"), (3, "y", None), (4, "x", "ccc")], "id int, part string, t string")
    said = spark.sql("SELECT * FROM longest_of('part', 't', TABLE({docs}) PARTITION BY part ORDER BY id)", docs=docs)
    assert rows(said) == [("x", 3, "bbb"), ("y", 1, None)]


def test_engine_pages_and_people(spark, rows):
    df = spark.createDataFrame(
        [("a", "mi larθal velus", "Cortona", 43.2, 11.9, "etruscan", "funerary", "verified", "413096", "the mi"), ("b", "velus mi", "Roma", None, None, "latin", "unknown", None, "", None), ("c", "arnθ", "Cortona", 43.3, 11.8, "etruscan", "unknown", "verified", None, "mi velus")],
        "id string, canonical string, findspot string, findspot_lat double, findspot_lon double, language string, classification string, provenance_status string, pleiades_id string, notes string",
    ).withColumn("emb_combined", F.array(F.lit(1.0), F.length("id").cast("double")))
    c = Corpus(df)
    assert rows(c.ids()) == [("a",), ("b",), ("c",)]
    assert [r.id for r in c.ranked("mi velus").collect()] == ["b", "a", "c"] and c.ranked("-x").count() == 0
    assert rows(c.provenance()) == [("unknown", 1), ("verified", 2)]
    assert c.letters("language", "mi").where("language = 'latin' and letter = 'm'").first().n == 1
    assert sum(len(decoded(bytes(r.tile))["inscriptions"]) for r in c.tiles(3).collect()) == 2
    assert '"body":"https://pleiades.stoa.org/places/413096"' in c.annotations("urn:r:").first().doc
    assert tuple(c.place_links().first()) == (3, 1, 0.3333)
    assert [r.id for r in c.hybrid(["mi", "velus", "roma"], [1.0, 1.0], rerank="words", limit=2).collect()] == ["b", "a"]
    entities = spark.createDataFrame([("1", "larθ", "spurina", "male", "a"), ("2", "velia", "lecne", "female", "a"), ("3", "vel", "lecne", "male", "b"), ("4", "x", None, None, "b")], "entity string, name string, gens string, gender string, record string")
    p = People(c, entities, spark.createDataFrame([("1", "2", "married"), ("3", "2", "father'of")], "source string, target string, kind string"))
    assert [r.entity for r in p.search(name="VEL").collect()] == ["3", "2"] and p.search(gens="lecne", gender="male").count() == 1
    assert rows(p.clan("lecne"), "id") == [("a",), ("b",)]
    assert rows(p.clans()) == [("lecne", 2, ["Cortona", "Roma"]), ("spurina", 1, ["Cortona"])]
    assert rows(p.related("spurina")) == [("lecne", 1)]
    assert rows(p.network("a"), "source_name", "target_name", "kind") == [("larθ", "velia", "married"), ("vel", "velia", "father'of")]
    assert rows(p.together()) == [("larθ", "velia", 1), ("vel", "x", 1)]
    assert [p.export(f).count() for f in ("graphml", "cypher", "json")] == [6, 6, 6]
