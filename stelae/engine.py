"""One object over a corpus: the query surface as methods that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions import markup
from stelae.functions.text import date_display
from stelae.operators import aggregates, cover, graph, joins, search, spatial, stats, vectors
from stelae.sources.tiles import vector_tiles


class Corpus:
    """A corpus DataFrame with the columns of ``stelae.sources.readers.CORPUS`` (those at hand)."""

    def __init__(self, df: DataFrame):
        self.df = df

    def search(self, text: str | None = None, findspot: str | None = None, language: str | None = None, classification: str | None = None,
               date: tuple[int | None, int | None] = (None, None), has: dict[str, bool | None] | None = None, sort: str = "id", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(page, total)."""
        lo, hi = date
        found = search.facets(
            self.df,
            contains={k: v for k, v in (("canonical", text), ("findspot", findspot)) if v},
            equals={k: v for k, v in (("language", language), ("classification", classification)) if v},
            at_least={"date_approx": lo} if lo is not None else None,
            at_most={"date_approx": hi} if hi is not None else None,
            has=has,
        )
        return search.page(search.ordered(found, sort, {"id": "id", "date": "date_approx"}), limit, offset), search.total(found)

    def get(self, record: str) -> DataFrame:
        return self.df.where(F.col("id") == record).limit(1)

    def concordance(self, keyword: str, context: int = 40) -> DataFrame:
        return search.keyword_in_context(self.df, keyword, context, "id", "canonical")

    def near(self, lat: float, lon: float, metres: float) -> DataFrame:
        return spatial.within_radius(self.df, lat, lon, metres, "findspot_lat", "findspot_lon", "findspot_uncertainty_m")

    def mates(self, record: str) -> DataFrame:
        """Records that share any outer identifier with one."""
        ids = ["trismegistos_id", "eagle_id", "pleiades_id", "geonames_id"]
        return joins.shared_identifiers(self.df, "id", ids).where(F.col("id") == record).select(F.col("mate").alias("id"))

    def summary(self) -> DataFrame:
        return aggregates.conditional_counts(self.df, {"with_coordinates": F.col("findspot_lat").isNotNull() & F.col("findspot_lon").isNotNull(), "classified": F.col("classification") != "unknown"})

    def timeline(self) -> DataFrame:
        c = self.df.where("date_approx is not null").select(aggregates.century(F.col("date_approx")).alias("century"))
        return c.groupBy("century").agg(F.count("*").alias("n")).orderBy("century")

    def similar(self, query: list[float], field: str = "emb_combined", limit: int = 10) -> DataFrame:
        if field not in ("emb_text", "emb_context", "emb_combined"):
            raise ValueError(f"no vector field {field!r}")
        return vectors.top_k(self.df, "id", field, query, limit)

    def hybrid(self, terms: list[str], query: list[float], field: str = "emb_combined", limit: int = 10, rerank: Callable[[DataFrame], Column] | str | None = None) -> DataFrame:
        """Reciprocal ranks of words and vectors fused. ``rerank`` makes a score of the rows of the best 5 * ``limit`` records (for
        instance a pandas UDF around a cross-encoder); they then come by it, equal ones by id. "words" scores the words they share."""
        if rerank == "words":
            held = F.concat(*[F.coalesce(search.words(c), F.array().cast("array<string>")) for c in ("canonical", "findspot")])
            return self.hybrid(terms, query, field, limit, lambda rows: search.lexical_score(held, terms))
        if rerank is not None:
            few = self.hybrid(terms, query, field, 5 * limit).select("id")
            rows = self.df.join(F.broadcast(few), "id")  # at most 5 * limit ids
            return rows.select("id", rerank(rows).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        wide = max(2 * limit, 20)
        sparse = self.df.select("id", search.term_rank([(search.words("canonical"), 1.0), (search.words("findspot"), 0.4)], terms).alias("s")).where("s > 0")
        a = vectors.reciprocal_ranks(sparse, [F.desc("s"), F.col("id")], "id", "a", wide)
        b = vectors.reciprocal_ranks(self.similar(query, field, wide), [F.desc("score"), F.col("id")], "id", "b", wide)
        return vectors.fuse(a, b, "id", limit)

    def ids(self) -> DataFrame:
        return self.df.select("id").orderBy("id")

    def ranked(self, query: str, limit: int = 20) -> DataFrame:
        """A web-style query by cover density: texts weigh most, then places, then notes (those at hand)."""
        fields = [(search.words(c), weight) for c, weight in (("canonical", "A"), ("findspot", "B"), ("notes", "C")) if c in self.df.columns]
        clauses = cover.clauses_of(query)
        if not clauses:
            return self.df.select("id", F.lit(0.0).alias("rank")).limit(0)
        return cover.cover_rank(self.df, "id", fields, clauses).select("id", "rank").orderBy(F.desc("rank"), "id").limit(limit)

    def provenance(self) -> DataFrame:
        """(status, n), the most frequent first."""
        return self.df.groupBy(F.coalesce("provenance_status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")

    def letters(self, by: str, alphabet: str) -> DataFrame:
        """Letter frequencies of each value of ``by`` (a language, a place)."""
        return stats.letter_frequencies(self.df, by, "canonical", alphabet)

    def tiles(self, zoom: int, attributes: tuple[str, ...] = ("classification", "findspot", "canonical")) -> DataFrame:
        """Vector tiles of the records with a point; ids must be numbers, or their hash stands for them."""
        number = self.df.schema["id"].dataType.simpleString() in ("int", "bigint", "smallint")
        rows = self.df.withColumn("_id", F.col("id") if number else F.pmod(F.xxhash64("id"), F.lit(1 << 53)))
        return vector_tiles(rows, zoom, "inscriptions", "_id", [c for c in attributes if c in self.df.columns], "findspot_lat", "findspot_lon")

    def annotations(self, base: str, place: str = "https://pleiades.stoa.org/places/") -> DataFrame:
        """(id, doc): a JSON-LD web annotation for each record that names a place of the gazetteer, the record as target, the place as body."""
        some = self.df.where(F.trim("pleiades_id") != "")
        uri = F.concat(F.lit(base), "id")
        body, target = F.concat(F.lit(place), "pleiades_id"), uri
        return some.select("id", markup.json_ld("http://www.w3.org/ns/anno.jsonld", "Annotation", F.concat(uri, F.lit("#place")), [body.alias("body"), target.alias("target")]).alias("doc"))

    def place_links(self) -> DataFrame:
        """One row: records, those with a place of the gazetteer, their share."""
        linked = F.coalesce(F.trim("pleiades_id") != "", F.lit(False))
        return self.df.agg(F.count("*").alias("total"), F.count_if(linked).alias("linked")).withColumn("share", F.when(F.col("total") > 0, F.round(F.col("linked") / F.col("total"), 4)).otherwise(0.0))

    def dated(self) -> DataFrame:
        return stats.credible_interval(stats.dating_posterior(self.df, "id", F.coalesce("canonical", F.lit(""))), "id")

    def shown(self) -> DataFrame:
        return self.df.withColumn("date_display", date_display(F.col("date_approx"), F.col("date_uncertainty")))


class People:
    """Persons named in a corpus: ``entities`` (entity, name, gens, gender, record) and ``relations`` (source, target, kind)."""

    def __init__(self, corpus: Corpus, entities: DataFrame, relations: DataFrame):
        self.corpus, self.entities, self.relations = corpus, entities, relations

    def search(self, name: str | None = None, gens: str | None = None, gender: str | None = None, limit: int = 50) -> DataFrame:
        """Persons whose name holds ``name`` (whatever the case), of a clan, of a gender."""
        found = search.facets(self.entities, contains={"name": name} if name else {}, equals={k: v for k, v in (("gens", gens), ("gender", gender)) if v})
        return search.page(found.orderBy("name", "entity"), limit)

    def clan(self, gens: str) -> DataFrame:
        """Records in which a member of the clan is named, each once."""
        held = self.entities.where(F.col("gens") == gens).select(F.col("record").alias("id")).distinct()
        return self.corpus.df.join(held, "id", "left_semi")

    def clans(self) -> DataFrame:
        """(gens, members, findspots): the clans with the places their members are named at."""
        places = self.corpus.df.select(F.col("id").alias("record"), "findspot")
        met = self.entities.where("gens is not null").join(places, "record", "left")
        return met.groupBy("gens").agg(F.count_distinct("entity").alias("members"), F.array_sort(F.collect_set("findspot")).alias("findspots"))

    def related(self, gens: str, limit: int = 20) -> DataFrame:
        """(gens, shared): clans named in the same records as this one, by the records shared."""
        own = self.entities.where(F.col("gens") == gens).select("record").distinct()
        others = self.entities.where((F.col("gens") != gens)).select("record", "gens").distinct().join(own, "record", "left_semi")
        return others.groupBy("gens").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "gens").limit(limit)

    def network(self, record: str) -> DataFrame:
        """The relations at either end of which a person of this record stands, with names."""
        around = self.entities.where(F.col("record") == record).select("entity")
        return graph.named_edges(graph.network(self.entities, self.relations, "entity", "source", "target", around), self.entities, "source", "target", "entity", "name")

    def together(self, least: int = 1) -> DataFrame:
        """(a, b, n): names that stand in ``least`` records together."""
        held = self.entities.groupBy("record").agg(F.array_sort(F.collect_set("name")).alias("names"))  # the persons of one record
        return aggregates.co_occurrence(held, "record", "names").where(F.col("n") >= least)

    def export(self, form: str) -> DataFrame:
        """(line): nodes and relations as "graphml" elements, "cypher" statements or "json" objects."""
        e, r = self.entities, self.relations
        if form == "graphml":
            nodes = e.select(markup.graphml_node(F.col("entity"), {"name": F.col("name"), "gens": F.col("gens")}).alias("line"))
            edge = F.concat(F.lit('<edge source="'), markup.xml_escape(F.col("source")), F.lit('" target="'), markup.xml_escape(F.col("target")), F.lit('"><data key="kind">'), markup.xml_escape(F.col("kind")), F.lit("</data></edge>"))
            return nodes.unionByName(r.select(edge.alias("line")))
        if form == "cypher":
            nodes = e.select(markup.cypher_merge("Person", F.col("entity"), {"name": F.col("name"), "gens": F.col("gens")}).alias("line"))
            t = markup.cypher_text
            edge = F.concat(F.lit("MATCH (a:Person {id: "), t(F.col("source")), F.lit("}), (b:Person {id: "), t(F.col("target")), F.lit("}) MERGE (a)-[:REL {kind: "), t(F.col("kind")), F.lit("}]->(b);"))
            return nodes.unionByName(r.select(edge.alias("line")))
        if form == "json":
            return e.select(F.to_json(F.struct("entity", "name", "gens", "gender", "record")).alias("line")).unionByName(r.select(F.to_json(F.struct("source", "target", "kind")).alias("line")))
        raise ValueError(f"no form {form!r}: graphml, cypher or json")
