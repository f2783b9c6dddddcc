"""Records as GeoJSON, JSON-LD, Turtle, GraphML, Cypher and XML text, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def geojson_feature(lat: Column, lon: Column, properties: list[Column]) -> Column:
    """A Feature; coordinates are longitude first. Null where a coordinate is missing."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    made = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    return F.when(lat.isNotNull() & lon.isNotNull(), made)


def json_ld(context: str, kind: str, uri: Column, fields: list[Column]) -> Column:
    """One JSON-LD object; null fields are left out."""
    return F.to_json(F.struct(F.lit(context).alias("@context"), F.lit(kind).alias("@type"), uri.alias("@id"), *fields))


def turtle_literal(c: Column) -> Column:
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def year_literal(year: Column) -> Column:
    """Four digits, with the sign of years before the era: ``-0500``."""
    return F.concat(F.when(year < 0, "-").otherwise(""), F.lpad(F.abs(year).cast("string"), 4, "0"))


def triples(df: DataFrame, subject: Column, predicates: dict[str, Column]) -> DataFrame:
    """(subject, predicate, object, line): one row per value present."""
    pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), o.alias("object")) for p, o in predicates.items()])
    rows = df.select(subject.alias("subject"), F.explode(pairs).alias("x")).where("x.object is not null").select("subject", "x.predicate", "x.object")
    return rows.withColumn("line", F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")))


def graphml_node(uid: Column, data: dict[str, Column]) -> Column:
    body = [F.concat(F.lit(f'<data key="{k}">'), xml_escape(v), F.lit("</data>")) for k, v in data.items()]
    return F.concat(F.lit('<node id="'), xml_escape(uid), F.lit('">'), F.concat(*[F.coalesce(b, F.lit("")) for b in body]), F.lit("</node>"))


def cypher_text(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_merge(label: str, uid: Column, fields: dict[str, Column]) -> Column:
    sets = [F.concat(F.lit(f"n.{k} = "), cypher_text(v)) for k, v in fields.items()]
    return F.concat(F.lit(f"MERGE (n:{label} {{id: "), cypher_text(uid), F.lit("}) SET "), F.concat_ws(", ", *sets), F.lit(";"))


def record_xml(uid: Column, fields: dict[str, Column]) -> Column:
    """A flat record; absent fields are left out."""
    body = [F.when(v.isNotNull(), F.concat(F.lit(f"<{k}>"), xml_escape(v), F.lit(f"</{k}>"))).otherwise("") for k, v in fields.items()]
    return F.concat(F.lit('<record id="'), xml_escape(uid), F.lit('">'), *body, F.lit("</record>"))


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, tags to blanks, the five named entities and blanks resolved, white space collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
