"""Readers: CSV, JSON lines, plain text, annotation tables, TEI and binary files, each to a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.operators.joins import earlier_source_wins
from stelae.operators.search import first_per

CORPUS = (
    "id string, raw_text string, canonical string, phonetic string, old_italic string, canonical_clean string, translation string, data_quality string, "
    "findspot string, findspot_lat double, findspot_lon double, findspot_uncertainty_m double, intact_token_ratio double, year_from int, year_to int, "
    "date_approx int, date_uncertainty int, medium string, object_type string, source string, bibliography string, notes string, language string, "
    "classification string, script_system string, completeness string, provenance_status string, provenance_flags array<string>, source_code string, "
    "trismegistos_id string, eagle_id string, pleiades_id string, geonames_id string, is_codex boolean"
)
#: Columns that may hold the text, in order.
TEXT_COLUMNS = ("text", "transcription", "inscription", "raw_text")
#: Headers of annotation tables and the names that stand for them.
ANNOTATION = {
    "id": "uuid id",
    "file": "file filename document",
    "kind": "type",
    "quote": "quote_transcription quote transcription",
    "label": "label",
    "tags": "tags tag",
    "comment": "comments comment",
    "uri": "uri url",
    "lat": "lat latitude",
    "lon": "lng lon longitude",
    "status": "verification_status status",
}


def safe_float(c: str | Column) -> Column:
    """Blank or malformed: null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def safe_int(c: str | Column) -> Column:
    """Through a double, cut toward zero: ``-500.0`` is -500."""
    return safe_float(c).try_cast("int")


def fields_over_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field of these files goes over lines: then some line has an odd number of quotes. Ends at the first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def raw_csv(spark: SparkSession, path: str, sep: str = ",", lines_in_fields: bool | None = None) -> DataFrame:
    """All columns as text, quotes doubled within quotes. Files are split among tasks unless quoted fields go over several lines
    (``lines_in_fields``; looked for where it is None): then each file is one task's."""
    if lines_in_fields is None:
        lines_in_fields = fields_over_lines(spark, path)
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", lines_in_fields).csv(path)


def pick_text_column(columns: list[str], wanted: str | None = None) -> str:
    lower = {c.lower(): c for c in columns}
    if wanted:
        if wanted.lower() not in lower:
            raise ValueError(f"no column {wanted!r}; found {columns}")
        return lower[wanted.lower()]
    for name in TEXT_COLUMNS:
        if name in lower:
            return lower[name]
    raise ValueError(f"no text column among {columns}; name one")


def corpus_csv(spark: SparkSession, path: str, language: str = "etruscan", lines_in_fields: bool | None = None) -> DataFrame:
    """Corpus records: the text from ``text`` or ``raw_text``; rows without text are skipped; casts that fail give null; a
    record without an id is named by a digest of its text."""
    raw = raw_csv(spark, path, lines_in_fields=lines_in_fields)
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    text = F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in ("text", "raw_text")])
    rows = raw.withColumn("_text", text).where("_text is not null")
    made = F.concat(F.lit("import_"), F.substring(F.sha2("_text", 256), 1, 12))
    return rows.select(
        F.coalesce(F.nullif(F.trim(col("id")), F.lit("")), made).alias("id"),
        F.col("_text").alias("raw_text"),
        col("findspot").alias("findspot"),
        safe_float(col("findspot_lat")).alias("findspot_lat"),
        safe_float(col("findspot_lon")).alias("findspot_lon"),
        safe_float(col("findspot_uncertainty_m")).alias("findspot_uncertainty_m"),
        safe_int(col("date_approx")).alias("date_approx"),
        safe_int(col("date_uncertainty")).alias("date_uncertainty"),
        *[col(c).alias(c) for c in ("medium", "object_type", "source", "bibliography", "notes")],
        F.coalesce(col("language"), F.lit(language)).alias("language"),
        F.coalesce(col("classification"), F.lit("unknown")).alias("classification"),
        F.filter(F.split(F.coalesce(col("provenance_flags"), F.lit("")), ","), lambda x: F.trim(x) != "").alias("provenance_flags"),
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): one record a line, blank lines and those that begin with ``#`` skipped."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> '' and not startswith(text, '#')")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or kept beside their text in ``_corrupt_record`` where ``strict``."""
    if strict:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def corpora(spark: SparkSession, paths: list[str], schema: str, lines_in_fields: bool | None = None) -> DataFrame:
    """Several corpora, CSV or JSON lines by suffix, brought to one shape (id, text, source, language); of an id the earliest path's row stays."""

    def one(path: str) -> DataFrame:
        df = raw_csv(spark, path, lines_in_fields=lines_in_fields) if path.endswith(".csv") else spark.read.schema(schema).json(path)
        col = lambda n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")
        text = F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in ("canonical_clean", "canonical", *TEXT_COLUMNS)])
        return df.select(col("id").alias("id"), text.alias("text"), col("source").alias("source"), col("language").alias("language")).where("id is not null and text is not null")

    return earlier_source_wins([one(p) for p in paths], "id")


def annotations(spark: SparkSession, path: str, lines_in_fields: bool | None = None) -> DataFrame:
    """Annotation tables, whatever their headers' case and alias; tags split at commas and bars."""
    raw = raw_csv(spark, path, lines_in_fields=lines_in_fields)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{have[n]}`") for n in names.split() if n in have), F.lit(None).cast("string"))
    out = raw.select(*[pick(v).alias(k) for k, v in ANNOTATION.items()])
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), "[|,]"), F.trim), lambda x: x != "")
    return out.withColumn("tags", tags).withColumn("lat", safe_float("lat")).withColumn("lon", safe_float("lon"))


def place_links(notes: DataFrame) -> DataFrame:
    """(quote, place_id): the first place of each quote that is not rejected, by its address."""
    ok = notes.where("lower(coalesce(status, '')) <> 'rejected' and lower(kind) = 'place' and trim(quote) <> ''")
    found = ok.withColumn("place_id", F.regexp_extract("uri", r"/places/([0-9]+)", 1)).where("place_id <> ''")
    return first_per(found.select("quote", "place_id", "id"), ["quote"], ["id"]).select("quote", "place_id")


def seed_dates(first: Column, last: Column) -> tuple[Column, Column]:
    """(year, uncertainty) from years before the era given as positive numbers: the signed midpoint and half the range."""
    a, b = safe_int(first), safe_int(last)
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    return (-F.floor((a + b) / 2)).cast("int"), F.floor(F.abs(a - b) / 2).cast("int")


def gazetteer(places: DataFrame, names: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(id, title, names, lat, lon) of places within (south, west, north, east) or without a point; variant names split at commas, each once."""
    s, w, n, e = box
    inside = F.col("lat").isNull() | F.col("lon").isNull() | (F.col("lat").between(s, n) & F.col("lon").between(w, e))
    each = names.select("id", F.explode(F.transform(F.split("name", ","), F.trim)).alias("n")).where("n <> ''").groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("variants"))
    out = places.where(inside).join(each, "id", "left")
    every = F.concat(F.array("title"), F.coalesce("variants", F.array().cast("array<string>")))
    return out.select("id", "title", F.array_distinct(every).alias("names"), "lat", "lon")


def embeddings(spark: SparkSession, path: str, own: str = "ett", own_model: str = "own", model: str = "other") -> DataFrame:
    """Vectors from JSON lines: rows without language, word or a vector are dropped, words in NFC-safe lower case, the model by language."""
    rows = spark.read.schema("lang string, word string, vector array<float>, frequency int, source string").json(path)
    rows = rows.where("trim(lang) <> '' and trim(word) <> '' and size(vector) > 0")
    return rows.withColumn("word", F.lower("word")).withColumn("embedder", F.when(F.col("lang") == own, own_model).otherwise(model))


def images(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(image_id, record, mime, sha256, size): files by their digest; the bytes stay where they are."""
    f = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m in (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("tif", "image/tiff"), ("tiff", "image/tiff"), ("webp", "image/webp"))], F.lit("application/octet-stream"))
    d = F.sha2("content", 256)
    return f.select(F.concat(F.lit(f"img_{record}_"), F.substring(d, 1, 8)).alias("image_id"), F.lit(record).alias("record"), mime.alias("mime"), d.alias("sha256"), F.col("length").alias("size"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): dividers part words, outer marks fall off, most frequent first."""
    flat = F.regexp_replace(F.lower(text), r"[·•:|]+", " ")
    w = F.explode(F.transform(F.split(flat, r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return df.select(w.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def tei(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """Records from TEI documents (id, place, year, uncertainty, lat, lon, material, object_type, bibliography, text, translation), by XPath on the XML
    without namespaces. The year is ``when-custom``, or the middle of the bounds rounded down; ids that lack are digests.
    Malformed documents keep a row with ``problem``."""
    x = F.regexp_replace(F.regexp_replace(F.col(xml), r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", ""), r"(</?)\w+:", "$1")
    x = F.regexp_replace(x, r"\s(xml):(\w+)=", " $2=")
    # parsed once in the tolerant mode, as XPath ends the job on a malformed document
    bad = F.from_xml(x, "_bad string, _any string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})["_bad"]
    ok = F.col(xml).rlike(r"(?s)^\s*<.*>\s*$") & bad.isNull()
    get = lambda path: F.nullif(F.trim(F.xpath_string(F.when(ok, x), F.lit(path))), F.lit(""))
    a, b, when = (safe_int(get(f"//origDate/@{k}")) for k in ("notBefore-custom", "notAfter-custom", "when-custom"))
    geo = F.split(get("//geo"), r"\s+")
    return texts.select(
        "*",
        F.coalesce(get("//idno[@type='filename']"), get("//publicationStmt/idno"), F.concat(F.lit("tei_"), F.substring(F.md5(F.col(xml).cast("binary")), 1, 8))).alias("id"),
        F.coalesce(get("//origPlace/placeName"), get("//origPlace")).alias("place"),
        F.coalesce(when, F.floor((a + b) / 2).cast("int")).alias("year"),
        F.when(when.isNull(), F.floor(F.abs(b - a) / 2).cast("int")).alias("uncertainty"),
        safe_float(F.try_element_at(geo, F.lit(1))).alias("lat"),
        safe_float(F.try_element_at(geo, F.lit(2))).alias("lon"),
        get("//material").alias("material"),
        get("//supportDesc//objectType").alias("object_type"),
        get("//div[@type='bibliography']//bibl").alias("bibliography"),
        get("//div[@type='edition']").alias("text"),
        get("//div[@type='translation']").alias("translation"),
        F.when(~ok, "not XML").alias("problem"),
    )


def paragraphs(files: DataFrame, content: str = "content", least: int = 20) -> DataFrame:
    """(path, n, text): paragraphs of TEI files, from the first of ``p``, ``div``, ``l`` that a file has, of ``least`` characters or more."""
    x = F.regexp_replace(F.col(content).cast("string"), r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", "")

    def of(tag: str) -> Column:
        inner = F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.filter(F.transform(inner, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))), lambda t: F.length(t) >= least)

    pick = F.when(F.size(of("p")) > 0, of("p")).when(F.size(of("div")) > 0, of("div")).otherwise(of("l"))
    return files.select("path", F.posexplode(pick).alias("n", "text"))
