"""Line and JSON sources: manifests, override files, index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, path string, sha256 string, bytes long, ext string, collection string, source string, licence string, fetchedAt string, private boolean"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A strict NDJSON manifest: a line that cannot be read fails the query; ids must be checked with
    :mod:`gridloom.operators.validate`."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def manifest_faults(spark: SparkSession, path: str) -> DataFrame:
    """(line, rule) of the lines that a strict manifest may not have: blank ones, ones that are no JSON object, and objects
    that lack a field or have one too many (the rule names the fields)."""
    names = F.array(*[F.lit(x.split()[0]) for x in MANIFEST.split(", ")])
    keys = F.json_object_keys("value")
    list_of = lambda what, a: F.when(F.size(a) > 0, F.concat(F.lit(what + ": "), F.array_join(F.array_sort(a), ", ")))
    rules = F.when(F.trim("value") == "", F.array(F.lit("blank"))).when(keys.isNull(), F.array(F.lit("no object"))).otherwise(
        F.array(list_of("missing", F.array_except(names, keys)), list_of("unknown", F.array_except(keys, names)))
    )
    lines = spark.read.text(path)
    return lines.select(F.col("value").alias("line"), F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {sheet, r, c, v or f} as (ord, sheet, r, c, t, vn, vs, vb, f). The element's text tells a number
    from a string that looks like one; an entry needs ``v`` unless it has ``f``."""
    raw = spark.read.option("wholetext", "true").text(path)
    items = F.from_json("value", "array<struct<sheet:int,r:int,c:int,v:string,f:string>>")
    kinds = F.from_json("value", "array<map<string,string>>")
    # Kinds come from the JSON itself: get_json_object keeps quotes of nested text away, so the variant's type is used.
    typed = raw.select(F.parse_json("value").alias("x"), items.alias("items"), F.size(kinds).alias("n"))
    each = typed.select("x", F.posexplode("items").alias("ord", "e"))
    path_of = F.concat(F.lit("$["), F.col("ord").cast("string"), F.lit("].v"))
    kind = F.lower(F.schema_of_variant(F.try_variant_get(F.col("x"), path_of, "variant")))
    number = kind.rlike("^(bigint|double|decimal|float|int)")
    v = F.col("e.v")
    vn, vb = F.when(number, v.try_cast("double")), F.when(kind == "boolean", v.try_cast("boolean"))
    vs = F.when(kind == "string", v)
    t = F.when(number, "n").when(kind == "boolean", "b").otherwise("s")
    return each.select("ord", "e.sheet", "e.r", "e.c", t.alias("t"), vn.alias("vn"), vs.alias("vs"), vb.alias("vb"), "e.f")


def filings(spark: SparkSession, path: str, forms: tuple[str, ...] = ("10-K", "10-Q"), base: str = "https://www.sec.gov/Archives/") -> DataFrame:
    """(form, url) of a |-delimited Latin-1 filing index: company number, name, form, date, file."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "|").option("quote", "").schema("cik string, company string, form string, filed string, file string").csv(path)
    return lines.filter(F.col("form").isin(*forms) & F.col("file").isNotNull()).select("form", F.concat(F.lit(base), "file").alias("url"))
