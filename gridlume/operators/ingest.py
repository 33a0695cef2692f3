"""From landed JSON reports to flat incident and address rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlume.functions.scalars import fixed, js_number
from gridlume.functions.text import department_code, postal_label

#: A report as it lands; numbers or texts are read as texts, opaque parts stay JSON.
REPORT = (
    "polygon string, resultMegacache struct<compteurIncidentHTA string, compteurTravauxHTA string, compteurBT string, recap string, listeCrises string, "
    "listeCoupuresInfoReseau array<struct<idCoupure string, etatCoupure string, incidentCoupure string, codeInsee string, etatElectrique string, "
    "nbFoyersCoupes string, dateCoupure string, dateRealimentation string, listeAdresses array<struct<localisation string, nbFoyersCoupes string>>>>>"
)


def decode_json(rows: DataFrame, text: str, schema: str, out: str = "value", error: str = "error") -> DataFrame:
    """``rows`` with the decoded struct and an error text; a row that can't be read keeps its place with a null struct.

    Partial failure stays in its row: callers route rows with an error to a warnings frame and go on with the rest.
    """
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json(F.col(text)).isNotNull() & F.rlike(F.col(text), F.lit(r"^\s*[\{\[]"))
    return rows.withColumn(out, F.when(is_json, parsed)).withColumn(error, F.when(~F.coalesce(is_json, F.lit(False)), F.lit("invalid response")))


def split_failures(rows: DataFrame, label: Column, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and a frame of distinct ``warning`` texts for the others."""
    bad = rows.where(F.col(error).isNotNull()).select(F.concat(label, F.lit(": "), F.col(error)).alias("warning")).distinct()
    return rows.where(F.col(error).isNull()).drop(error), bad


def explode_incidents(reports: DataFrame) -> DataFrame:
    """One row for each incident of ``reports`` (``seq``, ``insee``, ``city``, ``report``): defaults filled, position kept.

    ``key`` is the incident's id, or place and position where it is missing; an empty id is a real key.
    """
    data = F.col("report.resultMegacache")
    rows = reports.select("seq", "insee", "city", F.posexplode(data["listeCoupuresInfoReseau"]).alias("pos", "o"))
    text = lambda name: F.coalesce(F.col(f"o.{name}"), F.lit(""))
    return rows.select(
        "seq", "insee", "city", "pos",
        F.coalesce("o.idCoupure", F.concat_ws(":", "insee", F.col("pos").cast("string"))).alias("key"),
        text("idCoupure").alias("id"), text("etatCoupure").alias("status"), text("incidentCoupure").alias("type"), F.col("o.incidentCoupure").alias("raw_type"),
        js_number(F.col("o.etatElectrique")).alias("electric_state"), text("codeInsee").alias("place_code"),
        text("dateCoupure").alias("start"), text("dateRealimentation").alias("restore"),
        js_number(F.col("o.nbFoyersCoupes")).alias("households"),
        F.transform(F.coalesce("o.listeAdresses", F.expr("array()").cast("array<struct<localisation:string,nbFoyersCoupes:string>>")), lambda a: F.struct(F.coalesce(a["localisation"], F.lit("")).alias("location"), js_number(a["nbFoyersCoupes"]).alias("households"))).alias("addresses"),
    )


def explode_addresses(incidents: DataFrame) -> DataFrame:
    """One row for each address of ``explode_incidents``' rows, duplicates and all, with its own position."""
    return incidents.select("seq", "pos", "city", "id", "raw_type", "start", "restore", F.posexplode("addresses").alias("addr_pos", "a")).select("seq", "pos", "addr_pos", "city", "id", "raw_type", "start", "restore", F.col("a.location").alias("location"), F.col("a.households").alias("households"))


def commune_query(code: Column, name: Column, postcodes: Column, center_lng: Column, center_lat: Column) -> Column:
    """The report request of a place, coordinates with six decimals."""
    return F.struct(code.alias("insee"), F.lit("municipality").alias("type"), name.alias("adresse"), postal_label(name, postcodes).alias("CPVille"), name.alias("name"), F.lit("").alias("district"), name.alias("city"), department_code(code).alias("department"), fixed(center_lng, 6).alias("longitude"), fixed(center_lat, 6).alias("latitude"))


def public_place(code: Column, name: Column, postcodes: Column, center: Column, contour: Column) -> Column:
    """A place as it is published: ``[lng, lat]`` becomes ``{lat, lng}``; JSON output leaves nulls out."""
    point = F.when(center.isNotNull(), F.struct(F.get(center, F.lit(1)).alias("lat"), F.get(center, F.lit(0)).alias("lng")))
    return F.struct(code.alias("code"), name.alias("name"), postcodes.alias("postcodes"), point.alias("center"), contour.alias("contour"))


def public_geocode(g: Column) -> Column:
    """A lookup result without its internals: the fields of its status, the others null."""
    ok, error = g["status"] == "ok", g["status"] == "error"
    field = lambda name: F.when(ok, g[name]).alias(name)
    return F.struct(g["status"].alias("status"), g["query"].alias("query"), *map(field, ("lng", "lat", "label", "score", "type", "postcode", "citycode")), F.when(error, g["message"]).alias("message"))


def geometry_request(key: Column, name: Column, geocode: Column) -> Column:
    """What is asked about a street's lines; the point only where it was found."""
    point = F.when(geocode["status"] == "ok", F.struct(geocode["lat"].alias("lat"), geocode["lng"].alias("lng")))
    return F.struct(key.alias("id"), name.alias("name"), point.alias("point"))
