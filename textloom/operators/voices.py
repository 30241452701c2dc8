"""The voice catalogue as a DataFrame, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue. Ids tell region (a: US, b: UK) and gender by their first two letters.
VOICE_IDS = (
    "af_heart af_bella af_nicole af_sarah af_sky af_nova af_kore af_aoede af_alloy af_jessica af_river am_michael am_fenrir am_puck am_adam am_echo am_eric am_liam am_onyx am_santa"
    " bf_emma bf_isabella bf_alice bf_lily bm_george bm_fable bm_daniel bm_lewis"
).split()
VIBES = {
    "af_heart": "Warm, natural. Best all-rounder", "af_bella": "Expressive and bright", "af_nicole": "Soft, calm", "am_michael": "Steady, clear narrator", "am_fenrir": "Deep and strong", "bf_emma": "Polished British", "bm_george": "Classic British narrator",
}
DEFAULT_VOICE = "af_heart"


def voices(spark: SparkSession) -> DataFrame:
    """(place, id, name, region, gender, lang, vibe): 28 rows, small by nature."""
    rows = [(i, v, v[3:].capitalize(), {"a": "US", "b": "UK"}[v[0]], v[1].upper(), "en", VIBES.get(v)) for i, v in enumerate(VOICE_IDS)]
    return spark.createDataFrame(rows, "place int, id string, name string, region string, gender string, lang string, vibe string")


def voice_name(rows: DataFrame, catalogue: DataFrame, id_col: str) -> DataFrame:
    """Adds voice_name, the id itself where it is unknown."""
    names = F.broadcast(catalogue.select(F.col("id").alias("__id"), F.col("name").alias("__name")))
    return rows.join(names, F.col(id_col) == F.col("__id"), "left").withColumn("voice_name", F.coalesce("__name", id_col)).drop("__id", "__name")


def browse(catalogue: DataFrame, tab: str, search: str, favourites: list[str]) -> DataFrame:
    """Voices of a tab (all, us, uk, favorites) whose name, region, language or character holds the search text; favourites first."""
    liked = F.col("id").isin(favourites)
    in_tab = {"all": F.lit(True), "us": F.col("region") == "US", "uk": F.col("region") == "UK", "favorites": liked}[tab]
    about = F.lower(F.concat_ws(" ", "name", "region", "lang", F.coalesce("vibe", F.lit(""))))
    hit = in_tab if not search.strip() else in_tab & about.contains(search.strip().lower())
    return catalogue.filter(hit).withColumn("grp", F.when(liked, 0).otherwise(1))


def preferences(rows: DataFrame, catalogue: DataFrame, voice: str, speed: str, quality: str) -> DataFrame:
    """Stored choices with defaults in place of what is unknown."""
    known = F.broadcast(catalogue.select(F.col("id").alias("__id")))
    checked = rows.join(known, F.col(voice) == F.col("__id"), "left")
    number: Column = F.when((F.col(speed) > 0) & ~F.isnan(speed), F.col(speed))
    return checked.withColumns({voice: F.coalesce("__id", F.lit(DEFAULT_VOICE)), speed: F.coalesce(number, F.lit(1.0)), quality: F.when(F.col(quality).isin("small", "smooth"), F.col(quality)).otherwise("auto")}).drop("__id")
