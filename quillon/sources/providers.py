"""Search services as sources: asking them with a retry, and their JSON answers as records of one shape."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import store

#: The services in the order in which a picture they share is theirs, and how often a failure is tried again.
PROVIDERS = ("openverse", "commons", "artic", "met", "inaturalist")
RETRIES = 1

_VALUE = "struct<value:string>"
#: What is read of an answer.
SCHEMAS = {
    "openverse": "results array<struct<title:string,id:string,thumbnail:string,url:string,foreign_landing_url:string,license:string,license_version:string>>",
    "commons": f"query struct<pages:map<string,struct<title:string,imageinfo:array<struct<thumburl:string,url:string,descriptionurl:string,extmetadata:struct<LicenseShortName:{_VALUE}>>>>>>",
    "artic": "data array<struct<id:string,title:string,image_id:string>>",
    "met": "objects array<struct<objectID:string,title:string,isPublicDomain:boolean,primaryImageSmall:string,primaryImage:string,objectURL:string>>",
    "inaturalist": "results array<struct<id:string,name:string,preferred_common_name:string,default_photo:struct<medium_url:string,square_url:string,license_code:string>>>",
}


def _either(*cs: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def _record(name: Column, thumb_url: Column, source: Column, license_: Column) -> Column:
    return F.struct(name.alias("name"), thumb_url.alias("thumb_url"), source.alias("source"), license_.alias("license"))


def _openverse(x: Column) -> Column:
    code = _either(x["license"])
    named = F.trim(F.concat(F.lit("CC "), F.upper(code), F.lit(" "), F.coalesce(x["license_version"], F.lit(""))))
    return _record(_either(x["title"], x["id"]), _either(x["thumbnail"], x["url"]), _either(x["foreign_landing_url"], x["url"]), F.when(code == "", "").when(code == "cc0", "CC0").when(code == "pdm", "Public domain").otherwise(named))


def _commons(x: Column) -> Column:
    info = F.get(x["imageinfo"], F.lit(0))
    return _record(F.regexp_replace(_either(x["title"]), "^File:", ""), _either(info["thumburl"], info["url"]), _either(info["descriptionurl"]), _either(info["extmetadata"]["LicenseShortName"]["value"]))


def _artic(x: Column) -> Column:
    picture = F.when(_either(x["image_id"]) != "", F.concat(F.lit("https://www.artic.edu/iiif/2/"), x["image_id"], F.lit("/full/400,/0/default.jpg"))).otherwise("")
    return _record(_either(x["title"], x["id"]), picture, F.concat(F.lit("https://www.artic.edu/artworks/"), x["id"]), F.lit("CC0 / public domain"))


def _met(x: Column) -> Column:
    picture = F.when(F.coalesce(x["isPublicDomain"], F.lit(False)), _either(x["primaryImageSmall"], x["primaryImage"])).otherwise("")
    return _record(_either(x["title"], x["objectID"]), picture, _either(x["objectURL"], F.concat(F.lit("https://www.metmuseum.org/art/collection/search/"), x["objectID"])), F.lit("Open Access (CC0)"))


def _inaturalist(x: Column) -> Column:
    photo = x["default_photo"]
    return _record(_either(x["preferred_common_name"], x["name"]), _either(photo["medium_url"], photo["square_url"]), F.concat(F.lit("https://www.inaturalist.org/taxa/"), x["id"]), F.replace(F.upper(_either(photo["license_code"])), F.lit("CC-"), F.lit("CC ")))


READERS = {"openverse": _openverse, "commons": _commons, "artic": _artic, "met": _met, "inaturalist": _inaturalist}


def _listed(name: str, answer: Column) -> Column:
    """An answer's results in the service's order; a map's by its keys as numbers."""
    if name != "commons":
        return answer[SCHEMAS[name].split(" ", 1)[0]]
    entries = F.transform(F.map_entries(answer["query"]["pages"]), lambda e: F.struct(e["key"].cast("long").alias("n"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries, lambda a, b: F.coalesce(F.signum(a["n"] - b["n"]), F.lit(0)).cast("int")), lambda e: e["value"])


def records(answers: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(provider, provider_pos, pos, name, thumb_url, source, license) of answers (provider, json), after columns to ``keep``.

    Results without a picture drop out; so do unknown services, null answers and what isn't JSON.  One pass over
    the answers, whatever the number of services.
    """
    one = lambda n: F.transform(_listed(n, F.from_json("json", SCHEMAS[n])), lambda x, i: F.struct(i.alias("pos"), READERS[n](x).alias("r")))
    read = F.coalesce(*[F.when(F.col("provider") == n, one(n)) for n in PROVIDERS])
    place = F.coalesce(*[F.when(F.col("provider") == n, F.lit(i)) for i, n in enumerate(PROVIDERS)])
    keep = keep or []
    out = answers.select(*keep, "provider", place.alias("provider_pos"), F.explode(read).alias("x"))
    return out.select(*keep, "provider", "provider_pos", "x.pos", "x.r.*").where("thumb_url <> ''")


def asked(requests: DataFrame, make: Callable[[], Callable[[str], str]], *, retries: int = RETRIES) -> DataFrame:
    """Adds ``json`` and, for requests (url) that failed, ``failure`` and ``message``.

    ``make`` gives a worker its fetcher.  A failure is tried again ``retries`` times unless its error has a
    ``status`` under 500; no failure stops the job.
    """

    @F.pandas_udf("struct<json:string,failure:string,message:string>")
    def run(urls: pd.Series) -> pd.DataFrame:
        fetch, out = make(), []
        for url in urls:
            for left in range(retries, -1, -1):
                try:
                    out.append((fetch(url), None, None))
                    break
                except Exception as e:  # whatever a service does goes to the ledger
                    if not left or getattr(e, "status", 500) < 500:
                        out.append((None, type(e).__name__, str(e)))
                        break
        return pd.DataFrame(out, columns=["json", "failure", "message"])

    return requests.withColumn("_a", run("url")).select(*requests.columns, "_a.*")


def discover(answers: DataFrame, cap: int = 12) -> tuple[DataFrame, DataFrame]:
    """(merged, ledger) of answers (provider, json, failure, message): each picture once, and every service's count or error."""
    found = records(answers)
    why = F.when(F.col("failure").isNotNull(), text.describe_error(F.col("failure"), F.coalesce("message", F.lit(""))))
    tried = answers.groupBy("provider").agg(F.first(why, ignorenulls=True).alias("error"))
    return store.merge_providers(found, cap)[0], store.provider_ledger(tried, found)
