"""Answers of search services, failures and retries, by known answers."""

import json

from quillon.sources import providers

ANSWERS = {
    "openverse": {"results": [{"title": "Cat", "id": "1", "thumbnail": "t1", "url": "u1", "foreign_landing_url": "s1", "license": "by-sa", "license_version": "4.0"}, {"title": "", "id": 2, "url": "u2", "license": "pdm"}, {"id": "3"}]},
    "commons": {"query": {"pages": {"20": {"title": "File:Late.jpg", "imageinfo": [{"url": "u3"}]}, "9": {"title": "File:Dog.jpg", "imageinfo": [{"thumburl": "t1", "descriptionurl": "d", "extmetadata": {"LicenseShortName": {"value": "CC0"}}}]}, "3": {"title": "File:None"}}}},
    "artic": {"data": [{"id": 7, "title": None, "image_id": "ab"}, {"id": 8, "title": "x"}]},
    "met": {"objects": [{"objectID": 5, "title": "Vase", "isPublicDomain": True, "primaryImage": "big"}, {"objectID": 6, "isPublicDomain": False, "primaryImage": "p"}]},
    "inaturalist": {"results": [{"id": 1, "name": "Felis", "default_photo": {"square_url": "sq", "license_code": "cc-by-nc"}}, {"id": 2, "name": "None"}]},
}
EXPECTED = [
    ("openverse", "Cat", "t1", "s1", "CC BY-SA 4.0"), ("openverse", "2", "u2", "u2", "Public domain"), ("commons", "Dog.jpg", "t1", "d", "CC0"), ("commons", "Late.jpg", "u3", "", ""),
    ("artic", "7", "https://www.artic.edu/iiif/2/ab/full/400,/0/default.jpg", "https://www.artic.edu/artworks/7", "CC0 / public domain"),
    ("met", "Vase", "big", "https://www.metmuseum.org/art/collection/search/5", "Open Access (CC0)"), ("inaturalist", "Felis", "sq", "https://www.inaturalist.org/taxa/1", "CC BY-NC"),
]


class Refused(Exception):
    def __init__(self, status):
        super().__init__(f"HTTP {status}")
        self.status = status


def maker():
    tries = {}

    def fetch(url):
        tries[url] = tries.get(url, 0) + 1
        if url == "gone":
            raise Refused(404)
        if url == "busy" and tries[url] == 1:
            raise Refused(503)
        if url == "slow":
            raise TimeoutError("timed out")
        return json.dumps({"tries": tries[url]})

    return fetch


def test_records(spark):
    rows = [(n, json.dumps(a)) for n, a in ANSWERS.items()] + [("nobody", "{}"), ("met", None), ("artic", "no json"), ("commons", "{}")]
    got = providers.records(spark.createDataFrame(rows, "provider string, json string")).orderBy("provider_pos", "pos")
    assert [tuple(r) for r in got.select("provider", "name", "thumb_url", "source", "license").collect()] == EXPECTED


def test_discover(spark):
    rows = [(n, json.dumps(a), None, None) for n, a in ANSWERS.items() if n != "artic"] + [("artic", None, "TypeError", "x")]
    merged, ledger = providers.discover(spark.createDataFrame(rows, "provider string, json string, failure string, message string"), 4)
    assert [r["name"] for r in merged.collect()] == ["Cat", "2", "Late.jpg", "Vase"]  # the second t1 is openverse's
    assert {r["provider"]: (r["n"], r["error"]) for r in ledger.collect()} == {"openverse": (2, None), "commons": (2, None), "artic": (0, "unreachable — blocked or offline"), "met": (1, None), "inaturalist": (1, None)}


def test_retries(spark):
    rows = spark.createDataFrame([("gone",), ("busy",), ("slow",), ("fine",)], "url string")
    got = {r["url"]: (r["json"], r["failure"], r["message"]) for r in providers.asked(rows, maker).collect()}
    assert got == {"gone": (None, "Refused", "HTTP 404"), "busy": ('{"tries": 2}', None, None), "slow": (None, "TimeoutError", "timed out"), "fine": ('{"tries": 1}', None, None)}
    assert providers.asked(rows, maker, retries=0).where("url = 'busy'").first()["message"] == "HTTP 503"
