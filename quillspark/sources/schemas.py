"""Explicit schemas of the JSON documents; inference would make a column of every map key."""

_TOPIC = "id string, title string, url string, sourceId string, category string, firstAt timestamp, coverage int, added int, peak int, burst int"
_ARTICLE = "id string, title string, url string, excerpt string, sourceId string, category string, publishedAt timestamp"

TREND = (
    "date date, updatedAt timestamp, until timestamp, articles int, media int, topics int, "
    "genres map<string,struct<articles:int,topics:int,heat:double>>, words map<string,struct<articles:int,media:int>>, "
    f"top array<struct<{_TOPIC}>>"
)
DIGEST = f"date date, updatedAt timestamp, total int, counts map<string,int>, items array<struct<{_ARTICLE}, coverage int>>"
FEED = "failures int, okAt timestamp, fetchedAt timestamp, count int, etag string, lastModified string, failedAt timestamp, error string"
SUMMARY = f"{_ARTICLE}, summary string, points array<string>, background string, keywords array<string>, summarizedAt timestamp"
NOTE = (
    "topic string, items array<string>, title string, firstAt timestamp, common array<struct<text:string,sources:array<string>>>, "
    "emphasis array<struct<source:string,text:string>>, differences array<struct<text:string,sources:array<string>>>, background string, interpretation string, notedAt timestamp"
)
POPULAR = "updatedAt timestamp, day array<struct<id:string,n:int>>, week array<struct<id:string,n:int>>"
REQUEST = "id string, url string, sourceId string, requestedAt timestamp"
KEY = "kid string, publicKey string, createdAt timestamp"
