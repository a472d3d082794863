"""Paper records: JSON-lines and XML sources, the JSON-lines sink, and normalisation."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: ``authors`` as text takes both a list and a plain string.
RECORD = "id string, title string, abstract string, authors string, categories string"
_OAI = "header struct<_status string>, metadata struct<arXiv struct<id string, title string, abstract string, categories string, authors struct<author array<struct<keyname string, forenames string>>>>>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines and a byte order mark are skipped, a malformed line fails the read."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_oai(spark: SparkSession, path: str) -> DataFrame:
    """Records of harvested OAI-PMH pages: deleted ones are skipped, white space is single."""
    pages = spark.read.schema(_OAI).format("xml").option("rowTag", "record").option("ignoreNamespace", "true").load(path)
    rows = pages.where("metadata is not null").select("metadata.arXiv.*")
    names = F.filter(F.transform("authors.author", lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"]))), lambda n: n != "")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(text("id").alias("id"), T.clean(text("title")).alias("title"), T.clean(text("abstract")).alias("abstract"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.coalesce("categories", F.lit("")).alias("categories"))


def oai_control(spark: SparkSession, path: str) -> DataFrame:
    """Per page: its error code and resumption token ('' if none)."""
    pages = spark.read.text(path, wholetext=True)
    at = lambda what: F.xpath_string("value", F.lit(what))
    return pages.select(F.trim(at("string(//*[local-name()='error']/@code)")).alias("error"), F.trim(at("string(//*[local-name()='resumptionToken'])")).alias("token"))


def check_oai(control: DataFrame) -> None:
    """An error other than an empty selection is raised."""
    bad = control.where("error not in ('', 'noRecordsMatch')").first()
    if bad:
        raise ValueError(f"the repository answered with an error: {bad.error}")


RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, attempts: int = 6, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body; busy or failing servers are asked again after the time they name, or 10 s more each time."""
    for attempt in range(1, attempts + 1):
        try:
            with opener(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == attempts:
                raise
            wait = e.headers.get("Retry-After") if e.headers else None
            sleep(float(wait) if wait and wait.isdigit() else 10.0 * attempt)
    raise RuntimeError("no attempt was made")


def harvest_pages(base: str, selection: dict[str, str], parse: Callable[[bytes], str], get: Callable[[str], bytes] = fetch, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[bytes]:
    """Page after page, following the token that ``parse`` finds in each; the pages are then read by ``read_oai``."""
    query = {"verb": "ListRecords", "metadataPrefix": "arXiv", **selection}
    while True:
        page = get(f"{base}?{urllib.parse.urlencode(query)}")
        yield page
        token = parse(page)
        if not token:
            return
        query = {"verb": "ListRecords", "resumptionToken": token}
        sleep(pause)


# Name spaces and address of the interface.
OAI, ARXIV = "{http://www.openarchives.org/OAI/2.0/}", "{http://arxiv.org/OAI/arXiv/}"
ENDPOINT = "https://oaipmh.arxiv.org/oai"


def page_records(page: bytes) -> tuple[list[dict], str | None]:
    """The records of one page, which is bounded, and the token for the next."""
    root = ElementTree.fromstring(page)
    if (error := root.find(f"{OAI}error")) is not None:
        if error.get("code") == "noRecordsMatch":
            return [], None
        raise ValueError(f"the repository answered with an error: {error.get('code')}")
    made = []
    for paper in root.iterfind(f".//{OAI}record/{OAI}metadata/{ARXIV}arXiv"):
        field = lambda name, at=paper: (at.findtext(ARXIV + name) or "")
        names = (f"{field('forenames', a)} {field('keyname', a)}".strip() for a in paper.iter(f"{ARXIV}author"))
        made.append({"id": field("id"), "title": " ".join(field("title").split()), "abstract": " ".join(field("abstract").split()), "authors": [n for n in names if n], "categories": field("categories")})
    return made, root.findtext(f".//{OAI}resumptionToken") or None


def harvest(out: str, set_name: str = "cs", first: str | None = None, until: str | None = None, most: int = 100_000, base: str = ENDPOINT, get: Callable[[str], bytes] = fetch, sleep: Callable[[float], None] = time.sleep, log: Callable[[str], None] = lambda _: None) -> int:
    """Write the selected records, each id once, as JSON lines; returns how many."""
    chosen = {"set": set_name} | ({"from": first} if first else {}) | ({"until": until} if until else {})
    seen: set[str] = set()
    with open(out, "w", encoding="utf-8") as file:
        for page in harvest_pages(base, chosen, lambda p: page_records(p)[1], get, sleep=sleep):
            for record in page_records(page)[0]:
                if record["id"] not in seen and all(record[k] for k in ("id", "title", "abstract")) and len(seen) < most:
                    seen.add(record["id"])
                    file.write(to_json_line(record) + "\n")
            log(f"{len(seen)} records harvested")
            if len(seen) >= most:
                break
    return len(seen)


def harvested(records: DataFrame, most: int | None = None) -> DataFrame:
    """Records with id, title and abstract, each id once, at most ``most``."""
    full = records.where("coalesce(id, '') <> '' and coalesce(title, '') <> '' and coalesce(abstract, '') <> ''").dropDuplicates(["id"])
    return full.limit(most) if most is not None else full


def normalise(records: DataFrame, *carry: str) -> DataFrame:
    """Rows of the store: cleaned fields, authors joined, primary category, month of publication. carry: further columns to keep."""
    is_list = dict(records.dtypes).get("authors") == "array<string>"
    authors = F.array_join("authors", ", ") if is_list else F.coalesce(F.array_join(F.from_json("authors", "array<string>", {"mode": "PERMISSIVE"}), ", "), F.col("authors"))
    categories = T.clean(F.coalesce("categories", F.lit("")))
    return records.select(
        F.col("id").alias("arxiv_id"),
        T.clean(F.col("title")).alias("title"),
        T.clean(F.col("abstract")).alias("abstract"),
        T.clean(F.coalesce(authors, F.lit(""))).alias("authors"),
        categories.alias("categories"),
        F.when(categories == "", F.lit("unknown")).otherwise(F.split_part(categories, F.lit(" "), F.lit(1))).alias("primary_category"),
        T.published_month(F.col("id")).alias("published"),
        *carry,
    )


def to_json_line(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False)
