"""Reading listing and detail pages: cards, embedded JSON, key-value blocks.

Fields that a pattern can find stay in the JVM; nested elements go through the standard HTML parser in an Arrow UDF."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, set_hash

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements as [tag, attributes, children, parent]; children are elements or text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, [], None]
        self.at = self.root
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self.at = node[3]

    def handle_data(self, data):
        self.at[2].append(data)


def _all(node) -> Iterator[list]:
    for child in node[2]:
        if isinstance(child, list):
            yield child
            yield from _all(child)


def _text(node, joint: str = " ") -> str:
    parts: list[str] = []

    def walk(n):
        for child in n[2]:
            walk(child) if isinstance(child, list) else parts.append(child.strip())

    walk(node)
    return joint.join(p for p in parts if p)


def _has(node, name: str) -> bool:
    return name in node[1].get("class", "").split()


def cards(pages: DataFrame, base_url: str = "") -> DataFrame:
    """pages(page_number, html) to one row per card ``div.a-card[data-id]``: id, url (base_url and the id), price, page_number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_number"], batch["html"], strict=True):
                for card in (n for n in _all(_Tree(html or "").root) if n[0] == "div" and _has(n, "a-card") and n[1].get("data-id")):
                    price = next((_text(n) for n in _all(card) if _has(n, "a-card__price")), "")
                    rows.append((card[1]["data-id"], base_url + card[1]["data-id"], price, page))
            yield pd.DataFrame(rows, columns=["id", "url", "price_text", "page_number"])

    found = pages.select(F.col("page_number").cast("long"), "html").mapInPandas(run, "id string, url string, price_text string, page_number long")
    return found.select("id", "url", digits(F.col("price_text")).alias("price"), "page_number")


def digits(c: Column) -> Column:
    """The number that the digits of a text make, or null."""
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("bigint")


def page_count(html: Column) -> Column:
    """Pages of the listing, from the data embedded in its first page; 1 if there is none."""
    data = F.regexp_extract(html, r"(?s)window\.digitalData\s*=\s*(\{.*?\});", 1)
    return F.coalesce(F.get_json_object(data, "$.listing.pagesCount").try_cast("int"), F.lit(1))


def window_data(html: Column) -> Column:
    """The embedded JSON object of a detail page as text; null if absent or broken."""
    near = F.regexp_extract(html, r"(?s)window\.data\s*=\s*(\{.*?\});\s*</script>", 1)
    far = F.regexp_extract(html, r"window\.data\s*=\s*(\{.*\});", 1)
    found = F.when(near != "", near).otherwise(far)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def floors(text: Column) -> tuple[Column, Column]:
    """Floor and floors of "N из M"; else the first number and null."""
    both = r"(\d+)\s*из\s*(\d+)"
    pick = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("int")
    return F.coalesce(pick(both, 1), pick(r"(\d+)", 1)), pick(both, 2)


def complex_alias(href: Column) -> Column:
    """The second part of the path after /complex/show/."""
    return filled(F.regexp_extract(href, r"/complex/show/[^/]+/([^/?#]+)", 1))


def info_items(html: Column) -> Column:
    """``.offer__info-item[data-name]`` blocks as a map from name to the text of ``.offer__advert-short-info`` in them, null without one."""

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for page in batch:
                found = {}
                for node in (n for n in _all(_Tree(page or "").root) if _has(n, "offer__info-item") and n[1].get("data-name")):
                    value = next((n for n in _all(node) if _has(n, "offer__advert-short-info")), None)
                    found[node[1]["data-name"]] = None if value is None else _text(value, "")
                out.append(found)
            yield pd.Series(out)

    return run(html)


def element_text(html: Column, class_name: str) -> Column:
    """Text of the first element of a class, its parts joined by a blank; null if there is none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([next((_text(n) for n in _all(_Tree(p or "").root) if _has(n, class_name)), None) for p in batch])

    return run(html)


def complex_link(html: Column) -> Column:
    """(alias, name) of the link to the complex in the block map.complex."""

    @F.pandas_udf("struct<href:string,name:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch:
                blocks = (n for n in _all(_Tree(page or "").root) if _has(n, "offer__info-item") and n[1].get("data-name") == "map.complex")
                link = next((a for block in blocks for a in _all(block) if a[0] == "a" and "/complex/show/" in a[1].get("href", "")), None)
                rows.append((link and link[1]["href"], link and _text(link, "")))
            yield pd.DataFrame(rows, columns=["href", "name"])

    found = run(html)
    return F.struct(complex_alias(found["href"]).alias("alias"), found["name"].alias("name"))


def detail_rows(pages: DataFrame, scraped_at: Column, base_url: str = "") -> DataFrame:
    """pages(id, html) to the 37 detail columns, all text. A price of 0 counts as missing; added_at also stands for the published date."""
    from .tables import DETAIL

    html = F.col("html")
    shown = F.coalesce(element_text(html, "offer__price"), F.lit(""))
    p = pages.select("id", "html", window_data(html).alias("_d"), info_items(html).alias("_i"), complex_link(html).alias("_c"), shown.alias("_shown"))
    at = lambda path: F.get_json_object("_d", f"$.{path}")
    first = lambda *cs: F.coalesce(*(F.when(~c.isin("", "0", "false", "0.0"), c) for c in cs))
    item = lambda k: F.element_at("_i", k)
    floor, total = floors(item("flat.floor"))
    listed = F.transform(F.from_json(at("advert.photos"), "array<struct<src:string>>"), lambda x: x["src"])
    photos = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    extra = lambda k: at(f"adverts[0].{k}")
    made = {
        "id": F.col("id"), "url": F.concat(F.lit(base_url), F.col("id")), "title": at("advert.title"), "price": F.coalesce(first(at("advert.price")), digits(F.col("_shown")).cast("string")),
        "price_m2_text": extra("priceM2Text"), "price_m2": extra("priceM2"), "rooms": at("advert.rooms"), "square_m2": at("advert.square"), "floor": floor, "floor_total": total,
        **{k: at(f"advert.address.{k}") for k in ("district", "city", "street", "house_num")}, "latitude": at("advert.map.lat"), "longitude": at("advert.map.lon"),
        "complex_id": at("advert.complexId"), "complex_alias": F.col("_c.alias"), "complex_name": F.col("_c.name"), "furniture": item("live.furniture"),
        **{k: item(f"flat.{k}") for k in ("rent_renovation", "priv_dorm", "kitchen_studio", "suited_for")},
        "bathrooms_count": F.coalesce(*(F.when(item(k) != "", item(k)) for k in ("flat.bathrooms", "flat.wc", "live.bathrooms"))), "full_description": element_text(html, "js-description"),
        "photo_urls": F.to_json(photos), "photo_count": F.size(photos), "photo_set_hash": set_hash(photos), "seller_type": extra("owner.type"),
        "owner_name": first(extra("owner.title"), at("advert.ownerName")), "is_identity_confirmed": extra("owner.isChecked"), "published_date": extra("addedAt"),
        "created_at": extra("createdAt"), "added_at": extra("addedAt"), "storage": at("advert.storage"), "scraped_at": scraped_at,
    }
    return p.select(*(made[c].cast("string").alias(c) for c in DETAIL))


def fetch(requests: DataFrame, opener: Callable[[str], str], attempts: int = 3, backoff: float = 5.0) -> DataFrame:
    """(id, url) with html: null after so many failed attempts. opener gets a url and returns the page; pauses grow with the attempt."""

    def get(url: str) -> str | None:
        for i in range(attempts):
            try:
                return opener(url)
            except Exception:  # noqa: BLE001  any failure of the opener is an attempt
                if i + 1 < attempts:
                    time.sleep(backoff * (i + 1))
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(html=[get(u) for u in batch["url"]])

    return requests.select("id", "url").mapInPandas(run, "id string, url string, html string")
