"""Schemas of the tables that go in and come out."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """A schema from `name type, ...`; needs no session, as Python workers import this module too."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.add(name, T.ArrayType(_KINDS[kind[6:-1]]) if kind.startswith("array<") else _KINDS[kind])
    return out


PAGES = _struct("page_id long, url string, html string, html_specs string")
EXTRACTED = _struct(
    "page_id long, source_url string, site string, status string, errors array<string>, product_name string, authors string, "
    "publishers string, stock_qty int, ecommerce_description string, face_value double, price double, pages int, weight double, "
    "editions string, isbn string, publication_date string, language string, country string, image_url string, "
    "author_ids array<long>, publisher_ids array<long>"
)
REJECTS = _struct("page_id long, url string, host string, reason string")
CATALOG_LOCAL = _struct(
    "page_id long, name string, list_price double, compare_list_price double, description_ecommerce string, image_url_template string, "
    "is_storable boolean, pages int, publisher_link string, weight double, author_ids array<long>, publisher_ids array<long>, "
    "categ_id long, isbn string, last_edition string"
)
CATALOG_REMOTE = _struct("page_id long, name string, list_price double, standard_price double, type string, is_published boolean, image_1920 string, description_ecommerce string")
SPEC_ROW = _struct("ord int, table_idx int, n_td int, key string, v1 string, vlast string")
