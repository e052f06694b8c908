"""Catalog rows from product records: the two mappings, links to partners, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_null(c: str | Column) -> Column:
    """A text, or null where it is empty: fields that are sent only if they are set."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def catalog_local(records: DataFrame) -> DataFrame:
    """Rows of the local catalog: list price is the sale price, compare price the printed one."""
    categ = F.col("categ_id") if "categ_id" in records.columns else F.lit(None).cast("long")
    links = lambda c: F.when(F.size(c) > 0, F.col(c))
    return records.select(
        "page_id",
        F.col("product_name").alias("name"),
        F.col("price").alias("list_price"),
        F.col("face_value").alias("compare_list_price"),
        F.col("ecommerce_description").alias("description_ecommerce"),
        F.col("image_url").alias("image_url_template"),
        F.lit(True).alias("is_storable"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.col("source_url").alias("publisher_link"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        links("author_ids").alias("author_ids"),
        links("publisher_ids").alias("publisher_ids"),
        categ.alias("categ_id"),
        _or_null("isbn").alias("isbn"),
        _or_null("publication_date").alias("last_edition"),
    )


def catalog_remote(records: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Rows for a remote catalog: list price is the printed price, standard price the sale price.

    images: page_id, content (binary), of downloads that succeeded; others have a null image.
    """
    from ..functions.scalars import base64_text

    image = F.lit(None).cast("string")
    if images is not None:
        records = records.join(images.select("page_id", F.col("content").alias("_content")), "page_id", "left")
        image = base64_text(F.col("_content"))
    return records.select("page_id", F.col("product_name").alias("name"), F.col("face_value").alias("list_price"), F.col("price").alias("standard_price"), F.lit("consu").alias("type"), F.lit(True).alias("is_published"), image.alias("image_1920"), F.col("ecommerce_description").alias("description_ecommerce"))


def linked_ids(relation: DataFrame, partners: DataFrame, flag: str, key: str = "wizard_id") -> DataFrame:
    """key and ids: the sorted distinct partners of each record among those that have the flag set."""
    able = partners.where(F.col(flag)).select("partner_id")
    return relation.join(able, "partner_id", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("partner_id")).alias("ids"))


def with_links(records: DataFrame, authors: DataFrame, publishers: DataFrame, key: str = "page_id") -> DataFrame:
    """Records with author_ids and publisher_ids replaced by linked_ids' results."""
    none = F.array().cast("array<long>")
    rest = records.drop("author_ids", "publisher_ids")
    for name, ids in (("author_ids", authors), ("publisher_ids", publishers)):
        rest = rest.join(ids.select(F.col(ids.columns[0]).alias(key), F.col("ids").alias(name)), key, "left").withColumn(name, F.coalesce(name, none))
    return rest.select(*records.columns)


def with_category(records: DataFrame, categories: DataFrame) -> DataFrame:
    """Records with categ_id, where their chosen category exists."""
    known = categories.select("categ_id").distinct().withColumn("_known", F.lit(True))
    return records.join(known, "categ_id", "left").withColumn("categ_id", F.when(F.col("_known"), F.col("categ_id"))).drop("_known")
