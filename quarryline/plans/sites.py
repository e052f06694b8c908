"""The registered site profiles. Register another with SITES.register, or hand profiles to extract."""

from __future__ import annotations

from dataclasses import replace

from ..operators.profiles import Registry, Rule, Site

_STOCK = Rule(("span#available-quantity",), "strip", "first_int", 0)
_STOCK_WHOLE = Rule(("span#available-quantity",), "strip", "whole_int")
_BOOK_SPECS = ("title", "isbn", "author", "publisher", "pages", "edition", "language", "country", "weight")
_DEVICE_SPECS = ("isbn", "author", "publisher", "pages", "edition", "language", "country", "weight")
_PRESS_SPECS = ("title", "isbn", "publisher", "edition", "language", "country")
#: Never found on these sites.
_PRESS = {"authors": "", "weight": 0.0}
_SUMMARY = Rule(('h5:has-string("বই সংক্ষেপ") >> parent >> next p',), "space", "text", "")
_COVER = Rule(("div.grid img",), "src", "image_query")

SITES = Registry(
    (
        Site(
            "rokomari",
            {
                "face_value": Rule(("del.original-price", "span.price-original", "del"), "strip", "price", 0.0),
                "price": Rule(('div[class="fs-16 opacity-60"]', "span.price-current", 'span[class*="price"]'), "strip", "price", 0.0),
                "stock_qty": _STOCK,
                "ecommerce_description": Rule(("div.shortSummery_summeryText__ycsRa", 'div[class*="summary"]', 'div[itemprop="description"]'), "inner_strip", "text", ""),
                "image_url": Rule(('script[type="application/ld+json"]',), "string", "json_image"),
            },
            "R",
            guard="rokomari.com",
            spec_fields=_BOOK_SPECS,
        ),
        Site("pbs", {"ecommerce_description": _SUMMARY, "image_url": _COVER}, "P", guard="pbs.com", spec_fields=_PRESS_SPECS, constants=_PRESS),
        Site("guardianpubs", {"ecommerce_description": replace(_SUMMARY, lenient=Rule(("div.description",))), "image_url": _COVER}, "P", guard="guardianpubs.com", spec_fields=_PRESS_SPECS, constants=_PRESS),
        Site(
            "khoshrozltd",
            {
                "stock_qty": _STOCK_WHOLE,
                "product_name": Rule(('h1[class="mb-2 fs-20 fw-600"]',)),
                "face_value": Rule(('div[class="fs-16 opacity-60"]',), "strip", "digits_and_dots"),
                "price": Rule(('strong[class="h4 fw-700 text-primary"]',), "strip", "first_price", strict="first_decimal", otherwise=("face_value", "digits_and_dots")),
                "ecommerce_description": Rule(('div[class="mw-100 text-left"]',), "inner"),
                "image_url": Rule(('img[role="presentation"]',), "src"),
            },
            "K",
            "#spec-table tr",
            spec_fields=("author", "isbn", "pages", "published"),
        ),
        Site(
            "sottayon",
            {
                "stock_qty": _STOCK_WHOLE,
                "product_name": Rule(("h1.product_title",)),
                "face_value": Rule(("del .woocommerce-Price-amount bdi",), "raw", "digits_and_dots"),
                "price": Rule(("ins .woocommerce-Price-amount bdi",), "raw", "digits_and_dots"),
                "ecommerce_description": Rule(("div.woocommerce-product-details__short-description",), "inner"),
                "image_url": Rule(("img.wp-post-image",), "src"),
            },
        ),
        Site(
            "esquireelectronicsltd",
            {
                "product_name": Rule(("div.product-title",), "raw"),
                "price": Rule(("div.product-price >> in h3",), "raw", "price", 0.0, required=True),
                "face_value": Rule(("div.product-price >> in del",), "raw", "price", 0.0),
                "stock_qty": _STOCK,
                "ecommerce_description": Rule(("div.product-price >> next div.note-section",), "inner_strip", "text", ""),
                "image_url": Rule(("div.product-img-area >> in img",), "src", required=True),
            },
            "R",
            spec_fields=_DEVICE_SPECS,
        ),
        Site(
            "gadgetandgear",
            {
                "product_name": Rule(("h1.Top_productName__i6Zp2",), "raw"),
                "price": Rule(("div.product-price >> in h3",), "raw", "price", 0.0, required=True),
                "face_value": Rule(("span.ProductCard_price__t9DLm",), "raw", "price", 0.0),
                "stock_qty": _STOCK,
                "ecommerce_description": Rule(("div.Top_attribute__uEqlP >> previous",), "inner_strip", "text", "", required=True),
                "image_url": Rule(("img.Top_image__3b3Bd",), "src", required=True),
            },
            "R",
            spec_fields=_DEVICE_SPECS,
        ),
    )
)
