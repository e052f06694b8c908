import pytest
from pyspark.sql import functions as F

from quarryline.operators.catalog import catalog_local, catalog_remote, linked_ids, with_category, with_links
from quarryline.operators.dispatch import rejected
from quarryline.operators import extract as extract_module
from quarryline.operators.extract import extract
from quarryline.plans.queries import generated_pages
from quarryline.operators.profiles import Registry, Rule, Site
from quarryline.operators.specs import FIELDS as SPEC_FIELDS
from quarryline.operators.specs import fields_of
from quarryline.plans.sites import SITES
from quarryline.schemas import CATALOG_LOCAL, CATALOG_REMOTE, EXTRACTED, PAGES


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, None) for i, (u, h) in enumerate(rows)], PAGES)


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_schema_and_row_count(spark):
    junk = ["", None, "<table", "<div class='product-price'>"]
    rows = [(f"https://{s}.com/p", h) for s in SITES for h in junk]
    out = extract(pages(spark, *rows))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in EXTRACTED]
    assert out.count() == len(rows)


def test_spec_rules(spark):
    html = table(("Subtitle author", "S"), ("ISBN", "1"), ("isbn", "2", "3"), ("পৃষ্ঠা", "৩২ p"), ("Weight", "Wt. 3 g"))
    r, p = extract(pages(spark, ("https://www.rokomari.com/1", html), ("https://pbs.com.bd/1", html + table(("isbn", "no"))))).orderBy("page_id").collect()
    assert (r["product_name"], r["authors"], r["isbn"], r["pages"], r["weight"]) == ("S", "S", "2", 32, 0.0)
    assert (p["product_name"], p["isbn"], p["pages"]) == ("S", "3", None)


def test_missing_and_guard(spark):
    out = extract(pages(spark, ("https://esquireelectronicsltd.com/1", "<p>x</p>"), ("https://pbs.xcom.com.pbs.com/1", ""), ("https://rokomari.com.evil.rokomari.com/", ""))).orderBy("page_id").collect()
    assert out[0]["status"] == "partial" and out[0]["errors"] == ["missing:price", "missing:image_url"] and out[0]["price"] == 0.0
    assert all(r["status"] in ("ok", "partial") for r in out)


def test_guard_stops_all_fields(spark):
    html = '<del>Tk 5</del><span id="available-quantity">3</span>' + table(("Title", "S"))
    out = extract(pages(spark, ("https://WWW.ROKOMARI.COM/1", html), ("https://www.rokomari.com/1", html))).orderBy("page_id").collect()
    assert (out[0]["status"], out[0]["errors"]) == ("failed", ["guard"])
    assert all(out[0][c] is None for c in ("product_name", "face_value", "price", "stock_qty", "isbn", "pages", "ecommerce_description"))
    assert (out[1]["status"], out[1]["product_name"], out[1]["face_value"], out[1]["stock_qty"]) == ("ok", "S", 5.0, 3)


def test_category(spark, sf):
    records = extract(generated_pages(spark, sf, "sottayon")).where("page_id <= 3").withColumn("categ_id", F.col("page_id") * 10)
    out = with_category(records, spark.createDataFrame([(10,), (30,), (30,)], "categ_id long"))
    assert {r["page_id"]: r["categ_id"] for r in out.collect()} == {0: None, 1: 10, 2: None, 3: 30}
    assert {r["categ_id"] for r in catalog_local(out).collect()} == {10, None, 30}


def test_price_falls_back_to_face_value(spark):
    html = '<div class="fs-16 opacity-60">৳12.50</div><strong class="h4 fw-700 text-primary">free</strong>'
    thousands = '<strong class="h4 fw-700 text-primary">৳1,250.00</strong>'
    df = pages(spark, ("https://khoshrozltd.com/1", html), ("https://khoshrozltd.com/2", thousands))
    assert [r["price"] for r in extract(df).orderBy("page_id").collect()] == [12.5, 1250.0]
    assert [r["price"] for r in extract(df, strict=True).orderBy("page_id").collect()] == [12.5, 1.0]


def test_second_page_of_specs(spark):
    df = spark.createDataFrame([(1, "https://khoshrozltd.com/1", "<p>", '<table id="spec-table">' + "<tr><td>Last Edition</td><td>2020</td></tr></table>")], PAGES)
    assert extract(df).first()["publication_date"] == "2020"


def test_rejects(spark):
    rows = rejected(pages(spark, ("https://x.org/", ""), ("nonsense", ""), (None, ""), ("https://a.com/", ""), ("https://pbs.com.bd/", "")), SITES).orderBy("page_id").collect()
    assert [r["reason"] for r in rows] == ["no_site", "no_host", "no_host", "Cannot import product data from a.com"]


def test_plan_is_narrow(spark, sf):
    plan = extract(generated_pages(spark, sf, "rokomari"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_catalogs(spark, sf):
    records = extract(generated_pages(spark, sf, "sottayon"))
    assert catalog_local(records).columns == CATALOG_LOCAL.names
    assert catalog_remote(records).columns == CATALOG_REMOTE.names
    local, remote = catalog_local(records).orderBy("page_id").first(), catalog_remote(records).orderBy("page_id").first()
    assert local["list_price"] == remote["standard_price"] and local["compare_list_price"] == remote["list_price"]


def test_links(spark, sf):
    records = extract(generated_pages(spark, sf, "sottayon")).where("page_id <= 2")
    partners = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "partner_id long, is_writer boolean, is_publisher boolean")
    rel = spark.createDataFrame([(1, 2), (1, 1), (1, 1), (1, 3)], "wizard_id long, partner_id long")
    out = with_links(records, linked_ids(rel, partners, "is_writer"), linked_ids(rel, partners, "is_publisher")).orderBy("page_id").collect()
    by_id = {r["page_id"]: (r["author_ids"], r["publisher_ids"]) for r in out}
    assert by_id[1] == ([1, 2], [2, 3]) and by_id[2] == ([], [])


@pytest.mark.parametrize("site", sorted(SITES))
def test_empty_table(spark, site):
    assert extract(spark.createDataFrame([], PAGES), [site]).count() == 0


SHOP = Site(
    "shop",
    {"product_name": Rule(("h1.name", "h1"), required=True), "price": Rule(("b.price",), scalar=lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("double")), "face_value": Rule(("i.was",), scalar="price", default=0.0, otherwise=("price", "digits_and_dots"))},
    variant="R",
    guard="shop.com",
    spec_fields=("isbn", "pages"),
    constants={"country": "BD"},
)


def test_a_site_of_ones_own(spark):
    """A profile that no module knows, alone and beside registered ones."""
    df = pages(spark, ("https://shop.com/1", '<h1>T</h1><b class="price">1x2</b><i class="was">none</i>' + table(("ISBN", "9"), ("Page", "12"), ("Country", "X"))), ("https://shop.com/2", ""), ("https://pbs.com.bd/1", table(("isbn", "no"))))
    one, two = extract(df, [SHOP]).orderBy("page_id").collect()
    assert (one["product_name"], one["price"], one["face_value"], one["isbn"], one["pages"], one["country"], one["status"]) == ("T", 12.0, 0.0, "9", 12, "BD", "ok")
    assert (two["status"], two["errors"], two["face_value"], two["pages"], two["country"]) == ("partial", ["missing:product_name"], 0.0, 0, "BD")
    assert [r["site"] for r in extract(df, [SHOP, "pbs"]).orderBy("page_id").collect()] == ["shop", "shop", "pbs"]
    assert [f.name for f in extract(df, [SHOP]).schema] == EXTRACTED.names


def test_registry(monkeypatch, spark):
    own = Registry(SITES.values())
    monkeypatch.setattr(extract_module, "SITES", own)
    own.register(SHOP)
    assert set(own) == {*SITES, "shop"} and "shop" not in SITES
    df = pages(spark, ("https://shop.com/1", "<h1>T</h1>"), ("https://pbs.com.bd/1", ""))
    assert {r["site"] for r in extract(df).collect()} == {"shop", "pbs"}
    with pytest.raises(ValueError, match="registered already"):
        own.register(SHOP)
    own.register(Site("shop", {"product_name": Rule(("h2",))}), replace=True)
    assert extract(df, ["shop"]).first()["product_name"] is None
    with pytest.raises(KeyError):
        extract(df, ["nowhere"])


@pytest.mark.parametrize(
    "site",
    [
        Site("a.b", {}),
        Site("Shop", {}),
        Site("it's", {}),
        Site("s", {"colour": Rule(("p",))}),
        Site("s", {"price": Rule(())}),
        Site("s", {"price": Rule(("p:first",))}),
        Site("s", {"price": Rule(("p >> up",))}),
        Site("s", {"price": Rule(("p",), read="loud")}),
        Site("s", {"price": Rule(("p",), scalar="number")}),
        Site("s", {"price": Rule(("p",), lenient=Rule(("p[",)))}),
        Site("s", {"price": Rule(("p",), otherwise=("face_value", "price"))}),
        Site("s", {}, variant="Z"),
        Site("s", {}, spec_fields=("isbn",)),
        Site("s", {}, variant="R", spec_fields=("colour",)),
        Site("s", {"isbn": Rule(("p",))}, variant="R", spec_fields=("isbn",)),
        Site("s", {}, spec_rows="tr >"),
        Site("s", {}, constants={"colour": 1}),
    ],
)
def test_bad_profiles_are_refused(site):
    with pytest.raises(ValueError):
        Registry([site])


def test_expressions_dont_grow_with_sites(spark):
    """Seven sites more that treat their fields like others add labels only."""
    size = lambda sites: len(extract(pages(spark), sites)._jdf.queryExecution().optimizedPlan().expressions().toString()) + len(extract(pages(spark), sites)._jdf.queryExecution().optimizedPlan().toString())
    more = [Site(f"{label}x", s.fields, s.variant, s.spec_rows, s.guard, s.spec_fields, s.constants) for label, s in SITES.items()]
    plan = extract(pages(spark), [*SITES.values(), *more])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 3  # one fold a variant
    assert size([*SITES.values(), *more]) < 1.3 * size(SITES.values())


def python_fields(rows, variant):
    """The rules of the three variants, row by row."""
    chain = {"R": [("isbn", ["isbn"]), ("author", ["author", "লেখক"]), ("publisher", ["publisher", "প্রকাশক"]), ("pages", ["page", "পৃষ্ঠা"]), ("edition", ["edition", "সংস্করণ"]), ("language", ["language", "ভাষা"]), ("country", ["country", "দেশ"]), ("weight", ["weight"])]}
    chain["P"] = [("isbn", ["isbn"]), ("publisher", ["publisher", "প্রকাশক"]), ("title", ["title"]), ("edition", ["edition", "সংস্করণ"]), ("pages", ["number of pages", "পৃষ্ঠা"]), ("language", ["language", "ভাষা"]), ("country", ["country", "দেশ"])]
    out = dict.fromkeys(SPEC_FIELDS)
    for n_td, key, v1, vlast in rows:
        low = key.lower()
        if variant == "K":
            if n_td == 2:
                out |= {f: v1 for f, hit in (("author", "Author" in key), ("isbn", "isbn" in low), ("pages", "Number of Pages" in key), ("published", "Last Edition" in key)) if hit}
        elif n_td >= 2:
            value = v1 if variant == "R" else vlast
            if variant == "R" and "title" in low:
                out["title"] = value
            field = next((f for f, parts in chain[variant] if any(p in low for p in parts)), None)
            if field:
                out[field] = value
    return out


@pytest.mark.parametrize("variant", ["R", "P", "K"])
def test_fold_equals_row_by_row(spark, variant):
    import random

    draw = random.Random(variant)
    keys = ["Title", "Subtitle by Author", "ISBN-13", "isbn title", "Author", "author", "লেখক", "Publisher", "প্রকাশক", "Number of Pages", "Page", "পৃষ্ঠা", "Edition", "Last Edition", "ভাষা", "Country page", "দেশ", "Weight", "other", ""]
    tables = [[(draw.randint(1, 3), draw.choice(keys), f"a{i}", f"b{i}") for i in range(draw.randint(0, 12))] for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(tables)), "id int, rows array<struct<n_td: int, key: string, v1: string, vlast: string>>")
    got = df.withColumn("f", fields_of("rows", variant)).select("id", "f.*").orderBy("id").collect()
    assert [r.asDict() for r in got] == [{"id": i} | python_fields(t, variant) for i, t in enumerate(tables)]
