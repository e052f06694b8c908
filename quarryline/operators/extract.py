"""Pages to product records.

One Arrow UDF walks each page once and returns strings as they stand and the spec rows. All else,
typing, spec rules, defaults and errors, is native columns on top, so the optimizer prunes and
pushes filters below the UDF and no stage shuffles. Sites that treat a field alike share its
expression, and spec rows are folded once per variant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as S
from ..plans.sites import SITES
from ..schemas import EXTRACTED, SPEC_ROW
from . import dom
from .dispatch import supported
from .profiles import FIELDS, SCALARS, SPEC_COLUMNS, Rule, Site
from .specs import FIELDS as SPEC_FIELDS
from .specs import fields_of

#: Pages of an Arrow batch; a page may have tens of KB.
BATCH_PAGES = 512
TEXT_FIELDS = tuple(f for f in EXTRACTED.names if f in FIELDS)
RAW = T.StructType([*(T.StructField(f, T.StringType()) for f in TEXT_FIELDS), T.StructField("spec_rows", T.ArrayType(SPEC_ROW)), T.StructField("missing", T.ArrayType(T.StringType()))])
SPEC = T.StructType([T.StructField(f, T.StringType()) for f in SPEC_FIELDS])


def _found(root: dom.Element, rule: Rule, strict: bool) -> str | None:
    e = next((e for e in (dom.find(root, s) for s in rule.selectors) if e is not None), None)
    if e is not None:
        return dom.READ[rule.read](e)
    return _found(root, rule.lenient, strict) if rule.lenient and not strict else None


def read_page(site: Site, html: str | None, html_specs: str | None, strict: bool = False) -> dict:
    """The strings that a site's profile finds in one page. Never raises for any string."""
    root = dom.parse(html or "")
    out: dict = {name: _found(root, rule, strict) for name, rule in site.fields.items()}
    out["missing"] = [name for name, rule in site.fields.items() if rule.required and out[name] is None]
    if site.variant:
        table = dom.parse(html_specs) if html_specs else root
        out["spec_rows"] = dom.spec_rows(table, site.spec_rows, first_table=site.variant == "P")
    else:
        out["spec_rows"] = []
    return out


def _walk(sites: list[Site], strict: bool):
    profiles, raw = {s.label: s for s in sites}, to_arrow_type(RAW)

    @F.arrow_udf(RAW)
    def walk(site: pa.Array, html: pa.Array, html_specs: pa.Array) -> pa.Array:
        rows = zip(site.to_pylist(), html.to_pylist(), html_specs.to_pylist(), strict=True)
        return pa.array([read_page(profiles[s], h, x, strict) for s, h, x in rows], raw)

    return walk.asNondeterministic()


def _of_html(kind: T.DataType, read: Callable[[str], object]):
    """An Arrow UDF that applies read to each page; null for null."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else read(h) for h in html.to_pylist()], arrow)

    return run


#: All table rows with cells of a page.
spec_rows = _of_html(T.ArrayType(SPEC_ROW), lambda h: dom.spec_rows(dom.parse(h), "table tr"))
#: A page's text: every string stripped, joined by spaces.
body_text = _of_html(T.StringType(), lambda h: dom.text_space(dom.parse(h)))
#: A page's text: every string stripped, joined without anything between.
stripped_text = _of_html(T.StringType(), lambda h: dom.text_strip(dom.parse(h)))


def first_text(selector: str, read: str = "strip"):
    """An Arrow UDF of pages: what the first element that matches a selector reads as, null where none does."""
    dom.check_selector(selector)

    def find(html: str) -> str | None:
        e = dom.find(dom.parse(html), selector)
        return None if e is None else dom.READ[read](e)

    return _of_html(T.StringType(), find)


#: Values of spec fields that aren't text, and what stands in for a missing one (variant K has nothing do so).
_SPEC_TYPED = {"pages": S.page_count, "weight": S.first_decimal}
_SPEC_DEFAULT = {"pages": 0, "weight": 0.0}


def _scalar(rule: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return rule if callable(rule) else SCALARS[rule]


def _sources(name: str, site: Site, strict: bool) -> tuple | None:
    """What a field of a site is made of: equal for sites that may share an expression."""
    if name in site.constants:
        return ("constant", site.constants[name])
    if rule := site.fields.get(name):
        return ("field", rule.strict or rule.scalar if strict else rule.scalar, rule.otherwise, rule.default)
    spec = next((f for f in site.spec_fields if SPEC_COLUMNS[f] == name), None)
    return spec and ("spec", spec, None if site.variant == "K" else _SPEC_DEFAULT.get(spec, ""))


def _value(name: str, source: tuple) -> Column:
    kind, what, *rest = source
    if kind == "constant":
        return F.lit(what)
    if kind == "spec":
        value, default = _SPEC_TYPED.get(what, lambda c: c)(F.col(f"spec.{what}")), rest[0]
    else:
        text, (otherwise, default) = F.col(f"raw.{name}"), rest
        value = _scalar(what)(text)
        if otherwise:
            value = F.when(text.isNotNull(), F.coalesce(value, _scalar(otherwise[1])(F.col(f"raw.{otherwise[0]}"))))
    return value if default is None else F.coalesce(value, F.lit(default))


def _by_site(sites: list[Site], of: Callable[[Site], object], value: Callable[[object], Column], none: Column) -> Column:
    """One branch for each different of(site) that isn't None."""
    groups: dict = {}
    for s in sites:
        if (key := of(s)) is not None:
            groups.setdefault(key, []).append(s.label)
    among = lambda labels: F.expr("site IN (" + ", ".join(f"'{x}'" for x in labels) + ")")
    out = reduce(lambda c, g: c.when(among(g[1]), value(g[0])), groups.items(), F)
    return none if out is F else out.otherwise(none)


def extract(pages: DataFrame, sites: Iterable[str | Site] | None = None, strict: bool = False) -> DataFrame:
    """Product records (schema EXTRACTED) of the pages of known sites.

    pages: page_id, url, html and, where a site needs a second look, html_specs. sites: labels of
    registered profiles or profiles of your own; all registered ones if not given. A page whose URL
    lacks its site's guard, which is compared as written, is `failed`: nothing is read from it. One
    that lacks an element its site always has is `partial`. Both say so in errors. strict keeps two
    odd readings: the first run of digits and dots as a price where thousands separators occur, and
    no description from a description block.
    """
    chosen = SITES.chosen(sites)
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAGES))
    if "html_specs" not in pages.columns:
        pages = pages.withColumn("html_specs", F.lit(None).cast("string"))
    guard = _by_site(chosen, lambda s: s.guard or None, lambda g: F.when(~F.col("url").contains(g), F.lit("guard")), F.lit(None).cast("string"))
    routed = supported(pages.select("page_id", "url", "html", "html_specs"), [s.label for s in chosen]).withColumn("guarded", guard)
    # Pages without their guard aren't read.
    html = F.when(F.col("guarded").isNull(), F.col("html"))
    walked = routed.withColumn("raw", _walk(chosen, strict)("site", html, "html_specs"))
    folded = _by_site([s for s in chosen if s.spec_fields], lambda s: s.variant, lambda v: fields_of("raw.spec_rows", v), F.lit(None).cast(SPEC))
    errors = F.when(F.col("guarded").isNull(), F.transform("raw.missing", lambda m: F.concat(F.lit("missing:"), m))).otherwise(F.array("guarded"))
    typed = walked.withColumn("spec", folded).withColumn("errors", errors)

    def column(f: T.StructField) -> Column:
        value = _by_site(chosen, lambda s: _sources(f.name, s, strict), lambda source: _value(f.name, source).cast(f.dataType), F.lit(None).cast(f.dataType))
        return F.when(F.col("guarded").isNull(), value).alias(f.name)

    none = F.array().cast("array<long>")
    status = F.when(F.col("guarded").isNotNull(), "failed").when(F.size("errors") > 0, "partial").otherwise("ok")
    return typed.select(
        "page_id", F.col("url").alias("source_url"), "site", status.alias("status"), "errors", *[column(f) for f in EXTRACTED.fields if f.name in FIELDS], none.alias("author_ids"), none.alias("publisher_ids")
    )


def merge_previous(new: DataFrame, previous: DataFrame, key: str = "page_id") -> DataFrame:
    """New records with the previous record's value wherever a field is null."""
    old = previous.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in previous.columns if c != key and c in new.columns])
    return new.join(old, key, "left").select(key, *[F.coalesce(c, f"_{c}").alias(c) if f"_{c}" in old.columns else F.col(c) for c in new.columns if c != key])
