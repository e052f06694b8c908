"""Site profiles: what a site's pages hold and where, as data, and the registry that they are looked up in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions import scalars as S
from ..schemas import EXTRACTED
from . import dom
from .specs import VARIANTS

#: Fields that a profile may fill.
FIELDS = frozenset(EXTRACTED.names) - {"page_id", "source_url", "site", "status", "errors", "author_ids", "publisher_ids"}
#: Spec fields that a site may take over, with the column they go to.
SPEC_COLUMNS = {"title": "product_name", "isbn": "isbn", "author": "authors", "publisher": "publishers", "pages": "pages", "edition": "editions", "language": "language", "country": "country", "weight": "weight", "published": "publication_date"}
#: How a string becomes a value, by name. A profile may also give a function of a Column.
SCALARS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: c,
    "price": S.price,
    "first_price": S.first_price,
    "first_int": S.first_int,
    "whole_int": S.whole_int,
    "digits_and_dots": S.digits_and_dots,
    "first_decimal": S.first_decimal,
    "page_count": S.page_count,
    "image_query": lambda c: S.image_from_query(c, "https://pbs.com.bd"),
    "json_image": lambda c: S.json_field(c, "image"),
}


@dataclass(frozen=True)
class Rule:
    """One field of a site: the first selector that matches an element counts, even if its text is empty.

    `lenient` is for pages where none matches, unless extraction is strict; `strict` is the scalar rule
    of strict extraction, where that differs. Where an element's text gives no value, `otherwise`
    stands in: another field and how its text becomes a value. After that `default` does.
    `required` rules add to a page's errors when nothing matches.
    """

    selectors: tuple[str, ...]
    read: str = "strip"
    scalar: str | Callable[[Column], Column] = "text"
    default: object = None
    required: bool = False
    lenient: Rule | None = None
    strict: str | None = None
    otherwise: tuple[str, str] | None = None


@dataclass(frozen=True)
class Site:
    """A profile. `guard` must occur in the URL. Spec rows are classified by `variant`; `constants` are values of all its pages."""

    label: str
    fields: Mapping[str, Rule]
    variant: str | None = None
    spec_rows: str = "table tr"
    guard: str = ""
    spec_fields: tuple[str, ...] = ()
    constants: Mapping[str, object] = field(default_factory=dict)


def check(site: Site) -> None:
    """Raise ValueError for a profile that couldn't be run, and say why."""

    def need(fits: bool, what: str) -> None:
        if not fits:
            raise ValueError(f"site {site.label!r}: {what}")

    def check_rule(name: str, rule: Rule) -> None:
        need(bool(rule.selectors), f"{name} has no selector")
        for s in rule.selectors:
            dom.check_selector(s)
        need(rule.read in dom.READ, f"{name} is read as {rule.read!r}")
        for scalar in (rule.scalar, rule.strict, *(rule.otherwise or ())[1:]):
            need(scalar is None or callable(scalar) or scalar in SCALARS, f"{name} has the rule {scalar!r}")
        need(rule.otherwise is None or rule.otherwise[0] in site.fields, f"{name} falls back on a field that isn't there")
        if rule.lenient:
            check_rule(name, rule.lenient)

    need(re.fullmatch("[a-z0-9_-]+", site.label) is not None, "a label is one lower-case label of a host")
    taken = {SPEC_COLUMNS.get(f) for f in site.spec_fields}
    for name in (*site.fields, *site.constants):
        need(name in FIELDS, f"{name} is no field")
    for name, rule in site.fields.items():
        check_rule(name, rule)
    need(None not in taken, "unknown spec fields")
    need(not taken & (set(site.fields) | set(site.constants)) and not set(site.fields) & set(site.constants), "a field has two sources")
    need(site.variant in (None, *VARIANTS) and bool(site.variant) >= bool(site.spec_fields), f"variant {site.variant!r}")
    dom.check_selector(site.spec_rows)


class Registry(Mapping[str, Site]):
    """Profiles by label. Every profile is checked when it is registered, not when its first page comes."""

    def __init__(self, sites: Iterable[Site] = ()):
        self._sites: dict[str, Site] = {}
        for s in sites:
            self.register(s)

    def register(self, site: Site, replace: bool = False) -> Site:
        """Add a profile. A label that is taken is an error unless it is to be replaced."""
        check(site)
        if site.label in self._sites and not replace:
            raise ValueError(f"site {site.label!r} is registered already")
        self._sites[site.label] = site
        return site

    def chosen(self, sites: Iterable[str | Site] | None) -> list[Site]:
        """The profiles of labels of this registry or of profiles that are given as such; all of it for None."""
        return list(Registry(self[s] if isinstance(s, str) else s for s in sites).values()) if sites is not None else list(self.values())

    def __getitem__(self, label: str) -> Site:
        return self._sites[label]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sites)

    def __len__(self) -> int:
        return len(self._sites)
