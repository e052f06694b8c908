"""Spec rows to fields: which field a row speaks of, by substrings of its key; the last row of a field wins.

All of it is on arrays, so it needs no shuffle. A variant's rows are folded into its fields in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of lower-case keys, in the order they are tried.
CHAIN_R = (("isbn", ("isbn",)), ("author", ("author", "লেখক")), ("publisher", ("publisher", "প্রকাশক")), ("pages", ("page", "পৃষ্ঠা")), ("edition", ("edition", "সংস্করণ")), ("language", ("language", "ভাষা")), ("country", ("country", "দেশ")), ("weight", ("weight",)))
CHAIN_P = (("isbn", ("isbn",)), ("publisher", ("publisher", "প্রকাশক")), ("title", ("title",)), ("edition", ("edition", "সংস্করণ")), ("pages", ("number of pages", "পৃষ্ঠা")), ("language", ("language", "ভাষা")), ("country", ("country", "দেশ")))
#: Independent tests on keys as written; rows of exactly two cells.
TESTS_K = {"author": "Author", "pages": "Number of Pages", "published": "Last Edition"}
VARIANTS = ("R", "P", "K")
FIELDS = ("title", "isbn", "author", "publisher", "pages", "edition", "language", "country", "weight", "published")


def _classify_sql(key: str, chain: tuple) -> str:
    tests = (" OR ".join(f"contains({key}, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in chain)
    return "CASE WHEN " + " WHEN ".join(tests) + " END"


def classify(key: str, chain: tuple = CHAIN_R) -> Column:
    """The field that a lower-case key (SQL) speaks of, or null."""
    return F.expr(_classify_sql(key, chain))


def fields_of(rows: str, variant: str) -> Column:
    """A struct with the value of each of FIELDS from a column of spec rows: that of the last row that sets it, null if none does.

    Each row is classified once, and one fold keeps the last values; variant R takes a title from
    any row whose key speaks of one, beside what else the key speaks of, and K tests keys one by one.
    """
    if variant == "K":
        fits = {"isbn": "contains(lower(r.key), 'isbn')"} | {f: f"contains(r.key, '{part}')" for f, part in TESTS_K.items()}
        cells, value = "r.n_td = 2", "r.v1"
        row = ", ".join(f"'{f}', {test}" for f, test in fits.items())
        sets = {f: f"r.{f}" for f in fits}
    else:
        chain = CHAIN_R if variant == "R" else CHAIN_P
        row = f"'field', {_classify_sql('lower(r.key)', chain)}, 'title', contains(lower(r.key), 'title')"
        sets = {f: f"r.field = '{f}'" for f, _ in chain} | ({"title": "r.title"} if variant == "R" else {})
        cells, value = "r.n_td >= 2", "r.vlast" if variant == "P" else "r.v1"
    marked = f"transform(filter({rows}, r -> {cells}), r -> named_struct({row}, 'value', {value}))"
    none = ", ".join(f"'{f}', cast(null AS string)" for f in FIELDS)
    fold = ", ".join(f"'{f}', CASE WHEN {sets[f]} THEN r.value ELSE last.{f} END" if f in sets else f"'{f}', last.{f}" for f in FIELDS)
    return F.expr(f"aggregate({marked}, named_struct({none}), (last, r) -> named_struct({fold}))")
