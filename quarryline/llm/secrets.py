"""Secret scans with DataFrame functions only: three fixed patterns and a Markov test for random strings.

The test compares two character Markov models, of random strings and of ordinary identifiers,
by the logarithm of the ratio of the likelihoods that they give to a candidate. Both are trained
from labelled samples; what a scan gets is one table of whole thousandths, so any engine that
adds integers finds the same spans.

The test sees runs of CANDIDATE_LEAST or more characters only: a random string of fewer, with no
keyword before it and of no fixed pattern, is never scored and stays.
"""

from __future__ import annotations

import json
import math
import random
import string
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, letters of the keywords in either case. Runs of access and hex are whole runs,
#: so a least length in the pattern is the same as dropping short matches.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order of their numbers.
KINDS = ("assign", "access", "hex", "random")

#: Characters of candidates lie in this range of codes; a table has one row and column for each.
LOW, HIGH = ord("+"), ord("z")
WIDTH = HIGH - LOW + 1
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
CANDIDATE_LEAST = 20
#: Matches that are gathered at once.
BLOCK = 200

#: Fixed words of which ordinary names are made; longer ones of several languages teach what letters follow each other.
WORDS = """account action address after archive before binary bottom branch buffer button cache change channel
client column config content context control copy count create current custom data default delete detail device
document domain element enable encode entry error event export field file filter first format frame function
general group handle header height import index input insert internal item label language last layout length level
library limit list local location manager master message method model module month name network node notification
number object offset option order output package page parent partition password path payment picture pointer
position previous primary process product profile project property queue random range read record reference region
register remote report request reset resource response result return root sample schedule schema screen search
second section select sequence server service session setting shipping simple source start state static status
storage stream string style summary system table target template thread time title token total transaction type
update upload user value variable vector version view warning width window workspace write year
archaeological biotechnology bureaucracy characteristic chlorophyll circumstances communication cryptography
disproportionately earthquakes electroencephalograph fluorescence heterogeneous hypothetically incomprehensible
infrastructure jurisdiction kubernetes knowledge lightweight microprocessor nevertheless neighbourhood
onomatopoeia pharmaceutical photosynthesis psychology quantitative rhythm straightforward subsequently
thermodynamics transcontinental uncharacteristically unquestionably wavelength xylophone yesterday zoological
aber nicht werden keine schule haben zwischen freiheit verantwortung entwicklung geschwindigkeit gesellschaft
wissenschaftler krankenversicherung bundesverfassungsgericht aufmerksamkeit schmetterling rechtsschutz
donaudampfschifffahrt arbeitslosigkeit wirtschaftswachstum sehenswürdigkeit zeitschrift pfingsten
avoir toujours maintenant gouvernement développement quelque monsieur ensemble anticonstitutionnellement
malheureusement aujourd approximativement bibliothèque travailleur oeuvre
siempre trabajo gobierno desarrollo nosotros ciudad también universidad electrodomésticos desafortunadamente
responsabilidad extraordinariamente izquierda guerra
przedsiębiorca szczęście wszystko chrząszcz zwierzęta krzyczeć dźwięk społeczeństwo rzeczpospolita bezpieczeństwo mężczyzna
wykształcenie przyszłość trzydzieści źródło niebezpieczny czternaście wspomnienie przyjaciel skrzydło zdziwienie
zmrzlina čtvrtek vzdělávání společnost nejkrásnější příležitost krajina hospodářství skutečnost vlastnictví prstencový
zdravstvuyte pozhaluysta vzglyad obshchestvo pravitelstvo chuvstvo svyazannyy perestroyka khrushchev dostizheniye
megszentség egészségügyi köszönöm lehetőség gyönyörű vezérigazgató kütüphane değiştirmek çekoslovakyalı güzelleştirmek
verantwoordelijkheid schoonmaakbedrijf gemeenschappelijk angstschreeuw slechtstschrijvend""".split()
#: Fixed short names of folders, sites and formats that paths and addresses are made of.
PLACES = """usr local lib bin share home users var log etc opt tmp src main test java python3 site-packages node_modules dist
build assets images img static public api v1 v2 v3 https http www com org net de fr en wiki wikipedia github blog news
index html php css js json xml pdf png jpg 2023 2024 1080 720 x86_64 utf-8 iso-8859-1 rfc2616 sha256 md5 base64""".split()
SIGNS = "-_+/"
#: Fixed: the rows of a keyboard, over which fingers walk, and what names of devices and parts end in.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
UNITS = """GB MB TB Hz GHz mm cm kg V W mAh inch pcs pack rev ver type gen mk cat usb hdmi pro plus max mini lite black white
blue red set kit board sensor cable eu us uk std iso iec din""".split()


@dataclass(frozen=True)
class RandomTest:
    """Log-likelihood ratios in thousandths for each pair of characters, and the least sum that counts as random."""

    table: tuple[int, ...]
    least: int


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, bool]]:
    """n random strings (True) of common alphabets, and 2 * n ordinary runs (False).

    The ordinary ones are names made of WORDS in the usual ways, single long words, paths and
    addresses, dates, times and counters, plain numbers, part numbers, walks over the keyboard,
    rulers, and repeated characters or words.
    """
    draw = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits[:16], string.digits + "ABCDEF"]
    out = [("".join(draw.choices(draw.choice(alphabets), k=draw.randint(20, 64))), True) for _ in range(n)]
    words = ["".join(c for c in unicodedata.normalize("NFD", w) if c.isascii()) for w in WORDS]
    joins = [lambda p: "_".join(p), lambda p: "-".join(p), lambda p: "/".join(p), lambda p: "".join(p), lambda p: p[0] + "".join(map(str.title, p[1:])), lambda p: "_".join(p).upper(), lambda p: "".join(map(str.title, p)), lambda p: "_".join(p) + str(draw.randint(0, 2030)), lambda p: "-".join(map(str.title, p)), lambda p: "+".join(p), lambda p: "".join(p).upper()]

    def date() -> str:
        sign = draw.choice(["-", "_", "/", ""])
        parts = [f"{draw.randint(1970, 2039)}", f"{draw.randint(1, 12):02d}", f"{draw.randint(1, 28):02d}"]
        return sign.join(parts if draw.random() < 0.7 else parts[::-1]) + draw.choice(["", f"T{draw.randint(0, 235959):06d}", f"_{draw.randint(0, 235959):06d}", "Z"])

    def ruler() -> str:
        unit = draw.choice([*SIGNS, *SIGNS, *string.ascii_letters, *string.digits, draw.choice(SIGNS) + draw.choice(SIGNS), draw.choice(SIGNS) * draw.randint(2, 6) + draw.choice(SIGNS), draw.choice(words), "0123456789", string.ascii_lowercase, string.ascii_uppercase])
        return unit * (1 + draw.randint(20, 80) // len(unit))

    def part() -> str:
        case = draw.choice([str.upper, str.upper, str.title, str])
        letters = lambda least, most: "".join(draw.choices(string.ascii_uppercase, k=draw.randint(least, most)))
        number = lambda least, most: str(draw.randint(10 ** (least - 1), 10**most - 1))
        forms = [
            lambda: letters(1, 3) + number(1, 4),
            lambda: letters(1, 2) + number(1, 3) + draw.choice(["", letters(1, 1)]),
            lambda: number(1, 3) + case(draw.choice(UNITS)),
            lambda: number(1, 2) + "x" + number(1, 3) + draw.choice(["", *UNITS]),
            lambda: letters(2, 3),
            lambda: number(1, 5),
            lambda: case(draw.choice(UNITS)) + number(1, 2),
        ]
        named = lambda: case(draw.choice([*words, *UNITS]))
        parts = [draw.choice(forms)() for _ in range(draw.randint(2, 3))] + [named() for _ in range(draw.randint(1, 3))]
        draw.shuffle(parts)
        return draw.choice("---_/").join(parts)

    def walk() -> str:
        out = ""
        while len(out) < 20:
            row = draw.choice(ROWS)
            out += row[draw.randint(0, len(row) - 6) :][:: draw.choice([1, 1, -1])]
        return draw.choice([str, str, str.upper])(out)

    kinds = [
        lambda: walk() if draw.random() < 0.15 else part(),
        lambda: draw.choice(joins)(draw.choices(words, k=draw.randint(2, 6))),
        lambda: draw.choice(joins)(draw.choices(words, k=draw.randint(2, 6))),
        lambda: draw.choice([str, str.title, str.upper])(max(draw.choices(words, k=4), key=len)) * draw.randint(1, 2),
        lambda: draw.choice(["/", "", "//"]) + "/".join(draw.choice([str, str, str.title])(draw.choice([draw.choice(PLACES), draw.choice(words), draw.choice(words) + draw.choice("-_") + draw.choice(words)])) for _ in range(draw.randint(3, 8))),
        lambda: draw.choice("-_/").join(date() for _ in range(draw.randint(1, 4))),
        lambda: draw.choice("-_/").join(str(draw.randint(0, 10 ** draw.randint(1, 8))) for _ in range(draw.randint(3, 9))),
        lambda: draw.choice("-_").join(draw.choice([draw.choice(words), str(draw.randint(0, 999)), draw.choice(PLACES), date()]) for _ in range(draw.randint(3, 6))),
        lambda: "".join(draw.choices(string.digits, k=draw.randint(20, 40))),
        ruler,
        lambda: draw.choice(words) + ruler() + draw.choice(words),
    ]
    return out + [(draw.choice(kinds)(), False) for _ in range(2 * n)]


def train(samples: Iterable[tuple[str, bool]], odds: float = 1000.0, smoothing: float = 0.5) -> RandomTest:
    """Two bigram models with additive smoothing; a string is random if the ratio is at least `odds`.

    Samples may come from anywhere; characters outside the table's range are skipped.
    """
    counts = {True: [smoothing] * WIDTH * WIDTH, False: [smoothing] * WIDTH * WIDTH}
    for s, is_random in samples:
        for a, b in zip(s, s[1:], strict=False):
            if LOW <= ord(a) <= HIGH and LOW <= ord(b) <= HIGH:
                counts[is_random][(ord(a) - LOW) * WIDTH + ord(b) - LOW] += 1
    table = []
    for a in range(WIDTH):
        own = {k: v[a * WIDTH : (a + 1) * WIDTH] for k, v in counts.items()}
        sums = {k: sum(v) for k, v in own.items()}
        table += [round(1000 * (math.log(own[True][b] / sums[True]) - math.log(own[False][b] / sums[False]))) for b in range(WIDTH)]
    return RandomTest(tuple(table), round(1000 * math.log(odds)))


def ratio(s: Column, test: RandomTest) -> Column:
    """The log-likelihood ratio of a string of candidates' characters, in thousandths."""
    table = F.from_json(F.lit(json.dumps(test.table)), "array<int>")
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - LOW)
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("at"), (acc["sum"] + F.coalesce(F.get(table, acc["at"] * WIDTH + c), F.lit(0))).alias("sum"))
    return F.aggregate(F.filter(codes, lambda c: c.between(0, WIDTH - 1)), start, step)["sum"]


def _spans(text: Column, pattern: str, number: int, passes) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>>, those that `passes` holds for.

    Lists grow by copying, so matches are gathered in blocks: a text with n of them costs n * (BLOCK + n / BLOCK).
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, part):
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        ok = part["hit"].isNotNull() & passes(part["hit"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def block(acc, k):
        inner = F.aggregate(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["found"], inner["found"]).alias("found"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    return F.when(text.rlike(pattern), F.aggregate(blocks, start, block)["found"]).otherwise(F.array().cast(kind))


def with_spans(docs: DataFrame, test: RandomTest, text: str = "text") -> DataFrame:
    """docs with _base and _added, sorted arrays of spans (start, kind, end) in code points, end exclusive.

    _base holds the matches of the three patterns. Candidates are cut at the base spans that they
    overlap; _added holds what remains of them, in parts that are long enough to be candidates,
    where the test takes it for random. A null or empty text has none. Other columns stay; the
    two that are added replace columns of the same names. Narrow, no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    always = lambda _: F.lit(True)
    base = F.concat(
        _spans(body, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST),
        _spans(body, ACCESS, 1, always),
        _spans(body, HEX, 2, always),
    )
    span = lambda start, end: F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def parts(c):
        def cut(acc, b):
            part = F.array(span(acc["at"], b["start"]))
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["found"], part)).otherwise(acc["found"]).alias("found"))

        over = F.filter("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        last = lambda acc: F.concat(acc["found"], F.array(span(acc["at"], c["end"])))
        return F.aggregate(over, F.struct(c["start"].alias("at"), none.alias("found")), cut, last)

    tested = lambda s: (s["end"] - s["start"] >= CANDIDATE_LEAST) & (ratio(body.substr(s["start"] + 1, s["end"] - s["start"]), test) >= test.least)
    added = F.filter(F.flatten(F.transform(_spans(body, CANDIDATE, 3, always), parts)), tested)
    return docs.withColumn("_base", F.array_sort(base)).withColumn("_added", added)


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, test: RandomTest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs.

    A null or empty text has no spans; repeated rows each have theirs; an empty table gives no rows.
    Whole texts of any length are scanned. Other columns, whatever their names, are left out.
    """
    found = with_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), test)
    n = lambda number: F.size(F.filter("_base", lambda s: s["kind"] == number)).cast("long")
    return found.select(
        F.col("key").alias(key),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame, test: RandomTest, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with each run of overlapping spans of the text replaced by mark; a null text stays null.

    The other columns of docs, whatever their names, stay as they are, in order.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    body = F.col("text")

    def step(acc, s):
        before = F.array(body.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], before)).otherwise(acc["out"]).alias("out"))

    # A struct keeps the columns' names apart from those used here.
    found = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text")), test)
    cut = F.aggregate(F.array_sort(F.concat("_base", "_added")), start, step)
    clean = F.concat(F.array_join(cut["out"], ""), body.substr(cut["at"] + 1, F.length(body)))
    clean = F.when((F.size("_base") > 0) | (F.size("_added") > 0), clean).otherwise(body)
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def report_sql(test: RandomTest) -> str:
    """secret_report over a table `documents` as DuckDB SQL, for texts whose candidates overlap no base span in part.

    It drops such a candidate whole, where secret_report tests what remains of it.
    """

    def spans(pattern: str, number: int, passes: str) -> str:
        quoted = "'" + pattern.replace("'", "''") + "'"
        hits = f"regexp_extract_all(t, {quoted})"
        # gap lengths and hit lengths alternate; a hit's start is the sum of all lengths before it
        lengths = f"list_transform(string_split_regex(t, {quoted}), lambda x: length(x))"
        return f"list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{'start': CAST(list_sum(list_slice({lengths}, 1, i)) + coalesce(list_sum(list_slice(list_transform({hits}, lambda x: length(x)), 1, i - 1)), 0) AS INT), 'kind': {number}, 'hit': {hits}[i]}}), lambda s: {passes})"

    quoted = "'" + ASSIGN.replace("'", "''") + "'"
    table = json.dumps(test.table)
    llr = f"coalesce(list_sum(list_transform(range(1, length(s.hit)), lambda k: ({table})[(ascii(s.hit[k]) - {LOW}) * {WIDTH} + ascii(s.hit[k + 1]) - {LOW} + 1])), 0) >= {test.least}"
    end = "list_transform({0}, lambda s: {{'start': s.start, 'kind': s.kind, 'end': CAST(s.start + length(s.hit) AS INT)}})"
    base = f"list_concat({spans(ASSIGN, 0, f'length(regexp_extract(s.hit, {quoted}, 2)) >= {ASSIGN_LEAST}')}, {spans(ACCESS, 1, 'true')}, {spans(HEX, 2, 'true')})"
    names = "['" + "','".join(KINDS) + "']"
    join = "coalesce(array_to_string(list_transform({0}, lambda s: {1}[s.kind + 1] || ':' || s.start || ':' || s.end_), ','), '')"
    fixed = lambda x: end.format(x).replace("'end'", "'end_'")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort({fixed(base)}) AS base, {fixed(spans(CANDIDATE, 3, llr))} AS more FROM d),
free AS (SELECT doc_id, base, list_filter(more, lambda m: len(list_filter(base, lambda b: b.start < m.end_ AND m.start < b.end_)) = 0) AS added FROM found)
SELECT doc_id,
  CAST(len(list_filter(base, lambda s: s.kind = 0)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(base, lambda s: s.kind = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(base, lambda s: s.kind = 2)) AS BIGINT) AS n_hex,
  sha256({join.format("base", names)}) AS base_sha256,
  {join.format("list_sort(list_concat(base, added))", names)} AS spans,
  CAST(len(added) AS BIGINT) AS n_random
FROM free"""
