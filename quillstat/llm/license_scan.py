"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-cased words of letters and digits; a shingle is
three of them.  Templates are classed by their number of shingles, the powers of
two from 1 on being the classes' greatest ones.  For a class of ``size``, windows
start at every quarter of it (each shingle, in small classes) and are as much
longer as an occurrence at any place needs to lie whole in some window.  A
window and a template of its class are a candidate if they agree in any of
``bands`` minimum hashes; the share of the template's shingles that the window
holds then decides.

What the bands guarantee: of a window that holds a template of m shingles whole
the template is at least m in ``size + size / 4 - 1``, and m is over half of
``size``: a share of 1 in classes of 1 and 2 shingles, 3/4 in that of 4, 5/9 in
that of 8, and over 2/5 in any.  24 bands of one row then miss it with a probability
under 0.6 ** 24, which is 5e-6; a window that holds ``percent`` = 80 of it has a share
over 0.29 and is missed with one under 0.71 ** 24, 3e-4.

Everything is DataFrame expressions within a row, one column of them, so a later
filter on the result stays a small plan.  Texts that share no shingle with any
template are left out before any window is made, and windows that share none with
their class before they are hashed, which loses nothing.

Defined results: null, empty and short texts hold no template; repeated rows
repeat their result; templates under three words are one shingle of their words
and are found where a text is just these words; templates without words are never
found; of several windows with the greatest share the first counts; a very long
text takes memory of some times its size; an empty table gives an empty result;
input columns named as a result column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.license_texts import TEMPLATES

SHINGLE = 3
FOUND = "array<struct<name:string,word:int,percent:double>>"
_FOUND = FOUND.replace(">>", ",variants:array<string>>>")


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _shingles(words: Column) -> Column:
    """Hashes of every three neighbouring words; fewer words are one shingle."""

    def of(w):
        every = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, every).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, of)


def _least(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def _signature(shingles: Column, size: Column, bands: int) -> Column:
    """The least hash of each band, mixed with the class and the band."""
    return F.array(*(F.xxhash64(size, F.lit(b), _least(shingles, b)) for b in range(bands)))


def prepare(spark: SparkSession, templates: dict[str, str], bands: int) -> dict[int, list[dict]]:
    """By class: name, distinct shingles, signature and variants (templates of mostly the same shingles) of each template, from the same expressions as the texts'."""
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "name string, text string")
    rows = rows.select("name", F.array_distinct(_shingles(_words(F.col("text")))).alias("s")).where("size(s) > 0")
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("s")))).cast("int")
    every = [r.asDict() for r in rows.select("name", "s", size.alias("size"), _signature(F.col("s"), size, bands).alias("keys")).orderBy("name").collect()]
    sets = {t["name"]: set(t["s"]) for t in every}
    out: dict[int, list[dict]] = {}
    for t in every:
        own = sets[t["name"]]
        t["variants"] = [n for n, other in sets.items() if n != t["name"] and 2 * len(own & other) > len(own)]
        out.setdefault(t.pop("size"), []).append(t)
    return dict(sorted(out.items()))


def _table(values, kind: str) -> Column:
    """A constant of any size as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def steps(size: int) -> tuple[int, int]:
    """How far apart the windows of a class start, and how long they are."""
    step = max(size // 4, 1)
    return step, size + step - 1


def _windows(h: Column, hits: Column, size: int, bands: int) -> Column:
    """Array of the windows of a length class that hold any of ``hits``: first word, shingles and signature."""
    step, length = steps(size)
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(step))
    windows = F.filter(F.transform(starts, lambda i: F.struct(i.alias("word"), F.slice(h, i + 1, length).alias("s"))), lambda w: F.arrays_overlap(w["s"], hits))
    return F.transform(windows, lambda w: F.struct(w["word"].alias("word"), w["s"].alias("s"), _signature(w["s"], F.lit(size), bands).alias("keys")))


def _of_class(h: Column, size: int, own: list[dict], bands: int, percent: int) -> Column:
    """Array of (name, word, percent) of the templates of a class that some window holds."""
    keys = _table(sorted({k for t in own for k in t["keys"]}), "array<bigint>")
    table = _table(own, "array<struct<name:string,s:array<bigint>,keys:array<bigint>,variants:array<string>>>")

    def best(near, t):
        shares = F.transform(F.filter(near, lambda w: F.arrays_overlap(w["keys"], t["keys"])), lambda w: F.struct((100.0 * F.size(F.array_intersect(t["s"], w["s"])) / F.size(t["s"])).alias("percent"), (-w["word"]).alias("back")))
        return _let(F.array_max(shares), lambda b: F.struct(t["name"].alias("name"), (-b["back"]).cast("int").alias("word"), b["percent"].alias("percent"), t["variants"].alias("variants")))

    def agreed(near):
        return F.when(F.size(near) > 0, F.filter(F.transform(table, lambda t: best(near, t)), lambda x: x["percent"] >= percent)).otherwise(none)

    none = F.array().cast(_FOUND)
    own_shingles = _table(sorted({x for t in own for x in t["s"]}), "array<bigint>")
    # first the windows that agree with any template in any band; those without any shingle of the class cannot
    near = lambda hits: F.filter(_windows(h, hits, size, bands), lambda w: F.arrays_overlap(w["keys"], keys))
    return _let(F.array_intersect(h, own_shingles), lambda hits: F.when(F.size(hits) > 0, _let(near(hits), agreed)).otherwise(none))


def licenses(text: Column, ready: dict[int, list[dict]], bands: int, percent: int) -> Column:
    """Sorted array of (name, word, percent) of the prepared templates that ``text`` holds."""
    none = F.array().cast(FOUND)
    if not ready:
        return none
    every = _table(sorted({x for own in ready.values() for t in own for x in t["s"]}), "array<bigint>")

    def best(found):
        beaten = lambda x: F.exists(found, lambda y: (y["percent"] > x["percent"]) & F.array_contains(x["variants"], y["name"]))
        return F.array_sort(F.transform(F.filter(found, lambda x: ~beaten(x)), lambda x: F.struct(x["name"].alias("name"), x["word"].alias("word"), x["percent"].alias("percent"))))

    found = lambda h: _let(F.concat(*(_of_class(h, size, own, bands, percent) for size, own in ready.items())), best)
    return _let(_shingles(_words(text)), lambda h: F.when(F.arrays_overlap(h, every), found(h)).otherwise(none))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", percent: int = 80, bands: int = 24) -> DataFrame:
    """``docs`` with ``licenses``: array of (name, word, percent) of the templates that ``text`` holds.

    ``word`` is the first word of the window with the largest share, ``percent``
    that share; each template is listed once.  Of templates of mostly the same
    words, as versions of a license are, those with a lesser share are left out.
    """
    ready = prepare(docs.sparkSession, TEMPLATES if templates is None else templates, bands)
    keep = [c for c in docs.columns if c.lower() != "licenses"]
    return docs.select(*(F.col(f"`{c}`") for c in keep), licenses(F.col(f"`{text}`"), ready, bands, percent).alias("licenses"))
