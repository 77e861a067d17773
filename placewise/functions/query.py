"""Parsing of free-text address queries (TXT09, TXT10), as Column expressions.

Every token gets the first kind whose form it has; the slots of the parse are then read off the array
of tokens: first or last of a kind, what follows an anchor, what a fold leaves of the road's parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise.functions import text

# ---- fixed values: bounds, and the forms of tokens, tried in this order ----
MAX_TERMS = 8
LARGEST = 99_999
KINDS = {
    "mountain": "^산$",
    "zip": r"^\d{5}$",
    "number": r"^(산?)(\d+)(?:-(\d+))?$",
    "road_number": r"^(.+[로길])(\d+)(?:-(\d+))?$",
    "road": "[로길]$",
    "area_number": r"^(?=.*[가-힣])(.*?[동리읍면가])(산?)(\d+)(?:-(\d+))?$",
}
SEPARATORS = r"[\s,()\[\]{}]+"
AROUND_TOKENS = ".·;:'\""
AREA = r"(?:[동리읍면]|\d가)$"
BUILDING = r"^\d+동$"

#: Where the kinds of tokens with a number keep the name, the mountain mark, the main and the sub number (groups; 0: none).
_GROUPS = {"number": (0, 1, 2, 3), "road_number": (1, 0, 2, 3), "area_number": (1, 2, 3, 4)}
FIELDS = ["road", "main", "sub", "terms", "dong", "ri", "san", "bld_dong", "zipcode", "adjacent"]


def _choose(kind: Column, of: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in of.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _token(t: Column) -> Column:
    """struct(kind, word, mark, main, sub) of one token."""
    kind = F.lit("word")
    for name, form in reversed(KINDS.items()):
        kind = F.when(t.rlike(form), name).otherwise(kind)

    def group(k: int, default: Column) -> Column:
        return _choose(kind, {name: F.regexp_extract(t, KINDS[name], g[k]) for name, g in _GROUPS.items() if g[k]}, default)

    def number(k: int) -> Column:
        digits = F.regexp_replace(group(k, F.lit("")), "^0+(?=.)", "")
        return F.when(F.length(digits).between(1, 9), digits.cast("int")).when(F.length(digits) > 9, LARGEST + 1)

    name = group(0, t)
    word = F.when(kind.isin("road", "road_number"), F.regexp_replace(name, r"[.\s]", "")).when(kind.isin("word", "area_number"), F.regexp_replace(name, r"[^\p{L}\p{N}_]", "")).otherwise(name)
    return F.struct(kind.alias("kind"), word.alias("word"), (group(1, F.lit("")) != "").alias("mark"), number(2).alias("main"), F.coalesce(number(3), F.lit(0)).alias("sub"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _first(tokens: Column, which) -> Column:
    return F.get(F.filter(tokens, which), 0)


def _is_name(x: Column) -> Column:
    return x["kind"].isin("word", "area_number")


def _is_area(x: Column) -> Column:
    return _is_name(x) & (F.length(x["word"]) >= 2) & x["word"].rlike(AREA)


def _with_places(tokens: Column) -> Column:
    """Tokens with their place, and without those that only mark a mountain or hold no word; of zip codes all but the first are numbers."""
    kept = F.filter(tokens, lambda x: (x["kind"] != "mountain") & ~(_is_name(x) & (x["word"] == "")))

    def placed(ts: Column) -> Column:
        zips = F.array_position(F.transform(ts, lambda x: x["kind"]), "zip")

        def one(x: Column, i: Column) -> Column:
            again = (x["kind"] == "zip") & (i + 1 != zips)
            return F.struct(
                i.alias("at"), F.when(again, "number").otherwise(x["kind"]).alias("kind"), x["word"].alias("word"), x["mark"].alias("mark"),
                F.when(again, x["word"].cast("int")).otherwise(x["main"]).alias("main"), x["sub"].alias("sub"),
            )

        return F.transform(ts, one)

    return _bind(kept, placed)


def _slots(tokens: Column, mountain: Column) -> Column:
    building = _first(tokens, lambda x: _is_name(x) & x["word"].rlike(BUILDING))
    names = F.filter(tokens, lambda x: _is_name(x) & ~F.coalesce(x["at"] == building["at"], F.lit(False)))
    zipped = _first(tokens, lambda x: x["kind"] == "zip")
    number = _first(tokens, lambda x: x["main"].isNotNull() & (x["main"] <= LARGEST) & (x["sub"] <= LARGEST))
    dong = _first(names, _is_area)
    ri = _first(names, lambda x: (x["at"] > dong["at"]) & (x["word"] != dong["word"]) & (F.length(x["word"]) >= 2) & x["word"].endswith("리"))
    parts = F.transform(F.filter(tokens, lambda x: x["kind"].isin("road", "road_number")), lambda x: x["word"])
    road = F.aggregate(parts, F.lit(""), lambda all_, part: F.when(F.contains(all_, part), all_).otherwise(F.concat(all_, part)))
    road = F.nullif(F.regexp_replace(road, r"^(.+?)\1+$", "$1"), F.lit(""))
    anchors = F.filter(tokens, lambda x: x["kind"].isin("road", "road_number") | (_is_area(x) & ~F.coalesce(x["at"] == building["at"], F.lit(False))))
    anchored = lambda x: F.coalesce(F.exists(anchors, lambda a: a["at"] == x["at"] - 1), F.lit(False))
    found = F.struct(
        road.alias("road"), number.alias("number"), dong["word"].alias("dong"), ri["word"].alias("ri"), building["word"].alias("building"), zipped["word"].alias("zip"),
        F.coalesce((number["kind"] != "number") | anchored(number), F.lit(False)).alias("adjacent"), anchored(zipped).alias("zip_adjacent"),
        F.slice(F.array_distinct(F.transform(names, lambda x: x["word"])), 1, MAX_TERMS).alias("terms"),
        (mountain | F.exists(tokens, lambda x: x["mark"])).alias("san"),
    )

    def settled(f: Column) -> Column:
        # five digits after a road or a district are its number, if there is no other
        promoted = f["zip"].isNotNull() & f["number"].isNull() & (f["road"].isNotNull() | f["dong"].isNotNull())
        values = {
            "road": f["road"], "main": F.when(promoted, f["zip"].cast("int")).otherwise(f["number"]["main"]), "sub": F.when(promoted, 0).otherwise(f["number"]["sub"]), "terms": f["terms"],
            "dong": f["dong"], "ri": f["ri"], "san": f["san"], "bld_dong": f["building"], "zipcode": F.when(~promoted, f["zip"]), "adjacent": F.when(promoted, f["zip_adjacent"]).otherwise(f["adjacent"]),
        }
        return F.struct(*(values[name].alias(name) for name in FIELDS))

    return _bind(found, settled)


def parse_query(q: Column | str) -> Column:
    """TXT09: struct(road, main, sub, terms, dong, ri, san, bld_dong, zipcode, adjacent) of a query; a null one parses as an empty one."""
    q = F.col(q) if isinstance(q, str) else q
    joined = F.regexp_replace(F.coalesce(text.nfc(q), F.lit("")), r"(?<=\d)\.(?=\d)", "")
    tokens = F.filter(F.transform(F.split(joined, SEPARATORS), lambda t: F.btrim(t, F.lit(AROUND_TOKENS))), lambda t: t != "")
    classified = F.transform(tokens, _token)
    return _bind(classified, lambda ts: _bind(_with_places(ts), lambda placed: _slots(placed, F.exists(ts, lambda x: x["kind"] == "mountain"))))


def address_intent(p: Column) -> Column:
    """TXT10: a number stands right after what it belongs to, a district or a road."""
    return p["main"].isNotNull() & (p["dong"].isNotNull() | p["road"].isNotNull()) & p["adjacent"]
