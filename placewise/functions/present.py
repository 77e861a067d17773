"""Address strings and response structures (PRJ02, PRJ08, PRJ10, PRJ14 to PRJ17) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise.functions import codes, text

#: Kinds that aren't addresses, with the labels of those that have one; short province names (fixed values).
KIND_LABELS = {"station": "역", "place": "장소", "dong": "행정구역", "road": "도로"}
CATEGORY_KINDS = ["poi", "biz", "facility"]
SIDO_SHORT = {
    "서울특별시": "서울", "부산광역시": "부산", "대구광역시": "대구", "인천광역시": "인천", "광주광역시": "광주", "대전광역시": "대전",
    "울산광역시": "울산", "세종특별자치시": "세종", "경기도": "경기", "충청북도": "충북", "충청남도": "충남", "전라남도": "전남",
    "경상북도": "경북", "경상남도": "경남", "제주특별자치도": "제주", "강원특별자치도": "강원", "전북특별자치도": "전북", "전남광주통합특별시": "전남광주",
}


def shown(c: Column) -> Column:
    """The trimmed text; null if it is blank or the word None."""
    s = F.trim(c.cast("string"))
    return F.when(~s.isin("", "None"), s)


def search_text(name: Column, road: Column, jibun: Column) -> Column:
    """PRJ02: the three with single spaces between, also round missing ones; only the ends are trimmed."""
    return F.trim(F.concat(text.blank(name), F.lit(" "), text.blank(road), F.lit(" "), text.blank(jibun)))


def number_label(main: Column, sub: Column) -> Column:
    return F.when(shown(main).isNotNull(), F.concat(shown(main), F.when(F.coalesce(sub.cast("long"), F.lit(0)) != 0, F.concat(F.lit("-"), sub.cast("string"))).otherwise("")))


def bracketed(bld: Column) -> Column:
    return F.when(shown(bld).isNotNull(), F.concat(F.lit("("), shown(bld), F.lit(")")))


def address_line(sido: Column, sigungu: Column, emd: Column, road: Column, main: Column, sub: Column, bld: Column) -> Column:
    """PRJ14: the full line of an address."""
    return F.concat_ws(" ", shown(codes.remap_sido_name(sido)), shown(sigungu), shown(emd), shown(road), number_label(main, sub), bracketed(bld))


def road_line(sido: Column, sigungu: Column, emd: Column, road: Column, main: Column, sub: Column, bld: Column) -> Column:
    """PRJ14: as ``address_line``; of the township names only those that end in 읍 or 면."""
    return address_line(sido, sigungu, F.when(shown(emd).rlike("(읍|면)$"), emd), road, main, sub, bld)


def parcel_line(sido: Column, sigungu: Column, emd: Column, jibun: Column) -> Column:
    """PRJ14."""
    return F.concat_ws(" ", shown(codes.remap_sido_name(sido)), shown(sigungu), F.coalesce(shown(jibun), shown(emd)))


def category(cat1: Column, cat2: Column, subtype: Column) -> Column:
    """PRJ17: struct(primary, label, group, path, sub); null without any."""
    c1, c2 = shown(cat1), shown(cat2)
    whole = F.struct(c1.alias("primary"), F.concat_ws(" > ", c1, c2).alias("label"), c1.alias("group"), F.concat_ws(">", c1, c2).alias("path"), c2.alias("sub"))
    none = F.lit(None).cast("string")
    only = F.struct(none.alias("primary"), shown(subtype).alias("label"), none.alias("group"), none.alias("path"), none.alias("sub"))
    return F.when(c1.isNotNull(), whole).when(shown(subtype).isNotNull(), only)


def region(sido: Column, sigungu: Column, emd: Column | None = None, official: bool = False) -> Column:
    s = shown(codes.remap_sido_name(sido))
    if not official:
        s = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SIDO_SHORT.items() for x in kv)), s), s)
    out = F.concat_ws(" ", s, shown(sigungu), *([shown(emd)] if emd is not None else []))
    return F.when(out != "", out)


def display(c: dict[str, Column]) -> Column:
    """PRJ15: struct(main, secondary, full) of a place.

    ``c``: kind, name, sido, sigungu, emd, ri, road, main_no, sub_no, bld, postal, jibun, cat1, cat2, subtype."""
    name = F.coalesce(shown(c["name"]), F.lit(""))
    road = shown(c["road"])
    line = F.concat_ws(" ", road, number_label(c["main_no"], c["sub_no"]), bracketed(c["bld"]))
    near = region(c["sido"], c["sigungu"], c["emd"])
    road_form = F.struct(
        line.alias("main"),
        F.when(near.isNotNull() & shown(c["postal"]).isNotNull(), F.concat(near, F.lit(" ("), shown(c["postal"]), F.lit(")"))).otherwise(near).alias("secondary"),
        F.concat_ws(" ", region(c["sido"], c["sigungu"], c["emd"], official=True), line).alias("full"),
    )
    lot = F.nullif(text.clean_lot(c["jibun"]), F.lit(""))
    place = F.concat_ws(" ", shown(c["emd"]), shown(c["ri"]), lot)
    full = F.concat_ws(" ", region(c["sido"], c["sigungu"], official=True), shown(c["emd"]), shown(c["ri"]), lot)
    lot_form = F.struct(
        F.when(place == "", name).otherwise(place).alias("main"), region(c["sido"], c["sigungu"]).alias("secondary"), F.when(full == "", name).otherwise(full).alias("full")
    )
    where = region(c["sido"], c["sigungu"])
    kind_label = F.element_at(F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv)), c["kind"])
    cat = category(c["cat1"], c["cat2"], c["subtype"])
    head = F.when(c["kind"].isin(CATEGORY_KINDS), F.coalesce(cat["path"], cat["label"])).otherwise(kind_label)
    second = F.concat_ws(" · ", head, where)
    other_form = F.struct(
        name.alias("main"), F.when(second != "", second).alias("secondary"), F.when(where.isNotNull(), F.concat(name, F.lit(" — "), where)).otherwise(name).alias("full")
    )
    unknown = F.struct(name.alias("main"), F.lit(None).cast("string").alias("secondary"), name.alias("full"))
    return (
        F.when((c["kind"] == "addr") & road.isNotNull(), road_form).when(c["kind"] == "addr", lot_form)
        .when(c["kind"].isin([*KIND_LABELS, *CATEGORY_KINDS]), other_form).otherwise(unknown)
    )


def structure(c: dict[str, Column], containing: dict[str, Column] | None = None) -> Column:
    """PRJ16: the 17-field structure; a place's own values go ahead of those of the areas that contain it."""

    def own(name: str) -> Column:
        mine = F.nullif(F.trim(c[name].cast("string")), F.lit("")) if name in c else F.lit(None).cast("string")
        return F.coalesce(mine, containing[name]) if containing and name in containing else mine

    lot = text.lot_numbers(c["jibun"]) if "jibun" in c and containing is None else None
    none = F.lit(None).cast("int")
    main, sub = c["main_no"].cast("int"), c["sub_no"].cast("int")
    return F.struct(
        codes.remap_sido_name(own("sido")).alias("sido"), own("sigungu").alias("sigungu"), own("emd").alias("emd"), own("haeng_dong").alias("haeng_dong"),
        own("ri").alias("ri"), F.lit(None).cast("boolean").alias("san"), own("road").alias("road_name"), main.alias("main_no"), sub.alias("sub_no"),
        main.alias("bld_main_no"), sub.alias("bld_sub_no"), (lot["main"] if lot is not None else none).alias("ji_main"), (lot["sub"] if lot is not None else none).alias("ji_sub"),
        own("bld").alias("bld_name"), own("postal").alias("zipcode"), (c["bcode"] if "bcode" in c else F.lit(None).cast("string")).alias("b_code"),
        (c["hcode"] if "hcode" in c else F.lit(None).cast("string")).alias("h_code"),
    )


def building_height(height: Column, levels: Column) -> Column:
    """PRJ08: the measured height, or 3.3 m a storey, or 6 m."""
    return F.when(height > 0, F.round(height, 1)).when(levels > 0, F.round(levels * 3.3, 1)).otherwise(6.0)


def tier(cat1: Column, cat2: Column, by_cat2: dict[str, int], by_cat1: dict[str, int], fallback: int) -> Column:
    """PRJ10: the zoom from which a place shows, by its finer category, its coarser one, or the fallback."""

    def found(m: dict[str, int], c: Column) -> list[Column]:
        return [F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), c)] if m else []

    return F.coalesce(*found(by_cat2, cat2), *found(by_cat1, cat1), F.lit(fallback))


def visible(tier_minzoom: Column, zoom: int) -> Column:
    """FLT14."""
    return tier_minzoom.isNull() | (tier_minzoom <= zoom)
