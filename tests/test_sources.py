import struct
import zipfile
import zlib

import pytest
from placewise.operators.tiles import varint, zigzag
from placewise.plans import build
from placewise.sources import binary_files, text_files
from placewise.streaming.lookup import answer_stream
from pyspark.sql import functions as F


def test_fixed_positions(spark, tmp_path):
    lines = ["a|가|c|d", 'b|"나|c|d', "short|x"]
    (tmp_path / "f.txt").write_bytes("\n".join(lines).encode("cp949") + b"\nz|\xff\xfe|c|d\n")
    kept, counts = text_files.fixed_positions(spark, str(tmp_path / "f.txt"), {0: "k", 1: "v"}, 4)
    rows = kept.orderBy("line").collect()
    assert [(r.k, r.v) for r in rows[:2]] == [("a", "가"), ("b", '"나')] and "�" in rows[2].v and tuple(counts.first()) == (4, 1)


def test_csv_of_several_encodings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_bytes("이름,위도\n가,37.5\n".encode("utf-8-sig"))
    (tmp_path / "two.csv").write_bytes("이름,경도\n나,127.5\n".encode("cp949"))
    df = text_files.read_csv(spark, str(tmp_path), recursive=True)
    assert {(r["이름"], r["위도"], r["경도"], r.file, r.folder) for r in df.collect()} == {("가", "37.5", None, "one.csv", "a"), ("나", None, "127.5", "two.csv", tmp_path.name)}
    with pytest.raises(ValueError):
        text_files.encoding_of(b"\xff\xff\x80")


def test_code_tables(spark, tmp_path):
    body = "법정동코드\t법정동명\t폐지여부\r\n1111010100\t서울특별시 종로구 청운동\t존재\r\n".encode("cp949")
    (tmp_path / "t.txt").write_bytes(body)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.txt", body)
    for name in ("t.txt", "t.zip"):
        df = text_files.code_table(spark, str(tmp_path / name), ["법정동코드", "법정동명", "폐지여부"], {"존재": True, "폐지": False})
        assert df.first().exist and len(df.first().sha256) == 64
    with pytest.raises(ValueError):
        text_files.code_table(spark, str(tmp_path / "t.txt"), ["x", "y", "z"], {})
    with pytest.raises(ValueError):
        text_files.code_table(spark, str(tmp_path / "t.txt"), ["법정동코드", "법정동명", "폐지여부"], {"폐지": False})


def test_header_heuristics(spark):
    df = spark.createDataFrame([("37", "37.5", "x"), ("37", "37.6", "y")], ["위도(도)", "WGS84위도", "시설명"])
    assert text_files.coordinate_column(df, ["위도"], 33, 39) == "WGS84위도" and text_files.coordinate_column(df, ["경도"], 124, 132) is None
    assert text_files.find_column(df.columns, ["시설명칭", "시설명"]) == "시설명" and text_files.find_column(df.columns, ["시설"]) == "시설명"


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"11"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{"code":"p"},"geometry":{"type":"Point","coordinates":[127.5,37.5]}}]}')
    rows = {r.code: r for r in binary_files.geojson(spark, str(tmp_path / "g.json"), "code:string").collect()}
    assert len(rows["11"].rings[0]) == 4 and rows["p"].lon == 127.5 and rows["p"].rings is None


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<I4d2I", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "s.shp").write_bytes(bytes(100) + struct.pack(">2I", 1, len(body) // 2) + body)
    name = "가나".encode("cp949").ljust(10)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15)
    (tmp_path / "s.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 24, 1, 1, 1, 32 + 32 + 1, 11) + bytes(20) + field + b"\r" + b" " + name)
    r = binary_files.shapefile(spark, str(tmp_path)).first()
    assert r.attributes == {"NAME": "가나"} and [(p.x, p.y) for p in r.rings[0]] == ring


def _f(n, payload):
    return varint(n << 3 | 2) + varint(len(payload)) + payload


def _v(n, value):
    return varint(n << 3) + varint(value)


def test_osm_pbf(spark, tmp_path):
    strings = b"".join(_f(1, s) for s in (b"", b"name", "가".encode()))
    packed = lambda xs: b"".join(varint(zigzag(x)) for x in xs)
    dense = _f(1, packed([10, 1])) + _f(8, packed([375000000, 100])) + _f(9, packed([1270000000, 100])) + _f(10, b"".join(map(varint, (1, 2, 0, 0))))
    way = _v(1, 7) + _f(2, varint(1)) + _f(3, varint(2)) + _f(8, packed([10, 1, -1]))
    block = _f(1, strings) + _f(2, _f(2, dense)) + _f(2, _f(3, way))
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _v(2, len(data)) + _f(3, zlib.compress(data))
        head = _f(1, kind) + _v(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.pbf").write_bytes(out)
    osm = binary_files.osm_pbf(spark, str(tmp_path / "x.pbf"))
    rows = {(r.type, r.id): r for r in osm.collect()}
    assert rows["node", 10].tags == {"name": "가"} and rows["node", 11].lat == pytest.approx(37.50001) and rows["way", 7].refs == [10, 11, 10]
    assert binary_files.way_centres(osm).first().lon == pytest.approx(127.000005)


def test_elevation_and_xml(spark, tmp_path):
    (tmp_path / "N37E127.hgt").write_bytes(struct.pack(">9h", 0, 1, 2, 3, -32768, 5, 6, 7, 8))
    assert {(r.row, r.col, r.metres) for r in binary_files.elevation(spark, str(tmp_path / "N37E127.hgt")).collect() if r.row == 1} == {(1, 0, 3), (1, 2, 5)}
    assert spark.range(1).select(binary_files.terrain_rgb(F.lit(0)).alias("c")).first().c.asDict() == {"r": 1, "g": 134, "b": 160}
    page = "<response><body><items><item><org>가</org><lat>1</lat></item><item><name>나</name></item></items></body></response>"
    df = spark.createDataFrame([(page,)], "x string")
    assert [tuple(r) for r in binary_files.xml_items(df, "x", {"name": ["name", "org"], "lat": ["lat"]}).collect()] == [("가", "1"), ("나", None)]


def test_build(spark):
    lots = spark.createDataFrame(
        [("4311025301", "충청북도", "청주시", "가덕면", "계산리", "0", "123", "4", "r1", "0", "12", "0", "0", "m", "k", "f", 1), ("4311025301", "충청북도", "청주시", "가덕면", "계산리", "0", "999", "0", "r1", "0", "12", "0", "0", "m", "k", "f", 2), ("4311025301", "충청북도", "청주시", "가덕면", "계산리", "0", "5", "0", "r1", "0", "12", "0", "1", "m", "k", "f", 3)],
        "bcode string, sido string, sigungu string, emd string, ri string, san string, main string, sub string, pk1 string, pk2 string, pk3 string, pk4 string, sequence string, lot_management string, pk6 string, file string, line long",
    )
    buildings = spark.createDataFrame(
        [("k", "r1", "가양길", "0", "12", "0", "28198", "M1", " 집 ", "h", "동", "집", "1000000", "2000000", "b", 1), ("none", "r9", "x", "0", "1", "0", "1", "M2", "", "h", "동", "", "1", "1", "b", 2)],
        "pk6 string, pk1 string, road string, pk2 string, pk3 string, pk4 string, postal string, bd_mgt_sn string, bld string, hcode string, haeng_dong string, detail string, e string, n string, file string, line long",
    )
    built, counts = build.addresses(buildings, lots)
    r = built.first()
    assert (r.jibun, r.main_no, r.sub_no, r.bld, r.lon, r.lat) == ("가덕면 계산리 123-4", 12, 0, "집", 127.5, 38.0) and tuple(counts.first()) == (1, 1, 1)
    provinces = spark.createDataFrame([("충청북도",)], "sido string")
    raw = spark.createDataFrame([("가게", "s", "충북 청주시 가양길 12", "", None, "127.5", "36.5", None, None, "c", None), ("-", "s", "충북 청주시", "", None, "127", "36", None, None, "c", None), ("먼", "s", "충북 청주시", "", None, "10", "36", None, None, "c", None)],
                                "name string, subtype string, address string, lot_address string, org_sido string, lon string, lat string, phone string, opened string, cat1 string, cat2 string")
    biz = build.shops(raw, provinces).first()
    assert (biz.sido, biz.sigungu, biz.road, biz.main_no) == ("충청북도", "청주시", "가양길", 12)
    places = build.numbered([built, build.shops(raw, provinces)])
    assert sorted(r.id for r in places.collect()) == [1, 2] and places.columns == build.PLACES
    facilities = build.shaped(built.withColumn("kind", F.lit("facility"))).drop("lon", "lat", "id").withColumn("lon", F.lit(None).cast("double")).withColumn("lat", F.lit(None).cast("double"))
    placed = build.place_facilities(facilities.drop("is_primary"), places.where("kind = 'addr'"))
    assert placed.first().lon == 127.5 and placed.first().is_primary == 1
    assert build.gazetteer(places).first().roads == ["가양길"] and build.district_dictionary(places).first().emd8 == "43110253"


def test_streaming_answers(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "qid long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda q: q.select("qid", F.upper("text").alias("answer")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]
