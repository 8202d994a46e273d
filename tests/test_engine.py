"""Rules, kernels, sidecars, the store and the run, on literal cases."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.functions import pixels, scalars as S
from lumicat.operators import catalog as K, dedup as D, naming as N
from lumicat.operators.graph import components, global_index
from lumicat.plans import pipeline as P
from lumicat.sources import files, models, sidecar
from lumicat.store import Catalog, CatalogError, purge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,text", [(9.5, "09.50"), (10.0, "10.00"), (3.1425, "03.14"), (0.125, "00.12"), (2.675, "02.67"), (0.375, "00.38")])
def test_score_text(spark, value, text):
    assert one(spark, S.two_decimals(F.lit(value))) == text


def test_rating_guards(spark):
    rows = spark.createDataFrame([(3.0,), (4.0,), (6.9999999999,), (8.5,), (float("nan"),), (float("inf"),), (None,)], "s double")
    assert [r[0] for r in rows.select(S.rating(F.col("s"))).collect()] == [1, 2, 4, 5, None, None, None]
    assert [r[0] for r in rows.select(S.color_label(F.col("s"))).collect()] == ["Red", "", "Green", "Green", None, None, None]


@pytest.mark.parametrize(
    "path,score,cluster,name",
    [("/a/IMG_1234.CR3", 7.85, 3, "Cluster-003_Cull-07.85-IMG_1234.CR3"), ("/a/IMG_0001.cr3", None, None, "Cluster-NONE_Cull-NONE-IMG_0001.cr3"),
     ("/a/x.CR3", 5.0, 1234, "Cluster-1234_Cull-05.00-x.CR3"), ("/a/x.CR3", float("nan"), -1, "Cluster-NONE_Cull-NONE-x.CR3"), ("/a/b\u0085c.CR3", None, None, None)],
)
def test_rename_name(spark, path, score, cluster, name):
    row = spark.createDataFrame([(path, score, cluster)], "p string, s double, c long")
    assert row.select(S.rename_name(F.col("p"), F.col("s"), F.col("c"))).first()[0] == name


def test_byte_cap(spark):
    rows = spark.createDataFrame([("héllo", 3), ("héllo", 2), ("日本", 5), ("abc", 9), ("é", 0)], "t string, n int")
    assert [r[0] for r in rows.select(S.cap_bytes(F.col("t"), F.col("n"))).collect()] == ["hé", "h", "日", "abc", ""]
    long = "é" * 300
    name = spark.createDataFrame([(f"/a/{long}.cr3",)], "p string").select(S.rename_name(F.col("p"), F.lit(5.0), F.lit(1).cast("long"))).first()[0]
    assert len(name.encode()) <= 251 and name.endswith(".cr3")


def test_paths(spark):
    rows = spark.createDataFrame([("/a/b.cr3",), ("/a/b",), ("/a.d/b",), ("/a/.cr3",), ("/a/b.c.JPG",)], "p string")
    assert [r[0] for r in rows.select(S.with_extension(F.col("p"), "xmp")).collect()] == ["/a/b.xmp", "/a/b.xmp", "/a.d/b.xmp", "/a/.cr3.xmp", "/a/b.c.xmp"]
    assert [tuple(r) for r in rows.select(S.stem_of(F.col("p")), S.extension_of(F.col("p"))).collect()] == [("b", "cr3"), ("b", ""), ("b", ""), (".cr3", ""), ("b.c", "JPG")]
    assert one(spark, S.under_root(F.lit("/a/bc"), "/a/b")) is False


def test_collisions(spark):
    rows = spark.createDataFrame([(1, "photo.jpg"), (2, "photo.jpg"), (3, "photo.jpg"), (4, "x")], "i int, c string")
    out = N.without_collisions(rows, "c", ["i"]).orderBy("i").collect()
    assert [r["file_name"] for r in out] == ["photo.jpg", "photo_1.jpg", "photo_2.jpg", "x"]


def test_parsers(spark):
    rows = spark.createDataFrame([("1e3",), (" 7 ",), ("x",), ("-2.5",), ("inf",), ("99999999999",)], "t string")
    assert [r[0] for r in rows.select(S.parse_int32(F.col("t"))).collect()] == [1000, 7, None, -3, None, None]
    assert one(spark, S.parse_bool(F.lit(" TRUE "))) is True
    times = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2020-01-01t01:00:00+01:00",), ("2020-01-01",)], "t string")
    assert [r[0] for r in times.select(S.parse_time(F.col("t")).cast("long")).collect()] == [1577836800, 1577836800, None]
    assert one(spark, S.valid_xml_text(F.lit("a\x01"))) is False and one(spark, S.valid_xml_text(F.lit("aé\n"))) is True


def test_upsert(spark):
    schema = ", ".join(f"{c} {t}" for c, t in zip(K.PHOTO_COLUMNS, ["string", "string", "long", "long", "boolean", "string", "string", "string", "long", "int", "int", "int", "long", "long"]))
    row = lambda i, p, at=1, sup=None: (i, p, 1, 1, False, None, None, None, None, None, None, None, at, sup)
    old = spark.createDataFrame([row("a", "/1"), row("b", "/2", sup=5)], schema)
    batch = spark.createDataFrame([row("a", "/9"), row("b", "/2"), row("c", "/1"), row("d", "/3"), row("d", "/4")], schema)
    outcomes, after = K.upsert(old, batch, 100)
    assert {(r[0], r[1], r[2], r[3]) for r in outcomes.collect()} == {
        ("a", "/9", "already_catalogued", None), ("b", "/2", "already_catalogued", None), ("c", "/1", "superseded_previous", "a"),
        ("d", "/3", "inserted", None), ("d", "/4", "already_catalogued", None)}
    assert {(r["id"], r["source_path"], r["superseded_at_unix_seconds"]) for r in after.collect()} == {("a", "/1", 100), ("b", "/2", 5), ("c", "/1", None), ("d", "/3", None)}


def test_scores_are_checked_first(spark):
    table = spark.createDataFrame([("p", "m", 5.0, 1)], "photo_id string, model_slug string, aesthetic_score double, scored_at_unix_seconds long")
    batch = spark.createDataFrame([("p", "m", 6.0, 2), ("q", "m", 0.99, 2), ("q", "m", 10.01, 3), ("q", "m", float("nan"), 4), ("q", "m", 7.0, 5), ("q", "m", 8.0, 6)], table.schema)
    outcomes, after = K.insert_scores(table, batch)
    assert sorted(r["outcome"] for r in outcomes.collect()) == ["already_there", "already_there", "inserted", "rejected", "rejected", "rejected"]
    assert {(r[0], r[2]) for r in after.collect()} == {("p", 5.0), ("q", 7.0)}


def test_clusters(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [1.0])], "vec_id long, embedding array<float>")
    valid = D.valid_embeddings(rows)
    out = D.threshold_clusters(valid, 0.95, ["vec_id"])
    assert {(r["id"], r["cluster_id"], r["cluster_size"]) for r in out.collect()} == {(0, 0, 1), (1, 1, 2), (2, 1, 2), (4, 2, 1)}
    assert {(r[0], r[1]) for r in D.assignments(out).collect()} == {(1, 1), (2, 1)}
    stats = D.cluster_stats(out).first()
    assert (stats["cluster_count"], stats["singleton_count"], stats["largest"]) == (3, 2, 2)


def test_similar_pairs_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.6}
    for kind in ("float", "double"):
        odd = [(90, None), (91, []), (92, [1.0]), (93, [1.0]), (94, [float("nan")] * 8), (95, [None] + [1.0] * 7)]
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, f"vec_id long, embedding array<{kind}>")
        for blocks in (None, 1, 9):
            got = [(r["a"], r["b"]) for r in D.similar_pairs(rows, 0.6, blocks=blocks).collect()]
            assert len(got) == len(set(got)) and set(got) == want | {(92, 93)}
    assert D.similar_pairs(rows.limit(0), 0.6).count() == 0
    assert D.block_count(10**8, 512, 4, 8) == 3052 and D.block_count(60, 8, 4, 8) == 1 and D.block_count(5000, 64, 4, 8) == 5


def test_components_and_index(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}
    assert components(edges.where("u > 1000")).count() == 0
    out = global_index(spark.range(50).withColumn("k", -F.col("id")), F.col("k")).collect()
    assert all(r["position"] == 49 - r["id"] for r in out)


def test_pixels():
    img = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert np.array_equal(pixels.bilinear(img, 7, 5), img) and np.array_equal(pixels.bicubic(img, 7, 5), img)
    flat = np.full((40, 60, 3), 77, np.uint8)
    assert (pixels.lanczos(flat, 13, 9) == 77).all() and pixels.embedding_input(flat).shape == (1, 3, 224, 224)
    assert pixels.score_input(flat).shape == (1, 224, 224, 3)
    for o, back in zip(range(1, 9), (1, 2, 3, 4, 5, 8, 7, 6)):
        assert np.array_equal(pixels.upright(pixels.upright(img, o), back), img)
    assert pixels.upright(img, 6).shape == (7, 5, 3)
    ramp = pixels.shadow_ramp(10, 0.3)
    assert ramp.tolist() == [0, 128, 255] and pixels.shadow_ramp(1, 0.3).tolist() == [] and pixels.shadow_ramp(10, float("nan")).tolist() == []
    shaded = pixels.shade_bottom(flat, 0.5)
    assert (shaded[:20] == 77).all() and (shaded[-1] == 0).all()
    mark = np.zeros((4, 4, 4), np.uint8)
    mark[..., 3], mark[..., 0] = 255, 200
    out = pixels.blend(flat, mark, 58, 38, 4, 4)
    assert out[39, 59].tolist() == [200, 0, 0] and out[0, 0].tolist() == [77] * 3
    assert pixels.unpremultiply(pixels.premultiply(mark))[0, 0].tolist() == [200, 0, 0]
    assert pixels.resize_long_edge(flat, 30).shape == (20, 30, 3)
    table = pixels.tone_table(0.0)
    assert table[0] == 0 and (np.diff(table.astype(int)) >= 0).all()


def test_orientation_tag():
    tiff = b"II*\0\x08\0\0\0\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    exif = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif
    assert pixels.jpeg_orientation(jpeg) == 6 and pixels.jpeg_orientation(b"\xff\xd8\xff\xda\0\x02") is None and pixels.tiff_orientation(b"MM") is None


XMP = """<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" CRS:Temperature="100000" crs:Exposure2012="7" crs:temperature="1" xmp:Rating="9" other="kept" xmlns:CRS="x">
<crs:Tint>-7.5</crs:Tint><dc:subject><rdf:Bag><rdf:li>holiday</rdf:li><rdf:li>cluster:4</rdf:li></rdf:Bag></dc:subject><crs:Custom>yes</crs:Custom></rdf:Description></rdf:RDF></x:xmpmeta>"""


def test_sidecar_reader():
    s = sidecar.parse(XMP)
    assert s["temperature"] == 50000 and s["exposure"] is None and s["rating"] is None and s["tint"] == -8 and s["has_settings"]
    assert s["keywords"] == ["cluster:4", "holiday"]
    with pytest.raises(sidecar.SidecarError):
        sidecar.parse("<a><b></a>")
    deep = "<a>" * 70 + "</a>" * 70
    with pytest.raises(sidecar.SidecarError):
        sidecar.parse(deep)
    with pytest.raises(sidecar.SidecarError):
        sidecar.render("<a/>", {})


def test_sidecar_writer():
    merged = sidecar.merge(sidecar.parse(XMP), {"rating": 4, "keywords": ["lumicat", "cluster:9"], "score": 7.5})
    text = sidecar.render(XMP, merged)
    again = sidecar.parse(text)
    assert again["rating"] == 4 and again["score"] == 7.5 and again["keywords"] == ["cluster:9", "holiday", "lumicat"]
    assert 'other="kept"' in text and "<crs:Custom>yes</crs:Custom>" in text
    assert "Rating" not in sidecar.render(None, {"rating": 0})


def test_sidecar_conflicts(tmp_path):
    path = str(tmp_path / "a.xmp")
    now = time.time()
    assert sidecar.merge_and_write(path, {"rating": 3, "asset_id": "i", "last_processed_at": now}) == "created"
    assert sidecar.merge_and_write(path, {"rating": 5, "asset_id": "i", "last_processed_at": now}) == "overwritten"
    os.utime(path, (now + 60, now + 60))
    assert sidecar.merge_and_write(path, {"rating": 1, "asset_id": "i", "last_processed_at": now}) == "conflict_preserved"
    assert sidecar.merge_and_write(path, {"rating": 1, "asset_id": "i", "last_processed_at": now}, force=True) == "forced_overwrite"
    assert sidecar.parse(open(path).read())["rating"] == 1


def test_store(spark, tmp_path):
    root = str(tmp_path / "catalog")
    with Catalog(spark, root) as c:
        with pytest.raises(CatalogError):
            Catalog(spark, root, lock_timeout=0.1)
        rows = spark.createDataFrame([("p", "m", 5.0, 1)], c.read("cull_scores").schema)
        c.commit({"cull_scores": rows})
        c.commit({"cull_scores": c.read("cull_scores").unionByName(rows)})
        assert c.read("cull_scores").count() == 2
        c.vacuum()
        assert c.read("cull_scores").count() == 2
    with Catalog(spark, root) as c:
        assert c.read("cull_scores").count() == 2
    assert purge(spark, root).startswith("would") and purge(spark, root, really=True).startswith("deleted")
    other = tmp_path / "other"
    other.mkdir()
    (other / "x").write_text("x")
    with pytest.raises(CatalogError):
        Catalog(spark, str(other))
    with pytest.raises(CatalogError):
        purge(spark, str(other))


def test_files(spark, tmp_path):
    (tmp_path / ".lumicat").mkdir()
    (tmp_path / ".lumicat" / "no.cr3").write_bytes(b"x")
    for name, data in {"a.cr3": b"\xcc" * 200, ".hidden.CR3": b"h", "empty.cr3": b"", "b.txt": b"t", "big.cr3": bytes(range(256)) * 600}.items():
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (5e9, 5e9))
    found = files.facts(files.ingestible(files.paths(spark, str(tmp_path)))).collect()
    by = {os.path.basename(r["source_path"]): r for r in found}
    assert set(by) == {"a.cr3", ".hidden.CR3", "empty.cr3", "big.cr3"} and by["empty.cr3"]["error"] == "zero_bytes"
    for name in ("a.cr3", "big.cr3"):
        content = (tmp_path / name).read_bytes()
        got = one(spark, S.content_id(F.lit(len(content)), F.lit(5_000_000_000), F.lit(content)))
        assert got == by[name]["content_id"]
    with pytest.raises(ValueError):
        files.absolute(str(tmp_path / ".."), str(tmp_path))


def test_models(tmp_path):
    import hashlib

    (tmp_path / "m.onnx").write_bytes(b"weights")
    (tmp_path / "manifest.toml").write_text(f'[m]\nfile = "m.onnx"\nsha256 = "{hashlib.sha256(b"weights").hexdigest()}"\n')
    assert models.verified_bytes(str(tmp_path), "m") == b"weights"
    (tmp_path / "m.onnx").write_bytes(b"other")
    with pytest.raises(ValueError):
        models.verified_bytes(str(tmp_path), "m")
    assert models.mean_score([0] * 9 + [1]) == 10.0
    with pytest.raises(ValueError):
        models.unit_vector(np.zeros(4))


def test_arguments():
    assert P.threshold_arg("1") == 1.0 and P.long_edge_arg("16") == 16
    for f, bad in ((P.threshold_arg, "0"), (P.threshold_arg, "1.1"), (P.long_edge_arg, "15"), (P.badge_arg, "pos=center"), (P.badge_arg, "path=x,pos=up")):
        with pytest.raises(ValueError):
            f(bad)
    assert P.badge_arg("path=x.png,pos=top-left,scale=500") == {"path": "x.png", "pos": "top_left", "scale": 100.0}
    assert K.exit_code({"errors": 1}, ["errors"], [], ["inserted"], True) == 1 and K.exit_code({}, [], [], ["inserted"], False) == 64 and K.exit_code({"failed": 1}, [], ["failed"], [], False) == 2


def test_run(spark, tmp_path):
    source, output = tmp_path / "in", tmp_path / "out"
    source.mkdir(), output.mkdir()
    for i in range(6):
        (source / f"IMG_{i}.cr3").write_bytes(bytes([i // 2]) * 300)
        os.utime(source / f"IMG_{i}.cr3", (1577836800, 1577836800))
    cfg = P.RunConfig(str(source), str(output), 1_800_000_000)
    photo = F.col("id").alias("photo_id")
    digit = F.regexp_extract("source_path", r"_(\d)", 1).cast("int")
    scorer = lambda rows: rows.select(photo, (5.0 + digit).alias("aesthetic_score"))
    embedder = lambda rows: rows.select(photo, F.when(digit < 3, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    decode = lambda rows: rows.select("source_path", F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(b"\x10" * 12).alias("rgb"))
    with Catalog(spark, str(tmp_path / "catalog")) as c:
        code, report = P.run(c, cfg, scorer, embedder, decode)
        assert code == 0 and report["ingest"]["inserted"] == 3 and report["ingest"]["already_catalogued"] == 3
        assert report["score"] == {"inserted": 3} and report["dedup"]["clusters"] == 2 and report["dedup"]["singletons"] == 1
        assert report["develop"] == {"created": 3} and report["export"] == {"written": 2, "skipped_rating": 1}
        assert sidecar.parse((source / "IMG_2.xmp").read_text())["rating"] == 4
        code, report = P.run(c, cfg, scorer, embedder, decode)
        assert report["ingest"]["already_catalogued"] == 6 and "clusters" not in report["dedup"] and report["export"] == {"skipped": 2, "skipped_rating": 1}
        renamed = P.RunConfig(str(source), str(tmp_path / "renamed"), 1)
        assert P.rename(c, renamed) == {"copied": 3}
    with pytest.raises(ValueError):
        P.check_folders(str(source), str(source / "x"))


def test_vectors(spark):
    from lumicat.functions.vectors import vector_bytes, vector_from_bytes

    rows = spark.createDataFrame([([0.6, 0.8], 2), ([0.6, 0.7], 2), ([1.0], 2), (None, 1)], "v array<float>, n int")
    back = rows.select(vector_from_bytes(vector_bytes(F.col("v")), F.col("n")).alias("x")).collect()
    assert [r["x"] and [round(a, 6) for a in r["x"]] for r in back] == [[0.6, 0.8], None, None, None]


def test_watermark(spark, tmp_path):
    source, output = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    flat = np.full((200, 300, 3), 77, np.uint8)
    (source / "a.png").write_bytes(pixels.encode_png(flat))
    (source / "tiny.png").write_bytes(pixels.encode_png(flat[:8, :8]))
    (source / "bad.png").write_bytes(b"no image")
    mark = np.full((8, 16, 4), 255, np.uint8)
    (tmp_path / "mark.png").write_bytes(pixels.encode_png(mark))
    assert P.watermark(spark, str(source), str(output), str(tmp_path / "mark.png")) == {"written": 1, "undecodable": 1, "does_not_fit": 1}
    out = pixels.decode_png((output / "a.png").read_bytes())
    assert out.shape == (200, 300, 4) and (out[185:191, 278:291, :3] == 255).all() and (out[:100, :, :3] == 77).all()
    assert not (output / "tiny.png").exists()
    with pytest.raises(ValueError):
        pixels.decode_png(b"JPEG")


def test_streaming(spark, tmp_path):
    from lumicat import schema
    from lumicat.streaming.ingest import continuous_upsert

    rows = spark.createDataFrame([("a", "/1", 1, 1, False, None, None, None, None, None, None, None, 1, None)], schema.PHOTOS)
    rows.write.parquet(str(tmp_path / "in"))
    with Catalog(spark, str(tmp_path / "catalog")) as c:
        for _ in range(2):
            stream = spark.readStream.schema(schema.PHOTOS).parquet(str(tmp_path / "in"))
            continuous_upsert(c, stream, str(tmp_path / "ckpt"), lambda: 5).awaitTermination()
        assert [r["id"] for r in c.read("photos").collect()] == ["a"]


def test_number_grammar_and_trim(spark):
    texts = ["7d", "7f", "1_000", "\u0667", "0x10", "\u2003 7\n", "7.5", "-3e1", "1e400", "nan", "", ".", "5.", ".5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.parse_int32(F.col("t")).alias("i"), S.parse_float(F.col("t")).alias("f")).collect()
    want = {"\u2003 7\n": (7, 7.0), "7.5": (8, 7.5), "-3e1": (-30, -30.0), "5.": (5, 5.0), ".5": (1, 0.5)}
    assert {r["t"]: (r["i"], r["f"]) for r in got} == {t: want.get(t, (None, None)) for t in texts}
    assert [sidecar.parse_value("float", t) for t in texts] == [want.get(t, (None, None))[1] for t in texts]
    words = spark.createDataFrame([(["\ta\n", "\u3000b\xa0", " ", "a"],)], "w array<string>").select(S.clean_keywords(F.col("w")).alias("w")).first()
    assert words["w"] == ["a", "b"]


def test_sidecar_keeps_what_surrounds_its_root():
    text = "<?xpacket begin='' id='W5M0MpCehiHzreSzNTczkc9d'?><!-- note --><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about=''/></rdf:RDF></x:xmpmeta><?xpacket end='w'?>"
    out = sidecar.render(text, {"rating": 3})
    assert out.startswith("<?xpacket begin=") and "<!-- note -->" in out and out.endswith("<?xpacket end='w'?>") and sidecar.render(out, {"rating": 3}).count("<?xpacket") == 2


def test_stale_lock_is_taken_over(spark, tmp_path):
    Catalog(spark, f"file://{tmp_path}/c").close()
    (tmp_path / "c" / "_lock").touch()
    with pytest.raises(CatalogError):
        Catalog(spark, f"file://{tmp_path}/c", lock_timeout=0.2)
    Catalog(spark, f"file://{tmp_path}/c", lock_timeout=0.2, lock_stale=0.0).close()


def small_catalog(spark, tmp_path, n):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(n):
        (source / f"IMG_{i}.cr3").write_bytes(bytes([i]) * 300)
        os.utime(source / f"IMG_{i}.cr3", (1577836800, 1577836800))
    c = Catalog(spark, str(tmp_path / "catalog"))
    cfg = P.RunConfig(str(source), str(tmp_path / "out"), 1_800_000_000)
    P.ingest(c, cfg)
    return source, c, cfg


def digit_scores(rows):
    digit = F.regexp_extract("source_path", r"_(\d)", 1).cast("int")
    return rows.select(F.col("id").alias("photo_id"), (9.0 - digit).alias("aesthetic_score"))


def test_stages_look_at_the_files_again(spark, tmp_path):
    source, c, cfg = small_catalog(spark, tmp_path, 4)
    with c:
        (source / "IMG_0.cr3").unlink()
        (source / "IMG_1.cr3").write_bytes(b"other")
        (source / "IMG_2.cr3").write_bytes(b"")
        assert P.score(c, cfg, digit_scores) == {"inserted": 1, "file_missing": 1, "content_changed": 1, "derive_failed": 1}
        embedder = lambda rows: rows.select(F.col("id").alias("photo_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
        assert {k: v for k, v in P.dedup(c, cfg, embedder).items() if k in ("embedded", "file_missing", "content_changed", "derive_failed")} == {"embedded": 1, "file_missing": 1, "content_changed": 1, "derive_failed": 1}
        assert P.develop(c, cfg) == {"created": 3, "file_missing": 1}  # these need the file to be there, no more
        assert P.rename(c, P.RunConfig(str(source), str(tmp_path / "renamed"), 1)) == {"copied": 3, "file_missing": 1}


def test_sidecars_decide_what_is_exported(spark, tmp_path):
    source, c, cfg = small_catalog(spark, tmp_path, 6)
    linear = np.array([0, 20000, 65535] * 4, "<u2").tobytes()
    decode = lambda rows: rows.select("source_path", F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(b"\x10" * 12).alias("rgb"), F.when(F.col("source_path").contains("_5"), F.lit(linear)).alias("linear"))
    with c:
        P.score(c, cfg, digit_scores)
        described = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:xmp='http://ns.adobe.com/xap/1.0/' xmlns:crs='http://ns.adobe.com/camera-raw-settings/1.0/'><rdf:Description %s/></rdf:RDF>"
        (source / "IMG_0.xmp").write_text(described % "xmp:Rating='-1'")  # rejected in an editor
        (source / "IMG_1.xmp").write_text("<broken")
        (source / "IMG_5.xmp").write_text(described % "xmp:Rating='5' crs:Exposure2012='1.5'")
        (source / "IMG_2.cr3").unlink()
        assert P.export(c, cfg, decode) == {"written": 2, "skipped_rating": 2, "failed": 1, "file_missing": 1}  # 5.0 has two stars
        out = pixels.decode_png((tmp_path / "out" / "cull-04.00-IMG_5.png").read_bytes())
        assert out[0, 0, :3].tolist() == [int(pixels.tone_table(1.5)[i]) for i in (0, 20000, 65535)]
        assert P.export(c, cfg, decode)["skipped"] == 2


def test_scores_that_are_not_finite_fail_their_photo(spark, tmp_path):
    source, c, cfg = small_catalog(spark, tmp_path, 3)
    decode = lambda rows: rows.select("source_path", F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(b"\x10" * 12).alias("rgb"))
    with c:
        P.score(c, cfg, digit_scores)
        bad = F.when(F.col("aesthetic_score") == 9.0, float("inf")).otherwise(F.col("aesthetic_score")).alias("aesthetic_score")
        c.commit({"cull_scores": c.read("cull_scores").withColumn("aesthetic_score", bad)})
        assert P.develop(c, cfg) == {"created": 2, "failed": 1} and not (source / "IMG_0.xmp").exists()
        assert P.export(c, cfg, decode) == {"written": 2, "failed": 1}


def test_marks_in_export(spark, tmp_path):
    source, c, cfg = small_catalog(spark, tmp_path, 2)
    size = F.when(F.col("source_path").contains("_1"), 4).otherwise(100)
    decode = lambda rows: rows.select("source_path", size.alias("width"), F.lit(100).alias("height"), F.when(size == 4, F.lit(b"\x10" * 1200)).otherwise(F.lit(b"\x10" * 30000)).alias("rgb"))
    (tmp_path / "mark.png").write_bytes(pixels.encode_png(np.full((14, 28, 4), 255, np.uint8)))
    with c:
        P.score(c, cfg, digit_scores)
        got = P.export(c, cfg, decode, marks={"top_right": str(tmp_path / "mark.png"), "bottom_left": str(tmp_path / "mark.png")})
        assert got == {"written": 1, "failed": 1}  # the narrow one has no room for marks
    out = pixels.decode_png((tmp_path / "out" / "cull-09.00-IMG_0.png").read_bytes())[:, :, 0]
    assert (out[6:18, 68:94] == 255).all() and (out[83:94, 6:30] == 255).all() and (out[30:70] == 16).all()


def test_labels_argument():
    assert P.labels_arg(" Rot ", "Grün") == ("Rot", "Grün")
    for bad in (("", "Green"), ("Red", "\u2003"), ("x", " x"), ("a\x07", "b"), ("a", "\ufffe")):
        with pytest.raises(ValueError):
            P.labels_arg(*bad)


def tiff(main, inner=None, order="<"):
    """A TIFF header with one directory of (tag, kind, value), and the EXIF directory it names."""
    import struct

    def directory(at, entries):
        body, rest = b"", b""
        for tag, kind, value in entries:
            raw = value.encode() + b"\0" if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind], value)
            if len(raw) > 4:
                slot, rest = struct.pack(order + "I", at + 2 + 12 * len(entries) + 4 + len(rest)), rest + raw
            else:
                slot = raw.ljust(4, b"\0")
            body += struct.pack(order + "HHI", tag, kind, len(raw) if kind == 2 else 1) + slot
        return struct.pack(order + "H", len(entries)) + body + b"\0" * 4 + rest

    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    if inner is None:
        return head + directory(8, main)
    size = len(directory(8, [*main, (0x8769, 4, 0)]))
    return head + directory(8, [*main, (0x8769, 4, 8 + size)]) + directory(8 + size, inner)


def test_exif(spark, tmp_path):
    import struct

    from lumicat.sources import exif

    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    camera = [(0x010F, 2, "Canon"), (0x0110, 2, "EOS R8 "), (0x0112, 3, 6)]
    shot = [(0x9003, 2, "2020:01:02 03:04:05"), (0x9011, 2, "+01:00"), (0xA002, 4, 6000), (0xA003, 3, 4000)]
    moov = box(b"moov", box(b"uuid", bytes(16) + box(b"CMT1", tiff(camera, order=">")) + box(b"CMT2", tiff(shot))))
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", 8 + len(tiff(camera, shot, ">"))) + b"Exif\0\0" + tiff(camera, shot, ">")
    files_ = {
        "a.cr3": box(b"ftyp", b"crx isom") + moov + box(b"mdat", b"x" * 99), "b.dng": tiff(camera, shot), "c.jpg": jpeg,
        "d.dng": tiff([(0x010F, 2, " "), (0x0110, 2, "X")]), "e.dng": tiff([(0x010F, 2, "Acme"), (0x0112, 3, 9), (0x0100, 4, 0), (0x0132, 2, "0000:00:00 00:00:00")]),
        "f.cr3": b"\0" * 300, "g.cr3": box(b"ftyp", b"crx isom") + moov[:60], "h.jpg": b"\xff\xd8\xff\xd9", "i.dng": b"II*\0\xff\xff\xff\xff", "j.dng": b"",
    }
    for name, data in files_.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in [*files_, "gone"]], "source_path string")
    got = {os.path.basename(r[0]): tuple(r)[1:] for r in exif.with_exif(rows).collect()}
    full = ("Canon", "EOS R8", 1577930645, 6000, 4000, 6, None)
    assert got["a.cr3"] == got["b.dng"] == got["c.jpg"] == full
    assert got["e.dng"] == ("Acme", None, None, None, None, None, None) and got["d.dng"] == (None,) * 6 + ("no make",)
    assert all(got[n][:6] == (None,) * 6 and got[n][6] for n in ("f.cr3", "g.cr3", "h.jpg", "i.dng", "j.dng", "gone"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cr3").write_bytes(files_["a.cr3"])
    with Catalog(spark, str(tmp_path / "catalog")) as c:
        counts = P.ingest(c, P.RunConfig(str(tmp_path / "in"), str(tmp_path / "out"), 1))
        assert counts["inserted"] == 1 and counts["no_exif"] == 0 and counts["unknown_camera"] == 0
        assert [r["camera_slug"] for r in c.read("photos").collect()] == ["canon-r8"]
