import json

import pytest

from casagrid.sources import io


def test_geo_layer(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    features = [
        {"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [square, [[0, 0], [1, 1]]]}},
        {"type": "Feature", "properties": {"name": ""}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"zone_name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
    ]
    path = tmp_path / "z.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = io.read_geo_layer(spark, str(path), "zona").collect()
    assert sorted((r["name"], r["part"], len(r["rings"]), len(r["rings"][0])) for r in rows) == [("A", 0, 1, 5), ("B", 0, 1, 5), ("B", 1, 1, 5)]
    assert io.read_geo_layer(spark, str(tmp_path / "missing.geojson"), "zona").count() == 0


def test_open_data_headers(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Año;Tipo de Hecho;Año\n2020; Robo ;1\n", encoding="utf-8")
    df = io.read_open_data(spark, str(path), ["ano", "tipo_de_hecho"], sep=";")
    assert df.columns == ["ano", "tipo_de_hecho", "ano_2"]
    assert df.first()["tipo_de_hecho"] == "Robo"
    with pytest.raises(ValueError):
        io.read_open_data(spark, str(path), ["mes"], sep=";")


def test_alias_lookup_and_audit_log(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("source_text_normalized,canonical_name\nbarrio ingles,Centro\nBarrio Inglés,Otro\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_alias_lookup(spark, str(path)).collect()] == [("barrioingles", "Centro")]
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": 1, "url": "u", "result": "active"}\n')
    assert io.read_audit_log(spark, str(log)).first()["result"] == "active"


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    """Split at every few hundred bytes, in the middle of strings, records and features."""
    import csv
    import random

    rng = random.Random(6)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        odd = ('a}b{', 'q"x', "back\\slash", 'tail\\"}', "line\nbreak", "é", "", "plain", "{", '"')
        ring = lambda i: [[i, 0], [i + 1, 0], [i + 1, 1], [i, 1]]
        features = []
        for i in range(120):
            shape = {"type": "Polygon", "coordinates": [ring(i)]} if i % 3 else {"type": "MultiPolygon", "coordinates": [[ring(i)], [ring(i + 0.5)]]}
            feature = {"properties": {"name": f"Z{i}", "note": rng.choice(odd), "inner": {"a": 1}}, "geometry": shape, "type": "Feature"}
            features.append(dict(rng.sample(list(feature.items()), 3)))
        crs = {"type": "name", "properties": {"name": "urn:crs"}}
        path = tmp_path / "z.geojson"
        for layout in ({"crs": crs, "type": "FeatureCollection", "features": features}, {"features": features, "type": "FeatureCollection", "crs": crs}):
            for indent in (None, 2):
                path.write_text(json.dumps(layout, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
                pieces = io.ordered_pieces(spark, str(path), "}")
                assert pieces.rdd.getNumPartitions() > 10
                rows = io.read_geo_layer(spark, str(path), "zona").collect()
                assert sorted((r["feature_idx"], r["name"], r["part"], r["rings"][0][0]["lon"], r["props"]["note"]) for r in rows) == sorted(
                    (i, f"Z{i}", p, i + p / 2, f["properties"]["note"]) for i, f in enumerate(features) for p in range(1 if i % 3 else 2)
                )
        records = [[str(i), rng.choice(odd) + rng.choice(("", ", x", ";y")), rng.choice(("", "z", "multi\nline\n\nend"))] for i in range(200)]
        table = tmp_path / "t.csv"
        with open(table, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows([["Número", "Texto", "Texto"], *records])
        df = io.read_open_data(spark, str(table), ["numero", "texto"])
        assert df.columns == ["numero", "texto", "texto_2"]
        assert sorted(tuple(r) for r in df.fillna("").collect()) == sorted((a, b.strip(" "), c) for a, b, c in records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
