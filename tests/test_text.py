from pyspark.sql import functions as F

from casagrid.functions import address as A
from casagrid.functions import numbers as N
from casagrid.functions import text as T
from casagrid.functions import urls as U
from casagrid.operators import extract as X
from casagrid.operators import listing as L


def check(spark, fn, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [r["v"] for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_fold_and_repair(spark):
    check(spark, T.fold_text, [("Martín Güemes", "martin guemes"), ("GÃ¼emes", "guemes"), ("m² nº", "m2 no"), (None, ""), ("plain", "plain")])
    check(spark, T.repair_mojibake, [("ÃƒÂ¼", "ü"), ("ok", "ok"), ("cafÃ©", "café")])
    check(spark, T.text_key, [("Barrio Inglés (2)", "barrioingles2")])
    check(spark, T.snake_key, [(" Año de Venta ", "ano_de_venta")])


def test_numbers(spark):
    cases = [("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1.500", 1500.0), ("2,5", 2.5), ("1,234", 1234.0), ("", None), ("1,2,3", None), ("-7", -7.0)]
    check(spark, lambda c: A.parse_decimal(c).cast("double"), cases)
    check(spark, lambda c: N.price_short(F.lit("USD"), c.cast("decimal(16,2)")), [("1200000", "USD 1,2M"), ("98000", "USD 98k"), ("950", "USD 950"), (None, "Consultar"), ("2000000", "USD 2M")])


def test_addresses(spark):
    check(spark, A.normalize_street_number, [("Av. Vergara al 1.700", "Av. Vergara 1700"), ("Jauretche al 0", "Jauretche 100"), ("Roca 300, Piso PB", "Roca 300")])
    check(spark, A.normalize_address, [("Av. Gdor. Vergara 1700", "avenida gobernador vergara 1700")])
    check(spark, A.is_plausible_address, [("Hurlingham, Buenos Aires", False), ("Jauretche 900", True), ("x" * 200, False), ("", False)])
    check(spark, A.classify_precision, [("Roca 120", "exact"), ("Roca y Ocampo", "intersection"), ("Roca", "street"), ("", "neighborhood")])
    check(spark, A.normalize_neighborhood, [("B Inglés", A.CENTRE_ZONE), ("consultanos", ""), ("Loma", "Loma"), ("Villa Tesei, zona", "Villa Tesei")])
    check(spark, A.normalize_locality, [("William Morris", "William C. Morris"), ("Moron", "")])
    check(spark, A.infer_property_type, [("Casa o depto", "house"), ("depto en casa", "apartment"), ("galpon", "other")])


def test_detection(spark):
    rows = [("Casa en venta", "", "", "", "Excelente casa sobre Jauretche 950, William C. Morris", None, None)]
    df = spark.createDataFrame(rows, "title string, address string, locality string, neighborhood string, description string, latitude double, longitude double")
    r = L.enrich_location(df).first()
    assert r["detected_locality"] == "William C. Morris" and r["detected_references"] == ["Jauretche"]
    assert r["location_source"] == ("detail" if r["detected_address"] else "description")


def test_urls(spark):
    check(spark, U.url_tail, [("https://a.b/x/Casa-1/?q=1", "casa-1"), ("nope", "")])
    check(spark, U.safe_https_url, [("https://A.b:443/x?y=1#z", "https://a.b/x?y=1"), ("http://a.b", ""), ("https://u@a.b/", ""), ("https://a.b:99999/", "")])
    check(spark, U.mirror_key, [("https://a.b/v/casa-12-34/", "casa-12-34"), ("https://a.b/v", "")])
    check(spark, lambda c: U.absolute_url(F.lit("https://a.b/d/page"), c), [("x", "https://a.b/d/x"), ("/y#f", "https://a.b/y"), ("//c.d/z", "https://c.d/z"), ("?p=2", "https://a.b/d/page?p=2")])


def test_page_values(spark):
    check(spark, X.garage_value, [("sin cochera", 0), ("cochera", 1), ("3 autos", 3), ("-2", None)])
    check(spark, X.declared_total, [("Mostrando 1 a 20 propiedades de 1.234 encontradas", 1234), ("nada", None)])
    check(spark, X.max_page, [('<a href="?page=3">', 3), ("/page/7 pagina-12", 12), ("", None)])


def test_json_ld_is_walked_parents_first(spark):
    page = (
        '<script type="application/ld+json">{bad</script>'
        '<script type="application/ld+json">[{"@type":"X","offers":{"item":{"@type":"House","name":"deep"}}},{"@type":"House","name":"later"}]</script>'
    )
    graph = '<script type="application/ld+json">{"@graph":[{"@type":["Place","House"],"name":"g"}]}</script>'
    df = spark.createDataFrame([(1, page), (2, graph), (3, "<p>none</p>")], "page_id long, html string")
    out = X.json_ld(df, "page_id", ["House"])
    got = {r["page_id"]: r["n"] for r in out.select("page_id", F.get_json_object("object", "$.name").alias("n")).collect()}
    assert got == {1: "deep", 2: "g"}


def test_folding_equals_the_standard_for_all_characters(spark):
    import pyarrow as pa

    texts = [f"a{chr(c)}b{chr(c)}" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame(pa.table({"t": texts})).repartition(4).select("t", T.strip_marks("t").alias("p")).toArrow().to_pydict()
    assert sum(p != T.plain_letters(t) for t, p in zip(got["t"], got["p"], strict=True)) == 0


def test_rules_as_a_table_equal_rules_as_columns(spark):
    import random
    import re

    from casagrid.functions.street_rules import STREET_RULES
    from casagrid.operators import aliases as V

    rng = random.Random(7)
    words = sorted({w for p, r in STREET_RULES for w in re.findall(r"[A-Za-zÁ-ú]+\.?", re.sub(r"\\.", " ", p) + " " + r)})
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + f" {rng.randint(1, 9000)}" for _ in range(1500)]
    texts += [re.sub(r"\\d.*", "123", re.sub(r"\\s[+*]", " ", re.sub(r"\(\?<?[!=][^)]*\)|\\b|\?:|[()?$]|\\\.", "", p))).split("|")[-1] + " 55" for p, _ in STREET_RULES] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = {r["i"]: r["v"] for r in df.filter("not coalesce(t, '') rlike '(?i)solis'").select("i", A.address_variants("t").alias("v")).collect()}
    table = {r["i"]: r["variants"] for r in V.alias_variants(df, V.street_rules(spark), "t").collect()}
    assert {i: table[i] for i in plain} == plain and sum(map(bool, plain.values())) > 500


def test_patterns_of_many_ranges_skip_plain_letters():
    for pattern in (T.mark_class(), T.several_class()):
        assert pattern.startswith(r"[\x{80}-\x{10FFFF}&&[") and pattern.endswith("]]")
