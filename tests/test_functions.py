"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from placeflow.functions import contacts, decode, geo, keys, pb
from placeflow.operators import grid, metrics


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("lat", "lon", "inside"), [(0.5, 0.5, True), (1.5, 1.5, False), (None, 0.5, False)])
def test_triangle(spark, lat, lon, inside):
    ring = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 2]]]}
    assert one(spark, geo.in_geometry(F.lit(lat).cast("double"), F.lit(lon), ring)) is inside


def test_geometry_of_a_point_contains_nothing_and_a_location_falls_back_to_its_box(spark):
    point = {"type": "Point", "coordinates": [1, 1]}
    assert one(spark, geo.in_geometry(F.lit(1.0), F.lit(1.0), point)) is False
    assert one(spark, geo.in_location(F.lit(1.5), F.lit(1.5), (1, 1, 2, 2), point)) is True


@pytest.mark.parametrize(
    ("html", "site", "want"),
    [
        ('<a href="mailto:Sales@Example-Biz.com?subject=Hi">', None, ["sales@example-biz.com"]),
        ("info@shop.com INFO@shop.com Info@Shop.com", None, ["info@shop.com"]),
        ("logo@2x.png contact@real.com hero@3x.jpg", None, ["contact@real.com"]),
        ("user@example.com trace@sentry.io real@business.net", None, ["real@business.net"]),
        ("%20inman@thetaylordocs.com inman@thetaylordocs.com email@youremail.com", None, ["inman@thetaylordocs.com"]),
        ("own@acme.com other@foreign.org me@gmail.com", "https://www.acme.com", ["own@acme.com", "me@gmail.com"]),
        ('<a data-cfemail="422a2b023a6c212d">', None, ["hi@x.co"]),
        ("", None, []),
    ],
)
def test_emails(spark, html, site, want):
    column = contacts.emails(F.lit(html), None if site is None else F.lit(site))
    assert one(spark, column) == want


def test_hidden_address_that_is_none(spark):
    assert one(spark, contacts.decode_cfemail(F.lit("42zz"))) is None
    assert one(spark, contacts.decode_cfemail(F.lit("4242"))) is None


def test_socials(spark):
    html = '<a href="https://www.linkedin.com/shareArticle?x"> <a href="https://linkedin.com/company/acme/"> <a href="https://www.facebook.com/sharer/x"> https://wa.me/123?text=a'
    assert one(spark, contacts.social_links(F.lit(html))) == {"linkedin": "https://linkedin.com/company/acme", "whatsapp": "https://wa.me/123?text=a"}


@pytest.mark.parametrize(("link", "want"), [("/contact-us", "https://acme.com/contact-us"), ("about", "https://acme.com/a/about"), ("../about?x#y", "https://acme.com/about?x#y"), ("//b.org/c", "https://b.org/c"), ("mailto:x@y.zz", "mailto:x@y.zz")])
def test_join_url(spark, link, want):
    assert one(spark, contacts.join_url(F.lit("https://acme.com/a/b"), F.lit(link))) == want


def test_grounding(spark):
    page = F.lit("Write to sales [at] acme [dot] com")
    assert one(spark, contacts.email_grounded(F.lit("sales@acme.com"), page)) is True
    assert one(spark, contacts.email_grounded(F.lit("ceo@acme.com"), page)) is False


def test_dedup_key(spark):
    n = F.lit(None).cast("string")
    d = F.lit(None).cast("double")
    assert one(spark, keys.dedup_key(F.lit(""), F.lit("0x1"), n, n, n, d, d)) == "0x1"
    assert one(spark, keys.dedup_key(n, n, n, F.lit("Ab"), F.lit("C"), d, F.lit(1.5))) == "ab|c|None|1.5"


def test_decode(spark):
    wrapped = F.lit('{"c":0,"d":")]}\'\\n[1,[2]]"}/*""*/')
    assert one(spark, decode.json_text(wrapped)) == "[1,[2]]"
    assert one(spark, decode.kind(F.lit("please solve the CAPTCHA"))) == "blocked"
    assert one(spark, F.try_variant_get(decode.decoded(F.lit("not json")), "$", "string")) is None


def test_pb(spark):
    text = pb.encode([pb.message(1, [pb.field(2, "s", F.lit("coffee shop")), pb.field(3, "d", F.lit(30.2672)), pb.field(4, "d", F.lit(-97.7431))])])
    assert one(spark, text) == "!1m3!2scoffee shop!3d30.2672!4d-97.7431"
    assert [tuple(f) for f in one(spark, pb.decode(F.lit("!2scoffee!3d1.5")))] == [(2, "scoffee", ""), (3, "d", "1.5")]


def test_grid(spark):
    assert grid.generate_cells(spark, (0, 0, 0, 0), 1.0).count() == 1
    assert grid.estimate_cells((-43.7, 113, -10.6, 153.7), grid.choose_cell_size((-43.7, 113, -10.6, 153.7), 120)) <= 120
    cells = grid.generate_cells(spark, (0, 0, 0.03, 0.03), 1.0)
    near = spark.createDataFrame([(0.005, 0.005)], "lat double, lon double")
    gaps = grid.uncovered_cells(cells, near, 0.5, (0, 0, 0.03, 0.03))
    assert 0 < gaps.count() < cells.count()


def test_quadtree_recovers_what_one_capped_cell_cannot(spark):
    points = [(((5 + i % 20 * 2) * 4096) // 400, ((5 + i // 20 * 2) * 4096) // 400) for i in range(400)]
    df = spark.createDataFrame(points, "r long, c long")
    leaves = grid.quadtree(df, F.col("r"), F.col("c"), saturation=120, root_km=4.45, min_km=0.05).filter("NOT splits")
    assert leaves.agg(F.sum("n")).first()[0] == 400
    assert leaves.agg(F.max("n")).first()[0] < 120


def test_aimd(spark):
    def delay(*signals):
        xs = F.array(*(F.struct(F.lit(b).alias("blocked"), F.lit(r).cast("double").alias("retry_after")) for b, r in signals))
        return one(spark, metrics.aimd(xs))

    ok = (False, None)
    assert delay(*[ok] * 4) == 1.5
    assert delay(*[ok] * 5) == 1.4
    assert delay((True, None)) == 3.0
    assert delay((True, 7.0)) == 7.0
    assert delay((True, None), (True, None), (True, None)) == 8.0


def test_batch_parameters(spark):
    assert tuple(one(spark, metrics.batch_parameters(F.lit(40)))) == (4, 12.0, 3)
    assert tuple(one(spark, metrics.batch_parameters(F.lit(5000)))) == (24, 5.0, 1)


def test_case_folding(spark):
    words = ["STRASSE", "Straße", "ΣΟΦΟΣ", "σοφος", "ſtop", "Plain", "É", "", None, "ﬁne", "İ"]
    got = [r["k"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(keys.fold(F.col("w")).alias("k")).collect()]
    assert got == [None if w is None else w.casefold() for w in words]


def test_errors_and_exports():
    import placeflow
    from placeflow import errors

    assert placeflow.Places.__name__ == "Places" and placeflow.Settings().page_cap == 6
    assert {type(errors.of(n)).__name__ for n in ("HTTP 429", "ParseError", "TimeoutError", "ConnectError", "ConsentError", "Odd", None)} == {"RateLimitError", "ParseError", "RequestTimeoutError", "NetworkError", "AuthError", "PlacesError"}
    assert errors.of("429", "slow down", retry_after=3.0).details == {"retry_after": 3.0}
    assert issubclass(errors.DriftError, placeflow.PlacesError) and issubclass(errors.NotFoundError, ValueError)
    with pytest.raises(AttributeError):
        _ = placeflow.nothing
