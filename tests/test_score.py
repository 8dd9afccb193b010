"""Score rules at their boundaries."""

import pytest
from pyspark.sql import Row

from prospectry.operators.scoring import quality_score
from prospectry.sources import schemas



def policy(*known):
    """An HTTP verdict; the fields after the known ones are null."""
    names = schemas.HTTP_POLICY.fieldNames()
    return Row(**dict(zip(names, [*known, *[None] * (len(names) - len(known))])))


# A business and site without any fault, as of 2026.
FINE = dict(
    attributes=9, gbp_has_image=True, n_categories=2, gbp_is_verified=True, hasPhone=True, phoneStartsWithPlus=False, hasAddress=True,
    gbp_amount_of_attributes=5, has_website=True, isHttpAllowed=policy("d", True, True, False), responsive=True,
    siteBuilder=Row(["Unknown"]), favicon=True, html5=True, genericTitle=Row("t", False), metaDescription=True, h1=True, analytics=True,
    words=200, images=3, lastUpdate=Row(None, None, 2025, False), sitemap=Row("d", "s", 5), framework=["Unknown"], usesJs=True, jquery=False,
    speedMetrics=Row("u", 3.0, None), domain="d",
)

CASES = [
    ({}, 0, []),
    ({"attributes": 4}, 30, [("Few GBP attributes (4)", 30)]), ({"attributes": -1}, 0, []), ({"attributes": 5}, 0, []),
    ({"gbp_has_image": False}, 140, [("No image in GBP", 100), ("No image in GBP", 40)]),
    ({"n_categories": 1}, 30, [("Only one category", 30)]), ({"gbp_is_verified": False}, 120, [("Unverified Google Business Profile", 120)]),
    ({"gbp_is_verified": None}, 0, []), ({"hasPhone": False, "phoneStartsWithPlus": True}, 10, [("No phone number", 10)]),
    ({"phoneStartsWithPlus": True}, 10, [("Phone number starts with +", 10)]), ({"hasAddress": None}, 30, [("No address", 30)]),
    ({"gbp_amount_of_attributes": None}, 40, [("Few GBP attributes (0)", 40)]),
    ({"has_website": False, "words": 0, "h1": False}, 120, [("No website listed in GBP", 120)]), ({"has_website": None}, 0, []),
    ({"isHttpAllowed": policy("d", True, False, True)}, 120, [("Invalid or expired SSL certificate", 120)]),
    ({"isHttpAllowed": policy("d", True, False, None)}, 100, [("HTTP access allowed (no forced HTTPS)", 100)]),
    ({"isHttpAllowed": policy("d", True, None, None)}, 0, []),
    ({"siteBuilder": Row(["Squarespace", "Webflow", "Wix"])}, 60, [("One-page site builder (Squarespace)", 80), ("One-page site builder (Wix)", 80)]),
    ({"words": 199}, 0, [("Low text content (199 words)", 0)]), ({"words": 195}, 1, [("Low text content (195 words)", 1)]),
    ({"words": None}, 40, [("Low text content (0 words)", 40)]), ({"images": 2}, 15, [("Few images (2)", 15)]), ({"images": None}, 45, [("Few images (0)", 45)]),
    ({"lastUpdate": Row(None, None, 2024, False)}, 30, [("Very old content (2 years old)", 30)]), ({"lastUpdate": Row(None, None, 2012, False)}, 150, [("Very old content (14 years old)", 150)]),
    ({"lastUpdate": Row(None, None, 2039, False)}, 0, []), ({"sitemap": Row("d", "s", 4)}, 10, [("Small sitemap (4 pages)", 10)]),
    ({"sitemap": Row("d", None, 9)}, 30, [("No sitemap found", 30)]), ({"framework": ["Vue", "Astro"]}, 30, [("Frameworks detected (Vue, Astro)", 40)]),
    ({"usesJs": False, "jquery": True}, 30, [("No JavaScript", 30)]), ({"jquery": True}, 30, [("jQuery", 30)]), ({"framework": ["Next.js"], "jquery": True, "usesJs": False}, 0, []),
    ({"framework": None, "usesJs": False}, 0, []), ({"speedMetrics": Row("u", 3.1, None)}, 0, [("Slow load time (3.1s)", 0)]),
    ({"speedMetrics": Row("u", 4.35, None)}, 6, [("Slow load time (4.3s)", 6)]), ({"speedMetrics": Row("u", 99.0, None)}, 50, [("Slow load time (99.0s)", 50)]),
    ({"h1": False, "analytics": False, "favicon": False, "html5": False, "metaDescription": False, "responsive": False, "genericTitle": Row("home", True)}, 295,
     [("Not responsive", 100), ("Not using HTML5", 60), ("No favicon", 40), ("No H1 tag", 30), ("No analytics or tracking", 25), ("Generic title", 20), ("No meta description", 20)]),
]


def test_boundaries(spark):
    fields = schemas.SITE_METRICS.fieldNames()
    rows = [tuple({**FINE, **change}[f] for f in fields) for change, _, _ in CASES]
    from pyspark.sql import types as T

    schema = T.StructType([*schemas.SITE_METRICS.fields, T.StructField("i", T.IntegerType())])
    scored = quality_score(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema), 2026).orderBy("i").collect()
    for (change, score, reasons), found in zip(CASES, scored):
        assert (found.score, [(r.reason, r.penalty) for r in found.reasons], found.is_bad) == (score, reasons, score >= 60), change


def test_nothing_known(spark):
    """A table without a single metric: absent and null read alike."""
    found = quality_score(spark.range(1), 2026).first()
    assert found.score == 335 and [r.penalty for r in found.reasons] == [100, 45, 40, 40, 40, 30, 30, 10]


@pytest.mark.parametrize("seconds", [3.05, 3.15, 3.25, 3.35, 3.45, 3.55, 4.05, 7.949999])
def test_load_label(spark, seconds):
    row = spark.createDataFrame([(Row("u", seconds, None),)], f"speedMetrics {schemas.SITE_METRICS['speedMetrics'].dataType.simpleString()}")
    labels = [r.reason for r in quality_score(row, 2026).first().reasons]
    assert f"Slow load time ({seconds:.1f}s)" in labels


def test_long_methods_are_cut_in_any_session(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for given, left in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            quality_score(spark.range(1).selectExpr("true AS has_website"), 2026)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)
