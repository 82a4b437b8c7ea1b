from pyspark.sql import functions as F

from chartspark.functions import clinical as C
from chartspark.functions import text as T
from chartspark.operators.sentences import split_sentences


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_names_and_ingredients(spark):
    row = one(
        spark,
        name=T.normalize_name(F.lit("  Chronic   Kidney  disease ")),
        display=T.normalize_display(F.lit("Primary hypertension")),
        drug=T.normalize_ingredient(
            F.lit("Product containing precisely carbidopa anhydrous (as carbidopa) 25 milligram and levodopa 100 milligram/1 each oral tablet (clinical drug)")
        ),
        dose=T.normalize_dose_value(F.lit("25/100 mg")),
    )
    assert tuple(row) == ("kidney disease", "hypertension", "carbidopa / levodopa", "25/100")


def test_dates(spark):
    def verdict(value, snippet, note):
        r = one(spark, k=T.kept_date(F.lit(value), F.lit(snippet), F.lit(note)), r=T.date_reject_reason(F.lit(value), F.lit(snippet), F.lit(note)))
        return r.k, r.r

    assert verdict("2024-05", "in 2024", "2025-01-01") == ("2024-05", None)
    assert verdict("2024", "in 12024", "2025") == (None, "year_not_in_snippet")
    assert verdict("1990", "since 1990", "2025-01-01") == (None, "drift_gt_20y")
    assert verdict("May 2024", "May 2024", None) == (None, "bad_format")


def test_call_cost_rounds_half_even(spark):
    dec = lambda x: F.lit(x).cast("decimal(10,3)")
    rates = F.struct(dec("1.500").alias("input"), dec("0.150").alias("cached"), dec("9.000").alias("output"))
    n = lambda x: F.lit(x).cast("bigint")
    row = one(
        spark,
        plain=C.call_cost(n(1000), n(200), n(10), rates, F.lit(False)),
        half=C.call_cost(n(1), n(0), n(0), rates, F.lit(False)),
        uplift=C.call_cost(n(1000), n(2000), n(0), rates, F.lit(True)),
    )
    assert [str(v) for v in row] == ["0.001320", "0.000002", "0.000330"]


def sentences(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split_sentences(F.col("t")).alias("s"))
    return [r["s"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_splitter_cases(spark):
    texts = lambda t: [s["text"] for s in sentences(spark, t)[0]]
    assert len(texts("BP 120.5/80. Next sentence.")) == 2
    assert texts("Seen by Dr. Smith. Plan follows.")[0] == "Seen by Dr. Smith."
    assert len(texts("Plan: 1. Labs. 2. Imaging.")) == 1
    assert texts("ASSESSMENT\nEpigastric pain.") == ["ASSESSMENT", "Epigastric pain."]
    assert texts("J. Doe came.\n1. Rest.\nHome.") == ["J. Doe came.", "1. Rest.", "Home."]
    assert sentences(spark, "", None, " \n") == [[], [], []]


def test_splitter_offsets(spark):
    text = "  First 🙂 one. Second\n\nThird: a) x. b) y.\n| cell\nFourth."
    text += " Long line without an end, 4 mg daily.\n" * 400
    for span in sentences(spark, text)[0]:
        assert text[span["start"] : span["end"]] == span["text"]


def test_variants_are_computed_once_and_distinct_without_case(spark):
    terms = spark.createDataFrame([("HTN and left knee, NOS",), ("knee",), ("Severe KNEE",), ("",), (None,)], "term string")
    found = terms.select("term", T.query_variants(F.col("term")).alias("v"))
    rows = {r.term: r.v for r in found.collect()}
    assert rows["knee"] == ["knee"] and rows[""] == rows[None] == []
    assert rows["Severe KNEE"] == ["Severe KNEE", "KNEE"]
    assert rows["HTN and left knee, NOS"] == ["HTN and left knee, NOS", "HTN and knee, NOS", "HTN and left knee", "hypertension and left knee, nos"]
    # Within the lambda of the distinct step the rules would run again for each element.
    assert found._jdf.queryExecution().analyzed().toString().count("nos|unspecified") == 1
