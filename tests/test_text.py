"""Golden values of the text functions, segmentation and scoring."""

import re

import pytest
from pyspark.sql import functions as F

from evigrain import lexicon as lex
from evigrain.functions import text
from evigrain.operators import scoring
from evigrain.operators.segment import fold_passages, passages_of


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("a-\n-\nb", "ab"), ("a--\nb", "a-b"), ("a-\n\nb", "a-\n\nb"), ("x -\ny", "x y"), ("line-\r\nnext", "line-\n\nnext"), ("a  b\t c\nd", "a b c d"), ("", ""), (None, ""), ("\n\n \n", "")],
)
def test_clean_page(spark, raw, clean):
    assert one(spark, text.clean_page(F.col("t")), t=raw) == clean


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t="A b. C d! É e? 9 f.  G h.") == ["A b.", "C d! É e?", "9 f.", "G h."]
    assert one(spark, text.sentences(F.col("t")), t=None) == []


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="A 28-day Follow-up, b x2 É") == ["day", "follow-up", "x2"]


def test_unique_join(spark):
    df = spark.createDataFrame([(["b", " B ", None, "", "a\n c", "d"],)], "v array<string>")
    assert df.select(text.unique_join(F.col("v"), 2)).first()[0] == "b; a c"
    assert df.select(text.unique_join(F.slice("v", 3, 2), 2)).first()[0] is None


def test_hits_are_cut_before_they_are_made_unique(spark):
    t = "A total of 310 patients (n=150 and n = 160) were seen."
    assert one(spark, text.all_hits(F.col("t"), lex.SAMPLE_PATTERNS[:3], 4), t=t) == ["n=150", "n = 160", "n=150", "n = 160"]
    t = "AUC 0.81 (95% CI 0.7-0.9); AUC was 0.85; AUROC=.9; AUROC: .912"
    assert one(spark, text.all_hits(F.col("t"), lex.PERFORMANCE_PATTERNS[:1], 8), t=t) == ["AUC 0.81 (95% CI 0.7-0.9)", "AUROC: .912"]
    assert one(spark, text.first_hit(F.col("t"), ["zz", "AUROC"]), t=t) == "AUROC"


@pytest.mark.parametrize(
    ("page", "limit", "overlap", "out"),
    [
        ("alpha one\n\nbeta two\n\ngamma", 20, 4, ["alpha one beta two", "two gamma"]),
        ("Aa bb. Cc dd. Ee ff.", 12, 0, ["Aa bb.", "Cc dd.", "Ee ff."]),
        ("Aa bb. Cc dd. Ee ff.", 12, 3, ["Aa bb.", "bb. Cc dd.", "dd. Ee ff."]),
        ("", 12, 3, []),
        (None, 12, 3, []),
        (" \n\n ", 12, 3, []),
        ("x" * 50, 12, 3, ["x" * 50]),
    ],
)
def test_segment_forms_agree(spark, page, limit, overlap, out):
    assert passages_of(page, limit, overlap) == out
    assert one(spark, fold_passages(F.col("t"), limit, overlap), t=page) == out


def test_relevance(spark):
    t = "Serum lactate predicted 28-day mortality in septic shock (AUC 0.81)."
    terms = scoring.expand(lex.DEFAULT_QUESTION)
    assert one(spark, scoring.relevance(F.col("t"), terms), t=t) == 11.25
    assert one(spark, scoring.relevance_to(F.col("t"), text.array_of(terms)), t=t) == 11.25
    assert one(spark, scoring.relevance(F.col("t"), ["or"]), t="çor or orç or_x or-x") == 2.5
    assert one(spark, scoring.relevance(F.col("t"), terms), t=None) == 0


@pytest.mark.parametrize("question", ["", None, lex.DEFAULT_QUESTION, "Does an asterisk mark HR or SOFA?", "the of"])
def test_expansion_forms_agree(spark, question):
    assert set(one(spark, scoring.expand_column(F.col("q")), q=question)) == set(scoring.expand(question))
    assert scoring.expand("asterisk")[-3:] == ["odds ratio", "hazard ratio", "regression"]


def test_predictor_promotion(spark):
    from evigrain.operators.extract import predictors

    t = "Temperature, SOFA, Charlson."
    assert one(spark, predictors(F.col("t"), ["or"]), t=t) == "SOFA score; Charlson Comorbidity Index; Temperature"
    assert re.match("SOFA", one(spark, predictors(F.col("t"), []), t=t))
