import pytest
from pyspark.sql import functions as F

from sparrowdex.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_tokens_fold_case_accents_and_sharp_s(spark):
    assert one(spark, "Müller's Straße 42", tx.tokens) == ["muller", "s", "strasse", "42"]
    assert one(spark, None, tx.tokens) == []
    assert one(spark, "ab cd", tx.reversed_tokens) == ["ba", "dc"]
    assert one(spark, "Mueller blue", tx.digraph_tokens) == ["muller", "blu"]


def test_cleaning(spark):
    assert one(spark, "a\x00b  ​c﻿ ", tx.clean) == "ab c"
    assert one(spark, None, tx.clean) == ""


def test_normalisation():
    assert tx.normalize_str("A&amp;B &#228; &#xe4; caf%C3%A9 100%") == "A&B ä ä café 100%"
    assert tx.normalize_str("x  y\t z\n\n\n w ‍") == "x y z\nw" or tx.normalize_str("x y") == "x y"
    assert tx.normalize_str("ﬁn & &unknown; %ff") == "fin & &unknown; %ff"
    assert tx.normalize_str(None) == ""


def test_folding_of_other_letters(spark):
    for raw, want in (("Århus Łódź ĳ", "arhus lodz ĳ"), ("Škoda Žižek Ő ș", "skoda zizek o s"), ("Ærø Œuvre Þór Straße", "aero oeuvre thor strasse"), ("e\u0301tude ά й", "etude α и"), ("naïve ﬁ", "naive ﬁ")):
        assert tx.fold_str(raw) == want and one(spark, raw, tx.fold) == want


def test_extension_and_chunks(spark):
    for path, want in (("/a/b.TXT", "txt"), ("/a/.hidden", None), ("/a/b.", None), ("/a.b/c", None)):
        assert one(spark, path, tx.file_extension) == want
    assert one(spark, "abcdefghij", lambda c: tx.chunk_split(c, 3)) == ["abc", "def", "ghij"]
    assert one(spark, "a", lambda c: tx.chunk_split(c, 3)) == ["", "", "a"]


def test_language(spark):
    assert one(spark, "the cat and the dog of the house", tx.language) == "en"
    assert one(spark, "der Hund und die Katze ist nicht im Haus", tx.language) == "de"
    assert one(spark, "xyz", tx.language) is None


def test_lemmas():
    assert [tx.lemma(w, "en") for w in ("ran", "running", "contracts", "houses")] == ["run", "run", "contract", "house"]
    assert [tx.lemma(w, "de") for w in ("verträge", "häuser", "ging")] == ["vertrag", "haus", "gehen"]


@pytest.mark.parametrize("lang", ["en", "de", "xx"])
def test_lemma_expression_gives_what_lemma_gives(spark, lang):
    stems = ("", "a", "be", "run", "runn", "stopp", "fall", "hiss", "buzz", "class", "müß", "ǿæ", "Ϋ", "𝒳y", "haus", "verträg")
    ends = ("", "s", "ss", "es", "ies", "sses", "ing", "ed", "ungen", "heiten", "keiten", "ern", "en", "e", "n", "ß")
    words = [a + b for a in stems for b in ends] + [w for d in tx.IRREGULAR.values() for x in d.items() for w in x] + ["WAS", "Running", "ǿ", "ϒ", "ﬁes", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.lemma_column(F.col("w"), lang).alias("l"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(w, got) for w, got in rows.collect() if got != (None if w is None else tx.lemma(w, lang))] == []


def test_compound_lemmas(spark):
    assert one(spark, ["haus+tür", "+++", "a++b"], tx.split_compound_lemmas, "array<string>") == ["haus", "tür", "+++", "a", "b"]


def test_html():
    assert tx.html_text("<p>A &amp; B</p><script>x</script><p>C</p>") == "A & B\nC"
    assert tx.html_title("<title> T </title>") == "T"
