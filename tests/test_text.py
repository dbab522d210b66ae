"""Column functions on literal cases."""

from pyspark.sql import functions as F

from loomtext.functions import numeric as N
from loomtext.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def lit(spark, x):
    return F.lit(x)


def test_hash_counts_utf16_units(spark):
    assert one(spark, T.fnv1a32(F.lit("hello"))) == "4f9f2cab"
    h = 2166136261
    for u in (0xD83D, 0xDE00):
        h = ((h ^ u) * 16777619) & 0xFFFFFFFF
    assert one(spark, T.fnv1a32(F.lit("😀"))) == f"{h:08x}"
    assert one(spark, T.fnv1a32(F.lit(None).cast("string"))) == f"{2166136261:08x}"


def test_tokens_estimate(spark):
    assert one(spark, T.estimate_tokens(F.lit("a😀b1"))) == 2
    assert one(spark, T.estimate_tokens(F.lit(""))) == 0


def test_word_slices(spark):
    t = F.lit(" a b  c ")
    assert one(spark, T.words(t)) == ["a", "b", "c"]
    assert one(spark, T.words(F.lit(""))) == []
    assert one(spark, T.first_n_words(t, 3)) == " a b  c "
    assert one(spark, T.first_n_words(t, 2)) == "a b"
    assert one(spark, T.last_n_words(t, 2)) == "b c"
    assert one(spark, T.last_n_words(t, 9)) == " a b  c "
    assert one(spark, T.slice_first_n_words(t, 9)) == "a b c"
    assert one(spark, T.slice_first_n_words(t, 0)) == ""


def test_tokenisers(spark):
    assert one(spark, T.tokens(F.lit("The Été-big, ox of 2024 was"))) == ["été", "big", "2024"]
    assert one(spark, T.tokens(F.lit("The Été-big"), T.ASCII_SPLIT)) == ["big"]
    assert one(spark, T.token_set(F.lit("the cat the"))) == ["the", "cat"]


def test_snippet(spark):
    text = F.lit("x" * 50 + "needle" + "y" * 50)
    assert one(spark, T.snippet(text, F.lit("NEEDLE"), 30)) == "…" + "x" * 10 + "needle" + "y" * 14 + "…"
    assert one(spark, T.snippet(text, F.lit("none"), 5)) == "xxxxx"


def test_surroundings_absent(spark):
    s = one(spark, T.surroundings(F.lit("a b c"), F.lit("z")))
    assert (s["before"], s["after"]) == ("", "")


def test_budgets(spark):
    assert one(spark, T.trim_head(F.lit("abcdefghij"), F.lit(2), "Note")) == "abcdefgh\n\n[Note: truncated to ~2 tokens]"
    assert one(spark, T.trim_tail(F.lit("abcdefghij"), F.lit(2), "Note")) == "[Note: showing last ~2 tokens]\n\ncdefghij"
    b = one(spark, N.context_budget(F.lit(128_000)))
    assert (b["output"], b["other"], b["context"]) == (6000, 4000, 118_000)
    assert one(spark, N.output_budget(F.lit(10_000), F.lit(5_000))) is None


def test_clamps(spark):
    assert one(spark, N.clamp_int(F.lit(float("nan")), 2, 9)) == 2
    assert one(spark, N.clamp_int(F.lit(7.9), 2, 9)) == 7
    assert one(spark, N.normalize_limit(F.lit(float("inf")))) == 20
    assert one(spark, N.normalize_limit(F.lit(1000.0))) == 200


def test_names(spark):
    assert one(spark, T.normalize_name(F.lit("  Jean-Luc_O'Neil! "))) == "jean luc oneil"
    assert one(spark, T.name_similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert one(spark, T.name_similarity(F.lit(""), F.lit(""))) == 0.0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, N.dot(a, b)) == 11.0
    assert one(spark, N.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_markup(spark):
    assert one(spark, T.html_to_plain(F.lit("<p>a &amp; b</p> <p>c</p><ul><li>d</li><li>e</li></ul>"))) == "a & b\n\ncd\ne"
    assert one(spark, T.escape_rtf(F.lit("{a}\\\nb"))) == "\\{a\\}\\\\\\par\nb"
    assert one(spark, T.escape_regex(F.lit("a.b*"))) == "a\\.b\\*"
    assert one(spark, T.sanitize_file_name(F.lit(' a:b"c '))) == "a_b_c"
    assert one(spark, T.sanitize_file_name(F.lit("  "))) == "book"


def test_paths(spark):
    assert one(spark, T.parent_path(F.lit("a/b/c.md"))) == "a/b"
    assert one(spark, T.parent_path(F.lit("c.md"))) == ""
    assert one(spark, T.normalize_folder(F.lit("\\a\\b/"), "Exports")) == "a/b"
    assert one(spark, T.ensure_extension(F.lit("x.RTF"), "rtf")) == "x.RTF"
