from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import markup as M


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("o")).first()["o"]


def test_numeric_brackets_hand_trace(spark):
    # "[[3]]", "[]" and an unclosed "[4" stay; "[1]" and "[12]" go.
    assert one(spark, "alpha [1] [x] [12]b [[3]] [] [4", T.strip_numeric_brackets) == \
        "alpha  [x] b [[3]] [] [4"


def test_numeric_brackets_do_not_cross_lines(spark):
    assert one(spark, "a [1\n2] b [7]", T.strip_numeric_brackets) == "a [1\n2] b "


def test_category_prefix(spark):
    assert one(spark, "Category:Math and Category:Geo", T.strip_category_prefix) == "Math and Geo"


def test_drop_blank_lines_unicode_space(spark):
    text = "a\n  \n \t\nb\n"
    assert one(spark, text, T.drop_blank_lines) == "a\nb"


def test_clean_document_order(spark):
    # blank-line check happens before the replacements: a line that becomes
    # empty after cleaning is kept
    text = "x [1]\n \n[2]\nCategory:[3]"
    assert one(spark, text, T.clean_document) == "x \n\n"


def test_tokenize_unicode_underscore_apostrophe(spark):
    toks = one(spark, "Élan snake_case don't DON'T 3rd", T.tokenize)
    assert toks == ["élan", "snake_case", "don", "t", "don", "t", "3rd"]


def test_stopwords_keep_duplicates(spark):
    df = spark.createDataFrame([(["the", "cat", "the", "cat", "is"],)], "t array<string>")
    assert df.select(T.remove_stopwords("t")).first()[0] == ["cat", "cat"]


def test_doc_id_from_file_name(spark):
    names = ["id_12.txt", "id_7", "id_5.tar.gz", "id_x.txt", "other.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(T.doc_id_from_file_name("n")).collect()]
    assert got == [12, 7, 5, None, None]


def test_file_name_and_compose(spark):
    df = spark.createDataFrame([(3, "T", "body\nmore")], "id long, title string, text string")
    r = df.select(T.file_name_from_doc_id("id").alias("f"), T.compose_document("title", "text").alias("d")).first()
    assert r["f"] == "id_3.txt" and r["d"] == "T\nbody\nmore"
    back = df.select(T.split_title(T.compose_document("title", "text")).alias("s")).first()["s"]
    assert back["title"] == "T" and back["text"] == "body\nmore"


def test_decode_and_ascii(spark):
    df = spark.createDataFrame([("naïve café",)], "t string")
    r = df.select(T.decode_utf8(F.encode("t", "UTF-8")).alias("u"), T.ascii_only("t").alias("a")).first()
    assert r["u"] == "naïve café" and r["a"] == "nave caf"


def test_wiki_to_plain(spark):
    text = ("'''Algebra''' is <ref>cite</ref>a [[Mathematics|branch]] of [[math]]{{cn}}.\n"
            "== History ==\n<!-- hidden -->{| table |}[http://x.org site]")
    assert one(spark, text, T.wiki_to_plain) == "Algebra is a branch of math.\nHistory\nsite"


def test_nested_wiki_documents(spark):
    cases = [
        (1, "a {{x {{y}} {| z\n|}}} b", "a  b"),
        (2, "a\n{| o\n| b\n{| i\n|}\n| c\n|}\nd", "a\n\nd"),
        (3, "[[File:f.png|thumb|see [[p|the page]] now]]!", "see the page now!"),
        (4, "open {{ stays and {{this}} goes", "open {{ stays and  goes"),
        (5, "closed }} stays ]] |} {{gone}}", "closed }} stays ]] |} "),
        (6, "{{{p}}} {{a|{{{b}}}}} {{{{c}} d", "  {{ d"),
        (7, "&eacute;&#233;&#xE9; &amp;lt; &nosuch; &#0;&#x1F642; &", "ééé &lt; &nosuch; \ufffd🙂 &"),
        (8, "", ""), (9, None, None), (10, "{{" * 3000 + "x" + "}}" * 2999 + " y", "{{ y"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in cases], "doc_id long, text string, at string")
    got = {r.doc_id: r.plain for r in M.wiki_documents_to_plain(df).collect()}
    assert got == {i: want for i, _, want in cases}
    assert M.wiki_documents_to_plain(df.limit(0)).count() == 0
    plan = M.wiki_documents_to_plain(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_html_to_plain(spark):
    html = ("<html><head><script>var a='<p>';</script><style>p{}</style></head>"
            "<body><p>Fish &amp; chips&nbsp;&lt;3</p><!-- c --><b>ok</b></body></html>")
    assert one(spark, html, T.html_to_plain) == "Fish & chips\u00a0<3 ok"
